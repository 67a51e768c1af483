"""Row types shared by the operators (DDL strings)."""

LINES = "file string, page_no int, line_no int, text string"
WORDS = "file string, page_no int, x0 double, top double, text string"
TXN = ("file string, page_no int, line_no int, date date, amount decimal(18,2), memo string, "
       "doc_id string, balance decimal(18,2)")
PAGE_BALANCES = "file string, page_no int, bal_start decimal(18,2), bal_end decimal(18,2)"
BALANCES = "file string, bal_start decimal(18,2), bal_end decimal(18,2)"
LEDGER_RAW = ("file string, pos int, transaction_id string, key string, date string, "
              "debit_account string, credit_account string, amount string, description string")
LAYOUT = ("name string, bank_id string, keywords array<string>, line_pattern string, "
          "columns array<struct<name:string,match_group:int>>, has_balance_cleanup boolean, "
          "amount_decimal_separator string, amount_thousand_separator string, date_format string, "
          "header_keywords array<string>, balance_start_pattern string, balance_end_pattern string")
ACTIVITY = ("timestamp timestamp, user string, username string, action string, category string, "
            "details map<string,string>")
MONEY = "decimal(18,2)"
