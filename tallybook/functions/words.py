"""Word lists, constants and patterns that decide results."""

# fixed values: lines that never continue a memo
CONTINUATION_BLOCK = [
    "EXTRATO", "SALDO", "PAGE", "PÁGINA", "CONTINUA", "PERIODO:", "PAG.:", "DATA DOCUMENTO", "COOP CRED",
    "POUP E INVEST", "AGENCIA:", "CONTA:", "TOTAL", "SUJEITO", "AUTENTICAÇÃO", "OUVIDORIA", "SAC", "ALÔ",
    "DEFICIT", "SUPERAVIT", "TRANSPORTE", "TRANSPORT", "SALDO ANTERIOR", "SALDO ATUAL", "SALDO DO DIA",
    "LANCAMENTOS", "DATA HISTORICO",
]
# fixed values: memos that mark balance rows
BALANCE_MEMO_BLOCK = ["saldo", "total", "transporte", "transport", "a transportar"]
# fixed values: header words above a transaction
HEADER_ABOVE = ["Lançamentos", "Saldo em Conta", "Limite de Crédito", "Saldo Disponível", "Data", "Histórico",
                "Valor", "Extrato", "Página", "Saldo do Dia"]
NO_DESCRIPTION = "Descrição não capturada"
# fixed values: sign words of the free-form rule
DEBIT_WORDS = ["DEBITO", "PAGTO", "ENVIADO", "SAQU", "TARIFA", "PIX -", "PGTO", "RESGATE"]
CREDIT_WORDS = ["CREDITO", "RECEBIDO", "ESTORN", "DEPOSITO", "PIX +", "APLICA"]
# fixed values: month names
MONTHS = ["JAN", "FEV", "MAR", "ABR", "MAI", "JUN", "JUL", "AGO", "SET", "OUT", "NOV", "DEZ"]
# fixed values: balance lines and lines to ignore in the free-form rule
BALANCE_LINE = ["SALDO", "S A L D O", "TRANSPORTE"]
IGNORED_LINE = ["SALDO", "TOTAL", "ANTERIOR", "S A L D O", "TRANSPORTADO", "BLOQUEADO"]
ZERO_AMOUNTS = [r"\b0,00\s*[DC]?\b", r"\b0\.00\s*[DC]?\b"]
# fixed values: monthly code layout, lines that end a memo
G331_STOP = ["SALDO", "S A L D O", "DOCUMENTO", "VALOR", "AGÊNCIA"]
# fixed values: dotted-date layout, lines left out of memos
DOT_IGNORED = ["SALDO", "DATA", "HISTÓRICO", "MOD.", "EXTRATO", "CONTA CORRENTE", "AGÊNCIA", "LIM. ESPECIAL",
               "BLOQUEADO", "DISPONÍVEL", "CPMF", "VENCIMENTO", "OURO EMPRESARIAL"]
# fixed values: full layout and simple layout headers
FULL_HEADER = ["DOCUMENTO", "DATA", "LANÇAMENTO"]
SIMPLE_HEADER = ["DOCUMENTO", "DATA", "SALDO", "AGÊNCIA", "LANÇAMENTO", "HISTÓRICO", "VALOR", "DIA", "LOTE"]
# fixed values: column layout of code 341
ITAU_POSITIVE = ["PIX QR", "CREDITO", "RECEBIDO", "ESTORNO", "RESGATE", "DEP.", "RENDIMENTO"]
ITAU_NEGATIVE = ["PIX ENVIADO", "DEBITO", "PAGTO", "TARIFA", "MANUT", "DOC/TED", "CP MAESTRO", "EST SHOP", "SISPAG",
                 "PAG.", "CH COMPENSADO", "DÉBITO", "TRANSFERENCIA E", "PGTO", "IOF", "JUROS"]
# fixed values: column layout of code 237
BRADESCO_SKIP = ["EXTRATO DE", "SALDO ANTERIOR", "LANÇAMENTO"]
# fixed values: column layout of code 756
SICOOB_SKIP = ["SISBR", "COOPERATIVA", "EXTRATO", "LANÇAMENTOS", "DATA DOCUMENTO", "CHEQUE ESPECIAL", "LIMITE",
               "TARIFAS VENCIDAS", "JUROS VENCIDOS", "ENCARGOS", "RESUMO", "TAXA", "OUVIDORIA", "SAC:", "CNPJ:"]
SICOOB_BALANCE = ["DIA", "EM CONTA", "ANTERIOR"]
# fixed values: outgoing type words of the block layout
STONE_OUT = ["SAÍDA", "SAIDA", "DÉBITO", "DEBITO"]
# fixed values: type indicators of the layout-driven rule
DEBIT_MARKS = ["D", "DEB", "DEBITO", "DÉBITO", "-", "DR"]
CREDIT_MARKS = ["C", "CRED", "CREDITO", "CRÉDITO", "+", "CR"]
# fixed values: messages
MSG_UNKNOWN = "Saldo Inicial/Final não detectado."
MSG_VALID = "Conciliação Perfeita! ✅"
MSG_FLIPPED = "Corrigido Automaticamente (Inversão de Sinal) 🤖✅"
MSG_RESTORED = "Corrigido Automaticamente (Linha Restaurada) 🤖✅"
MSG_NO_LAYOUT = "Layout not detected in Text mode."
AUTO_MOVEMENT = "Rende Fácil - Movimentação Automática"
# fixed values: statuses, sources and colours of the timeline
MATCHED, MATCHED_COMBO = "Conciliado", "Conciliado (Comb)"
LEDGER_ONLY, BANK_ONLY = "Apenas no Diário", "Apenas no Banco"
LEDGER_SRC, BANK_SRC = "Diário", "Banco"
# fixed values: bank codes
BANKS = {
    "001": "Banco do Brasil S.A.",
    "003": "Banco da Amazônia S.A.",
    "004": "Banco do Nordeste do Brasil S.A.",
    "021": "BANESTES S.A. Banco do Estado do Espírito Santo",
    "033": "Banco Santander (Brasil) S.A.",
    "041": "Banco do Estado do Rio Grande do Sul S.A.",
    "047": "Banco do Estado de Sergipe S.A.",
    "070": "BRB - Banco de Brasília S.A.",
    "077": "Banco Inter S.A.",
    "104": "Caixa Econômica Federal",
    "208": "Banco BTG Pactual S.A.",
    "212": "Banco Original S.A.",
    "237": "Banco Bradesco S.A.",
    "260": "Nu Pagamentos S.A. (Nubank)",
    "336": "Banco C6 S.A.",
    "341": "Itaú Unibanco S.A.",
    "389": "Banco Mercantil do Brasil S.A.",
    "422": "Banco Safra S.A.",
    "655": "Banco Votorantim S.A.",
    "745": "Banco Citibank S.A.",
    "748": "Banco Cooperativo Sicredi S.A.",
    "756": "Banco Cooperativo do Brasil S.A. (SICOOB)",
    "633": "Banco Rendimento S.A.",
    "290": "PagSeguro Internet S.A.",
    "323": "Mercado Pago IP Ltda.",
    "074": "Banco Safra S.A.",
    "637": "Banco Sofisa S.A.",
    "643": "Banco Pine S.A.",
    "653": "Banco Voiter S.A.",
    "079": "Banco Original do Agronegócio S.A.",
}
UNKNOWN_BANK, NOT_DETECTED = "Banco Desconhecido", "Não Detectado"
# fixed values: shipped layouts (file name, name, code, keywords); line pattern ".*", no columns
LAYOUTS = [
    ("01_sicoob", "Sicoob", "756", ["SICOOB"]),
    ("02_sicredi", "Sicredi", "748", ["COOP CRED"]),
    ("03_bradesco", "Bradesco", "237", ["TOTAL DISPONÍVEL"]),
    ("04_santander", "Santander", "033", ["Internet Banking"]),
    ("05_cef", "CEF", "104", ["Extrato por período"]),
    ("06_stone", "Stone", "999", ["Stone"]),
    ("07_sicredi_associado", "Sicredi Associado", "748", ["Associado:", "Cooperativa:"]),
    ("10_bb", "Banco do Brasil", "001", ["Agência", "Lote"]),
    ("110_bb", "Banco do Brasil", "001", ["Agência", "Lote"]),
    ("111_itau", "Itau", "341", ["lançamentos", "período"]),
    ("11_itau", "Itau", "341", ["Agência", "lançamentos", "período"]),
]
# fixed values: rule sets by bank code or by upper-case layout name without blanks
RULE_SETS = {"001": "bb", "STONE": "stone", "104": "cef", "748": "sicredi", "033": "santander", "341": "itau",
             "237": "bradesco", "756": "sicoob", "CRESOL": "cresol"}
