"""Statement rules on small texts with known results."""
import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallybook.functions import scalars as S
from tallybook.operators import balance as B
from tallybook.operators import extract_lines as X
from tallybook.operators import extract_words as V
from tallybook.plans.queries_text import ABOVE_LAYOUT, DOT_LAYOUT
from tallybook.sources.ledger_files import ledger_from_balance_lines


def date(text):
    return datetime.datetime.strptime(text, "%d/%m/%Y").date()


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("page_no", "line_no").collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("text,want", [("1.234,56", "1234.56"), ("234,56", "234.56"), ("1.234.567,89", "1234567.89"), ("0,01", "0.01"), ("0,00", "0.00"),
                                       ("-1.000,00", "1000.00"), ("1000.00", "100000.00"), ("R$ 5,00", "0.00"), ("", "0.00")])
def test_br_amount(spark, text, want):
    assert value(spark, S.br_amount_abs(F.lit(text))) == D(want)


def test_amount_with_separators(spark):
    assert value(spark, S.amount_with_seps(F.lit("1,234.56"), ",", ".")) == D("1234.56")


@pytest.mark.parametrize("text,want", [("5,00D", "-5.00"), ("5,00C", "5.00"), ("-5,00", "5.00"), ("1.000,00*", "1000.00"), ("x", "0.00")])
def test_suffix_amount(spark, text, want):
    assert value(spark, S.br_amount_suffix(F.lit(text))) == D(want)


@pytest.mark.parametrize("text,want", [("Pagamento referente a NF 12345", True), ("AB", False), ("================", False), ("-----------------", False),
                                       ("SALDO ANTERIOR", False), ("EXTRATO MENSAL", False), ("PÁGINA 1 DE 3", False), ("CPF: **/**/****", False), ("A TRANSPORTAR", False)])
def test_continuation(spark, text, want):
    assert value(spark, S.is_continuation(F.lit(text))) is want


def test_generic(lines):
    text = "\n".join(["15.01.2024 PIX ENVIADO PARA 150,00 D", "FULANO DE TAL", "CPF FINAL 123", "15.01.2024 SALDO DO DIA 1.000,00 C", "ainda o mesmo",
                      "16.01.2024 ZERADA 0,00 C", "17.01.2024 PAGTO REF: NF-123/456 & CIA 50,00 C"])
    txn, gone = X.extract_generic(lines(text, "LINHA DA PAGINA DOIS"), DOT_LAYOUT)
    assert rows(txn, "amount", "memo", "type", "fitid") == [
        (D("-150.00"), "PIX ENVIADO PARA FULANO DE TAL CPF FINAL 123 ainda o mesmo", "DEBIT", "2024011515000"),
        (D("50.00"), "PAGTO REF: NF-123/456 & CIA LINHA DA PAGINA DOIS", "CREDIT", "202401175000")]
    assert rows(gone, "amount", "memo") == [(D("1000.00"), "SALDO DO DIA")]


def test_generic_no_rows(lines):
    txn, gone = X.extract_generic(lines("Este é um texto\nsem transações"), DOT_LAYOUT)
    assert txn.count() == 0 and gone.count() == 0


def test_scan_balances(lines):
    got = X.scan_balances(lines("Saldo Anterior 1.000,00\nx\nsaldo atual 9,00\nSaldo Atual 1.150,00"), DOT_LAYOUT).first()
    assert (got.bal_start, got.bal_end) == (D("1000.00"), D("1150.00"))


def test_memo_above(lines):
    text = "PAGAMENTO DE TITULOS\n30/09/2025 10,00 D\n01/10/2025 5,00 C\nData Histórico Valor\n02/10/2025 7,00 C"
    assert rows(X.extract_memo_above(lines(text), ABOVE_LAYOUT), "amount", "memo") == [
        (D("-10.00"), "PAGAMENTO DE TITULOS"), (D("5.00"), "Descrição não capturada"), (D("7.00"), "Descrição não capturada")]


DOT_1 = """Extrato de Conta
Data Dia Histórico Lote Banco Origem Documento Valor - R$ Saldo - R$
30.04.2025 Saldo anterior 0,00 C
02.05.2025 870-Transferência recebida 99020 3935 603935000011535 504,00 C
02/05 11:47 MARIA EXEMPLO
02.05.2025 870-Transferência recebida 99021 612936000050123 445,00 C
Mod. 0.51.291-3 - Folha 1"""
DOT_2 = """14.05.2025 470-Transferência enviada 99021 611873000132161 5.821,00 D
14/05 13:13 JOAO EXEMPLO
14.05.2025 798-BB Rende Fácil 9903 1.122,95 C 0,00 C
Rende Facil"""
DOT_3 = """30.05.2025 109-Pagamento de Boleto 13105 53001 7.387,20 D
ALIMENTOS EXEMPLO LTDA
30.05.2025 351-BB Rende Fácil 9903 3.692,24 D 0,00 C
Rende Facil
Lim. Especial: OURO EMPRESARIAL
Bloqueado - R$ Disponível - R$ CPMF cobrado - R$ Vencimento Limite - R$"""


def test_bb_dot_pages(lines):
    data = lines(DOT_1, DOT_2, DOT_3)
    got = {m.split(" 99")[0] + m[-15:]: (a, m) for a, m in rows(X.extract_bb_dot(data), "amount", "memo")}
    by_memo = {m: a for a, m in got.values()}
    find = lambda part: next((a, m) for m, a in by_memo.items() if part in m)
    assert find("603935000011535")[0] == D("504.00") and find("603935000011535")[1].endswith("MARIA EXEMPLO")
    assert find("611873000132161")[0] == D("-5821.00") and "JOAO EXEMPLO" in find("611873000132161")[1]
    assert find("53001")[0] == D("-7387.20") and "ALIMENTOS EXEMPLO LTDA" in find("53001")[1]
    bal = B.file_balances(X.bb_dot_balances(data)).first()
    assert (bal.bal_start, bal.bal_end) == (D("0.00"), D("0.00"))


def test_bb_simple_consumes_lines(lines):
    text = "\n".join(["02/01/2025", "Dep dinheiro ATM", "1234 99 100,00 (+)", "03/01/2025 Pagto boleto", "04/01/2025 outro 30,00 (-)",
                      "05/01/202 9903 BB Rende 13.508,56 (-)", "06/01/2025", "07/01/2025 so texto", "sem valor"])
    assert rows(X.extract_bb_simple(lines(text), 2025), "date", "amount", "memo") == [
        (date("02/01/2025"), D("100.00"), "Dep dinheiro ATM 1234 99"),
        # the dated line below supplies the amount and is used up
        (date("03/01/2025"), D("-30.00"), "Pagto boleto 04/01/2025 outro"),
        (date("05/01/2025"), D("-13508.56"), "BB Rende")]


def test_bb_full_truncated_year(lines):
    text = "05/03/2024 3935 99020870 Transferência 5.186,00 C\n06/03/202 9903 BB Rende 10,00 (-)\nDATA LANÇAMENTO 1\n07/03/2024 3935 99020870 X 1,00 D"
    assert rows(X.extract_bb_full(lines(text), 2019), "date", "amount", "memo") == [
        (date("05/03/2024"), D("5186.00"), "Transferência"), (date("06/03/2024"), D("-10.00"), "BB Rende"), (date("07/03/2024"), D("-1.00"), "X")]


def test_g331(lines):
    text = "\n".join(["Saldo Anterior 10,00 D", "08:11 ANA 02/01/2025 02/01/2025 0000 14175 Pix Enviado 1.000,00 D 5,00 C", "detalhe", "VALOR total", "perdida",
                      "03/01/2025 0000 1 Dep 7,00 C", "S A L D O 12,00 C"])
    data = lines(text)
    assert rows(X.extract_bb_g331(data), "amount", "memo", "balance") == [
        (D("-1000.00"), "08:11 ANA Pix Enviado detalhe", D("5.00")), (D("7.00"), "Dep", None)]
    bal = X.bb_g331_balances(data).first()
    assert (bal.bal_start, bal.bal_end) == (D("-10.00"), D("12.00"))


def test_stone_blocks(lines):
    text = "\n".join(["DATA TIPO LANÇAMENTO", "ANA", "10/05/2025 Entrada Recebível 10,00 110,00", "Pix | Maquininha", "LOJA", "BIA", "09/05/2025 Saída 5,00 100,00",
                      "08/05/2025 Débito Tarifa 1,00 105,00", "CAIO", "07/05 Crédito 2,00 106,00", "99 123,45"])
    assert rows(X.extract_stone(lines(text), 2025), "date", "amount", "memo", "balance") == [
        (date("10/05/2025"), D("10.00"), "ANA Recebível Pix | Maquininha LOJA", D("110.00")),
        (date("09/05/2025"), D("-5.00"), "BIA Saída", D("100.00")),
        (date("08/05/2025"), D("-1.00"), "Tarifa", D("105.00")),
        (date("07/05/2025"), D("2.00"), "CAIO Crédito", D("106.00"))]


def test_smart_words(words):
    data = words((10, 100, "SALDO"), (40, 100, "ANTERIOR"), (90, 100, "1.000,00"), (10, 120, "Loja"), (30, 120, "Azul"), (10, 140, "05"), (20, 140, "/"), (25, 140, "FEV"),
                 (60, 140, "PAGTO"), (100, 140, "1.234,56"), (10, 160, "06/02/2023"), (60, 160, "TED"), (100, 160, "10,00"), (130, 160, "C"), (150, 160, "90,00"),
                 (10, 180, "07/02/23"), (60, 180, "nada"), (100, 180, "0,00"))
    got = rows(V.extract_smart(data, 2020), "date", "amount", "memo")
    assert got == [(date("05/02/2023"), D("-1234.56"), "Loja Azul"), (date("06/02/2023"), D("10.00"), "06/02/2023 TED 10,00 C 90,00")]
    bal = V.smart_balances(data, 2020).first()
    assert (bal.bal_start, bal.bal_end) == (D("1000.00"), D("90.00"))


def test_bradesco_carries_date_and_stops_at_footer(words):
    page1 = words((30, 10, "01/02/2024"), (100, 10, "PIX"), (350, 10, "10,00"), (520, 10, "110,00"), (100, 20, "ANA"), file="f", page=1)
    page2 = words((100, 10, "TED"), (450, 10, "5,00"), (520, 10, "105,00"), (100, 20, "Total"), (520, 20, "105,00"), (100, 30, "resto"), (350, 30, "9,00"), file="f", page=2)
    data = page1.unionByName(page2)
    assert rows(V.extract_bradesco(data), "page_no", "date", "amount", "memo", "balance") == [
        (1, date("01/02/2024"), D("10.00"), "PIX ANA", D("110.00")), (2, date("01/02/2024"), D("-5.00"), "TED", D("105.00"))]
    ends = {r.page_no: r.bal_end for r in V.bradesco_balances(data).collect()}
    assert ends == {1: D("110.00"), 2: D("105.00")}


def test_ledger_running_balance_over_pages(lines):
    data = lines("01/02/2024\n100,00D Venda", "cont.\nTotal 1\n30,00D Saque\n02/02/2024\n50,00C Estorno")
    got = rows(ledger_from_balance_lines(data), "date", "amount", "signed_amount", "description")
    assert got == [(date("01/02/2024"), D("100.00"), D("100.00"), "Venda cont."), (date("01/02/2024"), D("70.00"), D("-70.00"), "Saque"),
                   (date("02/02/2024"), D("80.00"), D("-80.00"), "Estorno")]


@pytest.mark.parametrize("start,end,amounts,valid", [(1000, 1075, [100, -50, 25], True), (1000, 1100, [100, -50], False), (None, 1100, [100], None), (1000, 1100, [100.01], True)])
def test_balance_check(spark, start, end, amounts, valid):
    txn = spark.createDataFrame([("f", D(str(a))) for a in amounts], "file string, amount decimal(18,2)")
    bal = spark.createDataFrame([("f", start and D(start), D(end))], "file string, bal_start decimal(18,2), bal_end decimal(18,2)")
    assert B.validate_balance(txn, bal).first().is_valid is valid


def statement(spark, amounts):
    return spark.createDataFrame([("f", 1, i, D(a), "DEBIT" if a < 0 else "CREDIT", "m") for i, a in enumerate(amounts)],
                                 "file string, page_no int, line_no int, amount decimal(18,2), type string, memo string")


@pytest.mark.parametrize("start,end,amounts,gone,want,method", [
    (1000, 850, [100, -50], [], [-100, -50], "Text (Auto-Corrected)"), (1000, 950, [-100], [50], [-100, 50], "Text (Auto-Corrected)"),
    (1000, 900, [100], [], [-100], "Text (Auto-Corrected)"), (1000, 5000, [100, -50], [7], [100, -50], "Text"), (None, 950, [-100], [50], [-100], "Text")])
def test_repair(spark, start, end, amounts, gone, want, method):
    bal = spark.createDataFrame([("f", start and D(start), D(end))], "file string, bal_start decimal(18,2), bal_end decimal(18,2)")
    fixed, status = B.auto_repair(statement(spark, amounts), statement(spark, gone or [0]).filter("amount <> 0"), bal)
    assert sorted(int(r.amount) for r in fixed.collect()) == sorted(want)
    assert status.first().method == method


@pytest.mark.parametrize("text,want", [
    ("PIX para Maria Souza", True), ("ref. nota 123", True), ("ok", False), ("Saldo do dia 10,00", False), ("SALDO ANTERIOR", False), ("Ouvidoria 0800 000 000", False), ("Página 3 de 4", False),
    ("lançamentos futuros", True), ("LANCAMENTOS FUTUROS", False), ("Coop Cred Central", False), ("conta: 12-3", False), ("autenticação mecânica", False), ("----- fim -----", False),
    ("...continua", False), ("cartão **/**/**** x", False), ("Alô cliente", False), ("Sujeito a alteração", False), ("transporte de valores", False), ("total geral", False)])
def test_continuation_sentences(spark, text, want):
    assert value(spark, S.is_continuation(F.lit(text))) is want


@pytest.mark.parametrize("text,want", [
    ("", True), ("Saldo em conta", True), ("total geral", True), ("bloqueado 3 dias", True), ("S A L D O", True), ("transportado", True), ("mês anterior", True), ("tarifa 0,00 D", True),
    ("tarifa 0.00", True), ("tarifa 10,00 D", False), ("PIX recebido", False)])
def test_ignored_sentences(spark, text, want):
    assert value(spark, S.should_ignore(F.lit(text))) is want


@pytest.mark.parametrize("code,want", [
    ("001", "Banco do Brasil S.A."), ("0.33 ", "Banco Santander (Brasil) S.A."), ("104", "Caixa Econômica Federal"), ("237", "Banco Bradesco S.A."), ("341", "Itaú Unibanco S.A."),
    ("748", "Banco Cooperativo Sicredi S.A."), ("756", "Banco Cooperativo do Brasil S.A. (SICOOB)"), ("260", "Nu Pagamentos S.A. (Nubank)"), ("999", "Banco Desconhecido"), ("", "Banco Desconhecido")])
def test_bank_names(spark, code, want):
    from tallybook.sources.catalog import bank_name
    assert value(spark, bank_name(F.lit(code))) == want


@pytest.mark.parametrize("bank,layout,want", [
    ("001", "x", "bb"), ("104", "x", "cef"), ("748", "x", "sicredi"), ("033", "x", "santander"), ("341", "x", "itau"), ("237", "x", "bradesco"), ("756", "x", "sicoob"),
    ("999", "Stone", "stone"), (None, "Cre sol", "cresol"), ("000", "other", "generic"), ("001", None, None)])
def test_routes(spark, bank, layout, want):
    from tallybook.sources.catalog import route
    df = spark.createDataFrame([(bank, layout)], "bank_id string, layout string")
    assert route(df).first().rule_set == want


def test_stone_sorts_a_page_once(spark):
    """A task holds one sorted copy of its lines; pages with anchors and lines of every kind are in the plain form below."""
    import random

    from tallybook.operators.extract_lines import extract_stone
    rng = random.Random(7)
    kinds = ["01/03/2025 Entrada Loja 10,00 20,00", "02/03/2025 Saída Tarifa 1,00 19,00", "03/03/2025 sem valores", "texto {}", "nota {}", "R$ 120,00 a parte", "SALDO do dia", "  "]
    rows = [(f"f{f}", 1, i, rng.choice(kinds).format(i)) for f in range(60) for i in range(25)]
    out = extract_stone(spark.createDataFrame(rows, "file string, page_no int, line_no int, text string"), 2025)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 1
    want = []
    for f in range(60):
        lines = [(r[2], r[3].strip()) for r in rows if r[0] == f"f{f}" and r[3].strip()]
        anchors = [i for i, (_, t) in enumerate(lines) if t[:2].isdigit()]
        takes = {i: "Entrada" in lines[i][1] for i in anchors}
        memo = {i: [(i, "Loja" if takes[i] else "Tarifa")] for i in anchors if "sem valores" not in lines[i][1]}
        for i, (_, t) in enumerate(lines):
            if i in anchors:
                continue
            up, down = max((a for a in anchors if a < i), default=None), min((a for a in anchors if a > i), default=None)
            if up is not None and takes[up] and i - up <= 2 and not any("," in lines[x][1] for x in range(up + 1, i + 1)):
                memo[up].append((i, t))
            elif down is not None and takes[down] and down - i <= 3 and not any("," in lines[x][1] or "SALDO" in lines[x][1] for x in range(i, down)):
                memo[down].append((i, t))
        want += [(f"f{f}", lines[i][0], " ".join(t for _, t in sorted(m))) for i, m in memo.items()]
    assert sorted((r.file, r.line_no, r.memo) for r in out.collect()) == sorted(want)


def test_strip_takes_off_what_unicode_calls_white_space(spark):
    from pyspark.sql import functions as F

    from tallybook.functions.scalars import strip
    texts = [f"{chr(c)}a{chr(c)}b{chr(c)}" for c in [*range(0x2000), *range(0x2000, 0x3100), 0xFEFF]] + ["", " \n\r\n", "x \r\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~strip("t").eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).collect() == []
    assert "regexp" not in df.select(strip("t"))._jdf.queryExecution().optimizedPlan().toString()
