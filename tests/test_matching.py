"""Matching against plain loops on random data, with hot amounts, hot accounts and many id blocks."""
import datetime
import random
from itertools import combinations

import pytest

from tallybook.operators import match as M
from tallybook.operators.combo import combo_assign, combo_enumerate
from tallybook.operators.match import pairs
from tallybook.plans.reconcile import reconcile

DAY0 = datetime.date(2024, 1, 1)
DDL = "account_id long, row_id long, date date, cents long, description string"


def side(rng, n, accounts, amounts, days, stride):
    """Rows (account, id, day, cents); ids far apart so that one class spans several id blocks."""
    ids = rng.sample(range(n * 3), n)
    return [(rng.choice(accounts), i * stride, rng.randrange(days), rng.choice(amounts)) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame([(a, i, DAY0 + datetime.timedelta(d), c, "x") for a, i, d, c in rows], DDL)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[2], r[3], r[1]))


def loop_one_to_one(ledger, bank, tol):
    out = []
    for acct in {r[0] for r in ledger}:
        led, free, no = in_order(r for r in ledger if r[0] == acct), in_order(r for r in bank if r[0] == acct), 0
        left = []
        for row in led:
            hit = next((b for b in free if b[2] == row[2] and b[3] == row[3]), None)
            if hit is None:
                left.append(row)
                continue
            free.remove(hit)
            out.append((acct, row[1], hit[1], no))
            no += 1
        for row in left:
            near = sorted((b for b in free if b[3] == row[3] and abs(b[2] - row[2]) <= tol), key=lambda b: (abs(b[2] - row[2]), b[2], b[1]))
            if near:
                free.remove(near[0])
                out.append((acct, row[1], near[0][1], no))
                no += 1
    return sorted(out)


@pytest.mark.parametrize("seed,accounts,amounts,days,stride", [
    (1, [1], [100, -100], 12, 1), (2, [1, 2, 3], [100, 200, -300], 30, 1), (3, [1, 1, 1, 2], [500], 25, 1 << 15), (4, [7], [100, 101], 4, 1 << 16)])
@pytest.mark.parametrize("tol", [0, 3])
def test_one_to_one(spark, seed, accounts, amounts, days, stride, tol):
    rng = random.Random(seed)
    ledger, bank = (side(rng, 120, accounts, amounts, days, stride) for _ in range(2))
    tagged = M.match_one_to_one(frame(spark, ledger), frame(spark, bank), ["account_id"], tol)
    got = sorted((r.account_id, r.ledger_id, r.bank_id, r.match_no) for r in pairs(*tagged, ["account_id"]).collect())
    assert got == loop_one_to_one(ledger, bank, tol)


def test_one_to_one_empty_side(spark):
    led = frame(spark, [(1, 1, 0, 5)])
    none = frame(spark, [(1, 1, 0, 5)]).limit(0)
    tagged, _ = M.match_one_to_one(led, none, ["account_id"])
    assert [r.match_id for r in tagged.collect()] == [None]


@pytest.mark.parametrize("seed", range(3))
def test_any_sign(spark, seed):
    rng = random.Random(seed)
    ledger, bank = (side(rng, 80, [1, 2], [100, -100, 250, -250], 20, 1) for _ in range(2))
    want = []
    for acct in (1, 2):
        free = in_order(r for r in ledger if r[0] == acct)
        for b in in_order(r for r in bank if r[0] == acct):
            near = [x for x in free if abs(x[2] - b[2]) <= 3]
            hit = next((x for x in near if x[3] == b[3]), None) or next((x for x in near if x[3] == -b[3]), None)
            if hit:
                free.remove(hit)
                want.append((b[1], hit[1]))
    got = M.match_any_sign(frame(spark, bank), frame(spark, ledger), ["account_id"]).collect()
    assert sorted((r.bank_id, r.ledger_id) for r in got) == sorted(want)


def first_combo(pool, target, max_size=4):
    for size in range(2, max_size + 1):
        for pick in combinations(pool, size):
            if abs(abs(sum(p[3] for p in pick)) - abs(target)) <= 1:
                return pick
    return None


def loop_combos(ledger, bank, tol, cap):
    out = []
    for acct in {r[0] for r in bank}:
        free = in_order(r for r in ledger if r[0] == acct)
        for b in in_order(r for r in bank if r[0] == acct):
            pool = [x for x in free if abs(x[2] - b[2]) <= tol][:cap]
            pick = first_combo(pool, b[3])
            if pick:
                out += [(b[1], p[1]) for p in pick]
                free = [x for x in free if x not in pick]
    return sorted(out)


@pytest.mark.parametrize("seed,n_ledger,n_bank,days,cap,slice_rows", [
    (1, 60, 40, 60, 20, 10**6), (2, 120, 60, 25, 5, 10**6), (3, 150, 80, 20, 6, 4), (4, 200, 90, 30, 20, 7), (5, 100, 60, 10, 4, 1), (6, 160, 60, 3, 20, 5),
    # days far longer than their bank rows can use up
    (7, 400, 4, 4, 3, 10**6), (8, 500, 6, 12, 2, 2),
    # no bound: pools of dozens of rows
    (9, 120, 12, 8, None, 10**6), (10, 90, 10, 5, None, 3)])
def test_combo_assign(spark, seed, n_ledger, n_bank, days, cap, slice_rows):
    """Small slices force the parallel runs of one hot account to settle on the sequential result."""
    rng = random.Random(seed)
    amounts = [rng.randrange(-400, 900) for _ in range(40)]
    ledger = side(rng, n_ledger, [1, 1, 1, 2], amounts, days, 1)
    bank = side(rng, n_bank, [1, 1, 1, 2], [rng.randrange(100, 1500) for _ in range(50)], days, 1)
    got = combo_assign(frame(spark, bank), frame(spark, ledger), ["account_id"], cap, 3, 4, slice_rows).collect()
    assert sorted((r.bank_id, r.ledger_id) for r in got) == loop_combos(ledger, bank, 3, cap)


def test_combo_enumerate_nets_signed_rows(spark):
    """A payment and its discount: -6825.97 + 2242.68 = -4583.29."""
    ledger = frame(spark, [(1, 1, 0, -682597), (1, 2, 1, 224268), (1, 3, 1, 777)])
    got = combo_enumerate(frame(spark, [(1, 9, 2, -458329)]), ledger, ["account_id"], None).first()
    assert (got.size, got.members) == (2, [1, 2])


def test_reconcile_invariants(spark):
    rng = random.Random(9)
    ledger = side(rng, 300, [1, 2], [100, 200, 300, 450], 40, 1)
    bank = side(rng, 200, [1, 2], [100, 300, 500, 650], 60, 1)
    done = reconcile(frame(spark, ledger), frame(spark, bank), ["account_id"], 20)
    view = done.view.toPandas()
    last = {a: max(r[2] for r in ledger if r[0] == a) for a in (1, 2)}
    first = {a: min(r[2] for r in ledger if r[0] == a) for a in (1, 2)}
    inside = [r for r in bank if first[r[0]] <= r[2] <= last[r[0]]]
    assert len(view) == len(ledger) + len(inside)
    assert not view.duplicated(["source", "row_id"]).any()
    groups = view[view.group_id != "-1"].groupby(["account_id", "group_id"])
    for (_, name), rows in groups:
        led, bnk = rows[rows.source == "Diário"], rows[rows.source == "Banco"]
        assert len(bnk) == 1
        if name.startswith("S-"):
            assert len(led) == 1 and led.cents.iloc[0] == bnk.cents.iloc[0]
        else:
            assert 2 <= len(led) <= 4 and abs(abs(led.cents.sum()) - abs(bnk.cents.iloc[0])) <= 1
        assert (rows.cluster_date == rows.date.min()).all()


def test_rows_without_date_stay_unmatched(spark):
    ledger = spark.createDataFrame([(1, 1, DAY0, 5, "x"), (1, 2, None, 5, "x")], DDL)
    bank = spark.createDataFrame([(1, 1, DAY0, 5, "x"), (1, 2, DAY0, None, "x")], DDL)
    for side_ in M.match_one_to_one(ledger, bank, ["account_id"]):
        assert sorted((r.row_id, r.match_id) for r in side_.collect()) == [(1, "S-0"), (2, None)]


def test_no_row_is_lost_on_the_way(spark):
    """Rows without a date, an account or both go through the timeline, the sheets and the export like any other."""
    from tallybook.operators import journal as J
    from tallybook.operators import report as R
    from tallybook.operators import view as V
    rows = [(a, i, d, 100 * (i % 3 + 1), f"t{i}") for i, (a, d) in enumerate(
        [(a, d) for a in (1, 2, None) for d in (DAY0, DAY0 + datetime.timedelta(2), None) for _ in range(3)])]
    ledger, bank = spark.createDataFrame(rows, DDL), spark.createDataFrame(rows[::2], DDL)
    tagged = M.match_one_to_one(ledger, bank, ["account_id"])
    none = spark.createDataFrame([], "account_id long, bank_id long, ledger_id long, group_id string, cluster_date date")
    view = V.build_view(*tagged, none, ["account_id"])
    total = len(rows) + len(rows[::2])
    placed = V.sort_view(view, ["account_id"])
    edged = V.with_group_edges(placed, ["account_id"]).collect()
    assert len(edged) == total
    for account in (1, 2, None):
        own = sorted((r for r in edged if r.account_id == account), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(1, len(own) + 1))
        dates = [r.cluster_date for r in own]
        assert dates == sorted(dates, key=lambda d: (d is None, d))
    assert M.with_rank(ledger, ["account_id"]).count() == len(rows)
    sheets = R.report_sheets(view, ["account_id"]).collect()
    assert sum(r["Descrição"] != "TOTAL:" for r in sheets) == total
    entries = ledger.selectExpr("account_id", "cast(row_id as string) id", "date", "cast(cents as decimal(18,2)) amount", "description", "'1' conta_debito", "'' participante_debito",
                                "'2' conta_credito", "'' participante_credito", "'001' documento")
    lines = J.to_journal_lines(entries, ["account_id"]).collect()
    assert sorted((str(r.account_id), r.n) for r in lines) == sorted((str(a), n) for a in (1, 2, None) for n in range(1, 10))
    assert all(len(r.line.split(",")) == 12 for r in lines)


def test_a_null_amount_keeps_its_field(spark):
    from tallybook.operators import journal as J
    entries = spark.createDataFrame([(1, "a", "2025-01-01", None, "x"), (1, "b", "2025-01-02", 5, None)], "account_id long, id string, date string, amount long, description string")
    entries = entries.selectExpr("*", "'1' conta_debito", "null participante_debito", "'2' conta_credito", "'' participante_credito", "'001' documento")
    lines = [r.line for r in J.to_journal_lines(entries, ["account_id"]).orderBy("n").collect()]
    assert lines == ["1,01/01/2025,1,,2,,0.00,,x,DCTO,,001", "2,02/01/2025,1,,2,,5.00,,,DCTO,,001"]


def test_search_equals_every_subset():
    import itertools
    import random

    import numpy as np

    from tallybook.operators import combo as C
    rng = random.Random(3)
    for i in range(300):
        values = [rng.randint(-40, 40) if i % 2 else rng.randint(-3000, 3000) for _ in range(rng.randint(2, 12))]
        want = rng.randint(0, 120 if i % 2 else 4000)
        hits = (list(at) for size in (2, 3, 4) for at in itertools.combinations(range(len(values)), size) if abs(abs(sum(values[x] for x in at)) - want) <= 1)
        assert C._search(np.array(values), want, 4) == next(hits, None)


def test_unbounded_combos_of_a_hot_day(spark):
    """Many rows of one account in one window: no array of it goes along with the bank rows, and blocks of them are searched apart."""
    import random
    rng = random.Random(5)
    ledger = [(1, i, 1 + i % 7, rng.randint(-900_000, 900_000)) for i in range(30_000)] + [(2, 50_000, 2, 70), (2, 50_001, 3, 30)]
    bank = [(1, i, 4, rng.randint(1, 900_000)) for i in range(600)] + [(2, 900, 3, 100), (2, 901, 3, 5), (None, 902, 3, 100)]
    got = combo_enumerate(frame(spark, bank), frame(spark, ledger), ["account_id"], None).collect()
    cents = {i: c for _, i, _, c in ledger}
    wanted = {i: c for _, i, _, c in bank}
    assert sorted(r.bank_id for r in got) == [*range(600), 900]
    assert all(r.size == 2 and abs(abs(sum(cents[m] for m in r.members)) - wanted[r.bank_id]) <= 1 and not r.pool_cut for r in got)


def test_unbounded_combos_send_long_windows_only_to_tasks_of_their_own(spark, monkeypatch):
    from itertools import islice

    from tallybook.operators import combo as C
    rng = random.Random(5)
    ledger = [(a, 100 * a + i, 5, rng.randint(-300, 900)) for a in (1, 2) for i in range(24 if a == 1 else 25)]
    bank = [(a, 10 * a + i, 5, rng.randint(1, 2_000)) for a in (1, 2, 3) for i in range(8)]
    alone = []
    windows = C._enumerate_windows
    monkeypatch.setattr(C, "_enumerate_windows", lambda asks, *rest: alone.append(asks) or windows(asks, *rest))
    got = combo_enumerate(frame(spark, bank), frame(spark, ledger), ["account_id"], None).collect()
    assert {r.account_id for r in alone[0].collect()} == {2}
    for account, row_id, _, cents in bank:
        pool = sorted((x[3], x[1]) for x in ledger if x[0] == account)
        hits = (c for size in (2, 3, 4) for c in combinations(pool, size) if abs(abs(sum(x[0] for x in c)) - cents) <= 1)
        assert [r.members for r in got if (r.account_id, r.bank_id) == (account, row_id)] == [[x[1] for x in h] for h in islice(hits, 1)]


def test_narrow_pools_are_pruned_by_their_subsets():
    """Only what a subset without repeats can meet stays: 2 * 50 does not meet 100."""
    import numpy as np
    import pandas as pd

    from tallybook.operators import combo as C
    rng = random.Random(11)
    pools = [[rng.randint(-60, 90) for _ in range(rng.randint(2, 14))] for _ in range(400)] + [[50, 7], [50, 50], [1]]
    want = [rng.randint(0, 300) * rng.choice((1, -1)) for _ in range(400)] + [100, 100, 2]
    got = C._may_fit_each(pd.Series([np.array(p) for p in pools]), pd.Series(want), 4)
    exact = [any(abs(abs(sum(c)) - abs(w)) <= 1 for size in (2, 3, 4) for c in combinations(p, size)) for p, w in zip(pools, want)]
    assert got.tolist() == [e if len(p) <= C.NARROW else C._may_fit(np.array(p), abs(w), 4) for e, p, w in zip(exact, pools, want)]
    assert got[-3:].tolist() == [False, True, False]
    assert all(g or not e for g, e in zip(got, exact))


def test_timeline_is_gone_through_once(spark):
    """First dates of groups, and the sheets with their totals, each take the timeline's rows one time."""
    from pyspark.sql import functions as F

    from tallybook.functions import words as W
    from tallybook.operators import report as R
    from tallybook.operators import view as V
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(cents):
        read.add(1)
        return cents
    day = datetime.date(2024, 1, 5)
    rows = [(1, i, day - datetime.timedelta(i % 3), 100 + i, f"d{i}", W.BANK_SRC if i % 2 else W.LEDGER_SRC, W.MATCHED if i < 4 else W.BANK_ONLY if i % 2 else W.LEDGER_ONLY,
             f"S-{i // 2}" if i < 4 else "-1") for i in range(9)]
    view = spark.createDataFrame(rows, "account_id long, row_id long, date date, cents long, description string, source string, status string, group_id string")
    view = view.withColumn("cents", seen.asNondeterministic()("cents"))
    dated = {r.row_id: r.cluster_date for r in V.with_cluster_date(view, ["account_id"]).collect()}
    assert dated == {r[1]: min(x[2] for x in rows if x[7] == r[7]) if r[7] != "-1" else r[2] for r in rows}
    assert read.value == len(rows)
    sheets = R.report_sheets(view, ["account_id"]).collect()
    assert sum(r.Valor for r in sheets if r["Descrição"] == "TOTAL:") == sum(r[3] for r in rows) and len(sheets) == len(rows) + 3
    assert read.value == 2 * len(rows)
