"""Matching queries: ledger and bank sides derived from orders, order items against order totals."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.operators import combo as C
from tallybook.operators import match as M
from tallybook.operators import view as V
from tallybook.operators.clean import clip_to_period
from tallybook.plans.fixtures import KEYS, combo_bank, combo_ledger, ledger_of, orders_bank
from tallybook.plans.reconcile import reconcile
from tallybook.plans.registry import COMBO, COMBOS, GAPS, SIDES, query
from tallybook.session import stored

J1 = """lr AS (SELECT *, row_number() OVER (PARTITION BY account_id, date, cents ORDER BY row_id) AS k FROM ledger),
br AS (SELECT *, row_number() OVER (PARTITION BY account_id, date, cents ORDER BY row_id) AS k FROM bank),
j1 AS (SELECT account_id, date, cents, l.row_id AS ledger_id, b.row_id AS bank_id FROM lr l JOIN br b USING (account_id, date, cents, k))"""

# the greedy of the tolerant pass, one leftover ledger row per class and step
J2 = """ll AS (SELECT account_id, cents, date, row_id FROM ledger WHERE row_id NOT IN (SELECT ledger_id FROM j1)),
lb AS (SELECT account_id, cents, date, row_id FROM bank WHERE row_id NOT IN (SELECT bank_id FROM j1)),
cls AS (SELECT account_id, cents, L, B FROM
  (SELECT account_id, cents, list({'d': date, 'r': row_id} ORDER BY date, row_id) AS L FROM ll GROUP BY 1, 2)
  JOIN (SELECT account_id, cents, list({'d': date, 'r': row_id} ORDER BY date, row_id) AS B FROM lb GROUP BY 1, 2) USING (account_id, cents)),
steps AS (
  SELECT account_id, cents, L, B, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS ledger_id, CAST(NULL AS BIGINT) AS bank_id FROM cls
  UNION ALL
  SELECT account_id, cents, L, B, i + 1, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, L[i + 1].r, pick FROM (
    SELECT *, list_sort(list_transform(list_filter(B, lambda x: abs(date_diff('day', x.d, L[i + 1].d)) <= 3 AND NOT list_contains(used, x.r)),
                        lambda x: {'n': abs(date_diff('day', x.d, L[i + 1].d)), 'd': x.d, 'r': x.r}))[1].r AS pick
    FROM steps WHERE i < len(L))),
j2 AS (SELECT account_id, cents, ledger_id, bank_id FROM steps WHERE bank_id IS NOT NULL)"""
GREEDY = SIDES.replace("WITH ", "WITH RECURSIVE ", 1) + f", {J1}, {J2}"
NUMBERED = f"""{GREEDY}, allp AS (SELECT account_id, 0 AS step, ledger_id, bank_id FROM j1 UNION ALL SELECT account_id, 1, ledger_id, bank_id FROM j2),
num AS (SELECT p.account_id, p.step, p.ledger_id, p.bank_id, row_number() OVER (PARTITION BY p.account_id ORDER BY p.step, l.date, l.cents, l.row_id) - 1 AS match_no
  FROM allp p JOIN ledger l ON l.row_id = p.ledger_id)"""


def sides(spark, sf):
    return ledger_of(spark, sf), orders_bank(spark, sf)


def with_gaps(df):
    """Some rows without an account, some without a date."""
    return (df.withColumn("account_id", F.when(F.col("row_id") % 29 != 0, F.col("account_id")))
            .withColumn("date", F.when(F.col("row_id") % 31 != 0, F.col("date"))))


@query("w5_rank", f"{GAPS} SELECT account_id, row_id, row_number() OVER (PARTITION BY account_id ORDER BY date, cents, row_id) AS rank FROM ledger")
def w5(spark, sf):
    return M.with_rank(with_gaps(ledger_of(spark, sf)), KEYS).select("account_id", "row_id", "rank")


@query("p4_clip_to_period", f"""{SIDES}, p AS (SELECT account_id, min(date) AS lo, max(date) AS hi FROM ledger GROUP BY 1)
SELECT account_id, row_id, b.date, cents FROM bank b JOIN p USING (account_id) WHERE b.date BETWEEN lo AND hi""")
def p4(spark, sf):
    led, bank = sides(spark, sf)
    return clip_to_period(bank, led, KEYS).select("account_id", "row_id", "date", "cents")


@query("j1_match_exact", f"{SIDES}, {J1} SELECT * FROM j1")
def j1(spark, sf):
    return M.match_exact(*sides(spark, sf), KEYS)


@query("j2_match_tolerant", f"{GREEDY} SELECT account_id, ledger_id, bank_id FROM j2")
def j2(spark, sf):
    led, bank = sides(spark, sf)
    exact = M.match_exact(led, bank, KEYS)
    left = M.remaining(led, exact, KEYS, "ledger_id"), M.remaining(bank, exact, KEYS, "bank_id")
    return M.match_tolerant(*left, KEYS).select("account_id", "ledger_id", "bank_id")


@query("j3_match_ids", f"{NUMBERED} SELECT account_id, step, match_no, 'S-' || match_no AS match_id, ledger_id, bank_id FROM num")
def j3(spark, sf):
    led, bank = M.match_one_to_one(*sides(spark, sf), KEYS)
    return M.pairs(led, bank, KEYS).withColumn("match_id", F.concat(F.lit("S-"), F.col("match_no").cast("string")))


@query("j4_split", f"""{GREEDY} SELECT account_id, row_id, 'ledger' AS side, row_id IN (SELECT ledger_id FROM j1 UNION ALL SELECT ledger_id FROM j2) AS matched FROM ledger
UNION ALL SELECT account_id, row_id, 'bank', row_id IN (SELECT bank_id FROM j1 UNION ALL SELECT bank_id FROM j2) FROM bank""")
def j4(spark, sf):
    out = None
    for name, df in zip(("ledger", "bank"), M.match_one_to_one(*sides(spark, sf), KEYS)):
        hit, miss = M.split(df)
        for part, flag in ((hit, True), (miss, False)):
            rows = part.select("account_id", "row_id", F.lit(name).alias("side"), F.lit(flag).alias("matched"))
            out = rows if out is None else out.unionByName(rows)
    return out


@query("j8_match_any_sign", SIDES.replace("WITH ", "WITH RECURSIVE ", 1) + """, cls AS (SELECT account_id, a, L, B FROM
  (SELECT account_id, abs(cents) AS a, list({'d': date, 'c': cents, 'r': row_id} ORDER BY date, cents, row_id) AS L FROM ledger GROUP BY 1, 2)
  JOIN (SELECT account_id, abs(cents) AS a, list({'d': date, 'c': cents, 'r': row_id} ORDER BY date, cents, row_id) AS B FROM bank GROUP BY 1, 2) USING (account_id, a)),
steps AS (
  SELECT account_id, a, L, B, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS bank_id, CAST(NULL AS BIGINT) AS ledger_id FROM cls
  UNION ALL
  SELECT account_id, a, L, B, i + 1, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, B[i + 1].r, pick FROM (
    SELECT *, list_sort(list_transform(list_filter(L, lambda x: abs(date_diff('day', x.d, B[i + 1].d)) <= 3 AND NOT list_contains(used, x.r)),
                        lambda x: {'o': x.c <> B[i + 1].c, 'd': x.d, 'r': x.r}))[1].r AS pick
    FROM steps WHERE i < len(B)))
SELECT s.account_id, s.bank_id, s.ledger_id, b.cents <> l.cents AS opposite_sign FROM steps s JOIN bank b ON b.row_id = s.bank_id JOIN ledger l ON l.row_id = s.ledger_id""")
def j8(spark, sf):
    led, bank = sides(spark, sf)
    return M.match_any_sign(bank, led, KEYS).select("account_id", "bank_id", "ledger_id", "opposite_sign")


POOL = 20      # ledger rows that a combo is looked for in, as in the SQL below
CAND = """cand AS (SELECT b.account_id, b.row_id AS bank_id, b.cents AS b_cents, l.row_id AS ledger_id, l.cents,
  row_number() OVER (PARTITION BY b.account_id, b.row_id ORDER BY l.date, l.cents, l.row_id) AS place, count(*) OVER (PARTITION BY b.account_id, b.row_id) AS total
  FROM cb b JOIN cl l ON l.account_id = b.account_id AND l.date BETWEEN b.date - 3 AND b.date + 3 QUALIFY place <= 20)"""
SUBSETS = f"""{CAND}, two AS (SELECT a.account_id, a.bank_id, a.b_cents, a.place AS p, b.place AS q, a.cents + b.cents AS s, [a.ledger_id, b.ledger_id] AS m
  FROM cand a JOIN cand b ON a.bank_id = b.bank_id AND a.account_id = b.account_id AND a.place < b.place),
three AS (SELECT t.account_id, t.bank_id, t.b_cents, t.p, t.q, c.place AS r, t.s + c.cents AS s, list_append(t.m, c.ledger_id) AS m
  FROM two t JOIN cand c ON t.bank_id = c.bank_id AND t.account_id = c.account_id AND t.q < c.place),
four AS (SELECT t.account_id, t.bank_id, t.b_cents, t.p, t.q, t.r, c.place AS u, t.s + c.cents AS s, list_append(t.m, c.ledger_id) AS m
  FROM three t JOIN cand c ON t.bank_id = c.bank_id AND t.account_id = c.account_id AND t.r < c.place),
fits AS (SELECT account_id, bank_id, b_cents, 2 AS size, p, q, 0 AS r, 0 AS u, s, m FROM two UNION ALL SELECT account_id, bank_id, b_cents, 3, p, q, r, 0, s, m FROM three
  UNION ALL SELECT account_id, bank_id, b_cents, 4, p, q, r, u, s, m FROM four),
best AS (SELECT account_id, bank_id, size, m, (SELECT max(total) > 20 FROM cand c WHERE c.bank_id = fits.bank_id AND c.account_id = fits.account_id) AS pool_cut FROM fits WHERE abs(abs(s) - abs(b_cents)) <= 1
  QUALIFY row_number() OVER (PARTITION BY account_id, bank_id ORDER BY size, p, q, r, u) = 1)"""


@query("j5_combo_candidates", f"{COMBOS}, {CAND} SELECT account_id, bank_id, place, ledger_id, total > 20 AS pool_cut FROM cand")
def j5(spark, sf):
    return C.combo_candidates(combo_bank(spark, sf), combo_ledger(spark, sf), KEYS, POOL)


@query("j5_candidates_cut", f"{COMBOS}, {CAND.replace('<= 20', '<= 3')} SELECT account_id, bank_id, place, ledger_id, total > 3 AS pool_cut FROM cand")
def j5b(spark, sf):
    return C.combo_candidates(combo_bank(spark, sf), combo_ledger(spark, sf), KEYS, 3)


@query("j6_combo_enumerate", f"""{COMBOS}, {SUBSETS} SELECT account_id, bank_id, size, array_to_string(list_transform(m, lambda x: CAST(x AS VARCHAR)), ',') AS members, pool_cut FROM best""")
def j6(spark, sf):
    out = C.combo_enumerate(combo_bank(spark, sf), combo_ledger(spark, sf), KEYS, POOL)
    return out.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("j6_combo_unbounded", f"""{COMBOS}, {SUBSETS.replace(" QUALIFY place <= 20", "")} SELECT account_id, bank_id, size, array_to_string(list_transform(m, lambda x: CAST(x AS VARCHAR)), ',') AS members, FALSE AS pool_cut FROM best""")
def j6b(spark, sf):
    out = C.combo_enumerate(combo_bank(spark, sf), combo_ledger(spark, sf), KEYS, None)
    return out.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


# the sequential greedy: one bank row per account and step
J7 = f"""acc AS (SELECT account_id, B, L FROM
  (SELECT account_id, list({{'d': date, 'c': cents, 'r': row_id}} ORDER BY date, cents, row_id) AS B FROM cb GROUP BY 1)
  JOIN (SELECT account_id, list({{'d': date, 'c': cents, 'r': row_id}} ORDER BY date, cents, row_id) AS L FROM cl GROUP BY 1) USING (account_id)),
steps AS (
  SELECT account_id, B, L, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS bank_id, CAST([] AS BIGINT[]) AS pick, FALSE AS cut FROM acc
  UNION ALL
  SELECT account_id, B, L, i + 1, CASE WHEN pick IS NULL THEN used ELSE list_concat(used, pick) END, B[i + 1].r, pick, cut FROM (
    SELECT account_id, B, L, i, used, cut, coalesce(
      list_filter(list_transform(pairs, lambda k: {{'s': P[k[1]].c + P[k[2]].c, 'm': [P[k[1]].r, P[k[2]].r]}}), lambda x: abs(abs(x.s) - abs(B[i + 1].c)) <= 1)[1].m,
      list_filter(list_transform(triples, lambda k: {{'s': P[k[1]].c + P[k[2]].c + P[k[3]].c, 'm': [P[k[1]].r, P[k[2]].r, P[k[3]].r]}}), lambda x: abs(abs(x.s) - abs(B[i + 1].c)) <= 1)[1].m,
      list_filter(list_transform(quads, lambda k: {{'s': P[k[1]].c + P[k[2]].c + P[k[3]].c + P[k[4]].c, 'm': [P[k[1]].r, P[k[2]].r, P[k[3]].r, P[k[4]].r]}}), lambda x: abs(abs(x.s) - abs(B[i + 1].c)) <= 1)[1].m) AS pick
    FROM (SELECT account_id, B, L, i, used, free[1:20] AS P, len(free) > 20 AS cut FROM
      (SELECT *, list_filter(L, lambda x: abs(date_diff('day', x.d, B[i + 1].d)) <= 3 AND NOT list_contains(used, x.r)) AS free FROM steps WHERE i < len(B))) w
    JOIN combos q ON q.n = len(w.P)))"""
PLACES = """nums AS (SELECT unnest(range(1, 21)) AS x),
combos AS (SELECT n, coalesce((SELECT list([a.x, b.x] ORDER BY a.x, b.x) FROM nums a, nums b WHERE a.x < b.x AND b.x <= n), []) AS pairs,
  coalesce((SELECT list([a.x, b.x, c.x] ORDER BY a.x, b.x, c.x) FROM nums a, nums b, nums c WHERE a.x < b.x AND b.x < c.x AND c.x <= n), []) AS triples,
  coalesce((SELECT list([a.x, b.x, c.x, d.x] ORDER BY a.x, b.x, c.x, d.x) FROM nums a, nums b, nums c, nums d WHERE a.x < b.x AND b.x < c.x AND c.x < d.x AND d.x <= n), []) AS quads
  FROM (SELECT unnest(range(0, 21)) AS n))"""


@query("j7_combo_assign", f"""WITH RECURSIVE {COMBO}, {PLACES}, {J7}
SELECT account_id, bank_id, CAST(len(pick) AS INTEGER) AS size, unnest(pick) AS ledger_id, cut AS pool_cut FROM steps WHERE bank_id IS NOT NULL AND pick IS NOT NULL""")
def j7(spark, sf):
    out = C.combo_assign(combo_bank(spark, sf), combo_ledger(spark, sf), KEYS, POOL)
    return out.select("account_id", "bank_id", "size", "ledger_id", "pool_cut")


# the whole flow: bank rows inside the ledger's period, both one-to-one steps, then combos of what is left
CLIPPED = SIDES.replace("WITH ", "WITH RECURSIVE ", 1).replace("bank AS (", "bank_all AS (") + """,
period AS (SELECT account_id, min(date) AS lo, max(date) AS hi FROM ledger GROUP BY 1),
bank AS (SELECT b.* FROM bank_all b JOIN period p ON p.account_id = b.account_id AND b.date BETWEEN p.lo AND p.hi)"""
WHOLE = f"""{CLIPPED}, {J1}, {J2}, {NUMBERED.split(GREEDY + ", ", 1)[1]},
cl AS (SELECT * FROM ledger WHERE row_id NOT IN (SELECT ledger_id FROM num)), cb AS (SELECT * FROM bank WHERE row_id NOT IN (SELECT bank_id FROM num)),
{PLACES}, {J7.replace("steps", "csteps")},
heads AS (SELECT s.account_id, s.bank_id, s.pick, row_number() OVER (PARTITION BY s.account_id ORDER BY b.date, b.cents, b.row_id) - 1 AS no
  FROM csteps s JOIN bank b ON b.row_id = s.bank_id WHERE s.pick IS NOT NULL),
parts AS (SELECT account_id, no, unnest(pick) AS ledger_id FROM heads),
view0 AS (
  SELECT l.account_id, l.row_id, l.date, l.cents, l.description, 'Diário' AS source,
    CASE WHEN n.match_no IS NOT NULL THEN 'Conciliado' WHEN p.no IS NOT NULL THEN 'Conciliado (Comb)' ELSE 'Apenas no Diário' END AS status,
    coalesce('S-' || n.match_no, 'C-' || p.no, '-1') AS group_id, CASE WHEN coalesce(n.match_no, p.no) IS NULL THEN 'unmatched_ledger' ELSE 'matched_ledger' END AS color_code
  FROM ledger l LEFT JOIN num n ON n.ledger_id = l.row_id LEFT JOIN parts p ON p.ledger_id = l.row_id
  UNION ALL
  SELECT b.account_id, b.row_id, b.date, b.cents, b.description, 'Banco',
    CASE WHEN n.match_no IS NOT NULL THEN 'Conciliado' WHEN h.no IS NOT NULL THEN 'Conciliado (Comb)' ELSE 'Apenas no Banco' END,
    coalesce('S-' || n.match_no, 'C-' || h.no, '-1'), CASE WHEN coalesce(n.match_no, h.no) IS NULL THEN 'unmatched_bank' ELSE 'matched_bank' END
  FROM bank b LEFT JOIN num n ON n.bank_id = b.row_id LEFT JOIN heads h ON h.bank_id = b.row_id),
whole AS (SELECT *, CASE WHEN group_id = '-1' THEN date ELSE min(date) OVER (PARTITION BY account_id, group_id) END AS cluster_date FROM view0)"""


@query("j9_reconcile", f"{WHOLE} SELECT * FROM whole")
def j9(spark, sf):
    return reconcile(*sides(spark, sf), KEYS, POOL).view


def whole_view(spark, sf):
    """Timeline of the one-to-one data, written once: several queries read it twice."""
    return stored(reconcile(*sides(spark, sf), KEYS, POOL).view)


# items and totals: one-item orders match one to one when the day fits, the others as combos
TOTALS = WHOLE.replace(CLIPPED, f"""WITH RECURSIVE {COMBO}, ledger AS (SELECT *, 'ITEM ' || (row_id % 8) AS description FROM cl),
bank_all AS (SELECT *, 'ORDER ' || row_id AS description FROM cb), period AS (SELECT account_id, min(date) AS lo, max(date) AS hi FROM ledger GROUP BY 1),
bank AS (SELECT b.* FROM bank_all b JOIN period p ON p.account_id = b.account_id AND b.date BETWEEN p.lo AND p.hi)""").replace(
    "cl AS (SELECT * FROM ledger WHERE", "cl2 AS (SELECT * FROM ledger WHERE").replace("cb AS (SELECT * FROM bank WHERE", "cb2 AS (SELECT * FROM bank WHERE").replace(
    "AS B FROM cb GROUP", "AS B FROM cb2 GROUP").replace("AS L FROM cl GROUP", "AS L FROM cl2 GROUP")


@query("j9_reconcile_totals", f"{TOTALS} SELECT account_id, row_id, date, cents, source, status, group_id, cluster_date FROM whole")
def j9_totals(spark, sf):
    view = reconcile(combo_ledger(spark, sf), combo_bank(spark, sf), KEYS, POOL).view
    return view.select("account_id", "row_id", "date", "cents", "source", "status", "group_id", "cluster_date")


@query("w1_build_view", NUMBERED + """ SELECT account_id, row_id, date, cents, description, source, status, group_id, color_code FROM (
  SELECT l.account_id, l.row_id, l.date, l.cents, l.description, 'Diário' AS source, CASE WHEN n.match_no IS NULL THEN 'Apenas no Diário' ELSE 'Conciliado' END AS status,
         coalesce('S-' || n.match_no, '-1') AS group_id, CASE WHEN n.match_no IS NULL THEN 'unmatched_ledger' ELSE 'matched_ledger' END AS color_code
  FROM ledger l LEFT JOIN num n ON n.ledger_id = l.row_id
  UNION ALL
  SELECT b.account_id, b.row_id, b.date, b.cents, b.description, 'Banco', CASE WHEN n.match_no IS NULL THEN 'Apenas no Banco' ELSE 'Conciliado' END,
         coalesce('S-' || n.match_no, '-1'), CASE WHEN n.match_no IS NULL THEN 'unmatched_bank' ELSE 'matched_bank' END
  FROM bank b LEFT JOIN num n ON n.bank_id = b.row_id)""")
def w1(spark, sf):
    led, bank = M.match_one_to_one(*sides(spark, sf), KEYS)
    return V.build_view(led, bank, no_combos(spark), KEYS).drop("cluster_date")


def no_combos(spark):
    return spark.createDataFrame([], "account_id long, bank_id long, ledger_id long, group_id string, cluster_date date")


# a timeline by construction, for the window operators: exact pairs form groups, the rest stands alone
VIEW = f"""{SIDES}, {J1}, num AS (SELECT j.*, row_number() OVER (PARTITION BY j.account_id ORDER BY j.date, j.cents, j.ledger_id) - 1 AS no FROM j1 j),
view0 AS (SELECT l.account_id, l.row_id, l.date, l.cents, l.description, 'Diário' AS source, CASE WHEN no IS NULL THEN 'Apenas no Diário' ELSE 'Conciliado' END AS status,
    coalesce('S-' || no, '-1') AS group_id, 0 AS source_rank FROM ledger l LEFT JOIN num ON ledger_id = row_id
  UNION ALL SELECT b.account_id, b.row_id, b.date, b.cents, b.description, 'Banco', CASE WHEN no IS NULL THEN 'Apenas no Banco' ELSE 'Conciliado' END,
    coalesce('S-' || no, '-1'), 1 FROM bank b LEFT JOIN num ON bank_id = row_id),
view1 AS (SELECT *, CASE WHEN group_id = '-1' THEN date ELSE min(date) OVER (PARTITION BY account_id, group_id) END AS cluster_date FROM view0),
view2 AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY cluster_date, group_id, source_rank, row_id) AS pos FROM view1),
seen AS (SELECT account_id, group_id, min(pos) AS lo, max(pos) AS hi FROM view2 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY lo) - 1 AS idx FROM seen)"""


VIEW_GAPS = VIEW.replace(SIDES, GAPS, 1)


def exact_view(spark, sf, gaps=False):
    """The timeline of the exact pass alone."""
    led, bank = map(with_gaps, sides(spark, sf)) if gaps else sides(spark, sf)
    runs = M.one_to_one_runs(led, bank, KEYS, tol=None)
    led, bank = (M.with_match_id(M.tag_side(df, runs, KEYS, s)) for df, s in ((led, "l"), (bank, "b")))
    return V.build_view(led, bank, no_combos(spark), KEYS)


@query("w2_cluster_date", f"{VIEW} SELECT account_id, row_id, source, group_id, cluster_date FROM view1")
def w2(spark, sf):
    return V.with_cluster_date(exact_view(spark, sf), KEYS).select("account_id", "row_id", "source", "group_id", "cluster_date")


@query("w3_sort_view", f"{VIEW_GAPS} SELECT account_id, row_id, source, pos FROM view2")
def w3(spark, sf):
    return V.sort_view(exact_view(spark, sf, gaps=True), KEYS).select("account_id", "row_id", "source", "pos")


@query("w4_group_edges", f"""{VIEW_GAPS} SELECT v.account_id, v.row_id, v.source, v.group_id <> '-1' AND pos = lo AS is_first, v.group_id <> '-1' AND pos = hi AS is_last,
  idx % 2 = 0 AS is_even_group FROM view2 v JOIN ranked r ON v.account_id IS NOT DISTINCT FROM r.account_id AND v.group_id = r.group_id""")
def w4(spark, sf):
    return V.with_group_edges(V.sort_view(exact_view(spark, sf, gaps=True), KEYS), KEYS).select("account_id", "row_id", "source", "is_first", "is_last", "is_even_group")


@query("w6_top_discrepancies", f"""{VIEW_GAPS} SELECT account_id, status, row_id, place, total FROM (SELECT *, row_number() OVER (PARTITION BY account_id, status ORDER BY date, cents, row_id) AS place,
  count(*) OVER (PARTITION BY account_id, status) AS total FROM view1 WHERE status <> 'Conciliado') WHERE place <= 50""")
def w6(spark, sf):
    return V.top_discrepancies(exact_view(spark, sf, gaps=True), KEYS).select("account_id", "status", "row_id", "place", "total")
