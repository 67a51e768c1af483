"""Figures over the timeline. Their SQL builds the same timeline with a recursive greedy."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.functions import words as W
from tallybook.operators import report as R
from tallybook.operators.clean import filter_view
from tallybook.operators.match import match_one_to_one
from tallybook.operators.view import build_view
from tallybook.plans.fixtures import KEYS, ledger_of, orders_bank, with_amount
from tallybook.plans.queries_match import NUMBERED, VIEW, VIEW_GAPS, WHOLE, exact_view, no_combos, whole_view
from tallybook.plans.registry import SIDES, query
from tallybook.sinks.files import divergences

# the timeline after both one-to-one steps
TWO = f"""{NUMBERED}, view1 AS (
  SELECT l.account_id, l.row_id, l.date, l.cents, l.description, 'Diário' AS source, CASE WHEN n.match_no IS NULL THEN 'Apenas no Diário' ELSE 'Conciliado' END AS status,
         coalesce('S-' || n.match_no, '-1') AS group_id FROM ledger l LEFT JOIN num n ON n.ledger_id = l.row_id
  UNION ALL SELECT b.account_id, b.row_id, b.date, b.cents, b.description, 'Banco', CASE WHEN n.match_no IS NULL THEN 'Apenas no Banco' ELSE 'Conciliado' END,
         coalesce('S-' || n.match_no, '-1') FROM bank b LEFT JOIN num n ON n.bank_id = b.row_id)"""


def two_step_view(spark, sf):
    led, bank = match_one_to_one(ledger_of(spark, sf), orders_bank(spark, sf), KEYS)
    return build_view(led, bank, no_combos(spark), KEYS)


@query("a11_recon_metrics", f"""{TWO} SELECT account_id, count(*) FILTER (WHERE source = 'Diário') AS ledger_total, count(*) FILTER (WHERE source = 'Banco') AS bank_total,
  CAST(abs(coalesce(sum(cents) FILTER (WHERE status = 'Apenas no Diário'), 0) - coalesce(sum(cents) FILTER (WHERE status = 'Apenas no Banco'), 0)) AS BIGINT) AS diff_initial,
  CAST(abs(coalesce(sum(cents) FILTER (WHERE status = 'Apenas no Diário'), 0) - coalesce(sum(cents) FILTER (WHERE status = 'Apenas no Banco'), 0)) AS BIGINT) AS diff_final,
  CAST(0 AS BIGINT) AS comb_count FROM view1 GROUP BY 1""")
def a11(spark, sf):
    return R.recon_metrics(two_step_view(spark, sf), KEYS)


@query("a11_metrics_with_combos", f"""{WHOLE} SELECT account_id, count(*) FILTER (WHERE source = 'Diário') AS ledger_total, count(*) FILTER (WHERE source = 'Banco') AS bank_total,
  CAST(abs(coalesce(sum(cents) FILTER (WHERE status <> 'Conciliado' AND source = 'Diário'), 0) - coalesce(sum(cents) FILTER (WHERE status <> 'Conciliado' AND source = 'Banco'), 0)) AS BIGINT) AS diff_initial,
  CAST(abs(coalesce(sum(cents) FILTER (WHERE status = 'Apenas no Diário'), 0) - coalesce(sum(cents) FILTER (WHERE status = 'Apenas no Banco'), 0)) AS BIGINT) AS diff_final,
  count(*) FILTER (WHERE source = 'Banco' AND status = 'Conciliado (Comb)') AS comb_count FROM whole GROUP BY 1""")
def a11c(spark, sf):
    return R.recon_metrics(whole_view(spark, sf), KEYS)


@query("a12_daily_chart", f"""{SIDES} SELECT account_id, date, CAST(coalesce(l, 0) AS BIGINT) AS ledger, CAST(coalesce(b, 0) AS BIGINT) AS bank FROM
  (SELECT account_id, date, sum(cents) AS l FROM ledger GROUP BY 1, 2) FULL JOIN (SELECT account_id, date, sum(cents) AS b FROM bank GROUP BY 1, 2) USING (account_id, date)""")
def a12(spark, sf):
    return R.daily_chart(ledger_of(spark, sf), orders_bank(spark, sf), KEYS)


@query("a13_status_counts", f"{TWO} SELECT account_id, status, count(*) AS n FROM view1 GROUP BY 1, 2")
def a13(spark, sf):
    return R.status_counts(two_step_view(spark, sf), KEYS)


@query("a13_status_buckets", f"""{VIEW} SELECT account_id, CASE WHEN contains(status, 'Conciliado') THEN 'Conciliado' WHEN contains(status, 'Banco') THEN 'Pendente Banco' ELSE 'Pendente Diário' END AS bucket,
  count(*) AS n FROM view1 GROUP BY 1, 2""")
def a13b(spark, sf):
    return R.status_buckets(exact_view(spark, sf), KEYS)


@query("a14_recon_summary", f"""{TWO}, s AS (SELECT account_id, count(*) AS total, count(*) FILTER (WHERE contains(status, 'Conciliado')) AS matched,
  count(*) FILTER (WHERE status = 'Apenas no Banco') AS bank_only, count(*) FILTER (WHERE status = 'Apenas no Diário') AS ledger_only FROM view1 GROUP BY 1)
SELECT *, format('{{:.1f}}', matched * 100 / total) || '%' AS rate, CASE WHEN matched * 100 / total >= 80 THEN 'high' WHEN matched * 100 / total >= 50 THEN 'medium' ELSE 'low' END AS band FROM s""")
def a14(spark, sf):
    return R.recon_summary(two_step_view(spark, sf), KEYS)


@query("a15_report_metrics", f"""{TWO} SELECT account_id, CAST(sum(cents) FILTER (WHERE source = 'Banco') AS BIGINT) AS bank_total, CAST(sum(cents) FILTER (WHERE source = 'Diário') AS BIGINT) AS ledger_total,
  CAST(abs(coalesce(sum(cents) FILTER (WHERE status = 'Apenas no Diário'), 0) - coalesce(sum(cents) FILTER (WHERE status = 'Apenas no Banco'), 0)) AS BIGINT) AS net_diff,
  count(*) FILTER (WHERE status = 'Apenas no Banco') AS unmatched_bank_count, count(*) FILTER (WHERE status = 'Apenas no Diário') AS unmatched_ledger_count,
  min(date) AS start_date, max(date) AS end_date FROM view1 GROUP BY 1""")
def a15(spark, sf):
    return R.report_metrics(two_step_view(spark, sf), KEYS)


@query("a16_bank_match_rate", f"""{TWO}, s AS (SELECT account_id, count(*) FILTER (WHERE contains(status, 'Conciliado')) AS matched_bank, count(*) AS bank_total FROM view1 WHERE source = 'Banco' GROUP BY 1)
SELECT *, CAST(round(CAST(matched_bank * 100 AS DECIMAL(18,6)) / bank_total, 1) AS DOUBLE) AS match_rate FROM s""")
def a16(spark, sf):
    return R.bank_match_rate(two_step_view(spark, sf), KEYS)


@query("a17_flow_summary", f"""{TWO}, s AS (SELECT account_id, count(*) FILTER (WHERE source = 'Diário' AND contains(status, 'Conciliado')) AS ledger_matched, count(*) FILTER (WHERE source = 'Diário') AS ledger_total,
  count(*) FILTER (WHERE source = 'Banco' AND contains(status, 'Conciliado')) AS bank_matched, count(*) FILTER (WHERE source = 'Banco') AS bank_total FROM view1 GROUP BY 1)
SELECT *, round(ledger_matched * 100.0 / ledger_total, 1) AS ledger_pct, ledger_total - ledger_matched AS ledger_left,
  round(bank_matched * 100.0 / bank_total, 1) AS bank_pct, bank_total - bank_matched AS bank_left FROM s""")
def a17(spark, sf):
    return R.flow_summary(two_step_view(spark, sf), KEYS)


@query("a24_view_counters", f"""{VIEW} SELECT account_id, count(*) AS total, count(*) FILTER (WHERE cents > 0) AS filtered, count(*) FILTER (WHERE status <> 'Conciliado') AS pending FROM view1 GROUP BY 1""")
def a24(spark, sf):
    return R.view_counters(exact_view(spark, sf), F.col("cents") > 0, KEYS)


@query("k5_divergences", f"""{TWO} SELECT account_id, row_id, CASE WHEN source = 'Banco' THEN 'not_in_ledger' ELSE 'not_in_bank' END AS report, date, cents, description FROM view1 WHERE group_id = '-1'""")
def k5(spark, sf):
    led, bank = match_one_to_one(ledger_of(spark, sf), orders_bank(spark, sf), KEYS)
    not_in_ledger, not_in_bank = divergences(led, bank)
    pick = ["account_id", "row_id", "date", "cents", "description"]
    return (not_in_ledger.select(*pick, F.lit("not_in_ledger").alias("report"))
            .unionByName(not_in_bank.select(*pick, F.lit("not_in_bank").alias("report"))))


@query("k6_report_sheets", f"""{VIEW_GAPS}, s AS (SELECT *, CASE status WHEN 'Conciliado' THEN 'Conciliados' WHEN 'Apenas no Banco' THEN 'Apenas Banco' ELSE 'Apenas Diário' END AS sheet FROM view1)
SELECT account_id, sheet, row_number() OVER (PARTITION BY account_id, sheet ORDER BY date, source_rank, row_id) AS ord, date AS "Data", source AS "Origem", description AS "Descrição",
  CAST(cents AS BIGINT) AS "Valor", status AS "Status", CASE WHEN group_id = '-1' THEN '' ELSE group_id END AS "Grupo" FROM s
UNION ALL SELECT account_id, sheet, count(*) + 1, NULL, NULL, 'TOTAL:', CAST(sum(cents) AS BIGINT), NULL, NULL FROM s GROUP BY 1, 2""")
def k6(spark, sf):
    return R.report_sheets(exact_view(spark, sf, gaps=True), KEYS)


@query("k8_json_rows", f"""{VIEW} SELECT account_id, row_id, '{{"row_id":' || row_id || ',"date":"' || strftime(date, '%Y-%m-%d') || '","cents":' || cents || ',"source":"' || source || '","status":"' || status ||
  '","group_id":"' || group_id || '","cluster_date":"' || strftime(cluster_date, '%Y-%m-%d') || '"}}' AS record FROM view1""")
def k8(spark, sf):
    cols = ["account_id", "row_id", "date", "cents", "source", "status", "group_id", "cluster_date"]
    return R.json_rows(exact_view(spark, sf).select(*cols), KEYS)


@query("p6_filter_view", f"""{VIEW}, t AS (SELECT *, regexp_replace(regexp_replace(CAST(CAST(cents / 100.0 AS DECIMAL(18,2)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS shown FROM view1)
SELECT account_id, row_id, source, status, cents FROM t WHERE (contains(status, 'Conciliado') OR status = 'Apenas no Banco') AND (contains(lower(description), '34.5') OR contains(shown, '34.5'))""")
def p6(spark, sf):
    view = with_amount(exact_view(spark, sf))
    return filter_view(view, [W.MATCHED, W.BANK_ONLY], "34.5").select("account_id", "row_id", "source", "status", "cents")
