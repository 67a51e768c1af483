"""Figures over the timeline. VIEW rows carry keys, date, cents, source, status, group_id."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import words as W
from tallybook.operators.ordering import id_block, join_whole, ordinal
from tallybook.session import stored


def _matched() -> Column:
    return F.col("status").contains(W.MATCHED)


def _sum_if(flag: Column, value: str = "cents") -> Column:
    return F.coalesce(F.sum(F.when(flag, F.col(value))), F.lit(0)).cast("bigint")


def recon_metrics(view: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per side, open difference after one-to-one and after combos, number of combos. One aggregation."""
    led, bank = F.col("source") == W.LEDGER_SRC, F.col("source") == W.BANK_SRC
    not_single = F.col("status") != W.MATCHED
    return view.groupBy(*keys).agg(
        F.count_if(led).alias("ledger_total"), F.count_if(bank).alias("bank_total"),
        F.abs(_sum_if(led & not_single) - _sum_if(bank & not_single)).alias("diff_initial"),
        F.abs(_sum_if(F.col("status") == W.LEDGER_ONLY) - _sum_if(F.col("status") == W.BANK_ONLY)).alias("diff_final"),
        F.count_if(bank & (F.col("status") == W.MATCHED_COMBO)).alias("comb_count"))


def daily_chart(ledger: DataFrame, bank: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides per date; one union and one aggregation stand for the outer join."""
    zero = F.lit(0).cast("bigint")
    both = (ledger.select(*keys, "date", F.col("cents").alias("l"), zero.alias("b"))
            .unionByName(bank.select(*keys, "date", zero.alias("l"), F.col("cents").alias("b"))))
    return both.groupBy(*keys, "date").agg(F.sum("l").alias("ledger"), F.sum("b").alias("bank"))


def status_counts(view: DataFrame, keys: list[str]) -> DataFrame:
    """A13."""
    return view.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def status_buckets(view: DataFrame, keys: list[str]) -> DataFrame:
    """A13 pie buckets; empty ones do not appear."""
    bucket = (F.when(_matched(), W.MATCHED).when(F.col("status").contains("Banco"), "Pendente Banco")
              .when(F.col("status").contains("Diário"), "Pendente Diário"))
    return view.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n")).filter("bucket is not null")


def recon_summary(view: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, rate in per cent with one decimal, band."""
    s = view.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(_matched()).alias("matched"),
        F.count_if(F.col("status") == W.BANK_ONLY).alias("bank_only"),
        F.count_if(F.col("status") == W.LEDGER_ONLY).alias("ledger_only"))
    rate = F.col("matched") * 100 / F.col("total")
    return s.select("*", F.when(F.col("total") > 0, F.concat(F.format_string("%.1f", rate), F.lit("%"))).otherwise("0%").alias("rate"),
                    F.when(rate >= 80, "high").when(rate >= 50, "medium").otherwise("low").alias("band"))


def report_metrics(view: DataFrame, keys: list[str]) -> DataFrame:
    """A15."""
    bank_only, ledger_only = F.col("status") == W.BANK_ONLY, F.col("status") == W.LEDGER_ONLY
    return view.groupBy(*keys).agg(
        _sum_if(F.col("source") == W.BANK_SRC).alias("bank_total"), _sum_if(F.col("source") == W.LEDGER_SRC).alias("ledger_total"),
        F.abs(_sum_if(ledger_only) - _sum_if(bank_only)).alias("net_diff"), F.count_if(bank_only).alias("unmatched_bank_count"),
        F.count_if(ledger_only).alias("unmatched_ledger_count"), F.min("date").alias("start_date"), F.max("date").alias("end_date"))


def bank_match_rate(view: DataFrame, keys: list[str]) -> DataFrame:
    """Per cent of the bank rows that are matched."""
    bank = F.col("source") == W.BANK_SRC
    out = view.groupBy(*keys).agg(F.count_if(bank & _matched()).alias("matched_bank"), F.count_if(bank).alias("bank_total"))
    return out.withColumn("match_rate", F.when(F.col("bank_total") > 0, F.round(F.col("matched_bank") * 100.0 / F.col("bank_total"), 1))
                          .otherwise(0.0).cast("double"))


def flow_summary(view: DataFrame, keys: list[str]) -> DataFrame:
    """Matched rows of both sides with percentages, and what is left."""
    led, bank = F.col("source") == W.LEDGER_SRC, F.col("source") == W.BANK_SRC
    out = view.groupBy(*keys).agg(
        F.count_if(led & _matched()).alias("ledger_matched"), F.count_if(led).alias("ledger_total"),
        F.count_if(bank & _matched()).alias("bank_matched"), F.count_if(bank).alias("bank_total"))
    for side in ("ledger", "bank"):
        out = out.withColumn(f"{side}_pct", F.when(F.col(f"{side}_total") > 0, F.round(
            F.col(f"{side}_matched") * 100.0 / F.col(f"{side}_total"), 1)).cast("double"))
        out = out.withColumn(f"{side}_left", F.col(f"{side}_total") - F.col(f"{side}_matched"))
    return out


def view_counters(view: DataFrame, shown: Column, keys: list[str]) -> DataFrame:
    """Rows in all, rows the filter shows, rows still pending."""
    return view.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(shown).alias("filtered"),
        F.count_if(F.col("status").isin(W.BANK_ONLY, W.LEDGER_ONLY)).alias("pending"))


def entry_counters(entries: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Bank, manual and selected entries per key. ``selected``: keys, id."""
    chosen = selected.select(*keys, "id").distinct().withColumn("__sel", F.lit(True))
    marked = join_whole(entries, chosen, [*keys, "id"], "left")
    return marked.groupBy(*keys).agg(F.count_if(F.col("source") == "bank").alias("bank"), F.count_if(F.col("source") == "manual").alias("manual"),
                      F.count_if("__sel").alias("selected"))


def report_sheets(view: DataFrame, keys: list[str]) -> DataFrame:
    """K6: the rows of the three sheets and a TOTAL row each; ``ord`` is the row's place, the total comes last."""
    sheet = (F.when(_matched(), "Conciliados").when(F.col("status") == W.BANK_ONLY, "Apenas Banco")
             .when(F.col("status") == W.LEDGER_ONLY, "Apenas Diário"))
    rows = view.withColumn("sheet", sheet).filter("sheet is not null").withColumn("__src", F.when(F.col("source") == W.LEDGER_SRC, 0).otherwise(1))
    # written once, for the places and for the totals
    table = stored(rows.withColumn("__blk", F.struct(F.col("__src").alias("a"), id_block().alias("b"))).select(
        *keys, "sheet", "date", "source", "description", "cents", "status", "group_id", "row_id", "__src", "__blk"))
    # rows of one id stand in the order that small tables always had them in, the later match first
    later = [F.length("group_id").desc(), F.col("group_id").desc()]
    rows = ordinal(table, [*keys, "sheet"], ["date", "__blk"], ["__src", "row_id", *later], "ord", written=True)
    body = rows.select(*keys, "sheet", "ord", F.col("date").alias("Data"), F.col("source").alias("Origem"),
                       F.col("description").alias("Descrição"), F.col("cents").alias("Valor"), F.col("status").alias("Status"),
                       F.when(F.col("group_id") == "-1", "").otherwise(F.col("group_id")).alias("Grupo"))
    total = table.groupBy(*keys, "sheet").agg(
        F.sum("cents").alias("Valor"), (F.count("*") + 1).alias("ord")).withColumn("Descrição", F.lit("TOTAL:"))
    return body.unionByName(total, allowMissingColumns=True)


def json_rows(view: DataFrame, keys: list[str]) -> DataFrame:
    """K8: one JSON record per row with ISO dates."""
    iso = view.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if c in ("date", "cluster_date") else F.col(c) for c in view.columns])
    return iso.select(*keys, "row_id", F.to_json(F.struct(*[c for c in iso.columns if c not in keys])).alias("record"))

