"""Journal entries: bank-only rows with edits, manual entries, the export lines."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.scalars import iso_text_to_br
from tallybook.operators.ordering import join_whole, ordinal
from tallybook.schemas import MONEY

# fixed values: defaults of an entry
DEFAULTS = {"conta_debito": "78", "participante_debito": "", "conta_credito": "6670", "participante_credito": "", "documento": "001"}
ENTRY = ["id", "date", "amount", "description", *DEFAULTS, "source", "is_edited"]


def overlay_edits(bank_only: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Latest value per edited field over the defaults. ``edits``: keys, id, field, value, seq; of equal seq the larger value counts."""
    last = (edits.groupBy(*keys, "id").pivot("field", list(DEFAULTS)).agg(F.max_by("value", F.struct("seq", "value")))
            .withColumn("is_edited", F.lit(True)))
    return join_whole(bank_only, last, [*keys, "id"], "left").select(
        *keys, "id", "date", "amount", "description", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in DEFAULTS.items()],
        F.lit("bank").alias("source"), F.coalesce("is_edited", F.lit(False)).alias("is_edited"))


def select_entries(entries: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """J11. ``ids``: keys, id."""
    return join_whole(entries, ids.select(*keys, "id"), [*keys, "id"], "left_semi")


def apply_manual_log(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last event per id decides; deleted entries are gone. ``log``: keys, seq, op, id, entry fields; of equal seq the larger row counts."""
    cols = [c for c in log.columns if c not in (*keys, "id")]
    last = log.groupBy(*keys, "id").agg(F.max_by(F.struct(*cols), F.struct("seq", *cols)).alias("e")).select(*keys, "id", "e.*").filter("op <> 'delete'")
    return last.select(
        *keys, "id", "date", "amount", "description", "conta_debito", F.coalesce("participante_debito", F.lit("")).alias("participante_debito"),
        "conta_credito", F.coalesce("participante_credito", F.lit("")).alias("participante_credito"),
        F.coalesce(F.nullif("documento", F.lit("")), F.lit("001")).alias("documento"), F.lit("manual").alias("source"),
        F.lit(False).alias("is_edited"))


def to_journal_lines(entries: DataFrame, keys: list[str], seq: str = "id") -> DataFrame:
    """K1: numbered export lines in date order per key. ``date`` may be a date or text.

    The number is a prefix over days, so one large company is not numbered in one task. Entries without a date come last,
    with an empty date; an entry without an amount counts as 0.00, so that every line has the same fields.
    """
    iso = dict(entries.dtypes)["date"] == "string"
    day = F.col("date") if iso else F.date_format("date", "yyyy-MM-dd")
    # the head of the id splits a busy day; it sorts like the id itself
    rows = entries.withColumn("__day", day).withColumn("__head", F.left(F.col(seq), F.lit(8)))
    rows = ordinal(rows, keys, ["__day", "__head"], [seq], "n")
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("conta_debito", "participante_debito", "conta_credito", "participante_credito")]
    line = F.concat_ws(",", F.col("n").cast("string"), F.coalesce(iso_text_to_br("__day"), F.lit("")), *text, F.coalesce(F.col("amount").cast(MONEY), F.lit(0).cast(MONEY)).cast("string"), F.lit(""),
                       F.coalesce("description", F.lit("")), F.lit("DCTO"), F.lit(""), F.coalesce("documento", F.lit("")))
    return rows.select(*keys, "n", line.alias("line"))


def journal_file_name(company, month, year, bank):
    """K2."""
    return F.concat(F.lit("lancamento_"), F.upper(F.replace(company, F.lit(" "), F.lit(""))), F.lit("_"),
                    month.cast("int").cast("string"), year.cast("int").cast("string"), F.lit(" "), bank, F.lit(".txt"))
