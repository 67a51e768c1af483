"""Document fingerprints by a threshold-scaled sketch, with built-in functions only.

Every distinct shingle of a text is hashed; the sketch keeps each hash below a fixed share of all hash values. So the sketch grows
with the text, sketches of parts merge into the sketch of the whole, and shares of a short text inside a very long one can
be estimated. The LEAST smallest hashes are kept as well, wherever they lie: without them short texts would have empty sketches. Two
sketches are compared below the value up to which both are complete.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.llm import texts as X
from tallybook.llm.bundles import with_bundle

SHINGLE = 5
SHARE_BITS = 3          # keep one hash in 2**3
LEAST = 16
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def threshold(bits: int = SHARE_BITS) -> int:
    """Hashes are signed; those below are kept."""
    return _LOW + (1 << (64 - bits))


def with_sketch(df: DataFrame, text: str, out: str, shingle: int = SHINGLE, bits: int = SHARE_BITS, least: int = LEAST) -> DataFrame:
    """Adds ``out``: the sorted distinct hashes kept of the text's word shingles.

    A text of fewer words is one shingle; null and empty texts have an empty sketch. Each step is a column of its own,
    so that no expression is worked out twice.
    """
    w, h, n = F.col("__w"), F.col("__h"), F.col("__h")
    df = df.withColumn("__w", F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), X.GAP), lambda x: x != ""), lambda x: F.xxhash64(x)))
    many = F.transform(F.sequence(F.lit(1), F.size(w) - (shingle - 1)), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(shingle)]))
    df = df.withColumn("__h", F.when(F.size(w) >= shingle, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(F.transform(w, lambda x: x.cast("string")), " "))))
                       .otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__k", F.array_distinct(F.filter(h, lambda x: x < threshold(bits)))).drop("__w")
    few = F.slice(F.sort_array(F.array_distinct(n)), 1, least)
    return df.withColumn(out, F.when(F.size("__k") >= least, F.sort_array("__k")).otherwise(few)).drop("__k", "__h")


def merged(a: str | Column, b: str | Column, bits: int = SHARE_BITS, least: int = LEAST) -> Column:
    """Sketch of two texts together, from their sketches."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = F.sort_array(F.array_union(a, b))
    kept = F.filter(both, lambda x: x < threshold(bits))
    return F.when(F.size(kept) >= least, kept).otherwise(F.slice(both, 1, least))


def complete_to(sketch: Column, bits: int = SHARE_BITS, least: int = LEAST) -> Column:
    """All hashes up to this value are in the sketch."""
    last = F.get(sketch, F.size(sketch) - 1)
    return F.when(F.size(sketch) < least, F.lit(_HIGH)).otherwise(F.greatest(last, F.lit(threshold(bits) - 1)))


def compared(df: DataFrame, a: str, b: str, likeness: str | None = None, held: str | None = None, bits: int = SHARE_BITS, least: int = LEAST) -> DataFrame:
    """Adds ``likeness``, the estimated share of common shingles in all of both texts, and ``held``, in those of the shorter one (0 to 1).

    Two empty sketches are alike (1), an empty one and another are not (0).
    """
    x, y = F.col(a), F.col(b)
    df = df.withColumn("__to", F.least(complete_to(x, bits, least), complete_to(y, bits, least)))
    df = df.withColumn("__x", F.filter(x, lambda v: v <= F.col("__to"))).withColumn("__y", F.filter(y, lambda v: v <= F.col("__to")))
    df = df.withColumn("__c", F.size(F.array_intersect("__x", "__y")))
    both, short = F.size("__x") + F.size("__y") - F.col("__c"), F.least(F.size("__x"), F.size("__y"))
    if likeness:
        df = df.withColumn(likeness, F.when(both == 0, F.lit(1.0)).otherwise(F.col("__c") / both))
    if held:
        df = df.withColumn(held, F.when(both == 0, F.lit(1.0)).when(short == 0, F.lit(0.0)).otherwise(F.col("__c") / short))
    return df.drop("__to", "__x", "__y", "__c")


def as_text(sketch: str | Column) -> Column:
    """16 hex digits for each hash."""
    return F.array_join(F.transform(F.col(sketch) if isinstance(sketch, str) else sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def neighbours(ids: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """(doc_id, before, after): the next larger and the next smaller id, in a ring; ids must be distinct and not null.

    Windows see the ids of one range only, cut at quantiles; the ends of ranges meet in one row for each range.
    """
    span = ids.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("n")).first()
    if not span["n"]:
        return ids.select("doc_id", F.col("doc_id").alias("before"), F.col("doc_id").alias("after"))
    ids = with_bundle(ids, "doc_id", F.lit(1), rows)[0].withColumnRenamed("bundle", "part")
    inside, over = Window.partitionBy("part").orderBy("doc_id"), Window.orderBy("part")
    ends = ids.groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    ends = ends.select("part", F.coalesce(F.lag("high").over(over), F.lit(span["z"])).alias("under"), F.coalesce(F.lead("low").over(over), F.lit(span["a"])).alias("above"))
    near = ids.select("doc_id", "part", F.lead("doc_id").over(inside).alias("up"), F.lag("doc_id").over(inside).alias("down"))
    return near.join(ends, "part").select("doc_id", F.coalesce("up", "above").alias("before"), F.coalesce("down", "under").alias("after"))


def with_edited(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_chars, sketch, edited, next_sketch): the last half of each text replaced by the beginning of the next document's.

    Next is the document with the next smaller doc_id; after the last comes the first. If several rows have one doc_id, each is a row here,
    and as the next document the largest text stands for them. A row without doc_id has no next document: an empty text. A null text is an empty one. Texts of
    any length are taken whole; one must fit in a task. Other columns are dropped. Empty in, empty out.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))      # doc_id as it is: an alias would keep the exchanges apart
    placed, loose = base.where("doc_id is not null"), base.where("doc_id is null")
    sizes = placed.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n"))
    ring = neighbours(sizes.select("doc_id"))
    ring = ring.join(sizes.select(F.col("doc_id").alias("before"), F.col("n").alias("wanted")), "before")
    # texts are dealt by doc_id once: both sides below read that exchange, so it carries nothing but the text
    sent = placed.join(ring, "doc_id").groupBy("doc_id", "before", "wanted").agg(F.max("text").alias("text"))
    sent = with_sketch(sent, "text", "next_sketch").select(F.col("before").alias("to"), F.expr("left(text, cast(wanted div 2 as int))").alias("head"), "next_sketch")
    got = placed.join(sent, placed["doc_id"] == sent["to"]).drop("to")
    got = got.unionByName(loose.select("*", F.lit("").alias("head"), F.array().cast("array<bigint>").alias("next_sketch")))
    got = with_sketch(got.withColumn("n_chars", F.char_length("text")), "text", "sketch")
    edited = F.when(F.col("n_chars") > 1, F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), F.expr("left(head, cast(n_chars div 2 as int))"))).otherwise(F.col("text"))
    return got.select("doc_id", "text", F.col("n_chars").cast("bigint").alias("n_chars"), "sketch", edited.alias("edited"), "next_sketch")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    docs = with_sketch(docs, "edited", "edited_sketch")
    docs = compared(docs, "sketch", "edited_sketch", "near_edited", "held_edited")
    docs = compared(docs, "sketch", "next_sketch", "near_next", "held_next")
    return docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"),
                       "near_edited", "near_next", "held_edited", "held_next")
