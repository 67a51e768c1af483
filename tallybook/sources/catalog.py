"""Layout table, bank names, activity log, file catalogue."""
from __future__ import annotations

import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallybook.functions import words as W
from tallybook.functions.scalars import col, fmt_date_br, once, strip
from tallybook.operators.ordering import join_whole
from tallybook.schemas import ACTIVITY, LAYOUT
from tallybook.session import stored
from tallybook.sinks.commits import is_table, read_batches

MAX_LAYOUTS = 2000
PIECES = (8, 12, 16, 24, 32, 48, 64)   # letters of a keyword that pages look up; of shorter keywords all
STRETCH = 1 << 17       # letters whose pieces are hashed at once
MARK_BITS = 28         # marks of anchors' hashes: 32 MB at most
PART_BITS = 15         # of a hash's marks; as many as a bitmap of Spark has
MARKS = (0, 12, 24, 36)    # bits of a hash that say where in a part its marks are
MOST_HELD = 1 << 17     # keywords, and pieces of them, whose counts are known to the driver
NAMES = 128            # of a kind of layouts that are written by one task


def read_layouts(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """One row per layout file; ``priority`` is the file name. Missing options get their defaults."""
    raw = (spark.read.schema(LAYOUT).option("multiLine", "true").option("pathGlobFilter", pattern)
           .option("recursiveFileLookup", "true").json(folder)
           .select("*", F.col("_metadata.file_name").alias("priority")))
    defaults = {"has_balance_cleanup": F.lit(True), "amount_decimal_separator": F.lit(","), "amount_thousand_separator": F.lit("."),
                "date_format": F.lit("%d/%m/%Y"), "header_keywords": F.array().cast("array<string>")}
    return raw.select(*[F.coalesce(c, defaults[c]).alias(c) if c in defaults else F.col(c) for c in raw.columns])


def layout_list(layouts: DataFrame) -> list[dict]:
    """Layouts as configuration for the rule builders; refuses a table that is no configuration."""
    rows = layouts.orderBy("priority").limit(MAX_LAYOUTS + 1).collect()
    if len(rows) > MAX_LAYOUTS:
        raise ValueError(f"more than {MAX_LAYOUTS} layouts")
    return [r.asDict(recursive=True) for r in rows]


def shipped_layouts() -> list[dict]:
    return [{"priority": p, "name": n, "bank_id": b, "keywords": k, "line_pattern": ".*", "columns": []}
            for p, n, b, k in sorted(W.LAYOUTS)]


def layout_by_name(layouts: DataFrame, name: str) -> DataFrame:
    """S10."""
    return layouts.filter(F.col("name") == name)


def layout_names(layouts: DataFrame) -> DataFrame:
    """S10."""
    return layouts.select("name")


# ---- L1-L6 ---------------------------------------------------------------------------------------

def first_pages(pages: DataFrame) -> DataFrame:
    return pages.filter("page_no = 1")


def _first_layout(layouts: list[dict], test) -> Column:
    """Struct of the first layout that passes, as one expression: no join with the layout table."""
    picks = [F.when(test(x["keywords"]), F.struct(F.lit(x["name"]).alias("layout"), F.lit(x["bank_id"]).alias("bank_id")))
             for x in layouts]
    return F.coalesce(*picks)


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def detect_layout(pages: DataFrame, layouts: list[dict] | DataFrame) -> DataFrame:
    """L1 + L3: first layout all of whose keywords occur on the first page, ignoring case and accents.

    A list is configuration and becomes one expression; a table of any size goes through an index of its keywords.
    """
    if isinstance(layouts, DataFrame):
        kinds = stored(_kinds(layouts, fold, F.min(F.struct("priority", F.col("name").alias("layout"), "bank_id")).alias("__l")))
        first = fitting(pages, kinds).groupBy("file", "page_no").agg(F.min("__l").alias("__l"))
        marked = join_whole(first_pages(pages), first, ["file", "page_no"], "left")
    else:
        first = once(first_pages(pages), ["file", "text"], fold("text").alias("__folded"))
        found = _first_layout(layouts, lambda ks: _all([F.contains("__folded", fold(F.lit(k))) for k in ks]))
        marked = once(first, ["file", "text"], F.when(F.length("text") > 0, found).alias("__l"))
    return marked.select(
        "file", F.col("__l.layout").alias("layout"), F.col("__l.bank_id").alias("bank_id"),
        F.when(F.col("__l").isNull(), W.MSG_NO_LAYOUT).alias("error"),
        (F.col("__l").isNull() & (F.length(strip("text")) < 50)).alias("low_text"))


def identify(pages: DataFrame, layouts: list[dict] | DataFrame) -> DataFrame:
    """L2: (file, layout) for every layout whose keywords all occur exactly as written."""
    if isinstance(layouts, DataFrame):
        return _named(pages, layouts)
    names = F.array_compact(F.array(*[F.when(_all([F.col("text").contains(k) for k in x["keywords"]]), F.lit(x["name"]))
                                      for x in layouts]))
    return first_pages(pages).select("file", F.explode(F.array_distinct(names)).alias("layout"))


def _named(pages: DataFrame, layouts: DataFrame) -> DataFrame:
    """L2 over a table. The result has a row for each file and name, many more than files and kinds: names of one kind only, which cannot repeat, are written as they are found, by stretches of a kind's names."""
    kinds = _kinds(layouts, col, F.collect_set(F.struct("name")).alias("names")).withColumn("kind", F.monotonically_increasing_id())
    kinds = stored(kinds.withColumn("parts", F.ceil(F.size("names") / NAMES)))
    fits = stored(fitting(pages, kinds.drop("names"), col).distinct())
    names = kinds.select("kind", "parts", F.inline("names"))
    held = stored(names.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("kind", "parts")).alias("of")))
    alone = (held.where("n = 1").select("of.kind", F.pmod(F.crc32(F.coalesce("name", F.lit("")).cast("binary")), F.col("of.parts")).alias("part"), "name")
             .groupBy("kind", "part").agg(F.collect_list(F.struct("name")).alias("names")))
    once_each = fits.select("file", "kind", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")).join(alone, ["kind", "part"]).select("file", F.inline("names"))
    shared = join_whole(names.select("kind", "name"), held.where("n > 1").select("name"), ["name"])
    repeated = fits.select("file", "kind").join(shared, "kind").select("file", "name").distinct()
    return once_each.unionByName(repeated).withColumnRenamed("name", "layout")


@cache
def _plain_letters() -> tuple[str, str]:
    """Letters with marks in upper case, then the marks; the letters without, by the rule: decompose, drop the marks. A mark has no counterpart: ``translate`` drops it."""
    pairs = {}
    for code in range(0xC0, 0x2000):
        plain = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(x) != "Mn")
        if len(plain) == 1 and plain != chr(code):
            pairs[chr(code)] = plain
    marks = "".join(chr(x) for x in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(x)) == "Mn")
    return "".join(pairs) + marks, "".join(pairs.values())


def fold(c: Column | str) -> Column:
    """Upper case, without accents. A text is put in upper case once; letters and marks of those that are not ASCII change in one walk."""
    upper = F.upper(col(c))
    return F.when(F.octet_length(col(c)) > F.length(col(c)), F.translate(upper, *_plain_letters())).otherwise(upper)


def _length(letters: int) -> int:
    """Letters of the pieces under which a word is entered: all of a short word, more than half of others, a few different numbers in all."""
    return letters if letters <= PIECES[0] else max(q for q in PIECES if q <= letters)


def _pieces(word: str) -> list[str]:
    """Pieces of one length that cover the word."""
    q = _length(len(word))
    return list(dict.fromkeys(word[i: i + q] for i in [*range(0, len(word) - q, max(1, q // 2)), len(word) - q]))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h += b * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def _hashes(text: str, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Hash of 64 bits of each piece of q letters, from every place of the text on: of two pieces of a power of two that cover it, which are hashed likewise."""
    h, p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), 1
    for q in sorted(lengths):
        while 2 * p <= q:
            h, p = _mixed(h[:-p], h[p:]), 2 * p
        n = max(0, len(h) - (q - p))
        yield q, _mixed(h[:n], h[q - p:][:n])


def _is_marked(h: np.ndarray, bits: int, marked: np.ndarray) -> np.ndarray:
    """Places of the hashes all of whose marks are set; the marks of a hash lie in one part of the bits."""
    at, part = np.arange(len(h)), (h >> np.uint64(64 - (bits - PART_BITS))).astype(np.int64) << PART_BITS
    for shift in MARKS:
        slot = part | ((h >> np.uint64(shift)).astype(np.int64) & ((1 << PART_BITS) - 1))
        on = (marked[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        at, part, h = at[on], part[on], h[on]
    return at


def _marked_pieces(lengths: list[int], bits: int, marked: np.ndarray):
    """(page, text) -> (page, piece): the distinct pieces of these lengths whose hash is marked. Texts are joined to stretches, whose pieces are hashed at once."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lo = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            ends = np.cumsum([len(t) for t in texts])
            while lo < len(texts):
                base = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + STRETCH, "right")))
                whole, last, some = "".join(texts[lo:hi]), ends[lo:hi] - base, set()
                for q, h in _hashes(whole, lengths):
                    at = _is_marked(h, bits, marked)
                    of = np.searchsorted(last, at, "right")
                    some.update((ids[lo + f], whole[i: i + q]) for i, f, end in zip(at.tolist(), of.tolist(), last[of].tolist(), strict=True) if i + q <= end)
                lo = hi
                if some:
                    yield pa.record_batch([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.string())], names=["page", "piece"])
    return find


def _marked(anchors: DataFrame) -> tuple[int, np.ndarray]:
    """Some bits for each hash of an anchor: 64 bits an anchor, at most 2**MARK_BITS, so that what is collected is bounded. Marks bring candidates only."""
    bits = min(MARK_BITS, max(PART_BITS + 1, (anchors.count() * 64).bit_length()))

    def hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            starts, found = np.cumsum(sizes) - sizes, np.zeros(len(texts), np.uint64)
            for q, h in _hashes("".join(texts), sorted({*sizes.tolist()})):
                found[sizes == q] = h[starts[sizes == q]]
            yield pa.record_batch([pa.array(found.view(np.int64))], names=["hash"])
    parts = anchors.select("piece").mapInArrow(hashes_of, "hash long").withColumn("part", F.shiftrightunsigned("hash", 64 - (bits - PART_BITS)))
    # dealt by part before bits are set: sets of bits from every task would be larger than the hashes
    slots = parts.repartition("part").select("part", F.explode(F.array(*[F.shiftrightunsigned("hash", s).bitwiseAND(F.lit((1 << PART_BITS) - 1)) for s in MARKS])).alias("slot"))
    marked, size = np.zeros(1 << (bits - 3), dtype=np.uint8), 1 << (PART_BITS - 3)
    for r in slots.groupBy("part").agg(F.bitmap_construct_agg("slot").alias("bits")).toLocalIterator():
        marked[r["part"] * size: (r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return bits, marked


def _most_held(ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ids that stand more than once, with how often; of very many only those that more than one row in MOST_HELD has, which are MOST_HELD at most."""
    counts = stored(ids.groupBy("id").agg(F.count("*").alias("n")))
    rows = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    held = counts.where(F.col("n") > max(1, rows // MOST_HELD)).orderBy("id").toArrow()
    return held["id"].to_numpy(), held["n"].to_numpy()


def _times(ids: np.ndarray, held: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if not len(held[0]):
        return np.zeros(len(ids), np.int64)
    at = np.minimum(np.searchsorted(held[0], ids), len(held[0]) - 1)
    return np.where(held[0][at] == ids, held[1][at], 0)


def _firsts(of: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Place of the first entry of each owner in the order of ``by``."""
    order = np.lexsort((*reversed(by), of))
    return order[np.diff(of[order], prepend=-1) > 0]


def _entered(words: tuple, pieces: tuple | None = None):
    """Rows with needs -> the ids of the pieces of each row's rarest word, the longest of several; with the ids that many rows have, the rows with the rarest of these pieces."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            needs, ids = batch.column("needs"), batch.column("ids").flatten().to_numpy(zero_copy_only=False)
            of, sizes = np.repeat(np.arange(batch.num_rows), needs.value_lengths().to_numpy(zero_copy_only=False)), batch.column("sizes").flatten().to_numpy(zero_copy_only=False)
            own = [_pieces(w) for w in needs.flatten().take(pa.array(_firsts(of, _times(ids, words), -sizes, ids))).to_pylist()]
            flat = [x for some in own for x in some]
            hashed = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in flat], np.int64)
            if pieces is None:
                yield pa.record_batch([pa.array(hashed)], names=["id"])
                continue
            best = _firsts(np.repeat(np.arange(len(own)), [len(x) for x in own]), _times(hashed, pieces), hashed)
            kept = [c for c in batch.schema.names if c not in ("ids", "sizes")]
            yield pa.record_batch([*[batch.column(c) for c in kept], pa.array([flat[i] for i in best.tolist()], pa.string())], names=[*kept, "piece"])
    return find


def _kinds(layouts: DataFrame, form, *aggs: Column) -> DataFrame:
    """Layouts with the same keywords in ``form`` as one row; those with a null keyword are left out."""
    needs = F.array_sort(F.array_distinct(F.filter(F.transform("keywords", form), lambda k: k != "")))
    return layouts.where("not exists(keywords, k -> k is null)").groupBy(needs.alias("needs")).agg(*aggs)


def fitting(pages: DataFrame, kinds: DataFrame, form=fold) -> DataFrame:
    """(file, page_no, and the other columns of ``kinds``): the kinds all of whose ``needs`` occur on a first page in ``form``; a page without text has none. ``kinds`` is a table that is written already.

    A kind is entered under one piece of one keyword: the keyword that the fewest kinds have, the longest of several, and its piece that the fewest entries have. A page looks up its own pieces,
    of which only those leave it whose hash some entry has, so that common words bring no candidates. The texts are dealt by row; candidates go to them, and all keywords are compared there.
    A kind without needs fits every page.
    """
    carried = [c for c in kinds.columns if c != "needs"]
    named = kinds.where(F.size("needs") > 0).select("*", F.transform("needs", lambda k: F.crc32(k.cast("binary"))).alias("ids"), F.transform("needs", F.length).alias("sizes"))
    words = _most_held(named.select(F.explode("ids").alias("id")))
    pieces = _most_held(named.mapInArrow(_entered(words), "id long"))
    anchors = stored(named.mapInArrow(_entered(words, pieces), StructType([*kinds.schema.fields, StructField("piece", StringType())])))
    lengths = sorted(r["q"] for r in anchors.select(F.length("piece").alias("q")).distinct().collect())            # of some dozen lengths
    full = first_pages(pages).where(F.length("text") > 0)
    # the search and the comparison read one exchange: both need all its columns
    texts = full.select(F.xxhash64("file", "page_no", "text").alias("page"), form("text").alias("text"), "file", "page_no").repartition("page")
    fits = kinds.select(*[F.lit(None).cast(t).alias(c) for c, t in pages.select("file", "page_no").dtypes], *carried).limit(0)
    if lengths:
        near = texts.mapInArrow(_marked_pieces(lengths, *_marked(anchors)), "page long, piece string").join(anchors, "piece").drop("piece")
        fits = texts.join(near, "page").where(F.forall("needs", lambda k: F.contains(F.col("text"), k))).select("file", "page_no", *carried)
    always = kinds.where(F.size("needs") == 0).select(*carried)                     # one row at most, as kinds are distinct
    return fits if always.isEmpty() else fits.unionByName(full.select("file", "page_no").crossJoin(F.broadcast(always)))


def route(detected: DataFrame) -> DataFrame:
    """L4: rule set by bank code, else by the layout's name; 'generic' when there is none."""
    rules = F.create_map(*[F.lit(x) for kv in W.RULE_SETS.items() for x in kv])
    name = F.replace(F.upper("layout"), F.lit(" "), F.lit(""))
    return detected.withColumn("rule_set", F.when(F.col("layout").isNotNull(), F.coalesce(
        rules[F.col("bank_id")], rules[name], F.lit("generic"))))


def banks_dim(spark: SparkSession) -> DataFrame:
    """S14."""
    return spark.createDataFrame(list(W.BANKS.items()), "code string, bank_name string")


def bank_name(code: Column | str) -> Column:
    """Dots and blanks around the code are dropped."""
    names = F.create_map(*[F.lit(x) for kv in W.BANKS.items() for x in kv])
    return F.coalesce(names[strip(F.replace(col(code), F.lit("."), F.lit("")))], F.lit(W.UNKNOWN_BANK))


def bank_label(code: Column | str) -> Column:
    """``<name> (<code>)``."""
    empty = col(code).isNull() | (col(code) == "")
    return F.when(empty, W.NOT_DETECTED).otherwise(F.concat(bank_name(code), F.lit(" ("), col(code), F.lit(")")))


def with_sublayout(pages: DataFrame) -> DataFrame:
    """The variant of the rule set, per page. Needs ``rule_set`` and ``text``."""
    t = F.col("text")
    early = F.slice(F.split(t, "\n"), 1, 30)
    bb = (F.when(t.contains("G331"), "g331").when(t.rlike(r"\d{2}\.\d{2}\.\d{4}"), "dot")
          .when(F.exists(early, lambda x: x.rlike(r"\d{2}/\d{2}/\d{4}\s+\d{4}\s+\d{8}")), "full").otherwise("simple"))
    sicredi = (F.when(t.contains("Associado:") & t.contains("Cooperativa:"), "associado")
               .when(t.contains("COOP CRED"), "standard").otherwise("smart"))
    itau = F.when(t.contains("Saldo total") & t.contains("Lançamentos do período"), "columns").otherwise("smart")
    rule = F.col("rule_set")
    return pages.withColumn("sublayout", F.when(rule == "bb", bb).when(rule == "sicredi", sicredi).when(rule == "itau", itau)
                            .otherwise("only"))


# ---- S11, S13 ------------------------------------------------------------------------------------

def file_catalog(spark: SparkSession, root: str, meta: DataFrame | None = None, pattern: str = r"\.(pdf|ofx)$") -> DataFrame:
    """Every .pdf / .ofx below ``root``; ``meta``: file (path), bank, agency, account, start_date, end_date."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("_metadata.file_path").alias("path"))
             .filter(F.lower("path").rlike(pattern)))
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select(F.lit(False).alias("selected"), name.alias("filename"),
                         F.upper(F.element_at(F.split(name, r"\."), -1)).alias("type"), "path")
    if meta is None:
        return files.select("*", *[F.lit("").alias(c) for c in ("bank", "agency", "account", "period")])
    period = (F.when(F.col("start_date").isNotNull() & F.col("end_date").isNotNull(),
                     F.concat_ws(" - ", fmt_date_br("start_date"), fmt_date_br("end_date")))
              .when(F.col("start_date").isNotNull(), F.concat(F.lit("Inicio: "), fmt_date_br("start_date"))).otherwise(""))
    return files.join(meta, files["path"] == meta["file"], "left").select(
        *files.columns, *[F.coalesce(c, F.lit("")).alias(c) for c in ("bank", "agency", "account")], period.alias("period"))


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """Both generations of the log; ``user`` or ``username``. Where the log was written in batches, those that are whole."""
    if is_table(spark, path):
        raw = read_batches(spark, path, "json", f"{ACTIVITY}, day date").drop("day", "batch")
        return raw.withColumn("user", F.coalesce("user", "username")).drop("username")
    raw = spark.read.schema(ACTIVITY).option("recursiveFileLookup", "true").json(path)
    return raw.withColumn("user", F.coalesce("user", "username")).drop("username")


def activity_stats(log: DataFrame) -> DataFrame:
    """A23."""
    return log.groupBy("user", "category", F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))
