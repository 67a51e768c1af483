"""Quality rules as a short-circuit cascade, with built-in functions only.

A rule is a few columns worked out one after the other and a condition on them that rejects a document. What a rule costs is measured on a
sample, and which of the sample's documents it rejects; the rule with the most rejections per cost comes first, then the one with
the most among those that are left, and so on. A document that one rule has rejected is not looked at by the rules behind it.
The order changes what the cascade costs and which rule is named, never which documents are kept.
"""
from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import texts as X
from tallybook.llm.sampling import at_most
from tallybook.session import stored

SAMPLE = 1_000          # documents that costs and rejections are measured on
WINDOW = 5              # words
LEAST_WORDS = 10
MOST_REPEATED = 20      # words in repeated windows, of 100
SYMBOLS = "[#*$%&|<>]"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _windows() -> Column:
    many = F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get("hashes", i + (k - 1)) for k in range(WINDOW)]))
    return F.when(F.size("hashes") >= WINDOW, many).otherwise(F.array().cast("array<bigint>"))


def _sorted() -> Column:
    """In most texts no window comes twice; only the others are sorted."""
    return F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _repeated() -> Column:
    """Places of the windows that another window equals."""
    pairs = F.zip_with(F.slice("sorted", 1, F.size("sorted") - 1), F.slice("sorted", 2, F.size("sorted") - 1),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    return F.when(F.col("sorted").isNotNull(), F.sort_array(F.array_distinct(F.flatten(pairs))))


def _covered() -> Column:
    """Words in windows that begin at the repeated places: each adds up to the next one's begin."""
    steps = F.zip_with("repeated", F.slice("repeated", 2, F.size("repeated")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("bigint")


#: Columns that rules are made of, each from those before it. ``text`` is given.
FEATURES: dict[str, Callable[[], Column]] = {
    "words": lambda: F.filter(F.split(_text(), X.GAP), lambda w: w != ""),
    "n_words": lambda: F.size("words").cast("bigint"),
    "word_chars": lambda: F.char_length(F.array_join("words", "")).cast("bigint"),
    "n_symbols": lambda: F.regexp_count(_text(), F.lit(SYMBOLS)).cast("bigint"),
    "lines": lambda: F.filter(F.split(_text(), "\n"), lambda x: x.rlike(X.WORD)),
    "n_lines": lambda: F.size("lines").cast("bigint"),
    "n_dup_lines": lambda: (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
    "hashes": lambda: F.transform("words", lambda w: F.xxhash64(w)),
    "windows": _windows,
    "sorted": _sorted,
    "repeated": _repeated,
    "n_repeat_words": _covered,
    "n_capitals": lambda: F.regexp_count(_text(), F.lit(r"\p{Lu}")),
    "n_small": lambda: F.regexp_count(_text(), F.lit(r"\p{Ll}")),
    "n_exclaims": lambda: F.regexp_count(_text(), F.lit("!")),
    "n_letterless": lambda: F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}"))),
    "n_broken": lambda: F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
    "filler": lambda: F.contains(F.lower(_text()), F.lit("lorem ipsum")),
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """Rejects a text if ``rejects`` (SQL) holds; ``uses``: the features it needs, in the order of FEATURES."""

    name: str
    uses: tuple[str, ...]
    rejects: str


_repeats = ("words", "n_words", "hashes", "windows", "sorted", "repeated", "n_repeat_words")
FEW_WORDS = Rule("few words", ("words", "n_words"), f"n_words < {LEAST_WORDS}")
REPEATS = Rule("repeated windows", _repeats, f"100 * n_repeat_words > {MOST_REPEATED} * n_words")
RULES = [
    FEW_WORDS,
    REPEATS,
    Rule("symbols", ("words", "n_words", "n_symbols"), "10 * n_symbols > n_words"),
    Rule("word length", ("words", "n_words", "word_chars"), "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("repeated lines", ("lines", "n_lines", "n_dup_lines"), "10 * n_dup_lines > 3 * n_lines"),
    Rule("capitals", ("n_capitals", "n_small"), "n_capitals > n_small"),
    Rule("exclamation marks", ("words", "n_words", "n_exclaims"), "10 * n_exclaims > n_words"),
    Rule("words without letters", ("words", "n_words", "n_letterless"), "5 * n_letterless > n_words"),
    Rule("broken lines", ("lines", "n_lines", "n_broken"), "10 * n_broken > 3 * n_lines"),
    Rule("filler", ("filler",), "filler"),
]


def with_features(df: DataFrame, names: list[str] | tuple[str, ...], only: Column | None = None) -> DataFrame:
    """Adds features, each as a column of its own, so that none is worked out twice; ``only``: for these rows, null for the others."""
    for name in FEATURES:
        if name in names and name not in df.columns:
            df = df.withColumn(name, FEATURES[name]() if only is None else F.when(only, FEATURES[name]()))
    return df


@dataclass(frozen=True)
class Measured:
    """What the sample told: seconds of each rule beyond reading, and for each set of rules that reject a document together, how many there are."""

    seconds: dict[str, float]
    together: dict[frozenset[str], int]

    def order(self) -> list[str]:
        """Most rejections per cost first, counted among the documents that the rules before have left; then the cheapest."""
        left, out = dict(self.together), []
        while len(out) < len(self.seconds):
            gain = {r: sum(n for by, n in left.items() if r in by) / max(s, 1e-4) for r, s in self.seconds.items() if r not in out}
            out.append(max(gain, key=lambda r: (gain[r], -self.seconds[r], r)))
            left = {by: n for by, n in left.items() if out[-1] not in by}
        return out


def measure(docs: DataFrame, rules: list[Rule], sample: int = SAMPLE, runs: int = 2) -> Measured:
    """Costs and rejections of the rules on at most ``sample`` whole texts, the same ones in every run."""
    some = docs.select("doc_id", _text().alias("text"))
    some = stored(at_most(some, sample, docs.count(), "doc_id"))

    def seconds(df: DataFrame, value: Column) -> float:
        took = []
        for _ in range(runs):                                   # the first run also compiles
            start = time.perf_counter()
            df.agg(F.count_if(value)).collect()
            took.append(time.perf_counter() - start)
        return min(took)
    read = seconds(some, F.length("text") > 0)
    cost = {r.name: max(0.0, seconds(with_features(some, r.uses), F.expr(r.rejects)) - read) for r in rules}
    flags = with_features(some, sorted({u for r in rules for u in r.uses})).select(*[F.expr(r.rejects).alias(f"r{i}") for i, r in enumerate(rules)])
    rows = flags.groupBy(*flags.columns).agg(F.count("*").alias("n")).collect()                      # at most one for each text of the sample
    return Measured(cost, {frozenset(r.name for i, r in enumerate(rules) if row[i]): row["n"] for row in rows})


def cascade(df: DataFrame, rules: list[Rule], order: list[str], out: str, failed: Column | None = None) -> DataFrame:
    """Adds ``out``, the name of the first rule that rejects the text (null: kept), and the features, null where no rule needed them.

    Rows for which ``failed`` holds are rejected before ("base") and not looked at.
    """
    by_name = {r.name: r for r in rules}
    df = df.withColumn(out, F.when(failed, F.lit("base")) if failed is not None else F.lit(None).cast("string"))
    for name in order:
        rule, left = by_name[name], F.col(out).isNull()
        df = with_features(df, rule.uses, left).withColumn(out, F.when(left & F.expr(rule.rejects), F.lit(name)).otherwise(F.col(out)))
    # a filter on the verdict stays behind the generator; pushed through the rules it would hold each of them many times over
    return df.select(*[c for c in df.columns if c != out], F.inline(F.array(F.struct(F.col(out).alias(out)))))


def _own(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all given columns as one that no feature's name clashes with."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), _text().alias("text"))


def filtered(docs: DataFrame, rules: list[Rule] | None = None, sample: int = SAMPLE) -> DataFrame:
    """The documents that no rule rejects, with all their columns, whatever these are called.

    A null text has no words, like an empty one, and is rejected by "few words". Rows are judged one by one, so repeated rows fare alike and a doc_id
    may be null or occur again. Texts of any length are judged whole; a text must fit in a task. Empty in, empty out.
    """
    rules = RULES if rules is None else rules
    found = cascade(_own(docs), rules, measure(docs, rules, sample).order(), "rejected_by")
    return found.where("rejected_by is null").select("given.*")


def judged(docs: DataFrame, rules: list[Rule] | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept): one row for each row of (doc_id, text).

    Counts are those of every text; whether it is kept is found by the cascade, which leaves out what the base has failed. Nulls and the like as for filtered().
    """
    rules = [r for r in (RULES if rules is None else rules) if r not in (FEW_WORDS, REPEATS)]
    order = measure(docs, rules, sample).order()
    found = with_features(docs.select("doc_id", _text().alias("text")), [*_repeats, "lines", *BASE])
    found = found.withColumn("base_failed", F.expr(f"{FEW_WORDS.rejects} OR {REPEATS.rejects}"))
    return cascade(found, rules, order, "rejected_by", F.col("base_failed")).select("doc_id", *BASE, "base_failed", F.col("rejected_by").isNull().alias("kept"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
places AS (SELECT row, i, words[i:i + 4] AS win FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT row, unnest(found) AS i FROM (SELECT row, list(i) AS found FROM places GROUP BY row, win HAVING count(*) > 1)),
again AS (SELECT row, count(DISTINCT i + k)::BIGINT AS n FROM twice, range(5) AS t(k) GROUP BY row),
counts AS (SELECT doc_id, text, words, lines, len(words)::BIGINT AS n_words, len(list_aggregate(words, 'string_agg', ''))::BIGINT AS chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN again USING (row)),
base AS (SELECT * EXCLUDE (chars), coalesce(chars, 0) AS word_chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > 3 * len(lines)
  OR len(regexp_extract_all(text, '\p{Lu}')) > len(regexp_extract_all(text, '\p{Ll}')) OR 10 * len(regexp_extract_all(text, '!')) > n_words
  OR 5 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{L}'))) > n_words
  OR 10 * len(list_filter(lines, lambda x: ends_with(rtrim(x), '...') OR ends_with(rtrim(x), '…'))) > 3 * len(lines) OR contains(lower(text), 'lorem ipsum')) AS kept
FROM base
"""
