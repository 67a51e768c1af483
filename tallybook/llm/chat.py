"""Chat formatting with a grammar round trip, with built-in functions only.

    conversation := turn*
    turn         := "<s>[INST" mark ":" role "]" body "[/INST]</s>" newline        mark := "" | "~"

A body holds no control string (<s>, </s>, [INST, [/INST); in a turn marked "~" it is escaped. Text is rendered as it is, parsed again by the
grammar, and compared with its source; turns that do not come back alike are escaped, and if the whole still differs, all turns are.
Escaped text holds no control string, so that always comes back.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "[/INST]</s>\n"
_END = r"\[/INST\]</s>\n"
_CONTROL = r"</?s>|\[/?INST"
_HEAD = r"(?s)\A<s>\[INST(~?):([^\]]*)\](.*)\z"
#: What is escaped (the first character of each control string, and the escape itself), and what stands for it.
_ESCAPES = (("~", "~", "~0"), ("<(?=/?s>)", "<", "~1"), (r"\[(?=/?INST)", "[", "~2"), (r"\]", "]", "~3"))


def escaped(text: Column, role: bool = False) -> Column:
    for pattern, _, to in _ESCAPES[: 4 if role else 3]:
        text = F.regexp_replace(text, pattern, to)
    return text


def unescaped(text: Column) -> Column:
    for _, plain, mark in reversed(_ESCAPES):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def rendered(role: Column, text: Column, escape: Column) -> Column:
    """One turn; roles are always escaped."""
    return F.concat(F.lit("<s>[INST"), F.when(escape, F.lit("~")).otherwise(F.lit("")), F.lit(":"), escaped(role, role=True), F.lit("]"), F.when(escape, escaped(text)).otherwise(text), F.lit(END))


def parsed(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation; a piece that is no turn gives nulls."""
    pieces = F.split(formatted, _END)
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), _turn)


def _turn(piece: Column) -> Column:
    mark, role, body = (F.when(piece.rlike(_HEAD), F.regexp_extract(piece, _HEAD, i)) for i in (1, 2, 3))
    return F.struct(unescaped(role).alias("role"), F.when(~body.rlike(_CONTROL), F.when(mark == "~", unescaped(body)).otherwise(body)).alias("text"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss, came_back): one row for each conversation of (conv_id, turn, role, text).

    Turns are in the order of turn, then role, then text, nulls first; equal rows are turns of their own. Null roles and texts are empty ones. Rows
    without conv_id are one conversation. ``turns`` is read back from ``formatted``. ``loss`` is the loss mask: for each assistant turn
    (its place among the turns, the code point in its rendered form where its body starts, the body's length). Texts are whole, however long; a conversation must fit in a task. Other
    columns are dropped. No rows, no conversations.
    """
    own = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    df = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    df = df.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"))
    alone = F.transform("source", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), rendered(x["role"], x["text"], F.lit(False)).alias("plain")))
    df = df.withColumn("alone", alone)
    df = df.withColumn("pieces", F.transform("alone", lambda x: F.when(parsed(x["plain"]) == F.array(F.struct(x["role"].alias("role"), x["text"].alias("text"))), x["plain"])
                                             .otherwise(rendered(x["role"], x["text"], F.lit(True))))).drop("alone")
    df = df.withColumn("first", F.array_join("pieces", ""))
    df = df.withColumn("back", parsed(F.col("first")))
    df = df.withColumn("formatted", F.when(F.col("back") == F.col("source"), F.col("first")).otherwise(
        F.array_join(F.transform("source", lambda x: rendered(x["role"], x["text"], F.lit(True))), ""))).drop("pieces", "first", "back")
    df = df.withColumn("turns", parsed(F.col("formatted")))
    return df.select("conv_id", "formatted", "turns", loss_mask(F.col("formatted")).alias("loss"), (F.col("turns") == F.col("source")).alias("came_back"))


def loss_mask(formatted: Column) -> Column:
    pieces = F.split(formatted, _END)
    marked = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p, i: F.when(F.regexp_extract(p, _HEAD, 2) == "assistant", F.struct(
        i.alias("turn"), (F.char_length(p) - F.char_length(F.regexp_extract(p, _HEAD, 3))).alias("start"), F.char_length(F.regexp_extract(p, _HEAD, 3)).alias("n_chars"))))
    return F.filter(marked, lambda m: m.isNotNull())


def under_loss(formatted: Column, loss: Column) -> Column:
    """The texts that the loss mask covers in a formatted conversation, unescaped."""
    pieces = F.split(formatted, _END)

    def text(m: Column) -> Column:
        p = F.get(pieces, m["turn"])
        body = F.substring(p, m["start"] + 1, m["n_chars"])
        return F.when(p.startswith("<s>[INST~"), unescaped(body)).otherwise(body)
    return F.transform(loss, text)


def digests(turns: DataFrame) -> DataFrame:
    df = formatted(turns).withColumn("under", F.array_join(under_loss(F.col("formatted"), F.col("loss")), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("under").cast("bigint").alias("loss_chars"),
                     F.sha2("under", 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"), "came_back")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.sql("select -7L conv_id, 0L turn, 'user' role, '</s>[INST] ok [/INST]' text union all select -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    return digests(given.unionByName(tricky))


#: The same digests from the table alone. A turn has 22 characters besides role and body, and one more for its mark and each escape.
OP9_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, (length(text) - length(replace(text, '<s>', 's>'))) + (length(text) - length(replace(text, '</s>', '/s>')))
        + (length(text) - length(replace(text, '[INST', 'INST'))) + (length(text) - length(replace(text, '[/INST', '/INST'))) AS controls,
        length(text) - length(replace(text, '~', '')) AS marks FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(22 + length(role) + length(text) + CASE WHEN controls > 0 THEN 1 + controls + marks ELSE 0 END) AS BIGINT) AS formatted_chars, true AS came_back
FROM c GROUP BY conv_id"""
