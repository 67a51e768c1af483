"""Byte-level BPE of whole texts: long unsplit texts by tree concatenation, then back.

A long text is cut into pieces that are encoded in parallel, on any executor. Pieces are joined like the leaves of a tree: around
each join a window is encoded anew, and it grows on both sides until it agrees with both. Splits are where the vocabulary's pattern divides
a text before merging; one is certain if the pattern has seen AHEAD code points behind it. A window begins at the last certain split of the
left side, or where that is far, at a token's border inside the unsplit run; then its first token must be the left side's token there. It ends at
a split that it shares with the right side, or at a token's border inside a run, and then its last token must be the right side's. One common
token is enough: ids are the encoding of a run if and only if each two neighbours are (Berglund and others, tokenization automata, 2024).
"""
from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

#: Texts with more code points than this are cut into pieces of half as many.
LONG = 1 << 16
WINDOW = 64
#: The pattern looks at most so far beyond a split: the longest contraction.
AHEAD = 3
#: The usual pattern of the byte-level pre-tokenizer, for the fast encoder.
SPLITS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points for which both encoders surely split alike: scripts that were there long before either library.
_COMMON = re.compile("[\x00-ɏΑ-ΡΣ-ωЀ-џ‐-‧‰-›€ぁ-ゖァ-ヺ一-龥가-힣]*")

#: ids; for each split: its first token, its first code point; for each token: twice its first code point, plus 1 if it begins inside that one.
Encoded = tuple[list[int], list[int], list[int], list[int]]


def _border_before(border: list[int], at: int) -> tuple[int, int]:
    """The last token that begins with a code point, at ``at`` or before; the first token if there is none."""
    k = max(0, bisect_right(border, 2 * at) - 1)
    while k and border[k] % 2:
        k -= 1
    return k, border[k] // 2


def _border_behind(border: list[int], at: int) -> tuple[int, int]:
    """The first token that begins with a code point, at ``at`` or behind; the number of tokens if there is none."""
    k = bisect_left(border, 2 * at)
    while k < len(border) and border[k] % 2:
        k += 1
    return k, border[k] // 2 if k < len(border) else -1


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.fast = None
        plain = made["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if plain and not made["normalizer"] and made["model"]["type"] == "BPE":
            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]      # bytes shown as themselves
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            ranks = {bytes(byte[c] for c in t): i for t, i in made["model"]["vocab"].items() if t not in self.special}
            self.fast = tiktoken.Encoding("ranks", pat_str=SPLITS, mergeable_ranks=ranks, special_tokens={})
        self.made_of = {i: t.encode() for t, i in self.special.items()}

    @cached_property
    def slow(self) -> Tokenizer:
        """The library's own encoder, loaded where a text needs it."""
        made = Tokenizer.from_file(self.path)
        made.no_padding()
        made.no_truncation()
        return made

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, as the library's encode(text, add_special_tokens=False)."""
        if self.fast and _COMMON.fullmatch(text) and not (self.cut and self.cut.search(text)):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        if self.fast and not (self.special and np.isin(ids, list(self.made_of)).any()):
            return self.fast.decode_bytes(ids.tolist()).decode("utf-8", "replace")
        return self.slow.decode(ids.tolist(), skip_special_tokens=False)

    def encode_section(self, text: str) -> Encoded:
        """Ids, splits and token borders of a text that holds no special token."""
        if not text:
            return [], [], [], []
        e = self.slow.encode(text, add_special_tokens=False)
        word, offsets = e.word_ids, e.offsets            # each a new list
        first = [i for i, w in enumerate(word) if i == 0 or w != word[i - 1]]
        border = [2 * o[0] + (i > 0 and o[0] < offsets[i - 1][1]) for i, o in enumerate(offsets)]
        return e.ids, first, [offsets[i][0] for i in first], border

    def sections(self, text: str) -> list[tuple[str, int | None]]:
        """(text, id): what stands between special tokens, and the special tokens themselves."""
        out, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += [(text[at:m.start()], None), (m[0], self.special[m[0]])]
            at = m.end()
        return [*out, (text[at:], None)]

    def join(self, left: Encoded, right: Encoded, text: str, middle: int, window: int = WINDOW) -> Encoded:
        """Encoding of a section from those of text[:middle] and text[middle:]."""
        if not left[0] or not right[0]:
            return left if left[0] else right
        window = max(window, 2 * (AHEAD + 1))
        split = max(0, bisect_right(left[2], middle - AHEAD) - 1)
        while True:
            n, start = _border_before(left[3], middle - window)
            inside = start > left[2][split] + 1          # within an unsplit run, behind its first code point
            if not inside:
                n, start = left[1][split], left[2][split]
            j, end = _border_behind(right[3], window)
            end = len(text) if j == len(right[0]) else middle + end
            made = self.encode_section(text[start:end])
            if not inside or made[0][0] == left[0][n]:
                if (ends := self._meets(made, right, start - middle, j, end - middle)) is not None:
                    m, keep, j, rest = ends              # tokens and splits of the window, then where the right side goes on
                    own = slice(1 if inside else 0, keep)
                    kept = split + 1 if inside else split
                    return ([*left[0][:n], *made[0][:m], *right[0][j:]],
                            [*left[1][:kept], *(n + f for f in made[1][own]), *(n + m - j + f for f in right[1][rest:])],
                            [*left[2][:kept], *(start + x for x in made[2][own]), *(middle + x for x in right[2][rest:])],
                            [*left[3][:n], *(2 * start + x for x in made[3][:m]), *(2 * middle + x for x in right[3][j:])])
            window *= 2

    @staticmethod
    def _meets(made: Encoded, right: Encoded, start: int, j: int, end: int) -> tuple[int, int, int, int] | None:
        """Where a window (from ``start`` to ``end``, counted from the right side's begin; ``j`` its token there) goes over into the right side."""
        if j == len(right[0]):
            return len(made[0]), len(made[1]), j, len(right[1])
        for k, at in enumerate(made[2]):                 # a split that both have
            place = start + at
            if 0 <= place <= end - AHEAD:
                rest = bisect_left(right[2], place)
                if rest < len(right[2]) and right[2][rest] == place:
                    return made[1][k], k, right[1][rest], rest
        run = bisect_right(right[1], j - 1) - 1 if j else -1     # the right side's run that holds the token before ``end``
        far = end - AHEAD - 1
        if run < 0 or right[2][run] > far or start + made[2][-1] > far or run + 1 < len(right[1]) and right[1][run + 1] <= j:
            return None
        same = made[0][-1] == right[0][j - 1] and made[3][-1] + 2 * start == right[3][j - 1]
        return (len(made[0]), len(made[1]), j, run + 1) if same else None

    def tree(self, pieces: Sequence[Encoded], texts: Sequence[str]) -> Encoded:
        """Joins neighbours, then neighbours of neighbours, until one is left."""
        pieces, texts = list(pieces), list(texts)
        while len(pieces) > 1:
            pairs = range(0, len(pieces) - 1, 2)
            joined = [self.join(pieces[i], pieces[i + 1], texts[i] + texts[i + 1], len(texts[i])) for i in pairs]
            whole = [texts[i] + texts[i + 1] for i in pairs]
            pieces, texts = joined + pieces[len(joined) * 2:], whole + texts[len(joined) * 2:]
        return pieces[0]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _ids(arrays: list) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate([np.asarray(a, np.int32) for a in arrays]) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32, copy=False), pa.int32()))


def _encoded(path: str, text_col: str, ids_col: str, text_out: str | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):                       # ids take more room than text
                part = b.slice(at, 256)
                ids = [vocab.encode(t.as_py() or "") for t in part.column(text_col)]
                made = {ids_col: _ids(ids)}
                if text_out:
                    made[text_out] = pa.array([vocab.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([made.get(f.name) if f.name in made else part.column(f.name) for f in schema], schema=schema)
    return run


def _pieces(path: str):
    """Each long text in pieces: sections between special tokens, cut at LONG / 2 code points."""
    def run(batches: Iterator[pa.RecordBatch], long: int) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            for key, text in zip(b.column("__key"), b.column("__text"), strict=True):
                rows, step = [], max(1, long // 2)
                for s, (section, special) in enumerate(vocab.sections(text.as_py())):
                    rows += [(s, k, section[at: at + step], special) for k, at in enumerate(range(0, max(1, len(section)), step))] if special is None else [(s, 0, section, special)]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                                  pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int32())], ["__key", "section", "piece", "__text", "special"])
    return run


def _encode_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            made = [vocab.encode_section(t) if s is None else ([s], [0], [0], [0]) for t, s in zip(b.column("__text").to_pylist(), b.column("special").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("__key", "section", "piece", "__text")] + [_ids([m[i] for m in made]) for i in range(4)],
                                             ["__key", "section", "piece", "__text", "ids", "first", "at", "border"])
    return run


def _join_pieces(path: str):
    def run(table: pa.Table) -> pa.Table:
        vocab, rows = vocabulary(path), sorted(table.to_pylist(), key=lambda r: (r["section"], r["piece"]))
        ids: list[int] = []
        for s in sorted({r["section"] for r in rows}):
            own = [r for r in rows if r["section"] == s]
            ids += vocab.tree([(r["ids"], r["first"], r["at"], r["border"]) for r in own], [r["__text"] for r in own])[0]
        return pa.table([pa.array([rows[0]["__key"]], pa.string()), _ids([ids]), pa.array([vocab.decode(np.array(ids, np.uint32))], pa.string())], ["__key", "__ids", "__decoded"])
    return run


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, long: int = LONG) -> DataFrame:
    """Adds ``ids_col``, the token ids of the whole text, and if named ``decoded_col``, the text that these ids decode to.

    ``path`` is a vocabulary file of the tokenizers library (byte-level BPE); it must be readable by every executor. Null is encoded as
    an empty text, an empty text has no ids. Rows stay as they are, repeated ones too; a column that has one of the new names is replaced.
    Texts of more than ``long`` code points go through pieces, each distinct one once; a document and its tokens must fit in a task. Empty in, empty out.
    """
    made = [c for c in (ids_col, decoded_col) if c]
    rest = docs.drop(*made)
    is_long = F.char_length(F.coalesce(F.col(text_col), F.lit(""))) > long

    def shaped(base: T.StructType) -> T.StructType:
        out = T.StructType(list(base.fields)).add(ids_col, T.ArrayType(T.IntegerType()))
        return out.add(decoded_col, "string") if decoded_col else out
    whole = shaped(rest.schema)
    short = rest.where(~is_long).mapInArrow(_encoded(path, text_col, ids_col, decoded_col, to_arrow_schema(whole)), whole)
    tall = rest.where(is_long).withColumn("__key", F.sha2(text_col, 256))
    pieces, cut = _pieces(path), long
    spread = (tall.select("__key", F.col(text_col).alias("__text")).dropDuplicates(["__key"])
              .mapInArrow(lambda b: pieces(b, cut), "__key string, section int, piece int, __text string, special int")
              .repartition("__key", "section", "piece"))
    done = spread.mapInArrow(_encode_pieces(path), "__key string, section int, piece int, __text string, ids array<int>, first array<int>, at array<int>, border array<int>")
    joined = done.groupBy("__key").applyInArrow(_join_pieces(path), "__key string, __ids array<int>, __decoded string")
    out = tall.join(joined, "__key").withColumn(ids_col, F.col("__ids"))
    out = out.withColumn(decoded_col, F.col("__decoded")) if decoded_col else out
    return short.unionByName(out.select(*rest.columns, *made))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Adds ``text_col``, the text of the ids; null ids give an empty text."""
    rest = tokens.drop(text_col) if text_col in tokens.columns else tokens
    out = T.StructType(list(rest.schema.fields)).add(text_col, "string")
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            text = [vocab.decode(np.array(x.as_py() or [], np.uint32)) for x in b.column(ids_col)]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if f.name == text_col else b.column(f.name) for f in schema], schema=schema)
    return rest.mapInArrow(run, out)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def digests(docs: DataFrame, path: str) -> DataFrame:
    done = encode(docs.select("doc_id", "text"), path, decoded_col="decoded")
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents with their token ids, and whether these decode to the text again (``round_trip``).

    Null and empty texts have no ids; repeated rows stay. Columns that documents do not have are dropped. Empty in, empty out.
    """
    done = encode(docs.select("doc_id", "text", "lang", "source", "n_chars"), default_vocabulary(), decoded_col="decoded")
    return done.withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit(""))).drop("decoded")
