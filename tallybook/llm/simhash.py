"""SimHash near-duplicates, candidates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each decoded as a word of the binary Golay code of length 23. That code is perfect:
every word lies within 3 bits of exactly one codeword. Keys of a word are its codeword and, if that is 3
bits away, the five codewords 4 bits away; two words that differ in at most 2 bits have a key in common, and if they differ in at most
1 bit, the codeword of either is among the keys of the other.

Two fingerprints that differ in at most 4 bits differ in at most 2 bits in their two closest segments together: there either one segment is
equal and the other has at most 2 errors, or both have one. For either case there are joined keys of two segments. Fingerprints
that meet under a key are compared; those within the distance are linked.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.llm.graph import components
from tallybook.session import cut_lineage

#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
RADIUS = 4
SEED = 42
FEW = 12        # so many fingerprints under one key are compared all at once, more of them one neighbourhood after the other


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where((rest >> bit) & 1, GOLAY << (bit - 11), 0)
    return rest


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: error patterns that lead to a codeword at most 3, or else 4 bits away (first the nearest), and how many."""
    table, n = np.zeros((2048, 6), np.int64), np.ones(2048, np.int64)
    for weight in range(5):
        made = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        for pattern, s in zip(made, _syndromes(made), strict=True):
            if weight <= 3:
                table[s, :] = pattern
            else:
                table[s, n[s]] = pattern
                n[s] += 1
    return table, n


_TABLE: list = []


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices of 23-bit words, the nearest first, and how many of them count (1 or 6)."""
    if not _TABLE:
        _TABLE.extend(_patterns())
    s = _syndromes(words)
    return (words.astype(np.int64)[:, None] ^ _TABLE[0][s]) >> 11, _TABLE[1][s]


def fingerprint_of(data: bytes, shingle: int = 4) -> int:
    """SimHash of one text in UTF-8, as an unsigned number."""
    words = data.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(whole[s:e], SEED) for s, e in zip(starts, stops, strict=True)), np.uint64, n)
    set_in = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at: at + (1 << 16)]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp is the signed long of the fingerprint's 64 bits."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint_of(t.as_buffer().to_pybytes(), shingle) for t in b.column("bytes")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))
    return slim.mapInArrow(made, "doc_id long, fp long")


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and, for each, which of the fingerprints it belongs to."""
    seg = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [golay_keys(s) for s in seg]
    own, tag, keys, owner = np.arange(len(fps)), 0, [], []
    for i in range(3):
        for j in range(3):
            if i == j:
                continue
            for c in range(6):                                   # segment i equal, segment j within 2
                rows = own[near[j][1] > c]
                keys.append(((seg[i][rows] << 12 | near[j][0][rows, c]) << 4) | tag)
                owner.append(rows)
            tag += 1
            if i < j:                                            # both within 1
                for a, b in [(0, c) for c in range(6)] + [(c, 0) for c in range(1, 6)]:
                    rows = own[(near[i][1] > a) & (near[j][1] > b)]
                    keys.append(((near[i][0][rows, a] << 12 | near[j][0][rows, b]) << 4) | tag)
                    owner.append(rows)
                tag += 1
    return np.concatenate(keys), np.concatenate(owner)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False)
        keys, owner = keys_of(fps.view(np.uint64))
        for at in range(0, len(keys), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at: at + (1 << 18)]), pa.array(fps[owner[at: at + (1 << 18)]])], ["key", "fp"])


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _stars(fps: np.ndarray) -> list[np.ndarray]:
    """Links enough to connect what is connected among many fingerprints: each joins the smallest of its group."""
    out, left = [], np.sort(fps)
    while len(left) > 1:
        root, reached, left = left[:1], [left[:1]], left[1:]
        todo = root
        while len(todo) and len(left):
            near = _far(left, todo[0]) <= RADIUS
            reached.append(left[near])
            todo, left = np.concatenate((todo[1:], left[near])), left[~near]
        group = np.concatenate(reached)
        if len(group) > 1:
            out.append(np.stack((np.repeat(root, len(group) - 1), group[1:])))
    return out


def _links(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links among fingerprints sorted by key; whole groups only."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    out = []
    for s, n in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
        out += _stars(np.unique(fp[s: s + n]))
    some = np.repeat((sizes > 1) & (sizes <= FEW), sizes)
    key, fp = key[some], fp[some]
    for lag in range(1, min(FEW, len(key))):
        near = np.flatnonzero((key[lag:] == key[:-lag]) & (fp[lag:] != fp[:-lag]) & (_far(fp[lag:], fp[:-lag]) <= RADIUS))
        if not len(near) and not (key[lag:] == key[:-lag]).any():
            break
        out.append(np.stack((fp[near], fp[near + lag])))
    links = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return np.unique(np.sort(links, axis=0), axis=1)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by key; a group may go on in the next batch."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def made(links: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], ["a", "b"])
    for b in batches:
        key, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        if not len(key):
            continue
        if waiting and waiting[0][0][0] == key[-1]:
            waiting.append((key, fp))
            continue
        if waiting:
            key, fp = (np.concatenate([*(w[i] for w in waiting), x]) for i, x in enumerate((key, fp)))
        cut = np.searchsorted(key, key[-1])
        waiting = [(key[cut:], fp[cut:])]
        yield made(_links(key[:cut], fp[:cut]) if cut else np.zeros((2, 0), np.int64))
    if waiting:
        yield made(_links(*(np.concatenate([w[i] for w in waiting]) for i in (0, 1))))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links of distinct fingerprints ``fp`` at RADIUS or fewer differing bits, enough of them to connect all that is connected."""
    spread = fps.mapInArrow(_spread, "key long, fp long").repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(_meet, "a long, b long")


def groups(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): groups of documents linked by near-equal fingerprints.

    Equal fingerprints are one node, however many documents share one; a component is named by its smallest doc_id. Null and
    empty texts have fingerprint 0 and link like any other. Rows without doc_id take part, but do not name a component (null if it
    has no other). Repeated rows stay. Texts of any length are taken whole; one must fit in a task. Other columns are dropped. Empty in, empty out.
    """
    marked = cut_lineage(with_fingerprint(docs, text_col))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(component, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document with the smallest doc_id stays, once. Rows without doc_id pass.

    Of several rows with that doc_id the shortest stays, ties broken by the text's hash, source and lang. Null and empty texts are one group. The columns of documents stay. Empty in, empty out.
    """
    keep = groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    ranked = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi").withColumn(
        "__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("n_chars", F.xxhash64("text"), "source", "lang")))
    return ranked.where("__n = 1").select(*docs.columns).unionByName(docs.where("doc_id is null"))
