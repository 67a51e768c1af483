"""Embedding near-duplicates with an inverted multi-index.

Unit vectors are cut in two halves, each with a codebook of its own; pairs of codewords form the grid of cells. Every vector lies in one cell.
From each vector the multi-sequence traversal visits cells in the order of summed distances, the nearest first, up to a radius. The
radius is measured on a sample of queries against all rows, in which a group of near copies counts about once, however large. Where the
sample holds too few links to show the wanted recall, every cell is visited that a linked vector can lie in, and no link is missed.
Whoever is met in a cell is compared exactly, in double precision.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.graph import components
from tallybook.llm.sampling import at_most
from tallybook.session import cut_lineage

LINK = 0.93
SAMPLE = 20_000         # vectors that the codebooks are fitted to
QUERIES = 1_000         # vectors whose links are sought among all rows to measure the radius
RECALL = 0.995
IN_CELL = 256           # vectors of a label that a cell holds on average
PART = 2_048            # members, and queries, of a cell that one group compares; also what a cell of an exact index holds on average
BINS = 4_000            # of the radius, over 0 to 4


class Index:
    """Codebooks of both halves. An exact one tells, in place of the excess, how far (squared) a codeword's cell is at least."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 1, exact: bool = False):
        self.exact = exact
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.cut = (unit.shape[1] + 1) // 2
        self.books = [_kmeans(x, k, seed) for x in (unit[:, : self.cut], unit[:, self.cut:])]

    def excess(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For unit vectors and each half: the nearest codeword, and by how much farther (squared) each codeword is."""
        out = []
        for x, book in zip((vectors[:, : self.cut], vectors[:, self.cut:]), self.books, strict=True):
            d = (x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1)[None]
            out += [d.argmin(1), _apart(d, book) if self.exact else d - d.min(1, keepdims=True)]
        return out[0], out[1], out[2], out[3]

    def visits(self, vectors: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every visit: the cells whose excess over the nearest is within the radius."""
        _, e1, _, e2 = self.excess(vectors)
        order = np.argsort(e2, axis=1)
        e2 = np.take_along_axis(e2, order, 1)
        rows, cells = [], []
        for i in range(e1.shape[1]):                             # a staircase: the farther in one half, the fewer in the other
            n = (e2 <= radius - e1[:, i: i + 1]).sum(1)
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            rows.append(row)
            cells.append(i * e2.shape[1] + order[row, step])
        return np.concatenate(rows), np.concatenate(cells)


def _apart(d: np.ndarray, book: np.ndarray) -> np.ndarray:
    """From squared distances to codewords, the least squared distances to their cells: those to the farthest of the planes that bound a cell."""
    gap = np.sqrt(((book[:, None] - book[None]) ** 2).sum(2))
    out = np.zeros_like(d)
    for k in range(len(book)):
        far = gap[k] > 1e-6
        out[:, far] = np.maximum(out[:, far], (d[:, far] - d[:, k: k + 1]) / (2 * gap[k, far]))
    return out * out


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    rng = np.random.default_rng(seed)
    books = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((books * books).sum(1)[None] - 2 * x @ books.T).argmin(1)
        sums, n = np.zeros_like(books), np.bincount(near, minlength=len(books))
        np.add.at(sums, near, x)
        books[n > 0] = sums[n > 0] / n[n > 0, None]
    return books


def _vectors(batch: pa.RecordBatch | pa.Table, dims: int) -> np.ndarray:
    col = batch.column("vec")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.linalg.norm(v, axis=1)
    return v / n[:, None], n


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(label, vec, times, least, node): equal vectors of one label as one row; node numbers them."""
    fine = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    found = rows.where(fine).groupBy("label", F.transform("embedding", lambda x: x.cast("double")).alias("vec")).agg(F.count("*").alias("times"), F.min("vec_id").alias("least"))
    return cut_lineage(cut_lineage(found).withColumn("node", F.monotonically_increasing_id()))


def _radius(found: DataFrame, total: int, index: Index, dims: int, link: float, recall: float, queries: int) -> tuple[float | None, float]:
    """Radius at which the sampled queries meet all their links, for as many of them as the recall says, and that share.

    A query weighs 1 / (1 + its links): a group of near copies counts about once, and does not speak for rare pairs. None if the
    linked queries are worth fewer than the 1 / (1 - recall) that could show such a recall. If all rows are queries, no link is missed.
    """
    chosen = at_most(found, queries, total, "vec", "label").select("label", "vec", "node").toArrow()
    q, _ = _unit(_vectors(chosen, dims))
    labels, nodes = (np.asarray(chosen.column(c).to_pylist()) for c in ("label", "node"))
    a1, e1, a2, e2 = index.excess(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, _ = _unit(_vectors(b, dims))
            own, node = (np.asarray(b.column(c).to_pylist()) for c in ("label", "node"))
            i, j = np.nonzero((v @ q.T >= link) & (own[:, None] == labels[None]) & (node[:, None] != nodes[None]))
            b1, f1, b2, f2 = index.excess(v)
            need = np.minimum(f1[i, a1[j]] + f2[i, a2[j]], e1[j, b1[i]] + e2[j, b2[i]])
            n, worst = np.bincount(j, minlength=len(q)), np.zeros(len(q), np.int64)
            np.maximum.at(worst, j, np.minimum(np.ceil(need / 4 * BINS).astype(np.int64), BINS))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(worst[at]), pa.array(n[at])], ["query", "bin", "n"])
    rows = found.select("label", "vec", "node").mapInArrow(run, "query long, bin long, n long").groupBy("query").agg(F.max("bin").alias("bin"), F.sum("n").alias("n")).collect()
    at = np.array(sorted((r.bin, 1 / (1 + r.n)) for r in rows)).reshape(-1, 2)
    bins, weight = at[:, 0], at[:, 1]
    if chosen.num_rows >= total:
        return (bins.max(initial=0) + 1) * 4 / BINS, 1.0
    if recall >= 1 or weight.sum() ** 2 * (1 - recall) < (weight * weight).sum() or not len(bins):
        return None, 1.0
    met = np.cumsum(weight) / weight.sum()
    last = min(np.searchsorted(met, recall), len(bins) - 1)
    return (bins[last] + 1) * 4 / BINS, float(weight[bins <= bins[last]].sum() / weight.sum())


def _meet(index: Index, dims: int, link: float, radius: float):
    """One part of a cell: queries against members. Links of each, and enough of them to connect what is connected."""
    def run(table: pa.Table) -> pa.Table:
        asks = np.asarray(table.column("asks").to_pylist(), bool)
        v = _vectors(table, dims)
        node, times = (table.column(c).to_numpy() for c in ("node", "times"))
        u, norm = _unit(v)
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(q) or not len(m):
            return _RESULT.empty_table()
        hit = (v[q] @ v[m].T) / (norm[q][:, None] * norm[m][None]) >= link
        hit &= node[q][:, None] != node[m][None]
        if not hit.any():
            return _RESULT.empty_table()
        q, m = q[hit.any(1)], m[hit.any(0)]
        hit = hit[hit.any(1)][:, hit.any(0)]
        c1, _, c2, _ = index.excess(u[q])
        _, f1, _, f2 = index.excess(u[m])
        back = f1[:, c1] + f2[:, c2] <= radius                   # the member visits the query's cell, and counts the link there
        n = np.concatenate((hit @ times[m], (hit & ~back.T).T @ times[q]))
        who = np.concatenate((node[q], node[m]))
        ql, ml = node[q].copy(), node[m].copy()
        big = np.iinfo(np.int64).max
        while True:                                              # the smallest node of each connected part
            nq = np.minimum(ql, np.where(hit, ml[None], big).min(1))
            nm = np.minimum(ml, np.where(hit, nq[:, None], big).min(0))
            if (nq == ql).all() and (nm == ml).all():
                break
            ql, ml = nq, nm
        to = np.concatenate((ql, ml))
        count, edge = n > 0, to != who
        a = np.concatenate((who[count], who[edge]))
        b = pa.array(np.concatenate((who[count], to[edge])), mask=np.concatenate((np.ones(count.sum(), bool), np.zeros(edge.sum(), bool))))
        return pa.table([pa.array(a), b, pa.array(np.concatenate((n[count], np.zeros(edge.sum(), np.int64))))], schema=_RESULT)
    return run


_RESULT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def links(found: DataFrame, link: float = LINK, recall: float = RECALL, sample: int = SAMPLE, queries: int = QUERIES) -> tuple[DataFrame, dict]:
    """(a, b, n) from distinct_vectors(): with b, a link that connects; without, n links more of a. And what was measured."""
    sizes = found.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).orderBy(F.desc("n"), "dims").collect()
    out, told = None, {}
    for s in sizes:                                              # vectors of different lengths never link: an index for each length
        some = found.where(F.size("vec") == s["dims"])
        k = max(2, round(math.sqrt(s["n"] / s["labels"] / IN_CELL)))
        fitted = at_most(some, sample, s["n"], "vec", "label").select("vec").toArrow()
        index = Index(_vectors(fitted, s["dims"]), k)
        radius, measured = _radius(some, s["n"], index, s["dims"], link, recall, queries)
        if radius is None:                                       # |x - y|^2 of unit vectors that link; most cells are visited, so fewer and larger ones
            k, radius = max(2, round(math.sqrt(s["n"] / s["labels"] / PART))), 2 - 2 * link + 1e-9
            index = Index(_vectors(fitted, s["dims"]), k, exact=True)
        told[s["dims"]] = {"codewords": k, "radius": radius, "recall": measured, "exact": index.exact}
        made = _compared(some, index, s["dims"], link, radius)
        out = made if out is None else out.union(made)
    if out is None:
        out = found.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("times").alias("n")).limit(0)
    return out, told


def _compared(found: DataFrame, index: Index, dims: int, link: float, radius: float) -> DataFrame:
    width = index.books[1].shape[0]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, _ = _unit(_vectors(b, dims))
            c1, _, c2, _ = index.excess(u)
            row, cell = index.visits(u, radius)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(c1 * width + c2), pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(u))))).astype(np.int32)), pa.array(cell[np.argsort(row, kind="stable")]))], ["node", "own", "cells"])
    seen = cut_lineage(found.select("node", "vec").mapInArrow(visits, "node long, own long, cells array<long>").join(found.select("node", "label"), "node"))
    members = seen.groupBy("label", F.col("own").alias("cell")).agg(F.count("*").alias("m"))
    asking = seen.select("label", F.explode("cells").alias("cell")).groupBy("label", "cell").agg(F.count("*").alias("q"))
    parts = members.join(asking, ["label", "cell"]).select("label", "cell", F.ceil(F.col("m") / PART).alias("mp"), F.ceil(F.col("q") / PART).alias("qp"))
    salt = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    inside = seen.select("node", "label", F.col("own").alias("cell"), F.lit(False).alias("asks")).join(parts, ["label", "cell"]).select(
        "*", (salt % F.col("mp")).alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("qp") - 1)).alias("j"))
    outside = seen.select("node", "label", F.explode("cells").alias("cell"), F.lit(True).alias("asks")).join(parts, ["label", "cell"]).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("mp") - 1)).alias("i"), (salt % F.col("qp")).alias("j"))
    dealt = inside.union(outside.select(inside.columns)).select("node", "label", "cell", "i", "j", "asks").join(found.select("node", "vec", "times"), "node")
    return dealt.groupBy("label", "cell", "i", "j").applyInArrow(_meet(index, dims, link, radius), "a long, b long, n long")


def groups(rows: DataFrame, link: float = LINK, **settings) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of (vec_id, embedding, label).

    Vectors of one label and length link at a cosine of ``link`` or more. A vector that is null, zero, empty or holds a null or
    non-finite component, and a vector without label, links with nothing. Equal rows and equal vectors count as links one by one. A component is named by its smallest
    vec_id; a vector without vec_id takes part, and is never kept. Other columns are dropped. Empty in, empty out.
    """
    found = distinct_vectors(rows)
    made = cut_lineage(links(found, link, **settings)[0])
    counts = made.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(made.where("b is not null").select("a", "b"))
    known = found.select("node", "label", "vec", "times", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left")
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(named, "root").select(F.col("label").alias("__label"), "vec", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    own = rows.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = own.join(known, (F.col("label") == F.col("__label")) & (F.col("v") == F.col("vec")), "left")
    component = F.coalesce("component_id", "vec_id").cast("bigint")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
