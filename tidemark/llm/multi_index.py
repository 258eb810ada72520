"""Embedding near-duplicates by an inverted multi-index.

Two codebooks, one for each half of a unit vector, are fitted on a bounded sample. Every vector lies in one cell of
their product grid. A vector visits the cells nearest to it in the order of the multi-sequence traversal (the sum of
the two half distances rises), as many as put the cell of a vector at the threshold among those visited with
``recall`` probability; that number is measured on the sample. What it meets in a visited cell is verified by cosine
in double precision. A link counts if either vector visits the other's cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import connected_components, write_table

THRESHOLD, RECALL = 0.98, 0.995
#: Vectors the codebooks are fitted on (at most, whatever the table holds).
SAMPLE = 8192
#: Vectors a cell should hold, and centroids a codebook may have.
CELL, MOST_CENTROIDS = 1024, 1024
#: Vectors of a cell in one task; a cell with more is dealt to several.
BLOCK = 2048
PROBES = 1024


def unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        for i in range(len(c)):
            own = x[near == i]
            if len(own):
                c[i] = own.mean(0)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1))


def multi_sequence(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in rising order of d1[i] + d2[j], from the two sorted lists alone."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}
    while heap:
        _, a, b = heapq.heappop(heap)
        yield int(o1[a]), int(o2[b])
        for p in ((a + 1, b), (a, b + 1)):
            if p[0] < len(o1) and p[1] < len(o2) and p not in seen:
                seen.add(p)
                heapq.heappush(heap, (d1[o1[p[0]]] + d2[o2[p[1]]], *p))


class Index:
    """Codebooks of the two halves and the number of cells that a vector visits."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, recall: float, seed: int = 7):
        dim, self.half = sample.shape[1], sample.shape[1] // 2
        k = int(min(MOST_CENTROIDS, max(2, np.ceil(np.sqrt(n / CELL)))))
        u = unit(sample)
        self.books = [_kmeans(u[:, : self.half], k, seed), _kmeans(u[:, self.half :], k, seed + 1)]
        # vectors at exactly the threshold, in random directions: the farthest that must be found
        noise = np.random.default_rng(seed + 2).standard_normal(u.shape)
        noise = unit(noise - (noise * u).sum(1, keepdims=True) * u) if dim > 1 else np.zeros_like(u)
        at = self.home(threshold * u + np.sqrt(1 - threshold**2) * noise)
        d = [_distances(h, b) for h, b in zip(self._halves(u), self.books, strict=True)]
        width = len(self.books[1])
        of_near = d[0][np.arange(len(u)), at // width] + d[1][np.arange(len(u)), at % width]
        rank = [(np.add.outer(a, b) < x - 1e-12).sum() + 1 for a, b, x in zip(*d, of_near, strict=True)] if len(u) <= 2048 else [(np.add.outer(d[0][i], d[1][i]) < of_near[i] - 1e-12).sum() + 1 for i in range(0, len(u), len(u) // 2048)]
        self.visits = int(np.quantile(rank, recall, method="higher"))
        cells = len(self.books[0]) * width
        # the t-th cell of the traversal has (rank in one half) * (rank in the other) <= t
        pairs = [(a, b) for a in range(len(self.books[0])) for b in range(width) if (a + 1) * (b + 1) <= self.visits]
        self.visits, self.pairs = min(self.visits, cells), np.array(pairs)

    def _halves(self, u: np.ndarray) -> list[np.ndarray]:
        return [u[:, : self.half], u[:, self.half :]]

    def home(self, u: np.ndarray) -> np.ndarray:
        a, b = (_distances(h, c).argmin(1) for h, c in zip(self._halves(u), self.books, strict=True))
        return a * len(self.books[1]) + b

    def visit(self, u: np.ndarray) -> np.ndarray:
        """The first ``visits`` cells of each vector's multi-sequence traversal, for a batch at once."""
        d = [_distances(h, c) for h, c in zip(self._halves(u), self.books, strict=True)]
        order = [np.argsort(x, axis=1, kind="stable") for x in d]
        near = [np.take_along_axis(x, o, 1) for x, o in zip(d, order, strict=True)]
        sums = near[0][:, self.pairs[:, 0]] + near[1][:, self.pairs[:, 1]]
        first = np.argsort(sums, axis=1, kind="stable")[:, : self.visits]
        a = np.take_along_axis(order[0], self.pairs[first, 0], 1)
        b = np.take_along_axis(order[1], self.pairs[first, 1], 1)
        return (a * len(self.books[1]) + b).astype(np.int32)


def _valid(column: pa.Array, dtype) -> list[bytes | None]:
    """Bytes of each vector, None where it links with nothing: null, empty, zero, or a null or non-finite component."""
    out: list[bytes | None] = []
    for v in column:
        own = v.values if v.is_valid else None
        x = None if own is None or not len(own) or own.null_count else own.to_numpy(zero_copy_only=False).astype(dtype)
        if x is not None:
            with np.errstate(over="ignore"):
                norm = np.linalg.norm(x.astype(np.float64))
            x = x if np.isfinite(norm) and norm > 0 else None
        out.append(None if x is None else x.tobytes())
    return out


def _components(match: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id in the component of each row and column of a matrix of links."""
    big = np.iinfo(np.int64).max
    own, other = left.copy(), right.copy()
    while True:
        a = np.minimum(own, np.where(match, other[None, :], big).min(1, initial=big))
        b = np.minimum(other, np.where(match, a[:, None], big).min(0, initial=big))
        if (a == own).all() and (b == other).all():
            return a, b
        own, other = a, b


def _cells_worker(threshold: float, dtype):
    def emit(residents: list, probes: list):
        """Verify the probes of a block against its residents; (node, links, component) of those with a link."""
        r, p = ({"node": np.array([x[0] for x in s]), "mult": np.array([x[1] for x in s]), "home": np.array([x[2] for x in s]), "u": unit(np.frombuffer(b"".join(x[4] for x in s), dtype).reshape(len(s), -1))} for s in (residents, probes))
        match = (p["u"] @ r["u"].T >= threshold) & (p["node"][:, None] != r["node"])
        rows, cols = match.any(1), match.any(0)
        if not rows.any():
            return None
        match = match[rows][:, cols]
        p, r = {k: v[rows] for k, v in p.items()}, {k: v[cols] for k, v in r.items()}
        own, other = _components(match, p["node"], r["node"])
        # a resident counts the probes whose cell it does not visit itself: the others it meets as a probe
        visited = [residents[i][3] for i in np.flatnonzero(cols)]
        unseen = np.array([~np.isin(p["home"], v) for v in visited]).T
        back = (match & unseen) * p["mult"][:, None]
        return np.concatenate([p["node"], r["node"]]), np.concatenate([match @ r["mult"], back.sum(0)]), np.concatenate([own, other])

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (cell, block, role): the block's residents, then its probes."""
        at, residents, probes = None, [], []

        def flush():
            if residents and probes and (found := emit(residents, probes)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["node", "links", "component"])
            probes.clear()

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(10)]
            for label, dim, cell, block, role, *row in zip(*cols, strict=True):
                if (label, dim, cell, block) != at:
                    yield from flush()
                    at, residents = (label, dim, cell, block), []
                if role:
                    probes.append(row)
                    if len(probes) >= PROBES:
                        yield from flush()
                else:
                    residents.append(row)
        yield from flush()

    return worker


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are compared where labels (of any type, by their text) and lengths are equal and labels are not null. The
    commonest length, and each that more than ``block`` vectors have, gets an index of its own; vectors of a rarer
    length share one cell. A vector that is null, empty,
    zero or holds a null or non-finite component links with nothing, like one with a null vec_id: n_links 0, its own
    component, kept. Equal vectors are one entry of the index with a count and link with each other. Other columns are
    ignored. Repeated rows count as copies of each other. An empty table gives no rows.
    """
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    dtype = np.float32 if single else np.float64

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = _valid(b.column(2), dtype)
            raw = [v if i is not None and k is not None else None for v, i, k in zip(raw, b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], ["vec_id", "label", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    rows = write_table(rows.mapInArrow(prepare, "vec_id long, label string, vec binary"), "vectors")
    entries = rows.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult"))
    entries = write_table(entries.withColumn("dim", F.octet_length("vec") / np.dtype(dtype).itemsize).withColumn("dim", F.col("dim").cast("int")), "vector-entries")
    lengths = entries.groupBy("dim").count()
    commonest = lengths.orderBy(F.desc("count"), "dim").limit(1).collect()
    indexes = {}
    for dim, n in {*commonest, *lengths.where(F.col("count") > block).collect()}:
        sample = entries.where(F.col("dim") == dim).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vec").collect()
        indexes[dim] = Index(np.frombuffer(b"".join(bytes(r["vec"]) for r in sample), dtype).reshape(len(sample), dim), n, threshold, recall)
    found = _probe(entries, indexes, dtype, threshold, block)
    found = write_table(found, "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b"))).withColumnRenamed("node", "part")
    named = entries.join(links, "node", "left").join(parts, entries.node == F.col("part"), "left")
    named = named.select(F.col("label").alias("l"), F.col("vec").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "node").alias("c"))
    out = rows.join(named, (rows.label == named.l) & (rows.vec == named.v), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _probe(entries: DataFrame, indexes: dict[int, Index], dtype, threshold: float, block: int) -> DataFrame:
    sent = entries.sparkSession.sparkContext.broadcast(indexes)  # at most 2 * MOST_CENTROIDS centroids a length

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, raw = b.column(3).to_numpy(), b.column(4).to_pylist()
            home, visit = np.zeros(len(raw), np.int32), [np.zeros(1, np.int32)] * len(raw)  # vectors of a rare length share cell 0
            for dim in set(dims.tolist()) & sent.value.keys():
                ix, own = sent.value[dim], np.flatnonzero(dims == dim).tolist()
                u = unit(np.frombuffer(b"".join(raw[i] for i in own), dtype).reshape(len(own), dim))
                home[own] = ix.home(u)
                for i, v in zip(own, ix.visit(u), strict=True):
                    visit[i] = v
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(home), pa.array(visit, pa.list_(pa.int32()))], ["label", "node", "mult", "dim", "vec", "home", "visit"])

    cells = entries.select("label", "node", "mult", "dim", "vec").mapInArrow(assign, "label string, node long, mult long, dim int, vec binary, home int, visit array<int>")
    cells = write_table(cells, "vector-cells")
    large = cells.groupBy("label", "dim", "home").count().where(F.col("count") > block)
    large = large.select("label", "dim", F.col("home").alias("cell"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    payload = ["node", "mult", "home", "visit", "vec"]
    residents = cells.withColumn("cell", F.col("home")).join(large, ["label", "dim", "cell"], "left")
    residents = residents.select("label", "dim", "cell", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), F.lit(0).alias("role"), *payload)
    probes = cells.withColumn("cell", F.explode("visit")).join(large, ["label", "dim", "cell"], "left")
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    probes = probes.select("label", "dim", "cell", "block", F.lit(1).alias("role"), "node", "mult", "home", F.lit(None).cast("array<int>").alias("visit"), "vec")
    both = residents.unionByName(probes).repartition("label", "dim", "cell", "block").sortWithinPartitions("label", "dim", "cell", "block", "role")
    return both.mapInArrow(_cells_worker(threshold, dtype), "node long, links long, component long")
