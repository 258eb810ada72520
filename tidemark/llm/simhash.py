"""SimHash fingerprints, linked within a Hamming radius by sharded BK-trees.

Two fingerprints that differ in at most ``radius`` bits agree in at least ``blocks - radius`` of any ``blocks`` bit
blocks. Every choice of so many blocks, with their bits, names a shard: near fingerprints share a shard, and a
fingerprint meets the trees of its few shards only. The number of blocks follows the number of distinct
fingerprints, so that a shard stays small; every choice is exact. A shard with more fingerprints than one tree may
hold is dealt to several trees, and each of its fingerprints queries all of them.

The trees are not broadcast: together they hold every fingerprint, so their size grows with the data and has no
bound. Each tree goes to one task through the shuffle, with the fingerprints that query it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, write_table

WORDS, SEED, RADIUS = 3, 42, 3
#: Fingerprints a tree may hold.
TREE_SIZE = 4096
#: (distinct fingerprints up to, blocks): above it a shard would hold over about 64.
BLOCKS = ((1 << 22, 4), (1 << 31, 5), (1 << 63, 6))

_LANE = (np.arange(8) * 256).astype(np.int64)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, each 1 if it is set in over half of the shingle hashes; 0 where there is no word."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    joined, n = b" ".join(w), max(1, len(w) - words + 1)
    if len(w) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    lanes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8) + _LANE
    per_byte = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    set_bits = (per_byte @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * set_bits > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words, seed) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(worker, "doc_id long, fp long")


class BKTree:
    """Children of a node hang at their Hamming distance to it; a query follows only edges within the radius."""

    __slots__ = ("values", "payloads", "children")

    def __init__(self):
        self.values, self.payloads, self.children = [], [], []

    def add(self, value: int, payload) -> None:
        at, node = 0, len(self.values)
        self.values.append(value)
        self.payloads.append(payload)
        self.children.append({})
        while node:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].setdefault(d, node)
            if nxt == node:
                return
            at = nxt

    def within(self, value: int, radius: int) -> Iterator:
        """Payloads of the values at most ``radius`` away."""
        stack = [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                yield self.payloads[at]
            for k, child in children[at].items():
                if d - radius <= k <= d + radius:
                    stack.append(child)


def block_bounds(blocks: int, width: int = 64) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each block."""
    edges = [round(i * width / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def shard_keys(fp: Column, blocks: int, radius: int) -> Column:
    """Array of shard keys: one for each choice of ``blocks - radius`` blocks that are to agree."""
    bounds = block_bounds(blocks)
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        bits = F.lit(number).cast("long")
        for i in chosen:
            start, n = bounds[i]
            bits = F.shiftleft(bits, n).bitwiseOR(F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << n) - 1)))
        keys.append(bits)
    return F.array(*keys)


def _link_worker(radius: int):
    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (shard, tree, role): a tree's own fingerprints, then those that only query it."""
        at, tree, parent, out = None, BKTree(), {}, []

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for b in batches:
            for shard, number, role, fp, node in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if (shard, number) != at:
                    at, tree, parent = (shard, number), BKTree(), {}
                for other in tree.within(fp & 0xFFFFFFFFFFFFFFFF, radius):
                    x, y = root(other), root(node)
                    if x != y:  # a forest of a tree's links is enough for components
                        parent[max(x, y)] = min(x, y)
                        out.append((node, other))
                if not role:
                    tree.add(fp & 0xFFFFFFFFFFFFFFFF, node)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []

    return worker


def near_links(fps: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that join all fingerprints of ``fps`` (fp, node) within ``radius`` into the same components.

    ``fps`` must be written already: it is read several times. fp and node are distinct and not null.
    """
    if blocks is None:
        n = fps.count()
        blocks = radius + next(k for most, k in BLOCKS if n <= most) - RADIUS
    rows = fps.select("fp", "node", F.explode(shard_keys(F.col("fp"), blocks, radius)).alias("shard"))
    large = rows.groupBy("shard").count().where(F.col("count") > tree_size)
    large = large.select(F.col("shard").alias("large"), F.ceil(F.col("count") / tree_size).cast("int").alias("trees"))
    rows = rows.join(large, rows.shard == large.large, "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    # a pair of different trees is tried once, in the later one
    rows = rows.withColumn("tree", F.explode(F.sequence("own", F.col("trees") - 1)))
    rows = rows.select("shard", "tree", (F.col("tree") > F.col("own")).cast("int").alias("role"), "fp", "node")
    rows = rows.repartition("shard", "tree").sortWithinPartitions("shard", "tree", "role", "fp")
    return rows.mapInArrow(_link_worker(radius), "a long, b long")


def near_components(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, seed: int = SEED, tree_size: int = TREE_SIZE) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (smallest doc_id reachable by links) per row.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names. Null, empty and blank texts have
    fingerprint zero and are linked like any other. Copies share a fingerprint and are linked through it, never pair
    by pair. Repeated rows give repeated results. A null doc_id takes part in no link; its component is that of its
    fingerprint's other documents, or null. An empty table gives no rows.
    """
    own = write_table(fingerprints(docs, words, seed), "fingerprints")
    fps = write_table(own.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct-fingerprints")
    links = near_links(fps.where("node is not null"), radius, tree_size)
    found = connected_components(links)
    named = fps.join(found, "node", "left").select(F.col("fp").alias("f"), F.coalesce("component", "node").alias("component_id"))
    out = own.join(named, own.fp == named.f)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

