"""Benchmark decontamination by greedy string tiling.

Texts are words in lower case without ASCII punctuation. A document is a candidate for a benchmark item if they share
a seed: a run of ``min_match`` words, found by a rolling hash. Then the longest common runs of the two that overlap
no run chosen before are marked, longest first, down to ``min_match`` words; the search length falls by halves and
each search compares rolling hashes of that length (running Karp-Rabin). The share of the item's words that are
marked is its coverage, wherever in the document and in whatever order the runs stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import document_batches, write_table

MIN_MATCH, COVERAGE = 5, 0.8
#: Text bytes of benchmark items that one pass over the documents carries to the executors; more take more passes.
PASS_BYTES = 16 * 1024 * 1024
#: Base of the rolling hash, modulo 2**64; equal hashes are compared word by word.
BASE = np.uint64(0x9E3779B97F4A7C15)

_SPACES = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPACES).split()


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, BASE, np.uint64))))


class Rolling:
    """Hash of any window of a sequence of small non-negative ids."""

    def __init__(self, ids: np.ndarray):
        values = ids.astype(np.uint64) + np.uint64(1)
        self.powers = _powers(len(ids))
        # sums of id * base**(n - position): a window's share, moved to a common power, is its hash
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(values * self.powers[:-1][::-1], dtype=np.uint64)))
        self.n = len(ids)

    def windows(self, length: int, ceiling: int) -> np.ndarray:
        """Hashes of all windows, comparable between sequences of at most ``ceiling`` ids."""
        k = self.n - length + 1
        if k <= 0:
            return np.zeros(0, np.uint64)
        shift = _powers(ceiling)[ceiling - self.n : ceiling - self.n + k]
        return (self.sums[length:] - self.sums[:k]) * shift


def _open(marks: np.ndarray, length: int) -> np.ndarray:
    """Whether the window of ``length`` that starts at a position holds no mark."""
    total = np.concatenate(([0], np.cumsum(marks)))
    return total[length:] == total[: len(total) - length]


def tile(item: np.ndarray, doc: np.ndarray, min_match: int) -> int:
    """Words of ``item`` that greedy tiling by ``doc`` marks. Negative ids in ``doc`` match nothing."""
    a_marks, b_marks = np.zeros(len(item), np.int64), (doc < 0).astype(np.int64)
    if not len(item) or not len(doc):
        return 0
    ceiling = max(len(item), len(doc))
    a_hash, b_hash = Rolling(item), Rolling(np.maximum(doc, 0))
    length = min(len(item), len(doc))
    while length >= min_match:
        a_open, b_open = np.flatnonzero(_open(a_marks, length)), np.flatnonzero(_open(b_marks, length))
        a_keys, b_keys = a_hash.windows(length, ceiling)[a_open], b_hash.windows(length, ceiling)[b_open]
        order = np.argsort(a_keys, kind="stable")
        low, high = (np.searchsorted(a_keys[order], b_keys, side) for side in ("left", "right"))
        hits = np.flatnonzero(high > low)
        counts = (high - low)[hits]
        if len(hits):
            b = np.repeat(b_open[hits], counts)
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            a = a_open[order[np.repeat(low[hits], counts) + within]]
            # only where a common run begins: not where both words before it are common and free as well
            before = (a > 0) & (b > 0)
            before &= (item[a - 1] == doc[b - 1]) & (a_marks[a - 1] == 0) & (b_marks[b - 1] == 0)
            runs = []
            for x, y in zip(a[~before].tolist(), b[~before].tolist(), strict=True):
                n = 0
                while x + n < len(item) and y + n < len(doc) and item[x + n] == doc[y + n] and not a_marks[x + n] and not b_marks[y + n]:
                    n += 1
                if n >= length:
                    runs.append((n, x, y))
            runs.sort(key=lambda r: (-r[0], r[1], r[2]))
            while runs:
                n, x, y = runs.pop(0)
                free = (a_marks[x : x + n] == 0) & (b_marks[y : y + n] == 0)
                if free.all():
                    a_marks[x : x + n] = 1
                    b_marks[y : y + n] = 1
                    continue
                # what a chosen run left of it may still be long enough
                edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
                parts = [(int(e - s), x + int(s), y + int(s)) for s, e in edges.reshape(-1, 2) if e - s >= length]
                if parts:
                    runs = sorted([*runs, *parts], key=lambda r: (-r[0], r[1], r[2]))
        if length == min_match:
            break
        length = max(min_match, length // 2)
    return int(a_marks.sum())


class Items:
    """Benchmark items as ids of their own words, and their seeds."""

    def __init__(self, items: list[tuple[int, str]], min_match: int, coverage: float):
        self.min_match, self.coverage, self.vocab = min_match, coverage, {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words(text)]
            if ids:
                self.items.append((item_id, np.array(ids, np.int64)))
        seeds: dict[int, dict[int, set[int]]] = {}
        for k, (_, ids) in enumerate(self.items):
            n = min(min_match, len(ids))  # a shorter item is one seed
            for h in seed_hashes(ids, n):
                seeds.setdefault(n, {}).setdefault(int(h), set()).add(k)
        self.seeds = {n: (np.array(sorted(s), np.uint64), s) for n, s in seeds.items()}

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, words marked, words) of each item that ``text`` covers enough."""
        w = words(text)
        if not w or not self.items:
            return []
        ids = np.fromiter(map(self.vocab.get, w, repeat(-1)), np.int64, len(w))
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        candidates: dict[int, set[int]] = {}
        for n, (keys, of) in self.seeds.items():
            at = np.flatnonzero(known[n:] - known[: len(known) - n] == n) if len(ids) >= n else []
            if not len(at):
                continue
            hashes = seed_hashes(ids, n, at)
            place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            for p, h in zip(at[keys[place] == hashes].tolist(), hashes[keys[place] == hashes].tolist(), strict=True):
                for k in of[h]:
                    candidates.setdefault(k, set()).add(p)
        if not candidates:
            return []
        out = []
        ends = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0])))).reshape(-1, 2)
        for k in sorted(candidates):
            item_id, item = self.items[k]
            # the runs of known words that hold a seed, kept apart by a word that matches nothing
            runs = np.unique(np.searchsorted(ends[:, 0], sorted(candidates[k]), side="right") - 1)
            doc = np.concatenate([np.concatenate((ids[s:e], [-1])) for s, e in ends[runs]])
            marked = tile(item, doc, min(self.min_match, len(item)))
            if marked >= self.coverage * len(item):
                out.append((item_id, marked, len(item)))
        return out


def seed_hashes(ids: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hash of the n ids from each of the positions ``at`` (all of them by default)."""
    at = np.arange(len(ids) - n + 1) if at is None else at
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out * BASE + ids[at + k].astype(np.uint64) + np.uint64(1)
    return out


def _find_udf(items: Items, spark) -> Column:
    sent = spark.sparkContext.broadcast(items)  # built from at most about PASS_BYTES of text

    @F.pandas_udf("array<struct<item_id: long, covered: long, item_tokens: long>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"item_id": i, "covered": c, "item_tokens": n} for i, c, n in sent.value.find(t)] for t in texts], dtype=object)

    return find.asNondeterministic()  # so that no filter or projection runs it twice


def with_matches(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, pass_bytes: int = PASS_BYTES, column: str = "matches") -> DataFrame:
    """``docs`` and an array column of (item_id, covered, item_tokens) for the items that a text contains.

    Reads text of ``docs`` and item_id, text of ``benchmark``. If the benchmark is larger than ``pass_bytes`` its
    items are dealt by hash to as many passes as that takes; a pass goes over all documents and is written before the
    next one starts, so driver and executors hold ``pass_bytes`` of items however large the benchmark is. Null, empty and
    blank texts contain nothing and, as items, are in nothing. An item of fewer than ``min_match`` words must stand in
    a document as one run. Items with a null id or equal texts are each found. Repeated rows get equal results; very
    long texts are searched whole; empty tables give no rows, or no matches.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    dealt = items.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    document_batches(spark)
    columns = docs.columns
    for k in range(passes):
        own = [(r["item_id"], r["text"]) for r in dealt.where(F.col("pass") == k).orderBy("item_id", "text").collect()]
        find = _find_udf(Items(own, min_match, coverage), spark)(F.col("text").cast("string"))
        docs = docs.select(*(F.col(f"`{c}`") for c in columns), *([F.col(column).alias("__before")] if k else []), find.alias("__found"))
        docs = docs.select(*(F.col(f"`{c}`") for c in columns), (F.concat("__before", "__found") if k else F.col("__found")).alias(column))
        if k + 1 < passes:  # a written table between passes: executors hold the items of one pass at a time
            docs = write_table(docs, "tiling-pass")
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, covered, item_tokens, coverage."""
    rows = with_matches(docs.select("doc_id", "text"), benchmark, **options).select("doc_id", F.explode("matches").alias("m"))
    return rows.select("doc_id", "m.item_id", "m.covered", "m.item_tokens", (F.col("m.covered") / F.col("m.item_tokens")).alias("coverage"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that contain no item, with their columns."""
    return with_matches(docs, benchmark, column="__matches", **options).where(F.size("__matches") == 0).drop("__matches")
