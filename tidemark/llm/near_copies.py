"""Groups of near copies: SimHash links, and texts that share five-word shingles to a similarity of 0.8.

Copies collapse first, so thousands of them are one text. Then three steps, each over what the one before left apart:

1. Texts that share a MinHash band are compared with the first text of the band alone, so that a group of n near
   copies takes a small multiple of n comparisons and links, never pairs within the group.
2. SimHash: the BK-trees of operator 2 link fingerprints within three bits.
3. What makes the result whole is a prefix filter, whatever the bands missed. In an order of all shingles, rare ones
   first, two texts similar to 0.8 share a shingle near both their beginnings. Every pair of texts of different groups
   that does, and whose places leave room for enough common shingles, is compared exactly. Long texts share a line with
   ever more others as the corpus grows; such pairs go by parity bits in number as the text's shingles, before any text
   is moved.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, document_batches, released, write_table
from tidemark.llm.simhash import RADIUS, SEED, fingerprint, near_links

SIMILARITY, SHINGLE = 0.8, 5
#: MinHash bands of a text, and minima in one band: texts similar to 0.8 share a band with probability 0.99.
BANDS, MINIMA = 12, 5
#: Texts that one task compares with a leader.
MEMBERS = 1024
#: Texts whose shingles are counted, and how many of the most frequent shingles stand last in the order of the prefix filter.
SAMPLE, FREQUENT = 8192, 1 << 16
#: A shingle that so many sampled texts hold is counted by partial sums.
OFTEN = 8
#: Rows that a reader of documents decodes at once.
READ_ROWS = 1024
#: Rows of one Arrow batch from a worker.
BATCH_ROWS = 1 << 16
#: Shingles whose permuted hashes are held at once.
CHUNK = 4096

_SEEDS = np.random.default_rng(SEED)
_FACTORS = _SEEDS.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _SEEDS.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64)

#: Shingles before each that are compared, so that texts which share many meet a few times only.
EARLIER = 4
#: Longs of a text's parity bits.
PARITY = 8
#: Texts of more shingles than this also have wide parity bits, a power of two, at least so many a shingle.
LONG, WIDE = 768, 0.7
#: Ids that may travel as a broadcast; more meet in a join.
BROADCAST = 1 << 19

SKETCH = "doc_id long, fp long, digest binary, bands array<long>, n int, parity array<long>, wide array<long>"


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _shingle_hashes(w: list[bytes], words: int) -> np.ndarray:
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    n = len(w) - words + 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def bands(h: np.ndarray) -> list[int]:
    """One key per band, as unsigned: a hash of the band's minima and its number. No shingle, no bands."""
    if not len(h):
        return []
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), CHUNK):
        low = np.minimum(low, (h[k : k + CHUNK, None] * _FACTORS + _SHIFTS).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), number) for number, row in enumerate(low.reshape(BANDS, MINIMA))]


def parity(h: np.ndarray) -> list[int]:
    """Each distinct shingle turns one of 64 * PARITY bits over: two texts differ in no more bits than in shingles."""
    counts = np.bincount((h >> np.uint64(64 - (64 * PARITY - 1).bit_length())).astype(np.int64), minlength=64 * PARITY)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8").tolist()


def wide_parity(h: np.ndarray) -> list[int] | None:
    """As ``parity``, with bits in number as the shingles: those of a width are the exclusive or of the halves of twice that width."""
    if len(h) <= LONG:
        return None
    bits = 1 << max(6, math.ceil(math.log2(WIDE * len(h))))
    counts = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8").tolist()


def sketch(text: str | None) -> tuple[int, bytes, list[int], int, list[int], list[int] | None]:
    """(whole-text fingerprint, digest of the words, band keys, distinct shingles, parity, wide parity); the first and the keys as unsigned."""
    w = word_list(text)
    h = np.unique(_shingle_hashes(w, SHINGLE))
    return fingerprint(text), hashlib.md5(b" ".join(w)).digest(), bands(h), len(h), parity(h), wide_parity(h)


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sketch(t) for t in b.column(1).to_pylist()]
            flat = _signed([x for r in rows for x in r[2]])
            offsets = np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32)
            arrays = [b.column(0), _signed([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary()), pa.ListArray.from_arrays(offsets, flat)]
            arrays += [pa.array([r[3] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (4, 5))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "fp", "digest", "bands", "n", "parity", "wide"])

    document_batches(docs.sparkSession)
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(worker), SKETCH)


def shingles(text: str | None, words: int = SHINGLE) -> frozenset[int]:
    return frozenset(_shingle_hashes(word_list(text), words).tolist())


def similar(a: frozenset, b: frozenset, similarity: float) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < similarity * large:
        return False
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both)


def _sizes_fit(similarity: float, nx: Column, ny: Column) -> Column:
    return F.least(nx, ny) >= F.lit(similarity) * F.greatest(nx, ny) - 1e-6


def _room(similarity: float, nx: Column, ny: Column) -> Column:
    """In how many parity bits similar texts may differ.

    Texts of nx and ny shingles that are similar have o in common and so differ in nx + ny - 2 o shingles at most, and
    in no more parity bits.
    """
    return nx + ny - 2 * F.ceil(F.lit(similarity / (1 + similarity)) * (nx + ny) - 1e-6)


def _can_be_similar(similarity: float, x: str, y: str) -> Column:
    """Whether sizes and parity bits leave room for similarity: columns n and w0, w1, ... with the ends x and y."""
    nx, ny = F.col(f"n{x}"), F.col(f"n{y}")
    differ = sum((F.bit_count(F.col(f"w{k}{x}").bitwiseXOR(F.col(f"w{k}{y}"))) for k in range(PARITY)), F.lit(0))
    return _sizes_fit(similarity, nx, ny) & (differ <= _room(similarity, nx, ny))


def _parity_columns(end: str) -> list[Column]:
    return [F.col("n").alias(f"n{end}"), *(F.col("parity")[k].alias(f"w{k}{end}") for k in range(PARITY))]


def band_pairs(texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each text b with the smallest node a of every band it shares, once, if the two can be similar."""
    rows = texts.select("node", F.explode("bands").alias("band"))
    leaders = rows.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("high")).where("a <> high")
    pairs = rows.join(leaders, "band").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    one, two = (texts.select(F.col("node").alias(end), *_parity_columns(f"_{end}")) for end in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").where(_can_be_similar(similarity, "_a", "_b")).select("a", "b").distinct()


def possible_pairs(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) of nodes of which some texts (node, n, wide) can be similar by size and wide parity bits.

    What shares a line or two goes here, at the cost of n / 10 bytes instead of a text; 64 * PARITY bits say nothing of
    thousands of shingles. Texts without wide bits stay. The bits of the wider are folded to the width of the other.
    """
    one, two = (texts.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("wide").alias(f"wide_{end}")) for end in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("wide", F.concat("wide_a", "wide_b"))
    width = F.least(F.size("wide_a"), F.size("wide_b"))

    def folded(k: Column) -> Column:
        return F.aggregate(F.sequence(k, F.size("wide") - 1, width), F.lit(0).cast("long"), lambda x, i: x.bitwiseXOR(F.get("wide", i)))

    differ = F.aggregate(F.sequence(F.lit(0), width - 1), F.lit(0), lambda n, k: n + F.bit_count(folded(k)))
    nx, ny = F.col("n_a"), F.col("n_b")
    fits = F.when(F.col("wide").isNull(), True).otherwise(differ <= _room(similarity, nx, ny))
    return both.where(_sizes_fit(similarity, nx, ny)).where(fits).select("a", "b").distinct()


def _verify_worker(similarity: float):
    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (a, part, role): a leader's texts, then those compared with it; one set is held at a time."""
        at, leaders = None, set()
        for b in batches:
            out = []
            keys = (b.column(i).to_pylist() for i in range(4))
            for a, part, role, node, text in zip(*keys, b.column(4), strict=True):
                if (a, part) != at:
                    at, leaders = (a, part), set()
                own = shingles(text.as_py())
                if not role:
                    leaders.add(own)
                elif any(similar(x, own, similarity) for x in leaders):
                    out.append((a, node))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return worker


def verified(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b; written already) whose texts' shingle sets are similar.

    The text of a goes to the tasks that hold its partners, MEMBERS of them in one part; a task holds the shingles of
    one leader and one partner at a time, however many partners there are.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("node"))
    leaders = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("node"))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    needed = write_table(ends, "paired-texts")
    if needed.count() <= BROADCAST:  # then only the texts of pairs are moved
        needed = F.broadcast(needed)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(needed, "node", "left_semi")
    rows = members.union(leaders).join(texts, "node").select("a", "part", "role", "node", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return rows.mapInArrow(released(_verify_worker(similarity)), "a long, b long")


def star_links(links: DataFrame) -> DataFrame:
    """``links`` (a, b) with the same components: each b to its smallest a, and its other a to that one, each once.

    A text shares at most BANDS leaders, so a group is that small.
    """
    per = links.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("ends"))
    own = per.select("b", F.col("ends")[0].alias("a"))
    rest = per.select(F.explode(F.slice("ends", 2, BANDS)).alias("b"), F.col("ends")[0].alias("a"))
    return own.union(rest).select("a", "b").distinct()


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, sampled texts that hold each) of those most frequent in a bounded sample, by shingle."""
    step = max(1, docs.count() // SAMPLE)

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([_signed(list(shingles(text)))], ["token"])

    texts = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select(F.col("text").cast("string").alias("text")).distinct()
    counts = texts.mapInArrow(released(worker), "token long").groupBy("token").count().where("count > 1")
    top = counts.orderBy(F.desc("count"), "token").limit(FREQUENT).collect()
    tokens, n = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    order = np.argsort(tokens)
    return tokens[order], n[order]


def prefix(h: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(similarity n) + 1 of n distinct shingles, rare ones first, and how many sampled texts hold each.

    Similar texts share one of them, whatever order all texts have in common: a sample decides how large groups are,
    never what is found.
    """
    rank = np.zeros(len(h), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        rank = np.where(frequent[at] == h, counts[at], 0)
    order = np.lexsort((h, rank))[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]
    return h[order], rank[order]


def prefix_rows(docs: DataFrame, similarity: float) -> DataFrame:
    """(token, place, id, n, often): the prefix shingles of each text of n shingles, once in a task.

    id is the head of the digest of the text's words; ``often`` marks shingles that many texts hold.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))
    names = ["token", "place", "id", "n", "often"]

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, rows = [], 0

        def batch() -> pa.RecordBatch:
            arrays = [_signed(np.concatenate([x[0] for x in held])), *(pa.array(np.concatenate([x[k] for x in held])) for k in range(1, 5))]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            for text in b.column(0):
                w = word_list(text.as_py())
                head = int.from_bytes(hashlib.md5(b" ".join(w)).digest()[:8], "big", signed=True)
                if not w or head in seen:
                    continue
                seen.add(head)
                h = np.unique(_shingle_hashes(w, SHINGLE))
                own, counts = prefix(h, similarity, *sent.value)
                k = len(own)
                held.append((own, np.arange(k, dtype=np.int32), np.full(k, head), np.full(k, len(h), np.int32), counts >= OFTEN))
                rows += k
                if rows >= BATCH_ROWS:
                    yield batch()
                    rows = 0
        if held:
            yield batch()

    return docs.where("doc_id is not null").select(F.col("text").cast("string")).mapInArrow(released(worker), "token long, place int, id long, n int, often boolean")


def shared_shingles(rows: DataFrame) -> DataFrame:
    """The prefix rows whose shingle more than one text holds, each once.

    Rare shingles, nearly all of the rows, take one shuffle and a window over their few texts. A shingle that many texts
    hold is counted by partial sums first, so that no task holds all of its rows.
    """
    w = Window.partitionBy("token")
    rare = rows.where("not often").withColumns({"low": F.min("id").over(w), "high": F.max("id").over(w)}).where("low <> high")
    common = rows.where("often")
    held = common.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    common = common.join(held, "token")
    columns = ("token", "place", "id", "n")
    return rare.select(*columns).dropDuplicates(["token", "id"]).union(common.select(*columns).dropDuplicates(["token", "id"]))


def prefix_pairs(docs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of texts (digest, node, label, parity) of unlike label that can be similar: every such pair is among them.

    Let x have no more shingles than y, both be similar and o = ceil(similarity / (1 + similarity) (nx + ny)): they
    have o shingles in common at least. The first of these leaves o - 1 behind it in both texts, so its place in x is
    at most nx - o, which no y makes more than nx - 2 similarity / (1 + similarity) nx. So x need show only so many
    shingles, y its whole prefix. Shingles of one label alone, or that no text need show, are dropped after a grouping with partial sums. Where a
    label holds most of a shingle's texts, as in a large group joined already, its texts meet those of other labels,
    never one another. Places and parity bits are compared while rows meet, so that what cannot be similar makes no row;
    nor does a pair that shares one of the last EARLIER shingles before this one: it met there, or before. The first
    shingle that a pair shares has no such shingle before it.
    """
    rows = shared_shingles(write_table(prefix_rows(docs, similarity), "prefix-shingles"))
    texts = texts.withColumn("id", F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long"))
    rows = write_table(rows.join(texts.select("id", "node", "label"), "id"), "shared-shingles")
    share = similarity / (1 + similarity)
    early = F.col("place") <= F.col("n") - F.ceil(F.lit(2 * share) * F.col("n") - 1e-6)
    labels = rows.groupBy("token", "label").agg(F.count("*").alias("texts"), F.count_if(early).alias("early"))
    most = labels.groupBy("token").agg(F.max_by("label", F.struct("texts", "label")).alias("most"), F.count("*").alias("labels"), F.sum("early").alias("early"))
    rows = rows.drop("n").join(most.where("labels > 1 and early > 0").select("token", "most"), "token")
    rows = rows.join(texts.select("id", *_parity_columns("")), "id")
    own = Window.partitionBy("id").orderBy("place")  # one text's prefix
    rows = rows.withColumns({f"t{k}": F.lag("token", k).over(own) for k in range(1, EARLIER + 1)})
    rows = write_table(rows.drop("id"), "unlike-shingles")
    x = rows.where(early)
    x, y = (r.select("token", *(F.col(c).alias(c + end) for c in ("place", "n", "node", "label", "most", *(f"w{k}" for k in range(PARITY)), *(f"t{k}" for k in range(1, EARLIER + 1))))) for r, end in ((x, "_x"), (rows, "_y")))
    met_before = F.lit(False)
    for i in range(1, EARLIER + 1):
        for j in range(1, EARLIER + 1):
            met_before = met_before | F.coalesce(F.col(f"t{i}_x") == F.col(f"t{j}_y"), F.lit(False))
    fits = (
        (F.col("label_x") != F.col("label_y"))
        & (F.struct("n_x", "node_x") < F.struct("n_y", "node_y"))
        & _can_be_similar(similarity, "_x", "_y")
        & (F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")) >= F.lit(share) * (F.col("n_x") + F.col("n_y")) - 1e-6)
        & ~met_before
    )

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        joined = left.withColumnRenamed("token", "token_x").join(right, (F.col("token_x") == F.col("token")) & fits)
        return joined.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))

    return met(x.where("label_x <> most_x"), y).union(met(x.where("label_x = most_x"), y.where("label_y <> most_y"))).distinct()


def relabelled(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``texts`` with the labels that ``found`` (node, component) joins brought to one; written."""
    parts = found.select(F.col("node").alias("label"), F.col("component").alias("joined"))
    out = texts.join(parts, "label", "left").withColumn("label", F.coalesce("joined", "label"))
    return write_table(out.drop("joined"), "text-labels")


def near_copy_components(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, component) for every distinct non-null doc_id: groups by SimHash distance and by shingle similarity.

    ``docs`` is read several times and should be a written table. Null, empty and blank texts are copies of each other.
    Rows that share a doc_id are one document, with the links of all its texts. An empty table gives no rows.
    """
    # the default of 4096 whole documents in a reader's vectors is tens of megabytes of an executor's heap
    name = "spark.sql.parquet.columnarReaderBatchSize"
    docs.sparkSession.conf.set(name, min(int(docs.sparkSession.conf.get(name)), READ_ROWS))
    own = write_table(sketches(docs), "sketches")
    texts = own.groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"), F.any_value("n").alias("n"), F.any_value("parity").alias("parity"), F.any_value("wide").alias("wide"))
    texts = write_table(texts, "texts")
    pairs = write_table(band_pairs(texts, similarity), "band-pairs")
    found = connected_components(write_table(star_links(verified(docs, pairs, similarity)), "band-links"))
    named = relabelled(texts.select("digest", "node", "fp", "n", "parity", F.col("node").alias("label")), found)
    fps = write_table(named.groupBy("fp").agg(F.min("label").alias("node")), "text-fingerprints")
    same = named.join(fps.select("fp", F.col("node").alias("low")), "fp").where("label <> low").select(F.col("label").alias("a"), F.col("low").alias("b"))
    named = relabelled(named, connected_components(same.unionByName(near_links(fps, radius))))
    pairs = write_table(prefix_pairs(docs, named, similarity), "prefix-pairs")
    pairs = write_table(possible_pairs(pairs, texts, similarity), "possible-pairs")
    rest = write_table(verified(docs, pairs, similarity), "prefix-links")
    for end in ("a", "b"):
        label = named.select(F.col("node").alias(end), F.col("label").alias("to")).distinct()
        rest = rest.join(label, end).drop(end).withColumnRenamed("to", end)
    named = relabelled(named, connected_components(rest))
    out = own.join(named.select("digest", "label"), "digest").select("doc_id", F.col("label").alias("part"))
    # a doc_id whose rows have several texts joins their components
    shared = out.groupBy("doc_id").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    if shared.where("low <> high").isEmpty():
        return shared.select("doc_id", F.col("low").alias("component"))
    joined = connected_components(out.join(shared, "doc_id").select(F.col("part").alias("a"), F.col("low").alias("b")))
    return shared.join(joined, shared.low == joined.node, "left").select("doc_id", F.coalesce("component", "low").alias("component"))


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their group, one row for each; rows with a null doc_id stay."""
    groups = near_copy_components(docs, **options)
    keep = groups.groupBy("component").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    kept = docs.join(keep, ["doc_id"], "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
