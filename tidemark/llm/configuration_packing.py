"""Packing documents into as few sequences as possible by a configuration linear program.

Only the histogram of lengths decides: a configuration is a multiset of lengths that fits a sequence, and the program
asks for the fewest configurations that hold every length as often as it occurs. It is solved by multiplicative
weights: each length has a price, a knapsack over the capacity finds the dearest configurations, those are bought, and
what they hold becomes cheaper. Prices over the dearest configuration are also a lower bound for any packing. The
fractional answer is rounded down on what is really there; what is left is filled sequence by sequence, the longest
piece first, then the set of other pieces whose sum comes closest to the room left.

The histogram has as many rows as the capacity, whatever the corpus, so it is solved on the driver; the answer, a few
rows for each configuration bought, is carried to the documents. A piece finds its place by its length and its number
among pieces of that length: tasks number their own pieces, and a scan over the tasks' counts gives each a start.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import document_batches, tokenizer_path, write_table
from tidemark.llm.tokens import END_ID, batch_encoder, byte_portions

CAPACITY = 2048
#: Phases of the program: how much cheaper a length gets for each time its whole stock is bought, and rounds at most.
PHASES = ((0.3, 60), (0.1, 100), (0.03, 200))
#: Bits of a piece's number below its length in a key.
RANK_BITS = 44

Configuration = tuple[tuple[int, int], ...]  # (length, copies), longest first


class Packing(NamedTuple):
    """Configurations with the number of sequences of each, and a lower bound for any packing of the histogram."""

    sequences: list[tuple[Configuration, int]]
    bound: int


def _knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room the dearest value that fits it, and the length taken last (0: the room is a place too large)."""
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        values = best[room - 1 :: -1] + prices[1 : room + 1]
        k = int(values.argmax())
        if values[k] > best[room - 1]:
            best[room], taken[room] = values[k], k + 1
        else:
            best[room] = best[room - 1]
    return best, taken


def _filled(room: int, taken: np.ndarray, first: int) -> Configuration:
    """``first`` and the dearest filling of the room left."""
    copies = {first: 1}
    while room > 0:
        length = int(taken[room])
        if length:
            copies[length] = copies.get(length, 0) + 1
            room -= length
        else:
            room -= 1
    return tuple(sorted(copies.items(), reverse=True))


def multiplicative_weights(stock: Mapping[int, int], capacity: int, phases: tuple[tuple[float, int], ...] = PHASES) -> tuple[dict[Configuration, float], float]:
    """A fractional cover of ``stock`` by configurations, as large as the stock, and a lower bound for any cover.

    A round prices by one knapsack and buys, for each length, the dearest configuration that holds it, if that is still
    within the phase's step of the dearest of all. A phase starts with the prices of the one before and nothing bought;
    it ends when the least covered length shows the answer within its step of the bound, or after its rounds.
    """
    lengths = sorted(stock)
    total = sum(length * n for length, n in stock.items())
    price = {length: length / capacity for length in lengths}
    bound, bought = total / capacity, {}
    for step, rounds in phases:
        covered = dict.fromkeys(lengths, 0.0)
        bought = {}
        for _ in range(rounds):
            dense = np.full(capacity + 1, -math.inf)
            dense[lengths] = [price[length] for length in lengths]
            best, taken = _knapsack(dense, capacity)
            dearest = best[capacity]
            bound = max(bound, sum(n * price[length] for length, n in stock.items()) / dearest)
            for length in sorted(lengths, key=covered.__getitem__):
                if price[length] + best[capacity - length] < (1 - step) * dearest:
                    continue
                chosen = _filled(capacity - length, taken, length)
                if sum(price[x] * k for x, k in chosen) < (1 - step) * dearest:
                    continue
                amount = min(stock[x] / k for x, k in chosen)
                bought[chosen] = bought.get(chosen, 0.0) + amount
                for x, k in chosen:
                    covered[x] += amount * k / stock[x]
                    price[x] *= math.exp(-step * amount * k / stock[x])
            least = min(covered.values())
            if least > 0 and sum(bought.values()) / least <= (1 + step) * bound:
                break
            top = max(price.values())
            price = {x: max(p / top, 1e-200) for x, p in price.items()}
    held = sum(amount * sum(x * k for x, k in chosen) for chosen, amount in bought.items())
    return {chosen: amount * total / held for chosen, amount in bought.items()}, bound


def _closest(first: int, left: dict[int, int], capacity: int) -> Configuration:
    """``first`` and the pieces in stock whose sum comes closest to the room left, long ones preferred."""
    room, reach, steps = capacity - first, 1, []
    full = (1 << room + 1) - 1
    for length in sorted(left, reverse=True):
        if length > room:
            continue
        for _ in range(min(left[length] - (length == first), room // length)):
            grown = (reach | reach << length) & full
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
        if reach >> room & 1:
            break
    at, copies = reach.bit_length() - 1, {first: 1}
    for length, before in reversed(steps):
        if not before >> at & 1:
            copies[length] = copies.get(length, 0) + 1
            at -= length
    return tuple(sorted(copies.items(), reverse=True))


def pack_histogram(counts: Mapping[int, int], capacity: int = CAPACITY) -> Packing:
    """Sequences for ``counts`` pieces of each length (1 to ``capacity``): every piece in exactly one."""
    left = {length: n for length, n in counts.items() if n}
    if any(not 1 <= length <= capacity for length in left):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    total = sum(length * n for length, n in left.items())
    out: list[tuple[Configuration, int]] = []

    def take(chosen: Configuration, most: int) -> int:
        n = min([most, *(left.get(x, 0) // k for x, k in chosen)])
        if n:
            out.append((chosen, n))
            for x, k in chosen:
                left[x] -= n * k
                if not left[x]:
                    del left[x]
        return n

    whole = left.get(capacity, 0)
    take(((capacity, 1),), whole)
    bound = 0.0
    if left:
        amounts, bound = multiplicative_weights(left, capacity)
        order = sorted(amounts, key=lambda c: (-amounts[c], c))
        missed = {c: amounts[c] - take(c, int(amounts[c])) for c in order}
        for chosen in sorted(order, key=lambda c: (-missed[c], c)):
            if sum(x * k for x, k in chosen) == capacity:
                take(chosen, math.ceil(missed[chosen]))
        while left:
            take(_closest(max(left), left, capacity), max(left.values()))
    return Packing(out, max(-(-total // capacity), whole + math.ceil(bound - 1e-6)))


def _places(packing: Packing, capacity: int) -> np.ndarray:
    """Columns: key (length and first number), copies in a sequence, first sequence, offset; in order of key."""
    rows, used, sequence = [], {}, 0
    for chosen, n in packing.sequences:
        offset = 0
        for length, copies in chosen:
            first = used.get(length, 0)
            rows.append((length << RANK_BITS | first, copies, sequence, offset))
            used[length] = first + n * copies
            offset += length * copies
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4).T


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _pieces(docs: DataFrame, capacity: int, path: str, with_ids: bool) -> DataFrame:
    """The pieces of each document, numbered among those of one length and task."""

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(path).encode_column
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names)

        for rows in batches:
            for portion in byte_portions(rows, 1):
                ids, ends = encode(portion.column(1), END_ID)
                first = 0
                for doc_id, last in zip(portion.column(0).to_pylist(), ends.tolist(), strict=True):
                    n = last - first
                    start, length = 0, n % capacity or capacity  # a shorter piece comes first
                    for piece in range(-(-n // capacity)):
                        own = ids[first + start : first + start + length]
                        out.append((doc_id, piece, start, length, zlib.crc32(own), part, seen[length], *([own.tobytes()] if with_ids else [])))
                        seen[length] += 1
                        start, length = start + length, capacity
                    first = last
                yield batch()

    schema = PIECES + (", ids binary" if with_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(worker, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Documents longer than ``capacity`` are cut: whole pieces, and before them what is over; others stay whole. A null
    or empty text is the end id alone; a null doc_id is carried; repeated rows are packed as often as they come; a very
    long text becomes many pieces; an empty table gives no rows; other columns are ignored, whatever their names.
    Pieces of one length are alike to the packing, and go to sequences by task and order in it. ``with_ids`` adds the
    ids of a piece as little-endian unsigned 32-bit bytes.
    """
    path = tokenizer or tokenizer_path()
    document_batches(docs.sparkSession)
    pieces = write_table(_pieces(docs, capacity, path, with_ids), "pieces")
    held = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = write_table(held.select("length", "part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "piece-counts")
    histogram = {r.length: r.n for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    sent = docs.sparkSession.sparkContext.broadcast(_places(pack_histogram(histogram, capacity), capacity))  # rows by configuration

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, copies, sequence, offset = sent.value
        for rows in batches:
            length = rows.column("length").to_numpy()
            rank = rows.column("before").to_numpy() + rows.column("nth").to_numpy()
            own = length << RANK_BITS | rank
            at = np.searchsorted(key, own, "right") - 1
            turn = own - key[at]
            placed = [pa.array(sequence[at] + turn // copies[at]), pa.array(offset[at] + turn % copies[at] * length)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *placed], [*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + ("ids binary, " if with_ids else "") + "sequence_id long, offset long"
    return pieces.join(starts.drop("n"), ["length", "part"]).mapInArrow(worker, schema)
