"""Harmonic packing of documents into fixed-size training sequences.

A document gives whole sequences first. What remains has a length of its own, and with it a reciprocal-capacity class:
class k holds lengths over capacity / (k + 1) and up to capacity / k, and a bin of class k takes k of them. A full bin
has a gap of less than its smallest piece; the next remainder that comes is cut there to close it, and goes on to its
own class with what is left. Each worker fills its own bins while it reads its documents: no shuffle, and no state
beyond one open bin a class and one bin that waits for its last piece. When a worker ends, what lies in the open bins
is laid together into whole sequences and one last stretch, cut where its length is a power of two, the lengths at
which sequences need no padding. So nothing is padded, and a remainder is cut about once for a bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import document_batches, tokenizer_path
from tidemark.llm.tokens import END_ID, batch_encoder, byte_portions, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of one worker: its partition number above this many bits.
LOCAL_BITS = 36


class Bins:
    """One worker's bins. ``put`` and ``close`` give (item, start, length, local sequence, offset).

    An item is whatever the caller knows a document by; ``start`` and ``length`` are counted in its ids. State is a
    remainder a place of the open bins: at most ``capacity`` ids for each class, and one gap.
    """

    def __init__(self, capacity: int):
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("capacity must be a power of two")
        self.capacity, self.next = capacity, 0
        #: class -> remainders (item, start, length) of its open bin
        self.open: dict[int, list] = {}
        #: the full bin that waits for its last piece
        self.short: list | None = None

    def _sequence(self, pieces):
        number, offset = self.next, 0
        self.next += 1
        for item, start, length in pieces:
            yield item, start, length, number, offset
            offset += length

    def put(self, item, n: int):
        start = 0
        while n - start >= self.capacity:
            yield from self._sequence([(item, start, self.capacity)])
            start += self.capacity
        if start < n:
            yield from self._remainder(item, start, n - start)

    def _remainder(self, item, start: int, length: int):
        if self.short is not None:
            gap = self.capacity - sum(p[2] for p in self.short)
            part = min(gap, length)
            self.short.append((item, start, part))
            if part == gap:
                full, self.short = self.short, None
                yield from self._sequence(full)
            start, length = start + part, length - part
            if not length:
                return
        k = self.capacity // length  # capacity / (k + 1) < length <= capacity / k
        held = self.open.setdefault(k, [])
        held.append((item, start, length))
        if len(held) == k:
            del self.open[k]
            if sum(p[2] for p in held) == self.capacity:
                yield from self._sequence(held)
            else:
                # a piece cut from what is left of the remainders closes the gap; two gaps never wait at once
                yield from self._close_short()
                self.short = held

    def _close_short(self):
        """Close the waiting bin, if any, from the open bins, longest remainders first."""
        while self.short is not None and self.open:
            k = min(self.open)
            item, start, length = self.open[k].pop()
            if not self.open[k]:
                del self.open[k]
            yield from self._remainder(item, start, length)

    def close(self):
        """Lay what is left together: whole sequences, then one for each binary digit of the rest's length."""
        rest = self.short or []
        for k in sorted(self.open):
            rest = rest + self.open[k]
        self.open, self.short = {}, None
        total, want = sum(p[2] for p in rest), self.capacity
        held, room = [], 0
        for item, start, length in rest:
            while length:
                if not room:
                    while want > total:
                        want //= 2
                    room = want
                part = min(room, length)
                held.append((item, start, part))
                start, length, room, total = start + part, length - part, room - part, total - part
                if not room:
                    yield from self._sequence(held)
                    held = []


def _by_column(rows: pa.RecordBatch, path: str) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and ids of each document, a portion of the text column encoded at once."""
    for portion in byte_portions(rows, 1):
        ids, ends = batch_encoder(path).encode_column(portion.column(1), END_ID)
        first = 0
        for doc_id, last in zip(portion.column(0).to_pylist(), ends.tolist(), strict=True):
            yield doc_id, ids[first:last].tobytes()  # a copy: what waits in a bin must not hold the portion
            first = last


def _one_by_one(rows: pa.RecordBatch, path: str) -> Iterator[tuple[int | None, bytes]]:
    """The same with less memory: one document after another."""
    yield from zip(rows.column(0).to_pylist(), map(encoder(path).encode_document, rows.column(1).to_pylist()), strict=True)


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, with_ids: bool = False, lean: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names. A null or empty text is the
    end id alone. A null doc_id is carried. Repeated rows and ids are packed as often as they come. An empty table
    gives no rows. A very long text becomes many pieces of the same worker. ``with_ids`` adds the ids of a piece as
    little-endian unsigned 32-bit bytes. A retried task reads the same rows, and so numbers its sequences alike.
    ``lean`` encodes one document after another, for executors whose memory other work has filled: the same rows, in
    about twice the time.
    """
    path = tokenizer or tokenizer_path()
    document_batches(docs.sparkSession)

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = _one_by_one if lean else _by_column
        bins = Bins(capacity)
        base = TaskContext.get().partitionId() << LOCAL_BITS
        out: list[tuple] = []

        def batch():
            cols = list(zip(*out, strict=True))
            out.clear()
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays, names = [*arrays, pa.array(cols[7], pa.binary())], [*names, "ids"]
            return pa.RecordBatch.from_arrays(arrays, names)

        def place(placed):
            for (doc_id, ids, n, before), start, length, number, offset in placed:
                own = ids[4 * start : 4 * (start + length)]
                out.append((doc_id, before + start, length, zlib.crc32(own), n, base + number, offset, *([own] if with_ids else [])))

        for b in batches:
            for doc_id, ids in documents(b, path):
                n = len(ids) // 4
                whole = n - n % capacity
                place(bins.put((doc_id, ids, n, 0), whole))
                # only the remainder waits in a bin
                place(bins.put((doc_id, ids[4 * whole :], n, whole), n - whole))
                if len(out) >= 20_000:
                    yield batch()
        place(bins.close())
        if out:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(worker, SCHEMA + (", ids binary" if with_ids else ""))
