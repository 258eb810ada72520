"""Token ids in Arrow stream files whose batches hold fixed-size lists.

Every sequence has ``seq_len`` ids and as many mask bits, so sequence i of a file lies in batch i // batch_rows at
row i % batch_rows, and a memory-mapped file hands out both without copying. Documents follow each other in the
token stream; only the last sequence of a file is filled up, with mask bits off. Beside a token file lies an index
file: doc_id, start (in this file) and n_tokens of each document.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import document_batches, fresh_folder, tokenizer_path, write_table
from tidemark.llm.tokens import END_ID, BatchEncoder, batch_encoder, byte_portions

SEQ_LEN, BATCH_ROWS = 1024, 512
MANIFEST = "part long, path string, index_path string, n_docs long, n_tokens long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def token_schema(width: int, seq_len: int) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(pa.uint16() if width == 2 else pa.uint32(), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


def _open(path: str):
    return pyarrow.fs.FileSystem.from_uri(path)


class _Writer:
    """Fills sequences with ids and writes a batch whenever ``batch_rows`` of them are full."""

    def __init__(self, sink, width: int, seq_len: int, batch_rows: int):
        self.schema, self.seq_len, self.room = token_schema(width, seq_len), seq_len, seq_len * batch_rows
        self.dtype = np.uint16 if width == 2 else np.uint32
        self.held, self.n, self.total = [], 0, 0
        self.out = pa.ipc.new_stream(sink, self.schema)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= self.room:
            flat = np.concatenate(self.held)
            whole = len(flat) - len(flat) % self.room
            for k in range(0, whole, self.room):
                self._write(flat[k : k + self.room], self.room)
            self.held, self.n = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        if self.n:
            ids = np.zeros(-(-self.n // self.seq_len) * self.seq_len, self.dtype)
            ids[: self.n] = np.concatenate(self.held)
            self._write(ids, self.n)
        self.out.close()


class Sequences:
    """Random access to one local token file: memory-mapped, no copy of ids or mask bits."""

    def __init__(self, path: str):
        self.source = pa.memory_map(path.removeprefix("file://"))
        self.batches = list(pa.ipc.open_stream(self.source))
        self.rows = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _slice(self, i: int, column: str) -> pa.Array:
        if not 0 <= i < len(self):
            raise IndexError(i)
        lists = self.batches[i // self.rows].column(column)
        k = lists.type.list_size
        return lists.values.slice((i % self.rows) * k, k)

    def tokens(self, i: int) -> np.ndarray:
        return self._slice(i, "tokens").to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.BooleanArray:
        return self._slice(i, "mask")


def write_part(batches: Iterable[pa.RecordBatch], sink, side, enc: BatchEncoder, seq_len: int = SEQ_LEN, batch_rows: int = BATCH_ROWS) -> tuple[int, int]:
    """Write doc_id and text of ``batches`` to a token file and its index; gives the numbers of documents and of ids.

    A portion of the text column is encoded at once, and its ids go to the file as they lie.
    """
    tokens, index = _Writer(sink, 2 if len(enc.sizes) <= 1 << 16 else 4, seq_len, batch_rows), pa.ipc.new_stream(side, INDEX)
    n_docs = 0
    for rows in batches:
        for portion in byte_portions(rows, 1):
            ids, ends = enc.encode_column(portion.column(1), END_ID)
            n = np.diff(ends, prepend=0)
            starts = tokens.total + ends - n
            tokens.add(ids.astype(tokens.dtype))
            index.write_batch(pa.RecordBatch.from_arrays([portion.column(0), pa.array(starts), pa.array(n)], schema=INDEX))
            n_docs += portion.num_rows
    tokens.close()
    index.close()
    return n_docs, tokens.total


def write_token_files(docs: DataFrame, folder: str, seq_len: int = SEQ_LEN, batch_rows: int = BATCH_ROWS, tokenizer: str | None = None) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the manifest, one row per file, written already.

    doc_id ranges go to tasks and are sorted there, so file k holds smaller ids than file k + 1. A task names its
    files by its attempt: what a lost attempt leaves is never listed. A null or empty text is the end id alone; a
    null doc_id sorts first; repeated ids keep their rows, in order of text. An empty table gives an empty manifest.
    """
    path = tokenizer or tokenizer_path()
    document_batches(docs.sparkSession)

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = next(batches, None)
        if first is None:
            return
        names = [f"{folder}/{kind}-{part:06d}-{uuid.uuid4().hex}.arrows" for kind in ("tokens", "index")]
        fs, at = _open(folder)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(_open(names[0])[1]) as sink, fs.open_output_stream(_open(names[1])[1]) as side:
            n_docs, n_tokens = write_part(itertools.chain([first], batches), sink, side, batch_encoder(path), seq_len, batch_rows)
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "path": names[:1], "index_path": names[1:], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return write_table(rows.mapInArrow(worker, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (over all files, in order), n_tokens and ids_crc32 of every document, from the files alone."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", "index_path", before.alias("base"))  # one row a file: small

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, index_path, base in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                fs, at = _open(path)
                with fs.open_input_stream(at) as source, fs.open_input_stream(_open(index_path)[1]) as side:
                    stream = (x for rb in pa.ipc.open_stream(source) for x in _ids(rb))
                    have = np.zeros(0, np.uint16)
                    for rows in pa.ipc.open_stream(side):
                        crcs = []
                        for n in rows.column(2).to_pylist():
                            crc = 0
                            while n:
                                if not len(have):
                                    have = next(stream)
                                crc = zlib.crc32(have[:n].astype("<u4").tobytes(), crc)
                                n, have = n - min(n, len(have)), have[n:]
                            crcs.append(crc)
                        start = pa.array(rows.column(1).to_numpy() + base)
                        yield pa.RecordBatch.from_arrays([rows.column(0), start, rows.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a number given: adaptive execution would put the few rows of the manifest, and so all files, in one task
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(worker, DOCS)


def _ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The ids of a batch whose mask bits are on: a view, since only the end of a file is masked."""
    ids = batch.column(0).values.to_numpy(zero_copy_only=True)
    n = batch.column(1).values.true_count
    if n:
        yield ids[:n]


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write, then read back, in a new folder under ``spark.checkpoint.dir``."""
    folder = fresh_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, **options))
