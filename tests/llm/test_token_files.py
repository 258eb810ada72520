"""Token files of op5: encoded by the column, the same ids and index as one document at a time."""

import io
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import arrow_files, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(texts, first=0):
    ids = pa.array([None if not first and not i else first + i for i in range(len(texts))], pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], ["doc_id", "text"])


def written(batches, enc, **options):
    sink, side = io.BytesIO(), io.BytesIO()
    counts = arrow_files.write_part(batches, sink, side, enc, **options)
    ids = [x for b in pa.ipc.open_stream(sink.getvalue()) for x in arrow_files._ids(b)]
    return counts, np.concatenate([np.zeros(0, np.uint16), *ids]), pa.ipc.open_stream(side.getvalue()).read_all()


@pytest.mark.parametrize("portion", [1, 60, 4_000_000])
def test_a_part_holds_the_ids_of_the_library_wherever_portions_end(portion, monkeypatch):
    from tests.llm.test_vocabulary_alignment import SPECIAL, random_texts

    monkeypatch.setattr(arrow_files, "byte_portions", lambda rows, text: tokens.byte_portions(rows, text, portion))
    library = Tokenizer.from_file(PATH)
    texts = [None, "", *SPECIAL, *random_texts(7, 150), "word " * 900, None, "<|endoftext|> x", "\x00 \x00.\n"]
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    batches = [rows_of(texts[:40]), rows_of([], 40), rows_of([*texts[40:], "beyond the slice"], 40).slice(0, len(texts) - 40)]
    counts, ids, index = written(batches, tokens.batch_encoder(PATH), seq_len=16, batch_rows=4)
    assert counts == (len(texts), sum(map(len, want)))
    assert ids.dtype == np.uint16 and ids.tolist() == [i for own in want for i in own]
    assert index.column("doc_id").to_pylist() == [None, *range(1, len(texts))]
    assert index.column("n_tokens").to_pylist() == [len(own) for own in want]
    assert index.column("start").to_pylist() == (np.cumsum([0, *map(len, want)])[:-1]).tolist()
    assert written([], tokens.batch_encoder(PATH))[0] == (0, 0)


def test_a_part_gives_each_chunk_to_the_library_once(monkeypatch):
    """Also where rare words fill the caches: those that come again are not encoded again."""
    enc, learned, calls = tokens.BatchEncoder(PATH), Counter(), []
    learn, column = enc._learn, enc.encode_column
    monkeypatch.setattr(enc, "_learn", lambda new: (learned.update(new), learn(new)))
    monkeypatch.setattr(enc, "encode_column", lambda texts, end: (calls.append(len(texts)), column(texts, end))[1])
    enc.CHUNKS_KEPT = 200
    batches = [rows_of([f" common words rare{k}x{i} more rare{k}y{i}" for i in range(50)], 1 + 50 * k) for k in range(20)]
    (n_docs, n_tokens), ids, _ = written(batches, enc)
    assert n_docs == 1000 and n_tokens == len(ids)
    assert calls == [50] * 20
    assert sum(learned.values()) == len(learned) == 2003
