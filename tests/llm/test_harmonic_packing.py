"""Packing of op1: encoded by the column, the same rows as one document at a time."""

from collections import Counter

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(texts, first=0):
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def test_documents_have_the_ids_of_the_library_either_way():
    from tests.llm.test_vocabulary_alignment import SPECIAL, random_texts

    library = Tokenizer.from_file(PATH)
    texts = [None, "", *SPECIAL, *random_texts(11, 150), "word " * 900, "<|endoftext|> x", "\x00 \x00.\n", None]
    want = [(i, b"".join(x.to_bytes(4, "little") for x in [*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in enumerate(texts)]
    for documents in (packing._by_column, packing._one_by_one):
        assert list(documents(rows_of(texts), PATH)) == want
        assert list(documents(rows_of([]), PATH)) == []


def test_chunks_of_all_documents_go_to_the_library_once(monkeypatch):
    """Also where rare words fill the caches: those that come again are not encoded again."""
    enc, learned = tokens.BatchEncoder(PATH), Counter()
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda new: (learned.update(new), learn(new)))
    monkeypatch.setattr(packing, "batch_encoder", lambda path: enc)
    enc.CHUNKS_KEPT = 200
    for k in range(20):
        assert len(list(packing._by_column(rows_of([f" common words rare{k}x{i} more rare{k}y{i}" for i in range(50)], 50 * k), PATH))) == 50
    assert sum(learned.values()) == len(learned) == 2003


def test_rows_are_the_same_either_way(spark):
    texts = [(i, " ".join(f"w{i}x{j} common" for j in range(i % 37 * i % 211))) for i in range(300)] + [(None, None), (None, "  a"), (7, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = [packing.pack(docs, capacity=256, with_ids=True, lean=lean).collect() for lean in (False, True)]
    assert rows[0] == rows[1] and len(rows[0]) > 303
