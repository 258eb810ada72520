"""Alignment of two vocabularies against the definition, byte by byte."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import vocabulary_alignment as va

SPECIAL = ["x <|endoftext|> y", "<s>a</s>", "a <0x0A> b", "<unk>", "a\r\n b", "a\t b", "  two  spaces ", " ", "\n", "\n\n a\n", "word　 x", "▁ under", "été", "日本語 text", "🎉🎉", "aaaaaaa aaaa", "\x00\x01 z", "a ", "don't you'll", "\xa0 a", "한국어 ‍\n b"]


def by_definition(texts):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, sha256), with every A-B pair of tokens compared."""
    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    docs, counts = [], Counter()
    for text in texts:
        if not text:
            docs.append(None)
            continue
        a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
        a_bytes = [bytes(back[c] for c in a_tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            docs.append(None)
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, before = [], 0
        for cut in cuts:
            own = [",".join(str(i) for i, (s, _) in zip(ids, at, strict=True) if before <= s < cut) for ids, at in ((a, spans[0]), (b, spans[1]))]
            groups.append("|".join(own))
            before = cut
        docs.append((len(a), len(b), groups, links))
        counts.update(links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = d
            out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def random_texts(seed, n):
    r = random.Random(seed)
    parts = ["hello", "world", "Straße", "naïve", " ", "  ", "\n", "\n\n", "\t", "123", "4567", ",", ".", "...", "éa", "日本", "\xa0", "don't", "aaaa", "\r\n", "ing", "The", "🎉", "x_y", "//", "　"]
    return ["".join(r.choice(parts) + r.choice([" ", " ", " ", ""]) for _ in range(r.randrange(1, 40))) for _ in range(n)]


def rows_of(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r[0])]


def test_alignment_is_the_definition(spark, monkeypatch):
    texts = [None, "", *SPECIAL, *random_texts(1, 120), "hello world", "hello world"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, `groups.a` string").repartition(3)
    want = by_definition(texts)
    assert rows_of(va.align(docs)) == want
    # most pairs outside the broadcast: the join gives the same
    monkeypatch.setattr(va, "HEAD_PAIRS", 7)
    assert rows_of(va.align(docs)) == want


def test_alignment_with_few_chunks_kept(spark, monkeypatch):
    """What a task forgets it aligns again."""
    texts = random_texts(7, 60)
    v = va.vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    want = va.Chunks(v)
    uses = np.bincount(want.number([c for t in texts for c in v.chunks(t)]))
    monkeypatch.setattr(va, "CHARS_AT_ONCE", 50)
    got = va.Chunks(v)
    seen = np.zeros(0, np.int64)
    for _, chunks, _ in va._portions(iter([pa.RecordBatch.from_pydict({"text": texts})]), v, 0):
        numbers = got.number(chunks)
        n = np.repeat(np.bincount(numbers, minlength=len(got.spelt)), got.sizes[3])
        seen = np.concatenate([seen, np.repeat(got.codes, n)])
        got.clear()
    assert sorted(seen.tolist()) == sorted(np.repeat(want.codes, np.repeat(uses, want.sizes[3])).tolist())


def test_chunks_are_the_whole():
    v = va.vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert v.cuts
    store = va.Chunks(v)
    for text in [*SPECIAL, *random_texts(2, 500)]:
        full = " " + text
        (whole,), own = store.number([full]), store.number(v.chunks(text))
        (a, b, spelt), *_ = v._encoded([full])
        assert b.tolist() == v.b.encode(text) and a.tolist() == v.a.encode(full, add_special_tokens=False).ids and spelt == store.spelt[whole]
        assert store.spelt[whole] == store.spelt[own].all()
        if store.spelt[whole]:
            assert ";".join(store.groups[i] for i in own) == store.groups[whole]
            links = [sorted(store.codes[store.links_of(np.atleast_1d(x))[1]].tolist()) for x in (whole, own)]
            assert links[0] == links[1]


def test_alignment_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert va.align(empty).collect() == []
    odd = spark.createDataFrame([(None, "one two"), (None, "one two"), (5, "w " * 30_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in va.align(odd, with_groups=True).collect()}
    assert found[5]["n_groups"] == len(found[5]["groups"].split(";")) > 30_000
    assert found[None]["n_links"] == 2 and found[None]["n_best"] == 2 and found[None]["count_sum"] == 4
