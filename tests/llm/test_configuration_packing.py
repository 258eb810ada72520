"""Packing by configurations: every piece once, no gap, close to the bound; tiny cases against all packings."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm import configuration_packing as cp


def held(packing, capacity):
    """Pieces of each length that the sequences hold."""
    out = Counter()
    for chosen, n in packing.sequences:
        assert n > 0 and sum(x * k for x, k in chosen) <= capacity
        for x, k in chosen:
            out[x] += k * n
    return out


def fewest(pieces, capacity):
    """The fewest sequences, by trying every place for every piece."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= pieces[i]}:
            k = rooms.index(room)
            place(i + 1, [*rooms[:k], room - pieces[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - pieces[i]])

    pieces = sorted(pieces, reverse=True)
    place(0, [])
    return best


def test_tiny_histograms_against_all_packings():
    r = random.Random(2)
    same = 0
    for _ in range(60):
        pieces = [r.randrange(1, 33) for _ in range(r.randrange(1, 9))]
        packing = cp.pack_histogram(Counter(pieces), 32)
        assert held(packing, 32) == Counter(pieces)
        got, want = sum(n for _, n in packing.sequences), fewest(pieces, 32)
        assert packing.bound <= want <= got <= want + 1
        same += got == want
    assert same >= 57


def test_large_histograms_come_close_to_the_bound():
    r = np.random.default_rng(4)
    lengths = np.exp(r.normal(6.2, 1.0, 60_000)).astype(int) + 1
    lengths = np.where(lengths > 2048, lengths % 2048 + 1, lengths)
    hot = np.concatenate([lengths, np.full(30_000, 700)])  # a third of all pieces are of one length
    for pieces in (lengths, hot, np.full(999, 1000), np.full(10, 2048), r.integers(1025, 2049, 3000)):
        counts = Counter(pieces.tolist())
        packing = cp.pack_histogram(counts)
        assert held(packing, 2048) == counts
        n = sum(k for _, k in packing.sequences)
        assert packing.bound <= n
        if len(pieces) >= 60_000:
            assert n <= (1.01 if pieces is hot else 1.0005) * packing.bound + 1
    assert n == len(pieces)  # no two pieces over half a sequence meet
    assert cp.pack_histogram({}).sequences == []


def test_prices_prove_a_bound_and_the_stock_is_covered():
    stock = {700: 3000, 650: 2000, 40: 500, 1300: 900}
    amounts, bound = cp.multiplicative_weights(stock, 2048)
    cover = Counter()
    for chosen, amount in amounts.items():
        for x, k in chosen:
            cover[x] += k * amount
    assert all(cover[x] >= 0.5 * n for x, n in stock.items())
    assert bound <= sum(amounts.values()) / min(cover[x] / n for x, n in stock.items())


def check_pieces(rows, docs, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in docs]
    sequences = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for (doc_id, _), own in zip(docs, ids, strict=True):
        cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
        for piece, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id].append((piece, s, e - s, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own[s:e]))))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    return len(sequences), sum(map(len, ids))


def test_documents_are_packed_whole(spark):
    r = random.Random(6)
    docs = [(i, " ".join(r.choice(["alpha", "beta,", "gämma", "12"]) for _ in range(r.randrange(400)))) for i in range(150)]
    docs += [(200, None), (201, ""), (None, "no id"), (7, docs[7][1]), (202, "w " * 900), (203, "<|endoftext|> x")]
    docs += [(i, "the same text " * 20) for i in range(300, 400)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, `part.x` int").repartition(5)
    n, total = check_pieces(cp.pack(df, capacity=256, with_ids=True).collect(), docs, 256)
    assert n <= total / 256 * 1.01 + 2
    assert cp.pack(df.limit(0)).collect() == []


def test_ids_of_many_texts_are_those_of_the_library():
    from tests.llm.test_vocabulary_alignment import SPECIAL, random_texts
    from tidemark.llm.tokens import BatchEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, many = Tokenizer.from_file(path), BatchEncoder(path)
    texts = [None, "", *SPECIAL, *random_texts(9, 800), "Mr. x, y.z w., ½, a.\n", "..", " .", ". ", "<|endoftext|>"]
    for kept in (500_000, 5):
        many.CHUNKS_KEPT = kept
        for k in range(0, len(texts), 60):
            for t, ids in zip(texts[k : k + 60], many.encode(texts[k : k + 60]), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == (tokenizer.encode(t, add_special_tokens=False).ids if t else []), t


def test_columns_are_encoded_as_by_the_library_with_few_chunks_at_a_time():
    from tests.llm.test_vocabulary_alignment import SPECIAL, random_texts
    from tidemark.llm.tokens import BatchEncoder, byte_portions

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, many = Tokenizer.from_file(path), BatchEncoder(path)
    stops = [a + b + c for a in "aZéß×÷жҁ҂1²日" for b in ".," for c in (" x", "\ny", "", "  z")]
    texts = [None, *SPECIAL, *random_texts(3, 300), *stops, None, "", "<|endoftext|>", "\x00 \x00.\n"]
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    for many.CHUNKS_KEPT, many.TOGETHER, kind, size in ((400_000, 1_000_000, pa.string(), 4_000_000), (5, 3, pa.large_string(), 100)):
        rows = pa.RecordBatch.from_arrays([pa.array(["before", *texts], kind)], ["text"]).slice(1)
        got = []
        for own in byte_portions(rows, 0, size):
            ids, ends = many.encode_column(own.column(0), 0)
            assert ends[-1] == len(ids)
            got += [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == want


def test_chunks_that_come_again_are_not_encoded_again(monkeypatch):
    """A word of every portion goes to the library once, however many rare ones make the caches turn over."""
    from tidemark.llm.tokens import BatchEncoder

    many, learned = BatchEncoder(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    learn = many._learn
    monkeypatch.setattr(many, "_learn", lambda new: (learned.update(new), learn(new)))
    many.CHUNKS_KEPT = 20
    for k in range(30):
        many.encode([" common words " + " ".join(f"rare{chr(97 + k % 26)}{k}x{i}" for i in range(15))])
        assert len(many.kept) <= 50
    assert learned[" common"] == learned[" words"] == 1
    assert sum(learned.values()) == len(learned)
