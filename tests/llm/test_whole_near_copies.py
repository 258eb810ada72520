"""All near copies of the pipeline's second stage, against brute force."""

import itertools
import random

import numpy as np
import pytest

from tidemark.llm import near_copies
from tidemark.llm.simhash import fingerprint

DOCS = "doc_id long, text string"


def brute(rows):
    sets, values = {i: near_copies.shingles(t) for i, t in rows}, {i: fingerprint(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if (values[a] ^ values[b]).bit_count() <= near_copies.RADIUS or near_copies.similar(sets[a], sets[b], near_copies.SIMILARITY):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


def components(spark, rows):
    return {r.doc_id: r.component for r in near_copies.near_copy_components(spark.createDataFrame(rows, DOCS)).collect()}


def test_short_texts_with_one_edit(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = []
    for n in range(10, 81):
        base = [word() for _ in range(n)]
        changed = list(base)
        changed[rng.randrange(n)] = word()
        for w in (base, [*base, word()], changed, base[1:]):
            rows.append((len(rows), " ".join(w)))
    expected = brute(rows)
    assert components(spark, rows) == expected
    assert len(set(expected.values())) < len(rows) - 130


@pytest.mark.parametrize("seed", [256, 8])
@pytest.mark.parametrize("bands", [True, False])
def test_near_copies_far_apart_among_frequent_passages(spark, monkeypatch, seed, bands):
    """All passages are frequent: the copies of a pair are many texts apart in every group of a passage.

    Without bands the prefix filter alone finds them all.
    """
    if not bands:
        monkeypatch.setattr(near_copies, "band_pairs", lambda texts, _: texts.sparkSession.createDataFrame([], "a long, b long"))
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    lines = [[word() for _ in range(30)] for _ in range(12)]
    rows = []
    for _ in range(200):
        w = [x for line in rng.sample(lines, 4) for x in line]
        changed = list(w)
        changed[rng.randrange(len(w))] = word()
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(changed))]
    assert components(spark, rows) == brute(rows)


@pytest.mark.parametrize("words", [20, 30, 60, 100])
def test_pairs_at_the_edge_of_similarity(spark, words):
    """Texts with a few words replaced, many of them just above or just below 0.8."""
    rng = random.Random(words)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(words)]
        for edits in (0, 1, 2):
            w = list(base)
            for at in rng.sample(range(words), max(edits, edits * words // 60)):
                w[at] = word()
            rows.append((len(rows), " ".join(w)))
    assert components(spark, rows) == brute(rows)


def test_a_large_group_makes_few_links(spark):
    """Edited copies of one text: candidates and links stay a small multiple of the texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base, rows = [word() for _ in range(150)], []
    for k in range(1200):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(4)):
            w[at] = word()
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, DOCS)
    texts = near_copies.sketches(docs).withColumnRenamed("doc_id", "node")
    pairs = near_copies.band_pairs(texts, 0.8).cache()
    assert pairs.count() <= near_copies.BANDS * len(rows)
    assert near_copies.star_links(near_copies.verified(docs, pairs, 0.8)).count() <= 2 * len(rows)
    assert components(spark, rows) == brute(rows)


def test_frequent_shingles_stand_last():
    h, frequent = np.arange(10, dtype=np.uint64), np.array([0, 1, 3], np.uint64)
    assert near_copies.prefix(h, 0.8, frequent, np.array([5, 2, 9]))[0].tolist() == [2, 4, 5]
    assert near_copies.prefix(h[:4], 0.1, frequent, np.array([5, 2, 9]))[0].tolist() == [2, 1, 0, 3]
