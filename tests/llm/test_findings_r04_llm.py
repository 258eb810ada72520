"""Finding F1 of round 4: long texts that share a line cost no moved text, and no similar pair is lost by it."""

import itertools
import random

import numpy as np
from test_whole_near_copies import DOCS, brute

from tidemark.llm import near_copies


def texts(rng, n, words):
    """n texts of so many words, which all share two lines, and for each third an edited copy, near the edge of similarity."""
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    lines, rows = [[word() for _ in range(30)] for _ in range(2)], []
    for k in range(n):
        w = [*(word() for _ in range(words // 2)), *lines[0], *(word() for _ in range(words // 2)), *lines[1]]
        rows.append((len(rows), " ".join(w)))
        if k % 3 == 0:
            for at in rng.sample(range(len(w)), len(w) // rng.choice((35, 45, 55))):
                w[at] = word()
            rows.append((len(rows), " ".join(w)))
    return rows


def test_long_texts_with_a_common_line_are_not_moved(spark, monkeypatch):
    rows, moved, plain = texts(random.Random(3), 30, 1500), [], near_copies.verified
    monkeypatch.setattr(near_copies, "FREQUENT", 0)  # as in a corpus of so many lines that none is frequent
    monkeypatch.setattr(near_copies, "band_pairs", lambda texts, _: texts.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(near_copies, "verified", lambda docs, pairs, similarity: moved.append(pairs.count()) or plain(docs, pairs, similarity))
    got = {r.doc_id: r.component for r in near_copies.near_copy_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute(rows)
    assert 0 < len(rows) - len(set(got.values())) <= 10
    assert moved[0] == 0 and moved[1] <= 10


def test_wide_parity_loses_no_similar_pair(spark):
    """Sets around the edge of similarity, of sizes whose bits differ in number or are none."""
    rng, sets = np.random.default_rng(5), []
    for n in (760, 768, 769, 900, 1400, 1470, 2900, 2930, 6000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for kept in (n, int(0.95 * n), int(0.89 * n), int(0.86 * n), int(0.8 * n), int(0.5 * n)):
            for more in (0, n - kept, int(0.05 * n)):
                sets.append(np.unique(np.concatenate([base[:kept], rng.integers(0, 1 << 63, more, dtype=np.uint64)])))
    rows = [(k, len(h), near_copies.wide_parity(h)) for k, h in enumerate(sets)]
    frame = spark.createDataFrame(rows, "node long, n int, wide array<long>")
    pairs = list(itertools.combinations(range(len(sets)), 2))
    got = {(r.a, r.b) for r in near_copies.possible_pairs(spark.createDataFrame(pairs, "a long, b long"), frame, 0.8).collect()}
    plain = [frozenset(h.tolist()) for h in sets]
    near = {(a, b) for a, b in pairs if near_copies.similar(plain[a], plain[b], 0.8)}
    assert near and near <= got
    wide = {p for p in got if rows[p[0]][2] and rows[p[1]][2]}
    assert len(wide) < 2 * len(near) and all(len(plain[a] & plain[b]) > 0.5 * len(plain[a]) for a, b in wide)
