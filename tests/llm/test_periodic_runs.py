"""Runs against the definition: every period of every text, word by word."""

import hashlib
import random
import zlib

import numpy as np

from tidemark.llm.periodic_runs import find_runs, periodic_runs


def runs_by_definition(words, least=12):
    """{(start, end): smallest period}, by walking every period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return found


def rows_by_definition(docs):
    out = []
    for doc_id, text in docs:
        words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in (text or "")).split(" ") if w]
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = sorted((s, e - s, q) for (s, e), q in runs_by_definition(words).items())
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        left = " ".join(w for i, w in enumerate(words) if i not in dropped)
        out.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    return out


def random_words(r):
    """Few symbols, squares of words over two letters, periods inside periods."""
    kind = r.randrange(4)
    if kind == 0:
        return [r.choice("ab") for _ in range(r.randrange(80))]
    if kind == 1:
        return [r.choice("abcdef") for _ in range(r.randrange(150))]
    out = []
    for _ in range(r.randrange(1, 5)):
        unit = [r.choice("ab" if kind == 2 else "abcdefgh") for _ in range(r.randrange(1, 24))]
        out += (unit * r.randrange(1, 6))[: r.randrange(1, 70)] + [r.choice("ab")] * r.randrange(3)
    return out


def test_runs_are_the_definition():
    r = random.Random(3)
    for least in (12, 2):
        texts = [random_words(r) for _ in range(1500)]
        known, flat, ends, owner = {}, [], [], []
        for i, t in enumerate(texts):
            flat += [known.setdefault((i, w), len(known)) for w in t]
            ends += [len(flat)] * len(t)
            owner += [i] * len(t)
        start, end, period = find_runs(np.array(flat, np.int64), np.array(ends, np.int64), least)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = [{} for _ in texts]
        for s, e, q in zip(start.tolist(), end.tolist(), period.tolist(), strict=True):
            i = owner[s]
            got[i][s - int(bounds[i]), e - int(bounds[i])] = q
        for t, found in zip(texts, got, strict=True):
            assert found == runs_by_definition(t, least), t


def test_query_is_the_definition(spark):
    r = random.Random(5)
    texts = [None, "", " \n\t ", "a b " * 30, "x y z " * 5, "é\x0bé\x0c" * 9, *(" ".join(random_words(r)) for _ in range(150)), *(" ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(300))) for _ in range(100))]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, `start.x` int").repartition(4)
    got = sorted(tuple(x) for x in periodic_runs(df, plant=True).collect())
    assert got == rows_by_definition(docs)
    assert sum(x[1] > 0 for x in got) > 50


def test_odd_tables(spark):
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = " ".join(f"w{i * i % 1009}" for i in range(120_000))
    df = spark.createDataFrame([(None, "a b " * 8), (None, "a b " * 8), (4, long)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in periodic_runs(df, with_text=True).collect()}
    assert got[None]["n_runs"] == 1 and got[None]["text"] == "a b" and got[None]["exponent_milli"] == 8000
    assert (got[4]["start"], got[4]["length"], got[4]["period"]) == (0, 120_000, 1009)
    assert len(got[4]["text"].split()) == 1009


def test_collapsed_text_has_the_first_period_of_each_run(spark):
    df = spark.createDataFrame([(1, "start " + "p q r " * 6 + "end end")], "doc_id long, text string")
    assert periodic_runs(df, with_text=True).first()["text"] == "start p q r end end"
