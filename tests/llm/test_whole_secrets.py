"""Secrets in runs that hold an equals sign, a separator, a fixed pattern or letters alone."""

import random

from tidemark.llm import secret_scan


def test_secrets_inside_runs(spark):
    rng = random.Random(3)
    key = lambda k, n=40: "".join(rng.choices(secret_scan.ENCODINGS[k], k=n))
    grouped = lambda h: "-".join(h[i : i + 8] for i in range(0, len(h), 8))
    letters = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=40))
    keys = [key("alnum") for _ in range(8)]
    held = [f"private_key={keys[0]}", f"sig={keys[1]}", f"sessionid={keys[2]}==", f"SECRET_KEY={keys[3]}", f"a=1=b={keys[4]}", f"/v1/files/{keys[5]}", f"long-name-of-the-thing-{keys[6]}", f"secret={'0' * 8}.{keys[7]}"]
    dashed, after = grouped(key("hex", 64)), key("alnum")
    rows = [(i, f"text {t} end") for i, t in enumerate(held)] + [(20, letters), (21, f"x {dashed} y"), (22, f"{'0123456789abcdef' * 2}={after}"), (23, "NAME=some-ordinary-words-and-more-of-the-same-words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert not [k for i, k in enumerate(keys) if k in out[i]]
    assert letters not in out[20] and dashed not in out[21] and after not in out[22] and "ordinary-words" in out[23]
    for r in secret_scan.find_secrets(df).collect():
        spans = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("random")]
        assert len(spans) == r.n_random and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert r.n_random or r.doc_id in (7, 23)
