"""Secrets in texts: fixed patterns, and strings that pass a battery of randomness tests.

Candidates of the battery are runs of the characters that keys and tokens are written in, long enough to test, what a
fixed pattern holds cut out of them: the undivided run, and its parts between equals signs and other separators. The
encoding is inferred from the characters used (hex, base32, letters and digits, base64). Three tests ask whether the
run could be uniform random in that encoding: chi-squared over the alphabet, runs above and below the middle, and
serial correlation; a run that fails any is no secret. A run that passes must also be unlike language, in which
pairs of characters are equal at a fixed rate (``LANGUAGE_REPEAT``) and classes of characters seldom change. The
probability that language repeats as little and changes as often is its p-value, so a long run needs no more evidence
than a short one has to give; the p-values
of all candidates of the corpus, from a table of counts by length and magnitude, go through Benjamini-Hochberg within
each class of length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import document_batches, write_table

# Fixed patterns of the contract: kind, expression, group, least characters of the group.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: The battery's candidates, and the parts of them that are candidates too; equals signs at the end are padding.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PARTS = tuple(re.compile(x) for x in (r"[^=]+(?:=+\Z)?", r"[^=_-]+(?:=+\Z)?", r"[^=+/]+(?:=+\Z)?", r"[A-Za-z0-9]+(?:=+\Z)?"))
RUN_LEAST = 20
_HEX24 = re.compile(r"[0-9a-f]{24,}")
#: Significance of a randomness test; false-discovery rate among the strings reported.
ALPHA, FDR = 0.001, 0.001
#: Upper bounds of the classes of length, and steps of -log10 p in the table of counts.
LENGTH_CLASSES = (24, 32, 40, 64, 128, 1 << 60)
STEP, STEPS = 0.25, 400
ENCODINGS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
_ORDER = ("hex", "hex_upper", "base32", "lower", "upper", "alnum", "base64")
_TABLES = {k: {c: i for i, c in enumerate(v)} for k, v in ENCODINGS.items()}
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
#: Chance that two characters of running text, letters and digits apart, are equal; about the same in the languages
#: written in Latin letters.
LANGUAGE_REPEAT = 0.065


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: leftmost matches of each pattern, those too short dropped."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a run of 24 or more is what is left of the leftmost runs when shorter ones are dropped
    out += [("hex", *m.span()) for m in _HEX24.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _normal_tail(z: float) -> float:
    """P(Z >= z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """P(X >= x) for chi-squared, by Wilson and Hilferty's cube-root normal."""
    c = 2 / (9 * df)
    return _normal_tail(((x / df) ** (1 / 3) - (1 - c)) / math.sqrt(c)) if x > 0 else 1.0


def infer_encoding(run: str) -> str | None:
    own = set(run.rstrip("="))
    return next((k for k in _ORDER if own <= _SETS[k]), None)


def battery(run: str) -> tuple[float, float, float, float] | None:
    """(p of uniformity, of runs, of serial correlation, p of so few repeats in language), None if nothing fits."""
    body = run.rstrip("=")
    if infer_encoding(plain := re.sub("[-_]", "", body)) in ("hex", "hex_upper"):
        body = plain  # dashes between groups of hex digits are no part of the key
    encoding = infer_encoding(body)
    n = len(body)
    if encoding is None or n < RUN_LEAST:
        return None
    table, k = _TABLES[encoding], len(ENCODINGS[encoding])
    x = np.array([table[c] for c in body], dtype=np.float64)
    counts = np.bincount(x.astype(int), minlength=k)
    uniform = _chi_tail(float(((counts - n / k) ** 2).sum() / (n / k)), k - 1)
    above = x >= k / 2
    n1, n0 = int(above.sum()), int(n - above.sum())
    if not n1 or not n0:
        return uniform, 0.0, 0.0, 1.0
    runs = 1 + int((above[1:] != above[:-1]).sum())
    mean = 1 + 2 * n1 * n0 / n
    spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    p_runs = 2 * _normal_tail(abs(runs - mean) / spread)
    centred = x - (k - 1) / 2
    serial = float((centred[1:] * centred[:-1]).sum()) / (((k * k - 1) / 12) * math.sqrt(n - 1))
    p_serial = 2 * _normal_tail(abs(serial))
    # equal pairs: in language each pair is equal with LANGUAGE_REPEAT; normal with the variance of overlapping pairs
    pairs = n * (n - 1) / 2
    equal = float((counts * (counts - 1)).sum() / 2)
    sd = math.sqrt(pairs * LANGUAGE_REPEAT * (1 - LANGUAGE_REPEAT) + 2 * (n - 2) * pairs * 0.25 * LANGUAGE_REPEAT**2)
    # character classes: language changes between letters, digits and cases at word ends only
    kind = np.array([0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in body])
    changes = int((kind[1:] != kind[:-1]).sum())
    rate = 0.12 * (n - 1)
    p_changes = _normal_tail((changes - rate) / math.sqrt(rate * 0.88)) if changes > rate else 1.0
    p_repeat = _normal_tail((pairs * LANGUAGE_REPEAT - equal) / sd)
    # two unlike views of the same run, taken together by Fisher's method (4 degrees of freedom)
    s = -2 * (math.log(max(p_repeat, 1e-300)) + math.log(max(p_changes, 1e-300)))
    return uniform, p_runs, p_serial, math.exp(-s / 2) * (1 + s / 2)


def length_class(n: int) -> int:
    return next(i for i, most in enumerate(LENGTH_CLASSES) if n <= most)


def readings(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs less the base spans, undivided and in parts, each once."""
    for m in CANDIDATE.finditer(text):
        at, pieces = m.start(), []
        for _, s, e in taken:
            if s < m.end() and at < e:
                pieces.append((at, s))
                at = e
        for a, b in [*pieces, (at, m.end())]:
            if b - a >= RUN_LEAST:
                parts = {(a + p.start(), a + p.end()) for x in PARTS for p in x.finditer(text[a:b])}
                yield from sorted({(a, b)} | {(s, e) for s, e in parts if e - s >= RUN_LEAST})


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, class of length, step of -log10 p) of the readings that pass the randomness tests."""
    out = []
    for a, b in readings(text, taken):
        p = battery(text[a:b])
        if p is None or min(p[:3]) < ALPHA:
            continue
        out.append((a, b, length_class(b - a), min(STEPS, int(-math.log10(max(p[3], 1e-300)) / STEP))))
    return out


def thresholds(counts: list[tuple[int, int, int]], rate: float = FDR) -> dict[int, int]:
    """Least step that Benjamini-Hochberg accepts in each class of length, from (class, step, count) rows."""
    out: dict[int, int] = {}
    for c in {c for c, _, _ in counts}:
        own = sorted(((s, n) for k, s, n in counts if k == c), reverse=True)
        m, rank = sum(n for _, n in own), 0
        for step, n in own:
            rank += n
            if 10 ** (-step * STEP) <= rate * rank / m:
                out[c] = step
    return out


SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base string, starts array<long>, ends array<long>, classes array<int>, steps array<int>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the base spans and the battery's candidates."""

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                rows.append((base, candidates(text or "", base)))
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0)]
                + [pa.array([sum(k == kind for k, _, _ in base) for base, _ in rows], pa.int64()) for kind in KINDS[:3]]
                + [pa.array([joined(base) for base, _ in rows], pa.string())]
                + [pa.array([[c[i] for c in found] for _, found in rows], ints if i < 2 else pa.list_(pa.int32())) for i in range(4)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base", "starts", "ends", "classes", "steps"],
            )

    document_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(worker, SCAN)


def accepted(scanned: DataFrame, rate: float = FDR) -> dict[int, int]:
    """The thresholds over all candidates of ``scanned``; the counts are at most classes times steps."""
    each = scanned.select(F.explode(F.arrays_zip("classes", "steps")).alias("x")).groupBy("x.classes", "x.steps").count()
    return thresholds([(r["classes"], r["steps"], r["count"]) for r in each.collect()], rate)


def _all_spans(least: dict[int, int]):
    """Column: base spans and accepted candidates, those that overlap as one, joined in order."""
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    limit = F.create_map(*[x for c in range(len(LENGTH_CLASSES)) for x in (F.lit(c), F.lit(least.get(c, STEPS + 1)))])
    found = F.transform(
        F.filter(F.arrays_zip("starts", "ends", "classes", "steps"), lambda x: x["steps"] >= limit[x["classes"]]),
        lambda x: F.struct(x["starts"].alias("a"), F.lit(KINDS.index("random")).alias("k"), x["ends"].alias("b")),
    )
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    found = F.aggregate(
        F.array_sort(found),
        F.filter(found, lambda x: F.lit(False)),
        lambda acc, x: F.when(
            last(acc)["b"] > x["a"],
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["a"].alias("a"), x["k"].alias("k"), F.greatest(last(acc)["b"], x["b"]).alias("b")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    base = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("a"), order[F.split(s, ":")[0]].alias("k"), F.split(s, ":")[2].cast("long").alias("b")),
    )
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.concat(base, found)), lambda s: F.concat_ws(":", names[s["k"]], s["a"], s["b"])), ",")


def find_secrets(docs: DataFrame, rate: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random for each row of ``docs`` (doc_id, text).

    Null and empty texts have no spans. Spans of one kind do not overlap; spans that start together are ordered by
    kind. Very long texts are searched whole; repeated rows give repeated results; an empty table gives no rows.
    Other columns are ignored.
    """
    scanned = write_table(scan(docs), "secret-scan")
    spans = _all_spans(accepted(scanned, rate))
    n_random = F.regexp_count(F.col("spans"), F.lit("random:"))
    out = scanned.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))
    return out.withColumn("n_random", n_random.cast("long"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rate: float = FDR) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``, and n_chars, where there is one, set anew.

    The thresholds come from all of ``docs``. Overlapping spans become one mark. Null texts stay null.
    """
    least = accepted(write_table(scan(docs), "secret-scan"), rate)
    sent = docs.sparkSession.sparkContext.broadcast(least)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else redact_text(t, sent.value, mark) for t in texts], dtype=object)

    out = docs.withColumn("text", clean.asNondeterministic()(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def redact_text(text: str, least: dict[int, int], mark: str) -> str:
    base = base_spans(text)
    spans = sorted([(a, b) for _, a, b in base] + [(a, b) for a, b, c, s in candidates(text, base) if s >= least.get(c, STEPS + 1)])
    out, at = [], 0
    for a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])
