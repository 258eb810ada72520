"""Maximal periodic runs of words in whole texts, by a dictionary of basic factors.

The dictionary names every stretch of 2^k words: stretches of one text have the same name if and only if they are
equal, and the names of level k + 1 are those of pairs of names of level k. A stretch of 2^k words that occurs again
after q words, 2^k <= q < 2^(k + 1), proposes the period q. All its occurrences that begin in those 2^k places form one
arithmetic progression if there are three or more, and a run whose period lies among the progression is also met at
the progression's first or last term from one of the run's own places, so two terms a place are proposed. A proposal
is extended to both sides by descending the dictionary; equal stretches keep their smallest period.

Stretches that occur once in their text are unnamed, so that higher levels hold only what repeats. Texts are worked on
many at a time in one array, each with names of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import document_batches

MIN_LENGTH = 12
#: Words laid in one array; a longer text is an array of its own.
WORDS_AT_ONCE = 200_000
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class BasicFactors:
    """Names of all stretches of 2^k words of some texts; -1 where a stretch is unlike all others of its text."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        """``words`` are numbers, equal only for equal words of one text; ``ends[i]`` is where the text of i ends."""
        self.ends = ends
        #: level -> (name of each place, places in order of name and place, their keys name * step + place)
        self.levels: list[np.ndarray] = []
        self.sorted: list[tuple[np.ndarray, np.ndarray]] = []
        self.step = 4 * len(words) + 4
        places = np.arange(len(words))
        self._name(places, words)
        while len(self.sorted[-1][0]):
            below, half = self.levels[-1], 1 << len(self.levels) - 1
            places = self.sorted[-1][0]
            places = places[places + 2 * half <= ends[places]]
            right = below[places + half]
            places, right = places[right >= 0], right[right >= 0]
            self._name(places, below[places] * (int(right.max(initial=0)) + 1) + right)

    def _name(self, places: np.ndarray, keys: np.ndarray) -> None:
        order = np.lexsort((places, keys))
        places, keys = places[order], keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        alone = new & np.append(new[1:], True)
        names = np.cumsum(new & ~alone) - 1
        places, names = places[~alone], names[~alone]
        level = np.full(len(self.ends), -1, np.int64)
        level[places] = names
        self.levels.append(level)
        self.sorted.append((places, names * self.step + places))

    def proposals(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and periods: the first and last occurrence that begins 2^k to 2^(k + 1) - 1 words on."""
        places, keys = self.sorted[k]
        length = 1 << k
        first, last = np.searchsorted(keys, keys + length), np.searchsorted(keys, keys + 2 * length) - 1
        some = first <= last
        at, first, last = places[some], first[some], last[some]
        more = first < last
        at = np.concatenate([at, at[more]])
        return at, np.concatenate([places[first], places[last[more]]]) - at

    def _agree(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """Whether equal stretches of 2^k words begin at a and b."""
        inside = (a >= 0) & (b < len(self.ends))
        level = self.levels[k]
        name = level[np.where(inside, a, 0)]
        return inside & (name >= 0) & (name == level[np.where(inside, b, 0)])

    def extend(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the stretch around ``at`` in which words ``period`` apart are equal."""
        right, left = at.copy(), at.copy()
        for k in reversed(range(len(self.levels))):
            # a level is taken as often as it fits: once, but for the highest
            while True:
                ok = self._agree(right, right + period, k)
                right[ok] += 1 << k
                if k < len(self.levels) - 1 or not ok.any():
                    break
            while True:
                ok = self._agree(left - (1 << k), left - (1 << k) + period, k)
                left[ok] -= 1 << k
                if k < len(self.levels) - 1 or not ok.any():
                    break
        return left, right + period


def find_runs(words: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every maximal run of at least ``min_length`` words and two periods."""
    factors = BasicFactors(words, ends)
    found = [np.zeros((3, 0), np.int64)]
    for k in range(len(factors.levels)):
        at, period = factors.proposals(k)
        if not len(at):
            continue
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        # neighbours that propose one period lie in one stretch: the first stands for them
        head = np.ones(len(at), bool)
        head[1:] = (period[1:] != period[:-1]) | (at[1:] > at[:-1] + 1)
        at, period = at[head], period[head]
        start, end = factors.extend(at, period)
        long = end - start >= np.maximum(min_length, 2 * period)
        found.append(np.stack([start[long], end[long], period[long]]))
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of which one document in ten repeats a stretch to its end; where and how often the doc_id says."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def periodic_runs(docs: DataFrame, plant: bool = False, min_length: int = MIN_LENGTH, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its runs, the longest of them, and what is left without repeats.

    A run is a stretch of words whose words ``period`` apart are equal, for the smallest such period, of at least
    ``min_length`` words and two periods, that cannot be made longer. Of equally long runs the one that starts first
    counts, then the one of smaller period; without a run start, length, period and exponent_milli are null. A word is
    dropped from the text left if a run holds it after that run's first period. Null, empty and blank texts have no
    words; repeated rows get equal results; a null doc_id is carried; an empty table gives no rows; other columns are
    ignored, whatever their names. A text's words are held by one task, about 16 bytes a word for each level that it
    repeats on. ``plant`` repeats stretches by doc_id first (``planted``; none for a null doc_id); ``with_text`` adds the
    text left.
    """
    document_batches(docs.sparkSession)

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}

        def results(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], np.int64)
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            known.clear()
            flat = [known.setdefault(w, len(known)) for t in texts for w in t]
            owner = np.repeat(np.arange(len(texts)), lengths)
            names = np.array(flat, np.int64) + owner * (len(known) + 1)
            start, end, period = find_runs(names, bounds[1:][owner], min_length)
            dropped = np.zeros(len(flat) + 1, np.int64)
            np.add.at(dropped, start + period, 1)
            np.add.at(dropped, end, -1)
            kept = np.cumsum(dropped)[:-1] == 0
            of = np.searchsorted(start, bounds)
            rows = []
            for i, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
                own = slice(of[i], of[i + 1])
                runs = list(zip((start[own] - bounds[i]).tolist(), (end[own] - start[own]).tolist(), period[own].tolist(), strict=True))
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                left = text if not runs else [w for w, k in zip(text, kept[bounds[i] : bounds[i + 1]].tolist(), strict=True) if k]
                left = b" ".join(left)
                listed = "".join([f"{s},{n},{q}\n" for s, n, q in runs])
                exponent = 1000 * best[1] // best[2] if runs else None
                rows.append((doc_id, len(runs), *best, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest(), *([left.decode()] if with_text else [])))
            kinds = [pa.int64()] * 6 + [pa.string()] * (3 if with_text else 2)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], fields)

        ids, texts, held = [], [], 0
        for rows in batches:
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                words = (text or "").encode().split()
                words = planted(words, doc_id) if plant else words
                if ids and held + len(words) > WORDS_AT_ONCE:
                    yield results(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                held += len(words)
        if ids:
            yield results(ids, texts)

    schema = SCHEMA + (", text string" if with_text else "")
    fields = [f.split()[0] for f in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(worker, schema)
