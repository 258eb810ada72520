"""Document probability under a subword unigram model, summed over all segmentations.

The pieces are those of an existing sentencepiece vocabulary; their probabilities are the counts of that vocabulary's
own segmentation of the training words, with additive smoothing, beside one end-of-document symbol. A word's
probability is the sum over all ways to cut it into pieces, by forward recursion in log space; a character that is no
piece is its bytes. Every word is scored once, in the table of distinct words. The most frequent words of that table,
a bounded number, are carried to the documents; the rest of a document's words meet their scores in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_crc_mod, tokenizer_path, write_table

PIECES_FILE = "piece_bpe_32k.model"
SMOOTHING = 0.1
#: Words whose scores are carried to the documents, and bytes of one: a bound on the broadcast, not on what is scored.
HEAD_WORDS, HEAD_BYTES = 65_536, 64
#: Distinct words a counting task holds before it hands its counts on.
COUNTER_SIZE = 250_000
#: Rows of word uses handed on at once.
USES_SIZE = 100_000
LN10 = math.log(10)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode().lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, n): occurrences in training rows and in all rows of ``docs`` (train, text)."""

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {True: Counter(), False: Counter()}

        def batch():
            seen = counts[True].keys() | counts[False].keys()
            own = list(seen)
            train = np.array([counts[True].get(w, 0) for w in own], np.int64)
            both = train + np.array([counts[False].get(w, 0) for w in own], np.int64)
            counts[True].clear()
            counts[False].clear()
            return pa.RecordBatch.from_arrays([pa.array(own, pa.binary()).cast(pa.string()), pa.array(train), pa.array(both)], ["word", "c", "n"])

        for b in batches:
            for train, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[bool(train)].update(words(text))
                if len(counts[True]) + len(counts[False]) >= COUNTER_SIZE:
                    yield batch()
        if counts[True] or counts[False]:
            yield batch()

    rows = docs.select("train", "text").mapInArrow(worker, "word string, c long, n long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def count_pieces(vocab: DataFrame, model_file: str) -> DataFrame:
    """(piece, count) over the training words, each as often as it occurs; at most as many rows as the vocabulary."""

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        total = np.zeros(model.get_piece_size(), np.int64)
        for b in batches:
            c = b.column(1).to_numpy()
            ids = model.encode(b.column(0).to_pylist(), num_threads=1)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(lengths.sum()))
            np.add.at(total, flat, np.repeat(c, lengths))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "count"])

    return vocab.where("c > 0").select("word", "c").mapInArrow(worker, "piece long, count long").groupBy("piece").agg(F.sum("count").alias("count"))


class Lattice:
    """log10 probability of a word over all its segmentations."""

    def __init__(self, model_file: str, counts: dict[int, int], ends: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        total = sum(counts.get(i, 0) for i in ids) + ends + SMOOTHING * (len(ids) + 1)
        score = {i: math.log((counts.get(i, 0) + SMOOTHING) / total) for i in ids}
        self.end = math.log((ends + SMOOTHING) / total) / LN10
        self.pieces = {model.id_to_piece(i): score[i] for i in ids if not model.is_byte(i)}
        self.bytes = [0.0] * 256
        for i in ids:
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = score[i]
        self.longest = max(map(len, self.pieces), default=1)

    def word(self, word: str) -> float:
        text = "▁" + word
        n, pieces, longest = len(text), self.pieces, self.longest
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        for j in range(1, n + 1):
            terms = []
            for i in range(max(0, j - longest), j):
                s = pieces.get(text[i:j])
                if s is not None and alpha[i] > -math.inf:
                    terms.append(alpha[i] + s)
            if text[j - 1] not in pieces:
                terms.append(alpha[j - 1] + sum(self.bytes[b] for b in text[j - 1].encode()))
            if terms:
                top = max(terms)
                alpha[j] = top if len(terms) == 1 else top + math.log(sum([math.exp(t - top) for t in terms]))
        return alpha[n] / LN10


def score_words(vocab: DataFrame, lattice: Lattice) -> DataFrame:
    """``vocab`` and the log10 probability of each word."""
    sent = vocab.sparkSession.sparkContext.broadcast(lattice)  # as large as the piece vocabulary

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([model.word(w) for w in b.column(0).to_pylist()], pa.float64())], ["word", "c", "n", "lattice"])

    return vocab.select("word", "c", "n").mapInArrow(worker, "word string, c long, n long, lattice double")


USES = "doc_id long, h long, word string, k long, train boolean, known long, base double, lattice double"


def _split_scores(docs: DataFrame, head: dict[bytes, tuple[int, float]]) -> DataFrame:
    """Per row one row of sums over head words (word null) and one for each other distinct word with its count."""
    sent = docs.sparkSession.sparkContext.broadcast(head)  # HEAD_WORDS entries of HEAD_BYTES at most

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: (c, math.log10(c + SMOOTHING), s) for w, (c, s) in sent.value.items()}
        out: list[tuple] = []

        def batch():
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64()]
            arrays = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            arrays[2] = arrays[2].cast(pa.string())
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "h", "word", "k", "train", "known", "base", "lattice"])

        for b in batches:
            for doc_id, h, train, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                n = have = 0
                base = lattice = 0.0
                for w, k in Counter(words(text)).items():
                    n += k
                    hit = known.get(w)
                    if hit is None:
                        out.append((doc_id, h, w, k, None, None, None, None))
                    else:
                        have += k if hit[0] else 0
                        base += k * hit[1]
                        lattice += k * hit[2]
                out.append((doc_id, h, None, n, train, have, base, lattice))
                if len(out) >= USES_SIZE:
                    yield batch()
        if out:
            yield batch()

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "train", "text").mapInArrow(worker, USES)


def likelihood(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text).

    Rows whose crc32(doc_id) mod 10 is 0 are held out; the others train. A null doc_id counts as held out. Null and
    empty texts are the end token alone. Whole texts are scored, very long ones too; ties and repeated rows are scored
    row by row (a repeated row trains as often as it stands there). Without training rows every count is 0 and scores
    come from smoothing alone. An empty table gives no rows. Other columns are ignored.
    """
    model_file = model_file or tokenizer_path(PIECES_FILE)
    fold = F.coalesce(text_crc_mod(F.col("doc_id"), 10), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold != 0).alias("train"))
    vocab = write_table(count_words(rows), "words")
    ends = rows.where("train").count()
    total, distinct = vocab.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    train_tokens, distinct = (total or 0) + ends, distinct + (ends > 0)
    counts = {r["piece"]: r["count"] for r in count_pieces(vocab, model_file).collect()}  # bounded by the vocabulary file
    lattice = Lattice(model_file, counts, ends)
    scored = write_table(score_words(vocab, lattice), "word-scores")
    head = scored.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(HEAD_WORDS).collect()
    head = {r["word"].encode(): (r["c"], r["lattice"]) for r in head}

    # rows that share a doc_id but not the text are scored apart; equal rows give equal sums, as often as they stand
    split = write_table(_split_scores(rows, head), "word-uses")
    tail = split.where("word is not null").select("doc_id", "h", "word", "k")
    tail = tail.join(scored.select("word", "c", F.col("lattice").alias("s")), "word")
    tail = tail.select(
        "doc_id",
        "h",
        F.lit(None).cast("boolean").alias("train"),
        F.lit(None).cast("long").alias("n"),
        F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("known"),
        (F.col("k") * F.log10(F.col("c") + F.lit(SMOOTHING))).alias("base"),
        (F.col("k") * F.col("s")).alias("lattice"),
    )
    own = split.where("word is null").select("doc_id", "h", "train", F.col("k").alias("n"), "known", "base", "lattice")
    sums = own.unionByName(tail).groupBy("doc_id", "h")
    sums = sums.agg(F.max("train").alias("train"), F.count("n").alias("times"), F.max("n").alias("n"), *(F.sum(c).alias(c) for c in ("known", "base", "lattice")))
    floor = math.log10(train_tokens + SMOOTHING * (distinct + 1))
    n, once = F.col("n") + 1, F.lit(1) / F.col("times")
    out = sums.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        n.alias("n_tokens"),
        (F.col("known") / F.col("times") + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") * once + F.lit(math.log10(ends + SMOOTHING)) - n * F.lit(floor)).alias("base_score"),
        (F.col("lattice") * once + F.lit(lattice.end)).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"),
    )
    return out.drop("copy")
