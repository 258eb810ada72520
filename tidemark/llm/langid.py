"""Language identification by compression.

Each language has a zstandard raw-content dictionary cut from a bounded sample of labelled texts. A text is
compressed with every dictionary, in blocks, and the language whose dictionary makes it smallest is the answer. A
text is rejected where the two smallest sizes are closer than a margin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import document_batches, text_crc_mod

UNDETERMINED = "und"
#: The sample a dictionary is cut from: so many labelled rows of a language, a slice of so many characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 320, 1024
#: Bytes of a dictionary; all dictionaries together stay under ALL_BYTES, however many languages there are.
DICT_BYTES, ALL_BYTES = 256 * 1024, 16 * 1024 * 1024
BLOCK, LEVEL = 2048, 3
#: A text is rejected if the second smallest size is not larger than the smallest by this share.
MARGIN = 0.001
#: Margins at which the score is about 0.73.
SCALE = 0.02

_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def plain(text: str) -> bytes:
    """Lower case, each run of ASCII characters that are no letters as one space: only the language is left."""
    return b" ".join(text.lower().encode().translate(_ASCII_LETTERS).split()) + b" "


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionary content per language, from rows with a language and a letter.

    The counts cover all rows. The sample is what has the smallest hashes of its text: the hash bound passes about
    twice ``sample_rows`` rows of each language to the driver, never more than four times (the rest is cut off there).
    A long text gives a slice from a place that another hash chooses, so that any part of it may be learnt from.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null and text rlike '\\\\p{L}'")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    hashed = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1) / float(1 << 63))
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(2.0 * sample_rows / n))])
    places = F.greatest(F.char_length("text") - sample_chars, F.lit(0)) + 1
    piece = F.substr("text", (F.pmod(F.xxhash64(F.lit("place"), "text"), places) + 1).cast("int"), F.lit(sample_chars))
    picked = hashed.where(F.col("h") < share[F.col("lang")]).select("lang", "h", piece.alias("text"))
    picked = picked.dropDuplicates(["lang", "text"]).orderBy("h").limit(4 * sample_rows * len(counts)).collect()
    room = min(DICT_BYTES, ALL_BYTES // len(counts))
    out: dict[str, bytes] = {}
    for lang in sorted(counts, key=lambda k: (-counts[k], k)):  # the order decides ties
        texts = [plain(r["text"]) for r in picked if r["lang"] == lang][:sample_rows]
        out[lang] = b"".join(texts)[-room:] or lang.encode() * 8
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], block: int = BLOCK, level: int = LEVEL):
        self.languages, self.block = list(dictionaries), block
        self.compressors = []
        for lang in self.languages:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text by each dictionary, block after block."""
        data = plain(text)
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.compressors])

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score from 0 to 1, margin); ties go to the language with more training rows."""
        if not text or not _LETTER.search(text) or not self.languages:
            return UNDETERMINED, 0.0, 0.0
        sizes = self.sizes(text)
        order = np.argsort(sizes, kind="stable")
        margin = float(sizes[order[1]] - sizes[order[0]]) / float(sizes[order[0]]) if len(order) > 1 else 1.0
        return self.languages[order[0]], float(1 / (1 + np.exp(-margin / SCALE))), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, column: str = "found") -> DataFrame:
    """All columns of ``docs`` and a struct ``column``: lang_pred, score, margin, rejected.

    Reads only text. Null and empty texts and texts without a letter are ``und``, score 0, rejected. With no
    dictionary every text is ``und``. Repeated rows get equal results; an empty table gives no rows.
    """
    fields = "lang_pred string, score double, margin double, rejected boolean"
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most ALL_BYTES

    @F.pandas_udf(fields)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Classifier(sent.value)
        for texts in batches:
            rows = [model.predict(t) for t in texts]
            yield pd.DataFrame({"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "margin": [r[2] for r in rows], "rejected": [r[0] == UNDETERMINED or r[2] < margin for r in rows]}, columns=["lang_pred", "score", "margin", "rejected"])

    document_batches(docs.sparkSession)
    return docs.withColumn(column, found.asNondeterministic()(F.col("text").cast("string")))  # so that a filter on it does not run it twice


def split_identify(docs: DataFrame) -> DataFrame:
    """Learn on documents whose crc32(doc_id) mod 4 is not 2, predict all: doc_id, held_out, lang_pred, score, rejected."""
    fold = F.coalesce(text_crc_mod(F.col("doc_id"), 4), F.lit(2))  # a null doc_id is held out
    rows = docs.select("doc_id", "text", "lang", (fold == 2).alias("held_out"))
    out = identify(rows.select("doc_id", "text", "held_out"), learn(rows.where("not held_out")))
    return out.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.margin", "found.rejected")
