"""Five operators in a row over ``documents``: language ID, near-dedup, decontamination, secret scan, packing.

Every stage works on all its predecessor kept and returns the columns of ``documents``, but the last, which returns
the packed pieces. A stage that reads two tables or several times reads the written result of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, near_copies, packing, tiling
from tidemark.llm import secret_scan as secrets
from tidemark.llm.common import read_documents, write_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected; fill in a missing lang.

    Null and empty texts and texts without a letter are rejected. Ties go to the language with more labelled rows;
    repeated rows get equal results; very long texts are read whole; an empty table gives no rows. Other columns pass.
    """
    found = langid.identify(docs, langid.learn(docs), column="__language")
    kept = found.where("not __language.rejected").withColumn("lang", F.coalesce("lang", "__language.lang_pred"))
    return kept.select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: linked by SimHash within three bits, or sharing five-word shingles to 0.8.

    The smallest doc_id of a group stays, in one row. Null, empty and blank texts are copies of each other; rows with a
    null doc_id stay; very long texts are compared whole; an empty table gives no rows. Other columns pass.
    """
    return near_copies.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item.

    Null and empty texts contain none and stay; repeated rows get equal results; very long texts are searched whole;
    with an empty benchmark all rows stay; an empty table gives no rows. Other columns pass.
    """
    return tiling.decontaminate(docs, read_documents(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write a mark in place of each secret; every document stays.

    Null texts stay null and empty ones empty; overlapping secrets become one mark; n_chars is that of the new text;
    very long texts are searched whole; an empty table gives no rows. Other columns pass.
    """
    return secrets.redact(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents, one row each.

    A null or empty text is the end id alone; a null doc_id is carried; repeated rows are packed as often as they come;
    very long texts become many pieces; an empty table gives no rows.
    """
    return packing.pack(docs, lean=True)  # after the other stages an executor has little memory left


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack_sequences),
]

#: No stage is a SQL expression: zstandard sizes, BK-trees, string tiling, randomness tests and BPE ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = write_table(docs, name)
    return docs
