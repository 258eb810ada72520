"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import read_documents


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack

    return pack(read_documents(spark, sf_dir))


def op2_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import near_components

    return near_components(read_documents(spark, sf_dir))


def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.multi_index import near_vectors

    return near_vectors(read_documents(spark, sf_dir, "embeddings"))


def op4_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.langid import split_identify

    return split_identify(read_documents(spark, sf_dir))


def op5_arrow_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.arrow_files import token_files

    return token_files(read_documents(spark, sf_dir))


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quotes import reply_threads

    return reply_threads(read_documents(spark, sf_dir, "conversations"))


def op7_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secret_scan import find_secrets

    return find_secrets(read_documents(spark, sf_dir))


def op8_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lattice import likelihood

    return likelihood(read_documents(spark, sf_dir))


def op9_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.text_density import extract

    return extract(read_documents(spark, sf_dir, "pages"))


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.tiling import contaminated

    return contaminated(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, with the repeats planted by doc_id, one row a document."""
    from tidemark.llm.periodic_runs import periodic_runs

    return periodic_runs(read_documents(spark, sf_dir), plant=True)


def op12_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 2048 tokens as the configurations give, one row a piece."""
    from tidemark.llm.configuration_packing import pack

    return pack(read_documents(spark, sf_dir))


def op13_vocabulary_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and link counts of the byte-level vocabulary against the pieces, one row a document."""
    from tidemark.llm.vocabulary_alignment import align

    return align(read_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from tidemark.llm.quotes import ORACLE_SQL

    return {"op6_quotation_linking": ORACLE_SQL}
