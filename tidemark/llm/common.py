"""What the operators of this subpackage share: the shared folder, lineage cuts, components, text helpers."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.shared import fresh_folder, shared_dir, write_table

__all__ = ["connected_components", "document_batches", "fresh_folder", "read_documents", "released", "shared_dir", "text_crc_mod", "tokenizer_path", "write_table"]

TOKENIZER_FILE = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """Where the public tokenizer package keeps a vocabulary file (the same place on each executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def document_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Hand texts to Python in batches of so many rows: the default of 10,000 whole documents is tens of megabytes a task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)


def released(worker):
    """``worker``, which hands memory that it no longer uses back to the system when it ends.

    Python workers live on after a task, and their allocators keep what they were given; a later stage, or the other
    worker of an executor, may need it.
    """

    @functools.wraps(worker)
    def run(batches):
        yield from worker(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # a C library without it
            return

    return run


def text_crc_mod(doc_id, modulus: int):
    """crc32 of the decimal doc_id, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Alternating large-star and small-star rounds: each node hands its neighbours the smallest node it knows,
    so the depth falls geometrically. Every round aggregates a minimum per node (with map-side combine) and joins
    it back (a node with very many neighbours is a skewed side that adaptive execution splits). Rounds are written
    with ``checkpoint()``. Edges with a null end and self loops add nothing.
    """
    shared_dir(edges.sparkSession)
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )

    def state(df):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    before = state(e)
    if not before[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, large.a == low.u)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = small.where("a <> b").distinct().checkpoint()
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ends.groupBy("node").agg(F.min("component").alias("component")).union(roots)
