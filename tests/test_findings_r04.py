"""Findings of round 4 on small tables that show them."""

import datetime
import os

from pyspark.sql import functions as F
from test_findings_r03 import same_as_sql

from tidemark.plans.shared import write_table


def test_scalars_of_times_next_to_a_bucket(spark, tmp_path):
    """SQL's milliseconds are the nearest, so half a millisecond before a bucket is in it; before 1970 buckets end at their name."""
    edges = [datetime.datetime(y, m, 1, 0, 15) for y, m in ((2024, 1), (1970, 1), (1969, 12), (1960, 5))]
    micros = (-900_000_000, -900_000, -1501, -1500, -1000, -501, -500, -499, -1, 0, 1, 499, 500, 501, 172_425)
    rows = [(i, e + datetime.timedelta(microseconds=u), 1, "view", 1.0, '{"k": 3}') for i, (e, u) in enumerate((e, u) for e in edges for u in micros)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    assert len(same_as_sql(spark, tmp_path, "f_scalars", events=events)) == len(rows)


def test_a_written_table_leaves_no_shuffle_files(spark):
    """what a write has shuffled goes when it ends, not when the driver collects its garbage."""
    folders = [f.getPath() for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before = files()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    out = write_table(df, "counts")
    assert not files() - before
    assert out.count() == df.count() == 7  # the frame itself may be used again
    assert len(df.collect()) == len(df.collect()) == 7
