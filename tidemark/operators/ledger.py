"""Checks of decision logs and hash-chained ledgers, as tables of violations. Lines are checked where they lie."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.joins import orphans

RECORD = "seq long, type string, ts_ms long, decision_ts_ms long, exec_ts_ms long, action string, fill double, pos struct<side: int, size: double>, entry_hash string"
LEDGER = "record_id string, kind string, ts_ms long, decision_id string, fill_ids array<string>, strategy string, pnl double, previous_hash string, record_hash string"


def parse_log(lines: DataFrame, schema: str = RECORD) -> DataFrame:
    """seq, line and the fields of each JSON line; a line that is no JSON has null fields and ``bad`` set."""
    parsed = lines.withColumn("r", F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__c"}))
    names = [f.split(" ")[0] for f in schema.replace("struct<side: int, size: double>", "x").split(", ") if f.split(" ")[0] not in lines.columns]
    return parsed.select("seq", "line", *(F.col(f"r.{n}").alias(n) for n in names), F.try_parse_json("line").isNull().alias("bad"))


def log_violations(records: DataFrame) -> DataFrame:
    """(seq, code): broken rules of fields, time order, actions, fills and positions."""
    # neighbours by a join on the sequence number instead of one window over the log
    before = records.select((F.col("seq") + 1).alias("seq"), F.col("ts_ms").alias("__t"), F.col("pos.side").alias("__side"))
    rows = records.where("type = 'record'").join(before, "seq", "left")
    rules = {
        "BAD_JSON": F.col("bad"),
        "MISSING_TIME": F.col("ts_ms").isNull(),
        "TIME_NOT_INCREASING": F.col("ts_ms") <= F.col("__t"),
        "UNKNOWN_ACTION": ~F.col("action").isin("ENTER", "EXIT", "HOLD"),
        "EXECUTED_BEFORE_DECISION": F.col("exec_ts_ms") <= F.col("decision_ts_ms"),
        "FILL_WITHOUT_ACTION": F.col("fill").isNotNull() & (F.col("action") == "HOLD"),
        "ACTION_WITHOUT_FILL": F.col("fill").isNull() & F.col("action").isin("ENTER", "EXIT"),
        "ENTER_WHILE_OPEN": (F.col("action") == "ENTER") & (F.col("__side") != 0),
        "EXIT_WHILE_FLAT": (F.col("action") == "EXIT") & (F.col("__side") == 0),
    }
    found = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    out = rows.select("seq", F.explode(found).alias("code"))
    bad = records.where("bad").select("seq", F.lit("BAD_JSON").alias("code"))
    return out.where("code <> 'BAD_JSON'").unionByName(bad)


@F.pandas_udf(T.StringType())
def canonical_sha256(lines: pd.Series) -> pd.Series:
    """SHA-256 of a JSON object without its ``entry_hash``, keys in order and no white space; null if it is no object."""
    out = []
    for line in lines:
        try:
            record = json.loads(line)
            record.pop("entry_hash", None)
            out.append(hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":")).encode()).hexdigest())
        except (ValueError, TypeError, AttributeError):
            out.append(None)
    return pd.Series(out, dtype=object)


def hash_violations(records: DataFrame) -> DataFrame:
    """Records whose stored hash is not that of their canonical JSON."""
    return records.where("type = 'record'").withColumn("computed", canonical_sha256("line")).where(~F.col("computed").eqNullSafe(F.col("entry_hash"))).select("seq", "entry_hash", "computed")


def chain_violations(lines: DataFrame) -> DataFrame:
    """(seq, code) of a ledger of canonical lines: a hash that is not of line and link, a link that is not to the record before."""
    rows = lines.select("seq", "line", F.get_json_object("line", "$.previous_hash").alias("previous_hash"), F.get_json_object("line", "$.record_hash").alias("record_hash"))
    body = F.regexp_replace("line", r',?"record_hash":"[0-9a-f]*"', "")
    computed = F.sha2(F.concat(F.coalesce("previous_hash", F.lit("")), body), 256)
    before = rows.select((F.col("seq") + 1).alias("seq"), F.col("record_hash").alias("__before"))
    out = rows.join(before, "seq", "left")
    rules = {"HASH": ~F.col("record_hash").eqNullSafe(computed), "LINK": (F.col("seq") > 0) & ~F.col("previous_hash").eqNullSafe(F.col("__before"))}
    return out.select("seq", F.explode(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())).alias("code"))


def completeness(records: DataFrame) -> DataFrame:
    """One row: headers, footers, records, what the footer says, and whether the log is whole."""
    stated = F.max(F.when(F.col("type") == "footer", F.get_json_object("line", "$.records").cast("long")))
    out = records.agg(F.count_if(F.col("type") == "header").alias("headers"), F.count_if(F.col("type") == "footer").alias("footers"), F.count_if(F.col("type") == "record").alias("records"), stated.alias("stated"))
    return out.withColumn("complete", (F.col("headers") == 1) & (F.col("footers") == 1) & F.col("records").eqNullSafe(F.col("stated")))


def foreign_key_violations(ledger: DataFrame) -> DataFrame:
    """(record_id, code): fills without a decision, trades that name a fill that is not there."""
    of = lambda k: ledger.where(F.col("kind") == k)
    fills = orphans(of("fill"), of("decision"), "decision_id", "record_id").select("record_id", F.lit("FILL_WITHOUT_DECISION").alias("code"))
    named = of("trade").select("record_id", F.explode_outer("fill_ids").alias("fill_id"))
    trades = orphans(named, of("fill").select(F.col("record_id").alias("fid")), "fill_id", "fid").select("record_id", F.lit("TRADE_WITHOUT_FILL").alias("code")).distinct()
    return fills.unionByName(trades)


def reconstruct(ledger: DataFrame) -> DataFrame:
    """Each decision with its fills in time order, its trades' profit, and whether fills come after it."""
    of = lambda k: ledger.where(F.col("kind") == k)
    fills = of("fill").groupBy("decision_id").agg(F.sort_array(F.collect_list(F.struct("ts_ms", "record_id"))).alias("fills"), F.min("ts_ms").alias("first_fill"))  # fills of one decision
    owner = of("fill").select(F.col("record_id").alias("fill_id"), F.col("decision_id").alias("did"))
    trades = of("trade").select("record_id", "pnl", F.explode("fill_ids").alias("fill_id")).join(owner, "fill_id")
    trades = trades.select("record_id", "pnl", "did").distinct().groupBy("did").agg(F.count("*").alias("n_trades"), F.sum("pnl").alias("trade_pnl"))
    d = of("decision").select(F.col("record_id").alias("id"), "ts_ms", "strategy")
    out = d.join(fills, d["id"] == fills["decision_id"], "left").join(trades, d["id"] == trades["did"], "left")
    return out.select(F.col("id").alias("decision_id"), "ts_ms", "strategy", "fills", F.coalesce("n_trades", F.lit(0)).alias("n_trades"), "trade_pnl", F.coalesce(F.col("first_fill") >= F.col("ts_ms"), F.lit(True)).alias("in_order"))


def inspect(lines: DataFrame) -> DataFrame:
    """Per kind: records and chain violations."""
    rows = lines.withColumn("kind", F.get_json_object("line", "$.kind"))
    bad = chain_violations(lines).select("seq").distinct().withColumn("__bad", F.lit(1))
    return rows.join(bad, "seq", "left").groupBy("kind").agg(F.count("*").alias("records"), F.count("__bad").alias("violations"))


def ledger_line(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))
