"""Ticks and order books as Structured Streaming: buckets, dedupe, sequence checks, merged state, books, freshness.

Every operator is a transformation of a streaming DataFrame; batch DataFrames go through the stateless ones as well.
Rows inside a micro-batch come in any order: stateful steps sort them by arrival first.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.events import environment_events

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
TICK = "source string, venue string, instrument string, event_ts timestamp, received_ts timestamp, sequence long, kind string, side string, price double, quantity double, bid double, ask double, open_interest double, funding_rate double, generation int"


def read_ticks(spark: SparkSession, path: str, schema: str = TICK, files_per_batch: int | None = None) -> DataFrame:
    """Landed JSON messages as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


def parse_messages(raw: DataFrame, schema: str = TICK, value: str = "value") -> DataFrame:
    """Messages in a text or Kafka value column; what is no message of the schema has a null source and is dropped."""
    return raw.select(F.from_json(F.col(value).cast("string"), schema).alias("m")).select("m.*").where("source is not null")


def minute_flow(ticks: DataFrame, watermark: str = "2 minutes", width: str = "1 minute") -> DataFrame:
    """Volume and money by side per tumbling minute; state goes once the watermark passes its end."""
    side = lambda s, v: F.sum(F.when(F.col("side") == s, v).otherwise(0.0))
    money = F.col("price") * F.col("quantity")
    out = ticks.where("kind = 'trade'").withWatermark("event_ts", watermark).groupBy("instrument", F.window("event_ts", width).alias("w")).agg(
        side("buy", F.col("quantity")).alias("buy_volume"), side("sell", F.col("quantity")).alias("sell_volume"), side("buy", money).alias("buy_notional"), side("sell", money).alias("sell_notional"), F.count("*").alias("trades")
    )
    return out.select("instrument", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "buy_volume", "sell_volume", "buy_notional", "sell_notional", "trades")


def liquidations(ticks: DataFrame, watermark: str = "2 minutes", width: str = "1 minute") -> DataFrame:
    """Forced orders per minute by the side of the order."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("quantity")).otherwise(0.0))
    out = ticks.where("kind = 'liquidation'").withWatermark("event_ts", watermark).groupBy("instrument", F.window("event_ts", width).alias("w")).agg(side("buy").alias("liq_buy_qty"), side("sell").alias("liq_sell_qty"))
    return out.select("instrument", F.col("w.start").alias("start"), "liq_buy_qty", "liq_sell_qty")


EVENT_KEY = ("source", "instrument", "event_ts", "sequence", "kind", "price", "quantity")


def without_retransmissions(ticks: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    return ticks.withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark(list(EVENT_KEY))


def _seconds(width: str) -> int:
    n, unit = width.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]


def _tick_bars(ticks: DataFrame, width: str, watermark: str, *more) -> DataFrame:
    """Bars of trades with their window w: state of one row an instrument and open bucket."""
    at = F.struct("event_ts", "sequence")
    return ticks.where("kind = 'trade'").withWatermark("event_ts", watermark).groupBy("instrument", F.window("event_ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"), F.count("*").alias("trades"), *more
    )


def closed_bars(ticks: DataFrame, width: str = "1 minute", watermark: str = "10 seconds", step: str | None = None, steps: int | None = None) -> DataFrame:
    """OHLCV rows that appear once their bucket has closed (append mode).

    With ``step`` only complete buckets: those whose ticks lie in ``steps`` different stretches of that width.
    """
    seconds = _seconds(step) if step else 1
    parts = F.size(F.collect_set(F.floor(F.unix_seconds("event_ts") / seconds)))  # at most ``steps`` values
    out = _tick_bars(ticks, width, watermark, *([parts.alias("__parts")] if step else []))
    out = out.where(F.col("__parts") == steps) if step else out
    return out.select("instrument", F.col("w.start").alias("start"), F.col("w.end").alias("end"), *BAR_FIELDS)


BAR_FIELDS = ("open", "high", "low", "close", "volume", "trades")


def _wider(at) -> list:
    """A wider bar of bars in order of ``at``."""
    return [F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"), F.sum("trades").alias("trades")]


def wider_bars(bars: DataFrame, width: str, watermark: str = "0 seconds") -> DataFrame:
    """Closed bars of ``width`` from a stream of closed bars (instrument, start, end, ...), as another query has landed them."""
    out = bars.withWatermark("start", watermark).groupBy("instrument", F.window("start", width).alias("w")).agg(*_wider(F.col("start")))
    return out.select("instrument", F.col("w.start").alias("start"), F.col("w.end").alias("end"), *BAR_FIELDS)


class Widen(StatefulProcessor):
    """Hands an instrument's closed bars on and makes wider ones of them: state of one row an open wider bar.

    A wider bar appears once the watermark has passed its end; all bars below it have closed by then.
    """

    def __init__(self, widths: list[str]):
        self.widths = widths

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "level int, start_us long", "first_us long, open double, high double, low double, last_us long, close double, volume double, trades long")

    def _closed(self, key, passed_ms: int) -> list[tuple]:
        out = []
        for held in list(self.open.keys()):
            level, start = held
            end = start + _seconds(self.widths[level]) * 1_000_000
            if end <= passed_ms * 1000:
                _, o, h, lo, _, c, volume, trades = self.open.getValue((level, start))
                self.open.removeKey((level, start))
                out.append((*key, self.widths[level], start, end, o, h, lo, c, volume, trades))
            else:
                self.handle.registerTimer(end // 1000 - 1)  # rings when the watermark is past it: at the end
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            pdf = pdf.sort_values("start_us")
            yield pdf.assign(frame=self.widths[0])[ROLLED]
            for level, width in enumerate(self.widths[1:], 1):
                us = _seconds(width) * 1_000_000
                for at, own in pdf.groupby(pdf["start_us"] // us * us):
                    first, last = own.iloc[0], own.iloc[-1]
                    bar = (int(first["start_us"]), float(first["open"]), float(own["high"].max()), float(own["low"].min()), int(last["start_us"]), float(last["close"]), float(own["volume"].sum()), int(own["trades"].sum()))
                    if self.open.containsKey((level, int(at))):
                        old = tuple(self.open.getValue((level, int(at))))
                        early, late = min(old, bar), max(old, bar, key=lambda b: b[4])
                        bar = (*early[:2], max(old[2], bar[2]), min(old[3], bar[3]), *late[4:6], old[6] + bar[6], old[7] + bar[7])
                    self.open.updateValue((level, int(at)), bar)
        yield from self._frame(self._closed(key, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._frame(self._closed(key, timerValues.getCurrentWatermarkInMs()))

    def _frame(self, bars: list[tuple]) -> Iterator[pd.DataFrame]:
        if bars:
            yield pd.DataFrame(bars, columns=ROLLED)

    def close(self) -> None:
        pass


ROLLED = ["instrument", "frame", "start_us", "end_us", *BAR_FIELDS]


def rolled_up(ticks: DataFrame, widths: tuple[str, ...] = ("1 minute", "5 minutes", "15 minutes"), watermark: str = "10 seconds") -> DataFrame:
    """Closed bars of several widths, each a multiple of the one before, as one stream with a frame column.

    Ticks are aggregated once, to bars of the first width; wider bars are made of these. Each bar appears when it has
    closed itself, and does not wait for a wider one.
    """
    seconds = [_seconds(w) for w in widths]
    if any(b % a or b == a for a, b in zip(seconds, seconds[1:], strict=False)):
        raise ValueError("each width must be a multiple of the one before")
    bars = _tick_bars(ticks, widths[0], watermark).select("instrument", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), *BAR_FIELDS)
    schema = "instrument string, frame string, start_us long, end_us long, open double, high double, low double, close double, volume double, trades long"
    out = bars.groupBy("instrument").transformWithStateInPandas(statefulProcessor=Widen(list(widths)), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.select("instrument", "frame", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"), *BAR_FIELDS)


def _millis(t) -> int:
    return pd.Timestamp(t).value // 1_000_000


def _in_order(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """A key's rows of one micro-batch by arrival; ``files_per_batch`` of the source bounds them."""
    return pd.concat(list(rows)).sort_values(list(order), kind="stable")


class Blocks:
    """Rows of a key that wait in state, as Arrow blocks by slots of a number: a block costs one access, not each of its rows.

    The map's keys tell slot, order of coming and least number of a block; its rows are read slot by slot.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, column: str, width: int):
        self.map = handle.getMapState(name, "slot long, n long, least long", "block binary")
        self.column, self.width = column, width
        self.n = None

    def keys(self) -> list[tuple[int, int, int]]:
        return sorted(tuple(k) for k in self.map.keys())

    def add(self, pdf: pd.DataFrame) -> None:
        if self.n is None:
            self.n = 1 + max((k[1] for k in self.keys()), default=-1)
        for slot, own in pdf.groupby(pdf[self.column] // self.width, sort=False):
            sink = pa.BufferOutputStream()
            table = pa.Table.from_pandas(own, preserve_index=False)
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
                writer.write_table(table)
            self.map.updateValue((int(slot), self.n, int(own[self.column].min())), (sink.getvalue().to_pybytes(),))
            self.n += 1

    def take(self, keys: list[tuple[int, int, int]]) -> Iterator[pd.DataFrame]:
        """The rows of these blocks as they came, a frame a slot in order of the slots; the blocks are forgotten."""
        for _, own in itertools.groupby(keys, lambda k: k[0]):
            held = []
            for k in own:
                with pa.ipc.open_stream(bytes(self.map.getValue(k)[0])) as reader:
                    held.append(reader.read_pandas())
                self.map.removeKey(k)
            yield pd.concat(held, ignore_index=True)


class InOrder(StatefulProcessor):
    """Hands a key's rows on in order of arrival time and sequence, whatever batches they come in.

    Rows wait in blocks until the watermark of ``received_ts`` has passed them: then none can come before them, and a
    timer releases them in order. So files may land in any order, and be cut into batches anywhere, within the
    watermark's delay. A row that comes later than that is dropped by the engine, and shows as a gap in the sequence.
    What waits in state is bounded by the delay, not by the batch; a slot of 1/64 of it is sorted at a time.
    """

    def __init__(self, delay: str):
        self.slot_us = max(1000, _seconds(delay) * 1_000_000 // 64)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = Blocks(handle, "rows", "received_us", self.slot_us)

    def taken(self, pdf: pd.DataFrame) -> dict:
        """The waiting columns of a batch besides received_us and sequence."""
        raise NotImplementedError

    def released(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        """The result rows of waiting rows in order; called with each row once."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            held = pd.DataFrame({"received_us": _micros(pdf["received_ts"]), "sequence": pdf["sequence"].to_numpy(), **self.taken(pdf)})
            self.blocks.add(held)
            least = int(held["received_us"].min())
            first = least if first is None else min(first, least)
        timers = list(self.handle.listTimers())
        if not timers or min(timers) > _due(first):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(_due(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        keys = self.blocks.keys()
        later = [k[2] for k in keys if k[0] > passed // self.slot_us]
        for rows in self.blocks.take([k for k in keys if k[0] <= passed // self.slot_us]):
            due = rows["received_us"] <= passed
            if not due.all():
                self.blocks.add(rows[~due])
                later.append(int(rows["received_us"][~due].min()))
            if due.any():
                yield self.released(key, rows[due].sort_values(["received_us", "sequence"], kind="stable"))
        if later:
            self.handle.registerTimer(_due(min(later)))

    def close(self) -> None:
        pass


def _micros(column: pd.Series) -> np.ndarray:
    return column.astype("datetime64[us]").astype("int64").to_numpy()


def _due(received_us: int) -> int:
    """The watermark in milliseconds that has passed a row."""
    return -(-received_us // 1000)


def _before(values: np.ndarray, start) -> np.ndarray:
    """The largest value before each, that of earlier batches being ``start``."""
    return np.maximum.accumulate(np.concatenate([[start], values[:-1]]))


class SequenceCheck(InOrder):
    """Per source and instrument: the last sequence and the largest event time. Gives each tick its codes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "sequence long, event_ms long")

    def taken(self, pdf: pd.DataFrame) -> dict:
        return {"event_ms": _micros(pdf["event_ts"]) // 1000, "price": pdf["price"].to_numpy(), "quantity": pdf["quantity"].to_numpy()}

    def released(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        s, at = (rows[c].to_numpy("int64") for c in ("sequence", "event_ms"))
        known = np.ones(len(rows), bool)
        known[0] = self.last.exists()
        last = self.last.get() if known[0] else (s[0], at[0])
        sequence, event = _before(s, last[0]), _before(at, last[1])
        late, repeat, gap = known & (at < event), known & (s <= sequence), known & (s > sequence + 1)
        kinds = [[*first, *second] for first in ([], ["LATE"]) for second in ([], ["REPEAT"], ["GAP"])]
        codes = [kinds[i] for i in (3 * late + repeat + 2 * gap).tolist()]
        self.last.update((int(max(sequence[-1], s[-1])), int(max(event[-1], at[-1]))))
        return pd.DataFrame({"source": key[0], "instrument": key[1], "sequence": s, "event_ms": at, "price": rows["price"].to_numpy(), "quantity": rows["quantity"].to_numpy(), "codes": codes, "newer": ~known | (at > event)})


TAGGED = "source string, instrument string, sequence long, event_ms long, price double, quantity double, codes array<string>, newer boolean"
#: How much earlier than the newest a tick may arrive and still be put in its place.
REORDER_DELAY = "1 minute"


def _ordered(ticks: DataFrame, processor: InOrder, schema: str, delay: str) -> DataFrame:
    keyed = ticks.withWatermark("received_ts", delay).groupBy("source", "instrument")
    return keyed.transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def tagged(ticks: DataFrame, delay: str = REORDER_DELAY) -> DataFrame:
    """Every tick with its codes (GAP, REPEAT, LATE) and whether its event time is newer than all before.

    Ticks count in order of received_ts and sequence, whatever batches bring them, and come out once ``delay`` has passed
    them. LATE is an event time before one that arrived earlier; it is told, not dropped.
    """
    return _ordered(ticks, SequenceCheck(delay), TAGGED, delay)


def sequence_problems(ticks: DataFrame, delay: str = REORDER_DELAY) -> DataFrame:
    """(source, instrument, sequence, event_ms, code): a row for each gap, repeat and late tick."""
    return tagged(ticks, delay).select("source", "instrument", "sequence", "event_ms", F.explode("codes").alias("code"))


def only_newer(ticks: DataFrame, delay: str = REORDER_DELAY) -> DataFrame:
    """The ticks whose event time is after every tick before them: what a poller that skips what it has seen takes."""
    return tagged(ticks, delay).where("newer").drop("codes", "newer")


def split_late(stream: DataFrame, path: str, late_path: str, checkpoint: str, delay: str = REORDER_DELAY):
    """Write ticks that come in order to ``path`` and late ones to ``late_path``: none is merged or lost silently.

    A batch that runs again overwrites its own folder.
    """

    def save(batch: DataFrame, number: int) -> None:
        late = F.array_contains("codes", "LATE")
        held = batch.persist()
        held.where(~late).write.mode("overwrite").parquet(f"{path}/batch={number}")
        held.where(late).write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        held.unpersist()

    return tagged(stream, delay).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FIELDS = ("price", "bid", "ask", "open_interest", "funding_rate")


class FieldMerge(InOrder):
    """The newest non-null value of each field with its time; a new connection generation starts afresh."""

    def __init__(self, stale_ms: int, delay: str):
        super().__init__(delay)
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("fields", ", ".join(["generation int", "clock_ms long", *(f"{f} double, {f}_ms long" for f in FIELDS)]))

    def taken(self, pdf: pd.DataFrame) -> dict:
        return {"event_ms": _micros(pdf["event_ts"]) // 1000, "generation": pdf["generation"].to_numpy(), **{f: pdf[f].to_numpy(float) for f in FIELDS}}

    def released(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        held = list(self.state.get()) if self.state.exists() else None
        generation = rows["generation"].to_numpy()
        top = np.maximum.accumulate(generation if held is None else np.maximum(generation, held[0]))
        rows, top = rows[generation == top], top[generation == top]  # the others are of an older connection
        out = []
        for own in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(top)) + 1):
            if len(own):
                held, merged = self._merged(held, int(top[own[0]]), rows.iloc[own])
                out.append(merged)
        self.state.update(tuple(held))
        columns = [c.split()[0] for c in MERGED.split(", ")]
        return pd.concat(out, ignore_index=True).assign(source=key[0], instrument=key[1])[columns] if out else pd.DataFrame(columns=columns)

    def _merged(self, held: list | None, generation: int, rows: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        """The state after ticks of one generation, and the fields after each of them."""
        never = np.iinfo("int64").min
        at = rows["event_ms"].to_numpy("int64")
        if held is None or generation > held[0]:
            held = [generation, int(at[0]), *([None, None] * len(FIELDS))]
        clock = np.maximum.accumulate(np.maximum(at, held[1]))
        after, fresh = [generation, int(clock[-1])], {}
        for i, f in enumerate(FIELDS):
            value, since = held[2 + 2 * i : 4 + 2 * i]
            v = rows[f].to_numpy(float)
            # a value counts unless one of a later time is held: its time is then the largest of all values so far
            known = np.where(np.isnan(v), never, at)
            before = _before(known, never if since is None else since)
            time = np.maximum(before, known)
            newest = np.maximum.accumulate(np.where(~np.isnan(v) & (at >= before), np.arange(len(v)), -1))
            v = np.where(newest >= 0, v[newest], np.nan if value is None else value)
            fresh[f] = np.where((time != never) & (time >= clock - self.stale_ms), v, np.nan)
            after += [None, None] if time[-1] == never else [float(v[-1]), int(time[-1])]
        return after, pd.DataFrame({"sequence": rows["sequence"].to_numpy(), "generation": generation, "event_ms": clock, **fresh})


MERGED = "source string, instrument string, sequence long, generation int, event_ms long, " + ", ".join(f"{f} double" for f in FIELDS)


def merged_fields(ticks: DataFrame, stale_ms: int = 15_000, delay: str = REORDER_DELAY) -> DataFrame:
    """The merged fields after each tick, null where older than ``stale_ms`` before the newest event time of the connection.

    Ticks count in order of received_ts and sequence, whatever batches bring them. A tick of a newer connection
    generation forgets all fields; one of an older generation is skipped.
    """
    return _ordered(ticks, FieldMerge(stale_ms, delay), MERGED, delay)


class Book(StatefulProcessor):
    """Bids and asks as maps of price to size. A delta that does not follow the last one is a gap: the book is emptied until a snapshot.

    The maps hold at most ``levels`` prices; a batch reads them once and writes back the prices that it has changed. Its
    updates are laid down in slots of ``slot`` numbers first, so that one slot is sorted and held at a time.
    """

    def __init__(self, levels: int, slot: int = 50_000):
        self.levels, self.slot = levels, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bids = handle.getMapState("bids", "price double", "size double")
        self.asks = handle.getMapState("asks", "price double", "size double")
        self.at = handle.getValueState("update", "update_id long, synced boolean")
        self.blocks = Blocks(handle, "updates", "update_id", self.slot)

    def _cut(self, book: dict, best) -> None:
        """Forget the prices beyond the best ``levels``."""
        while len(book) > self.levels:
            del book[(min if best is max else max)(book)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, synced = self.at.get() if self.at.exists() else (None, False)
        before = [{k[0]: v[0] for k, v in s.iterator()} for s in (self.bids, self.asks)]
        sides = [dict(b) for b in before]
        for pdf in rows:
            self.blocks.add(pdf.drop(columns="instrument"))
        for pdf in self.blocks.take(self.blocks.keys()):
            out = []
            pdf = pdf.sort_values("update_id", kind="stable")
            for update, snapshot, *changes in zip(*(pdf[c].tolist() for c in ("update_id", "is_snapshot", "bid_prices", "bid_sizes", "ask_prices", "ask_sizes")), strict=True):
                if snapshot:
                    sides, synced = [{}, {}], True
                elif not synced or update != last + 1:
                    if synced:
                        out.append((*key, update, "GAP", None, None, None, None, None))
                    sides, synced, last = [{}, {}], False, update
                    continue
                for book, prices, sizes, best in zip(sides, changes[::2], changes[1::2], (max, min), strict=True):
                    for p, q in zip(prices.tolist(), sizes.tolist(), strict=True) if prices is not None else []:
                        if q:
                            book[p] = q
                        else:
                            book.pop(p, None)
                    self._cut(book, best)
                last = update
                depth = [sum(s.values()) for s in sides]
                money = sum(p * q for s in sides for p, q in s.items())
                out.append((*key, last, "OK", max(sides[0], default=None), min(sides[1], default=None), depth[0], depth[1], money))
            yield pd.DataFrame(out, columns=["instrument", "update_id", "status", "bid", "ask", "bid_depth", "ask_depth", "notional"])
        for state, old, new in zip((self.bids, self.asks), before, sides, strict=True):
            for p in old.keys() - new.keys():
                state.removeKey((p,))
            for p, q in new.items():
                if old.get(p) != q:
                    state.updateValue((p,), (q,))
        self.at.update((last, synced))

    def close(self) -> None:
        pass


BOOK = "instrument string, update_id long, status string, bid double, ask double, bid_depth double, ask_depth double, notional double"
DELTA = "instrument string, update_id long, is_snapshot boolean, bids array<struct<price: double, size: double>>, asks array<struct<price: double, size: double>>"


def order_books(deltas: DataFrame, levels: int = 50) -> DataFrame:
    """Top of book, depth and money after each update; a GAP row where updates are missing."""
    sides = [F.col(f"{side}s.{part}").alias(f"{side}_{part}s") for side in ("bid", "ask") for part in ("price", "size")]
    deltas = deltas.select("instrument", "update_id", "is_snapshot", *sides)
    return deltas.groupBy("instrument").transformWithStateInPandas(statefulProcessor=Book(levels), outputStructType=BOOK, outputMode="Append", timeMode="None")


def fresh_flags(ticks: DataFrame, now, limit_ms: int = 15_000) -> DataFrame:
    """Age at ``now`` (a column or timestamp) and whether a tick is stale or from the future."""
    age = F.unix_millis(now) - F.unix_millis("event_ts")
    return ticks.withColumns({"age_ms": age, "stale": age > limit_ms, "future": age < 0})


class Freshness(StatefulProcessor):
    """Per source and instrument the newest event time, and a timer that rings when it has grown too old."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "event_ms long")

    def _row(self, key, event: int, now: int) -> pd.DataFrame:
        age = now - event
        status = "FUTURE" if age < 0 else "FRESH" if age <= self.limit_ms else "STALE"
        return pd.DataFrame([(*key, event, age, status)], columns=["source", "instrument", "event_ms", "age_ms", "status"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(_millis(pdf["event_ts"].max()) for pdf in rows)
        event = max(newest, self.last.get()[0]) if self.last.exists() else newest
        now = timerValues.getCurrentProcessingTimeInMs()
        self.last.update((event,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if now <= event + self.limit_ms:
            self.handle.registerTimer(event + self.limit_ms + 1)
        yield self._row(key, event, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            yield self._row(key, self.last.get()[0], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def freshness(ticks: DataFrame, limit_ms: int = 15_000) -> DataFrame:
    """FRESH, STALE or FUTURE per source and instrument: on every batch with ticks, and when the limit passes without any."""
    schema = "source string, instrument string, event_ms long, age_ms long, status string"
    return ticks.groupBy("source", "instrument").transformWithStateInPandas(statefulProcessor=Freshness(limit_ms), outputStructType=schema, outputMode="Update", timeMode="ProcessingTime")


class PreviousBar(StatefulProcessor):
    """Per instrument the last bar that was seen; bars that are not newer are skipped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "start_ms long, high double, low double, close double, trend string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get() if self.last.exists() else None
        out = []
        for r in _in_order(rows, "start").to_dict("records"):
            at = _millis(r["start"])
            if before is not None and at <= before[0]:
                continue
            _, high, low, close, trend = before or (None, None, None, None, None)
            now = "FLAT" if close is None or r["close"] == close else "UP" if r["close"] > close else "DOWN"
            change = r["close"] / close - 1 if close else None
            out.append((*key, at, r["open"], r["high"], r["low"], r["close"], r["volume"], change, high, low, now, trend))
            before = (at, r["high"], r["low"], r["close"], now)
        if before is not None:
            self.last.update(before)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FOLLOWED.split(", ")])

    def close(self) -> None:
        pass


FOLLOWED = "instrument string, start_ms long, open double, high double, low double, close double, volume double, return_fraction double, previous_high double, previous_low double, trend_direction string, previous_trend_direction string"


def following(bars: DataFrame) -> DataFrame:
    """Each new bar of a stream with the bar before it, from state: one row per instrument and start, however often it comes."""
    return bars.groupBy("instrument").transformWithStateInPandas(statefulProcessor=PreviousBar(), outputStructType=FOLLOWED, outputMode="Append", timeMode="None")


def bar_events(bars: DataFrame) -> DataFrame:
    """Environment events of each new bar of a stream, evaluated once."""
    return environment_events(following(bars), ["instrument", "start_ms"])


def write_once(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """One row per key however often a batch runs: each batch is written to a folder of its own number."""

    def save(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in batch.columns if c not in (*keys, order)])).alias("r")).select(*keys, "r.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """An append-only Parquet log."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


