"""What a series is: its key columns, its time column in epoch milliseconds, its step, and its chunk length."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


@dataclass(frozen=True)
class Series:
    """``keys`` name one series (venue, instrument); ``chunk`` rows of it are one unit of work."""

    keys: tuple[str, ...] = ("venue", "instrument")
    ts: str = "ts_ms"
    step_ms: int = MINUTE
    chunk: int = 16_384

    def window(self, *more: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *more).orderBy(self.ts)

    def at(self, **changes) -> Series:
        return replace(self, **changes)


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Raise at plan time where a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def epoch_ms(column):
    """Epoch milliseconds of a timestamp without time zone (or with one, in UTC)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_millis(c.cast("timestamp"))
