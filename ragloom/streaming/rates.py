"""Streams: sliding-window rate limits, status from events, watermarked counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_OUT = "key long, ts timestamp, admitted boolean"


def rate_limited(events: DataFrame, key: str, ts: str, limit: int = 500, seconds: int = 60) -> DataFrame:
    """Admit an event if fewer than `limit` of its key were admitted within the last `seconds` (13.2); a stream or a table's stream.

    State per key: the admitted times within the window, `limit` at most. Events of a micro-batch are taken in time order.
    """
    span = pd.Timedelta(seconds=seconds)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent = [pd.Timestamp(x) for x in state.get[0]] if state.exists else []
        rows = pd.concat(list(batches))["ts"].sort_values()
        verdicts = []
        for now in rows:
            recent = [x for x in recent if now - x < span]
            verdicts.append(len(recent) < limit)
            if verdicts[-1]:
                recent.append(now)
        state.update(([str(x) for x in recent],))
        yield pd.DataFrame({"key": group[0], "ts": rows.to_numpy(), "admitted": verdicts})

    grouped = events.select(F.col(key).cast("long").alias("key"), F.col(ts).alias("ts")).groupBy("key")
    return grouped.applyInPandasWithState(step, _OUT, "recent array<string>", "append", "NoTimeout")


def sliding_count(events: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """Events of the key within the last `minutes`, the row itself included (batch form of 13.2)."""
    frame = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-minutes * 60_000_000, 0)
    return events.withColumn("n_recent", F.count("*").over(frame))


def tumbling_counts(events: DataFrame, ts: str, kind: str, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and kind behind a watermark; works on streams and tables."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
