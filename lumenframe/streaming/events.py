"""Event-time operators, the same code for streams and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def _timed(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """With a watermark, which needs a timestamp with time zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else events


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    """Aggregates per window of ``width``; ``late`` is the watermark's delay."""
    return sliding(events, time, width, width, keys, *aggregates, late=late)


def sliding(events: DataFrame, time: str, width: str, slide: str, keys: list[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    e = _timed(events, time, late)
    out = e.groupBy(F.window(time, width, slide), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    e = _timed(events, time, late)
    out = e.groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in out.columns if c != "session_window"])


def dedup(events: DataFrame, keys: list[str], time: str | None = None, late: str | None = None) -> DataFrame:
    """One row per key; with a watermark, state older than ``late`` is dropped."""
    if time and late:
        return _timed(events, time, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, within: str, late: str | None = None, how: str = "inner") -> DataFrame:
    """Pairs of equal ``keys`` in which the right time lies after the left one by at most ``within``.

    For two streams, ``late`` sets both watermarks, and with the bound on times Spark drops
    state that can't match any more.  Tables are joined on time slots of that width as well, so a
    key with many rows meets only those near in time.
    """
    after = (F.col(right_time) > F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {within}"))
    if left.isStreaming or right.isStreaming:
        a = _timed(left, left_time, late).withColumnsRenamed({k: f"__{k}" for k in keys})
        on = [F.col(f"__{k}") == F.col(k) for k in keys]
        joined = a.join(_timed(right, right_time, late), [*on, after], how)
        return joined.select(*(F.coalesce(f"__{k}", k).alias(k) for k in keys), *(c for c in [*left.columns, *right.columns] if c not in keys))
    if how != "inner":
        raise ValueError("tables join by interval as inner joins only")
    slot = lambda c: F.window(c, within)["start"]
    a = left.withColumn("__slot", F.explode(F.array(slot(F.col(left_time)), slot(F.col(left_time) + F.expr(f"INTERVAL {within}")))))
    return a.join(right.withColumn("__slot", slot(F.col(right_time))), [*keys, "__slot"]).filter(after).drop("__slot")


def counted_by_key(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Running counts per key as a stateful operator: (key, n), one row per key and batch; state goes after ``late``."""
    import pandas as pd

    def count(k, rows, state):
        n = (state.get[0] if state.exists else 0) + sum(len(r) for r in rows)
        if state.hasTimedOut:
            state.remove()
            return
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "n": [n]})

    timed = _timed(events, time, late)
    kind = timed.schema[key].dataType.simpleString()
    return timed.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, n long", "n long", "update", "NoTimeout")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there now into Parquet files, exactly once, and stop."""
    query = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
