"""Streams: request rates, incremental merging, appended logs.  Each gives what the batch operator gives on the same rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boardlark.operators.dedup import merge, prune
from boardlark.operators.store import Lock, StoreError, guard


def file_stream(spark: SparkSession, path: str, schema, most_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Events with a watermark; a time without a zone counts in the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def rate_windows(events: DataFrame, key: str, most: int, ts: str = "ts", width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Windows over the limit, as crawl.violations(); events later than `late` are dropped, which bounds the state."""
    windows = timed(events, ts, late).groupBy(F.window(ts, width).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return windows.where(F.col("n") > most).select("key", F.col("w.start").alias("start"), "n", (F.col("n") - most).alias("over"))


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return timed(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def write_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, then stop; a later call goes on from the checkpoint."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def merge_cycle(read: Callable[[], DataFrame], publish: Callable[[DataFrame], None], today, min_records: int = 1, min_retain_ratio: float = 0.5) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the batch's posts are merged into the posts read, stale ones go, and the result is published if the guard lets it; else
    the last state stays.  A batch that comes again merges to the same rows, as a known URL changes nothing but its permanent flag."""

    def run(batch: DataFrame, _: int) -> None:
        old = read()
        merged, _counts = merge(old, batch)
        # One order for the next cycle: what was there keeps its numbers, new posts go on behind them.
        after = (old.agg(F.max("_ord")).first()[0] or 0) + 1
        merged = merged.withColumn("_ord", F.when(F.col("_ord._src") == 0, F.col("_ord._ord")).otherwise(F.col("_ord._ord") + after))
        kept = prune(merged, today)
        try:
            guard(kept.count(), prune(old, today).count(), min_records, min_retain_ratio)
        except StoreError:
            return
        publish(kept)

    return run


def scheduled(cycle: Callable[[], None], interval_seconds: float, lock: Lock, run_on_startup: bool = True, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Runs a cycle at fixed intervals, one scheduler at a time: without the lock nothing runs.  A cycle that fails leaves the last good state and is tried
    again at the next interval.  rounds: intervals to run, without end by default; the outcomes of the cycles are returned."""
    done: list[str] = []

    def once() -> None:
        try:
            cycle()
            done.append("published")
        except Exception as e:  # the last good state stays, the schedule goes on
            done.append(f"failed:{type(e).__name__}")

    if not lock.acquire():
        return ["locked"]
    try:
        if run_on_startup:
            once()
        while rounds is None or rounds > 0:
            sleep(max(1, interval_seconds))
            once()
            rounds = rounds if rounds is None else rounds - 1
    finally:
        lock.release()
    return done
