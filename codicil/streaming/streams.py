"""Continuous versions of the append-only aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from codicil.sources.scratch import scratch


def usage_stream(calls: DataFrame, delay: str = "1 day") -> DataFrame:
    """Calls and tokens by UTC day, service and model, as a stream; late calls count until the watermark passes their day."""
    kept = calls.filter(~F.col("failed")).withWatermark("created_at", delay)
    per = kept.groupBy(F.window("created_at", "1 day"), "service", "model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return per.select(F.to_date("window.start").alias("day"), "service", "model", "calls", "input_tokens", "output_tokens")


def notify_stream(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """One row for each key within the watermark's delay."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(keys)


LIMITED = "user_id long, event_id long, allowed boolean, retry_after double"
BUCKET = "tokens double, at double"


def limiter(limit: float, window: float):
    """Token bucket of one key: `limit` tokens refill over `window` seconds; an event takes one or is denied."""
    rate = limit / window

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # a full bucket is as good as none
            state.remove()
            return
        level, at = state.get if state.exists else (limit, None)
        rows = pd.concat(list(batches)).sort_values(["created_at", "event_id"])
        seconds = rows["created_at"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        allowed, wait = [], []
        for now in seconds:
            level = min(limit, level + rate * max(0.0, now - (now if at is None else at)))
            at = now if at is None else max(at, now)
            allowed.append(level >= 1)
            wait.append(0.0 if level >= 1 else round((1 - level) / rate, 6))
            level -= level >= 1
        state.update((float(level), float(at)))
        full_at = int((at + (limit - level) / rate) * 1000)
        state.setTimeoutTimestamp(max(full_at, state.getCurrentWatermarkMs() + 1000))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "allowed": allowed, "retry_after": wait})

    return run


def rate_limit(events: DataFrame, limit: float, window: float, delay: str = "1 hour") -> DataFrame:
    """Whether each event of a user is within the limit, and after how many seconds it may come again."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    marked = events.withWatermark("created_at", delay)
    return marked.groupBy("user_id").applyInPandasWithState(limiter(limit, window), LIMITED, BUCKET, "append", GroupStateTimeout.EventTimeTimeout)


def read_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{directory}/{name}.parquet*")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, and read what it wrote. In ``complete`` mode the last batch is the result."""
    spark = stream.sparkSession
    out, marks = scratch(spark, "stream"), scratch(spark, "marks")
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", out)
    else:
        run = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    run.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
