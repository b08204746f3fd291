"""Streams: lines in, error-rate windows out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.config import Config
from logweir.operators.metrics import activity_key, is_error
from logweir.plans import views
from logweir.plans.engine import gated, tables


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as a stream; each is a record of its own, as assembly needs an order that a stream does not have."""
    return spark.readStream.text(path).select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("line_no"), F.col("value").alias("raw"), F.lit(1).alias("n_lines"))


def error_windows(parsed: DataFrame, config: Config, delay: str = "0 seconds") -> DataFrame:
    """bucket, n, hits of accepted records by tumbling window; rows later than the watermark are dropped."""
    rows = parsed.where("verdict = 'accepted'").select(F.col("event_ts").alias("ts"), is_error().alias("error")).withWatermark("ts", delay)
    out = rows.groupBy(F.window("ts", f"{config.bucket_seconds} seconds").alias("w")).agg(F.count("*").alias("n"), F.count_if("error").alias("hits"))
    return out.select(F.unix_timestamp("w.start").alias("bucket"), "n", "hits")


def run_available(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Processes what there is and returns the result as a table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def quarantine_windows(parsed: DataFrame, config: Config, delay: str = "0 seconds") -> DataFrame:
    """bucket, n, hits of quarantined among all records; those without a time count at the time of processing."""
    rows = parsed.select(F.coalesce("event_ts", F.current_timestamp()).alias("ts"), (F.col("verdict") == "quarantined").alias("hit")).withWatermark("ts", delay)
    out = rows.groupBy(F.window("ts", f"{config.bucket_seconds} seconds").alias("w")).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    return out.select(F.unix_timestamp("w.start").alias("bucket"), "n", "hits")


def endpoint_counts(parsed: DataFrame) -> DataFrame:
    """key, n, errors of accepted records, kept by key in the state store (modes complete and update)."""
    rows = parsed.where("verdict = 'accepted'").select(activity_key().alias("key"), is_error().alias("error"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if("error").alias("errors"))


def rolling(rows: DataFrame, seconds: int) -> DataFrame:
    """file, bucket, n, hits and late (rows left out) of each batch, row by row in order: a newer bucket of a file closes all
    older ones, whatever batch they come in. rows: file, line_no, ts, error. The state of a file is its newest bucket."""
    narrow = rows.where("ts is not null").select("file", "line_no", (F.floor(F.unix_micros("ts") / (seconds * 1_000_000)) * seconds).alias("bucket"), F.col("error").cast("int").alias("error"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows_ = pd.concat(list(frames)).sort_values("line_no")
        top = rows_["bucket"].cummax()
        if state.exists:
            top = top.clip(lower=state.get[0])
        state.update((int(top.iloc[-1]),))
        rows_["late"] = (rows_["bucket"] < top).astype("int64")
        rows_["n"], rows_["hits"] = 1 - rows_["late"], rows_["error"] * (1 - rows_["late"])
        out = rows_.groupby("bucket", as_index=False)[["n", "hits", "late"]].sum()
        out.insert(0, "file", key[0])
        yield out.astype({"n": "int64", "hits": "int64", "late": "int64"})

    return narrow.groupBy("file").applyInPandasWithState(step, "file string, bucket long, n long, hits long, late long", "newest long", "append", "NoTimeout")


def live(lines: DataFrame, config: Config, folder: str, draw: Callable[[str], None], every: str | None = None):
    """Draws the panel of all lines so far after each batch that changed it; the query that does so. folder: a shared one,
    which gets each batch's gated records, once also where a batch is run again. every: time between batches; None: what
    there is, then end."""
    spark, drawn = lines.sparkSession, []

    def batch(frame: DataFrame, number: int) -> None:
        numbered = frame.withColumn("line_no", F.monotonically_increasing_id() + F.lit(number << 45))
        gated(numbered, config).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        parsed = spark.read.parquet(folder)
        t = {"parsed": parsed} | tables(parsed, config)
        seen = views.signature(t["totals"]).first()["signature"]
        if seen not in drawn[-1:]:
            drawn.append(seen)
            draw(views.panel(t))

    writer = lines.writeStream.foreachBatch(batch)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
