"""From files to tables: the analysis as named DataFrames."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.config import Config
from logweir.operators import gate as G
from logweir.operators import metrics as M
from logweir.operators import templates as T
from logweir.operators.parsers import parse
from logweir.operators.records import assemble
from logweir.sources.text import read_lines, reference_year


def gated(records: DataFrame, config: Config) -> DataFrame:
    return G.gate(parse(records, config), config)


def anomalies(errors: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Anomalies of the error-rate and the quarantine-rate series, by `metric`."""
    found = M.anomalies(errors, 5.0).withColumn("metric", F.lit("error_rate"))
    return found.unionByName(M.anomalies(quarantine, 3.0).withColumn("metric", F.lit("quarantine_rate"))).orderBy("bucket")


def tables(parsed: DataFrame, config: Config) -> dict[str, DataFrame]:
    """Every metric of a gated frame; cache or store it first, as each table reads it."""
    errors = M.accepted_series(parsed, config)
    quarantine = M.quarantine_series(parsed, config)
    kind = F.when(F.col("verdict") == "accepted", F.col("parser")).otherwise("quarantined")
    return {
        "totals": M.totals(parsed),
        "error_series": errors,
        "quarantine_series": quarantine,
        "anomalies": anomalies(errors, quarantine),
        "latency": M.latency(parsed),
        "endpoints": M.endpoints(M.endpoint_rows(parsed), config.max_endpoints),
        "error_templates": T.by_tree(T.errors(parsed)),
        "formats": M.format_distribution(parsed),
        "drift": M.drift(parsed.select("line_no", kind.alias("format"))),
        "file_profile": M.file_profile(parsed),
        "keywords": M.keywords(parsed.where("verdict = 'accepted'").select("line_no", T.message_text().alias("text"))),
        "quality": M.data_quality(parsed),
        "time_span": M.time_span(parsed.where("verdict = 'accepted'"), "event_ts"),
        "reasons": G.reasons(parsed),
        "samples": G.samples(parsed),
    }


def read_records(spark: SparkSession, path, config: Config) -> DataFrame:
    """file, line_no, raw, n_lines and ref_year, the year that each file's first lines speak of (null: none)."""
    lines = read_lines(spark, path, config.encoding)
    records = assemble(lines, config.max_group)
    if config.reference_year:
        return records
    years = reference_year(lines, int(config.run_ts[:4])).select(F.col("file").alias("_f"), F.col("year").alias("ref_year"))
    return records.join(F.broadcast(years), F.col("file") == F.col("_f"), "left").drop("_f")  # a row a file


def analyze(spark: SparkSession, path, config: Config | None = None, progress: Callable[[int, int], None] | None = None) -> dict[str, DataFrame]:
    """All tables of a log; `parsed` is also a temporary view of that name, `quarantined` the rejected records with the
    lines before them. Several files make one log; `per_file` tells them apart. progress: called with the tasks done and
    begun so far while the records are parsed. `release` gives back what is cached."""
    config = config or Config()
    records = read_records(spark, path, config)
    # Times without a year go by the years that the file's other times name, where neither settings nor its head do.
    parsed = anchored(gated(records, config), config).persist()
    if progress:
        watched(parsed, progress)
    parsed.createOrReplaceTempView("parsed")
    return {"parsed": parsed, "quarantined": G.quarantined(parsed, config.context_lines), "per_file": M.per_file(parsed)} | tables(parsed, config)


def release(t: dict[str, DataFrame]) -> None:
    t["parsed"].unpersist()


def anchored(rows: DataFrame, config: Config) -> DataFrame:
    """Rows whose times name no year moved to the year that most other times of their file name, unless a year is set."""
    if config.reference_year:
        return rows
    t = F.col("timestamp")
    named = rows.where((t["state"] == "known") & (t["source"] != "syslog_assumption")).groupBy("file", F.year(t["value"]).alias("y")).agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    best = named.groupBy("file").agg(F.max_by("y", F.struct("n", -F.col("first"))).alias("_year")).withColumnRenamed("file", "_file")
    out = rows.join(F.broadcast(best), F.col("file") == F.col("_file"), "left")  # a row a file
    v = t["value"]
    moved = F.try_make_timestamp(F.col("_year"), F.month(v), F.day(v), F.hour(v), F.minute(v), F.second(v).cast("decimal(16,6)"))
    ref = F.col("ref_year") if "ref_year" in rows.columns else F.lit(None)
    due = ref.isNull() & (t["source"] == "syslog_assumption") & F.col("_year").isNotNull() & moved.isNotNull()
    out = out.withColumn("timestamp", F.when(due, t.withField("value", moved)).otherwise(t))
    return out.withColumn("event_ts", F.when(due, moved).otherwise(F.col("event_ts"))).drop("_file", "_year")


def watched(frame: DataFrame, progress: Callable[[int, int], None], every: float = 0.1) -> None:
    """Fill a cached frame and report tasks done and begun meanwhile."""
    sc, done = frame.sparkSession.sparkContext, threading.Event()
    group = f"logweir-{uuid.uuid4().hex}"

    def report() -> None:
        tracker = sc.statusTracker()
        while not done.wait(every):
            stages = [i for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for i in job.stageIds]
            infos = [x for i in stages if (x := tracker.getStageInfo(i))]
            progress(sum(x.numCompletedTasks for x in infos), sum(x.numTasks for x in infos))

    watcher = threading.Thread(target=report, daemon=True)
    watcher.start()
    try:
        sc.setJobGroup(group, "parse records")
        n = frame.count()
    finally:
        done.set()
        watcher.join()
        sc.setLocalProperty("spark.jobGroup.id", None)
    progress(n, n)
