"""Quarantine gate: accepted or quarantined, with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.config import Config
from logweir.functions.fields import STANDARD, known


def gate(parsed: DataFrame, config: Config) -> DataFrame:
    """Adds status, reason (joined by '; ') and event_ts (best known time) to parsed records."""
    t = F.col("timestamp")
    if config.allows_synthetic:
        made = known(F.lit(config.run_ts), 0.35, "timestamp", "ingestion_fallback")
        parsed = parsed.withColumn("timestamp", F.when(t["state"] == "known", t).otherwise(made))
    reasons = [F.when(t["state"] != "known", F.lit("Missing or unparseable timestamp")).when(t["confidence"] < config.threshold, F.format_string("Timestamp confidence (%.2f) below threshold (%.2f)", t["confidence"], F.lit(config.threshold)))]
    if config.profile == "strict":
        for f in STANDARD[1:]:
            reasons.append(F.when((F.col(f"{f}.state") == "known") & (F.col(f"{f}.confidence") < config.threshold), F.format_string(f"Field '{f}' confidence (%.2f) below threshold (%.2f)", F.col(f"{f}.confidence"), F.lit(config.threshold))))
        reasons.append(F.when(F.col("quality") < config.threshold, F.format_string("Overall confidence (%.2f) below threshold (%.2f)", F.col("quality"), F.lit(config.threshold))))
    out = parsed.withColumn("reason", F.concat_ws("; ", *reasons))
    out = out.withColumn("status_", F.when(F.col("reason") == "", "accepted").otherwise("quarantined"))
    return out.withColumn("event_ts", F.when(t["state"].isin("known", "unknown"), t["value"])).withColumnRenamed("status_", "verdict")


def context_before(records: DataFrame, n: int = 5, width: int = 200, stretch: int = 65536) -> DataFrame:
    """Adds context_before: the first `width` characters of the n records before. A file is cut into stretches of lines, each
    with the last n records of the stretch before it, so that no task sees a whole file. Records so long that a stretch
    holds fewer than n of them take context from the one stretch before alone."""
    part = F.floor(F.col("line_no") / stretch)
    rows = records.withColumn("_part", part)
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy("file", "_part").orderBy(F.desc("line_no")))).where(F.col("_r") <= n)
    lent = last.withColumn("_part", F.col("_part") + 1).withColumn("_own", F.lit(False)).drop("_r")
    both = rows.withColumn("_own", F.lit(True)).unionByName(lent)
    w = Window.partitionBy("file", "_part").orderBy("line_no").rowsBetween(-n, -1)
    return both.withColumn("context_before", F.collect_list(F.substring("raw", 1, width)).over(w)).where("_own").drop("_own", "_part")


def quarantined(gated: DataFrame, n: int = 5) -> DataFrame:
    """The rejected records with reason and the records before them, as a table to write."""
    return context_before(gated, n).where("verdict = 'quarantined'").select("file", "line_no", "reason", "raw", "context_before", "event_ts")


def reasons(gated: DataFrame) -> DataFrame:
    """reason, n: quarantined records by reason, numbers taken out of those about confidence."""
    one = gated.where("verdict = 'quarantined'").select(F.explode(F.split("reason", ";")).alias("r"))
    r = F.btrim("r")
    plain = F.when(r.startswith("Timestamp confidence"), "Timestamp confidence below threshold").when(r.startswith("Overall confidence"), "Overall confidence below threshold").otherwise(r)
    return one.select(plain.alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


def samples(gated: DataFrame, shown: int = 10, width: int = 120) -> DataFrame:
    """The last quarantined records, in order."""
    last = gated.where("verdict = 'quarantined'").orderBy(F.desc("line_no")).limit(shown)
    return last.select("line_no", "reason", F.substring("raw", 1, width).alias("preview")).orderBy("line_no")
