"""Log lines rendered from the `events` table: known inputs for the parsers, one format in seven each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SQL = """
SELECT event_id + 1 AS line_no, ts, event_type, user_id, value,
       '10.0.' || (user_id % 200) || '.' || (event_id % 200 + 1) AS ip_,
       '/' || event_type || '/' || (user_id % 10) AS path_,
       CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level_,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_,
       CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method_,
       event_type || ' by user ' || user_id AS text_,
       event_id % 7 AS kind, event_id
FROM {events}
"""


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, line_no, value: JSON, CLF, RFC 5424, key=value, pipes, bracketed text, and lines without a time or with one in BSD style."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # One small file is one task, and parsing is dear: rows of inputs with fewer splits than cores are spread.
    cores = spark.sparkContext.defaultParallelism
    return render(spark, events.repartition(cores) if events.rdd.getNumPartitions() < cores else events)


def render(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The lines of `events`, a table or a stream."""
    events = events.withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    rows = spark.sql(_SQL.format(events="{e}"), e=events)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    ms = F.round("value", 2).cast("string")
    line = (
        F.when(F.col("kind") == 0, F.format_string('{"timestamp":"%s","level":"%s","ip":"%s","method":"%s","path":"%s","status":%s,"duration_ms":%s,"message":"%s"}', iso, "level_", "ip_", "method_", "path_", F.col("status_").cast("string"), ms, "text_"))
        .when(F.col("kind") == 1, F.format_string('%s - - [%s +0000] "%s %s HTTP/1.1" %s 512', "ip_", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), "method_", "path_", F.col("status_").cast("string")))
        .when(F.col("kind") == 2, F.format_string("<%s>1 %s host app %s ID7 - %s", F.when(F.col("level_") == "ERROR", "11").otherwise("14"), iso, F.col("user_id").cast("string"), "text_"))
        .when(F.col("kind") == 3, F.format_string('time=%s level=%s method=%s path=%s status=%s latency_ms=%s msg="%s"', iso, "level_", "method_", "path_", F.col("status_").cast("string"), ms, "text_"))
        .when(F.col("kind") == 4, F.format_string("%s|%s|%s|%s|%s|%s|%sms", iso, "level_", "ip_", "method_", "path_", F.col("status_").cast("string"), ms))
        .when(F.col("kind") == 5, F.format_string("%s [%s] worker: %s", plain, "level_", "text_"))
        .when(F.col("event_id") % 14 == 6, F.concat(F.lit("no time here "), "text_"))
        .otherwise(F.format_string("%s host worker[%s]: %s", F.date_format("ts", "MMM dd HH:mm:ss"), F.col("user_id").cast("string"), "text_"))
    )
    return rows.select(F.lit("events").alias("file"), "line_no", line.alias("value"))
