"""The engine's registered queries and their SQL.

Log queries read lines rendered from `events` (sources/render.py). Their SQL computes the expected answer from the
columns of `events` and never parses a line.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.config import Config
from logweir.functions import fields as X
from logweir.functions.probe import probe
from logweir.functions.timestamps import timestamp
from logweir.operators import gate as G
from logweir.operators import metrics as M
from logweir.operators import templates as T
from logweir.operators.parsers import parse
from logweir.operators.records import assemble
from logweir.plans import reports as R
from logweir.plans import views as V
from logweir.plans.engine import anchored, anomalies, gated, tables
from logweir.sources.render import render, rendered
from logweir.sources.text import reference_year
from logweir.streaming.rates import endpoint_counts, error_windows, rolling, run_available

#: `events` are minutes apart: six hours a bucket.
CONFIG = Config(reference_year=2024, bucket_seconds=21_600)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir).select("file", "line_no", F.col("value").alias("raw"), F.lit(1).alias("n_lines"))


def _gated(spark: SparkSession, sf_dir: str, config: Config = CONFIG) -> DataFrame:
    return gated(_records(spark, sf_dir), config)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.withColumn("line_no", F.col("event_id") + 1).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("error", F.col("event_type") == "error")


def error_rate_overall(spark, sf_dir):
    return M.totals(_gated(spark, sf_dir)).select("total", "accepted", "quarantined", "errors", F.round("error_rate", 9).alias("error_rate"))


def error_rate_buckets(spark, sf_dir):
    return M.accepted_series(_gated(spark, sf_dir), CONFIG).select("bucket", "n", "hits", F.round("rate", 9).alias("rate"))


def error_rate_late(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("line_no", (F.col("event_id") + F.col("event_id") * 37 % 20) * 1_000 + F.col("event_id") % 1_000)
    return M.rate_series(e, F.col("error"), 3_600).select("bucket", "n", "hits")


def error_anomalies(spark, sf_dir):
    found = M.anomalies(M.rate_series(_events(spark, sf_dir), F.col("error"), 3_600), 2.0)
    return found.select("bucket", *[F.round(c, 6).alias(c) for c in ("rate", "baseline", "z")], "direction")


def latency_percentiles(spark, sf_dir):
    out = M.latency(_gated(spark, sf_dir))
    return out.select("n", "n_low", "n_unknown", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "min", "max")])


def _keyed(spark, sf_dir, key):
    return _events(spark, sf_dir).select(key.alias("key"), "line_no", "error", F.col("value").alias("ms"))


def endpoint_table(spark, sf_dir):
    out = M.endpoints(_keyed(spark, sf_dir, F.col("event_type")))
    return out.select("key", "n", "errors", *[F.round(c, 6).alias(c) for c in ("error_rate", "p50", "p95", "p99")], "first_line")


def endpoint_overflow(spark, sf_dir):
    out = M.endpoints(_keyed(spark, sf_dir, F.concat(F.lit("u"), F.col("user_id"), F.lit(":"), F.col("event_type"))))
    return out.select("key", "n", "errors", F.round("p50", 6).alias("p50"), "first_line")


def endpoint_trend(spark, sf_dir):
    return M.trend(_keyed(spark, sf_dir, F.col("user_id").cast("string")))


def _endpoints(spark, sf_dir):
    """Of users and event types: the first 200 pairs by arrival, and all others in one row."""
    return M.endpoints(_keyed(spark, sf_dir, F.concat(F.lit("u"), F.col("user_id"), F.lit(":"), F.col("event_type"))))


def endpoints_by_volume(spark, sf_dir):
    return V.top_endpoints(_endpoints(spark, sf_dir)).select("key", "n", "errors")


def endpoints_by_latency(spark, sf_dir):
    return V.top_endpoints(_endpoints(spark, sf_dir), "latency", 25).select("key", "n", F.round("p99", 6).alias("p99"))


def endpoints_failing(spark, sf_dir):
    return V.failing_endpoints(M.endpoints(_keyed(spark, sf_dir, F.concat("event_type", F.col("user_id") % 5)))).select("key", "n", "errors")


def endpoint_slowest(spark, sf_dir):
    return V.slowest_endpoint(_endpoints(spark, sf_dir)).select("key", "n", F.round("p99", 6).alias("p99"))


def keywords_shown(spark, sf_dir):
    return V.top_keywords(keywords_top(spark, sf_dir))


def format_mix(spark, sf_dir):
    return V.format_mix(_gated(spark, sf_dir))


def weakest_fields(spark, sf_dir):
    return V.weakest_fields(M.data_quality(_gated(spark, sf_dir))).select("field", F.round("known_rate", 9).alias("known_rate"))


def quality_score(spark, sf_dir):
    return V.overall_quality(M.data_quality(_gated(spark, sf_dir))).select(F.round("score", 9).alias("score"))


def overview(spark, sf_dir):
    out = V.overview(M.totals(_gated(spark, sf_dir)), 2.0)
    return out.select("total", "accepted", "quarantined", *[F.round(c, 6).alias(c) for c in ("accept_pct", "quarantine_pct", "error_pct", "throughput")])


def per_file(spark, sf_dir):
    """The log dealt over three files, each with line numbers of its own."""
    rows = _records(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), F.col("line_no") % 3)).withColumn("line_no", F.floor(F.col("line_no") / 3))
    return M.per_file(gated(rows, CONFIG)).select("file", "total", "accepted", "quarantined", "errors", F.round("error_rate", 9).alias("error_rate"))


def per_file_series(spark, sf_dir):
    """The same three files: each closes its own buckets."""
    rows = _events(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), F.col("line_no") % 3)).withColumn("line_no", F.floor(F.col("line_no") / 3))
    return M.rate_series(rows, F.col("error"), CONFIG.bucket_seconds).select("bucket", "n", "hits")


def late_rows(spark, sf_dir):
    """The rows that the series of error_rate_late leaves out."""
    e = _events(spark, sf_dir)
    shuffled = e.withColumn("line_no", (F.col("event_id") + (F.col("event_id") * 37) % 20) * 1000 + F.col("event_id") % 1000)
    return M.late(shuffled, 3600).select("event_id", "bucket")


def quarantine_series(spark, sf_dir):
    return M.quarantine_series(_gated(spark, sf_dir), CONFIG).select("bucket", "n", "hits")


def learned_years(spark, sf_dir):
    """Times without a year, where neither settings nor the clock name the log's."""
    config = Config(run_ts="2030-06-01 00:00:00", bucket_seconds=21_600)
    rows = anchored(gated(_records(spark, sf_dir), config), config).where("timestamp.source = 'syslog_assumption'")
    return rows.select("line_no", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def zoned_times(spark, sf_dir):
    """Times without an offset in a zone named in another letter case, read through both changes of its clocks."""
    config = Config(log_tz="america/chicago", reference_year=2024)
    e = _events(spark, sf_dir).select("line_no", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("event_id") * 3600 % 31_536_000).alias("wall"))
    out = e.select("line_no", F.inline(F.array(timestamp(F.date_format("wall", "yyyy-MM-dd HH:mm:ss"), config))))
    return out.select("line_no", F.unix_seconds("value").alias("seconds"), "confidence")


def loose_dates(spark, sf_dir):
    e = _events(spark, sf_dir)
    text = F.concat(F.lit("on "), F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy/MM/dd HH:mm")).otherwise(F.date_format("ts", "dd/MMM/yyyy")), F.lit(" it rained"))
    out = e.select("line_no", F.inline(F.array(timestamp(text, CONFIG))))
    return out.select("line_no", F.date_format("value", "yyyy-MM-dd HH:mm").alias("ts"), "confidence", "source")


def format_probe(spark, sf_dir):
    return _records(spark, sf_dir).select("line_no", probe(F.col("raw")).alias("p")).select("line_no", "p.hint", "p.confidence")


def _claimed() -> Column:
    """The query that shows a record: by the parser that claimed it, and for the token scan by the time that it found."""
    name, time = F.regexp_extract("parser", "^([^+]*)", 1), F.col("timestamp")
    scanned = F.when(time["state"] != "known", "parsed_untimed").when(time["source"] == "syslog_assumption", "parsed_bsd").otherwise("parsed_tokens")
    return F.when(name == "tokenExtractor", scanned).otherwise(F.concat(F.lit("parsed_"), name))


def _parsed(query_name: str, names: list[str]):
    """Parses every record; shows those that the parser claims, so that a line taken by a wrong parser comes out."""

    def query(spark, sf_dir):
        out = parse(_records(spark, sf_dir), CONFIG)
        out = out.where(_claimed() == query_name)
        shown = {f: F.date_format(X.known_value(F.col(f)), "yyyy-MM-dd HH:mm:ss") if f == "timestamp" else X.known_value(F.col(f)) for f in names}
        if query_name in ("parsed_tokens", "parsed_untimed"):
            shown["status"] = F.coalesce(shown["status"], F.lit(0))
        return out.select("line_no", "parser", *[c.alias(f) for f, c in shown.items()])

    return query


def timestamp_families(spark, sf_dir):
    """One literal of each family for every event."""
    e = _events(spark, sf_dir).withColumn("ts", F.date_trunc("second", "ts"))
    shapes = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "'['yyyy-MM-dd HH:mm:ss,'000]'", "yyyyMMdd-HH:mm:ss:'000'", "yyyy-MM-dd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss '+0000'", "yyMMdd HHmmss", "'['M.dd HH:mm:ss']'", "yy/MM/dd HH:mm:ss", "MMM dd HH:mm:ss"]
    text = F.when(F.col("event_id") % 10 == 9, F.unix_timestamp("ts").cast("string"))
    for k, s in enumerate(shapes):
        text = text.when(F.col("event_id") % 10 == k, F.date_format("ts", s))
    found = e.withColumn("text", F.concat(F.lit("x "), text, F.lit(" y")))
    out = found.select("line_no", F.inline(F.array(timestamp(F.col("text"), CONFIG))))
    return out.select("line_no", F.date_format("value", "yyyy-MM-dd HH:mm:ss").alias("ts"), "state", "confidence", "source")


def quarantine_split(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy("verdict", "parser").agg(F.count("*").alias("n"), F.count_if(M.is_error()).alias("errors"))


def quarantine_strict(spark, sf_dir):
    config = Config(threshold=0.8, profile="strict", reference_year=2024)
    return _gated(spark, sf_dir, config).groupBy("verdict").agg(F.count("*").alias("n"))


def quarantine_forensics(spark, sf_dir):
    config = Config(profile="forensics", reference_year=2024)
    return _gated(spark, sf_dir, config).groupBy("verdict", F.coalesce("timestamp.source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"))


def quarantine_reasons(spark, sf_dir):
    return G.reasons(_gated(spark, sf_dir))


def quarantine_context(spark, sf_dir):
    return G.context_before(_records(spark, sf_dir)).select("line_no", F.size("context_before").alias("n"), F.length(F.element_at("context_before", -1)).alias("last_length")).where("n > 0").select("line_no", "n")


def record_groups(spark, sf_dir):
    """Every third event is followed by as many stack lines as its id modulo 60 says."""
    e = _events(spark, sf_dir).select("event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 60).otherwise(0).cast("int").alias("more"))
    rows = e.select("event_id", "event_type", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("k"))
    lines = rows.select(F.concat(F.lit("file"), F.col("event_id") % 4).alias("file"), (F.col("event_id") * 100 + F.col("k")).alias("line_no"), F.when(F.col("k") == 0, F.concat(F.lit("2024-01-01 00:00:00 ERROR "), "event_type")).otherwise(F.concat(F.lit("    at frame"), F.col("k"))).alias("value"))
    return assemble(lines).select("file", "line_no", "n_lines", F.length("raw").alias("length"))


def format_distribution(spark, sf_dir):
    return M.format_distribution(_gated(spark, sf_dir)).select("format", "n", F.round("share", 9).alias("share"))


def format_drift(spark, sf_dir):
    e = _events(spark, sf_dir).select("line_no", F.when(F.floor(F.col("event_id") / 170) % 2 == 0, "json").otherwise("kv").alias("format"))
    return M.drift(e)


def file_profile(spark, sf_dir):
    out = M.file_profile(_gated(spark, sf_dir))
    return out.select(F.explode("parsers").alias("parser", "n"), F.round("parse_rate", 9).alias("parse_rate"), F.round("offset_rate", 9).alias("offset_rate"), "naive_policy")


def data_quality(spark, sf_dir):
    return M.data_quality(_gated(spark, sf_dir)).select("field", "known", "unknown", "absent", *[F.round(c, 9).alias(c) for c in ("known_rate", "mean_confidence")])


def time_span(spark, sf_dir):
    out = M.time_span(_events(spark, sf_dir))
    return out.select("n", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "span_seconds")


def reference_years(spark, sf_dir):
    return reference_year(rendered(spark, sf_dir), 2030)


def keywords_top(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return M.keywords(docs, order="doc_id")


def activity_keys(spark, sf_dir):
    out = _gated(spark, sf_dir).where("verdict = 'accepted'").groupBy(M.activity_key().alias("key")).agg(F.count("*").alias("n"))
    return out


def error_templates(spark, sf_dir):
    out = T.by_mask(T.errors(_gated(spark, sf_dir)))
    return out.select("template", "n", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"))


def error_tree(spark, sf_dir):
    return T.by_tree(T.errors(_gated(spark, sf_dir))).select("template", "n", F.array_join("endpoints", ",").alias("endpoints"))


def health_badge(spark, sf_dir):
    rows = _gated(spark, sf_dir).cache()
    found = anomalies(M.accepted_series(rows, CONFIG), M.quarantine_series(rows, CONFIG))
    return R.health(M.totals(rows), found).select("health", "total", F.round("error_rate", 9).alias("error_rate"), F.round("quarantine_rate", 9).alias("quarantine_rate"))


def _report(make):
    def query(spark, sf_dir):
        parsed = _gated(spark, sf_dir).cache()
        return make(tables(parsed, CONFIG))

    return query


def stream_error_rate(spark, sf_dir):
    """The same windows as a batch, from a stream of `events` processed to its end."""
    stream = _stream(spark, sf_dir)
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("error")).withWatermark("ts", "0 seconds")
    out = rows.groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.count_if("error").alias("hits"))
    return run_available(out.select(F.unix_timestamp("w.start").alias("bucket"), "n", "hits"), _named("stream_error_rate", sf_dir))


def stream_log_error_rate(spark, sf_dir):
    """Lines rendered from a stream of `events`, parsed, gated and counted in windows; no row is late in complete mode."""
    lines = render(spark, _stream(spark, sf_dir)).select("file", "line_no", F.col("value").alias("raw"), F.lit(1).alias("n_lines"))
    return run_available(error_windows(gated(lines, CONFIG), CONFIG), _named("stream_log_error_rate", sf_dir))


def stream_endpoints(spark, sf_dir):
    """Endpoints of rendered lines, counted by key in a stream's state."""
    lines = render(spark, _stream(spark, sf_dir)).select("file", "line_no", F.col("value").alias("raw"), F.lit(1).alias("n_lines"))
    return run_available(endpoint_counts(gated(lines, CONFIG)), _named("stream_endpoints", sf_dir))


def stream_late_rows(spark, sf_dir):
    """Rows in order, each late where its file has seen a newer bucket; added up over batches."""
    e = _stream(spark, sf_dir).select(F.lit("events").alias("file"), ((F.col("event_id") + (F.col("event_id") * 37) % 20) * 1000 + F.col("event_id") % 1000).alias("line_no"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("error"))
    out = run_available(rolling(e, 3600), _named("stream_late_rows", sf_dir), "append")
    return out.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "late")])


def _named(name, sf_dir):
    return f"{name}_{zlib.crc32(sf_dir.encode())}"


def _stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not path.endswith(".parquet") or _is_dir(spark, path) else f"{sf_dir}/events.parque[t]")


def _is_dir(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


_PARSED = {
    "parsed_json": (0, ["timestamp", "level", "ip", "method", "path", "status", "latency_ms", "message"]),
    "parsed_clf": (1, ["timestamp", "ip", "method", "path", "status", "message"]),
    "parsed_syslog": (2, ["timestamp", "level", "message"]),
    "parsed_kv": (3, ["timestamp", "level", "method", "path", "status", "latency_ms", "message"]),
    "parsed_delimited": (4, ["timestamp", "level", "ip", "method", "path", "status", "latency_ms"]),
    "parsed_tokens": (5, ["timestamp", "level", "status", "message"]),
    "parsed_bsd": (6, ["timestamp", "message"]),
}


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [error_rate_overall, error_rate_buckets, error_rate_late, error_anomalies, latency_percentiles, endpoint_table, endpoint_overflow, endpoint_trend, format_probe, timestamp_families, quarantine_split, quarantine_strict, quarantine_forensics, quarantine_reasons, quarantine_context, record_groups, format_distribution, format_drift, file_profile, data_quality, time_span, reference_years, keywords_top, activity_keys, error_templates, error_tree, health_badge, stream_error_rate, stream_log_error_rate, endpoints_by_volume, endpoints_by_latency, endpoints_failing, endpoint_slowest, keywords_shown, format_mix, weakest_fields, quality_score, overview, per_file, per_file_series, late_rows, quarantine_series, learned_years, zoned_times, loose_dates, stream_endpoints, stream_late_rows]
    made = {name: _parsed(name, names) for name, (_, names) in _PARSED.items()} | {"parsed_untimed": _parsed("parsed_untimed", ["status", "message"])}
    reports = {"summary_report": _report(R.summary), "json_report": _report(lambda t: R.document(t, CONFIG)), "insights": _report(R.insights), "rate_bars": _report(lambda t: R.bars(t["error_series"]))}
    return {f.__name__: f for f in plain} | made | reports


_TRUTH = """
WITH r AS (
  SELECT event_id + 1 AS line_no, event_id, date_trunc('second', ts) AS ts, event_type, user_id, round(value, 2) AS ms, event_id % 7 AS kind,
         '10.0.' || (user_id % 200) || '.' || (event_id % 200 + 1) AS ip, '/' || event_type || '/' || (user_id % 10) AS path,
         CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method, event_type || ' by user ' || user_id AS message,
         event_id % 14 <> 6 AS ok, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS timestamp,
         event_type = 'error' OR (event_id % 7 >= 5 AND user_id BETWEEN 500 AND 599) AS err,
         CASE WHEN event_id % 7 = 5 OR event_id % 14 = 13 THEN 'tokenExtractor' WHEN event_id % 14 = 6 THEN 'tokenExtractor'
              ELSE (['json', 'clf', 'syslog', 'kv', 'delimited'])[event_id % 7 + 1] END AS parser
  FROM events)
"""


#: How sure each field of a record is: positive where known, negative where unknown, null where absent.
_QUALITY = " UNION ALL ".join(
    f"SELECT '{field}' AS field, {sure} AS sure FROM r"
    for field, sure in {
        "timestamp": "CASE WHEN kind IN (0, 2, 3, 4) THEN 0.95 WHEN kind = 1 THEN 0.93 WHEN kind = 5 THEN 0.7225 WHEN ok THEN 0.5625 END",
        "ip": "CASE WHEN kind IN (0, 1, 4) THEN 0.95 END",
        "method": "CASE WHEN kind IN (0, 1, 3, 4) THEN 0.99 WHEN kind >= 5 THEN -0.3 END",
        "path": "CASE WHEN kind IN (0, 1, 3, 4) THEN 0.95 END",
        "status": "CASE WHEN kind IN (0, 1, 3, 4) OR (kind >= 5 AND user_id BETWEEN 100 AND 599) THEN 0.9 WHEN kind >= 5 AND user_id BETWEEN 600 AND 999 THEN -0.4 END",
        "latency_ms": "CASE WHEN kind IN (0, 3, 4) THEN 0.95 WHEN kind >= 5 THEN -0.5 END",
        "level": "CASE WHEN kind IN (0, 3, 4, 5) OR (kind IN (2, 6) AND event_type = 'error') THEN 0.98 WHEN kind = 2 THEN 0.95 END",
        "message": "CASE WHEN kind <> 4 THEN 1.0 END",
    }.items()
)


def core_oracle_sql() -> dict[str, str]:
    hour = "CAST(floor(epoch_us(ts) / 3600000000.0) * 3600 AS BIGINT)"
    six = "CAST(floor(epoch_us(ts) / 21600000000.0) * 21600 AS BIGINT)"
    series = "s AS (SELECT b AS bucket, count(*) AS n, count(*) FILTER (err) AS hits, count(*) FILTER (err) / count(*)::DOUBLE AS rate FROM k GROUP BY b)"
    parsed = {}
    for name, (kind, names) in _PARSED.items():
        where = f"kind = {kind}" if kind != 6 else "event_id % 14 = 13"
        columns = []
        for f in names:
            if name == "parsed_clf" and f == "message":
                columns.append("method || ' ' || path || ' HTTP/1.1' AS message")
            elif name == "parsed_tokens" and f == "message":
                columns.append("timestamp || ' [' || level || '] worker: ' || message AS message")
            elif name == "parsed_bsd" and f == "message":
                columns.append("strftime(ts, '%b %d %H:%M:%S') || ' host worker[' || user_id || ']: ' || message AS message")
            elif name == "parsed_tokens" and f == "status":
                columns.append("CASE WHEN user_id BETWEEN 100 AND 599 THEN user_id ELSE 0 END AS status")
            else:
                columns.append({"latency_ms": "ms AS latency_ms"}.get(f, f))
        parsed[name] = f"{_TRUTH} SELECT line_no, parser, {', '.join(columns)} FROM r WHERE {where}"
    parsed["parsed_untimed"] = f"{_TRUTH} SELECT line_no, parser, CASE WHEN user_id BETWEEN 100 AND 599 THEN user_id ELSE 0 END AS status, 'no time here ' || message AS message FROM r WHERE NOT ok"
    # Endpoints by user and type, as in endpoint_overflow, with p99.
    ends = "k AS (SELECT 'u' || user_id || ':' || event_type AS k0, event_id + 1 AS l, event_type = 'error' AS err, value FROM events), f AS (SELECT k0, row_number() OVER (ORDER BY min(l), k0) AS r FROM k GROUP BY k0), ends AS (SELECT CASE WHEN r <= 200 THEN k0 ELSE '(other)' END AS key, count(*) AS n, count(*) FILTER (err) AS errors, quantile_cont(value, 0.99) AS p99, min(l) AS first_line FROM k JOIN f USING (k0) GROUP BY 1)"
    lateness = "k0 AS (SELECT event_id, " + hour + " AS b, event_type = 'error' AS err, (event_id + event_id * 37 % 20) * 1000 + event_id % 1000 AS o FROM events), k AS (SELECT *, max(b) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING) AS top FROM k0)"
    words = "t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{2,}')) AS token, generate_subscripts(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{2,}'), 1) AS pos FROM documents), c AS (SELECT token, count(*) AS n, min((doc_id, pos)) AS first FROM t WHERE token NOT IN ('the', 'and', 'for', 'with', 'from', 'http', 'true', 'false') GROUP BY token), w AS (SELECT token, n FROM c ORDER BY first LIMIT 500)"
    glyphs = "'▁▂▃▄▅▆▇█'"
    return parsed | {
        "endpoints_by_volume": f"WITH {ends} SELECT key, n, errors FROM ends ORDER BY key = '(other)', n DESC, first_line LIMIT 10",
        "endpoints_by_latency": f"WITH {ends} SELECT key, n, round(p99, 6) AS p99 FROM ends ORDER BY key = '(other)', ends.p99 DESC, first_line LIMIT 25",
        "endpoints_failing": "WITH k AS (SELECT event_type || (user_id % 5) AS key, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, min(event_id) AS f FROM events GROUP BY 1), t AS (SELECT * FROM k ORDER BY errors / n::DOUBLE DESC, f LIMIT 8) SELECT key, n, errors FROM t WHERE n >= 3 AND errors > 0",
        "endpoint_slowest": f"WITH {ends}, t AS (SELECT * FROM ends ORDER BY key = '(other)', p99 DESC, first_line LIMIT 1) SELECT key, n, round(p99, 6) AS p99 FROM t WHERE n >= 3 AND t.p99 > 0",
        "keywords_shown": f"WITH {words} SELECT token, n FROM w ORDER BY n DESC, token LIMIT 15",
        "format_mix": f"{_TRUTH} SELECT parser AS format, round(100.0 * count(*) / sum(count(*)) OVER (), 0)::INTEGER AS percent, count(*) AS n FROM r WHERE ok GROUP BY parser ORDER BY n DESC, format LIMIT 4",
        "weakest_fields": f"{_TRUTH}, c AS ({_QUALITY}) SELECT field, round(count(*) FILTER (sure > 0) / count(*)::DOUBLE, 9) AS known_rate FROM c GROUP BY field ORDER BY count(*) FILTER (sure > 0), field LIMIT 3",
        "quality_score": f"{_TRUTH}, c AS ({_QUALITY}) SELECT round(count(*) FILTER (sure > 0) / count(*)::DOUBLE, 9) AS score FROM c",
        "overview": f"{_TRUTH} SELECT count(*) AS total, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS quarantined, round(100.0 * count(*) FILTER (ok) / count(*), 6) AS accept_pct, round(100.0 * count(*) FILTER (NOT ok) / count(*), 6) AS quarantine_pct, round(100.0 * count(*) FILTER (ok AND err) / count(*) FILTER (ok), 6) AS error_pct, round(count(*) / 2.0, 6)::DOUBLE AS throughput FROM r",
        "per_file": f"{_TRUTH} SELECT 'f' || (line_no % 3) AS file, count(*) AS total, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS quarantined, count(*) FILTER (ok AND err) AS errors, round(count(*) FILTER (ok AND err) / count(*) FILTER (ok)::DOUBLE, 9) AS error_rate FROM r GROUP BY 1",
        "per_file_series": f"SELECT {six} AS bucket, count(*) AS n, count(*) FILTER (event_type = 'error') AS hits FROM events GROUP BY 1",
        "late_rows": f"WITH {lateness} SELECT event_id, b AS bucket FROM k WHERE b < top",
        "stream_late_rows": f"WITH {lateness} SELECT b AS bucket, count(*) FILTER (b = top) AS n, count(*) FILTER (b = top AND err) AS hits, count(*) FILTER (b < top) AS late FROM k GROUP BY b",
        "quarantine_series": f"{_TRUTH} SELECT {six} AS bucket, count(*) AS n, 0::BIGINT AS hits FROM r WHERE ok GROUP BY 1",
        "learned_years": f"{_TRUTH} SELECT line_no, timestamp AS ts FROM r WHERE event_id % 14 = 13",
        "zoned_times": "WITH w AS (SELECT event_id + 1 AS line_no, 1704067200 + event_id * 3600 % 31536000 AS s FROM events) SELECT line_no, (s + CASE WHEN s >= 1710039600 AND s < 1730595600 THEN 18000 WHEN s >= 1730595600 AND s < 1730599200 THEN 18000 ELSE 21600 END)::BIGINT AS seconds, 0.7225::DOUBLE AS confidence FROM w",
        "loose_dates": "SELECT event_id + 1 AS line_no, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M') ELSE strftime(ts, '%Y-%m-%d 00:00') END AS ts, 0.578::DOUBLE AS confidence, 'configured_local' AS source FROM events",
        "stream_endpoints": f"{_TRUTH} SELECT CASE WHEN kind IN (0, 1, 3, 4) THEN path WHEN kind = 2 THEN 'msg:' || event_type || '-user' WHEN kind = 5 THEN 'msg:' || lower(level) || '-worker-' || event_type || '-user' ELSE 'msg:host-worker-' || event_type || '-user' END AS key, count(*) AS n, count(*) FILTER (err) AS errors FROM r WHERE ok GROUP BY 1",
        "rate_bars": f"{_TRUTH}, k AS (SELECT {six} AS b, err FROM r WHERE ok), {series}, t AS (SELECT bucket, rate FROM s ORDER BY bucket DESC LIMIT 12), p AS (SELECT max(rate) AS peak FROM t) SELECT string_agg(CASE WHEN rate > 0 THEN substr({glyphs}, CAST(floor(rate / peak * 7) AS INTEGER) + 1, 1) ELSE substr({glyphs}, 1, 1) END, '' ORDER BY bucket) AS bars FROM t, p",
        "error_rate_overall": f"{_TRUTH} SELECT count(*) AS total, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS quarantined, count(*) FILTER (ok AND err) AS errors, round(count(*) FILTER (ok AND err) / count(*) FILTER (ok)::DOUBLE, 9) AS error_rate FROM r",
        "error_rate_buckets": f"{_TRUTH}, k AS (SELECT {six} AS b, err FROM r WHERE ok), {series} SELECT bucket, n, hits, round(rate, 9) AS rate FROM s",
        "error_rate_late": f"WITH k0 AS (SELECT {hour} AS b, event_type = 'error' AS err, (event_id + event_id * 37 % 20) * 1000 + event_id % 1000 AS o FROM events), k AS (SELECT *, max(b) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING) AS top FROM k0) SELECT b AS bucket, count(*) AS n, count(*) FILTER (err) AS hits FROM k WHERE b = top GROUP BY b",
        "error_anomalies": f"WITH k AS (SELECT {hour} AS b, event_type = 'error' AS err FROM events), {series}, w AS (SELECT bucket, rate, median(rate) OVER z AS baseline, mad(rate) OVER z AS d, count(*) OVER z AS c FROM s WINDOW z AS (ORDER BY bucket ROWS 59 PRECEDING)), v AS (SELECT *, CASE WHEN d = 0 AND rate = baseline THEN 0 ELSE 0.6745 * (rate - baseline) / CASE WHEN d = 0 THEN 1e-4 ELSE d END END AS zz FROM w WHERE c >= 20) SELECT bucket, round(rate, 6) AS rate, round(baseline, 6) AS baseline, round(zz, 6) AS z, CASE WHEN zz > 0 THEN 'up' ELSE 'down' END AS direction FROM v WHERE abs(zz) > 2",
        # JSON, key=value and pipes carry a latency; where the token scan takes a user's number for a status, its latency is unknown.
        "latency_percentiles": f"{_TRUTH}, k AS (SELECT CASE WHEN kind IN (0, 3, 4) THEN ms END AS ms FROM r WHERE kind IN (0, 3, 4) OR (kind >= 5 AND ok AND user_id BETWEEN 100 AND 599)) SELECT count(ms) AS n, 0::BIGINT AS n_low, count(*) - count(ms) AS n_unknown, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99, round(min(ms), 6) AS min, round(max(ms), 6) AS max FROM k",
        "endpoint_table": "SELECT event_type AS key, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS error_rate, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(event_id) + 1 AS first_line FROM events GROUP BY 1",
        "endpoint_overflow": "WITH k AS (SELECT 'u' || user_id || ':' || event_type AS k0, event_id + 1 AS l, event_type = 'error' AS err, value FROM events), f AS (SELECT k0, row_number() OVER (ORDER BY min(l), k0) AS r FROM k GROUP BY k0) SELECT CASE WHEN r <= 200 THEN k0 ELSE '(other)' END AS key, count(*) AS n, count(*) FILTER (err) AS errors, round(quantile_cont(value, 0.5), 6) AS p50, min(l) AS first_line FROM k JOIN f USING (k0) GROUP BY 1",
        "endpoint_trend": "WITH k AS (SELECT user_id::VARCHAR AS key, event_id AS l, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events), a AS (SELECT key, list(v ORDER BY l) AS x, count(*) AS n FROM k WHERE r <= 20 GROUP BY key), h AS (SELECT key, n, list_sort(x[1:n // 2]) AS o, list_sort(x[n // 2 + 1:n]) AS w FROM a), m AS (SELECT key, n, o[len(o) // 2 + 1] AS o, w[len(w) // 2 + 1] AS w FROM h) SELECT key, CASE WHEN n < 10 OR o <= 0 THEN 'STABLE' WHEN w / o > 1.15 THEN 'DEGRADING' WHEN w / o < 0.85 THEN 'IMPROVING' ELSE 'STABLE' END AS trend FROM m",
        "format_probe": f"{_TRUTH} SELECT line_no, CASE WHEN parser = 'tokenExtractor' THEN 'unknown' ELSE parser END AS hint, CASE parser WHEN 'json' THEN 0.95 WHEN 'clf' THEN 0.85 WHEN 'syslog' THEN 0.9 WHEN 'kv' THEN 0.8 WHEN 'delimited' THEN 0.65 ELSE 0.0 END::DOUBLE AS confidence FROM r",
        "timestamp_families": "SELECT event_id + 1 AS line_no, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts, 'known' AS state, CASE event_id % 10 WHEN 0 THEN 0.95 WHEN 1 THEN 0.748 WHEN 2 THEN 0.714 WHEN 3 THEN 0.7225 WHEN 4 THEN 0.9 WHEN 5 THEN 0.697 WHEN 6 THEN 0.612 WHEN 7 THEN 0.663 WHEN 8 THEN 0.5625 ELSE 0.75 END::DOUBLE AS confidence, CASE WHEN event_id % 10 IN (0, 4, 9) THEN 'explicit_offset' WHEN event_id % 10 = 8 THEN 'syslog_assumption' ELSE 'configured_local' END AS source FROM events",
        "quarantine_split": f"{_TRUTH} SELECT CASE WHEN ok THEN 'accepted' ELSE 'quarantined' END AS verdict, parser, count(*) AS n, count(*) FILTER (err) AS errors FROM r GROUP BY 1, 2",
        "quarantine_strict": f"{_TRUTH} SELECT CASE WHEN kind < 5 THEN 'accepted' ELSE 'quarantined' END AS verdict, count(*) AS n FROM r GROUP BY 1",
        "quarantine_forensics": f"{_TRUTH} SELECT 'accepted' AS verdict, CASE WHEN NOT ok THEN 'ingestion_fallback' WHEN event_id % 14 = 13 THEN 'syslog_assumption' WHEN kind IN (1, 5) THEN 'configured_local' ELSE 'explicit_offset' END AS source, count(*) AS n FROM r GROUP BY 1, 2",
        "quarantine_reasons": f"{_TRUTH} SELECT 'Missing or unparseable timestamp' AS reason, count(*) AS n FROM r WHERE NOT ok HAVING count(*) > 0",
        "record_groups": "WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN event_id % 60 ELSE 0 END AS more FROM events), l AS (SELECT *, unnest(range(0, more + 1)) AS k FROM e), p AS (SELECT *, k // 50 AS part, CASE WHEN k = 0 THEN 26 + length(event_type) ELSE 12 + length(k::VARCHAR) END AS len FROM l) SELECT 'file' || (event_id % 4) AS file, min(event_id * 100 + k) AS line_no, count(*)::INTEGER AS n_lines, (sum(len) + count(*) - 1)::INTEGER AS length FROM p GROUP BY event_id, part",
        "format_distribution": f"{_TRUTH}, t AS (SELECT CASE WHEN ok THEN parser ELSE 'quarantined' END AS format FROM r ORDER BY line_no DESC LIMIT 100) SELECT format, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM t GROUP BY format",
        "format_drift": "WITH f AS (SELECT event_id + 1 AS l, (event_id // 170) % 2 AS kv FROM events), w AS (SELECT l, kv, sum(kv) OVER z AS n, count(*) OVER z AS c, first_value(kv) OVER z AS head FROM f WINDOW z AS (ORDER BY l ROWS 99 PRECEDING)), d AS (SELECT l, CASE WHEN n * 2 > c OR (n * 2 = c AND head = 1) THEN 'kv' ELSE 'json' END AS lead FROM w), p AS (SELECT l, lead, lag(lead) OVER (ORDER BY l) AS before FROM d) SELECT l AS line_no, before AS from_format, lead AS to_format FROM p WHERE before <> lead",
        "file_profile": f"{_TRUTH}, a AS (SELECT count(*) FILTER (ok) AS ok_, count(*) AS all_, count(*) FILTER (ok AND kind IN (0, 2, 3, 4)) AS off_ FROM r) SELECT parser, count(*) AS n, round(any_value(ok_) / any_value(all_)::DOUBLE, 9) AS parse_rate, round(any_value(off_) / any_value(ok_)::DOUBLE, 9) AS offset_rate, CASE WHEN any_value(off_) > any_value(ok_) - any_value(off_) THEN 'utc' ELSE 'local' END AS naive_policy FROM r, a WHERE ok GROUP BY parser",
        "data_quality": f"{_TRUTH}, c AS ({_QUALITY}) SELECT field, count(*) FILTER (sure > 0) AS known, count(*) FILTER (sure < 0) AS unknown, count(*) FILTER (sure IS NULL) AS absent, round(count(*) FILTER (sure > 0) / count(*)::DOUBLE, 9) AS known_rate, round(coalesce(avg(sure) FILTER (sure > 0), 0.0), 9) AS mean_confidence FROM c GROUP BY field",
        "activity_keys": f"{_TRUTH} SELECT CASE WHEN kind IN (0, 1, 3, 4) THEN path WHEN kind = 2 THEN 'msg:' || event_type || '-user' WHEN kind = 5 THEN 'msg:' || lower(level) || '-worker-' || event_type || '-user' ELSE 'msg:host-worker-' || event_type || '-user' END AS key, count(*) AS n FROM r WHERE ok GROUP BY 1",
        "time_span": "SELECT count(*) AS n, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span_seconds FROM events",
        "reference_years": "SELECT 'events' AS file, 2024 AS year",
        "keywords_top": "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{2,}')) AS token, generate_subscripts(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{2,}'), 1) AS pos FROM documents), c AS (SELECT token, count(*) AS n, min((doc_id, pos)) AS first FROM t WHERE token NOT IN ('the', 'and', 'for', 'with', 'from', 'http', 'true', 'false') GROUP BY token) SELECT token, n FROM c ORDER BY first LIMIT 500",
        "error_templates": f"{_TRUTH}, e AS (SELECT ts, CASE kind WHEN 1 THEN method || ' ' || path || ' HTTP/1.1' WHEN 4 THEN timestamp_iso || '|' || ip WHEN 5 THEN timestamp || ' [' || level || '] worker: ' || message WHEN 6 THEN strftime(ts, '%b %d %H:%M:%S') || ' host worker[' || user_id || ']: ' || message ELSE message END AS t, kind, level, method, path FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_iso FROM r) WHERE ok AND err) SELECT CASE WHEN kind = 4 THEN '|' || level || '|<ip>|' || method || regexp_replace('|' || path || '|', '[0-9]+', '<n>', 'g') || '<n>|<n>.<n>ms' ELSE regexp_replace(t, '[0-9]+', '<n>', 'g') END AS template, count(*) AS n, min(epoch_us(ts)) AS first_seen, max(epoch_us(ts)) AS last_seen FROM e GROUP BY 1",
        "health_badge": f"{_TRUTH}, a AS (SELECT count(*) AS total, count(*) FILTER (ok AND err) / count(*) FILTER (ok)::DOUBLE AS e, count(*) FILTER (NOT ok) / count(*)::DOUBLE AS q FROM r) SELECT CASE WHEN e >= 0.1 OR q >= 0.15 THEN 'CRITICAL' WHEN e >= 0.02 OR q >= 0.05 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health, total, round(e, 9) AS error_rate, round(q, 9) AS quarantine_rate FROM a",
        "stream_error_rate": f"SELECT {six} AS bucket, count(*) AS n, count(*) FILTER (event_type = 'error') AS hits FROM events GROUP BY 1",
        "stream_log_error_rate": f"{_TRUTH}, k AS (SELECT {six} AS bucket, err FROM r WHERE ok) SELECT bucket, count(*) AS n, count(*) FILTER (err) AS hits FROM k GROUP BY bucket",
        "quarantine_context": "SELECT event_id + 1 AS line_no, least(event_id, 5)::INTEGER AS n FROM events WHERE event_id > 0",
    }
