"""Aggregates over gated records: totals, rate series and anomalies, latency, endpoints, keywords, quality, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.config import Config
from logweir.functions import fields as X

# Fixed values.
ERROR_LEVELS = ["ERROR", "FATAL", "CRITICAL", "ERR", "EMERGENCY", "ALERT"]
STOP_WORDS = ["the", "and", "for", "with", "from", "http", "true", "false"]
_DATES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def is_error(include_4xx: bool = False) -> Column:
    """Known level of an error, or known status from 500 on (400 with `include_4xx`)."""
    level, status = X.known_value(F.col("level")), X.known_value(F.col("status"))
    return F.coalesce(level.isin(ERROR_LEVELS), F.lit(False)) | F.coalesce(status >= (400 if include_4xx else 500), F.lit(False))


def http_shaped() -> Column:
    return (F.col("path.state") == "known") | (F.col("status.state") == "known")


def activity_key() -> Column:
    """What a record is about: its path, else the program that speaks, else the first words of its message."""
    path, message = F.btrim(X.known_value(F.col("path"))), F.btrim(F.coalesce(X.known_value(F.col("message")), F.lit("")))
    head = F.btrim(F.get(F.split(message, ":"), F.lit(0)))
    program = F.when(F.length(head) <= 80, F.btrim(F.regexp_extract(head, "^([^\\[(]*)", 1)))
    pieces = F.slice(F.split(F.lower(message), "[^a-z0-9]+"), 1, 12)
    words = F.slice(F.filter(pieces, lambda x: (F.length(x) > 2) & ~x.rlike("^[0-9]+$") & ~x.isin(_DATES)), 1, 5)
    return (
        F.when(path.isNotNull() & (path != "/") & (path != ""), path)
        .when(program.rlike("^[A-Za-z][A-Za-z0-9_.-]+$"), F.concat(F.lit("svc:"), program))
        .when(F.size(words) > 0, F.concat(F.lit("msg:"), F.array_join(words, "-")))
        .otherwise(F.concat(F.lit("parser:"), "parser"))
    )


def totals(gated: DataFrame) -> DataFrame:
    """One row: total, accepted, quarantined, errors and their rates."""
    ok = F.col("verdict") == "accepted"
    out = gated.agg(F.count("*").alias("total"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("quarantined"), F.count_if(ok & is_error()).alias("errors"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumns({"error_rate": rate("errors", "accepted"), "quarantine_rate": rate("quarantined", "total")})


def on_time(rows: DataFrame, seconds: int, *, ts: str = "ts", order: str = "line_no") -> DataFrame:
    """Adds `bucket` (epoch seconds) and keeps rows that no row of their file before them overtook: a newer bucket closes
    all older ones. Rows without a `file` are of one file.

    The running maximum goes in two steps, within ranges of the order first and then over one row a range, so no task
    sees all rows.
    """
    rows = rows.where(F.col(ts).isNotNull()).withColumn("bucket", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)) * seconds)
    file = F.col("file") if "file" in rows.columns else F.lit("")
    rows = rows.withColumn("_file", file).withColumn("_part", F.floor(F.col(order) / 65536))
    tops = rows.groupBy("_file", "_part").agg(F.max("bucket").alias("_top"))
    before = tops.select("_file", "_part", F.max("_top").over(Window.partitionBy("_file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    running = F.max("bucket").over(Window.partitionBy("_file", "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("_running", running).join(before, ["_file", "_part"])
    return joined.where(F.col("bucket") >= F.greatest("_running", F.coalesce("_before", F.lit(-(2**62))))).drop("_file", "_part", "_running", "_before")


def late(rows: DataFrame, seconds: int, *, ts: str = "ts", order: str = "line_no") -> DataFrame:
    """The rows that `on_time` leaves out, each with its bucket."""
    kept = on_time(rows, seconds, ts=ts, order=order)
    keys = [c for c in ("file", order) if c in rows.columns]
    bucket = (F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)) * seconds).alias("bucket")
    return rows.where(F.col(ts).isNotNull()).select("*", bucket).join(kept.select(*keys), keys, "left_anti")


def rate_series(rows: DataFrame, flag: Column, seconds: int, **how) -> DataFrame:
    """bucket, n, hits and rate of a flag in tumbling windows of event time."""
    order = how.get("order", "line_no")
    few = [c for c in ("file", order, how.get("ts", "ts")) if c in rows.columns]
    kept = on_time(rows.select(*few, flag.alias("_flag")), seconds, **how)
    return kept.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("_flag").alias("hits")).withColumn("rate", F.col("hits") / F.col("n"))


def anomalies(series: DataFrame, threshold: float, *, least: int = 20, window: int = 60) -> DataFrame:
    """bucket, rate, baseline, z, direction where a rate's modified z-score over the last rates, itself included, passes the threshold."""
    w = Window.orderBy("bucket").rowsBetween(-(window - 1), 0)
    seen = series.select("bucket", "rate", F.percentile("rate", F.lit(0.5)).over(w).alias("baseline"), F.collect_list("rate").over(w).alias("_w"))
    d = F.array_sort(F.transform("_w", lambda x: F.abs(x - F.col("baseline"))))
    half = F.floor(F.size("_w") / 2).cast("int")
    seen = seen.withColumn("_d", d).withColumn("mad", F.when(F.size("_w") % 2 == 1, F.element_at("_d", half + 1)).otherwise((F.element_at("_d", half) + F.element_at("_d", F.greatest(half + 1, F.lit(1)))) / 2))
    z = F.when((F.col("mad") == 0) & (F.col("rate") == F.col("baseline")), 0.0).otherwise(0.6745 * (F.col("rate") - F.col("baseline")) / F.when(F.col("mad") == 0, 1e-4).otherwise(F.col("mad")))
    found = seen.where(F.size("_w") >= least).withColumn("z", z).where(F.abs("z") > threshold)
    return found.select("bucket", "rate", "baseline", "z", F.when(F.col("z") > 0, "up").otherwise("down").alias("direction"))


def latency(gated: DataFrame) -> DataFrame:
    """One row: exact percentiles of sure latencies of requests, and counts of unsure and unknown ones."""
    rows = gated.where((F.col("verdict") == "accepted") & http_shaped())
    f = F.col("latency_ms")
    sure = (f["state"] == "known") & (f["confidence"] >= 0.5) & (f["value"] <= X.MAX_MS)
    v = F.when(sure, f["value"])
    p = F.percentile(v, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = rows.agg(F.count(v).alias("n"), F.count_if((f["state"] == "known") & ~sure).alias("n_low"), F.count_if(f["state"] == "unknown").alias("n_unknown"), p.alias("p"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.select("n", "n_low", "n_unknown", *[F.get("p", F.lit(i)).alias(x) for i, x in enumerate(("p50", "p95", "p99"))], "min", "max")


def endpoints(rows: DataFrame, most: int = 200) -> DataFrame:
    """key, n, errors, error_rate, p50, p95, p99, trend, first_line. rows: key, line_no, error, ms (null: none).
    The first `most` keys by arrival have rows of their own; all others share '(other)'."""
    seen = rows.groupBy("key").agg(F.min("line_no").alias("first")).orderBy("first", "key").limit(most)
    # At most `most` keys: a bounded table.
    named = rows.join(F.broadcast(seen.select(F.col("key").alias("own"))), F.col("key") == F.col("own"), "left").withColumn("key", F.coalesce("own", F.lit("(other)"))).drop("own")
    p = F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = named.groupBy("key").agg(F.count("*").alias("n"), F.count_if("error").alias("errors"), p.alias("p"), F.min("line_no").alias("first_line"))
    out = out.select("key", "n", "errors", (F.col("errors") / F.col("n")).alias("error_rate"), *[F.get("p", F.lit(i)).alias(x) for i, x in enumerate(("p50", "p95", "p99"))], "first_line")
    return out.join(trend(named), "key", "left").withColumn("trend", F.coalesce("trend", F.lit("STABLE")))


def trend(rows: DataFrame, last: int = 20) -> DataFrame:
    """key, trend: upper medians of the older and the newer half of the last latencies of each key."""
    # In two steps, so that a hot key's rows are cut down by many tasks before they meet.
    w = Window.partitionBy("key", F.pmod(F.xxhash64("line_no"), F.lit(64))).orderBy(F.desc("line_no"))
    some = rows.where("ms is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= last)
    top = some.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("line_no")))).where(F.col("r") <= last)
    recent = top.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "ms"))), lambda x: x["ms"]).alias("ms"))
    n = F.size("ms")
    half = F.floor(n / 2).cast("int")
    upper = lambda a: F.try_element_at(F.array_sort(a), F.floor(F.size(a) / 2).cast("int") + 1)
    recent = recent.withColumn("old", upper(F.slice("ms", 1, half))).withColumn("new", upper(F.slice("ms", half + 1, n - half)))
    ratio = F.when(F.col("old") > 0, F.col("new") / F.col("old"))
    return recent.select("key", F.when(n < 10, "STABLE").when(ratio > 1.15, "DEGRADING").when(ratio < 0.85, "IMPROVING").otherwise("STABLE").alias("trend"))


def endpoint_rows(gated: DataFrame) -> DataFrame:
    return gated.where("verdict = 'accepted'").select(activity_key().alias("key"), "line_no", is_error().alias("error"), X.known_value(F.col("latency_ms")).alias("ms"))


def keywords(rows: DataFrame, *, text: str = "text", order: str = "line_no", most: int = 500) -> DataFrame:
    """token, n: counts of the first `most` distinct tokens by arrival."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_-]{2,}"), F.lit(0))
    words = rows.select(order, F.posexplode(tokens).alias("pos", "token")).where(~F.col("token").isin(STOP_WORDS))
    counts = words.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct(order, "pos")).alias("first"))
    return counts.orderBy("first").limit(most).select("token", "n")


def format_distribution(gated: DataFrame, last: int = 100) -> DataFrame:
    """format, share over the last records."""
    kind = F.when(F.col("verdict") == "accepted", F.col("parser")).otherwise("quarantined")
    recent = gated.select("line_no", kind.alias("format")).orderBy(F.desc("line_no")).limit(last)
    return recent.groupBy("format").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def drift(rows: DataFrame, last: int = 100) -> DataFrame:
    """line_no, from_format, to_format where the most frequent format of the last records changes; of equal counts the
    one that came first in the window leads. rows: line_no, format.

    Windows run in overlapping stretches of the order, so no task sees all rows."""
    size = max(65536, 4 * last)
    part = F.floor(F.col("line_no") / size)
    own = rows.select("line_no", "format", F.explode(F.array_distinct(F.array(part, F.floor((F.col("line_no") + last) / size)))).alias("part"))
    w = Window.partitionBy("part").orderBy("line_no")
    seen = own.withColumn("w", F.collect_list("format").over(w.rowsBetween(-(last - 1), 0)))
    kinds = F.array_distinct("w")
    best = F.array_max(F.transform(kinds, lambda k, i: F.struct(F.size(F.filter("w", lambda x: x == k)).alias("n"), (-i).alias("i"), k.alias("k"))))["k"]
    led = seen.withColumn("lead_", best).withColumn("from_format", F.lag("lead_").over(w))
    mine = led.where((F.floor(F.col("line_no") / size) == F.col("part")) & F.col("from_format").isNotNull() & (F.col("from_format") != F.col("lead_")))
    return mine.select("line_no", "from_format", F.col("lead_").alias("to_format"))


def file_profile(gated: DataFrame) -> DataFrame:
    """One row: records by parser and by timestamp source, share parsed and share with an offset, advice on naive times."""
    ok = gated.where("verdict = 'accepted'")
    by = ok.groupBy(F.regexp_extract("parser", "^([^+]*)", 1).alias("k")).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "count")))).alias("parsers"))
    src = ok.groupBy(F.col("timestamp.source").alias("k")).count()
    n = lambda *names: F.coalesce(F.sum(F.when(F.col("k").isin(*names), F.col("count"))), F.lit(0))
    sources = src.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("k", F.lit("none")), "count")))).alias("sources"), n("explicit_offset").alias("offsets"), n("explicit_offset", "configured_utc", "epoch_utc").alias("utc"), n("configured_local", "syslog_assumption").alias("local"))
    count = totals(gated).select("total", "accepted")
    one = by.join(sources).join(count)
    return one.select("parsers", "sources", F.when(F.col("total") > 0, F.col("accepted") / F.col("total")).otherwise(0.0).alias("parse_rate"), F.when(F.col("accepted") > 0, F.col("offsets") / F.col("accepted")).otherwise(0.0).alias("offset_rate"), F.when(F.col("utc") > F.col("local"), "utc").otherwise("local").alias("naive_policy"))


def data_quality(gated: DataFrame) -> DataFrame:
    """field, known, unknown, absent, known_rate, mean_confidence."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.state").alias("state"), F.col(f"{f}.confidence").alias("confidence")) for f in X.TYPES])
    rows = gated.select(F.explode(each).alias("x")).select("x.*")
    out = rows.groupBy("field").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("known", "unknown", "absent")], F.avg(F.when(F.col("state") == "known", F.col("confidence"))).alias("mean_confidence"))
    return out.withColumn("known_rate", F.col("known") / (F.col("known") + F.col("unknown") + F.col("absent"))).withColumn("mean_confidence", F.coalesce("mean_confidence", F.lit(0.0)))


def time_span(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: first, last, span_seconds over the year with most records where it has three and a quarter of all, else over all; n counts all."""
    known = rows.where(F.col(ts).isNotNull())
    years = known.groupBy(F.year(ts).alias("y")).agg(F.count("*").alias("n"), F.min(ts).alias("a"), F.max(ts).alias("b"))
    out = years.agg(F.sum("n").alias("n"), F.max(F.struct("n", (-F.col("y")).alias("y"), "a", "b")).alias("top"), F.min("a").alias("a"), F.max("b").alias("b"))
    main = F.col("top.n") >= F.greatest(F.lit(3), F.floor(F.col("n") / 4))
    out = out.select("n", F.when(main, F.col("top.a")).otherwise(F.col("a")).alias("first"), F.when(main, F.col("top.b")).otherwise(F.col("b")).alias("last"))
    return out.withColumn("span_seconds", (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1e6)


def per_file(gated: DataFrame) -> DataFrame:
    """file, total, accepted, quarantined, errors, their rates, and the parser that claims most: a row a file."""
    ok = F.col("verdict") == "accepted"
    out = gated.groupBy("file").agg(F.count("*").alias("total"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("quarantined"), F.count_if(ok & is_error()).alias("errors"), F.mode("parser").alias("parser"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumns({"accept_rate": rate("accepted", "total"), "quarantine_rate": rate("quarantined", "total"), "error_rate": rate("errors", "accepted")})


def accepted_series(gated: DataFrame, config: Config) -> DataFrame:
    rows = gated.where("verdict = 'accepted'").withColumn("ts", F.col("event_ts"))
    return rate_series(rows, is_error(), config.bucket_seconds)


def quarantine_series(gated: DataFrame, config: Config) -> DataFrame:
    """Records without a time are left out: they have no place on the time axis of the log."""
    return rate_series(gated.withColumn("ts", F.col("event_ts")), F.col("verdict") == "quarantined", config.bucket_seconds)
