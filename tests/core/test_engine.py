"""The engine: parsers, assembly, gate and metrics on small inputs, and registered queries against their SQL."""

import datetime as dt
import gzip

import duckdb
import pytest
from pyspark.sql import functions as F

from logweir.config import Config
from logweir.functions import fields as X
from logweir.functions.probe import delimiter, probe
from logweir.functions.timestamps import timestamp
from logweir.operators import metrics as M
from logweir.operators.gate import gate
from logweir.operators.parsers import parse
from logweir.operators.records import assemble, balance, fold
from logweir.operators.templates import match
from logweir.plans.catalog import core_oracle_sql, core_queries
from logweir.plans.engine import analyze
from logweir.sources.text import read_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["error_rate_buckets", "error_rate_late", "error_anomalies", "endpoint_trend", "record_groups", "format_drift", "keywords_top", "parsed_json", "parsed_delimited", "error_templates", "quarantine_split", "stream_error_rate"])
def test_query_matches_sql(spark, duck, name):
    want = duck.sql(core_oracle_sql()[name]).df()
    got = core_queries()[name](spark, SF).toPandas()[list(want.columns)]
    rows = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def times(spark, texts, config):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", F.inline(F.array(timestamp(F.col("text"), config))))
    return [(r.value and f"{r.value:%Y-%m-%d %H:%M:%S}", r.state, round(r.confidence, 4), r.source) for r in rows.withColumn("value", F.col("value").cast("timestamp_ntz")).orderBy("k").collect()]


def test_timestamp_families(spark):
    cases = [
        ("2024-03-15T14:23:01+02:00", "2024-03-15 12:23:01", 0.95, "explicit_offset"),
        ("2024-03-15T14:23:01.250-0130", "2024-03-15 15:53:01", 0.95, "explicit_offset"),
        ("2024-03-15T14:23:01", "2024-03-15 14:23:01", 0.8075, "configured_local"),
        ("[Sun Dec 04 04:47:44 2005]", "2005-12-04 04:47:44", 0.782, "configured_local"),
        ("10/Oct/2000:13:55:36 -0700", "2000-10-10 20:55:36", 0.9, "explicit_offset"),
        ("[2024-03-15 14:23:03,456]", "2024-03-15 14:23:03", 0.748, "configured_local"),
        ("20171223-22:15:29:606|Step", "2017-12-23 22:15:29", 0.714, "configured_local"),
        ("at 2024-03-15 14:23:03.5 it", "2024-03-15 14:23:03", 0.7225, "configured_local"),
        ("081109 203615 148 INFO", "2008-11-09 20:36:15", 0.697, "configured_local"),
        ("[10.30 16:49:06]", "2024-10-30 16:49:06", 0.612, "configured_local"),
        ("17/06/09 20:10:40 INFO", "2017-06-09 20:10:40", 0.663, "configured_local"),
        ("Oct 11 22:14:15 host su", "2024-10-11 22:14:15", 0.5625, "syslog_assumption"),
        ("t=1718000000.123", "2024-06-10 06:13:20", 0.78, "explicit_offset"),
        ("1718000000", "2024-06-10 06:13:20", 0.75, "explicit_offset"),
        ("1718000000123", "2024-06-10 06:13:20", 0.8, "explicit_offset"),
    ]
    got = times(spark, [c[0] for c in cases], Config(reference_year=2024))
    assert got == [(when, "known", sure, source) for _, when, sure, source in cases]
    # No such day, no time, a year out of bounds; a sure time beats a number that is none.
    odd = times(spark, ["2024-02-30T00:00:00Z", "", None, "2099-01-01 00:00:00", "call 9876543210 at 2024-01-02 03:04:05"], Config())
    assert [x[:2] for x in odd] == [(None, "absent"), (None, "absent"), (None, "absent"), ("2099-01-01 00:00:00", "unknown"), ("2024-01-02 03:04:05", "known")]
    assert odd[3][2] == 0.4


def test_years_of_times_without_one(spark):
    config = Config(run_ts="2024-03-10 00:00:00")
    assert [x[0] for x in times(spark, ["Mar 12 00:00:00", "Apr 20 00:00:00", "[12.31 23:59:59]"], config)] == ["2024-03-12 00:00:00", "2023-04-20 00:00:00", "2023-12-31 23:59:59"]


def test_local_zone(spark):
    zone = Config(log_tz="America/Chicago")
    assert times(spark, ["2024-03-15 14:23:03", "2024-03-10 02:30:00", "2024-11-03 01:30:00"], zone) == [(w, "known", 0.7225, "configured_local") for w in ("2024-03-15 19:23:03", "2024-03-10 08:30:00", "2024-11-03 06:30:00")]
    assert times(spark, ["2024-03-15 14:23:03"], Config(log_tz="America/Chicago", naive_policy="utc")) == [("2024-03-15 14:23:03", "known", 0.68, "configured_utc")]


def parsed(spark, *texts, config=None):
    rows = spark.createDataFrame([("f", i, t, 1) for i, t in enumerate(texts)], "file string, line_no long, raw string, n_lines int")
    return parse(rows, config or Config()).orderBy("line_no").collect()


def test_parsers_merge_and_fall_back(spark):
    json_, syslog, scan, broken, bsd, ltsv, names, kv, nested, nothing = parsed(
        spark,
        'prefix {"ts":"2024-01-01T00:00:00Z","duration":"2s","status":503} tail',
        "<34>1 2024-01-01T00:00:00Z h app 1 ID - su failed",
        "2024-01-01 00:00:00 GET /a?b=1 200 12ms [ERROR] 10.0.0.1",
        "{broken",
        "<165>Oct 11 22:14:15 10.1.2.3 WARN low disk",
        "time:2024-01-01T00:00:00Z\tstatus:404\tuser:x",
        "timestamp|level|status",
        'level=warn msg="a b" duration=7 ip=::1 level=error time=2024-01-01T00:00:00Z',
        '{"time":"2024-01-01T00:00:00Z","user":{"id":1},"method":null,"message":null,"latency_ms":3}',
        None,
    )
    assert json_.parser == "json" and json_.latency_ms.value == 2000 and json_.status.value == 503 and json_.warnings == ["text before the JSON object"]
    assert syslog.parser == "syslog" and syslog.level.value == "CRITICAL" and syslog.message.value == "su failed"
    assert scan.parser == "tokenExtractor" and (scan.path.value, scan.latency_ms.value, scan.level.value, scan.ip.value, scan.method.value, scan.status.value) == ("/a", 12.0, "ERROR", "10.0.0.1", "GET", 200)
    assert broken.parser == "json+tokenExtractor" and broken.warnings == ["no JSON object"]
    assert bsd.parser == "syslog" and (bsd.ip.value, bsd.level.value, bsd.level.confidence) == ("10.1.2.3", "WARN", 0.98) and bsd.warnings == ["the message's level overrides the priority's"]
    assert ltsv.parser == "kv" and ltsv.status.value == 404 and ltsv.timestamp.state == "known"
    assert names.parser == "delimited+tokenExtractor" and names.message.value == "timestamp | level | status"
    assert kv.level.value == "ERROR" and (kv.latency_ms.state, kv.latency_ms.value) == ("unknown", 7.0) and kv.ip.value == "::1" and kv.message.value == "a b"
    assert (nested.method.state, nested.method.value, nested.message.state, nested.latency_ms.value) == ("unknown", "NONE", "absent", 3.0)
    assert nothing.parser == "tokenExtractor" and nothing.message.value == "" and nothing.quality == 0.0


def test_probe_order_and_columns(spark):
    cases = {
        "": ("unknown", 0.0), '{"a":1}': ("json", 0.95), "<13>x": ("syslog", 0.90), '1.2.3.4 - - [10/Oct/2000:13:55:36 -0700] "GET / HTTP/1.0" 200 1': ("clf", 0.85),
        'x {"a":1}': ("json", 0.70), "a\tb\tc": ("kv", 0.75), "a=1 b=2 c=3": ("kv", 0.80), "a|b|c": ("delimited", 0.65), "a,b,c\nd\ne,f,g": ("delimited", 0.65),
        "2024-03-15T14:23:03,456, a, b": ("unknown", 0.0), "2024-03-15 14:23:03,456, a, b": ("unknown", 0.0), "a,b,c\nd,e,f,g": ("unknown", 0.0), "plain words": ("unknown", 0.0),
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, raw string").select("k", F.inline(F.array(probe(F.col("raw")))), delimiter(F.col("raw")).alias("sep")).orderBy("k").collect()
    assert [(r.hint, r.confidence) for r in rows] == list(cases.values())


def test_activity_keys(spark):
    texts = {"shutdown": "svc:shutdown", "sshd[12]: failed": "svc:sshd", "Jan 02 disk sda is full of it all": "msg:disk-sda-full-all", "a: b": "parser:tokenExtractor", "x" * 81: "msg:" + "x" * 81}
    rows = parse(spark.createDataFrame([("f", i, t, 1) for i, t in enumerate(texts)], "file string, line_no long, raw string, n_lines int"), Config())
    assert [r.key for r in rows.select("line_no", M.activity_key().alias("key")).orderBy("line_no").collect()] == list(texts.values())


def test_braces_keep_records_together():
    assert balance('{"a": "}"') == (1, False, False)
    assert fold(['{"a":', "1}", "next", "  more"], 50) == [0, 0, 1, 1]
    assert fold(["x"] + [" y"] * 4, 3) == [0, 0, 0, 1, 1]


def test_assembly_of_files_with_open_braces(spark):
    lines = spark.createDataFrame([("f", 1, '{"a":'), ("f", 2, "1}"), ("f", 3, "x"), ("g", 1, "y"), ("g", 2, "  at z")], "file string, line_no long, value string")
    got = {(r["file"], r["line_no"], r["n_lines"]) for r in assemble(lines).collect()}
    assert got == {("f", 1, 2), ("f", 3, 1), ("g", 1, 2)}


def test_gate_profiles(spark):
    rows = spark.createDataFrame([("f", 1, "2024-01-01 00:00:00 ERROR boom", 1), ("f", 2, "no time", 1), ("f", 3, "", 1)], "file string, line_no long, raw string, n_lines int")
    verdicts = lambda c: [r["verdict"] for r in gate(parse(rows, c), c).orderBy("line_no").collect()]
    assert verdicts(Config()) == ["accepted", "quarantined", "quarantined"]
    assert verdicts(Config(profile="forensics")) == ["accepted"] * 3
    assert verdicts(Config(profile="strict", threshold=0.9)) == ["quarantined"] * 3


def test_extractor_columns(spark):
    row = spark.range(1).select(X.ip(F.lit("[10.0.0.1]")).alias("a"), X.path(F.lit("https://h/x?y")).alias("b"), X.latency(F.lit("3s")).alias("c"), X.level(F.lit("[warn]")).alias("d"), X.status(F.lit("700")).alias("e"), X.ip(F.lit("2001:0DB8:0:0:0:0:0:01")).alias("f"), X.ip(F.lit("1.2.3.256")).alias("g")).first()
    assert (row.a.value, row.b.value, row.c.value, row.d.value, row.e.state) == ("10.0.0.1", "/x", 3000.0, "WARN", "unknown") and row.f.value == "2001:db8::1" and row.g.state == "unknown"


def test_keyword_cap_counts_the_first_tokens_only(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "gamma alpha")], "line_no long, text string")
    assert {(r["token"], r["n"]) for r in M.keywords(rows, most=2).collect()} == {("alpha", 2), ("beta", 1)}


def test_templates_generalize():
    assert match(["user a failed login", "user b failed login", "disk full on x y"]) == [0, 0, 1]


def test_analyze_a_gzip_file(spark, tmp_path):
    with gzip.open(tmp_path / "a.log.gz", "wt", encoding="utf-8") as f:
        f.write("﻿2024-01-01T00:00:00Z ERROR GET /a 500 10ms\n  at frame\nno time here\n")
    assert [r["line_no"] for r in read_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [1, 2, 3]
    t = analyze(spark, str(tmp_path))
    total = t["totals"].first()
    assert (total["total"], total["accepted"], total["errors"]) == (2, 1, 1)


def test_empty_input(spark):
    rows = spark.createDataFrame([], "file string, line_no long, raw string, n_lines int")
    total = M.totals(gate(parse(rows, Config()), Config())).first()
    assert total["total"] == 0 and total["error_rate"] == 0
