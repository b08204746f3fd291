"""Files to reports: zones, years, context, several files, the command line, streams that draw."""

import json

import pytest
from pyspark.sql import functions as F

from logweir import cli
from logweir.config import Config, zone_named
from logweir.operators import gate as G
from logweir.operators import metrics as M
from logweir.plans import views as V
from logweir.plans.engine import analyze, release
from logweir.streaming.rates import live, stream_lines

LINES = ["2024-01-02T00:00:00Z ERROR GET /a 500 10ms", "  at frame", "Jan 02 00:00:05 host sshd[3]: failed", "no time here", '{"timestamp":"2024-01-02T00:00:07Z","path":"/b","status":200,"duration_ms":9}']


@pytest.fixture
def log(tmp_path):
    (tmp_path / "a.log").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    return str(tmp_path / "a.log")


def test_zone_names(monkeypatch):
    monkeypatch.setenv("TZ", "Asia/Tokyo")
    assert [zone_named(z) for z in ("america/chicago", "UTC", "Local", "system", "no/such")] == ["America/Chicago", "UTC", "Asia/Tokyo", "Asia/Tokyo", "UTC"]


def test_analysis_of_a_file(spark, log):
    seen = []
    t = analyze(spark, log, Config(run_ts="2031-05-01 00:00:00"), progress=lambda done, all_: seen.append((done, all_)))
    assert seen[-1] == (4, 4)
    rows = t["parsed"].orderBy("line_no").collect()
    assert [(r.line_no, r.verdict) for r in rows] == [(1, "accepted"), (3, "accepted"), (4, "quarantined"), (5, "accepted")]
    assert f"{rows[1].event_ts:%Y}" == "2024"  # by the file's head, not by the clock
    bad = t["quarantined"].collect()
    assert [(r.line_no, len(r.context_before)) for r in bad] == [(4, 2)] and bad[0].context_before[1] == LINES[2]
    assert [(r.total, r.errors) for r in t["per_file"].collect()] == [(4, 2)]
    text = V.panel(t, 2.0)
    assert text.startswith("CRITICAL: 4 records, 75.0% accepted") and "2 records/s" in text and "Hints" in text
    release(t)


@pytest.mark.parametrize("form", ["summary", "json", "dashboard"])
def test_command_line(spark, log, form):
    out = cli.run(spark, cli.arguments().parse_args([log, "--format", form, "--log-timezone", "UTC", "--reference-date", "2024-06-01"]))
    if form == "json":
        doc = json.loads(out)
        assert {"summary", "time", "logTimeSpan", "fileProfile", "formatDrift", "insights", "keywords", "latency", "endpoints", "errors", "quarantine", "schema", "quality", "anomalies"} <= set(doc)
        assert doc["summary"]["totalLines"] == 4 and doc["summary"]["totalEvents"] == 3 and doc["time"]["referenceYear"] == 2024
        assert doc["latency"]["count"] == 2 and doc["quarantine"]["recentSamples"][0]["lineNumber"] == 4 and doc["quality"]["fields"]
    else:
        assert "4 records" in out


def test_command_line_refuses(capsys):
    assert cli.main(["/no/such/file.log"]) == 2
    with pytest.raises(SystemExit):
        cli.arguments().parse_args(["x", "--quarantine-threshold", "1.5"])


def test_context_over_stretches(spark):
    rows = spark.range(1, 101).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.concat(F.lit("r"), "id").alias("raw"))
    out = {r.line_no: r.context_before for r in G.context_before(rows, 3, stretch=10).collect()}
    assert out == {i: [f"r{j}" for j in range(max(1, i - 3), i)] for i in range(1, 101)}


def test_series_of_several_files(spark):
    """Two files of which one is an hour behind: neither closes the other's buckets."""
    rows = spark.createDataFrame([("a", 1, 10), ("b", 1, 0), ("a", 2, 11), ("b", 2, 1), ("b", 3, 7), ("b", 4, 2)], "file string, line_no long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {(r.bucket, r.n) for r in M.rate_series(rows, F.lit(False), 5).collect()} == {(10, 2), (0, 2), (5, 1)}
    assert [(r.file, r.line_no, r.bucket) for r in M.late(rows, 5).collect()] == [("b", 4, 0)]


def test_sorting_and_words(spark):
    ends = spark.createDataFrame([("a", 5, 0, 0.0, 9.0, 1), ("b", 5, 4, 0.8, 3.0, 2), ("(other)", 99, 50, 0.5, 99.0, 3), ("c", 2, 2, 1.0, None, 4)], "key string, n long, errors long, error_rate double, p99 double, first_line long")
    keys = lambda df: [r.key for r in df.collect()]
    assert keys(V.top_endpoints(ends)) == ["a", "b", "c", "(other)"] and keys(V.top_endpoints(ends, "errorRate")) == ["c", "b", "a", "(other)"]
    assert keys(V.top_endpoints(ends, "latency", 2)) == ["a", "b"] and keys(V.top_endpoints(ends, "?")) == ["a", "b", "c", "(other)"]
    assert set(keys(V.failing_endpoints(ends))) == {"b", "(other)"} and keys(V.slowest_endpoint(ends)) == ["a"]
    row = spark.range(1).select(*[V.duration(F.lit(s)).alias(f"d{i}") for i, s in enumerate((45, 725, 11_040, 190_800))], V.truncated(F.lit("abcdef"), 5).alias("t")).first()
    assert list(row) == ["45s", "12m 5s", "3h 4m", "2d 5h", "ab..."]
    assert V.signature(ends).first() == V.signature(ends.orderBy("key")).first() != V.signature(ends.limit(2)).first()
    assert V.echo_safe("a→b", "ascii") == "a?b"


def test_live_panel(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(LINES))
    drawn = []
    live(stream_lines(spark, str(tmp_path / "in")), Config(), str(tmp_path / "table"), drawn.append).awaitTermination()
    assert len(drawn) == 1 and "5 records" in drawn[0]
