"""Queries cover all records: each would fail on a part of them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from logweir.functions import fields as X
from logweir.plans import catalog as C
from logweir.plans.engine import gated
from logweir.streaming.rates import error_windows, run_available, stream_lines

SF = "/root/testdata/sf0.001"
PARSED = [*C._PARSED, "parsed_untimed"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def same(got, want):
    rows = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False, name=None))
    assert rows(got.toPandas()[list(want.columns)]) == rows(want)


@pytest.mark.parametrize("name", PARSED)
def test_parsed_queries_match_sql(spark, duck, name):
    same(C.core_queries()[name](spark, SF), duck.sql(C.core_oracle_sql()[name]).df())


def test_parsed_queries_show_every_line_once(spark, duck):
    seen = [r.line_no for name in PARSED for r in C.core_queries()[name](spark, SF).collect()]
    assert sorted(seen) == [r[0] for r in duck.sql("SELECT event_id + 1 FROM events ORDER BY 1").fetchall()]


def test_parsed_queries_go_by_parser_and_not_by_place(spark, monkeypatch):
    moved = C._records(spark, SF).withColumn("line_no", F.col("line_no") + 1)
    want = {name: C.core_queries()[name](spark, SF).count() for name in ("parsed_json", "parsed_bsd")}
    monkeypatch.setattr(C, "_records", lambda *_: moved)
    assert {name: C.core_queries()[name](spark, SF).count() for name in want} == want


def test_latency_percentiles_of_all_records(spark, duck):
    """JSON, key=value and pipes carry a latency; where the scan takes a user's number for a status, its latency is unknown."""
    p = ", ".join(f"round(quantile_cont(ms, {q}), 6) AS p{n}" for q, n in ((0.5, 50), (0.95, 95), (0.99, 99)))
    want = duck.sql(f"{C._TRUTH} SELECT count(ms) AS n, 0::BIGINT AS n_low, count(*) - count(ms) AS n_unknown, {p}, round(min(ms), 6) AS min, round(max(ms), 6) AS max FROM (SELECT kind, ok, user_id, CASE WHEN kind IN (0, 3, 4) THEN ms END AS ms FROM r) WHERE kind IN (0, 3, 4) OR (kind >= 5 AND ok AND user_id BETWEEN 100 AND 599)").df()
    same(C.core_queries()["latency_percentiles"](spark, SF), want)


def test_data_quality_of_all_records(spark, duck):
    records = [r.asDict(True) for r in C._gated(spark, SF).collect()]
    want = {}
    for f in X.TYPES:
        n = {s: [r[f]["confidence"] for r in records if r[f]["state"] == s] for s in ("known", "unknown", "absent")}
        want[f] = (*map(len, n.values()), round(len(n["known"]) / len(records), 9), round(sum(n["known"]) / max(len(n["known"]), 1), 9))
    got = {r.field: (r.known, r.unknown, r.absent, r.known_rate, r.mean_confidence) for r in C.core_queries()["data_quality"](spark, SF).collect()}
    assert set(got) == set(want) and all(got[f] == pytest.approx(want[f]) for f in want)
    total, ok, ms = duck.sql(f"{C._TRUTH} SELECT count(*), count(*) FILTER (ok), count(*) FILTER (kind IN (0, 3, 4)) FROM r").fetchall()[0]
    assert got["timestamp"][:3] == (ok, 0, total - ok) and got["latency_ms"][0] == ms and got["message"][0] + got["message"][2] == total


@pytest.mark.parametrize("spike, badge", [(3, "DEGRADED"), (0, "HEALTHY")])
def test_health_badge_sees_error_spikes(spark, monkeypatch, spike, badge):
    """40 windows of 20 lines; errors in the last alone, below 2 % of all."""
    level = F.when((F.col("id") >= 780) & (F.col("id") < 780 + spike), "ERROR").otherwise("INFO")
    time = F.date_format(F.timestamp_seconds(1_704_067_200 + F.floor(F.col("id") / 20) * C.CONFIG.bucket_seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = spark.range(800).select(F.lit("f").alias("file"), (F.col("id") + 1).alias("line_no"), F.concat(F.lit("time="), time, F.lit(" level="), level, F.lit(" msg=x")).alias("raw"), F.lit(1).alias("n_lines"))
    monkeypatch.setattr(C, "_records", lambda *_: lines)
    row = C.core_queries()["health_badge"](spark, SF).first()
    assert (row.health, row.total) == (badge, 800) and row.error_rate == spike / 800


def test_streamed_lines_are_parsed_and_gated(spark, duck, tmp_path):
    want = duck.sql(C.core_oracle_sql()["stream_log_error_rate"]).df()
    same(C.core_queries()["stream_log_error_rate"](spark, SF), want)
    C.rendered(spark, SF).select("value").write.text(str(tmp_path / "lines"))
    same(run_available(error_windows(gated(stream_lines(spark, str(tmp_path / "lines")), C.CONFIG), C.CONFIG), "lines_of_files"), want)
