"""Registry of manifests that differ in shape; guards of parts, days and instruments; text sources and sinks."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidewindow.functions import scalars as SC
from tidewindow.operators import costs as CO, quality as Q, registry as RG
from tidewindow.sources import driver as D, files as FI

FIELDS = {
    "scale": ("long", ("$.scale", "$.price.scale")),
    "first": ("date", ("$.requested.first", "$.first_day")),
    "corpus": ("string", ("$.corpus_id",)),
}


def _entries(spark, rows):
    df = spark.createDataFrame(rows, "name string, body string")
    return {r["name"]: r for r in RG.registry(df, "name", "body", FIELDS).collect()}


def test_shapes_conflicts_and_gaps(spark):
    old = json.dumps({"scale": 100, "first_day": "2024-01-01", "corpus_id": "c1"})
    new = json.dumps({"price": {"scale": "100"}, "requested": {"first": "2024-01-01"}, "corpus_id": "c1", "more": [1]})
    got = _entries(
        spark,
        [("a", old), ("a", new), ("a", old), ("b", old), ("b", new.replace("c1", "c2")), ("c", '{"scale": "x", "corpus_id": null}'),
         ("d", "{"), ("d", None), (None, old)]
        + [("hot", old)] * 500,
    )
    a = got["a"]
    assert (a.documents, a.unreadable, a.scale, str(a["first"]), a.corpus, a.missing, a.conflicts) == (3, 0, 100, "2024-01-01", "c1", "", "")
    assert (got["b"].corpus, got["b"].conflicts) == (None, "corpus")
    assert got["c"].missing == "scale,first,corpus"
    assert (got["d"].documents, got["d"].unreadable, got["d"].missing) == (2, 2, "scale,first,corpus")
    assert got[None].corpus == "c1" and got["hot"].documents == 500
    both = json.dumps({"scale": 1, "price": {"scale": 2}})
    assert _entries(spark, [("x", both)])["x"].conflicts == "scale"
    assert _entries(spark, []) == {}


def test_entries_against_the_declared_universe(spark):
    body = lambda **x: json.dumps({"scale": 100, "first_day": "2024-01-01", "corpus_id": "c"} | x)
    rows = [("ok", body()), ("scaled", body(scale=10)), ("extra", body()), ("torn", body()), ("torn", "{"), ("short", '{"scale": 100}'),
            ("two", body()), ("two", body(corpus_id="d"))]
    df = spark.createDataFrame(rows, "name string, body string")
    expected = spark.createDataFrame([(n, 100) for n in ("ok", "scaled", "torn", "short", "two", "gone")], "name string, scale long")
    got = {r["name"]: r for r in RG.validated(RG.registry(df, "name", "body", FIELDS), expected, "name", ["corpus"]).collect()}
    assert {n: r.status for n, r in got.items()} == {
        "ok": "verified", "scaled": "mismatch", "extra": "undeclared", "torn": "unreadable", "short": "incomplete",
        "two": "conflict", "gone": "absent",
    }
    assert got["scaled"].mismatched == "scale" and got["gone"].mismatched is None


def test_day_audit_counts_gaps_and_windows(spark):
    hours = [("x", h) for h in (0, 1, 2, 3, 5, 8, 9, 10, 11, 23)] + [("y", 4)]
    bars = spark.createDataFrame(hours, "instrument string, h int").select(
        "instrument", F.timestamp_seconds(F.col("h") * 3600).alias("open_time"), F.lit(1.0).alias("low"), F.lit(2.0).alias("high"),
        F.lit(1.0).alias("volume"),
    )
    got = {r.instrument: r for r in Q.day_audit(bars, 3600, (2, 4)).collect()}
    x = got["x"]
    # Windows of two hours: 0, 2, 8, 10 whole, 4 and 22 not; of four: 0 and 8 whole, 4 and 20 not.
    assert (x.bars, x.gaps, x.windows_2, x.incomplete_2, x.windows_4, x.incomplete_4) == (10, 3, 4, 2, 2, 2)
    assert (got["y"].gaps, got["y"].windows_2, got["y"].incomplete_2) == (0, 0, 1)


def test_parts_need_their_total_and_one_provenance(spark):
    def verdict(rows, total):
        df = spark.createDataFrame(rows, "run string, part int, group_key int, source string")
        totals = spark.createDataFrame([("r", total)], "run string, declared_rows long")
        return Q.part_completeness(df, 2, totals, "source").first()

    assert verdict([("r", 0, 1, "s"), ("r", 1, 2, "s")], 2).complete
    lost, mixed = verdict([("r", 0, 1, "s"), ("r", 1, 2, "s")], 3), verdict([("r", 0, 1, "s"), ("r", 1, 2, "t")], 2)
    assert (lost.complete, lost.declared_rows, mixed.complete, mixed.sources) == (False, 3, False, 2)
    assert not verdict([("r", 0, 1, "s"), ("r", 1, 2, None)], 2).complete


def test_an_unknown_instrument_fails(spark, tmp_path):
    row = [(1, "rumour", 3, 1.0, '{"k": 1}')]
    df = spark.createDataFrame(row, "event_id long, event_type string, user_id long, value double, props string")
    df.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    with pytest.raises(Exception, match="unknown instrument: rumour"):
        D.ticks(spark, str(tmp_path)).collect()


def test_trades_that_are_no_number_are_refused_not_lost(spark):
    rows = [(1, 2.0, 1.0), (2, float("nan"), 1.0), (3, float("inf"), 1.0), (4, None, 1.0), (5, 1.0, float("-inf"))]
    trades = spark.createDataFrame(rows, "id int, pips_adverse double, pips_favorable double").selectExpr(
        "*", "'x' AS instrument", "'london' AS session", "false AS converted"
    )
    costs = CO.scenario_grid(spark.createDataFrame([("x", "london", "mean", 0.2, 0.1)], "instrument string, session string, statistic string, spread double, commission double"))
    got = CO.priced(trades, costs).collect()
    assert sorted((r.id, r.cost_status) for r in got) == [(1, "covered")] * 4 + [(i, "refused") for i in (2, 3, 4, 5)]
    assert all(r.net_adverse is None and r.statistic is None for r in got if r.cost_status == "refused")


def test_cells_carry_their_break_even(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", -1.0)]
    trades = spark.createDataFrame(rows, "k string, pips_adverse double").selectExpr("*", "0.5D AS spread", "0.1D AS commission", "false AS converted")
    cells = spark.createDataFrame([(k, s) for k in "abc" for s in (0.0, 1.0, 2.0)], "k string, slippage double")
    got = {(r.k, r.slippage): (r.break_even_slippage, r.extra_slippage) for r in CO.with_break_even(cells, trades, ["k"]).collect()}
    assert got["a", 0.0] == pytest.approx((1.4, 1.4)) and got["a", 1.0] == pytest.approx((1.4, 0.4)) and got["a", 2.0] == pytest.approx((1.4, 0.0))
    assert got["b", 1.0] == (0.0, 0.0) and got["c", 0.0] == (None, None)


def test_horizons_that_a_timeframe_can_meet(spark):
    df = spark.createDataFrame([(7200, "2h"), (7200, "4h"), (28800, "4h"), (21600, "4h"), (7200, "2H"), (7200, None)], "h long, tf string")
    got = [r.ok for r in df.select(SC.compatible_horizon(F.col("h"), F.col("tf")).alias("ok")).collect()]
    assert got == [True, False, True, False, False, False]


def test_json_lines_in_order_and_by_partition(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "concat('n', id % 3) AS name").repartition(7)
    FI.write_jsonl(df, f"{tmp_path}/ordered", ["id"])
    lines = [json.loads(x) for f in sorted((tmp_path / "ordered").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["id"] for x in lines] == list(range(1000))
    FI.write_jsonl(df, f"{tmp_path}/split", partition_by=["name"])
    one = FI.read_jsonl(spark, f"{tmp_path}/split/name=n1", "id long")
    assert one.count() == 333 and FI.read_jsonl(spark, f"{tmp_path}/split", "id long, name string").count() == 1000
    with pytest.raises(Exception, match="(?i)already exists"):
        FI.write_jsonl(df, f"{tmp_path}/ordered", ["id"])
    (tmp_path / "bad.json").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        FI.read_jsonl(spark, f"{tmp_path}/bad.json", "id long").collect()


def test_cost_document_and_commitments_of_files(spark, tmp_path):
    body = json.dumps({"spreads": {"x": {"london": {"mean": 0.5, "p75": 0.75}, "overall": {"mean": 1.0}}}}, indent=1)
    (tmp_path / "costs.json").write_text(body)
    (tmp_path / "empty.json").write_text("")
    schema = "spreads map<string, map<string, map<string, double>>>"
    got = FI.cost_dimensions(FI.read_document(spark, f"{tmp_path}/costs.json", schema)).collect()
    assert sorted(map(tuple, got)) == [("x", "london", "mean", 0.5), ("x", "london", "p75", 0.75), ("x", "overall", "mean", 1.0)]
    # The scan has no row for a file without a byte; what must exist is declared (see day files).
    files = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in FI.file_commitments(spark, f"{tmp_path}/*.json").collect()}
    want = {n: (len(x), hashlib.sha256(x).hexdigest()) for n, x in (("costs.json", body.encode()),)}
    assert files == want
