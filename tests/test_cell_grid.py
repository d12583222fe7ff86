"""Reports worked out as arrays say what the expressions of the grid say, row by row."""

import math
import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from tidewindow.operators import cell_grid as CG, costs as CO, families as FA, outcomes as OC, summaries as SU
from tidewindow.plans import families as FM, grid as GR, study as ST

SF = "/root/testdata/sf0.001"
YEAR = 366 * 86400


@pytest.fixture(scope="module")
def trades(spark):
    """Events with gaps, missing closes, two events at one clock, a year without trades, and an instrument without costs."""
    rng, rows = random.Random(7), []
    for instrument, session, size in (("purchase.0", None, 23), ("view.0", "asia", 1), ("view.0", "london", 9), ("error.1", "asia", 4)):
        for direction in (1, -1):
            for i in range(size):
                at = 1704067200 + (i // 2) * 40 * 86400 + (i % 2) * 7200 * (i > 3) + (2 * YEAR if i > 6 else 0)
                p0, d0 = 100.0 + rng.randint(-9, 9) / 10, rng.choice((-1, 1)) * rng.randint(1, 30) / 10
                path = []
                for m in range(1, 33):
                    if rng.random() < 0.7:
                        close = p0 + rng.randint(-20, 20) / 10
                        high, low = close + rng.randint(0, 9) / 10, close - rng.randint(0, 9) / 10
                        path.append((m, high, low, close if rng.random() < 0.9 else None))
                rows.append(
                    (instrument, "band", "2h", session, direction, 4, 0.75, "none", "none-v1", f"{at}", at, p0, d0, 0.1, instrument < "r", path)
                )
    events = spark.createDataFrame(
        rows,
        "instrument string, benchmark_family string, signal_timeframe string, session string, direction int, lookback int, signal_threshold double, "
        "filter_family string, filter_spec_id string, candidate_event_id string, at long, p0 double, d0 double, pip double, converted boolean, "
        "path array<struct<m:int,high:double,low:double,close:double>>",
    )
    pairs = [("purchase.0", "overall", 0.31, 0.5), ("view.0", "asia", 0.13, 0.07), ("view.0", "london", 0.22, 0.07)]
    base = spark.createDataFrame(pairs, "instrument string, session string, spread double, commission double")
    statistics = F.explode(F.array(*[F.lit(s) for s in CO.STATISTICS]))
    costs = CO.scenario_grid(base.withColumn("statistic", statistics).withColumn("spread", F.col("spread") + F.length("statistic")))
    events = CO.with_scenarios(events, events, costs).cache()
    grid = OC.barrier_outcomes(OC.with_entries(events, ST.RECLAIM, ST.EXTENSION), ST.STOPS).cache()
    return events, grid, CO.status_of(grid.where("complete"))


def report(events, what, fields, excursions=False):
    paths = events.repartition(3, "instrument", "direction").sortWithinPartitions(*GR.EVENT, "at")
    return CG.report(paths, GR.EVENT, what, fields, ST.STOPS, ST.RECLAIM, ST.EXTENSION, excursions=excursions)


def same(got, want, keys):
    key = lambda r: str([r[k] for k in keys])
    want = ST.tidy(want)
    got, want = ({key(r): r.asDict() for r in df.collect()} for df in (ST.tidy(got).select(*want.columns), want))
    assert got.keys() == want.keys() and want
    for k, row in want.items():
        for name, value in row.items():
            g = got[k][name]
            assert g == value or (isinstance(value, float) and math.isclose(g, value, abs_tol=2e-6)), (k, name, g, value)


def test_outcome_matrix(spark, trades):
    """F3"""
    events, grid, _ = trades
    same(report(events, CG.matrix, CG.MATRIX, True), SU.outcome_matrix(grid, GR.CONFIG), GR.CONFIG)


def test_outcome_distributions(spark, trades, monkeypatch):
    """F6"""
    events, grid, _ = trades
    monkeypatch.setattr(ST, "candidates", lambda spark, sf: events.drop("path", "scenarios", "cost_status", "filter_family", "filter_spec_id"))
    monkeypatch.setattr(ST, "placed_paths", lambda *_: events.coalesce(1).sortWithinPartitions(*GR.EVENT, "at"))
    got = GR.outcome_distributions(spark, SF)
    same(got, SU.long_distributions(grid, GR.CONFIG), [*GR.CONFIG, "metric", "quantile"])


def test_cost_cells(spark, trades):
    """F1"""
    events, _, priced = trades
    same(report(events, CG.priced_cells, CG.PRICED), SU.scenario_cells(priced, GR.CONFIG), [*GR.CONFIG, "statistic", "slippage"])


def test_atlas_cells(spark, trades):
    """F4"""
    events, _, priced = trades
    want = SU.cell_metrics(FA.placed_headline_values(priced, CO.HEADLINE), FM.CELL, "value", ST.WIDTH)
    same(report(events, partial(CG.atlas, CO.HEADLINE), CG.ATLAS), want, FM.CELL)


def test_regime_breadth(spark, trades):
    """F5"""
    events, _, priced = trades
    cells = CO.scenario_rows(priced).groupBy(*GR.CONFIG, "statistic", "slippage").agg(
        F.avg("pips_adverse").alias("mean_gross"), F.avg("net_adverse").alias("mean_net")
    )
    keys = [*GR.BREADTH, "statistic", "slippage"]
    same(SU.merged_breadth(report(events, CG.positive_cells, CG.POSITIVE), keys), SU.breadth(cells, keys), keys)


def test_priced_scenarios(spark, trades):
    """F7"""
    events, _, priced = trades
    keys = ["instrument", "session", "entry_mode", "statistic", "slippage", "cost_status"]
    want = CO.scenario_rows(priced).groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum("net_adverse").alias("net_adverse"), F.sum("net_favorable").alias("net_favorable"),
        F.max("spread").alias("spread"),
    )
    got = report(events, CG.priced_sums, CG.SUMS).groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("net_adverse").alias("net_adverse"), F.sum("net_favorable").alias("net_favorable"),
        F.max("spread").alias("spread"),
    )
    same(got, want, keys)


def test_groups_are_whole_across_batches(spark, trades, monkeypatch):
    """F1, F3 to F7: a group that ends in a later batch is one group."""
    events, grid, _ = trades
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    monkeypatch.setattr(CG, "CHUNK", 5)
    try:
        same(report(events, CG.matrix, CG.MATRIX, True), SU.outcome_matrix(grid, GR.CONFIG), GR.CONFIG)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("module, name", [(GR, n) for n in ("cost_cells", "outcome_matrix", "outcome_distributions", "regime_breadth", "priced_scenarios")] + [(FM, "atlas_cells")])
def test_no_cell_of_an_event_becomes_a_row(spark, module, name):
    """F1, F3 to F7: rows of the plan are events, then what the report returns."""
    plan = module.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "_clock" not in plan and "scenarios" not in plan.split("MapInArrow")[0]
