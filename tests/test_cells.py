"""Cells of the cost grid: grid rows stay where their entries lie."""

import math
import re

from tidewindow.operators import costs as CO, families as FA, summaries as SU
from tidewindow.plans import families as FM, grid as GR, study as ST

SF = "/root/testdata/sf0.001"


def shuffles_below_grid(df):
    """Exchanges that come after a Generate of cells, from the plan's text (parents stand above children)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    grid = plan.index("_clock")
    return len(re.findall(r"Exchange hash", plan[:grid]))


def test_cost_cells_shuffle_no_grid_row(spark):
    trades = GR._scenario_trades(spark, SF)
    assert shuffles_below_grid(SU.scenario_cells(trades, GR.CONFIG)) == 0


def test_scenario_cells_match_the_joined_form(spark):
    keys = ["instrument", "session"]
    rows = [("a", s, g, g + 1.0, c) for s, c in (("x", True), (None, False)) for g in (-3.0, -1.0, 0.5, 0.5, 2.0, 9.0)]
    rows += [("b", "x", 1.0, 1.0, False), ("a", "x", math.nan, 1.0, True)]
    trades = spark.createDataFrame(rows, "instrument string, session string, pips_adverse double, pips_favorable double, converted boolean")
    base = spark.createDataFrame([("a", "x", 0.1, 0.2), ("a", "overall", 0.3, 0.1)], "instrument string, session string, spread double, commission double")
    costs = CO.scenario_grid(base.selectExpr("*", "'mean' as statistic"))
    priced = CO.priced(trades, costs)
    plain = priced.where("slippage = 0 and cost_status = 'covered'")
    want = CO.with_break_even(SU.cost_cells(priced, keys), plain, [*keys, "statistic"])
    got = SU.scenario_cells(CO.status_of(CO.with_scenarios(trades, trades, costs)), keys)
    key = lambda r: str((r["instrument"], r["session"], r["statistic"], r["slippage"]))
    got, want = ({key(r): r.asDict() for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and len(want) == 10
    for k, row in want.items():
        for name, value in row.items():
            g = got[k][name]
            assert g == value or (isinstance(value, float) and (math.isnan(value) and math.isnan(g) or abs(g - value) < 1e-9)), (k, name, g, value)


def test_distributions_shuffle_no_grid_row(spark):
    rows = ST.placed_outcomes(spark, SF)
    assert shuffles_below_grid(SU.long_distributions(rows, GR.CONFIG)) == 0


def test_atlas_cells_shuffle_no_grid_row(spark):
    values = FA.placed_headline_values(GR._scenario_trades(spark, SF), CO.HEADLINE)
    assert shuffles_below_grid(SU.cell_metrics(values, FM.CELL, "value", ST.WIDTH, ST.PLACE)) == 0


def test_entries_with_a_trade_are_those_of_the_grid(spark):
    """what asks for no exit cell opens no grid."""
    from tidewindow.operators import outcomes as OC

    entered = ST.entries(spark, "/root/testdata/sf0.01")
    want = OC.barrier_outcomes(entered, ST.STOPS).where("complete").select("candidate_event_id", "entry_mode").distinct().collect()
    got = OC.with_trade(entered, ST.STOPS).select("candidate_event_id", "entry_mode").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_headline_cells_match_the_joined_rows(spark):
    """F8, F11, F12: scenarios side by side give the expectancies of scenarios as rows."""
    from pyspark.sql import functions as F

    rows = [("a", "x", g, g, True) for g in (-2.0, 0.5, 3.0)] + [("a", None, math.inf, 1.0, False), ("b", "x", 1.0, 1.0, False)]
    trades = spark.createDataFrame(rows, "instrument string, session string, pips_adverse double, pips_favorable double, converted boolean")
    base = spark.createDataFrame([("a", "x", 0.1, 0.2), ("a", "overall", 0.3, 0.1)], "instrument string, session string, spread double, commission double")
    costs = CO.scenario_grid(base.select("*", F.explode(F.array(*[F.lit(s) for s in CO.STATISTICS])).alias("statistic")))
    keys = ["instrument", "session"]
    want = FA.headline_values(trades, costs, CO.HEADLINE).groupBy(*keys, "scenario").agg(F.avg("value").alias("expectancy"))
    events = FA.with_headline(CO.with_scenarios(trades, trades, costs), CO.HEADLINE)
    got = FA.expectancies(FA.headline_cells(CO.finite_status(events), keys, CO.HEADLINE), keys)
    text = lambda df: sorted(str(tuple(r)) for r in df.select(*keys, "scenario", F.round("expectancy", 9)).collect())
    assert text(got) == text(want) and got.count() == 9


def test_correlation_opens_a_grid_for_paired_clocks_only(spark):
    """events without a partner at their clock never meet a path, and grid rows are joined where they lie."""
    rows = [("a", t, f) for t, f in ((1, "band"), (1, "vwap"), (2, "band"), (3, "vwap"))]
    events = spark.createDataFrame(rows, "instrument string, at long, benchmark_family string")
    assert {r["at"] for r in FA.paired_events(events, ["instrument", "at"]).collect()} == {1}
    plan = FM.QUERIES["outcome_correlation"](spark, SF)
    assert shuffles_below_grid(plan) == 0 and "Join" not in plan._jdf.queryExecution().executedPlan().toString().split("_clock")[0]


def test_setups_and_hypotheses_shuffle_no_grid_row(spark):
    """F8, F11: only merged cells leave the tasks that hold their entries."""
    keys = [k for k in ST.PLACE if k != "entry_mode"]
    assert shuffles_below_grid(FA.expectancies(FM._headline_cells(spark, SF, keys), [*FM.SETUP, *FM.EXIT])) == 0
    assert shuffles_below_grid(FM._headline_cells(spark, SF, FM.ACROSS, ["part"])) == 0


def test_breakout_tasks_follow_the_bars(spark, monkeypatch):
    """tasks that order levels are as many as the bars ask for, and depths multiply rows after the shuffle."""
    from tidewindow.plans import structure as SR
    from tidewindow.sources import driver as D
    from tidewindow.sources.staging import stage

    bars = stage(D.bars(spark, SF))
    monkeypatch.setattr(SR, "BARS_PER_TASK", 10)
    plan = SR._breakouts(bars)._jdf.queryExecution().optimizedPlan().toString()
    want = -(-bars.count() // 10)
    assert re.search(rf"RepartitionByExpression \[instrument#\d+, level_id#\d+\], {want}\b", plan)
    assert plan.index("minimum_depth") < plan.index("RepartitionByExpression") < plan.rindex("Join")


def test_trade_validation_walks_no_excursion(spark):
    """the contract asks for results only."""
    plan = GR.QUERIES["trade_validation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan.split("Generate inline")[1]


def test_path_matrix_shuffles_events_once(spark):
    """events are dealt once, and no metric becomes a row."""
    from tidewindow.plans import pathways as PW

    text = PW.QUERIES["path_matrix"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange ", text)) == 1 and "Generate" not in text


def test_inventory_orders_no_medians(spark):
    """counts need no quantile, and an outer join to one is not pruned by itself."""
    from tidewindow.plans import benchmarks as BM

    text = BM.QUERIES["replication_inventory"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_hits" not in text and "signal_count" in text
