"""Registered queries: family overlap, atlas cells and roll-ups."""

from functools import partial, reduce

from pyspark.sql import functions as F

from tidewindow.operators import cell_grid as CG, costs as CO, families as FA, outcomes as OC, summaries as SU
from tidewindow.plans import grid as GR, study as ST
from tidewindow.plans.study import tidy
from tidewindow.sources.staging import stage

EXIT = ["tp", "sl", "stop"]
SETUP = [
    "instrument", "signal_timeframe", "session", "direction", "benchmark_family", "lookback", "signal_threshold",
    "entry_mode", "filter_family", "filter_spec_id",
]
CELL = [*SETUP, *EXIT, "scenario"]
HYPOTHESIS = [*[k for k in SETUP if k != "instrument"], *EXIT]
FAMILY = ["instrument", "signal_timeframe", "session", "direction", "entry_mode"]
EXECUTION = ["instrument", "signal_timeframe", "at", "direction"]


def scoped(df):
    """Fixed scope of the family comparison: London, short, two-hour signals."""
    return df.where((F.col("signal_timeframe") == "2h") & (F.col("session") == "london") & (F.col("direction") == -1))


IMMEDIATE = OC.ENTRY_MODES[:1]


def traded_setups(spark, sf, events=None):
    """Entries with a complete trade: setups and executions have no exit keys, so no grid is opened."""
    rows = ST.traded(spark, sf, events).withColumn("signal_threshold", F.lit(ST.THRESHOLD))
    return stage(rows.select("candidate_event_id", *SETUP, "at"))


def classed_events(spark, sf):
    """Scoped events with an immediate trade, once per event class: scope and class come before the grid."""
    events = stage(scoped(ST.candidates(spark, sf)))
    rows = stage(ST.traded(spark, sf, events, IMMEDIATE).select(*events.columns))
    return stage(FA.with_event_classes(rows))


def family_overlap(spark, sf):
    return tidy(FA.overlap_table(scoped(ST.candidates(spark, sf))))


def event_class_metrics(spark, sf):
    rows = ST.placed_trades(spark, sf, classed_events(spark, sf), ["instrument", "event_class"], IMMEDIATE)
    return tidy(SU.class_metrics(rows, ["instrument", "event_class", "benchmark_family", *EXIT], "pips_adverse", ST.WIDTH))


def plateau_breadth(spark, sf):
    """How many cells stay positive under every cost scenario, before and after costs."""
    events = GR.priced_events(spark, sf, classed_events(spark, sf), modes=IMMEDIATE)
    rows = ST.placed_trades(spark, sf, events, ["instrument", "event_class"], IMMEDIATE)
    priced = CO.scenario_rows(CO.status_of(rows))
    keys = ["instrument", "event_class", "benchmark_family", "statistic", "slippage"]
    cells = priced.groupBy(*keys, "lookback", *EXIT).agg(
        F.avg("pips_adverse").alias("mean_gross"), F.avg("net_adverse").alias("mean_net")
    )
    return tidy(SU.breadth(cells, keys))


def outcome_correlation(spark, sf):
    """Band against anchored outcomes at the same clock and exit cell."""
    setup = ["instrument", "signal_timeframe", "session", "direction", "lookback"]
    events = stage(ST.candidates(spark, sf).where(F.col("session").isNotNull()))
    # Only clocks at which both fire can pair, so only their events get paths and a grid.
    events = stage(FA.paired_events(events, [*setup, "at"]))
    rows = ST.placed_trades(spark, sf, events, setup, IMMEDIATE)
    return tidy(FA.paired_correlation(rows, [*setup, *EXIT], "at", "pips_adverse"))


def clock_sets(spark, sf):
    """Clocks per family: union, intersection and differences, from one flag per clock and family."""
    return tidy(FA.clock_sets(ST.candidates(spark, sf), "band", "vwap"))


def atlas_cells(spark, sf):
    cells = GR.cell_report(spark, sf, partial(CG.atlas, CO.HEADLINE), CG.ATLAS, priced=True)
    return GR.tidied(cells.select(*CELL, *[x for x in CG.ATLAS if x not in CELL]))


def _headline_cells(spark, sf, keys, extra=(), events=None):
    """Cells with their expectancies, lying by ``keys``, from staged events."""
    chosen = reduce(
        lambda a, b: a | b, [(F.col("statistic") == s) & (F.col("slippage") == slip) for s, slip in CO.HEADLINE]
    )
    events = stage(ST.candidates(spark, sf)) if events is None else events
    events = GR.priced_events(spark, sf, events, chosen)
    # Some instruments of one setup lie together: what spans instruments is merged there first.
    part = F.pmod(F.hash("instrument"), F.lit(max(1, events.count() // (4 * ST.PER_TASK))))
    events = FA.with_headline(events, CO.HEADLINE).drop("scenarios").withColumn("part", part)
    trades = CO.finite_status(ST.placed_trades(spark, sf, events, keys))
    return FA.headline_cells(trades, [*SETUP, *EXIT, *extra], CO.HEADLINE)


def setup_families(spark, sf):
    events = stage(ST.candidates(spark, sf))
    cells = _headline_cells(spark, sf, [k for k in ST.PLACE if k != "entry_mode"], events=events)
    return tidy(FA.setup_families(cells, traded_setups(spark, sf, events), SETUP, EXECUTION, CO.HEADLINE))


def execution_families(spark, sf):
    return tidy(FA.execution_families(traded_setups(spark, sf), FAMILY, EXECUTION, ["benchmark_family", "lookback"]))


ACROSS = ["benchmark_family", "signal_timeframe", "direction", "lookback", "part"]


def hypotheses(spark, sf):
    rows = stage(FA.hypotheses(_headline_cells(spark, sf, ACROSS, ["part"]), HYPOTHESIS, CO.HEADLINE))
    return tidy(FA.with_hypothesis_id(rows, HYPOTHESIS, rows))


def hypothesis_support(spark, sf):
    """Cross-instrument support of each hypothesis, one row per instrument."""
    cells = stage(_headline_cells(spark, sf, ACROSS, ["part"]))
    rows = FA.with_hypothesis_id(FA.expectancies(cells, [*SETUP, *EXIT]), HYPOTHESIS, cells)
    return tidy(rows.select("hypothesis_id", "scenario", "instrument", "expectancy"))


def reference_overlap(spark, sf):
    """Overlap of every setup with the scoped anchored-family executions."""
    trades = traded_setups(spark, sf)
    ref = scoped(trades).where(F.col("benchmark_family") != "band")
    return tidy(FA.role_overlap(trades, SETUP, EXECUTION, ref))


QUERIES = {
    f.__name__: f
    for f in (
        family_overlap, event_class_metrics, plateau_breadth, outcome_correlation, clock_sets, atlas_cells,
        setup_families, execution_families, hypotheses, hypothesis_support, reference_overlap,
    )
}
