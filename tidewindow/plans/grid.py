"""Registered queries: entries, races, barrier outcomes, costs and their reports."""

from pyspark.sql import functions as F

from tidewindow.operators import cell_grid as CG, costs as CO, outcome_grid as OG, outcomes as OC, quality as Q, summaries as SU
from tidewindow.plans import study as ST
from tidewindow.plans.study import tidy
from tidewindow.sources import driver as D
from tidewindow.sources.staging import stage

REGIME = ["instrument", "benchmark_family", "signal_timeframe", "session", "direction", "lookback"]
# A trade configuration has thirteen keys; leaving any out counts a trade several times.
CONFIG = [*REGIME, "signal_threshold", "filter_family", "filter_spec_id", "entry_mode", "tp", "sl", "stop"]
EVENT = [k for k in CONFIG if k not in ("entry_mode", "tp", "sl", "stop")]


def entry_rules(spark, sf):
    rows = ST.entries(spark, sf).drop("path")
    return tidy(
        rows.select(
            "candidate_event_id", "entry_mode", "executed", "wait", "entry_price", "r_at_entry", "pre_entry_favorable",
            "pre_entry_adverse", "time_to_extension", "extension_to_entry",
        )
    )


def barrier_race(spark, sf):
    rows = ST.races(spark, sf)
    return tidy(
        rows.select(
            "candidate_event_id", "horizon",
            *[f"{c}{t}" for t in (25, 50) for c in ("time_to_reversion", "time_to_extension", "ordering_")],
        )
    )


def race_report(spark, sf):
    return tidy(SU.race_summary(stage(ST.races(spark, sf)), REGIME))


def first_passage_report(spark, sf):
    return tidy(SU.first_passage_summary(stage(ST.races(spark, sf)), REGIME, max(ST.RACE), ST.RACE))


def hazard_report(spark, sf):
    return tidy(SU.hazard(ST.races(spark, sf), REGIME, max(ST.RACE), ((0, 2), (2, 4), (4, 8))))


def entry_wait_report(spark, sf):
    return tidy(SU.entry_waits(stage(ST.entries(spark, sf).drop("path")), REGIME, (1, 2, 4)))


def barrier_outcomes(spark, sf):
    """The grid is the result: values are rounded where they are worked out, once per barrier and not per cell."""
    values = ("pips", "bp", "fraction", "mae", "mfe", "mae_bound", "mfe_bound", "time_to_mae", "time_to_mfe")
    rows = OG.outcome_grid(ST.entries(spark, sf), ST.STOPS, values=values, finish=ST.near6)
    rows = rows.select(
        "candidate_event_id", "entry_mode", "tp", "sl", "stop", "status", "complete", "exit_reason", "holding",
        "pips_adverse", "pips_favorable", "bp_adverse", "fraction_adverse", "mae", "mfe", "mae_bound", "mfe_bound",
        "time_to_mae", "time_to_mfe",
    )
    return tidy(rows, rounded=[name for name, kind in rows.dtypes if kind == "double"])


def cell_report(spark, sf, what, fields, priced=False, excursions=False):
    """The rows of a report of ``cell_grid`` on all candidates, which meet their costs, if ``priced``, before their paths."""
    events = stage(ST.candidates(spark, sf))
    events = priced_events(spark, sf, events) if priced else events
    return CG.report(
        ST.placed_paths(spark, sf, events, EVENT), EVENT, what, fields, ST.STOPS, ST.RECLAIM, ST.EXTENSION, excursions=excursions
    )


def tidied(rows):
    """:func:`study.tidy` of rows that come rounded."""
    return tidy(rows, rounded=[name for name, kind in rows.dtypes if kind == "double"])


def outcome_matrix(spark, sf):
    return tidied(cell_report(spark, sf, CG.matrix, CG.MATRIX, excursions=True))


def outcome_distributions(spark, sf):
    cells = cell_report(spark, sf, CG.distributions, CG.DISTRIBUTIONS, excursions=True)
    items = [
        F.struct(F.lit(m).alias("metric"), F.col("sample_count"), F.lit(q).alias("quantile"), F.col(f"{m}_{q}").alias("value"))
        for m in CG.METRICS for q in SU.QUANTS
    ]
    return tidied(cells.select(*CONFIG, F.inline(F.array(*items))))


def run_totals(spark, sf):
    return tidy(SU.run_totals(OC.outcome_counts(ST.entries(spark, sf), ST.STOPS), ["instrument"]))


def trade_validation(spark, sf):
    """Every grid cell of a candidate by the trade contract: why a row is no priceable trade."""
    rows = Q.check_trades(ST.grid(ST.entries(spark, sf), excursions=False), D.member().isin(*D.MEMBERS))
    return tidy(rows.groupBy("instrument", "verdict").agg(F.count("*").alias("rows")))


def cost_dimension(spark, sf):
    """(instrument, session, statistic, slippage) with spread and commission in pips."""
    profile = CO.spread_profile(D.ticks(spark, sf), 5)
    spreads = CO.scenario_grid(CO.long_costs(profile, D.pip()))
    # Commission in pips, by quote kind and session.
    commission = F.when(D.converted(), F.when(F.col("session") == "asia", 0.6).otherwise(0.5)).otherwise(0.07)
    return spreads.withColumn("commission", commission)


def priced_events(spark, sf, events, chosen=None, modes=OC.ENTRY_MODES):
    """Staged events with ``cost_status`` and their cost ``scenarios`` (those that ``chosen`` names): costs
    are met before paths and grid, which only multiply what was found once."""
    costs = cost_dimension(spark, sf)
    costs = stage(costs if chosen is None else costs.where(chosen))
    lacking = stage(CO.uncovered(events, costs))
    # Only pairs without costs have to show whether anything is traded in them.
    traded = lacking
    if not lacking.isEmpty():
        same = (F.col("l.instrument") == F.col("r.instrument")) & (F.coalesce("l.session", F.lit("overall")) == F.col("r.session"))
        traded = stage(
            ST.traded(spark, sf, events.alias("l").join(lacking.alias("r"), same, "left_semi"), modes).select("instrument", "session").distinct()
        )
    return stage(CO.with_scenarios(events, traded, costs))


def _scenario_trades(spark, sf):
    """Complete trades with their cost scenarios as one array, lying by the keys of their cells."""
    entered, costs = stage(ST.entries(spark, sf)), stage(cost_dimension(spark, sf))
    traded = ST.grid(ST.placed(entered)).where("complete").select("instrument", "session").distinct()
    rows = ST.placed(stage(CO.with_scenarios(entered, stage(traded), costs)))
    return CO.status_of(
        ST.grid(rows).where("complete").select(
            *CONFIG, "candidate_event_id", "at", "pips_adverse", "pips_favorable", "mae_pips", "mfe_pips", "converted",
            "cost_status", "scenarios",
        )
    )


def cost_coverage(spark, sf):
    """Which instruments are priced and which are blocked for want of a cost row."""
    trades = ST.candidates(spark, sf).select("instrument", "session", "candidate_event_id")
    costs = cost_dimension(spark, sf).where("not (session = 'asia' and instrument like 'signup%')")
    rows = CO.block_uncovered(trades, costs)
    return tidy(rows.groupBy("instrument", "cost_status").agg(F.count("*").alias("candidates")))


def priced_scenarios(spark, sf):
    """Net result of every complete trade under every cost scenario, summarised."""
    rows = cell_report(spark, sf, CG.priced_sums, CG.SUMS, priced=True)
    return tidy(
        rows.groupBy("instrument", "session", "entry_mode", "statistic", "slippage", "cost_status").agg(
            F.sum("rows").alias("rows"), F.sum("net_adverse").alias("net_adverse"), F.sum("net_favorable").alias("net_favorable"),
            (F.sum("modeled") / F.sum("rows")).alias("modeled_cost"), F.max("spread").alias("spread"), F.max("commission").alias("commission"),
        )
    )


def cost_cells(spark, sf):
    """Net statistics of every cell, with the slippage it bears."""
    return tidied(cell_report(spark, sf, CG.priced_cells, CG.PRICED, priced=True))


BREADTH = ["instrument", "signal_timeframe", "session", "direction", "entry_mode"]


def break_even(spark, sf):
    """Break-even slippage per group, with the currency conversion kink; blocked trades have none."""
    keys = ["instrument", "session"]
    events = priced_events(spark, sf, stage(ST.candidates(spark, sf)), F.col("slippage") == 0)
    trades = CO.status_of(ST.placed_trades(spark, sf, events, keys)).where("cost_status = 'covered'")
    cells = SU.scenario_cells(trades, [*keys, "entry_mode", "tp"])
    return tidy(cells.select(*keys, "entry_mode", "tp", "statistic", "break_even_slippage"))


def regime_breadth(spark, sf):
    cells = cell_report(spark, sf, CG.positive_cells, CG.POSITIVE, priced=True)
    return tidy(SU.merged_breadth(cells, [*BREADTH, "statistic", "slippage"]))


QUERIES = {
    f.__name__: f
    for f in (
        entry_rules, barrier_race, race_report, first_passage_report, hazard_report, entry_wait_report,
        barrier_outcomes, outcome_matrix, outcome_distributions, run_totals, trade_validation, cost_coverage, priced_scenarios,
        cost_cells, break_even, regime_breadth,
    )
}
