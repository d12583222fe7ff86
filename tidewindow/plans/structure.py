"""Registered queries: structural levels, failed breakouts and trend exhaustion."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidewindow.functions import sessions as S
from tidewindow.functions.scalars import identity_hash
from tidewindow.operators import families as FA, features as FE, joins as JO, levels as LV, paths as PA, stats as SS, summaries as SU
from tidewindow.plans import study as ST
from tidewindow.plans.study import tidy
from tidewindow.sources import driver as D
from tidewindow.sources.staging import stage

OPENING, RECLAIM = 2, 6
DEPTHS = (0.0, 0.05, 0.10)
HORIZONS = (1, 2, 4, 8)
PATH = 8
THRESHOLDS = (0.4, 0.6, 0.8)
PRIMARY = 0.6
WINDOWS_S = (0, 7200, 14400, 28800)
ANCHORS = ("previous-day", "asia-session", "london-opening")
COUNTS = (
    "events", "clocks", "complete_paths", "instruments", "adequate_instruments", "positive_instruments", "active_months",
    *[f"n_h{h}" for h in HORIZONS],
)


def _dense(spark, sf, cells, **axes):
    """Every instrument with every combination of the axes: a cell without events shows zero."""
    grid = D.ticks(spark, sf).select(F.col("instrument").alias("cell_instrument")).distinct()
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return SS.dense(grid, cells, [*axes, "cell_instrument"], COUNTS)


def _levels(bars):
    return LV.structural_levels(bars, ST.STEP, OPENING, ST.WIDTH)


def structural_levels(spark, sf):
    return tidy(_levels(stage(D.bars(spark, sf))))


BARS_PER_TASK = 20_000


def _breakouts(bars):
    """From staged bars, whose number says how many tasks order their levels."""
    tasks = max(bars.sparkSession.sparkContext.defaultParallelism, -(-bars.count() // BARS_PER_TASK))
    return LV.failed_breakouts(bars, _levels(bars), ST.STEP, RECLAIM, DEPTHS, ST.WIDTH, tasks)


def failed_breakouts(spark, sf):
    return tidy(_breakouts(stage(D.bars(spark, sf))).drop("event_id"))


def _observed(events, bars):
    rows = PA.attach_paths(events.withColumn("pip", D.pip()), bars, "at", ST.STEP, PATH)
    return stage(PA.directional_paths(rows, PATH, HORIZONS).drop("path", "missing_steps"))


def _breakout_observations(spark, sf):
    bars = stage(D.bars(spark, sf))
    return _observed(stage(_breakouts(bars)), bars)


def _unique(rows, extra=()):
    """One opportunity per (instrument, clock, direction); colliding paths must be equal."""
    return SU.unique_opportunities(
        rows, ["instrument", "at", "direction", *extra], ["anchor_family", "level_id", "event_id"],
        ["path_complete", "mfe_pips", "mae_pips"],
    )


def _flat(df):
    """Maps as sorted text, so that every engine compares them the same way."""
    out = []
    for name, kind in df.dtypes:
        if kind.startswith("map<string,bigint>"):
            pairs = F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
            out.append(F.array_join(F.array_sort(pairs), ",").alias(name))
        elif not kind.startswith("map"):
            out.append(F.col(name))
    return df.select(*out)


def breakout_summary(spark, sf):
    """Anchor/depth/instrument cells, then depth and family scopes over unique opportunities."""
    rows = _breakout_observations(spark, sf)
    none = lambda df, *names: df.withColumns({n: F.lit(None).cast("string") for n in names})
    cell = SU.scope_summary(rows.withColumn("cell_instrument", F.col("instrument")), ["anchor_family", "minimum_depth", "cell_instrument"], HORIZONS)
    cell = _dense(spark, sf, cell, anchor_family=ANCHORS, minimum_depth=DEPTHS)
    depth = SU.scope_summary(_unique(rows, ["minimum_depth"]), ["minimum_depth"], HORIZONS)
    family = SU.scope_summary(_unique(rows).withColumn("scope", F.lit("family")), ["scope"], HORIZONS)
    out = (
        cell.withColumn("scope", F.lit("cell"))
        .unionByName(none(depth.withColumn("scope", F.lit("depth")), "anchor_family", "cell_instrument"))
        .unionByName(none(family, "anchor_family", "cell_instrument").withColumn("minimum_depth", F.lit(None).cast("double")))
    )
    return tidy(_flat(out))


def _overlap(spark, sf):
    rows = _breakout_observations(spark, sf)
    clocks = ST.candidates(spark, sf).where("benchmark_family <> 'band' and direction = -1").select("instrument", "at")
    near = JO.nearest_clock(rows, clocks, ["instrument"], "at", max(WINDOWS_S), "nearest_s")
    every = near.select("anchor_family", "instrument", "at", "direction", "nearest_s").distinct()
    total = near.select("instrument", "at", "direction", "nearest_s").distinct()
    scopes = []
    for part in (every, total.withColumn("anchor_family", F.lit("ALL"))):
        for instrument in (F.lit("ALL"), F.col("instrument")):
            scoped = part.withColumn("scope_instrument", instrument)
            scopes.append(FA.overlap_windows(scoped, ["anchor_family", "scope_instrument"], WINDOWS_S))
    return reduce(DataFrame.unionByName, scopes)


def breakout_overlap(spark, sf):
    """Unique breakouts near a reference clock, by window, anchor and instrument, and over all."""
    return tidy(_overlap(spark, sf))


def breakout_decision(spark, sf):
    seen = _breakout_observations(spark, sf)
    rows = SU.scope_summary(
        _unique(seen).withColumn("scope", F.lit("family")), ["scope"], HORIZONS, min_instrument_events=FA.MIN_INSTRUMENT_EVENTS
    )
    means = _unique(seen, ["minimum_depth"]).groupBy("minimum_depth").agg(F.avg(f"pips_h{HORIZONS[-1]}").alias("mean"))
    depths = means.agg((F.count_if(F.col("mean") > 0) == len(DEPTHS)).alias("depths_positive")).withColumn("scope", F.lit("family"))
    out = FA.stage_decision(SS.attach(rows, depths, ["scope"]), HORIZONS[-1], F.col("depths_positive"))
    # How much of the study is not already in the reference clocks of the same instrument.
    overlap = _overlap(spark, sf).where("anchor_family = 'ALL' and scope_instrument = 'ALL'").select(
        F.lit("family").alias("scope"), (F.col(f"unique_w{WINDOWS_S[-1]}") / F.col("events")).alias("unique_rate")
    )
    out = FA.independence(
        SS.attach(out, overlap, ["scope"]), F.col("unique_rate"), F.col("decision") != "INCONCLUSIVE", F.col("decision") == "PASS"
    )
    return tidy(
        out.select(
            "scope", "events", f"n_h{HORIZONS[-1]}", f"mean_h{HORIZONS[-1]}", f"pips_h{HORIZONS[-1]}_median", "decision",
            "unique_rate", "independence",
        )
    )


def trend_features(spark, sf):
    rows = FE.trend_features(ST.observations(spark, sf), ST.BARS)
    return tidy(
        rows.select(
            "instrument", F.col("t").alias("open_s"), "atr", "displacement", "trend_direction", "normalized_displacement",
            "efficiency", "extension", "retained", "last_move", "upper_wick", "lower_wick", "body", "wick_body_ratio",
            "bar_range", "volume_change",
        )
    )


def _exhaustion(obs):
    rows = stage(FE.trend_features(obs, ST.BARS))
    grid = rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))
    flag = FE.exhausted(F.col("threshold"), 0.15, 0.25, 0.10)
    events = FE.episode_starts(grid, ST.BARS, flag, (*FE.SERIES, "threshold"))
    name, since, until = S.sole_session_minutes(F.col("available_at"))
    return events.withColumns(
        {
            "direction": -F.col("trend_direction"),
            "p0": F.col("close"),
            "session_label": name,
            "from_open": since,
            "to_close": until,
            "event_id": identity_hash("trend-exhaustion-", F.col("instrument"), F.col("at"), F.format_string("%.2f", "threshold")),
        }
    )


def trend_exhaustion(spark, sf):
    rows = _exhaustion(ST.observations(spark, sf))
    return tidy(
        rows.select(
            "event_id", "instrument", "at", "threshold", "direction", "normalized_displacement", "efficiency", "extension",
            "retained", "session_label", "from_open", "to_close",
        )
    )


def exhaustion_observations(spark, sf):
    obs = stage(ST.observations(spark, sf))
    return _observed(stage(_exhaustion(obs)), obs)


def exhaustion_summary(spark, sf):
    rows = exhaustion_observations(spark, sf)
    cell = SU.scope_summary(rows.withColumn("cell_instrument", F.col("instrument")), ["threshold", "cell_instrument"], HORIZONS)
    cell = _dense(spark, sf, cell, threshold=THRESHOLDS)
    whole = SU.scope_summary(rows, ["threshold"], HORIZONS).withColumn("cell_instrument", F.lit(None).cast("string"))
    out = cell.withColumn("scope", F.lit("instrument")).unionByName(whole.withColumn("scope", F.lit("threshold")))
    return tidy(_flat(out))


def exhaustion_expectancy(spark, sf):
    """Mean outcome by instrument, month and quarter of each threshold, as long rows."""
    rows = exhaustion_observations(spark, sf)
    ts = F.timestamp_seconds("at")
    keys = F.array(
        F.struct(F.lit("instrument").alias("kind"), F.col("instrument").alias("key")),
        F.struct(F.lit("month").alias("kind"), F.date_format(ts, "yyyy-MM").alias("key")),
        F.struct(F.lit("quarter").alias("kind"), F.concat(F.year(ts), F.lit("-Q"), F.quarter(ts)).alias("key")),
    )
    long = rows.select("threshold", f"pips_h{HORIZONS[-1]}", F.inline(keys))
    return tidy(
        long.groupBy("threshold", "kind", "key").agg(
            F.count("*").alias("events"), F.avg(f"pips_h{HORIZONS[-1]}").alias("expectancy")
        )
    )


def exhaustion_overlap(spark, sf):
    rows = exhaustion_observations(spark, sf).where(F.col("threshold") == PRIMARY)
    clocks = ST.candidates(spark, sf).where("benchmark_family <> 'band' and direction = -1").select("instrument", "at")
    near = JO.nearest_clock(rows, clocks, ["instrument"], "at", max(WINDOWS_S), "nearest_s")
    return tidy(FA.overlap_windows(near, ["instrument"], WINDOWS_S))


def exhaustion_plateau(spark, sf):
    rows = exhaustion_observations(spark, sf)
    means = rows.groupBy("threshold").agg(F.avg(f"pips_h{HORIZONS[-1]}").alias("mean"))
    return tidy(FA.plateau_ok(means, "threshold", PRIMARY, "mean"))


def exhaustion_decision(spark, sf):
    """The study's verdict at its primary threshold."""
    seen = exhaustion_observations(spark, sf)
    rows = SU.scope_summary(
        seen.where(F.col("threshold") == PRIMARY), ["threshold"], HORIZONS, min_instrument_events=FA.MIN_INSTRUMENT_EVENTS
    )
    means = seen.groupBy("threshold").agg(F.avg(f"pips_h{HORIZONS[-1]}").alias("mean"))
    plateau = FA.plateau_ok(means, "threshold", PRIMARY, "mean").select(F.lit(PRIMARY).alias("threshold"), "plateau")
    out = FA.stage_decision(SS.attach(rows, plateau, ["threshold"]), HORIZONS[-1], F.col("plateau"))
    main = HORIZONS[-1]
    return tidy(out.select("threshold", "events", f"n_h{main}", f"mean_h{main}", f"pips_h{main}_median", "plateau", "decision"))


QUERIES = {
    f.__name__: f
    for f in (
        structural_levels, failed_breakouts, breakout_summary, breakout_overlap, breakout_decision, trend_features,
        trend_exhaustion, exhaustion_summary, exhaustion_expectancy, exhaustion_overlap, exhaustion_plateau,
        exhaustion_decision,
    )
}
