"""Registered queries: signals, path diagnostics and their matrix."""

from pyspark.sql import functions as F

from tidewindow.operators import paths as PA, summaries as SU
from tidewindow.plans import study as ST
from tidewindow.plans.study import tidy
from tidewindow.sources import driver as D
from tidewindow.sources.staging import stage

SETUP = ["instrument", "benchmark_family", "signal_timeframe", "session", "direction", "lookback", "threshold"]


SETUP_PLACE = [k for k in ST.PLACE if k != "entry_mode"]


def signal_grid(spark, sf):
    """Frozen signals of three families x two timeframes x lookbacks x thresholds x sessions."""
    rows = ST.frozen_signals(spark, sf)
    return tidy(rows.select(*SETUP, "at", "p0", "e0", "d0", "z"))


def state_sides(spark, sf):
    """Two-sided states, qualifying or not, counted per key."""
    rows = ST.two_sided_states(spark, sf)
    return tidy(
        rows.groupBy("instrument", "benchmark_family", "signal_timeframe", "session", "direction", "lookback").agg(
            F.count("*").alias("states"), F.count_if("qualifying").alias("qualifying"), F.avg("z").alias("mean_z")
        )
    )


def rearmed_events(spark, sf):
    rows = ST.candidates(spark, sf)
    return tidy(
        rows.select(
            "candidate_event_id", "instrument", "benchmark_family", "signal_timeframe", "session", "direction",
            "lookback", "at", "p0", "e0", "d0", "z", "signal_threshold",
        )
    )


def path_diagnostics(spark, sf):
    rows = ST.diagnosed(spark, sf)
    keep = [f"{m}_h{h}" for h in ST.SNAPSHOTS for m in ("move", "bps", "pips", "reversion")]
    keep += ["t25", "t50", "t75", "t100", "max_reversion"]
    keep += [f"{n}{s}" for n in ("mae", "mfe") for s in ("", "_pips", "_bps", "_fraction")] + ["time_to_mae", "time_to_mfe"]
    keep += [f"{n}_h{h}" for h in ST.PAST for n in ("pre_raw", "pre_signed", "impulse")]
    return tidy(
        rows.select(
            *SETUP, "at", "path_complete", F.array_join(F.col("missing_steps").cast("array<string>"), ",").alias("missing"), *keep
        )
    )


def directional_paths(spark, sf):
    """Direction-only paths of the re-armed events: clamped excursions, any horizons."""
    rows = ST.candidates(spark, sf).select("candidate_event_id", "instrument", "at", "direction", "p0", "pip")
    rows = PA.attach_paths(rows, D.bars(spark, sf), "at", ST.STEP, 12)
    out = PA.directional_paths(rows, 12, (3, 6, 12))
    return tidy(
        out.select(
            "candidate_event_id", "path_complete", *[f"{m}_h{h}" for h in (3, 6, 12) for m in ("move", "bps", "pips")],
            "mae", "mae_pips", "mfe", "mfe_pips", "mfe_bps", "time_to_mae", "time_to_mfe",
        )
    )


def path_matrix(spark, sf):
    events = ST.placed(stage(ST.diagnosed(spark, sf).drop("path", "past")), SETUP_PLACE)
    return tidy(SU.path_matrix(events, SETUP, ST.SNAPSHOTS, ST.PAST))


QUERIES = {
    f.__name__: f
    for f in (signal_grid, state_sides, rearmed_events, path_diagnostics, directional_paths, path_matrix)
}
