"""Registered queries: process fits, the gate built on them, replay comparison, residual shocks."""

from pyspark.sql import functions as F

from tidewindow.functions.scalars import timeframe_seconds
from tidewindow.operators import events as EV, outcomes as OC, panel as PN, paths as PA, process as PR, summaries as SU
from tidewindow.operators import features as FE, stats as SS
from tidewindow.plans import study as ST
from tidewindow.plans.study import tidy
from tidewindow.sources import driver as D
from tidewindow.sources.staging import stage

WINDOW = 16
MIN_SCORE = 0.5
HALF_LIFE_CAP = 600.0


def _sides(spark, sf):
    return stage(ST.two_sided_states(spark, sf))


def _fits(sides):
    rows = stage(PR.residuals(sides))
    tf_s = timeframe_seconds(F.col("signal_timeframe"))
    return PR.fit_states(rows, tf_s, max(ST.TIMEFRAMES.values()), WINDOW, ST.WIDTH, rank_width=64)


def residual_rows(spark, sf):
    """Direction-free residuals: LONG and SHORT copies collapse, disagreement fails."""
    rows = PR.residuals(ST.two_sided_states(spark, sf))
    return tidy(
        rows.groupBy("instrument", "benchmark_family", "signal_timeframe", "session", "lookback").agg(
            F.count("*").alias("rows"), F.avg("deviation").alias("mean_deviation"), F.max("at").alias("last_s")
        )
    )


def process_states(spark, sf):
    return tidy(
        _fits(_sides(spark, sf)).select(
            *PR.PROCESS, "at", "deviation", "transitions", "status", "invalid_reason", "phi", "intercept", "phi_se",
            "innovation_sigma", "r_squared", "kappa", "long_run_mean", "half_life", "stationary_sigma", "score",
        )
    )


def _scope():
    """Fixed scope of the gate: short, London, the anchored families."""
    return (F.col("session") == "london") & (F.col("direction") == -1) & F.col("benchmark_family").isin("vwap", "vwap-fine")


def _gated(spark, sf):
    sides = _sides(spark, sf)
    candidates = ST.candidates(spark, sf, sides)
    aligned = PR.align(candidates, _fits(sides))
    return PR.gate(aligned, _scope(), MIN_SCORE, HALF_LIFE_CAP)


def candidate_alignment(spark, sf):
    """Candidates with the state at exactly their clock, counted by status."""
    sides = _sides(spark, sf)
    rows = PR.align(ST.candidates(spark, sf, sides), _fits(sides))
    return tidy(
        rows.groupBy("benchmark_family", F.coalesce("status", F.lit("missing")).alias("status"), "invalid_reason").agg(
            F.count("*").alias("candidates"), F.avg("half_life").alias("mean_half_life")
        )
    )


def gate_decisions(spark, sf):
    rows = _gated(spark, sf)
    return tidy(rows.select("candidate_event_id", "eligible", "eligibility_reason", "directional_score", "half_life"))


def replay_comparison(spark, sf):
    """Ungated against gated outcomes: mergeable sums per instrument, merged over instruments."""
    events = stage(_gated(spark, sf).withColumn("in_scope", _scope()).where("in_scope"))
    paths = PA.attach_paths(events, D.bars(spark, sf), "at", ST.STEP, ST.EXTENSION + max(ST.STOPS))
    entries = OC.with_entries(paths, ST.RECLAIM, ST.EXTENSION).where(F.col("entry_mode") == "immediate")
    rows = OC.barrier_outcomes(entries, ST.STOPS[1:], (0.75, 1.0), (0.25, 0.5)).where("complete")
    variants = F.when(F.col("eligible"), F.array(F.lit("ungated"), F.lit("gated"))).otherwise(F.array(F.lit("ungated")))
    rows = stage(rows.select("instrument", "pips_adverse", "mfe_pips", "mae_pips", F.explode(variants).alias("variant")))
    parts = SU.partial_metrics(rows, ["variant", "instrument"], "pips_adverse")
    both = parts.unionByName(parts.withColumn("instrument", F.lit("ALL")))
    merged = SU.merge_metrics(both, ["variant", "instrument"])
    tagged = rows.unionByName(rows.withColumn("instrument", F.lit("ALL")))
    keys = ["variant", "instrument"]
    merged = SS.attach(merged, SS.quantiles(tagged, keys, "pips_adverse", {"median": 0.5}), keys)
    base = merged.where("variant = 'ungated'").select("instrument", F.col("n").alias("_base"))
    return tidy(SS.attach(merged, base, ["instrument"]).withColumn("retention", F.try_divide("n", "_base")).drop("_base"))


def gated_outcomes(spark, sf):
    """Every grid cell of the candidates that the process gate admits; the others never meet a bar."""
    sides = _sides(spark, sf)
    events = PR.align(ST.candidates(spark, sf, sides), _fits(sides))
    gate = lambda rows: PR.gate(rows, _scope(), MIN_SCORE, HALF_LIFE_CAP)
    rows = ST.outcomes(spark, sf, gate, events)
    keys = ["instrument", "filter_family", "filter_spec_id", "entry_mode", "tp", "sl", "stop"]
    return tidy(
        rows.groupBy(*keys).agg(
            F.count("*").alias("candidates"), F.count_if("complete").alias("complete_trades"),
            F.count_if(F.col("status") == "passed").alias("passed"), F.avg("pips_adverse").alias("mean_pips"),
        )
    )


def residual_shocks(spark, sf):
    """Rolling principal-component residuals of each universe's panel, with shock episodes."""
    panel = PN.synchronized_panel(D.bars(spark, sf), D.universe(), D.member(), D.MEMBERS)
    rows = PN.pca_residuals(stage(panel), D.MEMBERS, 48, 2, 24, ST.WIDTH, rank_width=128)
    return tidy(PN.residual_shocks(stage(rows), ST.WIDTH))


def band_shocks(spark, sf):
    """Hysteresis episodes on band scores: enter at 1.5, leave below 0.5, sign frozen."""
    rows = FE.band_features(ST.research_observations(spark, sf), ST.LOOKBACKS, ST.BARS).where(F.col("z").isNotNull())
    rows = stage(rows.select("instrument", "timeframe", "lookback", "at", "z"))
    out = EV.shock_episodes(rows, ["instrument", "timeframe", "lookback"], "at", ST.WIDTH, "z", 1.5, 0.5)
    return tidy(out.drop("z"))


QUERIES = {
    f.__name__: f
    for f in (
        residual_rows, process_states, candidate_alignment, gate_decisions, replay_comparison, gated_outcomes,
        residual_shocks, band_shocks,
    )
}
