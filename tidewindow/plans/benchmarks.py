"""Registered queries: labels, rolling and anchored features, benchmark summaries."""

from pyspark.sql import functions as F

from tidewindow.functions.scalars import compatible_horizon
from tidewindow.operators import features as FE, observations as OB, stats as SS, summaries as SU
from tidewindow.plans import study as ST
from tidewindow.plans.study import tidy
from tidewindow.sources.staging import stage


def labelled(spark, sf):
    return OB.forward_labels(ST.research_observations(spark, sf), ST.SERIES, ST.HORIZONS_S, ST.WIDTH)


def forward_outcomes(spark, sf):
    rows = OB.melt_labels(labelled(spark, sf), ST.HORIZONS_S, ["instrument", "timeframe", "t", "active"])
    return tidy(rows.withColumnRenamed("t", "open_s"))


def observation_audit(spark, sf):
    return tidy(OB.observation_audit(labelled(spark, sf), ST.SERIES, ST.HORIZONS_S))


def band_features(spark, sf):
    rows = FE.band_features(ST.research_observations(spark, sf), ST.LOOKBACKS, ST.BARS)
    return tidy(rows.select("instrument", "timeframe", F.col("t").alias("open_s"), "lookback", "middle", "dispersion", "z"))


def vwap_features(spark, sf):
    return tidy(_vwap_columns(FE.vwap_features(ST.research_observations(spark, sf), ST.LOOKBACKS, ST.BARS)))


def fine_vwap_features(spark, sf):
    fine, obs = ST.observations(spark, sf), ST.research_observations(spark, sf)
    return tidy(_vwap_columns(FE.fine_vwap_features(fine, obs, ST.LOOKBACKS, ST.BARS)))


def _vwap_columns(rows):
    return rows.select(
        "instrument", "timeframe", F.col("t").alias("open_s"), "anchor",
        F.date_format("session_date", "yyyy-MM-dd").alias("session_date"), "lookback", "vwap", "absolute", "relative",
        "volatility", "z",
    )


def _benchmark(obs, research, features, group, contexts=None, medians=True):
    """Signals of every threshold joined to the labels of horizons that their timeframe can meet,
    summarised by direction incl. all."""
    keys = ["instrument", "timeframe", *group, "lookback"]
    # Four consumers (statistics, medians, grid, months) share one pass over the bars.
    narrow = features(obs).select(*keys, "active", "z", *[f"ret_{h}" for h in ST.HORIZONS_S])
    long = OB.melt_labels(stage(narrow), ST.HORIZONS_S, [*keys, "active", "z"])
    long = long.where(compatible_horizon(F.col("horizon_s"), F.col("timeframe")))
    months = SU.active_months(research, ["instrument", "timeframe"])
    return SU.benchmark_summary(long, keys, ST.THRESHOLDS, months, contexts, medians)


def _vwap(obs, research, medians=True):
    return _benchmark(obs, research, lambda rows: FE.vwap_features(rows, ST.LOOKBACKS, ST.BARS), ["anchor"], medians=medians)


def _band(obs, research, medians=True):
    sessions = (None, "asia", "london", "new_york")
    features = lambda rows: ST.with_contexts(FE.band_features(rows, ST.LOOKBACKS, ST.BARS))
    return _benchmark(obs, research, features, ["context"], ("context", sessions), medians)


def _fine_vwap(obs, research, fine, medians=True):
    return _benchmark(obs, research, lambda rows: FE.fine_vwap_features(fine, rows, ST.LOOKBACKS, ST.BARS), ["anchor"], medians=medians)


def vwap_benchmark(spark, sf):
    """Session-anchored deviations against exact-clock returns."""
    return tidy(_vwap(labelled(spark, sf), ST.research_observations(spark, sf)))


def band_benchmark(spark, sf):
    """Rolling bands against exact-clock returns, overall and per overlapping session."""
    return tidy(_band(labelled(spark, sf), ST.research_observations(spark, sf)))


def fine_vwap_benchmark(spark, sf):
    return tidy(_fine_vwap(labelled(spark, sf), ST.research_observations(spark, sf), ST.observations(spark, sf)))


def replication_inventory(spark, sf):
    """Rows and signals per family, timeframe and session; the three benchmarks share their bars and order no medians."""
    obs, research, fine = (stage(x) for x in (labelled(spark, sf), ST.research_observations(spark, sf), ST.observations(spark, sf)))
    parts = [
        rows.select(F.lit(family).alias("family"), "timeframe", F.col(session).alias("session"), "direction", "signal_count")
        for family, session, rows in (
            ("vwap", "anchor", _vwap(obs, research, False)),
            ("vwap-fine", "anchor", _fine_vwap(obs, research, fine, False)),
            ("band", "context", _band(obs, research, False)),
        )
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return tidy(
        rows.groupBy("family", "timeframe", "session").agg(
            F.count("*").alias("rows"), F.sum(F.when(F.col("direction") == "all", F.col("signal_count"))).alias("signals")
        )
    )


def exact_totals(spark, sf):
    """Order-independent totals of returns (decimal accumulation) next to the plain mean."""
    long = OB.melt_labels(labelled(spark, sf), ST.HORIZONS_S, ["instrument", "timeframe"])
    return tidy(
        long.groupBy("instrument", "timeframe", "horizon_s").agg(
            F.count("ret").alias("n"), SS.exact_sum(F.col("ret"), 12).alias("total"), F.avg("ret").alias("mean")
        )
    )


QUERIES = {
    f.__name__: f
    for f in (
        band_benchmark, forward_outcomes, observation_audit, band_features, vwap_features, fine_vwap_features,
        vwap_benchmark, fine_vwap_benchmark, replication_inventory, exact_totals,
    )
}
