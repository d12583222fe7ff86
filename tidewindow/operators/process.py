"""Rolling first-order process fits of deviations, and the gate built on them."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewindow.operators.chunks import core_only, halo, running_sum, same_keys
from tidewindow.operators.quality import collapse_identical

PROCESS = ("instrument", "benchmark_family", "signal_timeframe", "session", "lookback")


def residuals(states: DataFrame, keys=PROCESS) -> DataFrame:
    """One row per process and instant; both directions must agree on price and anchor."""
    rows = states.select(*keys, "at", F.col("close").alias("p0"), "e0")
    return collapse_identical(rows, [*keys, "at"], ["p0", "e0"]).withColumn("deviation", F.col("p0") - F.col("e0"))


def fit_states(
    rows: DataFrame, tf_s: Column, max_tf_s: int, window: int, width: int, rank_width: int = 4096, keys=PROCESS
) -> DataFrame:
    """Least-squares fit of the last ``window`` adjacent transitions, at every row.

    A pair of rows that is not exactly one timeframe apart is dropped and does not reset the
    history, so the frame runs over the rank of valid pairs.  Rows are numbered by a chunked
    prefix sum, fits are computed in rank chunks with a margin, and each row looks up the fit
    of the latest pair it has seen.
    """
    keys = list(keys)
    placed = halo(rows.withColumn("_tf", tf_s), F.col("at"), width, back=max_tf_s)
    order = Window.partitionBy(*keys, "_chunk").orderBy("at")
    adjacent = F.col("at") - F.lag("at").over(order) == F.col("_tf")
    seen = core_only(placed.withColumn("_x", F.when(adjacent, F.lag("deviation").over(order))))
    seen = running_sum(seen, keys, "at", F.col("at"), width, F.col("_x").isNotNull().cast("long"), "transitions")
    pairs = seen.where(F.col("_x").isNotNull()).select(
        *keys, F.col("transitions").alias("_rank"), F.col("_x").alias("x"), F.col("deviation").alias("y")
    )
    ranked = halo(pairs, F.col("_rank"), rank_width, back=window)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_rank").rowsBetween(-(window - 1), 0)
    fits = core_only(
        ranked.withColumns(
            {
                "_n": F.count("*").over(w),
                "_mx": F.avg("x").over(w),
                "_my": F.avg("y").over(w),
                "_sxx": F.regr_sxx("y", "x").over(w),
                "_sxy": F.regr_sxy("y", "x").over(w),
                "_syy": F.regr_syy("y", "x").over(w),
                "_flat": F.max("x").over(w) == F.min("x").over(w),
            }
        )
    ).where(F.col("_n") == window).drop("x", "y", "_n")
    cond = same_keys(keys) & (F.col("l.transitions") == F.col("r._rank"))
    extra = ["_mx", "_my", "_sxx", "_sxy", "_syy", "_flat"]
    joined = seen.alias("l").join(fits.alias("r"), cond, "left").select("l.*", *[F.col(f"r.{c}") for c in extra])
    return _map_states(joined, window).drop("_x", *extra)


def _map_states(rows: DataFrame, window: int) -> DataFrame:
    c = F.col
    enough = c("transitions") >= window
    usable = enough & ~c("_flat")
    rows = rows.withColumn("phi", F.when(usable, c("_sxy") / c("_sxx")))
    rows = rows.withColumn("intercept", c("_my") - c("phi") * c("_mx"))
    sse = F.greatest(F.lit(0.0), c("_syy") - c("phi") * c("_sxy"))
    # The one-pass residual sum is noise below this share of the total: treat it as exact fit.
    rows = rows.withColumn("_var", F.when(sse > c("_syy") * 1e-12, sse / (window - 2)).otherwise(F.lit(0.0)))
    rows = rows.withColumns(
        {
            "innovation_sigma": F.when(usable & (c("_var") > 0), F.sqrt("_var")),
            "phi_se": F.when(usable & (c("_var") > 0), F.sqrt(c("_var") / c("_sxx"))),
            "r_squared": F.when(usable & (c("_syy") > 0), F.lit(1.0) - sse / c("_syy")),
        }
    )
    reason = (
        F.when(~enough, "insufficient_history")
        .when(c("_flat"), "degenerate_regression")
        .when(c("phi") <= 0, "phi_non_positive")
        .when(c("phi") >= 1, "phi_not_below_one")
        .when(c("innovation_sigma").isNull(), "non_positive_innovation_variance")
    )
    rows = rows.withColumn("invalid_reason", reason).withColumn(
        "status",
        F.when(c("invalid_reason") == "insufficient_history", "unavailable")
        .when(c("invalid_reason").isNotNull(), "invalid")
        .otherwise("valid"),
    )
    ok = c("status") == "valid"
    rows = rows.withColumns(
        {
            "kappa": F.when(ok, -F.ln("phi") / (c("_tf") / 60.0)),
            "long_run_mean": F.when(ok, c("intercept") / (1.0 - c("phi"))),
            "stationary_sigma": F.when(ok, c("innovation_sigma") / F.sqrt(1.0 - c("phi") * c("phi"))),
        }
    )
    return rows.withColumns(
        {
            "half_life": F.lit(0.6931471805599453) / c("kappa"),
            "score": (c("deviation") - c("long_run_mean")) / c("stationary_sigma"),
        }
    ).drop("_var", "_tf")


def align(candidates: DataFrame, states: DataFrame, keys=PROCESS, how: str = "left") -> DataFrame:
    """Exact-clock join of candidates to process states; never the nearest state."""
    extra = [
        "transitions", "phi", "intercept", "phi_se", "innovation_sigma", "r_squared", "invalid_reason", "status",
        "kappa", "long_run_mean", "stationary_sigma", "half_life", "score",
    ]
    cond = same_keys([*keys, "at"])
    return candidates.alias("l").join(states.alias("r"), cond, how).select("l.*", *[F.col(f"r.{c}") for c in extra])


def gate(aligned: DataFrame, scope: Column, min_score: float, half_life_cap: float | None, spec_id: str = "ou-v1") -> DataFrame:
    """Adds eligible and the first reason against, in the fixed order of the checks."""
    c = F.col
    directional = c("score") * -c("direction")
    reason = (
        F.when(~F.coalesce(scope, F.lit(False)), "outside_frozen_signal_scope")
        .when(c("status").isNull(), "missing_exact_state")
        .when(c("status") != "valid", F.concat(F.lit("ou_status_"), c("status")))
        .when(directional.isNull() | F.isnan(directional), "non_finite_directional_score")
        .when(directional <= min_score, "directional_score_not_strictly_above_threshold")
        .when(c("half_life").isNull() | F.isnan("half_life"), "non_finite_half_life")
    )
    if half_life_cap is not None:
        reason = reason.when(c("half_life") > half_life_cap, "half_life_above_cap")
    return aligned.withColumns(
        {"directional_score": directional, "eligibility_reason": reason.otherwise("eligible")}
    ).withColumns(
        {
            "eligible": c("eligibility_reason") == "eligible",
            "filter_family": F.lit("ornstein-uhlenbeck"),
            "filter_spec_id": F.lit(spec_id),
            "filter_metadata": F.create_map(
                F.lit("ou_status"), F.coalesce("status", F.lit("missing")),
                F.lit("eligibility_reason"), c("eligibility_reason"),
            ),
        }
    )
