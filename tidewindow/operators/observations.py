"""Bars as research observations, their exact-clock labels and the audit of both."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewindow.functions import sessions as S
from tidewindow.functions.scalars import is_flat_inactive, seconds, timeframe_seconds
from tidewindow.operators.chunks import core_only, halo


def observe(bars: DataFrame, major=S.MAJOR_SESSIONS) -> DataFrame:
    """Add the activity flag, the open clock ``t``, its bar number ``k`` and the clock ``at``.

    Bars are epoch aligned, so ``k = t / timeframe`` numbers them on one scale for every
    timeframe: adjacent bars differ by exactly one.
    """
    c = F.col
    return bars.withColumn("tf_s", timeframe_seconds(c("timeframe"))).withColumns(
        {
            "t": seconds(c("open_time")),
            "k": F.floor(seconds(c("open_time")) / c("tf_s")).cast("long"),
            "at": seconds(c("available_at")),
            "active": ~is_flat_inactive(c("open"), c("high"), c("low"), c("close"), c("volume")),
            "active_sessions": S.active_names(c("open_time"), major),
        }
    )


def as_of(bars: DataFrame, instant: Column) -> DataFrame:
    """Only what was known at ``instant``.

    ``available_at`` is computed when bars come from ticks, so the filter stays above the scan: pass
    the instant to the source as well (``bars(..., until=)``) to prune it.
    """
    return bars.where(F.col("available_at") <= instant)


def forward_labels(obs: DataFrame, keys, horizons_s, width: int) -> DataFrame:
    """Adds ``target_<h>`` and ``ret_<h>``: the active close exactly ``h`` later, or NULL.

    The target is found with a RANGE frame that is one instant wide, so all horizons come out
    of one shuffle and a missing clock stays missing.
    """
    spread = halo(obs, F.col("at"), width, ahead=max(horizons_s))
    base = Window.partitionBy(*keys, "_chunk").orderBy("at")
    usable = F.when(F.col("active"), F.col("close"))
    out = spread.withColumns(
        {f"target_{h}": F.first(usable).over(base.rangeBetween(h, h)) for h in horizons_s}
    )
    out = core_only(out)
    return out.withColumns(
        {f"ret_{h}": F.when(F.col("active"), F.col(f"target_{h}") / F.col("close") - 1.0) for h in horizons_s}
    )


def melt_labels(labelled: DataFrame, horizons_s, keep) -> DataFrame:
    """One row per (row, horizon) with ``horizon_s`` and ``ret``."""
    items = F.array(
        *[F.struct(F.lit(h).cast("long").alias("horizon_s"), F.col(f"ret_{h}").alias("ret")) for h in horizons_s]
    )
    return labelled.select(*keep, F.explode(items).alias("_i")).select(*keep, "_i.*")


def observation_audit(labelled: DataFrame, keys, horizons_s) -> DataFrame:
    return labelled.groupBy(*keys).agg(
        F.count("*").alias("source_bars"),
        F.count_if("active").alias("active_bars"),
        F.count_if(~F.col("active")).alias("inactive_bars"),
        *[F.count(f"ret_{h}").alias(f"valid_{h}") for h in horizons_s],
        *[(F.count("*") - F.count(f"ret_{h}")).alias(f"unavailable_{h}") for h in horizons_s],
    )
