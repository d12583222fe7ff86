"""Epoch-aligned OHLCV resampling that never fills gaps."""

from pyspark.sql import DataFrame, functions as F

from tidewindow.functions.scalars import UNIT_SECONDS, seconds


def duration(timeframe: str) -> int:
    return int(timeframe[:-1]) * UNIT_SECONDS[timeframe[-1]]


def _windows(bars: DataFrame, source: str, targets) -> DataFrame:
    step = duration(source)
    for target in targets:
        width = duration(target)
        if width <= step or width % step:
            raise ValueError(f"{target} is not a larger integer multiple of {source}")
    opened, closed = seconds(F.col("open_time")), seconds(F.col("close_time"))
    # All targets in one pass: a bar is copied once per target and grouped once.
    grid = F.array(
        *[F.struct(F.lit(t).alias("timeframe"), F.lit(duration(t)).cast("long").alias("tf_s")) for t in targets]
    )
    rows = bars.drop("timeframe").select("*", F.explode(grid).alias("_g")).select("*", "_g.*").drop("_g")
    rows = rows.withColumns({"_o": opened, "window_s": F.floor(opened / F.col("tf_s")) * F.col("tf_s")})
    on_grid = ((F.col("_o") - F.col("window_s")) % step == 0) & (closed - F.col("_o") == step)
    first, last = F.min_by("open", "_o"), F.max_by("close", "_o")
    return rows.groupBy("instrument", "timeframe", "tf_s", "window_s").agg(
        F.count("*").alias("observed"),
        F.sum(F.when(on_grid, 1).otherwise(0)).alias("_on_grid"),
        F.max("available_at").alias("_available"),
        first.alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        last.alias("close"),
        F.min("price_basis").alias("price_basis"),
        F.sum("volume").alias("_volume"),
        F.min("volume_semantics").alias("volume_semantics"),
    ).withColumn("expected", (F.col("tf_s") / step).cast("long"))


def _complete():
    return (F.col("observed") == F.col("expected")) & (F.col("_on_grid") == F.col("expected"))


def resample(bars: DataFrame, source: str, *targets: str) -> DataFrame:
    """Complete windows only.  ``bars`` must be free of duplicate intervals (see quality)."""
    done = _windows(bars, source, targets).where(_complete())
    close_time = F.timestamp_seconds(F.col("window_s") + F.col("tf_s"))
    return done.select(
        "instrument",
        "timeframe",
        F.timestamp_seconds("window_s").alias("open_time"),
        close_time.alias("close_time"),
        F.greatest(close_time, F.col("_available")).alias("available_at"),
        "open",
        "high",
        "low",
        "close",
        "price_basis",
        F.when(F.col("volume_semantics") != "none", F.coalesce("_volume", F.lit(0.0))).alias("volume"),
        "volume_semantics",
    )


def incomplete_windows(bars: DataFrame, source: str, *targets: str) -> DataFrame:
    """Windows that hold some bars but not all; wholly absent windows are not invented."""
    return _windows(bars, source, targets).where(~_complete()).select(
        "instrument",
        "timeframe",
        F.timestamp_seconds("window_s").alias("open_time"),
        F.timestamp_seconds(F.col("window_s") + F.col("tf_s")).alias("close_time"),
        "expected",
        "observed",
    )


def conservation(bars: DataFrame, source: str, *targets: str) -> DataFrame:
    """Per instrument and target: complete bars x components + leftovers = source rows.

    The source rows are counted on their own, before any windowing.
    """
    accounted = F.when(_complete(), F.col("expected")).otherwise(F.col("observed"))
    windows = _windows(bars, source, targets).groupBy("instrument", "timeframe").agg(
        F.count_if(_complete()).alias("complete_windows"),
        F.count_if(~_complete()).alias("incomplete_windows"),
        F.sum(accounted).alias("accounted_rows"),
    )
    rows = bars.groupBy("instrument").agg(F.count("*").alias("source_rows"))
    return windows.join(rows, "instrument").withColumn("conserved", F.col("accounted_rows") == F.col("source_rows"))
