"""Gap-safe rolling and session-anchored features.

Bars of one series never overlap, so ``n`` rows whose bar numbers ``k`` span ``n - 1`` are
exactly ``n`` adjacent bars.  That one fact replaces every gap bookkeeping: a look-back that
meets a gap simply counts fewer rows and yields NULL.  Frames are RANGE frames over ``k``, so
all timeframes go through one plan; ``width`` is the chunk size in bars.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewindow.functions import sessions as S
from tidewindow.functions.scalars import lower_wick, true_range, typical_price, upper_wick
from tidewindow.operators.chunks import core_only, halo

SERIES = ("instrument", "timeframe")


def _frame(rows: int):
    return Window.partitionBy(*SERIES, "_chunk").orderBy("k").rangeBetween(-(rows - 1), 0)


def _lag_adjacent(column: Column) -> Column:
    return F.first(column).over(Window.partitionBy(*SERIES, "_chunk").orderBy("k").rangeBetween(-1, -1))


def band_features(obs: DataFrame, lookbacks, width: int) -> DataFrame:
    """Rolling mean and sample deviation of exactly N adjacent active closes, long by lookback."""
    spread = halo(obs, F.col("k"), width, back=max(lookbacks))
    usable = F.when(F.col("active"), F.col("close"))
    cells = {}
    for n in lookbacks:
        w = _frame(n)
        full = F.count(usable).over(w) == n
        spreadless = F.max(usable).over(w) == F.min(usable).over(w)
        cells[f"_mid_{n}"] = F.when(full, F.avg(usable).over(w))
        cells[f"_sd_{n}"] = F.when(full & ~spreadless, F.stddev_samp(usable).over(w))
    out = core_only(spread.withColumns(cells))
    items = F.array(
        *[
            F.struct(
                F.lit(n).alias("lookback"),
                F.col(f"_mid_{n}").alias("middle"),
                F.col(f"_sd_{n}").alias("dispersion"),
                ((F.col("close") - F.col(f"_mid_{n}")) / F.col(f"_sd_{n}")).alias("z"),
            )
            for n in lookbacks
        ]
    )
    return out.select(*obs.columns, F.explode(items).alias("_i")).select(*obs.columns, "_i.*")


def return_volatility(obs: DataFrame, lookbacks, width: int) -> DataFrame:
    """Adds ``vol_<n>``: sample deviation of exactly N adjacent active returns (0 -> NULL)."""
    spread = halo(obs, F.col("k"), width, back=max(lookbacks) + 1)
    usable = F.when(F.col("active"), F.col("close"))
    spread = spread.withColumn("_r", usable / _lag_adjacent(usable) - 1.0)
    cells = {}
    for n in lookbacks:
        w = _frame(n)
        flat = F.max("_r").over(w) == F.min("_r").over(w)
        cells[f"vol_{n}"] = F.when((F.count("_r").over(w) == n) & ~flat, F.stddev_samp("_r").over(w))
    return core_only(spread.withColumns(cells)).drop("_r")


def by_session(obs: DataFrame) -> DataFrame:
    """One row per (bar, open major session) with the session's start date."""
    rows = obs.select("*", F.explode("active_sessions").alias("anchor"))
    return rows.withColumn("session_date", S.instance_of(F.col("open_time"), F.col("anchor")))


def session_vwap(anchored: DataFrame, order: str = "t") -> DataFrame:
    """Running activity-weighted price of one session instance; NULL while no weight.

    The partition is one session of one instrument, so it is bounded by the session length.
    """
    weight = F.when(F.col("active"), F.col("volume"))
    price = typical_price(F.col("high"), F.col("low"), F.col("close"))
    w = (
        Window.partitionBy(*SERIES, "anchor", "session_date")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    total = F.sum(weight).over(w)
    return anchored.withColumn("vwap", F.when(total > 0, F.sum(price * weight).over(w) / total))


def _deviations(rows: DataFrame, lookbacks) -> DataFrame:
    keep = [c for c in rows.columns if not c.startswith("vol_")]
    relative = F.col("close") / F.col("vwap") - 1.0
    items = F.array(
        *[
            F.struct(
                F.lit(n).alias("lookback"),
                (F.col("close") - F.col("vwap")).alias("absolute"),
                relative.alias("relative"),
                F.col(f"vol_{n}").alias("volatility"),
                (relative / F.col(f"vol_{n}")).alias("z"),
            )
            for n in lookbacks
        ]
    )
    return rows.select(*keep, F.explode(items).alias("_i")).select(*keep, "_i.*")


def vwap_features(obs: DataFrame, lookbacks, width: int) -> DataFrame:
    vol = return_volatility(obs, lookbacks, width)
    return _deviations(session_vwap(by_session(vol)), lookbacks)


def fine_vwap_features(fine: DataFrame, obs: DataFrame, lookbacks, width: int) -> DataFrame:
    """Session VWAP accumulated on fine bars, sampled at each coarse bar's availability.

    As-of by union: fine rows sort before coarse rows of the same instant, and the running
    sums stop at the session instance, so nothing is carried across a reset.
    """
    vol = return_volatility(obs, lookbacks, width)
    coarse = by_session(vol)
    weight = F.when(F.col("active"), F.col("volume"))
    source = by_session(fine).select(
        "instrument",
        "anchor",
        "session_date",
        F.col("at"),
        F.lit(0).alias("_side"),
        (typical_price(F.col("high"), F.col("low"), F.col("close")) * weight).alias("_pv"),
        weight.alias("_w"),
        F.lit(None).cast(coarse.select(F.struct(*coarse.columns)).schema[0].dataType).alias("_row"),
    )
    probe = coarse.select(
        "instrument",
        "anchor",
        "session_date",
        F.col("at"),
        F.lit(1).alias("_side"),
        F.lit(None).cast("double").alias("_pv"),
        F.lit(None).cast("double").alias("_w"),
        F.struct(*coarse.columns).alias("_row"),
    )
    w = (
        Window.partitionBy("instrument", "anchor", "session_date")
        .orderBy("at", "_side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    total = F.sum("_w").over(w)
    sampled = (
        source.unionByName(probe)
        .withColumn("vwap", F.when(total > 0, F.sum("_pv").over(w) / total))
        .where(F.col("_side") == 1)
        .select("_row.*", "vwap")
    )
    return _deviations(sampled, lookbacks)


def signal_side(active: Column, z: Column, threshold) -> Column:
    """+1 below -threshold, -1 above +threshold; equality and inactivity do not signal."""
    limit = F.lit(float(threshold))
    return F.when(active & (z < -limit), 1).when(active & (z > limit), -1)


def trend_features(
    obs: DataFrame, width: int, trend: int = 8, tail: int = 4, atr: int = 20
) -> DataFrame:
    """Inputs of the exhaustion rule, only where trend+tail+ATR history is gap-free."""
    need = atr + tail + 1
    spread = halo(obs, F.col("k"), width, back=need)
    order = Window.partitionBy(*SERIES, "_chunk").orderBy("k")
    c = F.col
    rows = spread.withColumns(
        {
            "_prev": F.lag("close").over(order),
            "_have": F.count("*").over(_frame(need)),
            "_vprev": F.lag("volume").over(order),
        }
    ).withColumns(
        {"_tr": true_range(c("high"), c("low"), c("_prev")), "_step": F.abs(c("close") - c("_prev"))}
    )
    before = order.rowsBetween(-(atr + tail - 1), -tail)
    path = order.rowsBetween(-(trend + tail - 2), -tail)
    last = order.rowsBetween(-(tail - 1), 0)
    rows = rows.withColumns(
        {
            "atr": F.sum("_tr").over(before) / atr,
            "_start": F.lag("close", trend + tail - 1).over(order),
            "_end": F.lag("close", tail).over(order),
            "_changes": F.sum("_step").over(path),
            "_top": F.max("high").over(last),
            "_bottom": F.min("low").over(last),
        }
    )
    rows = core_only(rows).where(c("_have") == need)
    rows = rows.withColumn("displacement", c("_end") - c("_start")).withColumn(
        "trend_direction", F.signum("displacement").cast("int")
    )
    up = c("trend_direction")
    body = F.abs(c("close") - c("open"))
    wicks = upper_wick(c("open"), c("high"), c("close")), lower_wick(c("open"), c("low"), c("close"))
    return rows.withColumns(
        {
            "normalized_displacement": F.when(c("atr") > 0, F.abs("displacement") / c("atr")),
            "efficiency": F.coalesce(F.try_divide(F.abs("displacement"), c("_changes")), F.lit(0.0)),
            "extension": F.when(up > 0, c("_top") - c("_end")).when(up < 0, c("_end") - c("_bottom")),
            "retained": up * (c("close") - c("_end")),
            "last_move": up * (c("close") - c("_prev")),
            "upper_wick": wicks[0],
            "lower_wick": wicks[1],
            "body": body,
            "wick_body_ratio": F.try_divide(wicks[0] + wicks[1], body),
            "bar_range": c("high") - c("low"),
            "volume_change": c("volume") - c("_vprev"),
        }
    ).drop("_prev", "_vprev", "_have", "_tr", "_step", "_start", "_end", "_changes", "_top", "_bottom")


def exhausted(threshold, min_efficiency=0.60, min_extension=0.25, max_retained=0.10) -> Column:
    """Trend-exhaustion rule on :func:`trend_features`; false when the range is degenerate."""
    c = F.col
    rule = (
        (c("normalized_displacement") > threshold)
        & (c("efficiency") >= min_efficiency)
        & (c("extension") >= min_extension * c("atr"))
        & (c("retained") <= max_retained * c("atr"))
        & (c("last_move") < 0)
    )
    return F.coalesce(rule & (c("atr") > 0) & (c("trend_direction") != 0), F.lit(False))


def episode_starts(rows: DataFrame, width: int, flag: Column, keys=SERIES) -> DataFrame:
    """Rows where ``flag`` turns true; a false row, a gap or missing history re-arms."""
    tagged = rows.withColumn("_f", flag)
    spread = halo(tagged, F.col("k"), width, back=1)
    step = Window.partitionBy(*keys, "_chunk").orderBy("k").rangeBetween(-1, -1)
    before = F.coalesce(F.first("_f").over(step), F.lit(False))
    return core_only(spread.withColumn("_b", before)).where(F.col("_f") & ~F.col("_b")).drop("_f", "_b")
