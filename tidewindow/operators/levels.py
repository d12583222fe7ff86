"""Structural price levels and failed breakouts of them."""

from pyspark.sql import DataFrame, Window, functions as F

from tidewindow.functions import sessions as S
from tidewindow.functions.scalars import breach_depth, identity_hash, reclaim_depth
from tidewindow.operators.chunks import carry_last
from tidewindow.operators.joins import asof_backward, range_join


def _trading_date(ts):
    """Local date on which the trading day that contains ``ts`` began."""
    local = S.local_time(ts, S.TRADING_DAY.timezone)
    before_turn = F.pmod(F.unix_seconds(local), F.lit(86400)) < S.TRADING_DAY.start_minute * 60
    return F.date_sub(F.to_date(local), F.when(before_turn, 1).otherwise(0))


def _complete(grouped: DataFrame, step_s: int) -> DataFrame:
    """Keep window instances whose every step is present (start and end are in seconds)."""
    return grouped.where(F.col("_count") * step_s == F.col("end_s") - F.col("start_s"))


def complete_trading_days(bars: DataFrame, step_s: int) -> DataFrame:
    """One row per instrument and trading day with all its bars."""
    rows = bars.withColumn("day", _trading_date(F.col("open_time")))
    lo, hi = S.window_bounds(F.col("day"), S.TRADING_DAY)
    days = rows.groupBy("instrument", "day").agg(
        F.count_distinct("open_time").alias("_count"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max(F.unix_seconds("available_at")).alias("known_s"),
    )
    days = days.withColumns({"start_s": F.unix_seconds(lo), "end_s": F.unix_seconds(hi)})
    return _complete(days, step_s).drop("_count")


def _session_windows(bars: DataFrame, w: S.ClockWindow, family: str, step_s: int, opening_steps: int | None) -> DataFrame:
    day = S.instance_date(F.col("open_time"), w)
    rows = bars.where(S.contains(F.col("open_time"), w)).withColumn("day", day)
    lo, hi = S.window_bounds(F.col("day"), w)
    next_lo, _ = S.window_bounds(F.date_add("day", 1), w)
    rows = rows.withColumns({"start_s": F.unix_seconds(lo), "_close_s": F.unix_seconds(hi), "_next_s": F.unix_seconds(next_lo)})
    if opening_steps is None:
        rows = rows.withColumns({"end_s": F.col("_close_s"), "expires_s": F.col("_next_s")})
    else:
        rows = rows.withColumns({"end_s": F.col("start_s") + opening_steps * step_s, "expires_s": F.col("_close_s")})
        rows = rows.where(F.unix_seconds("open_time") < F.col("end_s"))
    grouped = rows.groupBy("instrument", "day", "start_s", "end_s", "expires_s").agg(
        F.count_distinct("open_time").alias("_count"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max(F.unix_seconds("available_at")).alias("known_s"),
    )
    return _complete(grouped, step_s).select(
        "instrument", F.lit(family).alias("anchor_family"), "day", "high", "low", "known_s", F.col("end_s").alias("ready_s"), "expires_s"
    )


def structural_levels(bars: DataFrame, step_s: int, opening_steps: int, width: int) -> DataFrame:
    """High and low of the previous trading day, the Asia session and the London opening.

    Scale is the range of the latest complete trading day that ended by then; a level is valid
    strictly after ``available_s`` and before ``expires_s``.
    """
    days = complete_trading_days(bars, step_s)
    scales = days.select(
        "instrument", "end_s", F.struct("high", "low", "known_s").alias("_day")
    )
    latest = bars.groupBy("instrument").agg(F.max(F.unix_seconds("available_at")).alias("_latest"))
    local = F.to_date(S.local_time(F.col("open_time"), S.TRADING_DAY.timezone))
    lo, hi = S.window_bounds(F.col("day"), S.TRADING_DAY)
    previous = (
        bars.select("instrument", local.alias("day"))
        .distinct()
        .withColumns({"ready_s": F.unix_seconds(lo), "expires_s": F.unix_seconds(hi)})
        .join(latest, "instrument")
        .where(F.col("ready_s") <= F.col("_latest"))
        .select(
            "instrument",
            F.lit("previous-day").alias("anchor_family"),
            "day",
            F.lit(None).cast("double").alias("high"),
            F.lit(None).cast("double").alias("low"),
            F.col("ready_s").alias("known_s"),
            "ready_s",
            "expires_s",
        )
    )
    asia, london = S.MAJOR_SESSIONS[0], S.MAJOR_SESSIONS[1]
    anchors = previous.unionByName(_session_windows(bars, asia, "asia-session", step_s, None)).unionByName(
        _session_windows(bars, london, "london-opening", step_s, opening_steps)
    )
    scaled = asof_backward(
        anchors, scales.withColumnRenamed("end_s", "ready_s"), ["instrument"], "ready_s", "_day", "_scale", width
    ).where(F.col("_scale").isNotNull())
    c = F.col
    scaled = scaled.withColumns(
        {
            "scale": c("_scale.high") - c("_scale.low"),
            "high": F.coalesce("high", "_scale.high"),
            "low": F.coalesce("low", "_scale.low"),
            "available_s": F.greatest("ready_s", "known_s", "_scale.known_s"),
        }
    ).where((c("scale") > 0) & (c("available_s") < c("expires_s")))
    sides = F.array(
        F.struct(F.lit("upper").alias("side"), c("high").alias("price"), F.lit("high").alias("_tag")),
        F.struct(F.lit("lower").alias("side"), c("low").alias("price"), F.lit("low").alias("_tag")),
    )
    return scaled.select("*", F.inline(sides)).select(
        "instrument",
        F.concat_ws("-", "anchor_family", "_tag", F.date_format("day", "yyyy-MM-dd")).alias("level_id"),
        "anchor_family",
        "side",
        "price",
        "scale",
        "available_s",
        "expires_s",
    )


def failed_breakouts(bars: DataFrame, levels: DataFrame, step_s: int, reclaim_steps: int, depths, width: int, tasks: int | None = None) -> DataFrame:
    """Closes beyond a level that come back inside within the reclaim window.

    Levels are dealt to ``tasks``, if given, before depths multiply their rows: a number that follows the
    bars keeps what one task orders the same at every size.

    Per level (at most a day of bars): runs of outside closes are islands that a gap also
    ends; a run counts only when an inside close, or a fresh level, comes right before it.
    """
    c = F.col
    clocks = bars.select(
        "instrument", F.unix_seconds("available_at").alias("at"), "high", "low", "close"
    )
    clocks = carry_last(clocks, ["instrument"], "at", c("at"), width, "at", "_prev_at")
    clocks = clocks.withColumn("_gap", F.coalesce(c("at") - c("_prev_at") != step_s, F.lit(False))).drop("_prev_at")
    rows = range_join(clocks, levels, ["instrument"], "at", "available_s", "expires_s", 86400)
    rows = rows.withColumns(
        {
            "_out": F.when(c("side") == "upper", c("close") > c("price")).otherwise(c("close") < c("price")),
            "depth": breach_depth(c("side"), c("price"), c("high"), c("low"), c("scale")),
        }
    )
    if tasks is not None:
        rows = rows.repartition(tasks, "instrument", "level_id")
    rows = rows.withColumn("minimum_depth", F.explode(F.array(*[F.lit(float(d)) for d in depths])))
    level = ["instrument", "level_id", "minimum_depth"]
    order = Window.partitionBy(*level).orderBy("at")
    first = F.row_number().over(order) == 1
    stale = c("at") - c("available_s") > step_s
    before = F.lag("_out").over(order)
    rows = rows.withColumns(
        {
            "_starts": first | c("_gap") | (before != c("_out")),
            "_fresh": F.when(first, ~stale).otherwise(~c("_gap") & ~before),
            "_reclaims": ~first & ~c("_gap") & before & ~c("_out"),
        }
    ).withColumn("_run", F.sum(c("_starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*level, "_run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_usable", F.first("_fresh").over(run) & c("_out"))
    rows = rows.withColumn(
        "_broke", F.min(F.when(c("_usable") & (c("depth") >= c("minimum_depth")), c("at"))).over(run)
    )
    rows = rows.withColumns(
        {
            "_first_depth": F.max(F.when(c("at") == c("_broke"), c("depth"))).over(run),
            "_max_depth": F.max(F.when(c("_broke").isNotNull(), c("depth"))).over(run),
            "_outside": F.sum(F.when(c("_broke").isNotNull(), 1).otherwise(0)).over(run),
        }
    )
    lagged = {f"{n}_l": F.lag(n).over(order) for n in ("_broke", "_first_depth", "_max_depth", "_outside")}
    rows = rows.withColumns(lagged).where(
        c("_reclaims") & c("_broke_l").isNotNull() & (c("at") <= c("_broke_l") + reclaim_steps * step_s)
    )
    return rows.select(
        "instrument",
        "level_id",
        "anchor_family",
        "minimum_depth",
        "side",
        "price",
        "scale",
        F.when(c("side") == "upper", -1).otherwise(1).alias("direction"),
        c("_broke_l").alias("breakout_s"),
        "at",
        c("close").alias("p0"),
        c("_first_depth_l").alias("initial_depth"),
        F.greatest("_max_depth_l", "depth").alias("max_depth"),
        c("_outside_l").alias("outside_closes"),
        ((c("at") - c("_broke_l")) / step_s).cast("long").alias("steps_to_reclaim"),
        reclaim_depth(c("side"), c("price"), c("close"), c("scale")).alias("reclaim_inside"),
        identity_hash("failed-breakout-", c("instrument"), c("level_id"), c("_broke_l"), c("at"), c("minimum_depth")).alias("event_id"),
    )
