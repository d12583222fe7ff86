"""Turning states into events: re-arm de-duplication and hysteresis episodes."""

from pyspark.sql import Column, DataFrame, functions as F

from tidewindow.functions.scalars import identity_hash
from tidewindow.operators.chunks import carry_last

STATE_KEYS = ("instrument", "benchmark_family", "signal_timeframe", "session", "direction", "lookback")


def two_sided(states: DataFrame, threshold: float) -> DataFrame:
    """Each valid state once per direction, with ``qualifying`` for the side it signals."""
    side = F.when(F.col("z") < -threshold, 1).when(F.col("z") > threshold, -1)
    valid = states.where(F.col("active") & F.col("z").isNotNull())
    return valid.select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("direction")).withColumn(
        "qualifying", F.coalesce(side == F.col("direction"), F.lit(False))
    )


def rearmed(states: DataFrame, threshold: float, width: int, keys=STATE_KEYS) -> DataFrame:
    """First qualifying state of each key, and again after a state strictly inside the band.

    Other states change nothing, so only two kinds of rows take part: Q (qualifying) and
    R (re-arming).  Q is an event unless the kind before it is Q.
    """
    inside = ~F.col("qualifying") & (F.abs(F.col("z")) < threshold)
    kinds = states.withColumn("_kind", F.when(F.col("qualifying"), "Q").when(inside, "R")).where(
        F.col("_kind").isNotNull()
    )
    seen = carry_last(kinds, keys, "at", F.col("at"), width, "_kind", "_before")
    events = seen.where((F.col("_kind") == "Q") & F.coalesce(F.col("_before") != "Q", F.lit(True)))
    return (
        events.drop("_kind", "_before")
        .withColumns(
            {"p0": F.col("close"), "d0": F.col("close") - F.col("e0"), "signal_threshold": F.lit(float(threshold))}
        )
        .withColumn("candidate_event_id", event_id(keys))
    )


def event_id(keys=STATE_KEYS) -> Column:
    return identity_hash("candidate-", *[F.col(k) for k in keys], F.col("at"))


def shock_episodes(rows: DataFrame, keys, order: str, width: int, z: str, enter: float, leave: float) -> DataFrame:
    """Hysteresis: active from |z| >= enter until |z| < leave; the entry sign is frozen."""
    size = F.abs(F.col(z))
    kind = F.when(size >= enter, "H").when(size < leave, "L")
    tagged = rows.withColumn("_kind", kind)
    seen = carry_last(tagged, keys, order, F.col(order), width, "_kind", "_before")
    event = (F.col("_kind") == "H") & F.coalesce(F.col("_before") == "L", F.lit(True))
    seen = seen.withColumns(
        {
            "shock_active": F.coalesce(F.coalesce("_kind", "_before") == "H", F.lit(False)),
            "event_emitted": F.coalesce(event, F.lit(False)),
        }
    ).withColumn("_entry_sign", F.when(F.col("event_emitted"), F.signum(F.col(z)).cast("int")))
    signed = carry_last(seen, keys, order, F.col(order), width, "_entry_sign", "_prior_sign")
    sign = F.when(F.col("shock_active"), F.coalesce("_entry_sign", "_prior_sign")).otherwise(0)
    return (
        signed.withColumn("shock_sign", sign)
        .withColumn("fade_direction", -F.col("shock_sign"))
        .drop("_kind", "_before", "_entry_sign", "_prior_sign")
    )
