"""The driver's tables as bars: events become ticks, ticks become hourly bars.

One instrument is an event type within a cohort of 150 users, so that more data means more
instruments at an even density rather than ever denser bars.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewindow.functions.scalars import decode_price

COHORT_USERS = 150
BASE = "1h"
BASE_S = 3600
# Quote precision (decimals) by event type.
PRECISION = {"click": 2, "view": 2, "error": 3, "purchase": 3, "signup": 3}
# Event types whose outcomes go through the currency conversion haircut.
CONVERTED = ("purchase", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_type(column: Column, values: dict) -> Column:
    """Five-way lookup as an expression: no join for a dimension of fixed size."""
    kind = F.substring_index(column, ".", 1)
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[kind]


def known(value: Column, name: Column) -> Column:
    """``value``, or the job fails with the name that has none."""
    stop = F.raise_error(F.concat(F.lit("unknown instrument: "), F.coalesce(name, F.lit("NULL"))))
    return F.coalesce(value, stop.cast("int"))


def pip(column="instrument"):
    return by_type(F.col(column), {k: 10.0 ** (1 - p) for k, p in PRECISION.items()})


def converted(column="instrument"):
    return F.substring_index(F.col(column), ".", 1).isin(*CONVERTED)


def ticks(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """instrument, ts, tick id, integer ticks, price, weight, bid/ask spread in price units.

    ``until`` (exclusive, UTC) is compared with the stored column, so the scan is pruned by it.
    """
    e = table(spark, sf_dir, "events")
    if until is not None:
        e = e.where(F.col("ts") < F.lit(until).cast(e.schema["ts"].dataType))
    scale = known(by_type(F.col("event_type"), {k: 10**p for k, p in PRECISION.items()}), F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("int")
    rows = e.select(
        F.concat("event_type", F.lit("."), F.floor(F.col("user_id") / COHORT_USERS)).alias("instrument"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("tick_id"),
        (F.round(F.col("value") * scale).cast("long") + 100 * scale).alias("ticks"),
        scale.alias("price_scale"),
        F.when(k >= 20, 1.0).otherwise(0.0).alias("weight"),
        ((k - 10) / 1000.0).alias("raw_spread"),
    )
    return rows.withColumn("price", decode_price(F.col("ticks"), F.col("price_scale")))


def bars(spark: SparkSession, sf_dir: str, step_s: int = BASE_S, label: str = BASE, until: str | None = None) -> DataFrame:
    """Tick bars.  First and last price merge map-side (min_by/max_by), so a hot hour is safe.

    With ``until``, a bar that closes later holds only its earlier ticks.
    """
    t = ticks(spark, sf_dir, until)
    window = F.floor(F.unix_seconds("ts") / step_s) * step_s
    first, last = F.struct("ts", "tick_id"), F.struct("ts", "tick_id")
    grouped = t.groupBy("instrument", window.alias("_w")).agg(
        F.min_by("price", first).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", last).alias("close"),
        F.sum("weight").alias("volume"),
    )
    close_time = F.timestamp_seconds(F.col("_w") + step_s)
    return grouped.select(
        "instrument",
        F.lit(label).alias("timeframe"),
        F.timestamp_seconds("_w").alias("open_time"),
        close_time.alias("close_time"),
        close_time.alias("available_at"),
        "open",
        "high",
        "low",
        "close",
        F.lit("bid").alias("price_basis"),
        "volume",
        F.lit("quote_activity").alias("volume_semantics"),
    )


# The members of one universe (a cohort of users), in panel order.
MEMBERS = tuple(sorted(PRECISION))


def universe(column="instrument") -> Column:
    return F.substring_index(column, ".", -1)


def member(column="instrument") -> Column:
    return F.substring_index(column, ".", 1)
