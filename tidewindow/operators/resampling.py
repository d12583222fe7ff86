"""Reproducible bootstrap tables: the draws are a pure function of their coordinates."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewindow.operators.chunks import same_keys, value_bin


def draw(n, *coordinates: Column, seed: int = 0) -> Column:
    """Uniform pick in [0, n): multiplicative hash of the coordinates (fixed odd constants)."""
    mix = F.lit(seed).cast("long")
    for k, c in zip((7919, 104729, 1299709), coordinates):
        mix = mix + c.cast("long") * k
    mixed = F.pmod(mix * F.lit(2654435761), F.lit(4294967296))
    # Fold the high half down: the low bits of a product repeat with a short period.
    folded = F.floor(mixed / 65536) + F.pmod(mixed, F.lit(65536)) * 65536
    return F.pmod(folded.cast("long"), n.cast("long") if isinstance(n, Column) else F.lit(n).cast("long"))


def block_picks(spark: SparkSession, paths: int, horizon: int, block: int, days: int, seed: int) -> DataFrame:
    """(path, day, source_day): blocks of consecutive source days, wrapping at the end."""
    grid = spark.range(paths).select(F.col("id").alias("path"))
    blocks = -(-horizon // block)
    rows = grid.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumn("start", draw(days, F.col("path"), F.col("block"), seed=seed))
    rows = rows.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    day = F.col("block") * block + F.col("offset")
    return rows.where(day < horizon).select(
        "path", day.cast("long").alias("day"), F.pmod(F.col("start") + F.col("offset"), F.lit(days)).alias("source_day")
    )


def rebased_trades(trades: DataFrame, picks: DataFrame) -> DataFrame:
    """Trades of each picked source day, with their clocks moved to the synthetic day."""
    shift = (F.col("day") - F.col("source_day")) * 86400
    return trades.join(picks, "source_day").withColumns(
        {"entry_s": F.col("entry_s") + shift, "exit_s": F.col("exit_s") + shift}
    )


def rebased_summary(trades: DataFrame, picks: DataFrame, keys, value: str) -> DataFrame:
    """Trades, total, first entry and last exit of the rebased trades, per (keys, path).

    Days are summarised once and then picked: a trade is never copied per path.
    """
    per_day = trades.groupBy(*keys, "source_day").agg(
        F.count("*").alias("n"), F.sum(value).alias("s"), F.min("entry_s").alias("lo"), F.max("exit_s").alias("hi")
    )
    shift = (F.col("day") - F.col("source_day")) * 86400
    rows = per_day.join(picks, "source_day")
    return rows.groupBy("path", *keys).agg(
        F.sum("n").alias("trades"), F.sum("s").alias("total_r"), F.min(F.col("lo") + shift).alias("first_s"), F.max(F.col("hi") + shift).alias("last_s")
    )


def daily_totals(trades: DataFrame, picks: DataFrame, keys, value: str) -> DataFrame:
    """Sum of ``value`` per (keys, path, synthetic day) without expanding trades per path.

    A day's total does not depend on the path, so days are summed once and then picked.
    """
    per_day = trades.groupBy(*keys, "source_day").agg(F.sum(value).alias("total"), F.count("*").alias("trades"))
    return per_day.join(picks, "source_day").select(*keys, "path", "day", "total", "trades")


def month_block_bootstrap(
    rows: DataFrame, keys, block: str, score: str, tie: str, values, replicates: int, share: float, seed: int
) -> DataFrame:
    """Top and bottom ``share`` means of each value, per replicate of whole blocks.

    Blocks are counted into order-preserving score bins; a replicate weights the bins and finds the
    two bins where its cuts fall, and only the rows of those bins are looked at, per replicate.
    """
    keys, spark = list(keys), rows.sparkSession
    blocks = rows.select(*keys, block).distinct()
    number = Window.partitionBy(*keys).orderBy(block)
    blocks = blocks.withColumns(
        {"_i": F.row_number().over(number) - 1, "_k": F.count("*").over(Window.partitionBy(*keys))}
    )
    slots = blocks.select(*keys, F.col("_i").alias("_slot"), "_k")
    reps = F.sequence(F.lit(0), F.lit(replicates - 1))
    picked = (
        slots.withColumn("replicate", F.explode(reps))
        .withColumn("_i", draw(F.col("_k"), F.col("replicate"), F.col("_slot"), seed=seed))
        .groupBy(*keys, "replicate", "_i")
        .agg(F.count("*").alias("_m"))
    )
    weights = picked.alias("l").join(blocks.alias("r"), same_keys([*keys, "_i"])).select(
        *[F.col(f"l.{k}") for k in keys], "l.replicate", F.col(f"r.{block}"), "l._m"
    )
    placed = rows.select(*keys, block, score, tie, *values, value_bin(F.col(score)).alias("_bin"))
    hist = placed.groupBy(*keys, block, "_bin").agg(
        F.count("*").alias("_n"), *[F.sum(v).alias(f"_s_{v}") for v in values]
    )
    mixed = (
        hist.alias("l")
        .join(weights.alias("r"), same_keys([*keys, block]))
        .groupBy(*[F.col(f"l.{k}").alias(k) for k in keys], F.col("r.replicate").alias("replicate"), F.col("l._bin").alias("_bin"))
        .agg(F.sum(F.col("_n") * F.col("_m")).alias("_n"), *[F.sum(F.col(f"_s_{v}") * F.col("_m")).alias(f"_s_{v}") for v in values])
    )
    group = Window.partitionBy(*keys, "replicate")
    upto = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = mixed.withColumns({"_to": F.sum("_n").over(upto), "_all": F.sum("_n").over(group)}).withColumns(
        {"_from": F.col("_to") - F.col("_n"), "_cut": F.ceil(F.col("_all") * F.lit(share)).cast("long")}
    )
    # Ranks 0.._cut-1 are the bottom, _all-_cut.._all-1 the top.
    n, lo, hi, cut, total = (F.col(x) for x in ("_n", "_from", "_to", "_cut", "_all"))
    whole_bottom, whole_top = hi <= cut, lo >= total - cut
    partial = ((lo < cut) & (hi > cut)) | ((lo < total - cut) & (hi > total - cut))
    sums = [
        *[F.sum(F.when(whole_bottom, F.col(f"_s_{v}"))).alias(f"_b_{v}") for v in values],
        *[F.sum(F.when(whole_top, F.col(f"_s_{v}"))).alias(f"_t_{v}") for v in values],
        F.max(cut).alias("_cut"),
    ]
    whole = bins.groupBy(*keys, "replicate").agg(*sums)
    edge = bins.where(partial).select(*keys, "replicate", "_bin", "_from", "_cut", "_all")
    inside = Window.partitionBy(*keys, "replicate", "_bin").orderBy(score, tie).rowsBetween(Window.unboundedPreceding, 0)
    # Only rows of a bin that some replicate cuts meet that replicate, and only then its weights.
    edge_rows = (
        placed.alias("l")
        .join(edge.alias("r"), same_keys([*keys, "_bin"]))
        .select("l.*", "r.replicate", "r._from", "r._cut", "r._all")
        .alias("l")
        .join(weights.alias("r"), same_keys([*keys, "replicate", block]))
        .select("l.*", "r._m")
    )
    edge_rows = edge_rows.withColumn("_hi", F.col("_from") + F.sum("_m").over(inside)).withColumn("_lo", F.col("_hi") - F.col("_m"))
    bottom = F.greatest(F.lit(0), F.least("_hi", "_cut") - F.col("_lo"))
    top = F.greatest(F.lit(0), F.col("_hi") - F.greatest(F.col("_lo"), F.col("_all") - F.col("_cut")))
    # A bin that is whole for one cut may be partial for the other: count only the partial side here.
    parts = edge_rows.alias("e").join(
        bins.select(*keys, "replicate", "_bin", whole_bottom.alias("_wb"), whole_top.alias("_wt")).alias("b"),
        [F.col(f"e.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "replicate", "_bin"]],
    ).select("e.*", "b._wb", "b._wt")
    parts = parts.groupBy(*keys, "replicate").agg(
        *[F.sum(F.when(~F.col("_wb"), F.col(v) * bottom)).alias(f"_pb_{v}") for v in values],
        *[F.sum(F.when(~F.col("_wt"), F.col(v) * top)).alias(f"_pt_{v}") for v in values],
    )
    joined = whole.alias("l").join(parts.alias("r"), same_keys([*keys, "replicate"]), "left")
    mean = lambda a, b: (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))) / F.col("l._cut")
    return joined.select(
        *[F.col(f"l.{k}").alias(k) for k in keys],
        F.col("l.replicate").alias("replicate"),
        *[mean(F.col(f"l._t_{v}"), F.col(f"r._pt_{v}")).alias(f"top_{v}") for v in values],
        *[mean(F.col(f"l._b_{v}"), F.col(f"r._pb_{v}")).alias(f"bottom_{v}") for v in values],
    )
