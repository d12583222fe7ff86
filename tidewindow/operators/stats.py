"""Grouped statistics with exact quantiles that do not gather a group in one task."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewindow.operators.chunks import same_keys, value_bin

LINEAR, NEAREST = "linear", "nearest"


def quantiles(df: DataFrame, keys, value: str, wanted: dict[str, float], rule: str = LINEAR) -> DataFrame:
    """Exact quantiles of ``value`` per key: ``keys`` + one column per name in ``wanted``.

    ``linear`` interpolates between order statistics (inclusive rule); ``nearest`` returns
    the observed value of rank ``ceil(p * n)``.  Equal values are counted before the shuffle,
    groups are split into order-preserving bins, and only the bins that hold a wanted rank
    are ordered.  NULL and NaN values are ignored; groups without values yield no row.
    """
    keys = list(keys)
    kept = df.select(*keys, F.col(value).cast("double").alias("_x"))
    kept = kept.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    counted = kept.groupBy(*keys, "_x").agg(F.count("*").alias("_c")).withColumn("_bin", value_bin(F.col("_x")))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    bins = (
        counted.groupBy(*keys, "_bin")
        .agg(F.sum("_c").alias("_rows"))
        .withColumns({"_to": F.sum("_rows").over(upto), "_n": F.sum("_rows").over(whole)})
        .withColumn("_from", F.col("_to") - F.col("_rows"))
    )
    n = F.col("_n")
    ranks = []
    for name, p in wanted.items():
        if rule == LINEAR:
            at = (n - 1) * F.lit(float(p))
            lo = F.floor(at).cast("long")
            ranks.append(F.struct(F.lit(name).alias("name"), lo.alias("rank"), (F.lit(1.0) - (at - lo)).alias("w")))
            ranks.append(
                F.struct(
                    F.lit(name).alias("name"),
                    F.least(lo + 1, n - 1).alias("rank"),
                    (at - lo).alias("w"),
                )
            )
        else:
            hit = F.greatest(F.lit(0), F.ceil(F.lit(float(p)) * n) - 1).cast("long")
            ranks.append(F.struct(F.lit(name).alias("name"), hit.alias("rank"), F.lit(1.0).alias("w")))
    hits = F.filter(F.array(*ranks), lambda r: (r.rank >= F.col("_from")) & (r.rank < F.col("_to")))
    useful = bins.withColumn("_hits", hits).where(F.size("_hits") > 0)
    inside = Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    values = (
        counted.alias("l")
        .join(useful.alias("r"), same_keys([*keys, "_bin"]))
        .select("l.*", "r._from", "r._hits")
        .withColumn("_hi", F.col("_from") + F.sum("_c").over(inside))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
        .select(
            *keys,
            "_x",
            F.explode(F.filter("_hits", lambda r: (r.rank >= F.col("_lo")) & (r.rank < F.col("_hi")))).alias("_h"),
        )
    )
    return values.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("_h.name") == name, F.col("_x") * F.col("_h.w"))).alias(name)
            for name in wanted
        ]
    )


def quantile_columns(df: DataFrame, keys, values, wanted: dict[str, float], rule: str = LINEAR) -> DataFrame:
    """Quantiles of several columns in one pass: columns ``<value>_<name>``."""
    keys = list(keys)
    pairs = [F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("x")) for v in values]
    long = df.select(*keys, F.explode(F.array(*pairs)).alias("_m")).select(*keys, "_m.metric", "_m.x")
    found = quantiles(long, [*keys, "metric"], "x", wanted, rule)
    picks = [
        F.max(F.when(F.col("metric") == v, F.col(name))).alias(f"{v}_{name}") for v in values for name in wanted
    ]
    return found.groupBy(*keys).agg(*picks)


def with_ranks(df: DataFrame, keys, value: str) -> DataFrame:
    """Adds the 1-based place of ``value`` within ``keys`` and how many values there are, for groups that
    lie in one task anyway; NULL and NaN have no place."""
    known = F.col(value).isNotNull() & ~F.isnan(value)
    rows = df.withColumn("_known", known)
    group = Window.partitionBy(*keys, "_known")
    return rows.withColumns({"_rank": F.row_number().over(group.orderBy(value)), "_n": F.count("*").over(group)})


def at_rank(p: float) -> Column:
    """Whether a row of :func:`with_ranks` is its group's ``nearest`` quantile."""
    return F.col("_known") & (F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("_n"))) == F.col("_rank"))


def attach(left: DataFrame, right: DataFrame, keys, how: str = "left", plain=()) -> DataFrame:
    """Null-safe join on ``keys`` that keeps one copy of them; ``plain`` keys are never NULL, and rows that
    lie by these are joined where they are."""
    extra = [c for c in right.columns if c not in keys]
    return (
        left.alias("l").join(right.alias("r"), same_keys(keys, plain=plain), how).select("l.*", *[F.col(f"r.{c}") for c in extra])
    )


def moments(x: Column, prefix: str = "") -> list[Column]:
    """count, mean, win rate, sample stddev, standard error and t-statistic of ``x``."""
    n, sd = F.count(x), F.when(F.count(x) >= 2, F.stddev_samp(x))
    error = sd / F.sqrt(n)
    return [
        n.alias(prefix + "valid_outcome_count"),
        F.avg(x).alias(prefix + "mean"),
        F.avg((x > 0).cast("double")).alias(prefix + "win_rate"),
        sd.alias(prefix + "stddev"),
        error.alias(prefix + "standard_error"),
        F.try_divide(F.avg(x), error).alias(prefix + "t_stat"),
    ]


def fraction(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def profit_factor(x: Column, zero_loss: str = "null") -> Column:
    """Gains over losses.  Without losses: NULL, or with ``inf`` infinity (0 when no gain)."""
    gains = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0))
    losses = F.coalesce(-F.sum(F.when(x < 0, x)), F.lit(0.0))
    ratio = F.try_divide(gains, losses)
    if zero_loss == "null":
        return ratio
    return F.when(losses > 0, ratio).when(gains > 0, F.lit(float("inf"))).otherwise(0.0)


def exact_sum(x: Column, scale: int = 12) -> Column:
    """Order-independent total: decimals add exactly, so every run gives the same bits."""
    return F.sum(x.cast(f"decimal(26,{scale})")).cast("double")


def key_counts(df: DataFrame, scope, key: str, out: str) -> DataFrame:
    """Map of row counts by ``key`` within each scope, from two levels of grouping."""
    inner = df.groupBy(*scope, key).agg(F.count("*").alias("_n"))
    return inner.groupBy(*scope).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("_n"))))).alias(out),
        F.max("_n").alias("_top_" + out),
    )


def key_means(df: DataFrame, scope, key: str, value: str, out: str) -> DataFrame:
    inner = df.where(F.col(value).isNotNull()).groupBy(*scope, key).agg(F.avg(value).alias("_m"))
    return inner.groupBy(*scope).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("_m"))))).alias(out)
    )


def dense(grid: DataFrame, rows: DataFrame, keys, zero=()) -> DataFrame:
    """Left join onto a full grid so that empty cells appear, counts as zero."""
    out = attach(grid, rows, keys)
    return out.fillna(0, subset=list(zero)) if zero else out
