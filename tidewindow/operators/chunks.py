"""Ordered work on long series without one task per series.

A series key (an instrument, a process) may hold a third of all rows, so no operator here
partitions a window by the series key alone.  Bounded look-back goes through :func:`halo`
(fixed-width chunks plus a margin of repeated rows); unbounded state goes through
:func:`carry_last` and :func:`running_sum` (one small summary row per chunk, then a carry).
"""

from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK, CORE = "_chunk", "_core"


def halo(df: DataFrame, axis: Column, width: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Copy each row into every chunk of ``axis`` that can see it.

    ``axis`` is an integer position (epoch seconds, or a rank).  A chunk covers ``width``
    units; it also receives rows up to ``back`` units before and ``ahead`` units after.
    ``_core`` marks the one copy that owns the row.
    """
    home = F.floor(axis / width).cast("long")
    first = F.floor((axis - ahead) / width).cast("long")
    last = F.floor((axis + back) / width).cast("long")
    return df.select(
        "*", home.alias("_home"), F.explode(F.sequence(first, last)).alias(CHUNK)
    ).select(*df.columns, CHUNK, (F.col("_home") == F.col(CHUNK)).alias(CORE))


def core_only(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORE)).drop(CHUNK, CORE)


def same_keys(keys, left: str = "l", right: str = "r", plain=()) -> Column:
    """Null-safe equality, so that a NULL session is a group like any other; ``plain`` keys are never NULL."""
    same = lambda k, a, b: a == b if k in plain else a.eqNullSafe(b)
    return reduce(lambda a, b: a & b, [same(k, F.col(f"{left}.{k}"), F.col(f"{right}.{k}")) for k in keys])


def _attach(df: DataFrame, chunks: DataFrame, keys, columns) -> DataFrame:
    joined = df.alias("l").join(chunks.alias("r"), same_keys([*keys, CHUNK]), "left")
    return joined.select("l.*", *[F.col(f"r.{c}") for c in columns])


def carry_last(df: DataFrame, keys, order, axis: Column, width: int, value: str, out: str) -> DataFrame:
    """``out`` = last non-NULL ``value`` strictly before the row, over the whole series.

    ``order`` are columns that totally order rows of one key and agree with ``axis``.
    """
    order = [order] if isinstance(order, str) else list(order)
    placed = df.withColumn(CHUNK, F.floor(axis / width).cast("long"))
    before = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.last(value, ignorenulls=True).over(before))
    summary = placed.where(F.col(value).isNotNull()).groupBy(*keys, CHUNK).agg(
        F.max_by(value, F.struct(*order)).alias("_last")
    )
    # Chunks without a value need no row: the carry is looked up by the latest earlier chunk.
    every = placed.select(*keys, CHUNK).distinct()
    across = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        every.alias("l")
        .join(summary.alias("r"), same_keys([*keys, CHUNK]), "left")
        .select("l.*", "r._last")
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(across))
    )
    return (
        _attach(local, carried, keys, ["_carry"])
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_local", "_carry", CHUNK)
    )


def carry_max(df: DataFrame, keys, order, axis: Column, width: int, value: str, out: str) -> DataFrame:
    """``out`` = largest ``value`` strictly before the row, over the whole series."""
    order = [order] if isinstance(order, str) else list(order)
    placed = df.withColumn(CHUNK, F.floor(axis / width).cast("long"))
    before = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    chunks = placed.groupBy(*keys, CHUNK).agg(F.max(value).alias("_most")).withColumn("_carry", F.max("_most").over(across))
    local = placed.withColumn("_local", F.max(value).over(before))
    return _attach(local, chunks, keys, ["_carry"]).withColumn(out, F.greatest("_local", "_carry")).drop("_local", "_carry", CHUNK)


def running_sum(df: DataFrame, keys, order, axis: Column, width: int, value: Column, out: str) -> DataFrame:
    """Inclusive prefix sum of ``value`` over the whole series, chunk by chunk."""
    order = [order] if isinstance(order, str) else list(order)
    placed = df.withColumn("_v", value).withColumn(CHUNK, F.floor(axis / width).cast("long"))
    upto = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_local", F.sum("_v").over(upto))
    across = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, CHUNK)
        .agg(F.sum("_v").alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(across), F.lit(0)))
    )
    return (
        _attach(local, offsets, keys, ["_offset"])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_v", "_local", "_offset", CHUNK)
    )


def value_bin(x: Column, per_log_unit: int = 256) -> Column:
    """Order-preserving bin of a double: equal-ratio bins, so no range has to be known.

    ``ln`` never decreases, hence ``x <= y`` implies ``bin(x) <= bin(y)``; equal values share
    a bin.  A bin spans a ratio of 1/256, which keeps any bin of a spread-out group small.
    """
    magnitude = F.floor(F.ln(F.abs(x)) * per_log_unit) + F.lit(800 * per_log_unit)
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * magnitude).cast("long")


def tie_part(df: DataFrame, tie: str | None) -> Column:
    """An order-preserving part of a text tie key: two characters after what all keys share."""
    if tie is None or dict(df.dtypes)[tie] != "string":
        return F.lit("")
    r = df.agg(F.min(tie).alias("a"), F.max(tie).alias("b")).first()
    shared = len(commonprefix([r["a"] or "", r["b"] or ""]))
    return F.coalesce(F.substring(F.col(tie), shared + 1, 2), F.lit(""))


def ranked(df: DataFrame, keys, value: str, tie: str | None, out: str = "rank") -> DataFrame:
    """Global 1-based row number by (value, tie) within ``keys``, plus the group size ``n``.

    Rows are ordered inside (value, part of the tie key) only, so neither a spread-out group nor a
    value that most rows share is one task; counts alone cross a :func:`value_bin`, and bins a group.
    """
    keys = list(keys)
    placed = df.withColumns({"_bin": value_bin(F.col(value)), "_part": tie_part(df, tie)})
    within = Window.partitionBy(*keys, "_bin").orderBy(value, "_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(*keys, "_bin", value, "_part").agg(F.count("*").alias("_rows"))
    cells = cells.withColumn("_inside", F.coalesce(F.sum("_rows").over(within), F.lit(0)))
    across = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        placed.groupBy(*keys, "_bin")
        .agg(F.count("*").alias("_rows"))
        .select(
            *keys,
            "_bin",
            F.coalesce(F.sum("_rows").over(across), F.lit(0)).alias("_before"),
            F.sum("_rows").over(Window.partitionBy(*keys)).alias("n"),
        )
    )
    group = [*keys, "_bin"]
    cells = cells.alias("l").join(bins.alias("r"), same_keys(group)).select("l.*", "r._before", "r.n")
    order = Window.partitionBy(*keys, value, "_part").orderBy(*([tie] if tie else [value]))
    return (
        placed.withColumn("_local", F.row_number().over(order))
        .alias("l")
        .join(cells.alias("r"), same_keys([*keys, "_bin", value, "_part"]))
        .select("l.*", "r._inside", "r._before", "r.n")
        .withColumn(out, (F.col("_local") + F.col("_inside") + F.col("_before")).cast("long"))
        .drop("_bin", "_part", "_local", "_inside", "_before")
    )


def longest_run(df: DataFrame, keys, order, axis: Column, width: int, flag: Column, out: str, plain=()) -> DataFrame:
    """Longest unbroken run of ``flag`` per key, in ``order``; runs may span chunks.

    Each chunk reports its size, its leading and trailing run and its inner maximum;
    runs that reach across chunks are rebuilt from those summaries alone.
    """
    order = [order] if isinstance(order, str) else list(order)
    rows = df.select(*keys, *order, flag.cast("int").alias("_f"), F.floor(axis / width).cast("long").alias(CHUNK))
    seq = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    # Rows after the k-th break form run k; run 0 is the leading run.
    tagged = rows.withColumn("_run", F.sum(1 - F.col("_f")).over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    runs = tagged.groupBy(*keys, CHUNK, "_run").agg(F.sum("_f").alias("_len"), F.count("*").alias("_rows"))
    chunks = runs.groupBy(*keys, CHUNK).agg(
        F.max("_len").alias("_inner"),
        F.max(F.when(F.col("_run") == 0, F.col("_len"))).alias("_lead"),
        F.max_by("_len", "_run").alias("_trail"),
        (F.sum("_len") == F.sum("_rows")).alias("_all"),
    )
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    # A chunk that is one whole run extends the run before it; any other chunk closes it.
    grouped = chunks.withColumn(
        "_g",
        F.coalesce(
            F.sum(F.when(F.col("_all"), 0).otherwise(1)).over(across.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    )
    prior = Window.partitionBy(*keys, "_g").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    opened = grouped.withColumn("_full_before", F.coalesce(F.sum("_trail").over(prior), F.lit(0)))
    tail = opened.where(~F.col("_all")).select(*keys, (F.col("_g") + 1).alias("_g"), F.col("_trail").alias("_carry"))
    linked = opened.alias("l").join(tail.alias("r"), same_keys([*keys, "_g"], plain=plain), "left").select("l.*", "r._carry")
    reach = F.coalesce("_carry", F.lit(0)) + F.col("_full_before") + F.coalesce("_lead", F.lit(0))
    return linked.groupBy(*keys).agg(F.max(F.greatest("_inner", reach)).cast("long").alias(out))
