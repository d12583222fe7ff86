"""Interval, as-of and exact-clock joins planned as equi joins."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewindow.operators.chunks import carry_last, same_keys


def range_join(points: DataFrame, spans: DataFrame, keys, at: str, lo: str, hi: str, bucket: int, how: str = "inner"):
    """Points with ``lo < at < hi`` of a span, by time bucket (all columns are seconds).

    A span is copied to each bucket it touches, so choose ``bucket`` near the span length.
    """
    b = "_bucket"
    placed = points.withColumn(b, F.floor(F.col(at) / bucket).cast("long"))
    copies = spans.withColumn(
        b,
        F.explode(
            F.sequence(F.floor(F.col(lo) / bucket).cast("long"), F.floor(F.col(hi) / bucket).cast("long"))
        ),
    )
    extra = [c for c in spans.columns if c not in keys]
    cond = same_keys([*keys, b]) & (F.col(f"l.{at}") > F.col(f"r.{lo}")) & (F.col(f"l.{at}") < F.col(f"r.{hi}"))
    joined = placed.alias("l").join(copies.alias("r"), cond, how)
    return joined.select("l.*", *[F.col(f"r.{c}") for c in extra]).drop(b)


def asof_backward(probe: DataFrame, source: DataFrame, keys, at: str, value: str, out: str, width: int) -> DataFrame:
    """``value`` of the latest source row at or before each probe row (source wins ties)."""
    cols = probe.columns
    row_type = probe.select(F.struct(*cols)).schema[0].dataType
    left = probe.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*cols).alias("_row"))
    left = left.withColumn("_v", F.lit(None).cast(source.schema[value].dataType))
    right = source.select(
        *keys,
        F.col(at).alias("_at"),
        F.lit(0).alias("_side"),
        F.lit(None).cast(row_type).alias("_row"),
        F.col(value).alias("_v"),
    )
    both = left.unionByName(right)
    seen = carry_last(both, keys, ["_at", "_side"], F.col("_at"), width, "_v", out)
    return seen.where(F.col("_side") == 1).select("_row.*", out)


def nearest_clock(events: DataFrame, clocks: DataFrame, keys, at: str, reach: int, out: str) -> DataFrame:
    """Smallest |event - clock| in seconds within ``reach``, else NULL (no pair survives).

    Both sides are reduced first: distinct clocks, distinct event instants.  An instant looks
    at three buckets of ``reach`` seconds, and the minimum is taken map-side.
    """
    b, k = "_bucket", list(keys)
    places = F.floor(F.col(at) / reach).cast("long")
    marks = clocks.select(*k, F.col(at).alias("_clock")).distinct()
    marks = marks.withColumn(b, F.floor(F.col("_clock") / reach).cast("long"))
    # Per bucket only its first and last clock, and those around the instant, can be nearest;
    # keep the sorted distinct clocks of a bucket as one array (at most ``reach`` instants).
    packed = marks.groupBy(*k, b).agg(F.collect_set("_clock").alias("_clocks"))
    instants = events.select(*k, at).distinct().withColumn("_p", places)
    probes = instants.withColumn(b, F.explode(F.array(F.col("_p") - 1, F.col("_p"), F.col("_p") + 1)))
    gaps = (
        probes.alias("l")
        .join(packed.alias("r"), same_keys([*k, b]))
        .select(
            *[F.col(f"l.{c}") for c in (*k, at)],
            F.array_min(F.transform("r._clocks", lambda x: F.abs(x - F.col(f"l.{at}")))).alias("_gap"),
        )
        .where(F.col("_gap") <= reach)
        .groupBy(*k, at)
        .agg(F.min("_gap").alias(out))
    )
    return events.alias("l").join(gaps.alias("r"), same_keys([*k, at]), "left").select("l.*", f"r.{out}")


def lookup_cost(rows: DataFrame, costs: DataFrame, session: Column, allowed: Column) -> DataFrame:
    """Left join of a cost dimension where ``allowed``; the session's size threshold picks the join."""
    cond = F.col("l._allowed") & (F.col("l.instrument") == F.col("r.instrument")) & (F.col("l._session") == F.col("r.session"))
    extra = [c for c in costs.columns if c not in ("instrument", "session")]
    return (
        rows.withColumns({"_session": F.coalesce(session, F.lit("overall")), "_allowed": allowed})
        .alias("l")
        .join(costs.alias("r"), cond, "left")
        .select("l.*", *[F.col(f"r.{c}") for c in extra])
        .drop("_session", "_allowed")
    )


def guarded_join(facts: DataFrame, partners: DataFrame, keys, facts_unique: bool = False) -> DataFrame:
    """``facts`` with the columns of their one partner; a fact without a partner, or a key with
    two, is an error that names the key.

    One shuffle: both sides travel as one tagged table, a window counts partners and facts per key,
    and the row that breaks the rule raises where it lies.  Facts of a key may be many; partners
    are one row a key.
    """
    keys = list(keys)
    extra = [c for c in partners.columns if c not in keys]
    fact = facts.select(*keys, F.struct(*facts.columns).alias("_fact"))
    partner = partners.select(*keys, F.struct(*extra).alias("_partner"))
    both = fact.unionByName(partner, allowMissingColumns=True)
    group = Window.partitionBy(*keys)
    text = F.to_json(F.struct(*keys))
    stop = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), text))
    found = F.count("_partner").over(group)
    bad = F.when(found > 1, stop("more than one partner")).when(
        F.col("_fact").isNotNull() & (found == 0), stop("no partner")
    )
    if facts_unique:
        bad = bad.when(F.count("_fact").over(group) > 1, stop("a fact twice"))
    rows = both.withColumn("_only", F.max("_partner").over(group)).withColumn("_bad", bad.cast("string"))
    # The check is part of the filter, so that no plan leaves it out.
    rows = rows.where(F.col("_fact").isNotNull() & F.col("_bad").isNull())
    return rows.select("_fact.*", *[F.col(f"_only.{c}").alias(c) for c in extra])
