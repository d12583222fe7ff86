"""Identity of a corpus as a tree of hashes: days, months, years, series, corpus.

A day's hash covers the rows of one series on one day.  Row digests are added in four lanes of 60
bits, which merges map-side, needs no order and holds no day in one place; a repeated row counts
twice.  (Sums guard against loss, damage and mix-ups, not against an adversary.)  Months and years
hash their children in calendar order; at most 31 and 12 of them.  The corpus, whose number of
series has no bound, adds the digests of its series in the same lanes.

The identity depends on neither file order nor partitions, and a corpus of which some days changed is
verified again from these days' rows alone: ``days_changed`` names them, ``refreshed`` rebuilds their
branches and takes every other day from the earlier tree.

Defined cases: rows without a series or a time belong to the day NULL (period ``?``) of their series;
an empty corpus has no nodes but a root over nothing.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tidewindow.operators.chunks import same_keys

LANES, DIGITS = 4, 15  # 15 hex digits fit a long
NODE = ("level", "series", "period", "children", "sha256")
LEVELS = ("day", "month", "year")
NONE = "?"


def _text(columns) -> Column:
    """One text per row; a NULL is no text, and lengths keep neighbours apart."""
    parts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])


def _lanes(digest: Column) -> list[Column]:
    lane = lambda i: F.conv(F.substring(digest, i * DIGITS + 1, DIGITS), 16, 10).cast("decimal(38,0)")
    return [F.sum(lane(i)).alias(f"_lane{i}") for i in range(LANES)]


def _total(count: str) -> Column:
    return F.sha2(F.concat_ws("|", F.col(count), *[F.coalesce(F.col(f"_lane{i}"), F.lit(0)) for i in range(LANES)]), 256)


def day_nodes(rows: DataFrame, series: str, day: Column, content) -> DataFrame:
    """Leaves: one node per (series, day) over the ``content`` columns; children counts rows."""
    kept = rows.select(
        F.coalesce(F.col(series).cast("string"), F.lit(NONE)).alias("series"),
        F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(NONE)).alias("period"),
        F.sha2(_text(content), 256).alias("_digest"),
    )
    sums = kept.groupBy("series", "period").agg(F.count("*").alias("children"), *_lanes(F.col("_digest")))
    return sums.select(F.lit("day").alias("level"), "series", "period", "children", _total("children").alias("sha256"))


def _parents(nodes: DataFrame, level: str, width: int) -> DataFrame:
    """Nodes over calendar periods of ``width`` characters: an ordered hash of a bounded list."""
    period = F.when(F.col("period") == NONE, F.col("period")).otherwise(F.substring("period", 1, width))
    grouped = nodes.groupBy("series", period.alias("_up")).agg(
        F.array_sort(F.collect_list(F.concat_ws("=", "period", "sha256"))).alias("_below")
    )
    return grouped.select(
        F.lit(level).alias("level"), "series", F.col("_up").alias("period"), F.size("_below").cast("long").alias("children"),
        F.sha2(F.array_join("_below", "|"), 256).alias("sha256"),
    )


def tree(days: DataFrame) -> DataFrame:
    """All nodes above and including the given days."""
    months = _parents(days, "month", 7)
    years = _parents(months, "year", 4)
    series = years.groupBy("series").agg(
        F.count("*").alias("children"), F.array_sort(F.collect_list(F.concat_ws("=", "period", "sha256"))).alias("_below")
    ).select(
        F.lit("series").alias("level"), "series", F.lit(None).cast("string").alias("period"), "children",
        F.sha2(F.array_join("_below", "|"), 256).alias("sha256"),
    )
    # A series' digest is taken together with its name.
    named = series.select(F.sha2(F.concat_ws("=", "series", "sha256"), 256).alias("_digest"))
    root = named.agg(F.count("*").alias("children"), *_lanes(F.col("_digest"))).select(
        F.lit("corpus").alias("level"), F.lit(None).cast("string").alias("series"), F.lit(None).cast("string").alias("period"),
        "children", _total("children").alias("sha256"),
    )
    out = days
    for part in (months, years, series, root):
        out = out.unionByName(part)
    return out.select(*NODE)


def days_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Days of two trees (or day nodes) that differ: added, missing or changed.

    The trees are descended level by level: only below a year that differs are months compared, and
    only below a month that differs, days.
    """
    scope = None
    for level, width in (("year", 4), ("month", 7), ("day", 10)):
        l, r = (t.where(F.col("level") == level).select("series", "period", "sha256") for t in (before, after))
        if scope is not None:
            up = F.when(F.col("period") == NONE, F.col("period")).otherwise(F.substring("period", 1, width - 3))
            l, r = (
                t.withColumn("_up", up).join(scope, ["series", "_up"], "left_semi").drop("_up") for t in (l, r)
            )
        both = l.alias("l").join(r.alias("r"), same_keys(["series", "period"]), "full_outer")
        verdict = (
            F.when(F.col("l.sha256").isNull(), "added").when(F.col("r.sha256").isNull(), "missing")
            .when(F.col("l.sha256") != F.col("r.sha256"), "changed")
        )
        found = both.select(
            F.coalesce("l.series", "r.series").alias("series"), F.coalesce("l.period", "r.period").alias("period"),
            verdict.alias("verdict"),
        ).where("verdict is not null")
        scope = found.select("series", F.col("period").alias("_up"))
    return found


def refreshed(before: DataFrame, days: DataFrame, fresh: DataFrame) -> DataFrame:
    """The tree after ``days`` (series, period) were read again as the day nodes ``fresh``.

    Days that were read again and are not in ``fresh`` have gone; all others stay as they were.
    """
    kept = before.where("level = 'day'").join(days.select("series", "period"), ["series", "period"], "left_anti")
    return tree(kept.select(*NODE).unionByName(fresh.select(*NODE)))
