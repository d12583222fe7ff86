"""Registered queries: what a corpus is, what changed in it, and whether its parts hold what they declare."""

from pyspark.sql import functions as F

from tidewindow.operators import identity as ID, registry as RG
from tidewindow.plans.study import tidy
from tidewindow.sources import driver as D, parts as PT
from tidewindow.sources.staging import stage

CONTENT = ("tick_id", "micros", "ticks")
CUTOFF = "2024-01-15 12:00:00"


def _content(spark, sf, until=None):
    t = D.ticks(spark, sf, until)
    return t.select("instrument", "ts", "tick_id", F.unix_micros("ts").alias("micros"), "ticks")


def _days(rows):
    return ID.day_nodes(rows, "instrument", F.col("ts"), CONTENT)


def corpus_identity(spark, sf):
    """Every node of the ticks' hash tree, from the days up to the corpus."""
    return tidy(ID.tree(stage(_days(_content(spark, sf)))))


def corpus_recheck(spark, sf):
    """The corpus of a noon in mid-January against today's: what became of each day, and whether reading
    only the days that differ leads to the identity of the whole."""
    before = stage(ID.tree(stage(_days(_content(spark, sf, CUTOFF)))))
    whole = stage(ID.tree(stage(_days(_content(spark, sf)))))
    days = stage(ID.days_changed(before, whole))
    again = _content(spark, sf).withColumn("period", F.date_format("ts", "yyyy-MM-dd"))
    again = again.join(days.select(F.col("series").alias("instrument"), "period"), ["instrument", "period"], "left_semi")
    after = ID.refreshed(before, days, _days(again)).where("level in ('series', 'corpus')")
    counts = days.groupBy("series").agg(
        *[F.count_if(F.col("verdict") == v).alias(f"{v}_days") for v in ("added", "missing", "changed")]
    )
    total = days.agg(*[F.count_if(F.col("verdict") == v).alias(f"{v}_days") for v in ("added", "missing", "changed")])
    counts = counts.unionByName(total.withColumn("series", F.lit(None).cast("string")))
    want = whole.where("level in ('series', 'corpus')").select("series", F.col("sha256").alias("_whole"))
    rows = after.alias("a").join(want.alias("w"), F.expr("a.series <=> w.series"), "left")
    rows = rows.join(counts.alias("c"), F.expr("a.series <=> c.series"), "left")
    zero = lambda v: F.coalesce(f"c.{v}_days", F.lit(0)).alias(f"{v}_days")
    return tidy(
        rows.select(
            "a.level", "a.series", zero("added"), zero("missing"), zero("changed"), "a.sha256",
            F.coalesce(F.col("a.sha256") == F.col("w._whole"), F.lit(False)).alias("verified"),
        )
    )


def declared_parts(spark, sf):
    """Which parts hold rows of another series.  Ticks with a spread below zero are filed under the
    first series of their type; a part is declared by its folder, the series stands in the rows."""
    t = D.ticks(spark, sf)
    filed = F.when(F.col("raw_spread") < 0, F.concat(D.member(), F.lit(".0"))).otherwise(F.col("instrument"))
    files = stage(t.select("instrument", "tick_id", filed.alias("part")), "part")
    rows = PT.declared(files, r"/part=([^/]+)/[^/]*$")
    return tidy(PT.part_report(rows, "instrument"))


# Where the two shapes of a manifest keep a field.
FIELDS = {
    "scale": ("long", ("$.price.scale", "$.price_scale")),
    "first_day": ("date", ("$.range.first", "$.requested_start_date")),
    "last_day": ("date", ("$.range.last", "$.requested_end_date")),
    "rows": ("long", ("$.rows",)),
}


def manifests(spark, sf):
    """Two manifests a series, as JSON: the old shape knows the ticks with a spread of zero or more, the
    new one all of them.  Old manifests of errors are torn."""
    t = D.ticks(spark, sf).select("instrument", F.date_format("ts", "yyyy-MM-dd").alias("day"), "price_scale", "raw_spread")
    quoted = F.when(F.col("raw_spread") >= 0, F.col("day"))
    s = t.groupBy("instrument").agg(
        F.max("price_scale").alias("scale"), F.count("*").alias("n"), F.min("day").alias("a"), F.max("day").alias("b"),
        F.min(quoted).alias("qa"), F.max(quoted).alias("qb"),
    )
    old = F.to_json(F.struct(
        F.struct("scale").alias("price"), F.struct(F.col("qa").alias("first"), F.col("qb").alias("last")).alias("range"),
    ))
    new = F.to_json(F.struct(
        F.col("scale").cast("string").alias("price_scale"), F.col("a").alias("requested_start_date"),
        F.col("b").alias("requested_end_date"), F.col("n").alias("rows"),
    ))
    torn = F.when(D.member() == "error", F.substring(old, 1, 20)).otherwise(old)
    return s.select("instrument", F.explode(F.array(torn, new)).alias("manifest"))


def corpus_registry(spark, sf):
    """One entry per series from manifests of two shapes, against the declared universe: every event type
    of every cohort, signups declared with two decimals."""
    entries = RG.registry(manifests(spark, sf), "instrument", "manifest", FIELDS)
    cohorts = D.table(spark, sf, "events").select(F.floor(F.col("user_id") / D.COHORT_USERS).alias("cohort")).distinct()
    declared = {k: 100 if k == "signup" else 10**p for k, p in D.PRECISION.items()}
    members = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).cast("long").alias("scale")) for k, s in declared.items()])
    universe = cohorts.select("cohort", F.inline(members)).select(F.concat_ws(".", "k", "cohort").alias("instrument"), "scale")
    out = RG.validated(entries, universe, "instrument", ["rows"])
    days = {c: F.date_format(c, "yyyy-MM-dd") for c in ("first_day", "last_day")}
    return tidy(out.withColumns(days))


QUERIES = {f.__name__: f for f in (corpus_identity, corpus_recheck, declared_parts, corpus_registry)}
