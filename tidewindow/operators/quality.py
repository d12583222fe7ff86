"""Data-quality and reconciliation operators.  All are joins and mergeable aggregates."""

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewindow.functions.scalars import seconds
from tidewindow.operators.chunks import carry_last, carry_max, same_keys
from tidewindow.schema import PRICE_BASES, VOLUME_SEMANTICS


def check_rows(bars: DataFrame) -> DataFrame:
    """Adds ``violations``: the names of the bar rules a row breaks (empty when valid)."""
    c = F.col
    prices = [c(x) for x in ("open", "high", "low", "close")]
    finite = reduce(lambda a, b: a & b, [p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf")) for p in prices])
    none = c("volume_semantics") == "none"
    rules = {
        "interval_not_positive": ~(c("open_time") < c("close_time")),
        "available_before_close": c("available_at") < c("close_time"),
        "price_not_finite": ~finite,
        "high_below_body": c("high") < F.greatest("open", "close", "low"),
        "low_above_body": c("low") > F.least("open", "close", "high"),
        "unknown_price_basis": ~c("price_basis").isin(*PRICE_BASES),
        "unknown_volume_semantics": ~c("volume_semantics").isin(*VOLUME_SEMANTICS),
        "volume_without_semantics": none & c("volume").isNotNull(),
        "volume_missing": ~none & c("volume").isNull(),
        "volume_negative": c("volume") < 0,
    }
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return bars.withColumn("violations", found)


def check_trades(trades: DataFrame, expected: Column) -> DataFrame:
    """Adds ``verdict``: valid, or the first rule of the trade contract that a row breaks."""
    c = F.col
    finite = lambda x: c(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    verdict = (
        F.when(~F.coalesce(expected, F.lit(False)), "unexpected_instrument")
        .when(F.coalesce(c("candidate_event_id"), F.lit("")) == "", "missing_identity")
        .when(~F.coalesce(c("complete"), F.lit(False)), "incomplete")
        .when(~(finite("pips_adverse") & finite("pips_favorable")), "not_finite")
        .otherwise("valid")
    )
    return trades.withColumn("verdict", verdict)


def other_instrument(rows: DataFrame, declared: str) -> DataFrame:
    """Rows of a part that do not carry the instrument it was declared for."""
    return rows.where(~F.col("instrument").eqNullSafe(F.lit(declared)))


def split_valid(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = check_rows(bars)
    good = F.size("violations") == 0
    return checked.where(good).drop("violations"), checked.where(~good)


def dataset_report(bars: DataFrame, step_s: int) -> DataFrame:
    """Counts of structural faults per series.

    Duplicate rows and intervals come from grouping; an overlap is an interval that opens before
    the latest close of any earlier one, carried over the whole series chunk by chunk.
    """
    keys = ["instrument", "timeframe"]
    interval = [*keys, "open_time", "close_time"]
    rest = [c for c in bars.columns if c not in interval]
    rows = bars.groupBy(*bars.columns).agg(F.count("*").alias("_same"))
    spans = rows.groupBy(*interval).agg(
        F.sum("_same").alias("_rows"), F.sum(F.col("_same") - 1).alias("_copies"), F.count("*").alias("_variants")
    )
    lo, hi = seconds(F.col("open_time")), seconds(F.col("close_time"))
    placed = carry_max(spans.withColumns({"_lo": lo, "_hi": hi}), keys, ["_lo", "_hi"], F.col("_lo"), step_s * 64, "_hi", "_reach")
    structure = placed.groupBy(*keys).agg(
        F.sum("_rows").alias("rows"),
        F.sum("_copies").alias("duplicate_rows"),
        F.sum(F.col("_variants") - 1).alias("duplicate_intervals"),
        F.count_if(F.col("_hi") - F.col("_lo") != step_s).alias("wrong_length"),
        F.count_if(F.col("_reach") > F.col("_lo")).alias("overlaps"),
    )
    mixed = bars.groupBy(*keys).agg(
        F.count_distinct("price_basis").alias("price_bases"), F.count_distinct("volume_semantics").alias("volume_kinds")
    )
    return structure.alias("l").join(mixed.alias("r"), same_keys(keys)).select(
        "l.*", (F.col("r.price_bases") == 1).alias("one_basis"), (F.col("r.volume_kinds") == 1).alias("one_volume_kind")
    )


def _previous_close(bars: DataFrame, keys, width: int) -> DataFrame:
    return carry_last(bars, keys, "open_time", seconds(F.col("open_time")), width, "close_time", "_previous_close")


def gaps(bars: DataFrame, step_s: int, width: int, keys=("instrument", "timeframe")) -> DataFrame:
    """(gap_start, gap_end) between neighbouring bars; informational, nothing is filled."""
    rows = _previous_close(bars, list(keys), width)
    return rows.where(F.col("open_time") > F.col("_previous_close")).select(
        *keys, F.col("_previous_close").alias("gap_start"), F.col("open_time").alias("gap_end")
    )


def universe_audit(bars: DataFrame, step_s: int, start: str, end: str, long_gap_s: int, width: int) -> DataFrame:
    """Coverage of [start, end): ratio, missing bars, bad prices, long gaps incl. the edges."""
    lo, hi = (F.unix_seconds(F.lit(x).cast("timestamp")) for x in (start, end))
    t = seconds(F.col("open_time"))
    rows = bars.where((t >= lo) & (t < hi))
    inner = gaps(rows, step_s, width).select(
        "instrument", (seconds(F.col("gap_end")) - seconds(F.col("gap_start"))).alias("gap_s")
    )
    c = F.col
    base = rows.groupBy("instrument").agg(
        F.count("*").alias("bars"),
        F.count_distinct("open_time").alias("distinct_bars"),
        F.count_if((c("high") < c("low")) | (c("low") <= 0)).alias("bad_prices"),
        F.count_distinct(F.to_date("open_time")).alias("days"),
        F.min(t).alias("_first"),
        F.max(seconds(c("close_time"))).alias("_last"),
    )
    edges = base.select(
        "instrument", F.explode(F.array(c("_first") - lo, hi - c("_last"))).alias("gap_s")
    ).where("gap_s > 0")
    holes = inner.unionByName(edges).groupBy("instrument").agg(
        F.count_if(c("gap_s") >= long_gap_s).alias("long_gaps"),
        F.max("gap_s").alias("max_gap_s"),
        F.sum("gap_s").alias("gap_total_s"),
    )
    expected = (hi - lo) / step_s
    return (
        base.join(holes, "instrument", "left")
        .withColumns(
            {
                "expected_bars": expected.cast("long"),
                "missing_bars": expected.cast("long") - c("distinct_bars"),
                "duplicate_bars": c("bars") - c("distinct_bars"),
                "coverage": c("distinct_bars") / expected,
                "absent_days": ((hi - lo) / 86400).cast("long") - c("days"),
                "long_gaps": F.coalesce("long_gaps", F.lit(0)),
                "max_gap_s": F.coalesce("max_gap_s", F.lit(0)),
                "gap_total_s": F.coalesce("gap_total_s", F.lit(0)),
            }
        )
        .drop("_first", "_last", "days")
    )


def calendar(spark, start: str, end: str) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    )


def day_range(rows: DataFrame, day: str = "day") -> tuple[str, str]:
    """First and last day of a table, as text: one row of two dates."""
    r = rows.agg(F.min(day).cast("string").alias("a"), F.max(day).cast("string").alias("b")).first()
    return (r["a"], r["b"]) if r["a"] else ("1970-01-01", "1970-01-01")


def absent_days(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Calendar days in [start, end] without a row, per key."""
    present = rows.select(key, "day").distinct()
    spine = present.select(key).distinct().withColumn(
        "day", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    )
    return spine.join(present, [key, "day"], "left_anti")


def calendar_partition(rows: DataFrame, declared_absent: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Per key: days that are present, declared absent, both (conflict) or neither."""
    present = rows.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(
        key, "day", F.lit(1).alias("p"), F.lit(0).alias("a")
    ).distinct()
    absent = declared_absent.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(
        key, "day", F.lit(0).alias("p"), F.lit(1).alias("a")
    ).distinct()
    spine = rows.select(key).distinct().select(
        key,
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"),
        F.lit(0).alias("p"),
        F.lit(0).alias("a"),
    )
    days = present.unionByName(absent).unionByName(spine).groupBy(key, "day").agg(F.max("p").alias("p"), F.max("a").alias("a"))
    return days.groupBy(key).agg(
        F.count("*").alias("calendar_days"),
        F.sum("p").alias("present_days"),
        F.sum("a").alias("absent_days"),
        F.count_if((F.col("p") == 1) & (F.col("a") == 1)).alias("conflicts"),
        F.count_if((F.col("p") == 0) & (F.col("a") == 0)).alias("unexplained"),
    ).withColumn("exact_partition", (F.col("conflicts") == 0) & (F.col("unexplained") == 0))


def presence(bars: DataFrame, universe: Column, member: Column, members) -> DataFrame:
    """Per universe and clock: one 0/1 column per member (``m0``, ``m1``, ... in the given order).

    ``members`` is the fixed list of a universe, so the width is bounded and no pairs or sets of
    clocks are ever emitted.
    """
    rows = bars.select(universe.alias("universe"), member.alias("_member"), "open_time")
    flags = [F.max((F.col("_member") == m).cast("int")).alias(f"m{i}") for i, m in enumerate(members)]
    return rows.groupBy("universe", "open_time").agg(*flags)


def sync_audit(clocks: DataFrame, members) -> DataFrame:
    """Per universe and member: own clocks, clocks common to all, loss; plus union and ratio."""
    every = reduce(lambda a, b: a * b, [F.col(f"m{i}") for i in range(len(members))])
    wide = clocks.groupBy("universe").agg(
        F.count("*").alias("union_clocks"),
        F.sum(every).alias("common_clocks"),
        *[F.sum(f"m{i}").alias(f"n{i}") for i in range(len(members))],
    )
    items = F.array(*[F.struct(F.lit(m).alias("member"), F.col(f"n{i}").alias("clocks")) for i, m in enumerate(members)])
    return wide.select("universe", "union_clocks", "common_clocks", F.inline(items)).withColumns(
        {
            "lost_to_sync": F.col("clocks") - F.col("common_clocks"),
            "common_ratio": F.col("common_clocks") / F.col("union_clocks"),
        }
    )


def sync_pairs(clocks: DataFrame, members) -> DataFrame:
    """Common clock counts of each member pair of a universe, as sums of flag products."""
    pairs = list(combinations(range(len(members)), 2))
    wide = clocks.groupBy("universe").agg(
        *[F.sum(F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}_{j}") for i, j in pairs]
    )
    items = F.array(
        *[
            F.struct(
                F.lit(members[i]).alias("left_member"),
                F.lit(members[j]).alias("right_member"),
                F.col(f"c{i}_{j}").alias("common_clocks"),
            )
            for i, j in pairs
        ]
    )
    return wide.select("universe", F.inline(items))


def day_audit(bars: DataFrame, step_s: int, factors=()) -> DataFrame:
    """One row per (instrument, day): counts, gaps between bars, price range, volume range and total, and
    for each of ``factors`` the resampled windows that are whole and those that lack a bar.

    A day is gathered as its distinct slots of ``step_s`` seconds, so it holds 86400 / step_s at most.
    """
    slot = F.floor(F.unix_seconds("open_time") / step_s)
    days = bars.groupBy("instrument", F.date_format("open_time", "yyyy-MM-dd").alias("day")).agg(
        F.array_sort(F.collect_set(slot)).alias("_slots"),
        F.count("*").alias("bars"),
        F.min("low").alias("min_low"),
        F.max("high").alias("max_high"),
        F.min("volume").alias("min_volume"),
        F.max("volume").alias("max_volume"),
        F.sum("volume").alias("total_volume"),
    )
    jump = lambda s, i: (i > 0) & (s - F.get("_slots", i - 1) > 1)
    counts = {"gaps": F.size(F.filter("_slots", jump))}
    for f in factors:
        counts |= dict(zip((f"windows_{f}", f"incomplete_{f}"), _windows(f)))
    return days.withColumns(counts).drop("_slots")


def _windows(factor: int) -> tuple[Column, Column]:
    """Windows of ``factor`` slots that are whole, and those that are touched but not whole."""
    full = lambda s, i: (s % factor == 0) & (F.get("_slots", i + (factor - 1)) == s + (factor - 1))
    whole = F.size(F.filter("_slots", full))
    return whole, F.size(F.array_distinct(F.transform("_slots", lambda s: F.floor(s / factor)))) - whole


def reconcile(left: DataFrame, right: DataFrame, keys, columns) -> DataFrame:
    """Full outer join on ``keys``; which side a key is on and which columns disagree."""
    l = left.select(*keys, *columns, F.lit(True).alias("_in")).alias("l")
    r = right.select(*keys, *columns, F.lit(True).alias("_in")).alias("r")
    joined = l.join(r, same_keys(keys), "full_outer")
    side = F.when(F.col("l._in").isNull(), "right_only").when(F.col("r._in").isNull(), "left_only").otherwise("both")
    wrong = F.array_compact(
        F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in columns])
    )
    return joined.select(
        *[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys],
        side.alias("side"),
        F.when(side == "both", F.array_join(wrong, "|")).alias("mismatched"),
        *[F.col(f"l.{c}").alias(f"left_{c}") for c in columns],
        *[F.col(f"r.{c}").alias(f"right_{c}") for c in columns],
    )


def require(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """Fail the job on the first bad row instead of passing it on."""
    checked = F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
    return df.where(checked)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent identity of a table: row count and sum of row hashes."""
    cols = sorted(df.columns)
    return df.agg(
        F.count("*").alias("rows"),
        F.sum(F.xxhash64(*cols).cast("decimal(20,0)")).cast("decimal(38,0)").alias("hash_sum"),
    )


def part_completeness(parts: DataFrame, declared: int, totals: DataFrame, source: str) -> DataFrame:
    """Per run: are the parts exactly 0..declared-1, does each group sit in one part, do the rows add up
    to the run's declared total, and do all of them name one ``source``?

    ``totals`` (run, declared_rows) has one row a run; a run without a total is not complete.
    """
    owners = parts.groupBy("run", "group_key").agg(F.count_distinct("part").alias("_owners"), F.count("*").alias("_rows"))
    groups = owners.groupBy("run").agg(
        F.count("*").alias("groups"), F.count_if(F.col("_owners") > 1).alias("split_groups"), F.sum("_rows").alias("rows")
    )
    index = parts.select("run", "part").distinct().groupBy("run").agg(
        F.count_if((F.col("part") >= 0) & (F.col("part") < declared)).alias("found_parts"),
        F.count_if((F.col("part") < 0) | (F.col("part") >= declared)).alias("undeclared_parts"),
    )
    # A row that names no source is a source of its own.
    sources = parts.select("run", F.struct(source).alias("_source")).distinct().groupBy("run").agg(F.count("*").alias("sources"))
    out = groups.join(index, "run").join(sources, "run").join(totals.select("run", "declared_rows"), "run", "left")
    sound = (F.col("found_parts") == declared) & (F.col("undeclared_parts") == 0) & (F.col("split_groups") == 0)
    told = F.coalesce(F.col("rows") == F.col("declared_rows"), F.lit(False))
    return out.withColumn("complete", sound & told & (F.col("sources") == 1))


def duplicate_identity(rows: DataFrame, identity, values) -> DataFrame:
    """One row per identity: copies, and whether they agree (identical) or not (conflict)."""
    same = rows.groupBy(*identity, *values).agg(F.count("*").alias("_n"))
    per = same.groupBy(*identity).agg(F.sum("_n").alias("copies"), F.count("*").alias("variants"))
    return per.withColumn(
        "verdict", F.when(F.col("copies") == 1, "unique").when(F.col("variants") == 1, "identical").otherwise("conflict")
    )


def collapse_identical(rows: DataFrame, identity, values) -> DataFrame:
    """Keep one copy per identity; copies that disagree fail the job."""
    per = rows.groupBy(*identity).agg(
        *[F.min(v).alias(v) for v in values], *[F.max(v).alias(f"_max_{v}") for v in values]
    )
    bad = reduce(lambda a, b: a | b, [~F.col(v).eqNullSafe(F.col(f"_max_{v}")) for v in values])
    return require(per, bad, "conflicting duplicate identity").select(*identity, *values)


def outside_period(rows: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    day = F.to_date(ts)
    return rows.where(~day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def orphans(rows: DataFrame, parents: DataFrame, keys) -> DataFrame:
    return rows.join(parents, list(keys), "left_anti")


def missing_parts(source: DataFrame, target: DataFrame, keys) -> DataFrame:
    return source.select(*keys).distinct().join(target.select(*keys).distinct(), list(keys), "left_anti")
