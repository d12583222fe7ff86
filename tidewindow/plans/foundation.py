"""Registered queries: ingest, quality, sessions, resampling and scalar columns."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from tidewindow.functions import sessions as S
from tidewindow.operators import observations as OB, quality as Q, resample as RS
from tidewindow.plans import study as ST
from tidewindow.plans.study import tidy
from tidewindow.sources import driver as D
from tidewindow.sources.staging import stage


def epoch(name, out=None):
    return F.unix_seconds(name).alias(out or name)


def bar_ingest(spark, sf):
    b = D.bars(spark, sf)
    return tidy(b.select("instrument", epoch("open_time", "open_s"), "open", "high", "low", "close", "volume"))


def resample_bars(spark, sf):
    out = RS.resample(D.bars(spark, sf), D.BASE, *ST.TIMEFRAMES)
    return tidy(
        out.select("instrument", "timeframe", epoch("open_time", "open_s"), epoch("available_at", "available_s"),
                   "open", "high", "low", "close", "volume")
    )


def resample_incomplete(spark, sf):
    out = RS.incomplete_windows(D.bars(spark, sf), D.BASE, *ST.TIMEFRAMES)
    return tidy(out.select("instrument", "timeframe", epoch("open_time", "open_s"), "expected", "observed"))


def resample_conservation(spark, sf):
    return tidy(RS.conservation(D.bars(spark, sf), D.BASE, *ST.TIMEFRAMES))


def scalar_columns(spark, sf):
    """Timeframe seconds, aliases, tick decoding, pip, typical price, activity, returns, keys."""
    from tidewindow.functions import scalars as C

    b = OB.observe(D.bars(spark, sf))
    c = F.col
    return tidy(
        b.select(
            "instrument",
            c("t").alias("open_s"),
            C.timeframe_seconds(c("timeframe")).alias("tf_s"),
            C.timeframe_seconds(C.normalize_timeframe(F.lit(" h1 "))).alias("alias_s"),
            D.pip().alias("pip"),
            C.typical_price(c("high"), c("low"), c("close")).alias("hlc3"),
            c("active"),
            C.arithmetic_return(c("close"), c("open")).alias("bar_return"),
            F.ln(c("close") / c("open")).alias("log_return"),
            C.upper_wick(c("open"), c("high"), c("close")).alias("upper_wick"),
            C.lower_wick(c("open"), c("low"), c("close")).alias("lower_wick"),
            C.true_range(c("high"), c("low"), c("open")).alias("true_range"),
            C.month_key(c("open_time")).alias("month"),
            C.quarter_key(c("open_time")).alias("quarter"),
        )
    )


def tick_decode(spark, sf):
    t = D.ticks(spark, sf)
    return tidy(t.select("tick_id", "instrument", "ticks", "price", D.pip().alias("pip")))


def point_in_time_view(spark, sf):
    """Bars known on 2024-01-15 00:00 UTC, per instrument."""
    instant = "2024-01-15 00:00:00"
    seen = OB.as_of(D.bars(spark, sf, until=instant), F.lit(instant).cast("timestamp"))
    return tidy(
        seen.groupBy("instrument").agg(F.count("*").alias("bars"), F.max(F.unix_seconds("available_at")).alias("last_s"))
    )


def session_labels(spark, sf):
    rows = S.classify(D.bars(spark, sf))
    return tidy(
        rows.select(
            "instrument",
            epoch("open_time", "open_s"),
            F.array_join("active_sessions", "|").alias("sessions"),
            "regime",
            F.array_join("active_named_windows", "|").alias("named"),
            F.col("session_membership")["london"].alias("in_london"),
            F.date_format(F.col("local_times")["asia"], "yyyy-MM-dd HH:mm").alias("tokyo_clock"),
        )
    )


def session_bounds(spark, sf):
    """Instance dates, window bounds and trading-day bounds of every bar."""
    b = D.bars(spark, sf)
    t = F.col("open_time")
    night = next(w for w in S.NAMED_WINDOWS if w.crosses_midnight)
    day = S.instance_date(t, S.MAJOR_SESSIONS[2])
    lo, hi = S.window_bounds(day, S.MAJOR_SESSIONS[2])
    nlo, nhi = S.window_bounds(S.instance_date(t, night), night)
    flo, fhi = S.window_bounds(day, S.TRADING_DAY)
    return tidy(
        b.select(
            "instrument",
            epoch("open_time", "open_s"),
            F.date_format(day, "yyyy-MM-dd").alias("ny_date"),
            F.unix_seconds(lo).alias("ny_open_s"),
            F.unix_seconds(hi).alias("ny_close_s"),
            F.unix_seconds(nlo).alias("night_open_s"),
            F.unix_seconds(nhi).alias("night_close_s"),
            F.unix_seconds(flo).alias("day_open_s"),
            F.unix_seconds(fhi).alias("day_close_s"),
        )
    )


def session_minutes(spark, sf):
    b = D.bars(spark, sf)
    name, since, until = S.sole_session_minutes(F.col("open_time"))
    return tidy(
        b.select("instrument", epoch("open_time", "open_s"), name.alias("session"), since.alias("from_open"),
                 until.alias("to_close"))
    )


def dataset_gaps(spark, sf):
    gaps = Q.gaps(D.bars(spark, sf), D.BASE_S, ST.WIDTH)
    return tidy(gaps.select("instrument", epoch("gap_start", "start_s"), epoch("gap_end", "end_s")))


def _line_bars(spark, sf):
    """Line items read as candidate daily bars of a supplier; many break the bar contract."""
    li = D.table(spark, sf, "lineitem")
    opened = F.col("l_shipdate").cast("timestamp")
    return li.select(
        F.col("l_suppkey").cast("string").alias("instrument"),
        F.lit("1d").alias("timeframe"),
        opened.alias("open_time"),
        (opened + F.expr("INTERVAL 1 DAY") * F.when(F.col("l_linenumber") == 7, 2).otherwise(1)).alias("close_time"),
        (opened + F.expr("INTERVAL 1 DAY") * (F.col("l_linenumber") % 3)).alias("available_at"),
        F.col("l_quantity").alias("open"),
        (F.col("l_extendedprice") / 2000.0).alias("high"),
        (F.col("l_discount") * 200.0).alias("low"),
        (F.col("l_tax") * 500.0).alias("close"),
        F.when(F.col("l_returnflag") == "R", "quote").otherwise("bid").alias("price_basis"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("volume"),
        F.when(F.col("l_returnflag") == "A", "none").otherwise("tick").alias("volume_semantics"),
    )


def row_contract(spark, sf):
    rows = Q.check_rows(_line_bars(spark, sf))
    return rows.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("rows"))


def dataset_contract(spark, sf):
    return tidy(Q.dataset_report(_line_bars(spark, sf), 86400))


def universe_audit(spark, sf):
    """Coverage of the days that the ticks span, first day to the day after the last."""
    b = stage(D.bars(spark, sf))
    first, last = Q.day_range(b.select(F.to_date("open_time").alias("day")))
    end = str(date.fromisoformat(last) + timedelta(days=1))
    return tidy(Q.universe_audit(b, D.BASE_S, first, end, 3 * D.BASE_S, ST.WIDTH))


def absent_days(spark, sf):
    """Calendar days without orders, per priority class (spine anti join)."""
    o = D.table(spark, sf, "orders")
    rows = o.select(F.col("o_orderpriority").alias("instrument"), F.to_date("o_orderdate").alias("day"))
    out = Q.absent_days(rows, "instrument", *Q.day_range(rows))
    return out.select("instrument", F.date_format("day", "yyyy-MM-dd").alias("day"))


def calendar_partition(spark, sf):
    """Does (dates with data) + (declared absent dates) partition the calendar exactly?"""
    o = D.table(spark, sf, "orders")
    rows = o.select(F.col("o_orderstatus").alias("instrument"), F.to_date("o_orderdate").alias("day"))
    declared = rows.where(F.day("day") == 31).select("instrument", "day").distinct()
    return tidy(Q.calendar_partition(rows, declared, "instrument", *Q.day_range(rows)))


def _clocks(spark, sf):
    return Q.presence(D.bars(spark, sf), D.universe(), D.member(), D.MEMBERS)


def sync_audit(spark, sf):
    return tidy(Q.sync_audit(_clocks(spark, sf), D.MEMBERS))


def sync_pairs(spark, sf):
    return tidy(Q.sync_pairs(_clocks(spark, sf), D.MEMBERS))


def day_audit(spark, sf):
    return tidy(Q.day_audit(D.bars(spark, sf), D.BASE_S, (2, 4, 8)))


def plausibility(spark, sf):
    limits = {"click": (100.0, 400.0), "error": (100.5, 500.0), "purchase": (100.0, 600.0), "signup": (99.0, 450.0), "view": (100.0, 700.0)}
    b = D.bars(spark, sf)
    lo = D.by_type(F.col("instrument"), {k: v[0] for k, v in limits.items()})
    hi = D.by_type(F.col("instrument"), {k: v[1] for k, v in limits.items()})
    return tidy(
        b.withColumns({"_lo": lo, "_hi": hi})
        .groupBy("instrument")
        .agg(
            F.min("low").alias("min_low"),
            F.max("high").alias("max_high"),
            F.count_if(F.col("volume") < 0).alias("negative_volume"),
            (F.min(F.col("low") - F.col("_lo")) >= 0).alias("above_floor"),
            (F.max(F.col("high") - F.col("_hi")) <= 0).alias("below_ceiling"),
        )
    )


def reconcile_tables(spark, sf):
    """Customer order counts against line-item order counts, field by field (full outer)."""
    o = D.table(spark, sf, "orders").groupBy(F.col("o_orderkey").alias("k")).agg(
        F.count("*").alias("rows"), F.max(F.year("o_orderdate")).alias("year"))
    li = D.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.max("l_linenumber").cast("long").alias("rows"), F.min(F.year("l_shipdate")).alias("year"))
    out = Q.reconcile(o, li, ["k"], ["rows", "year"])
    return tidy(out.groupBy("side", "mismatched").agg(F.count("*").alias("keys")))


def event_identity(spark, sf):
    from tidewindow.functions.scalars import identity_hash

    b = D.bars(spark, sf)
    return b.select(
        "instrument", epoch("open_time", "open_s"),
        identity_hash("bar-", F.col("instrument"), F.col("timeframe"), F.unix_seconds("open_time"), F.col("price_basis")).alias("bar_id"),
    )


def part_completeness(spark, sf):
    """Eight declared parts per order status: indexes, overlaps, totals by line items, provenance by priority."""
    o = D.table(spark, sf, "orders")
    lines = D.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.lit(1).alias("_one"))
    totals = lines.join(o, "o_orderkey").groupBy(F.col("o_orderstatus").alias("run")).agg(F.count("*").alias("declared_rows"))
    parts = o.select(
        "o_orderpriority",
        F.col("o_orderstatus").alias("run"),
        F.pmod("o_custkey", F.lit(9)).alias("part"),
        F.col("o_orderkey").alias("group_key"),
    )
    return tidy(Q.part_completeness(parts, 8, totals, "o_orderpriority"))


def duplicate_identity(spark, sf):
    li = D.table(spark, sf, "lineitem")
    out = Q.duplicate_identity(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_quantity"])
    return tidy(out.groupBy("verdict").agg(F.count("*").alias("identities"), F.sum("copies").alias("rows")))


def period_guard(spark, sf):
    li = D.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    bad = Q.outside_period(li, "ts", "1995-06-01", "1999-06-30")
    return tidy(bad.groupBy("year").agg(F.count("*").alias("rows")))


def orphan_rows(spark, sf):
    li = D.table(spark, sf, "lineitem")
    o = D.table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tidy(Q.orphans(li, o, ["l_orderkey"]).groupBy("l_returnflag").agg(
        F.count("*").alias("rows"), F.count_distinct("l_orderkey").alias("orders")))


def expected_counts(spark, sf):
    """Observed event counts per type against a declared expectation (here: users x 13)."""
    e = D.table(spark, sf, "events")
    got = e.groupBy("event_type").agg(F.count("*").alias("n"))
    want = e.groupBy("event_type").agg((F.count_distinct("user_id") * 13).alias("n"))
    return tidy(Q.reconcile(got, want, ["event_type"], ["n"]).select("event_type", "side", "mismatched", "left_n", "right_n"))


def tick_validation(spark, sf):
    """Finite, non-negative, in-year ticks per instrument; the rejects are counted by reason."""
    t = D.ticks(spark, sf)
    reason = (
        F.when(F.col("price").isNull() | F.isnan("price"), "not_finite")
        .when(F.col("raw_spread") < 0, "negative_spread")
        .when(F.col("weight") == 0, "no_weight")
        .otherwise("ok")
    )
    return tidy(t.groupBy("instrument", reason.alias("reason")).agg(F.count("*").alias("rows")))


def incremental_ingest(spark, sf):
    """Days still to load: source listing minus what the target already holds."""
    t = D.ticks(spark, sf).select("instrument", F.to_date("ts").alias("day"))
    target = D.bars(spark, sf).where("volume >= 7").select("instrument", F.to_date("open_time").alias("day"))
    out = Q.missing_parts(t, target, ["instrument", "day"])
    return out.select("instrument", F.date_format("day", "yyyy-MM-dd").alias("day"))


def spread_profile(spark, sf):
    """Last quote per five-second bucket, clamped at zero, summarised by session."""
    from tidewindow.operators.costs import spread_profile as profile

    return tidy(profile(D.ticks(spark, sf), 5))


def panel_check(spark, sf):
    from tidewindow.operators.panel import panel_violations, synchronized_panel

    panel = synchronized_panel(D.bars(spark, sf), D.universe(), D.member(), D.MEMBERS)
    return tidy(panel_violations(panel, D.MEMBERS))


QUERIES = {
    f.__name__: f
    for f in (
        bar_ingest, resample_bars, resample_incomplete, resample_conservation, scalar_columns, tick_decode,
        point_in_time_view, session_labels, session_bounds, session_minutes, dataset_gaps, row_contract,
        dataset_contract, universe_audit, absent_days, calendar_partition, sync_audit, sync_pairs, day_audit,
        plausibility, reconcile_tables, event_identity, part_completeness, duplicate_identity, period_guard,
        orphan_rows, expected_counts, tick_validation, incremental_ingest, spread_profile, panel_check,
    )
}
