"""Transaction-cost dimensions and scenarios."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewindow.functions import sessions as S
from tidewindow.functions.scalars import net_pips
from tidewindow.operators import stats as ST
from tidewindow.operators.chunks import same_keys, value_bin
from tidewindow.operators.joins import lookup_cost

# Fixed values of the scenario matrix.
STATISTICS = ("mean", "p75", "p90", "p95")
SLIPPAGES = (0.0, 0.1, 0.25, 0.5)
HEADLINE = (("mean", 0.0), ("p75", 0.1), ("p90", 0.25), ("p95", 0.5))


def spread_profile(ticks: DataFrame, bucket_s: int, quantiles=None) -> DataFrame:
    """Spread statistics by (instrument, session), from the last quote of each bucket.

    Sessions overlap; ``overall`` counts every sample once.
    """
    quantiles = quantiles or {"p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}
    last = ticks.groupBy("instrument", F.floor(F.unix_seconds("ts") / bucket_s).alias("_b")).agg(
        F.max_by("raw_spread", F.struct("ts", "tick_id")).alias("_s")
    )
    at = F.timestamp_seconds(F.col("_b") * bucket_s)
    rows = last.select(
        "instrument",
        F.explode(F.concat(F.array(F.lit("overall")), S.active_names(at))).alias("session"),
        F.greatest(F.lit(0.0), F.col("_s")).alias("spread"),
    )
    keys = ["instrument", "session"]
    means = rows.groupBy(*keys).agg(F.count("*").alias("samples"), F.avg("spread").alias("mean"))
    return ST.attach(means, ST.quantiles(rows, keys, "spread", quantiles), keys)


def long_costs(profile: DataFrame, pip: Column, statistics=STATISTICS) -> DataFrame:
    """(instrument, session, statistic, spread) in pips from a profile."""
    items = F.array(*[F.struct(F.lit(s).alias("statistic"), (F.col(s) / pip).alias("spread")) for s in statistics])
    return profile.select("instrument", "session", F.explode(items).alias("_i")).select("instrument", "session", "_i.*")


def scenario_grid(costs: DataFrame, slippages=SLIPPAGES) -> DataFrame:
    return costs.withColumn("slippage", F.explode(F.array(*[F.lit(float(s)) for s in slippages])))


def uncovered(keys: DataFrame, costs: DataFrame) -> DataFrame:
    """Required (instrument, session) pairs that no cost row covers."""
    need = keys.select("instrument", F.coalesce("session", F.lit("overall")).alias("session")).distinct()
    return need.join(costs.select("instrument", "session").distinct(), ["instrument", "session"], "left_anti")


def block_uncovered(rows: DataFrame, costs: DataFrame) -> DataFrame:
    """Adds ``cost_status``; an instrument with any uncovered pair is blocked as a whole."""
    blocked = uncovered(rows, costs).select("instrument").distinct().withColumn("_blocked", F.lit(True))
    return (
        rows.alias("l")
        .join(blocked.alias("r"), same_keys(["instrument"]), "left")
        .select("l.*", F.when(F.col("r._blocked"), "blocked").otherwise("covered").alias("cost_status"))
    )


def priced(trades: DataFrame, costs: DataFrame) -> DataFrame:
    """Complete trades x scenarios with adverse-first and favourable-first net pips.

    No trade is lost: an instrument that lacks a cost row for any session it trades in is blocked,
    and its trades come out once, with ``cost_status`` blocked and no scenario; so does a trade
    whose result is no finite number, as refused.
    """
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))
    status = F.when(finite("pips_adverse") & finite("pips_favorable"), F.col("cost_status")).otherwise("refused")
    known = block_uncovered(trades, costs).withColumn("cost_status", status)
    rows = lookup_cost(known, costs, F.col("session"), F.col("cost_status") == "covered")
    c = F.col
    return rows.withColumns(
        {
            "net_adverse": net_pips(c("pips_adverse"), c("spread"), c("slippage"), c("commission"), c("converted")),
            "net_favorable": net_pips(c("pips_favorable"), c("spread"), c("slippage"), c("commission"), c("converted")),
            "modeled_cost": c("spread") + c("slippage") + c("commission"),
        }
    )


def with_scenarios(entries: DataFrame, traded: DataFrame, costs: DataFrame) -> DataFrame:
    """Adds ``cost_status`` and ``scenarios``, all cost rows of the entry's session as one array.

    ``traded`` are the entries with a complete trade; as in :func:`priced`, an instrument that lacks a
    cost row for any session it trades in is blocked.
    """
    blocked = uncovered(traded, costs).select("instrument").distinct().withColumn("_blocked", F.lit(True))
    extra = [c for c in costs.columns if c not in ("instrument", "session")]
    held = costs.groupBy("instrument", "session").agg(F.array_sort(F.collect_list(F.struct(*extra))).alias("scenarios"))
    rows = entries.alias("l").join(blocked.alias("r"), F.col("l.instrument") == F.col("r.instrument"), "left").select(
        "l.*", F.when(F.col("r._blocked"), "blocked").otherwise("covered").alias("cost_status")
    )
    return lookup_cost(rows, held, F.col("session"), F.col("cost_status") == "covered")


def finite_status(trades: DataFrame) -> DataFrame:
    """A trade whose result is no finite number is refused."""
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))
    status = F.when(finite("pips_adverse") & finite("pips_favorable"), F.col("cost_status")).otherwise("refused")
    return trades.withColumn("cost_status", status)


def status_of(trades: DataFrame) -> DataFrame:
    """:func:`finite_status`, and what is not covered has no scenarios."""
    rows = finite_status(trades)
    return rows.withColumn("scenarios", F.when(F.col("cost_status") == "covered", F.col("scenarios")))


def scenario_rows(trades: DataFrame) -> DataFrame:
    """The rows of :func:`priced` from trades that carry their ``scenarios``: no join, no shuffle."""
    c = F.col
    rest = [x for x in trades.columns if x != "scenarios"]
    return trades.select(*rest, F.inline_outer("scenarios")).withColumns(
        {
            "net_adverse": net_pips(c("pips_adverse"), c("spread"), c("slippage"), c("commission"), c("converted")),
            "net_favorable": net_pips(c("pips_favorable"), c("spread"), c("slippage"), c("commission"), c("converted")),
            "modeled_cost": c("spread") + c("slippage") + c("commission"),
        }
    )


def break_even(trades: DataFrame, keys, gross: str, spread: str, commission: str, converted: str) -> DataFrame:
    """Total slippage at which a group's mean net result crosses zero.

    Without conversion the mean is linear in slippage.  With it, the mean is piecewise linear
    with a kink where a trade's value changes sign, so the zero lies between two neighbouring
    gross values.  Prefix sums over order-preserving bins find it; no group is gathered.
    Expects one (spread, commission, converted) per group.
    """
    keys = list(keys)
    g, sp, cm = F.col(gross), F.col(spread), F.col(commission)
    base = trades.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.sum(g).alias("_g"),
        F.max(sp).alias("_sp"),
        F.max(cm).alias("_cm"),
        F.max(F.col(converted).cast("int")).alias("_cv"),
        F.sum(F.when(g - sp > 0, (g - sp) * 0.993).otherwise((g - sp) * 1.007)).alias("_v0"),
    )
    mean0 = F.when(F.col("_cv") == 1, F.col("_v0") / F.col("_n") - F.col("_cm")).otherwise(
        F.col("_g") / F.col("_n") - F.col("_sp") - F.col("_cm")
    )
    base = base.withColumn("_mean0", mean0)
    # Kinks at x = gross - spread, ascending: below the cut s trades lose, above they win.
    x = g - sp
    placed = trades.where(F.col(converted)).select(*keys, x.alias("_x")).groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    placed = placed.withColumn("_bin", value_bin(F.col("_x")))
    across = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    bins = placed.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_bc"), F.sum(F.col("_c") * F.col("_x")).alias("_bs"))
    bins = bins.select(
        *keys,
        "_bin",
        F.coalesce(F.sum("_bc").over(across), F.lit(0)).alias("_bc0"),
        F.coalesce(F.sum("_bs").over(across), F.lit(0.0)).alias("_bs0"),
        F.sum("_bc").over(whole).alias("_all_c"),
        F.sum("_bs").over(whole).alias("_all_s"),
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    kinks = (
        placed.alias("l")
        .join(bins.alias("r"), same_keys([*keys, "_bin"]))
        .select("l.*", "r._bc0", "r._bs0", "r._all_c", "r._all_s")
        .withColumns(
            {
                "_lo_c": F.col("_bc0") + F.sum("_c").over(inside),
                "_lo_s": F.col("_bs0") + F.sum(F.col("_c") * F.col("_x")).over(inside),
            }
        )
    )
    hi_c, hi_s = F.col("_all_c") - F.col("_lo_c"), F.col("_all_s") - F.col("_lo_s")
    # Total net value when the slippage equals this kink (trades at the kink contribute zero).
    total = 0.993 * (hi_s - hi_c * F.col("_x")) + 1.007 * (F.col("_lo_s") - F.col("_lo_c") * F.col("_x"))
    kinks = kinks.withColumns({"_total": total, "_hi_c": hi_c, "_hi_s": hi_s})
    joined = kinks.alias("l").join(base.alias("r"), same_keys(keys)).select("l.*", "r._n", "r._cm")
    # The total falls with slippage: the segment starts at the last kink still positive.
    target = F.col("_cm") * F.col("_n")
    above = joined.where(F.col("_total") > target).groupBy(*keys).agg(
        F.max_by(F.struct("_lo_c", "_lo_s", "_hi_c", "_hi_s"), F.col("_x")).alias("_seg")
    )
    edge = kinks.groupBy(*keys).agg(F.max("_all_c").alias("_ac"), F.max("_all_s").alias("_as"))
    out = ST.attach(ST.attach(base, above, keys), edge, keys)
    lo_c = F.coalesce(F.col("_seg._lo_c"), F.lit(0))
    lo_s = F.coalesce(F.col("_seg._lo_s"), F.lit(0.0))
    up_c = F.coalesce(F.col("_seg._hi_c"), F.col("_ac"))
    up_s = F.coalesce(F.col("_seg._hi_s"), F.col("_as"))
    root = F.try_divide(0.993 * up_s + 1.007 * lo_s - F.col("_cm") * F.col("_n"), 0.993 * up_c + 1.007 * lo_c)
    value = F.when(F.col("_mean0") <= 0, F.lit(0.0)).when(F.col("_cv") == 1, root).otherwise(F.col("_mean0"))
    return out.select(*keys, value.alias("break_even_slippage"))


def with_break_even(cells: DataFrame, trades: DataFrame, keys) -> DataFrame:
    """Adds to cost cells (one row per ``keys`` and slippage) the total slippage at which the cell breaks even,
    and what is left of it beyond the cell's own.  ``trades`` are covered and priced without slippage; a cell
    that has none of them keeps NULL in both."""
    even = break_even(trades, keys, "pips_adverse", "spread", "commission", "converted")
    out = ST.attach(cells, even, list(keys))
    extra = F.greatest(F.lit(0.0), F.col("break_even_slippage") - F.col("slippage"))
    return out.withColumn("extra_slippage", F.when(F.col("break_even_slippage").isNotNull(), extra))
