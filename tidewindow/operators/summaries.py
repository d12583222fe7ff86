"""Report-level aggregations: benchmarks, path matrices, outcome and cost cells, families."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewindow.operators import costs as CO, stats as ST
from tidewindow.operators.chunks import longest_run, same_keys


def active_months(obs: DataFrame, keys) -> DataFrame:
    month = F.date_format("open_time", "yyyy-MM")
    return obs.groupBy(*keys).agg(F.count_distinct(F.when(F.col("active"), month)).alias("months"))


def benchmark_summary(long: DataFrame, keys, thresholds, months: DataFrame, contexts=None, medians: bool = True) -> DataFrame:
    """Signal and return statistics per (keys, threshold, horizon, all/long/short).

    Every cell of the grid appears, also without signals.  ``contexts`` names a group column
    and the values that must all appear in it.
    """
    scope = [*keys, "threshold", "horizon_s"]
    limit = F.col("threshold")
    side = F.when(F.col("z") < -limit, 1).when(F.col("z") > limit, -1)
    # Signals are rare: keep those only, and let the grid restore empty cells.
    signals = (
        long.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
        .withColumn("side", F.when(F.col("active"), side))
        .where(F.col("side").isNotNull())
        .withColumn("signed", F.col("side") * F.col("ret"))
        .withColumn(
            "direction",
            F.explode(F.array(F.lit("all"), F.when(F.col("side") == 1, "long").otherwise("short"))),
        )
    )
    group = [*scope, "direction"]
    x = F.col("signed")
    stats = signals.groupBy(*group).agg(
        F.count("*").alias("signal_count"),
        F.count_if(F.col("side") == 1).alias("long_count"),
        F.count_if(F.col("side") == -1).alias("short_count"),
        *ST.moments(x),
    )
    if medians:
        stats = ST.attach(stats, ST.quantiles(signals, group, "signed", {"median": 0.5}), group)
    base = long.select(*keys, "horizon_s").distinct()
    if contexts:
        name, values = contexts
        others = [k for k in keys if k != name]
        base = base.select(*others, "horizon_s").distinct().withColumn(
            name, F.explode(F.array(*[F.lit(v).cast("string") for v in values]))
        )
    grid = (
        base.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
        .withColumn("direction", F.explode(F.array(*[F.lit(d) for d in ("all", "long", "short")])))
        .select(*group)
    )
    counts = ["signal_count", "long_count", "short_count", "valid_outcome_count"]
    out = ST.dense(grid, stats, group, counts)
    out = ST.attach(out, months, months.columns[:2])
    return out.withColumns(
        {
            "unavailable_count": F.col("signal_count") - F.col("valid_outcome_count"),
            "monthly_frequency": F.try_divide(F.col("signal_count"), F.col("months")),
        }
    )


def path_matrix(events: DataFrame, keys, snapshots, past, levels=(25, 50, 75, 100)) -> DataFrame:
    """One row per setup: counts, snapshot means, hit rates, excursion quantiles, impulse.

    Events that lie by some of ``keys`` are summarised where they are, all quantiles in one pass.
    """
    c = F.col
    full = c("path_complete")
    aggs = [F.count("*").alias("observations"), F.count_if(full).alias("complete_paths")]
    for h in snapshots:
        aggs += [F.count(f"pips_h{h}").alias(f"n_h{h}")]
        aggs += [F.avg(f"{m}_h{h}").alias(f"mean_{m}_h{h}") for m in ("bps", "pips", "reversion")]
    for level in levels:
        aggs += [F.count(f"t{level}").alias(f"hit{level}_count"), F.avg(f"t{level}").alias(f"mean_t{level}")]
    aggs += [F.count(f"impulse_h{h}").alias(f"n_presignal_h{h}") for h in past]
    quants = {}
    rows = events.withColumns(
        {
            **{f"pre_raw_pips_h{h}": c(f"pre_raw_h{h}") / c("pip") for h in past},
            **{f"pre_signed_pips_h{h}": c(f"pre_signed_h{h}") / c("pip") for h in past},
        }
    )
    medians = [f"{m}_h{h}" for h in snapshots for m in ("bps", "pips", "reversion")]
    medians += [f"t{level}" for level in levels]
    medians += ["mae_bps", "mfe_bps", "time_to_mae", "time_to_mfe"]
    medians += [f"pre_raw_pips_h{h}" for h in past] + [f"pre_signed_pips_h{h}" for h in past]
    tails = ["mae_pips", "mae_fraction", "mfe_pips", "mfe_fraction", "max_reversion"]
    shares = [f"impulse_h{h}" for h in past]
    for columns, wanted in (
        (medians, {"median": 0.5}),
        (tails, {"median": 0.5, "p75": 0.75, "p90": 0.9}),
        (shares, {"p25": 0.25, "median": 0.5, "p75": 0.75}),
    ):
        for name in columns:
            x = c(name).cast("double")
            # All ranks of a column from one count of its values.
            ranks = F.percentile(F.when(~F.isnan(x), x), F.array(*[F.lit(p) for p in wanted.values()]))
            quants |= {f"{name}_{q}": (f"_q_{name}", i) for i, q in enumerate(wanted)}
            aggs.append(ranks.alias(f"_q_{name}"))
    base = rows.groupBy(*keys).agg(*aggs)
    base = base.withColumns({name: F.get(source, F.lit(i)) for name, (source, i) in quants.items()})
    base = base.drop(*{source for source, _ in quants.values()})
    base = base.withColumn("complete_fraction", c("complete_paths") / c("observations"))
    for level in levels:
        base = base.withColumn(f"hit{level}_rate", F.try_divide(c(f"hit{level}_count"), c("complete_paths")))
    return base


QUANTS = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def outcome_matrix(outcomes: DataFrame, keys, plain=()) -> DataFrame:
    """Trade matrix cells: status counts, exit shares, means and nearest-rank quantiles.

    Ambiguous exits count as stops, and also on their own.
    """
    c = F.col
    done = c("complete")
    live = c("status") == "executed"
    x, n = F.when(done, c("pips_adverse")), F.count_if(done)
    stop_like = done & c("exit_reason").isin("sl", "ambiguous")
    base = outcomes.groupBy(*keys).agg(
        F.count_distinct("candidate_event_id").alias("candidates"),
        F.count_if(live).alias("executed"),
        F.count_if(c("status") == "no_entry").alias("no_entry"),
        F.count_if(c("status") == "passed").alias("passed"),
        n.alias("complete_trades"),
        F.count_if(live & ~done).alias("incomplete_trades"),
        F.count_if(c("ambiguous")).alias("ambiguous_count"),
        ST.fraction(F.count_if(c("ambiguous")), n).alias("ambiguous_fraction"),
        F.count_if(done & (c("exit_reason") == "tp")).alias("tp_count"),
        ST.fraction(F.count_if(done & (c("exit_reason") == "tp")), n).alias("tp_fraction"),
        F.count_if(stop_like).alias("sl_count"),
        ST.fraction(F.count_if(stop_like), n).alias("sl_fraction"),
        F.count_if(done & (c("exit_reason") == "time_stop")).alias("time_stop_count"),
        ST.fraction(F.count_if(done & (c("exit_reason") == "time_stop")), n).alias("time_stop_fraction"),
        F.avg(x).alias("mean_pips"),
        F.avg(F.when(done, c("pips_favorable"))).alias("mean_pips_favorable"),
        F.avg(F.when(done, c("bp_adverse"))).alias("mean_bp"),
        ST.fraction(F.count_if(x > 0), n).alias("win_fraction"),
        ST.fraction(F.count_if(x < 0), n).alias("loss_fraction"),
        ST.fraction(F.count_if(x == 0), n).alias("zero_fraction"),
        F.avg(F.when(done, c("mae_pips"))).alias("mean_mae_pips"),
        F.avg(F.when(done, c("mfe_pips"))).alias("mean_mfe_pips"),
        F.avg(F.when(done, c("wait"))).alias("mean_wait"),
    )
    rows = outcomes.where(done)
    values = ["pips_adverse", "bp_adverse", "mae_pips", "mfe_pips", "holding", "wait", "r_at_entry", "pre_entry_adverse"]
    pairs = [F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("x")) for v in values]
    ordered = ST.with_ranks(rows.select(*keys, F.inline(F.array(*pairs))), [*keys, "metric"], "x")
    quants = ordered.groupBy(*keys).agg(
        *[F.max(F.when((F.col("metric") == v) & ST.at_rank(p), F.col("x"))).alias(f"{v}_{q}") for v in values for q, p in QUANTS.items()]
    )
    return ST.attach(base, quants, keys, plain=plain)


def long_distributions(outcomes: DataFrame, keys) -> DataFrame:
    """One row per (cell, metric, quantile) with the sample size."""
    rows = outcomes.where(F.col("complete"))
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("x"))
            for m, c in (
                ("gross_pips", "pips_adverse"), ("mae_pips", "mae_pips"), ("mfe_pips", "mfe_pips"), ("holding", "holding"),
            )
        ]
    )
    long = rows.select(*keys, F.inline(pairs))
    group = [*keys, "metric"]
    # Ordered where the rows lie: a shuffle of grid rows, once per metric, would be the largest of the study.
    wide = ST.with_ranks(long, group, "x").groupBy(*group).agg(
        F.count("x").alias("sample_count"), *[F.max(F.when(ST.at_rank(p), F.col("x"))).alias(q) for q, p in QUANTS.items()]
    )
    items = F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(q).alias("value")) for q in QUANTS])
    return wide.select(*group, "sample_count", F.inline(items))


def race_summary(races: DataFrame, keys, levels=(25, 50)) -> DataFrame:
    group = [*keys, "horizon"]
    aggs = [F.count("*").alias("candidates")]
    times = []
    for level in levels:
        for side in ("reversion", "extension"):
            t = f"time_to_{side}{level}"
            times.append(t)
            aggs.append(ST.fraction(F.count(t), F.count("*")).alias(f"{side}{level}_hit_fraction"))
        for order in ("reversion", "extension", "ambiguous_same_minute", "none"):
            aggs.append(
                ST.fraction(F.count_if(F.col(f"ordering_{level}") == order), F.count("*")).alias(f"order{level}_{order}")
            )
    base = races.groupBy(*group).agg(*aggs)
    return ST.attach(base, ST.quantile_columns(races, group, times, {"median": 0.5}, ST.NEAREST), group)


def _barriers(races: DataFrame, keys, horizon: int) -> DataFrame:
    fields = [("R>=+0.25", "time_to_reversion25"), ("R>=+0.50", "time_to_reversion50"),
              ("R<=-0.25", "time_to_extension25"), ("R<=-0.50", "time_to_extension50")]
    items = F.array(*[F.struct(F.lit(b).alias("barrier"), F.col(c).alias("steps")) for b, c in fields])
    return races.where(F.col("horizon") == horizon).select(*keys, F.inline(items))


def first_passage_summary(races: DataFrame, keys, horizon: int, by) -> DataFrame:
    long = _barriers(races, keys, horizon)
    group = [*keys, "barrier"]
    base = long.groupBy(*group).agg(
        F.count("*").alias("candidates"),
        F.count("steps").alias("hits"),
        ST.fraction(F.count("steps"), F.count("*")).alias("hit_fraction"),
        F.avg("steps").alias("mean_steps"),
        *[ST.fraction(F.count_if(F.col("steps") <= m), F.count("*")).alias(f"hit_by_{m}") for m in by],
    )
    wanted = {k: v for k, v in QUANTS.items() if k != "p95"}
    return ST.attach(base, ST.quantiles(long, group, "steps", wanted, ST.NEAREST), group)


def hazard(races: DataFrame, keys, horizon: int, intervals) -> DataFrame:
    """At-risk counts and new hits per interval of steps (lo, hi]."""
    long = _barriers(races, keys, horizon)
    grid = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in intervals])
    # Count each waiting time once; intervals then read the small table of waiting times.
    counted = long.groupBy(*keys, "barrier", "steps").agg(F.count("*").alias("_n"))
    cells = counted.select("*", F.inline(grid))
    risk = F.col("steps").isNull() | (F.col("steps") > F.col("lo"))
    new = (F.col("steps") > F.col("lo")) & (F.col("steps") <= F.col("hi"))
    out = cells.groupBy(*keys, "barrier", "lo", "hi").agg(
        F.sum(F.when(risk, F.col("_n")).otherwise(0)).alias("at_risk"),
        F.sum(F.when(new, F.col("_n")).otherwise(0)).alias("new_hits"),
    )
    return out.withColumn("conditional_hit", ST.fraction(F.col("new_hits"), F.col("at_risk")))


def entry_waits(entries: DataFrame, keys, by) -> DataFrame:
    """Waiting-time distribution per entry mode (immediate entries excluded)."""
    rows = entries.where(F.col("entry_mode") != "immediate")
    group = [*keys, "entry_mode"]
    done = F.col("executed")
    values = {
        "wait": F.when(done, F.col("wait")),
        "ext": F.when(done, F.col("time_to_extension")),
        "reclaim": F.when(done, F.col("extension_to_entry")),
    }
    rows = rows.withColumns({f"_{k}": v for k, v in values.items()})
    base = rows.groupBy(*group).agg(
        F.count("*").alias("candidates"),
        F.count_if(done).alias("executed"),
        F.count_if(~done).alias("no_entry"),
        ST.fraction(F.count_if(~done), F.count("*")).alias("no_entry_fraction"),
        *[F.avg(f"_{k}").alias(f"mean_{k}") for k in values],
        *[ST.fraction(F.count_if(F.col("_wait") <= m), F.count("*")).alias(f"entry_by_{m}") for m in by],
        ST.fraction(F.count_if(F.col("_reclaim") == 0), F.count_if(done)).alias("same_step_fraction"),
    )
    wanted = {k: v for k, v in QUANTS.items() if k != "p95"}
    quants = ST.quantile_columns(rows, group, [f"_{k}" for k in values], wanted, ST.NEAREST)
    quants = quants.select(*group, *[F.col(c).alias(c[1:]) for c in quants.columns if c not in group])
    return ST.attach(base, quants, group)


def run_totals(counts: DataFrame, keys=()) -> DataFrame:
    """Totals of a run from the cell counts of its entries (``outcome_counts``), in one pass."""
    return counts.groupBy(*keys).agg(
        F.count_distinct("candidate_event_id").alias("candidates"),
        F.sum("no_entry").alias("no_entry"),
        F.sum("passed").alias("passed"),
        F.sum("executed_cells").alias("executed"),
        F.sum("incomplete").alias("incomplete"),
        F.sum("ambiguous").alias("ambiguous"),
    )


def cost_cells(priced: DataFrame, keys) -> DataFrame:
    """Net statistics per (cell, statistic, slippage); costs are constant inside a cell."""
    group = [*keys, "statistic", "slippage"]
    x = F.col("net_adverse")
    base = priced.groupBy(*group).agg(
        F.count("*").alias("trades"),
        F.avg(x).alias("mean_net"),
        F.avg("net_favorable").alias("mean_net_favorable"),
        F.avg((x > 0).cast("double")).alias("win_fraction"),
        F.avg((x < 0).cast("double")).alias("loss_fraction"),
        F.avg((x == 0).cast("double")).alias("zero_fraction"),
        ST.profit_factor(x, "inf").alias("profit_factor"),
        F.avg("pips_adverse").alias("mean_gross"),
        F.avg("modeled_cost").alias("mean_cost"),
        F.max(F.col("spread") + F.col("commission")).alias("_fixed"),
    )
    wanted = {k: v for k, v in QUANTS.items() if k != "p95"}
    base = ST.attach(base, ST.quantiles(priced, group, "net_adverse", wanted, ST.NEAREST), group)
    return base.withColumn("headroom", F.col("mean_gross") - F.col("_fixed") - F.col("slippage")).drop("_fixed")


def scenario_cells(trades: DataFrame, keys) -> DataFrame:
    """:func:`cost_cells` with the break-even columns, from trades that carry their scenarios.

    Net results rise with gross ones, so one order of a cell's trades serves the quantiles and kinks of
    all its scenarios; it is taken before scenarios multiply the rows.  ``trades`` lie by some of ``keys``.
    """
    c = F.col
    # Costs are constant inside a cell, hence so is the order of its covered trades.
    own = [*keys, "cost_status"]
    upto, whole = Window.partitionBy(*own).orderBy("pips_adverse"), Window.partitionBy(*own)
    ordered = trades.withColumns(
        {
            "_rank": F.row_number().over(upto),
            "_c": F.count("*").over(upto),  # with its peers
            "_g": F.sum("pips_adverse").over(upto),
            "_n": F.count("*").over(whole),
            "_all": F.sum("pips_adverse").over(whole),
        }
    )
    x, kink = c("net_adverse"), c("pips_adverse") - c("spread")
    low = c("_g") - c("_c") * c("spread")
    high, more = c("_all") - c("_n") * c("spread") - low, c("_n") - c("_c")
    total = 0.993 * (high - more * kink) + 1.007 * (low - c("_c") * kink)
    # The total falls with slippage: trades whose kink is still above the target are those before the zero.
    above = c("converted") & (total > c("commission") * c("_n"))
    wanted = {k: v for k, v in QUANTS.items() if k != "p95"}
    at = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * c("_n"))) == c("_rank")
    cells = CO.scenario_rows(ordered).groupBy(*keys, "statistic", "slippage").agg(
        F.count("*").alias("trades"),
        F.avg(x).alias("mean_net"),
        F.avg("net_favorable").alias("mean_net_favorable"),
        F.avg((x > 0).cast("double")).alias("win_fraction"),
        F.avg((x < 0).cast("double")).alias("loss_fraction"),
        F.avg((x == 0).cast("double")).alias("zero_fraction"),
        ST.profit_factor(x, "inf").alias("profit_factor"),
        F.avg("pips_adverse").alias("mean_gross"),
        F.avg("modeled_cost").alias("mean_cost"),
        F.max(c("spread") + c("commission")).alias("_fixed"),
        *[F.max(F.when(at(p), x)).alias(name) for name, p in wanted.items()],
        F.max("spread").alias("_sp"),
        F.max("commission").alias("_cm"),
        F.max(c("converted").cast("int")).alias("_cv"),
        F.sum(F.when(kink > 0, kink * 0.993).otherwise(kink * 1.007)).alias("_v0"),
        F.sum(kink).alias("_ks"),
        F.count_if(above).alias("_lc"),
        F.sum(F.when(above, kink)).alias("_ls"),
    )
    n, ls = c("trades"), F.coalesce("_ls", F.lit(0.0))
    mean0 = F.when(c("_cv") == 1, c("_v0") / n - c("_cm")).otherwise(c("mean_gross") - c("_sp") - c("_cm"))
    root = F.try_divide(0.993 * (c("_ks") - ls) + 1.007 * ls - c("_cm") * n, 0.993 * (n - c("_lc")) + 1.007 * c("_lc"))
    even = F.when(mean0 <= 0, F.lit(0.0)).when(c("_cv") == 1, root).otherwise(mean0)
    cells = cells.withColumns(
        {
            "headroom": c("mean_gross") - c("_fixed") - c("slippage"),
            "break_even_slippage": F.when(c("statistic").isNotNull(), even),
        }
    )
    extra = F.greatest(F.lit(0.0), c("break_even_slippage") - c("slippage"))
    cells = cells.withColumn("extra_slippage", F.when(c("break_even_slippage").isNotNull(), extra))
    return cells.drop(*[x for x in cells.columns if x.startswith("_")])


def breadth(cells: DataFrame, keys, gross: str = "mean_gross", net: str = "mean_net") -> DataFrame:
    """How many configurations of a regime stay positive."""
    g, n = F.col(gross) > 0, F.col(net) > 0
    return cells.groupBy(*keys).agg(
        F.count("*").alias("cells"),
        F.count_if(n).alias("net_positive"),
        ST.fraction(F.count_if(n), F.count("*")).alias("net_positive_fraction"),
        F.count_if(g).alias("gross_positive"),
        ST.fraction(F.count_if(g & n), F.count_if(g)).alias("surviving_fraction"),
    )


def merged_breadth(parts: DataFrame, keys) -> DataFrame:
    """:func:`breadth` from counts of cells that are positive net, gross and both."""
    total = {x: F.sum(x) for x in ("cells", "net_positive", "gross_positive", "both_positive")}
    return parts.groupBy(*keys).agg(
        total["cells"].alias("cells"),
        total["net_positive"].alias("net_positive"),
        ST.fraction(total["net_positive"], total["cells"]).alias("net_positive_fraction"),
        total["gross_positive"].alias("gross_positive"),
        ST.fraction(total["both_positive"], total["gross_positive"]).alias("surviving_fraction"),
    )


def class_metrics(rows: DataFrame, keys, value: str, width: int, months_in_year: int = 12) -> DataFrame:
    """Event-class metrics with monthly stability and the longest losing streak."""
    x = F.col(value)
    dated = rows.withColumn("_month", F.date_format(F.timestamp_seconds("at"), "yyyy-MM"))
    monthly = dated.groupBy(*keys, "_month").agg(F.avg(x).alias("_mean"))
    stability = monthly.groupBy(*keys).agg(
        F.stddev_samp("_mean").alias("monthly_std"),
        F.count_if(F.col("_mean") > 0).alias("positive_months"),
        F.count("*").alias("total_months"),
        F.min_by("_month", F.struct("_mean", "_month")).alias("worst_month"),
        F.min("_mean").alias("worst_month_mean"),
    )
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        F.count_distinct("candidate_event_id").alias("candidates"),
        F.count_distinct("at").alias("clocks"),
        (F.count("*") / months_in_year).alias("trades_per_month"),
        F.avg(x).alias("expectancy"),
        ST.profit_factor(x).alias("profit_factor"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
    )
    streak = longest_run(rows, keys, ["at", "candidate_event_id"], F.col("at"), width, x < 0, "max_losing_streak")
    return ST.attach(ST.attach(base, stability, keys), streak, keys)


def cell_metrics(rows: DataFrame, keys, value: str, width: int, plain=()) -> DataFrame:
    """Exact-cell metrics over full calendar years: months without trades count as zero.

    Months are kept apart by year; a cell's years are those it trades in.  Rows that lie by the never
    NULL keys ``plain`` are grouped, ordered and joined where they are.
    """
    x = F.col(value)
    year = F.year(F.timestamp_seconds("at"))
    month = F.month(F.timestamp_seconds("at")) + year * 12
    monthly = rows.groupBy(*keys, month.alias("_m")).agg(F.sum(x).alias("_sum"), F.count("*").alias("_n"))
    spine = rows.select(*keys, year.alias("_y")).distinct()
    spine = spine.select(*keys, F.explode(F.sequence(F.col("_y") * 12 + 1, F.col("_y") * 12 + 12)).alias("_m"))
    filled = ST.attach(spine, monthly, [*keys, "_m"], plain=plain).withColumn("_v", F.coalesce("_sum", F.lit(0.0)))
    by_month = filled.groupBy(*keys).agg(
        F.count_if(F.col("_sum") > 0).alias("positive_months"),
        F.count_if(F.col("_sum") < 0).alias("negative_months"),
        F.count_if(F.col("_n").isNull()).alias("no_trade_months"),
        F.min("_v").alias("worst_month"),
        F.max("_v").alias("best_month"),
        F.avg("_v").alias("monthly_mean"),
        F.stddev_pop("_v").alias("monthly_std"),
        F.count("*").alias("_months"),
    )
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        F.count_distinct("candidate_event_id").alias("candidates"),
        F.avg(x).alias("expectancy"),
        F.sum(x).alias("total"),
        ST.profit_factor(x, "inf").alias("profit_factor"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
    )
    streak = longest_run(rows, keys, ["at", "candidate_event_id"], F.col("at"), width, x < 0, "max_losing_streak", plain)
    out = ST.attach(ST.attach(base, by_month, keys, plain=plain), streak, keys, plain=plain)
    # A second distinct count beside the candidates would multiply the rows and shuffle them.
    return out.withColumn("trades_per_month", F.col("trades") / F.col("_months")).drop("_months")


def partial_metrics(rows: DataFrame, keys, value: str) -> DataFrame:
    """Mergeable sums of one variant; combine parts with :func:`merge_metrics`."""
    x = F.col(value)
    zero = F.lit(0.0)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(x).alias("total"),
        F.count_if(x > 0).alias("wins"),
        F.sum(F.when(x > 0, x).otherwise(zero)).alias("gains"),
        F.sum(F.when(x < 0, -x).otherwise(zero)).alias("losses"),
        F.sum("mfe_pips").alias("mfe_total"),
        F.sum("mae_pips").alias("mae_total"),
    )


def merge_metrics(parts: DataFrame, keys) -> DataFrame:
    c = F.col
    sums = parts.groupBy(*keys).agg(
        *[F.sum(x).alias(x) for x in ("n", "total", "wins", "gains", "losses", "mfe_total", "mae_total")]
    )
    factor = F.when(c("losses") > 0, c("gains") / c("losses")).when(c("gains") > 0, F.lit(float("inf"))).otherwise(0.0)
    return sums.select(
        *keys,
        "n",
        (c("total") / c("n")).alias("mean"),
        (c("wins") / c("n")).alias("win_rate"),
        factor.alias("profit_factor"),
        (c("mfe_total") / c("n")).alias("mean_mfe"),
        (c("mae_total") / c("n")).alias("mean_mae"),
    )


def unique_opportunities(rows: DataFrame, keys, order, agree) -> DataFrame:
    """First row per opportunity in a stable order; colliding rows must agree on ``agree``.

    The row is chosen by a mergeable minimum, so a crowded opportunity costs no sort.
    """
    pick = F.min_by(F.struct(*rows.columns), F.struct(*order))
    clash = None
    for name in agree:
        one = ~F.min(F.col(name)).eqNullSafe(F.max(F.col(name)))
        clash = one if clash is None else clash | one
    out = rows.groupBy(*keys).agg(pick.alias("_row"), clash.alias("_clash"))
    fail = F.raise_error(F.lit("colliding opportunities disagree on their path")).cast("boolean")
    return out.where(F.when(F.col("_clash"), fail).otherwise(F.lit(True))).select("_row.*")


def scope_summary(rows: DataFrame, scope, horizons, step_value: str = "pips_h", min_instrument_events: int = 10) -> DataFrame:
    """Stage summary of a scope: counts by period and instrument, concentration, returns."""
    dated = rows.withColumns(
        {
            "_month": F.date_format(F.timestamp_seconds("at"), "yyyy-MM"),
            "_quarter": F.concat(F.year(F.timestamp_seconds("at")), F.lit("-Q"), F.quarter(F.timestamp_seconds("at"))),
        }
    )
    main = f"{step_value}{horizons[-1]}"
    aggs = [F.count("*").alias("events"), F.count_distinct("at").alias("clocks")]
    for h in horizons:
        x = F.col(f"{step_value}{h}")
        aggs += [
            F.count(x).alias(f"n_h{h}"),
            F.avg(x).alias(f"mean_h{h}"),
            F.avg((x > 0).cast("double")).alias(f"win_rate_h{h}"),
            ST.profit_factor(x).alias(f"profit_factor_h{h}"),
        ]
    full = F.col("path_complete")
    aggs += [
        F.count_if(full).alias("complete_paths"),
        F.avg(F.when(full, F.col("mfe_pips"))).alias("mean_mfe_pips"),
        F.avg(F.when(full, F.col("mae_pips"))).alias("mean_mae_pips"),
    ]
    out = dated.groupBy(*scope).agg(*aggs)
    values = [f"{step_value}{h}" for h in horizons]
    quants = ST.quantile_columns(
        dated, scope, values, {"p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90}
    )
    out = ST.attach(out, quants, scope)
    out = ST.attach(out, ST.quantile_columns(dated, scope, ["mfe_pips", "mae_pips"], {"median": 0.5}), scope)
    # Months and quarters are as many as the calendar has; instruments grow with the data, so
    # they are counted and never gathered.
    for key, name in (("_month", "month"), ("_quarter", "quarter")):
        out = ST.attach(out, ST.key_counts(dated, scope, key, f"{name}_counts"), scope)
        out = ST.attach(out, ST.key_means(dated, scope, key, main, f"{name}_expectancy"), scope)
    per = dated.groupBy(*scope, F.col("instrument").alias("_key")).agg(F.count("*").alias("_n"), F.avg(main).alias("_m"))
    spread = per.groupBy(*scope).agg(
        F.max("_n").alias("_top_instrument"),
        F.count("*").alias("instruments"),
        F.count_if(F.col("_n") >= min_instrument_events).alias("adequate_instruments"),
        F.count_if(F.col("_m") > 0).alias("positive_instruments"),
    )
    out = ST.attach(out, spread, scope)
    c = F.col
    return out.withColumns(
        {
            "max_instrument_share": c("_top_instrument") / c("events"),
            "max_quarter_share": c("_top_quarter_counts") / c("events"),
            "active_months": F.size("month_counts"),
            "mfe_to_mae": F.when(c("mae_pips_median") > 0, c("mfe_pips_median") / c("mae_pips_median")),
        }
    ).drop("_top_month_counts", "_top_quarter_counts", "_top_instrument")
