"""Comparing event families: membership, overlap, atlas roll-ups and decision rules."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewindow.operators import stats as ST
from tidewindow.operators.chunks import same_keys
from tidewindow.functions.scalars import net_pips
from tidewindow.operators.costs import priced


def clock_flags(candidates: DataFrame, keys, band: str = "band") -> DataFrame:
    """Per clock: does the band family fire, does any anchored family fire."""
    fam = F.col("benchmark_family")
    return candidates.groupBy(*keys).agg(
        F.max((fam == band).cast("int")).alias("has_band"), F.max((fam != band).cast("int")).alias("has_vwap")
    )


def with_event_classes(candidates: DataFrame, band: str = "band") -> DataFrame:
    """One row per class an event belongs to (a band event has two)."""
    clocks = clock_flags(candidates, ["instrument", "at"], band)
    rows = candidates.alias("l").join(clocks.alias("r"), same_keys(["instrument", "at"])).select(
        "l.*", "r.has_band", "r.has_vwap"
    )
    both = (F.col("has_band") == 1) & (F.col("has_vwap") == 1)
    mixed = F.when(both, "intersection")
    classes = F.when(
        F.col("benchmark_family") == band, F.array(F.lit("band-standalone"), mixed.otherwise("band-only"))
    ).otherwise(F.array(mixed.otherwise("vwap-only")))
    return rows.withColumn("event_class", F.explode(classes)).drop("has_band", "has_vwap")


def overlap_table(candidates: DataFrame, band: str = "band") -> DataFrame:
    """Set sizes of the two families, per lookback (strict) and over all (execution)."""
    strict = clock_flags(candidates, ["instrument", "lookback", "at"], band).select(
        "instrument", F.lit("strict-specification").alias("definition"), F.col("lookback").cast("string").alias("lookback"),
        "has_band", "has_vwap",
    )
    execution = clock_flags(candidates, ["instrument", "at"], band).select(
        "instrument", F.lit("execution-level").alias("definition"), F.lit("all").alias("lookback"), "has_band", "has_vwap"
    )
    b, v = F.col("has_band"), F.col("has_vwap")
    return strict.unionByName(execution).groupBy("instrument", "definition", "lookback").agg(
        F.sum(b).alias("band_clocks"),
        F.sum(v).alias("vwap_clocks"),
        F.sum(b * v).alias("both_clocks"),
        F.sum(b * (1 - v)).alias("band_only_clocks"),
        F.try_divide(F.sum(b * (1 - v)), F.sum(b)).alias("band_only_rate"),
        F.try_divide(F.sum(b * v), F.sum(b)).alias("band_overlap_rate"),
        F.try_divide(F.sum(b * v), F.sum(v)).alias("vwap_overlap_rate"),
        F.count("*").alias("union_clocks"),
    )


def paired_events(events: DataFrame, keys, band: str = "band") -> DataFrame:
    """Events of clocks (``keys``) at which both the band and an anchored family fire."""
    clocks = clock_flags(events, keys, band).where("has_band = 1 and has_vwap = 1")
    return events.alias("l").join(clocks.alias("r"), same_keys(keys), "left_semi")


def paired_correlation(trades: DataFrame, keys, at: str, value: str, band: str = "band") -> DataFrame:
    """Pearson correlation of the band outcome with each anchored family at the same clock.

    A window pairs them, so trades that lie by some of ``keys`` are paired and merged where they are; a join
    would be sized by the events a grid comes from, and broadcast.
    """
    clock = Window.partitionBy(*keys, at)
    banded = F.collect_list(F.when(F.col("benchmark_family") == band, F.struct(F.col(value).alias("_x")))).over(clock)
    rows = trades.select(*keys, at, F.col("benchmark_family").alias("vwap_family"), F.col(value).alias("_y"), banded.alias("_b"))
    pairs = rows.where(F.col("vwap_family") != band).select(*keys, "vwap_family", "_y", F.inline("_b"))
    varied = (F.max("_x") > F.min("_x")) & (F.max("_y") > F.min("_y"))
    # ``corr`` divides before any condition on it holds, and fails where one side is constant.
    correlation = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))
    return pairs.groupBy(*keys, "vwap_family").agg(
        F.count("*").alias("pairs"), F.when(varied, correlation).alias("correlation")
    )


def headline_values(trades: DataFrame, costs: DataFrame, headline) -> DataFrame:
    """One row per (trade, scenario): gross, and net under each headline cost pair."""
    gross = trades.select("*", F.lit("gross").alias("scenario"), F.col("pips_adverse").alias("value"))
    chosen = F.lit(False)
    for statistic, slippage in headline:
        chosen = chosen | ((F.col("statistic") == statistic) & (F.col("slippage") == slippage))
    net = priced(trades, costs.where(chosen)).select(
        *trades.columns, F.concat_ws("+", "statistic", F.format_string("%.2f", "slippage")).alias("scenario"),
        F.col("net_adverse").alias("value"),
    )
    return gross.unionByName(net)


def placed_headline_values(trades: DataFrame, headline) -> DataFrame:
    """:func:`headline_values` from trades that carry their cost scenarios: no join, no shuffle."""
    chosen = lambda s: reduce(
        lambda a, b: a | b, [(s["statistic"] == statistic) & (s["slippage"] == slippage) for statistic, slippage in headline]
    )
    c, kept = F.col, [x for x in trades.columns if x not in ("scenarios", "cost_status")]
    net = F.transform(
        F.filter("scenarios", chosen),
        lambda s: F.struct(
            F.concat_ws("+", s["statistic"], F.format_string("%.2f", s["slippage"])).alias("scenario"),
            net_pips(c("pips_adverse"), s["spread"], s["slippage"], s["commission"], c("converted")).alias("value"),
        ),
    )
    # A blocked or refused trade comes once without a scenario.
    blocked = F.array(F.struct(F.concat_ws("+", F.lit(None).cast("string"), F.format_string("%.2f", F.lit(None).cast("double"))).alias("scenario"), F.lit(None).cast("double").alias("value")))
    gross = F.array(F.struct(F.lit("gross").alias("scenario"), c("pips_adverse").alias("value")))
    return trades.select(*kept, F.inline(F.concat(gross, F.coalesce(net, blocked))))


def with_headline(events: DataFrame, headline) -> DataFrame:
    """Adds each headline scenario as a column ``headline_<i>``, found once an event and not once a grid row."""
    one = lambda statistic, slippage: F.get(
        F.filter("scenarios", lambda s: (s["statistic"] == statistic) & (s["slippage"] == slippage)), F.lit(0)
    )
    return events.withColumns({f"headline_{i}": one(*pair) for i, pair in enumerate(headline)})


def scenario_names(headline) -> list[Column]:
    """Gross, the headline scenarios, and what trades without a scenario come under."""
    none = F.concat_ws("+", F.lit(None).cast("string"), F.format_string("%.2f", F.lit(None).cast("double")))
    return [F.lit("gross"), *[F.lit(f"{statistic}+{slippage:.2f}") for statistic, slippage in headline], none]


def headline_cells(trades: DataFrame, keys, headline) -> DataFrame:
    """One row per cell with an array of (scenario, trades, expectancy): gross, the headline scenarios and, where
    trades are blocked or refused, one without a name.  Scenarios are summed side by side, rows are not multiplied."""
    c, covered = F.col, F.col("cost_status") == "covered"
    aggs, items = [], []
    parts = [(F.lit(True), c("pips_adverse"))]
    for i in range(len(headline)):
        s = c(f"headline_{i}")
        net = net_pips(c("pips_adverse"), s["spread"], s["slippage"], s["commission"], c("converted"))
        parts.append((covered & s.isNotNull(), net))
    parts.append((~covered, F.lit(None).cast("double")))
    for i, (name, (there, value)) in enumerate(zip(scenario_names(headline), parts, strict=True)):
        aggs += [F.count_if(there).alias(f"_n{i}"), F.avg(F.when(there, value)).alias(f"_e{i}")]
        items.append(F.struct(name.alias("scenario"), c(f"_n{i}").alias("trades"), c(f"_e{i}").alias("expectancy")))
    return trades.groupBy(*keys).agg(*aggs).select(*keys, F.array(*items).alias("cells"))


def expectancies(cells: DataFrame, keys) -> DataFrame:
    """The rows (keys, scenario, expectancy) of :func:`headline_cells`."""
    return cells.select(*keys, F.inline("cells")).where("trades > 0").drop("trades")


def _side_by_side(cells: DataFrame, keys, headline, aggregates) -> DataFrame:
    """``aggregates(there, expectancy)`` of every scenario of :func:`headline_cells`, one row per (keys, scenario)
    that has trades: cells are merged before scenarios become rows."""
    items = []
    for i, name in enumerate(scenario_names(headline)):
        cell = F.col("cells")[i]
        there = cell["trades"] > 0
        parts = aggregates(there, F.when(there, cell["expectancy"]))
        items.append(F.struct(name.alias("scenario"), F.count_if(there).alias("_cells"), *parts))
    rows = cells.groupBy(*keys).agg(F.array(*items).alias("_s"))
    return rows.select(*keys, F.inline("_s")).where("_cells > 0").drop("_cells")


def setup_families(cells: DataFrame, trades: DataFrame, setup, execution, headline) -> DataFrame:
    """Plateau evidence of a setup over its exit cells, per cost scenario; ``trades`` are its entries with a trade.

    A setup has no more cells than the exit grid, so a percentile of theirs holds few values."""
    counts = trades.groupBy(*setup).agg(
        F.count_distinct("candidate_event_id").alias("candidates"), F.count_distinct(*execution).alias("opportunities")
    )
    plateau = lambda there, x: [
        F.count_if(there).alias("exit_cells"),
        F.count_if(x > 0).alias("positive_cells"),
        ST.fraction(F.count_if(x > 0), F.count_if(there)).alias("positive_fraction"),
        F.min(x).alias("min_expectancy"),
        F.max(x).alias("max_expectancy"),
        F.percentile(F.when(~F.isnan(x), x), F.lit(0.5)).alias("median_expectancy"),
    ]
    return ST.attach(_side_by_side(cells, setup, headline, plateau), counts, setup)


def execution_families(trades: DataFrame, family, execution, setup) -> DataFrame:
    """Distinct executions of a family and which variants fired (sorted, pipe-joined)."""
    join = lambda c: F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), "|")
    return trades.groupBy(*family).agg(
        F.count_distinct(*execution).alias("opportunities"),
        F.count_distinct(*[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in setup]).alias("memberships"),
        join("benchmark_family").alias("variants"),
        join("lookback").alias("lookbacks"),
    )


def clock_sets(candidates: DataFrame, left: str, right: str) -> DataFrame:
    """(instrument, set, clocks) of two families' clocks: one shuffle, no set is built."""
    flag = lambda f: F.max((F.col("benchmark_family") == f).cast("int"))
    clocks = candidates.where(F.col("benchmark_family").isin(left, right)).groupBy("instrument", "at").agg(
        flag(left).alias("_l"), flag(right).alias("_r")
    )
    a, b = F.col("_l") == 1, F.col("_r") == 1
    parts = {left: a, right: b, "union": a | b, "both": a & b, f"{left}_only": a & ~b, f"{right}_only": b & ~a}
    sums = clocks.groupBy("instrument").agg(*[F.count_if(x).alias(n) for n, x in parts.items()])
    items = F.array(*[F.struct(F.lit(n).alias("set"), F.col(n).alias("clocks")) for n in parts])
    return sums.select("instrument", F.inline(items)).where("clocks > 0")


def hypotheses(cells: DataFrame, keys, headline) -> DataFrame:
    """A hypothesis across instruments: how many tested, how many positive.  ``cells`` (:func:`headline_cells`)
    has one row per instrument and ``keys``."""
    return _side_by_side(cells, keys, headline, lambda there, x: [
        F.count_if(there).alias("instruments_tested"), F.count_if(x > 0).alias("instruments_positive"),
    ])


def with_hypothesis_id(rows: DataFrame, keys, hypotheses: DataFrame) -> DataFrame:
    """``rows`` with the stable id of their hypothesis."""
    # The number of hypotheses is the size of the parameter grid, so one ordered numbering is safe.
    ids = hypotheses.select(*keys).distinct().withColumn(
        "hypothesis_id",
        F.format_string("H%04d", F.row_number().over(Window.orderBy(*[F.col(k).asc_nulls_first() for k in keys]))),
    )
    return ST.attach(rows, ids, keys)


def role_overlap(trades: DataFrame, setup, execution, reference: DataFrame) -> DataFrame:
    """Distinct executions of each setup that a reference set of executions also has."""
    ref = reference.select(*execution).distinct().withColumn("_hit", F.lit(1))
    total = ref.agg(F.count("*").alias("_total"))
    rows = trades.select(*setup, *execution).distinct()
    marked = rows.alias("l").join(ref.alias("r"), same_keys(execution), "left").select("l.*", "r._hit")
    per = marked.groupBy(*setup).agg(F.count("*").alias("opportunities"), F.count("_hit").alias("intersection"))
    return (
        per.crossJoin(F.broadcast(total))
        .withColumns(
            {
                "overlap_rate": F.col("intersection") / F.col("opportunities"),
                "unique_to_setup": F.col("opportunities") - F.col("intersection"),
                "reference_only": F.col("_total") - F.col("intersection"),
            }
        )
        .drop("_total")
    )


def overlap_windows(events: DataFrame, keys, windows_s, gap: str = "nearest_s") -> DataFrame:
    """Counts and rates of events with a reference clock within each window."""
    hits = {f"w{w}": F.count_if(F.col(gap) <= w) for w in windows_s}
    aggs = [F.count("*").alias("events")]
    for name, hit in hits.items():
        aggs += [
            hit.alias(f"overlap_{name}"),
            F.try_divide(hit, F.count("*")).alias(f"overlap_rate_{name}"),
            (F.count("*") - hit).alias(f"unique_{name}"),
        ]
    return events.groupBy(*keys).agg(*aggs)


# Fixed values of the study decisions.
MIN_EVENTS, MIN_INSTRUMENT_EVENTS, MIN_INSTRUMENTS = 100, 20, 2
MAX_INSTRUMENT_SHARE, MAX_QUARTER_SHARE = 0.60, 0.50


def stage_decision(rows: DataFrame, horizon: int, robust: Column) -> DataFrame:
    """PASS / KILL / INCONCLUSIVE from a summary row.

    ``robust`` is the study's own last condition: every depth positive, or a plateau of thresholds.
    The summary counts as adequate the instruments with MIN_INSTRUMENT_EVENTS events.
    """
    c = F.col
    big, good = c("adequate_instruments"), c("positive_instruments")
    adequate = (c("events") >= MIN_EVENTS) & (c(f"n_h{horizon}") >= MIN_EVENTS)
    evidence = (
        adequate
        & (big >= MIN_INSTRUMENTS)
        & (good >= MIN_INSTRUMENTS)
        & (c(f"mean_h{horizon}") > 0)
        & (c(f"pips_h{horizon}_median") >= 0)
        & (c("max_instrument_share") <= MAX_INSTRUMENT_SHARE)
        & (c("max_quarter_share") <= MAX_QUARTER_SHARE)
        & robust
    )
    return rows.withColumn(
        "decision",
        F.when(F.coalesce(evidence, F.lit(False)), "PASS").when(adequate, "KILL").otherwise("INCONCLUSIVE"),
    )


def plateau_ok(rows: DataFrame, threshold: str, primary: float, mean: str) -> DataFrame:
    """One row: primary mean positive and every neighbour at least half of it."""
    p = F.max(F.when(F.col(threshold) == primary, F.col(mean)))
    weakest = F.min(F.when(F.col(threshold) != primary, F.coalesce(F.col(mean), F.lit(float("-inf")))))
    return rows.agg(p.alias("primary_mean"), weakest.alias("weakest_neighbour")).withColumn(
        "plateau",
        F.coalesce(
            (F.col("primary_mean") > 0) & (F.col("weakest_neighbour") >= 0.5 * F.col("primary_mean")), F.lit(False)
        ),
    )


def independence(rows: DataFrame, unique_rate: Column, adequate: Column, passed: Column) -> DataFrame:
    label = (
        F.when(unique_rate.isNull() | ~adequate, "INSUFFICIENT EVIDENCE")
        .when((unique_rate >= 0.5) & passed, "INDEPENDENT CANDIDATE")
        .when(unique_rate >= 0.5, "PARTIALLY ORTHOGONAL")
        .otherwise("LIKELY REFERENCE FILTER/TIMING LAYER")
    )
    return rows.withColumn("independence", label)
