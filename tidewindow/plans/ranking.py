"""Registered queries: quality ranking of exhaustion events and bootstraps of priced trades."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from tidewindow.functions.scalars import policy_key
from tidewindow.operators import costs as CO, models as MO, ranking as RK, resampling as BS, stats as SS
from tidewindow.plans import grid as GR, structure as SR, study as ST
from tidewindow.plans.study import tidy
from tidewindow.sources.staging import stage

START_S = 1704067200  # 2024-01-01 00:00 UTC
FOLD_S = 3 * 86400
FIRST_TEST_FOLD = 5
NUMERIC = (
    "normalized_displacement", "efficiency", "extension_atr", "retained_atr", "upper_wick_atr", "lower_wick_atr",
    "body_atr", "range_atr", "wick_body_ratio", "from_open", "to_close",
)
CATEGORICAL = ("instrument", "side", "session_label")
MAIN = SR.HORIZONS[-1]
REPLICATES = 2000


def _quality(spark, sf):
    rows = SR.exhaustion_observations(spark, sf).where(F.col("threshold") == SR.PRIMARY)
    atr = F.col("atr")
    return (
        rows.where(F.col(f"move_h{MAIN}").isNotNull() & (atr > 0))
        .withColumns({f"{n}_atr": F.col(c) / atr for n, c in (
            ("extension", "extension"), ("retained", "retained"), ("upper_wick", "upper_wick"), ("lower_wick", "lower_wick"),
            ("body", "body"), ("range", "bar_range"))})
        .withColumns(
            {
                "target": F.col(f"move_h{MAIN}") / atr,
                "pips": F.col(f"pips_h{MAIN}"),
                "side": F.when(F.col("direction") > 0, "long").otherwise("short"),
                "fold": (F.floor((F.col("at") - START_S) / FOLD_S) + 1).cast("long"),
                "from_open": F.col("from_open").cast("double"),
                "to_close": F.col("to_close").cast("double"),
            }
        )
        .select("event_id", "instrument", "at", "direction", "side", "session_label", "fold", *NUMERIC, "target", "pips", "mfe_pips", "mae_pips")
    )


def quality_rows(spark, sf):
    return tidy(_quality(spark, sf))


def predictor_quantiles(spark, sf):
    base, _ = RK.describe_predictors(stage(_quality(spark, sf)), NUMERIC, "event_id", "target", "pips")
    return tidy(base)


def predictor_quintiles(spark, sf):
    _, buckets = RK.describe_predictors(stage(_quality(spark, sf)), NUMERIC, "event_id", "target", "pips")
    return tidy(buckets)


def predictor_deciles(spark, sf):
    """Outcome by rank decile of every predictor with at least ten values."""
    base, buckets = RK.describe_predictors(stage(_quality(spark, sf)), NUMERIC, "event_id", "target", "pips", 10)
    enough = base.where(F.col("count") >= 10).select("predictor")
    return tidy(buckets.join(enough, "predictor", "left_semi"))


def category_outcomes(spark, sf):
    rows = _quality(spark, sf)
    items = F.array(*[F.struct(F.lit(c).alias("category"), F.coalesce(F.col(c), F.lit("none")).alias("value")) for c in CATEGORICAL])
    long = stage(rows.select("target", "pips", "mfe_pips", "mae_pips", F.inline(items)))
    return tidy(RK.outcome_summary(long, ["category", "value"], "target", "pips"))


KEEP = ("event_id", "instrument", "direction", "quarter", "session_label", "target", "pips", "mfe_pips", "mae_pips")


def _periods(rows):
    ts = F.timestamp_seconds("at")
    quarter = F.concat(F.year(ts), F.lit("-Q"), F.quarter(ts))
    return rows.withColumns({"quarter": quarter, "session_label": F.coalesce("session_label", F.lit("none"))})


def _scores(spark, sf):
    """Two transparent scores as model families, so that every number can be checked."""
    rows = stage(_quality(spark, sf))
    scores = F.array(
        F.struct(F.lit("displacement").alias("family"), F.col("normalized_displacement").alias("score")),
        F.struct(F.lit("extension").alias("family"), F.round("extension_atr", 1).alias("score")),
    )
    return _periods(rows).select(*KEEP, "fold", F.inline(scores))


def ranking_evaluation(spark, sf):
    return tidy(RK.evaluate(_scores(spark, sf), ["family"], "score", "event_id", "target", "pips"))


def ranking_decision(spark, sf):
    reports = stage(RK.evaluate(_scores(spark, sf), ["family"], "score", "event_id", "target", "pips"))
    return tidy(RK.study_decision(reports, "family", ("displacement", "extension")))


def fold_bootstrap(spark, sf):
    """Top-share means per replicate of whole folds, as 95 % intervals."""
    reps = BS.month_block_bootstrap(
        _scores(spark, sf), ["family"], "fold", "score", "event_id", ["pips", "target"], REPLICATES, 0.2, 20
    )
    rows = stage(reps.withColumn("top_minus_bottom", F.col("top_target") - F.col("bottom_target")))
    return tidy(
        SS.quantile_columns(rows, ["family"], ["top_pips", "top_target", "top_minus_bottom"], {"lo": 0.025, "hi": 0.975})
    )


def walk_forward_models(spark, sf):
    """Huber, quantile and spline families fitted on earlier folds only, then evaluated."""
    rows = stage(_periods(_quality(spark, sf)))
    last = rows.agg(F.max("fold")).first()[0] or 0
    scored = MO.walk_forward(rows, NUMERIC, CATEGORICAL, "target", "fold", range(FIRST_TEST_FOLD, last + 1), KEEP)
    return tidy(RK.evaluate(stage(scored), ["family"], "score", "event_id", "target", "pips"))


# ------------------------------------------------------------------ priced trades
# Distributions run over all paths; the tables that list paths are for looking at and hold the first ones.
PATHS, LISTED, HORIZON, BLOCK, SEED = 50000, 2000, 20, 5, 11


def weekdays(first_year: int, last_year: int) -> list[date]:
    """Monday-Friday days of whole years: the research calendar."""
    day, out = date(first_year, 1, 1), []
    while day.year <= last_year:
        if day.weekday() < 5:
            out.append(day)
        day += timedelta(days=1)
    return out


def _calendar(spark, rows):
    """(days with their index, how many): the weekdays of every year that the rows touch."""
    r = rows.agg(F.min(F.year("day")).alias("a"), F.max(F.year("day")).alias("b")).first()
    days = weekdays(r["a"], r["b"]) if r["a"] else []
    return spark.createDataFrame([(d, i) for i, d in enumerate(days)], "day date, source_day long"), len(days)


def _admitted(spark, sf):
    """Immediate trades of the anchored families, priced at mean spread, with entry-to-stop risk, R
    and whether the bootstrap takes them: ``admission`` is taken, or the reason of the refusal."""
    c = F.col
    events = stage(ST.candidates(spark, sf).where(c("benchmark_family") != "band"))
    modes = ("immediate",)
    # Scope and costs come before the grid: its rows are neither joined nor shuffled.
    events = GR.priced_events(spark, sf, events, (c("statistic") == "mean") & (c("slippage") == 0.1), modes)
    rows = CO.scenario_rows(CO.status_of(ST.placed_trades(spark, sf, events, ["instrument", "at"], modes)))
    entry = c("p0") + c("direction") * c("r_at_entry") * F.abs("d0")
    stop = c("p0") - c("direction") * c("sl") * F.abs("d0")
    rows = rows.withColumns(
        {
            "stop_pips": F.abs(entry - stop) / c("pip"),
            "entry_s": c("at") + c("wait") * ST.STEP,
            "exit_s": c("at") + (c("wait") + c("holding")) * ST.STEP,
            "policy": policy_key("benchmark_family", "lookback", "tp", "sl", "stop"),
            "day": F.to_date(F.timestamp_seconds("at")),
        }
    )
    at_risk = (c("stop_pips") > 0) & (c("direction") * (entry - stop) > 0)
    admission = (
        F.when(c("cost_status") != "covered", "no_cost")
        .when(c("sl").isNull(), "no_stop")
        .when(~F.coalesce(at_risk, F.lit(False)), "no_risk")
        .when(F.weekday("day") >= 5, "weekend")
        .otherwise("taken")
    )
    rows = rows.withColumns({"r": F.try_divide("net_adverse", "stop_pips"), "admission": admission})
    return rows.select(
        "candidate_event_id", "instrument", "benchmark_family", "session", "policy", "day", "entry_s", "exit_s",
        "pips_adverse", "net_adverse", "stop_pips", "r", "admission",
    )


def trade_admission(spark, sf):
    """Trades that the bootstrap takes, and those it refuses, by reason: none leaves uncounted."""
    return tidy(_admitted(spark, sf).groupBy("instrument", "benchmark_family", "admission").agg(F.count("*").alias("trades")))


def _priced_trades(spark, sf):
    """(The trades taken, on their calendar days; the number of calendar days)."""
    rows = stage(_admitted(spark, sf).where("admission = 'taken'").drop("benchmark_family", "admission"))
    calendar, days = _calendar(spark, rows)
    return rows.join(calendar, "day").select(
        "candidate_event_id", "instrument", "session", "policy", "source_day", "entry_s", "exit_s",
        "pips_adverse", "net_adverse", "stop_pips", "r",
    ), days


def priced_trades(spark, sf):
    rows, _ = _priced_trades(spark, sf)
    return tidy(rows)


def bootstrap_picks(spark, sf):
    """Circular day-block picks over the days that hold trades of the given tables."""
    rows, count = _priced_trades(spark, sf)
    days = rows.select("source_day").distinct()
    picks = BS.block_picks(spark, LISTED, HORIZON, BLOCK, count, SEED)
    return tidy(picks.join(days.withColumn("has_trades", F.lit(True)), "source_day", "left").fillna(False, ["has_trades"]))


def rebased_trades(spark, sf):
    """Rebased trade tables of all paths, summarised per path and policy."""
    trades, count = _priced_trades(spark, sf)
    picks = BS.block_picks(spark, LISTED, HORIZON, BLOCK, count, SEED)
    return tidy(BS.rebased_summary(trades, picks, ["policy"], "r"))


def _path_totals(spark, sf):
    trades, count = _priced_trades(spark, sf)
    picks = BS.block_picks(spark, PATHS, HORIZON, BLOCK, count, SEED)
    days = BS.daily_totals(trades, picks, ["policy"], "r")
    return stage(days.groupBy("policy", "path").agg(F.sum("total").alias("total_r"), F.sum("trades").alias("trades")))


def bootstrap_distribution(spark, sf):
    """Distribution of summed R over paths, per policy (nearest rank)."""
    rows = _path_totals(spark, sf)
    base = rows.groupBy("policy").agg(
        F.count("*").alias("paths"), F.avg("total_r").alias("mean_r"), F.avg((F.col("total_r") > 0).cast("double")).alias("positive_share")
    )
    wanted = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    return tidy(SS.attach(base, SS.quantiles(rows, ["policy"], "total_r", wanted, SS.NEAREST), ["policy"]))


def policy_summary(spark, sf):
    """Across policies: quartiles and worst of the policy medians, and the positive share."""
    rows = _path_totals(spark, sf)
    medians = SS.quantiles(rows, ["policy"], "total_r", {"median": 0.5}, SS.NEAREST)
    medians = stage(medians.withColumn("universe", F.lit("ACROSS_POLICIES")))
    base = medians.groupBy("universe").agg(
        F.count("*").alias("policies"), F.min("median").alias("worst"), F.avg((F.col("median") > 0).cast("double")).alias("positive_share")
    )
    q = SS.quantiles(medians, ["universe"], "median", {"p25": 0.25, "mid": 0.5, "p75": 0.75}, SS.NEAREST)
    return tidy(SS.attach(base, q, ["universe"]))


QUERIES = {
    f.__name__: f
    for f in (
        quality_rows, predictor_quantiles, predictor_quintiles, predictor_deciles,
        category_outcomes, ranking_evaluation, ranking_decision,
        fold_bootstrap, walk_forward_models, trade_admission, priced_trades, bootstrap_picks, rebased_trades, bootstrap_distribution,
        policy_summary,
    )
}
