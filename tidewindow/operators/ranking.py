"""Ranking studies: rank buckets, top shares and the evaluation of scores."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewindow.operators import stats as ST
from tidewindow.operators.chunks import ranked, same_keys, value_bin


def split_bucket(rank: Column, n: Column, parts: int) -> Column:
    """Bucket 1..parts of near-equal size; the leading buckets take the remainder."""
    size, extra = F.floor(n / parts), n % parts
    long_part = extra * (size + 1)
    late = extra + F.ceil(F.try_divide(rank - long_part, size))
    return F.when(rank <= long_part, F.ceil(rank / (size + 1))).otherwise(late).cast("long")


def bucketed(df: DataFrame, keys, score: str, tie: str, parts: int, out: str = "bucket") -> DataFrame:
    return ranked(df, keys, score, tie, "_rank").withColumn(out, split_bucket(F.col("_rank"), F.col("n"), parts)).drop("_rank", "n")


def with_top_share(df: DataFrame, keys, score: str, tie: str, shares: dict[str, float]) -> DataFrame:
    """Adds one flag per share: the last ceil(n * share) rows in (score, tie) order."""
    rows = ranked(df, keys, score, tie, "_rank")
    flags = {name: F.col("_rank") > F.col("n") - F.ceil(F.col("n") * F.lit(p)) for name, p in shares.items()}
    return rows.withColumns(flags).drop("_rank", "n")


def average_ranks(df: DataFrame, keys, value: str, out: str) -> DataFrame:
    """Ties share the mean of their ranks.  Works on distinct values, then joins back."""
    keys = list(keys)
    counted = df.groupBy(*keys, F.col(value).alias("_x")).agg(F.count("*").alias("_c")).withColumn("_bin", value_bin(F.col("_x")))
    across = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(across), F.lit(0))
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    values = counted.alias("l").join(bins.alias("r"), same_keys([*keys, "_bin"])).select("l.*", "r._before")
    values = values.withColumn("_hi", F.col("_before") + F.sum("_c").over(inside)).select(
        *keys, "_x", (F.col("_hi") - (F.col("_c") - 1) / 2.0).alias(out)
    )
    cond = same_keys(keys) & (F.col(f"l.{value}") == F.col("r._x")) if keys else F.col(f"l.{value}") == F.col("r._x")
    return df.alias("l").join(values.alias("r"), cond).select("l.*", f"r.{out}")


def spearman(df: DataFrame, keys, left: str, right: str) -> DataFrame:
    rows = average_ranks(average_ranks(df, keys, left, "_rl"), keys, right, "_rr")
    varied = (F.max("_rl") > F.min("_rl")) & (F.max("_rr") > F.min("_rr"))
    return rows.groupBy(*keys).agg(F.when(varied, F.corr("_rl", "_rr")).alias("spearman"))


def outcome_summary(rows: DataFrame, keys, target: str, pips: str) -> DataFrame:
    keys = list(keys)
    x = F.col(pips)
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(target).alias("mean_target"),
        F.avg(x).alias("mean_pips"),
        ST.profit_factor(x).alias("profit_factor"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
        F.avg("mfe_pips").alias("mean_mfe"),
        F.avg("mae_pips").alias("mean_mae"),
    )
    return ST.attach(base, ST.quantile_columns(rows, keys, [target, pips], {"median": 0.5}), keys)


def evaluate(predictions: DataFrame, keys, score: str, tie: str, target: str, pips: str) -> DataFrame:
    """One row per model family: top shares, lifts, rank correlation, quintile order."""
    keys = list(keys)
    rows = with_top_share(predictions, keys, score, tie, {"_t20": 0.20, "_t10": 0.10})
    rows = bucketed(rows, keys, score, tie, 5)
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(target).alias("baseline"),
        F.count_if("_t20").alias("top20_n"),
        F.avg(F.when(F.col("_t20"), F.col(target))).alias("top20_mean"),
        F.avg(F.when(F.col("_t20"), F.col(pips))).alias("top20_pips"),
        ST.profit_factor(F.when(F.col("_t20"), F.col(pips))).alias("top20_profit_factor"),
        F.count_if("_t10").alias("top10_n"),
        F.avg(F.when(F.col("_t10"), F.col(target))).alias("top10_mean"),
        *[F.avg(F.when(F.col("bucket") == q, F.col(target))).alias(f"q{q}") for q in range(1, 6)],
    )
    base = ST.attach(base, spearman(predictions, keys, score, target), keys)
    shares = None
    top = rows.where("_t20")
    for name in ("instrument", "direction", "fold", "quarter", "session_label"):
        counts = top.groupBy(*keys, name).agg(F.count("*").alias("_n"))
        part = counts.groupBy(*keys).agg((F.max("_n") / F.sum("_n")).alias(f"max_{name}_share"))
        shares = part if shares is None else ST.attach(shares, part, keys)
    per = top.groupBy(*keys, "instrument").agg(F.avg(pips).alias("_m"))
    shares = ST.attach(shares, per.groupBy(*keys).agg(F.count_if(F.col("_m") > 0).alias("top20_positive_instruments")), keys)
    shares = ST.attach(shares, ST.quantiles(top, keys, pips, {"top20_median": 0.5}), keys)
    order = sum(
        [F.coalesce((F.col(f"q{i}") <= F.col(f"q{i + 1}")).cast("int"), F.lit(0)) for i in range(1, 5)], F.lit(0)
    )
    return ST.attach(base, shares, keys).withColumns(
        {
            "top20_lift": F.col("top20_mean") - F.col("baseline"),
            "top10_lift": F.col("top10_mean") - F.col("baseline"),
            "top_minus_bottom": F.col("q5") - F.col("q1"),
            "ordered_pairs": order,
        }
    )


def passes(min_n: int = 1000, min_top: int = 200) -> Column:
    """Promotion rule of one family on the columns of :func:`evaluate` (fixed limits)."""
    c = F.col
    rule = (
        (c("n") >= min_n)
        & (c("top20_n") >= min_top)
        & (c("top20_pips") > 0)
        & (c("top20_median") >= 0)
        & (c("top20_profit_factor") >= 1.20)
        & (c("top20_lift") >= 0.05)
        & (c("spearman") >= 0.05)
        & (c("ordered_pairs") >= 3)
        & (c("top20_positive_instruments") >= 3)
        & (c("max_instrument_share") <= 0.40)
        & (c("max_fold_share") <= 0.30)
        & (c("max_quarter_share") <= 0.60)
    )
    return F.coalesce(rule, F.lit(False))


def study_decision(reports: DataFrame, family: str, order, min_n: int = 1000, min_top: int = 200) -> DataFrame:
    """INCONCLUSIVE / PROMOTE / PARK over all families, and the simplest near-best model.

    ``reports`` holds one row per model family, so the preference scan is over a few rows.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(family))
    lift = F.coalesce("top20_lift", F.lit(float("-inf")))
    rho = F.coalesce("spearman", F.lit(float("-inf")))
    rows = reports.withColumns({"_order": rank, "_lift": lift, "_rho": rho, "_pass": passes(min_n, min_top)})
    leader = F.max_by(F.struct("_lift", "_rho", family), F.struct(F.col("_lift"), F.col("_rho"), -F.col("_order")))
    summary = rows.agg(
        leader.alias("_leader"),
        F.count_if("_pass").alias("passing"),
        F.max(((F.col("n") < min_n) | (F.col("top20_n") < min_top)).cast("int")).alias("_thin"),
    )
    near = (F.col("_lift") >= F.col("_leader._lift") - 0.02) & (F.col("_rho") >= F.col("_leader._rho") - 0.01)
    return rows.crossJoin(F.broadcast(summary)).groupBy().agg(
        F.max("passing").alias("passing"),
        F.coalesce(F.min_by(F.when(near, F.col(family)), F.when(near, F.col("_order"))), F.max(F.col(f"_leader.{family}"))).alias("selected"),
        F.when(F.max("_thin") == 1, "INCONCLUSIVE")
        .when(F.max("passing") >= 2, "PROMOTE_TO_FROZEN_CANDIDATE")
        .otherwise("PARK")
        .alias("decision"),
    )


def describe_predictors(rows: DataFrame, predictors, tie: str, target: str, pips: str, parts: int = 5) -> tuple[DataFrame, DataFrame]:
    """(missing rates and quantiles per predictor, outcome by rank bucket per predictor)."""
    items = F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).cast("double").alias("x")) for p in predictors])
    long = rows.select(tie, target, pips, "mfe_pips", "mae_pips", F.inline(items))
    base = long.groupBy("predictor").agg(
        F.count("x").alias("count"),
        (F.count("*") - F.count("x")).alias("missing"),
        ((F.count("*") - F.count("x")) / F.count("*")).alias("missing_rate"),
        F.min("x").alias("p00"),
        F.max("x").alias("p100"),
    )
    wanted = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    base = ST.attach(base, ST.quantiles(long, ["predictor"], "x", wanted), ["predictor"])
    buckets = bucketed(long.where(F.col("x").isNotNull()), ["predictor"], "x", tie, parts)
    return base, outcome_summary(buckets, ["predictor", "bucket"], target, pips)
