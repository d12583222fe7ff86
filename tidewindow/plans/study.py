"""The shared study over the driver's tables: bars -> states -> candidates -> outcomes.

All constants of the study are here.  The base bar (one hour) plays the fine step, two, four and
eight hours are the signal timeframes; minutes of a minute study become steps of one hour.  Look-backs
are short and the candidates' threshold is low because the tables' bars have many gaps: twenty
bars in a row hardly ever occur, and the score of four values cannot pass 1.5.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewindow.operators import eligibility as EL, events as EV, features as FE, observations as OB
from tidewindow.operators import outcomes as OC, paths as PA, resample as RS
from tidewindow.sources import driver as D
from tidewindow.sources.staging import stage

STEP = D.BASE_S
WIDTH = 7 * 86400  # chunk of an ordered series, in seconds
BARS = 168  # chunk of an ordered series, in bars
TIMEFRAMES = {"2h": 7200, "4h": 14400, "8h": 28800}
LOOKBACKS = (4, 8)
THRESHOLDS = (1.0, 1.5, 2.0, 2.5)
THRESHOLD = 0.75
HORIZONS_S = (7200, 14400, 28800, 86400)
SERIES = ("instrument", "timeframe")
STEPS = 24  # path length of the diagnostics
SNAPSHOTS = (1, 2, 4, 8, 24)
PAST = (1, 2, 4)
RECLAIM, EXTENSION = 4, 8
STOPS = (6, 12, 24)
RACE = (2, 4, 8)


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return OB.observe(D.bars(spark, sf))


def research_observations(spark: SparkSession, sf: str) -> DataFrame:
    """All signal timeframes from one pass over the base bars."""
    return OB.observe(RS.resample(D.bars(spark, sf), D.BASE, *TIMEFRAMES))


def staged_observations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Base and research observations, each written once: ticks are scanned a single time."""
    base = stage(observations(spark, sf))
    bars = base.drop("t", "k", "at", "tf_s", "active", "active_sessions")
    return base, stage(OB.observe(RS.resample(bars, D.BASE, *TIMEFRAMES)))


def _state_columns(df: DataFrame, family: str, session, e0: str) -> DataFrame:
    return df.select(
        "instrument",
        F.lit(family).alias("benchmark_family"),
        F.col("timeframe").alias("signal_timeframe"),
        session.alias("session"),
        "lookback",
        "at",
        "active",
        "close",
        F.col(e0).alias("e0"),
        "z",
    )


def with_contexts(rows: DataFrame) -> DataFrame:
    """Each row once overall (NULL) and once per open session: contexts overlap."""
    contexts = F.concat(F.array(F.lit(None).cast("string")), F.col("active_sessions"))
    return rows.withColumn("context", F.explode(contexts))


def states(spark: SparkSession, sf: str) -> DataFrame:
    """All valid states of three families on all signal timeframes."""
    fine, obs = staged_observations(spark, sf)
    valid = F.col("z").isNotNull()
    band = FE.band_features(obs, LOOKBACKS, BARS).where(valid)
    native = FE.vwap_features(obs, LOOKBACKS, BARS).where(valid)
    sampled = FE.fine_vwap_features(fine, obs, LOOKBACKS, BARS).where(valid)
    return (
        _state_columns(with_contexts(band), "band", F.col("context"), "middle")
        .unionByName(_state_columns(native, "vwap", F.col("anchor"), "vwap"))
        .unionByName(_state_columns(sampled, "vwap-fine", F.col("anchor"), "vwap"))
    )


def two_sided_states(spark: SparkSession, sf: str, threshold: float = THRESHOLD) -> DataFrame:
    return EV.two_sided(states(spark, sf), threshold)


def candidates(spark: SparkSession, sf: str, sides: DataFrame | None = None) -> DataFrame:
    """Re-armed events over the whole history, with pip and conversion flag."""
    # The carry reads its input three times (rows, chunk summaries, chunk list): write it once.
    sides = stage(two_sided_states(spark, sf)) if sides is None else sides
    events = EV.rearmed(sides, THRESHOLD, WIDTH)
    return events.withColumns({"pip": D.pip(), "converted": D.converted()}).drop("active", "qualifying", "close")


def frozen_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Every qualifying state at every threshold of the grid (no de-duplication)."""
    rows = states(spark, sf).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))
    side = F.when(F.col("z") < -F.col("threshold"), 1).when(F.col("z") > F.col("threshold"), -1)
    return (
        rows.where(F.col("active"))
        .withColumn("direction", side)
        .where(F.col("direction").isNotNull())
        .withColumns({"p0": F.col("close"), "d0": F.col("close") - F.col("e0"), "pip": D.pip()})
        .drop("active", "close")
    )


def diagnosed(spark: SparkSession, sf: str) -> DataFrame:
    signals = frozen_signals(spark, sf)
    paths = PA.attach_paths(signals, D.bars(spark, sf), "at", STEP, STEPS, max(PAST))
    return PA.path_diagnostics(paths, STEPS, SNAPSHOTS, PAST)


def candidate_paths(spark: SparkSession, sf: str, gate: EL.Gate = EL.accept_all, events: DataFrame | None = None) -> DataFrame:
    """Admitted candidates with the bars they may ever need: waiting time plus the longest stop."""
    events = EL.admitted(candidates(spark, sf) if events is None else events, gate)
    return PA.attach_paths(events, D.bars(spark, sf), "at", STEP, EXTENSION + max(STOPS))


def entries(spark: SparkSession, sf: str, gate: EL.Gate = EL.accept_all, events: DataFrame | None = None, modes=OC.ENTRY_MODES) -> DataFrame:
    return OC.with_entries(candidate_paths(spark, sf, gate, events), RECLAIM, EXTENSION, modes=modes)


def outcomes(spark: SparkSession, sf: str, gate: EL.Gate = EL.accept_all, events: DataFrame | None = None) -> DataFrame:
    return grid(entries(spark, sf, gate, events))


def grid(entered: DataFrame, excursions: bool = True) -> DataFrame:
    return OC.barrier_outcomes(entered, STOPS, excursions=excursions).withColumn("signal_threshold", F.lit(THRESHOLD))


# Keys of every cell that are never NULL, and the entries a task opens into their grid.
PLACE = ("instrument", "benchmark_family", "signal_timeframe", "direction", "lookback", "entry_mode")
PER_TASK = 2000


def placed(rows: DataFrame, keys=PLACE) -> DataFrame:
    """Staged entries dealt by the ``keys`` all cells share, so many a task that their grids stay small.

    Entries cross the network, their grid rows never do: what groups or orders by these keys and more
    finds its rows where they are.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PER_TASK))
    return rows.repartition(tasks, *keys)


def traded(spark: SparkSession, sf: str, events: DataFrame | None = None, modes=OC.ENTRY_MODES) -> DataFrame:
    """Entries with at least one complete trade: what does not ask for exit cells needs no grid."""
    return OC.with_trade(entries(spark, sf, events=events, modes=modes), STOPS)


def placed_trades(spark: SparkSession, sf: str, events: DataFrame, keys, modes=OC.ENTRY_MODES) -> DataFrame:
    """Complete trades of staged events, which are dealt by ``keys`` before their paths become a grid: rows
    that are grouped, ordered or joined by these keys and more stay where they are.  No excursions."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-events.count() * len(modes) // PER_TASK))
    paths = candidate_paths(spark, sf, events=events).repartition(tasks, *keys)
    return grid(OC.with_entries(paths, RECLAIM, EXTENSION, modes=modes), excursions=False).where("complete")


EVENTS_PER_TASK = 4000


def placed_paths(spark: SparkSession, sf: str, events: DataFrame, keys) -> DataFrame:
    """Staged events with their paths, dealt and sorted by the ``keys`` of their cells, for ``cell_grid``."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-events.count() // EVENTS_PER_TASK))
    paths = candidate_paths(spark, sf, events=events)
    kept = [x for x in (*keys, "at", "p0", "d0", "pip", "converted", "cost_status", "scenarios", "path") if x in paths.columns]
    dealt = paths.select(*kept).repartition(tasks, *[k for k in PLACE if k in keys])
    return dealt.sortWithinPartitions(*keys, "at")


def placed_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Only what the reports read: the grid multiplies every column it carries."""
    return grid(placed(stage(entries(spark, sf)))).select(
        "instrument", "benchmark_family", "signal_timeframe", "session", "direction", "lookback", "signal_threshold",
        "filter_family", "filter_spec_id", "entry_mode", "tp", "sl", "stop", "candidate_event_id", "status", "complete", "exit_reason", "ambiguous", "holding", "wait",
        "r_at_entry", "pre_entry_adverse", "pips_adverse", "pips_favorable", "bp_adverse", "mae_pips", "mfe_pips",
    )


def races(spark: SparkSession, sf: str) -> DataFrame:
    return OC.race(candidate_paths(spark, sf), RACE)


def r6(x):
    """Six decimals (three from 1000 on), never a negative zero.

    Two engines may add in different order, and many values here are exact decimal halves:
    a fixed off-grid nudge keeps such ties clear of the rounding edge on both sides.
    """
    x = F.col(x) if isinstance(x, str) else x
    return (
        F.when(F.abs(x) < 1e-6, F.lit(0.0))
        .when(F.abs(x) < 1000, F.round(x + 2.71828e-7, 6))
        .otherwise(F.round(x + 2.71828e-4, 3))
    )


def near6(x):
    """:func:`r6` by binary arithmetic, which no decimal text passes through: for values by the billion."""
    step = lambda nudge, per: F.rint((x + nudge) * per) / per
    size = F.abs(x)
    return F.when(size < 1e-6, F.lit(0.0)).when(size < 1000, step(2.71828e-7, 1e6)).otherwise(step(2.71828e-4, 1e3))


def tidy(df: DataFrame, ints=(), rounded=()) -> DataFrame:
    """Round doubles but those ``rounded`` already, widen integers; the last step of every registered query."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double" and name not in rounded:
            c = r6(c)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)
