"""Cases that once lost, clipped or miscounted rows."""

import datetime as dt
import lzma
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewindow.operators import chunks as CH, costs as CO, families as FA, joins as JO, quality as Q, ranking as RK, resampling as BS, summaries as SU
from tidewindow.plans import grid as GR, ranking as PR
from tidewindow.schema import BAR
from tidewindow.sources import dayfiles as DF, files as FI
from tidewindow.sources.staging import stage

T0 = dt.datetime(2024, 3, 4, tzinfo=dt.timezone.utc)


def long_bar(start, length, step=60):
    opened = T0 + dt.timedelta(seconds=step * start)
    closed = opened + dt.timedelta(seconds=step * length)
    return ("X", "1m", opened, closed, closed, 1.0, 1.0, 1.0, 1.0, "bid", 1.0, "tick")


def test_overlaps_are_found_wherever_a_chunk_starts(spark):
    for shift in range(0, 130, 9):
        rows = [long_bar(shift, 70)] + [long_bar(shift + i, 1) for i in (60, 69, 70, 90)]
        assert Q.dataset_report(spark.createDataFrame(rows, BAR), 60).first().overlaps == 2


def test_trades_without_a_cost_are_blocked_not_lost(spark):
    trades = spark.createDataFrame(
        [("A", "london", 5.0, 5.0, False), ("B", "asia", 4.0, 4.0, False), ("B", None, 3.0, 3.0, False)],
        "instrument string, session string, pips_adverse double, pips_favorable double, converted boolean",
    )
    costs = spark.createDataFrame(
        [("A", "london", "mean", 0.0, 1.0, 0.5), ("A", "london", "p90", 0.25, 2.0, 0.5), ("B", "overall", "mean", 0.0, 1.0, 0.5)],
        "instrument string, session string, statistic string, slippage double, spread double, commission double",
    )
    got = sorted((r.instrument, r.cost_status, r.statistic, r.net_adverse) for r in CO.priced(trades, costs).where("instrument = 'A'").collect())
    assert got == [("A", "covered", "mean", 3.5), ("A", "covered", "p90", 2.25)]
    blocked = CO.priced(trades, costs).where("instrument = 'B'").collect()
    assert len(blocked) == 2 and all(r.cost_status == "blocked" and r.statistic is None and r.net_adverse is None for r in blocked)


def test_fixed_cost_values_and_keys():
    assert CO.SLIPPAGES == (0.0, 0.1, 0.25, 0.5) and dict(CO.HEADLINE)["p90"] == 0.25
    assert len(GR.CONFIG) == 13 and {"session", "lookback", "signal_threshold"} <= set(GR.CONFIG)


def test_research_calendar():
    days = PR.weekdays(2024, 2024)
    assert len(days) == 262 and days[0] == dt.date(2024, 1, 1) and days[-1] == dt.date(2024, 12, 31)


def test_empty_day_files_are_quarantined(spark, tmp_path):
    folder = tmp_path / "X"
    folder.mkdir()
    (folder / "2024-01-02.bi5").write_bytes(b"")
    (folder / "2024-01-03.bi5").write_bytes(lzma.compress(b""))
    (folder / "2024-01-04.bi5").write_bytes(lzma.compress(struct.pack(">5if", 60, 10, 11, 9, 12, 2.0)))
    files = DF.day_files(spark, f"{tmp_path}/*/*.bi5")
    # Spark's file sources leave out files of no bytes; the manifest shows them, and other tables may hold them.
    manifest = spark.createDataFrame([("X", dt.date(2024, 1, d), "?") for d in (2, 3, 4)], "instrument string, day date, sha256 string")
    assert DF.declared_days(files, manifest)[1].count() == 3
    empty = files.limit(1).select("path", "instrument", F.lit("2024-01-02").cast("date").alias("day"), F.lit(b"").alias("content"), "sha256")
    bars, bad = DF.decode_days(files.unionByName(empty.withColumn("path", F.lit("other"))), F.lit(10.0))
    assert sorted((str(r.day), r.fault) for r in bad.collect()) == [("2024-01-02", "empty_file"), ("2024-01-03", "empty_file")]
    assert bars.count() == 1


def test_declared_and_repeated_days(spark):
    files = spark.createDataFrame([("p1", "A", "d1", "h1"), ("p2", "A", "d2", "hX"), ("p3", "A", "d2", "h2")], "path string, instrument string, day string, sha256 string")
    manifest = spark.createDataFrame([("A", "d1", "h1"), ("A", "d2", "other"), ("A", "d3", "h3")], "instrument string, day string, sha256 string")
    matched, lacking = DF.declared_days(files, manifest)
    assert [r.path for r in matched.collect()] == ["p1"] and sorted(r.day for r in lacking.collect()) == ["d2", "d3"]
    assert [(r.day, r.files) for r in DF.mixed_or_repeated_days(files).collect()] == [("d2", 2)]


def test_trade_contract(spark):
    nan = float("nan")
    rows = [("A", "1", True, 1.0, 2.0), ("Z", "2", True, 1.0, 1.0), ("A", None, True, 1.0, 1.0), ("A", "3", None, 1.0, 1.0), ("A", "4", True, nan, 1.0)]
    df = spark.createDataFrame(rows, "instrument string, candidate_event_id string, complete boolean, pips_adverse double, pips_favorable double")
    got = [r.verdict for r in Q.check_trades(df, F.col("instrument") == "A").collect()]
    assert got == ["valid", "unexpected_instrument", "missing_identity", "incomplete", "not_finite"]
    assert [r.candidate_event_id for r in Q.other_instrument(df, "A").collect()] == ["2"]


def test_ranks_split_a_value_that_most_rows_share(spark):
    rows = spark.range(20_000).select(
        F.lit("g").alias("g"), F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(F.lit(5.0)).alias("v"),
        F.concat(F.lit("event-"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12)).alias("tie"),
    )
    out = stage(CH.ranked(rows, ["g"], "v", "tie"))
    want = sorted((r.v, r.tie) for r in rows.collect())
    assert [(r.v, r.tie) for r in out.orderBy("rank").collect()] == want and out.agg(F.max("n")).first()[0] == 20_000
    placed = rows.withColumn("_part", CH.tie_part(rows, "tie"))
    assert placed.groupBy("v", "_part").count().agg(F.max("count")).first()[0] < 20_000 / 50


def test_months_of_two_years_stay_apart(spark):
    at = [int(dt.datetime(y, 1, 5, tzinfo=dt.timezone.utc).timestamp()) for y in (2023, 2024)]
    df = spark.createDataFrame([("k", at[0], "a", 1.0), ("k", at[1], "b", -3.0)], "k string, at long, candidate_event_id string, v double")
    r = SU.cell_metrics(df, ["k"], "v", 86400).first()
    assert (r.positive_months, r.negative_months, r.no_trade_months, r.trades_per_month) == (1, 1, 22, 2 / 24)


def test_clock_sets_match_set_operations(spark):
    rows = [("A", f, t) for f, ts in (("band", (1, 2, 3)), ("vwap", (2, 3, 4, 5)), ("other", (9,))) for t in ts] + [("B", "band", 1)]
    df = spark.createDataFrame(rows, "instrument string, benchmark_family string, at long")
    got = {(r.instrument, r["set"]): r.clocks for r in FA.clock_sets(df, "band", "vwap").collect()}
    assert got == {("A", "band"): 3, ("A", "vwap"): 4, ("A", "union"): 5, ("A", "both"): 2, ("A", "band_only"): 1, ("A", "vwap_only"): 2,
                   ("B", "band"): 1, ("B", "union"): 1, ("B", "band_only"): 1}


def test_rebased_summary_matches_the_expansion(spark):
    trades = spark.createDataFrame([("p", d, d * 86400 + i, d * 86400 + i + 50, float(i)) for d in range(4) for i in range(3)],
                                   "policy string, source_day long, entry_s long, exit_s long, r double")
    picks = BS.block_picks(spark, 30, 6, 3, 7, 2)
    wide = BS.rebased_trades(trades, picks).groupBy("path", "policy").agg(
        F.count("*").alias("trades"), F.sum("r").alias("total_r"), F.min("entry_s").alias("first_s"), F.max("exit_s").alias("last_s")
    )
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, BS.rebased_summary(trades, picks, ["policy"], "r").collect()))


def test_block_bootstrap_matches_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [("f", int(b), round(float(rng.normal()), 1), f"e{i:03d}", float(rng.normal())) for i, b in enumerate(rng.integers(0, 5, 200))]
    df = spark.createDataFrame(rows, "k string, block long, score double, tie string, v double")
    got = {r.replicate: (r.top_v, r.bottom_v) for r in BS.month_block_bootstrap(df, ["k"], "block", "score", "tie", ["v"], 25, 0.2, 20).collect()}

    def draw(rep, slot, n):
        mixed = (20 + rep * 7919 + slot * 104729) * 2654435761 % 4294967296
        return (mixed // 65536 + mixed % 65536 * 65536) % n

    blocks = sorted({r[1] for r in rows})
    for rep in range(25):
        taken = [r for s in range(len(blocks)) for r in rows if r[1] == blocks[draw(rep, s, len(blocks))]]
        taken.sort(key=lambda r: (r[2], r[3]))
        cut = int(np.ceil(len(taken) * 0.2))
        want = np.mean([r[4] for r in taken[-cut:]]), np.mean([r[4] for r in taken[:cut]])
        np.testing.assert_allclose(got[rep], want, rtol=1e-9)


SUMMARY = dict(
    events=100, n_h4=100, adequate_instruments=2, positive_instruments=2, mean_h4=0.1, pips_h4_median=0.0, max_instrument_share=0.6,
    max_quarter_share=0.5, robust=True,
)


@pytest.mark.parametrize(
    "change, decision",
    [
        ({}, "PASS"), ({"events": 99}, "INCONCLUSIVE"), ({"n_h4": 99}, "INCONCLUSIVE"), ({"adequate_instruments": 1}, "KILL"),
        ({"positive_instruments": 1}, "KILL"), ({"mean_h4": 0.0}, "KILL"), ({"mean_h4": None}, "KILL"), ({"pips_h4_median": -0.1}, "KILL"),
        ({"pips_h4_median": None}, "KILL"), ({"max_instrument_share": 0.61}, "KILL"), ({"max_quarter_share": 0.51}, "KILL"),
        ({"robust": False}, "KILL"), ({"robust": None}, "KILL"),
    ],
)
def test_each_condition_of_a_study_decision(spark, change, decision):
    row = SUMMARY | change
    schema = "events long, n_h4 long, adequate_instruments long, positive_instruments long, mean_h4 double, pips_h4_median double, max_instrument_share double, max_quarter_share double, robust boolean"
    rows = spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)
    assert FA.stage_decision(rows, 4, F.col("robust")).first()["decision"] == decision


REPORT = dict(
    n=1000, top20_n=200, top20_pips=0.1, top20_median=0.0, top20_profit_factor=1.2, top20_lift=0.05, spearman=0.05, ordered_pairs=3,
    top20_positive_instruments=3, max_instrument_share=0.4, max_fold_share=0.3, max_quarter_share=0.6,
)
BREAKS = dict(
    n=999, top20_n=199, top20_pips=0.0, top20_median=-0.1, top20_profit_factor=1.19, top20_lift=0.049, spearman=None, ordered_pairs=2,
    top20_positive_instruments=2, max_instrument_share=0.41, max_fold_share=0.31, max_quarter_share=0.61,
)


def test_each_condition_of_a_promotion(spark):
    rows = [dict(REPORT, family="all")] + [dict(REPORT, family=k) | {k: v} for k, v in BREAKS.items()]
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in REPORT.items()) + ", family string"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    assert [r.family for r in df.where(RK.passes()).collect()] == ["all"]


def test_guarded_join_of_none_one_and_two_partners(spark):
    facts = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 6.0), ("b", None, 7.0)], "id string, k int, x double")
    partner = lambda *rows: spark.createDataFrame(rows, "id string, k int, at long")
    whole = partner(("a", 1, 10), ("b", None, 20), ("c", 3, 30))
    rows = JO.guarded_join(facts, whole, ["id", "k"])
    assert rows.columns == ["id", "k", "x", "at"]
    assert sorted(tuple(r) for r in rows.collect()) == [("a", 1, 5.0, 10), ("a", 1, 6.0, 10), ("b", None, 7.0, 20)]
    for held, unique, message in (
        (partner(("a", 1, 10)), False, "no partner"),
        (whole.union(partner(("a", 1, 11))), False, "more than one partner"),
        (whole, True, "a fact twice"),
    ):
        with pytest.raises(Exception, match=message):
            JO.guarded_join(facts, held, ["id", "k"], unique).count()
