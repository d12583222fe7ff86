"""Eligibility before entry, and run totals folded inside a row."""

import random

import pytest
from pyspark.sql import functions as F

from tidewindow.operators import eligibility as EL, outcomes as OC, summaries as SU

EVENTS = "candidate_event_id string, direction int, p0 double, d0 double, at long, instrument string"
PATH = "array<struct<m:int, high:double, low:double, close:double>>"


def _events(spark):
    return spark.createDataFrame([("a", 1, 10.0, -2.0, 0, "x"), ("b", -1, 10.0, 2.0, 60, "x"), ("c", 1, 9.0, -1.0, 60, "y")], EVENTS)


def _reject(name, cond):
    def gate(events):
        kept = F.coalesce(cond, F.lit(False))
        return EL.accept_all(events).withColumns({"eligible": kept, "filter_family": F.lit(name), "filter_spec_id": F.lit(f"{name}-v1")})

    return gate


def test_default_gate_changes_nothing(spark):
    events = _events(spark)
    out = EL.admitted(events)
    assert sorted(out.select(events.columns).collect()) == sorted(events.collect())
    assert {tuple(r) for r in out.select("filter_family", "filter_spec_id").collect()} == {("none", "none-v1")}


def test_rejected_events_keep_their_decision_and_meet_no_bar(spark):
    gate = _reject("future", F.col("direction") == 1)
    decided = {r.candidate_event_id: (r.eligible, r.filter_spec_id) for r in EL.decide(_events(spark), gate).collect()}
    assert decided == {"a": (True, "future-v1"), "b": (False, "future-v1"), "c": (True, "future-v1")}
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def spy(at):
        seen.add(1)
        return at

    bars = spark.createDataFrame(
        [("x", i * 60, 11.0, 9.0, 10.0) for i in range(5)], "instrument string, at long, high double, low double, close double"
    )
    events = EL.admitted(_events(spark), gate).withColumn("at", spy("at"))
    joined = events.join(bars, ["instrument", "at"], "left").select("candidate_event_id", "at", "close").collect()
    assert {tuple(r) for r in joined} == {("a", 0, 10.0), ("c", 60, None)} and seen.value == 2
    assert EL.admitted(_events(spark), _reject("none-left", F.lit(False))).count() == 0


def test_a_gate_that_breaks_its_contract_is_refused(spark):
    with pytest.raises(ValueError, match="lost \\['p0'\\]"):
        EL.decide(_events(spark), lambda e: EL.accept_all(e).drop("p0"))
    with pytest.raises(ValueError, match="eligible string"):
        EL.decide(_events(spark), lambda e: EL.accept_all(e).withColumn("eligible", F.lit("yes")))
    with pytest.raises(Exception, match="decision is NULL"):
        EL.decide(_events(spark), lambda e: EL.accept_all(e).withColumn("eligible", F.lit(None).cast("boolean"))).collect()


def test_all_gates_label_by_the_first_that_rejects(spark):
    gate = EL.all_gates(_reject("long", F.col("direction") == 1), _reject("x", F.col("instrument") == "x"))
    got = {r.candidate_event_id: (r.eligible, r.filter_family) for r in EL.decide(_events(spark), gate).collect()}
    assert got == {"a": (True, "x"), "b": (False, "long"), "c": (False, "x")}


def test_run_totals_equal_the_cells(spark):
    """Folded counts against the cells themselves, on random paths with gaps and no entries."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        d = rng.choice((1, -1))
        path = []
        for m in range(1, 33):
            if rng.random() < 0.2:
                continue
            close = 10 + rng.uniform(-2, 2)
            path.append((m, close + rng.random(), close - rng.random(), close))
        rows.append((f"c{i}", d, 10.0, -2.0 * d, 0, f"i{i % 3}", 0.01, path))
    rows.append(("empty", 1, 10.0, -2.0, 0, "i0", 0.01, []))
    paths = spark.createDataFrame(rows, f"{EVENTS}, pip double, path {PATH}")
    entries = OC.with_entries(paths, 4, 8)
    got = {tuple(r) for r in SU.run_totals(OC.outcome_counts(entries, (6, 12, 24)), ["instrument"]).collect()}
    cells = OC.barrier_outcomes(entries, (6, 12, 24)).collect()
    want = set()
    for name in ("i0", "i1", "i2"):
        own = [r for r in cells if r.instrument == name]
        count = lambda f: sum(1 for r in own if f(r))
        want.add((
            name, len({r.candidate_event_id for r in own}), count(lambda r: r.status == "no_entry"), count(lambda r: r.status == "passed"),
            count(lambda r: r.status == "executed"), count(lambda r: r.status == "executed" and not r.complete), count(lambda r: r.ambiguous),
        ))
    assert got == want and all(v for row in want for v in row[1:])
