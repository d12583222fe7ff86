"""F26 barrier_outcomes: values are worked out once per barrier, paths are walked as arrays, rounding stays what it was."""

import random

from pyspark.sql import functions as F

from tidewindow.operators import outcome_grid as OG, outcomes as OC
from tidewindow.plans import grid as GR, study as ST


def entries(spark, n=150):
    rnd = random.Random(11)
    rows = []
    for i in range(n):
        d, p0 = rnd.choice((1, -1)), 100.0
        wait = rnd.choice((0, 1, 3, None))
        path, p = [], p0
        for m in range(1, 33):
            p += rnd.gauss(0, 0.8)
            if rnd.random() < 0.15:
                continue
            price = [p + abs(rnd.gauss(0, 0.7)), p - abs(rnd.gauss(0, 0.7)), p]
            # A price may be unknown, moves may tie.
            if i % 5 == 0:
                price = [round(x) + 0.0 for x in price]
            if i % 7 == 0 and rnd.random() < 0.3:
                price[rnd.randrange(3)] = rnd.choice((None, float("nan")))
            path.append((m, *price))
        if i in (3, 4):
            path = [] if i == 3 else None
        entry = None if wait is None else p0 + rnd.gauss(0, 1)
        rows.append((f"c{i}", d, p0, rnd.choice((-4.0, 4.0)), 0.1, wait is not None, wait, entry, None if entry is None else d * (entry - p0) / 4, path))
    schema = ("candidate_event_id string, direction int, p0 double, d0 double, pip double, executed boolean, wait int, entry_price double, "
              "r_at_entry double, path array<struct<m:int,high:double,low:double,close:double>>")
    return spark.createDataFrame(rows, schema)


def text(df):
    return sorted(str(tuple(r)) for r in df.select([F.round(c, 9).alias(c) if k == "double" else c for c, k in df.dtypes]).collect())


def test_arrays_walk_as_expressions_do(spark):
    rows = entries(spark)
    for stops, sls in (((6, 12, 24), OC.SL_FRACTIONS), ((3,), (None,))):
        want, got = (f(rows, stops, sls=sls) for f in (OC.barrier_outcomes, OG.outcome_grid))
        assert got.columns == want.columns and text(got) == text(want) and got.where("complete").count()


def test_no_entry_and_no_row(spark):
    none = entries(spark).where("not executed")
    for rows in (none, none.limit(0)):
        out = OG.outcome_grid(rows, ST.STOPS)
        assert out.count() == 48 * rows.count() and out.where("status <> 'no_entry' or complete or mae is not null").count() == 0


def test_rounding_by_arithmetic_is_rounding(spark):
    rnd = random.Random(2)
    x = [rnd.choice((1, -1)) * rnd.random() * 10.0 ** rnd.randrange(-8, 7) for _ in range(20_000)]
    x += [k * 5e-7 for k in range(-3000, 3000)] + [k / 8 + 999 for k in range(40)] + [0.0, -0.0, 1e-6, float("nan"), float("inf"), -float("inf"), None]
    df = spark.createDataFrame([(v,) for v in x], "x double").select("x", ST.r6("x").alias("a"), ST.near6(F.col("x")).alias("b"))
    assert df.where("not (a <=> b)").collect() == []


def test_values_are_rounded_before_they_become_cells(spark):
    """Ten ends a trade are rounded, not 48 cells, and one projection follows the cells."""
    plan = GR.QUERIES["barrier_outcomes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate inline")]
    assert "round(" not in above and "rint(" not in above and above.count("Project") == 1
