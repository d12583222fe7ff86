"""Chunked order operators against plain loops, with chunks small enough to matter."""

import math
import random

from pyspark.sql import functions as F

from tidewindow.operators import chunks as C, events as EV, stats as ST


def _series(seed, n, keys=("a", "b")):
    rnd = random.Random(seed)
    rows = []
    for k in keys:
        t = 0
        for _ in range(n):
            t += rnd.choice((1, 1, 1, 5))
            rows.append((k, t, rnd.choice((-2.5, -1.0, -0.2, 0.0, 0.2, 1.0, 2.5))))
    return rows


def test_carry_last_and_running_sum(spark):
    rows = _series(1, 60)
    df = spark.createDataFrame(rows, "k string, t long, z double").withColumn("v", F.when(F.abs("z") > 2, F.col("z")))
    got = {(r.k, r.t): (r.p, r.s) for r in C.running_sum(
        C.carry_last(df, ["k"], "t", F.col("t"), 7, "v", "p"), ["k"], "t", F.col("t"), 7, F.lit(1), "s").collect()}
    for key in ("a", "b"):
        last, n = None, 0
        for k, t, z in sorted(r for r in rows if r[0] == key):
            n += 1
            assert got[(k, t)] == (last, n)
            last = z if abs(z) > 2 else last


def test_longest_run(spark):
    rows = _series(2, 200)
    df = spark.createDataFrame(rows, "k string, t long, z double")
    for width in (3, 11, 10_000):
        got = {r.k: r.run for r in C.longest_run(df, ["k"], "t", F.col("t"), width, F.col("z") < 0.5, "run").collect()}
        for key in ("a", "b"):
            best = cur = 0
            for _, _, z in sorted(r for r in rows if r[0] == key):
                cur = cur + 1 if z < 0.5 else 0
                best = max(best, cur)
            assert got[key] == best


def test_rearm_and_prefix_invariance(spark):
    rows = _series(3, 120)
    schema = "instrument string, at long, z double"
    fixed = {"benchmark_family": "f", "signal_timeframe": "1h", "session": None, "lookback": 1, "active": True, "close": 10.0, "e0": 9.0}

    def run(data):
        df = spark.createDataFrame(data, schema).select("*", *[F.lit(v).alias(k) for k, v in fixed.items()])
        df = df.withColumn("session", F.lit(None).cast("string"))
        return {(r.instrument, r.direction, r.at) for r in EV.rearmed(EV.two_sided(df, 1.0), 1.0, 9).collect()}

    want = set()
    for key in ("a", "b"):
        for d in (1, -1):
            armed = True
            for k, t, z in sorted(r for r in rows if r[0] == key):
                qualifies = z < -1.0 if d == 1 else z > 1.0
                if qualifies and armed:
                    want.add((k, d, t))
                    armed = False
                elif not qualifies and abs(z) < 1.0:
                    armed = True
    assert run(rows) == want
    cut = [r for r in rows if r[1] <= 100]
    assert run(cut) == {e for e in want if e[2] <= 100}


def test_shock_hysteresis(spark):
    rows = _series(4, 150)
    df = spark.createDataFrame(rows, "k string, t long, z double")
    got = {(r.k, r.t): (r.shock_active, r.event_emitted, r.shock_sign, r.fade_direction)
           for r in EV.shock_episodes(df, ["k"], "t", 8, "z", 2.0, 0.5).collect()}
    for key in ("a", "b"):
        active, sign = False, 0
        for k, t, z in sorted(r for r in rows if r[0] == key):
            event = False
            if active and abs(z) < 0.5:
                active, sign = False, 0
            if not active and abs(z) >= 2.0:
                active, event, sign = True, True, 1 if z > 0 else -1
            assert got[(k, t)] == (active, event, sign, -sign)


def test_quantiles_both_rules(spark):
    rnd = random.Random(5)
    rows = [(k, rnd.choice((0.0, -1.5, rnd.gauss(0, 3), 2.0))) for k in ("a", "b", None) for _ in range(rnd.choice((1, 37, 200)))]
    df = spark.createDataFrame(rows, "k string, x double")
    wanted = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    lin = {r.k: r for r in ST.quantiles(df, ["k"], "x", wanted).collect()}
    near = {r.k: r for r in ST.quantiles(df, ["k"], "x", wanted, ST.NEAREST).collect()}
    for k in ("a", "b", None):
        xs = sorted(x for q, x in rows if q == k)
        for name, p in wanted.items():
            at = (len(xs) - 1) * p
            lo = math.floor(at)
            want = xs[lo] + (xs[min(lo + 1, len(xs) - 1)] - xs[lo]) * (at - lo)
            assert abs(lin[k][name] - want) < 1e-12
            assert near[k][name] == xs[max(0, math.ceil(p * len(xs)) - 1)]


def test_ranked(spark):
    rnd = random.Random(6)
    rows = [("a", rnd.choice((-1.0, 0.0, 3.0, rnd.random())), i) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, x double, i long")
    got = [r.i for r in C.ranked(df, ["k"], "x", "i").orderBy("rank").collect()]
    assert got == [i for _, _, i in sorted(rows, key=lambda r: (r[1], r[2]))]
