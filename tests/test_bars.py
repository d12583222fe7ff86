"""Bars, sessions, sources and outcomes on small literal inputs."""

import datetime as dt
import lzma
import random
import struct

import numpy as np
from pyspark.sql import functions as F

from tidewindow.functions import sessions as S
from tidewindow.operators import costs as CO, outcomes as OC, panel as PN, quality as Q, resample as RS
from tidewindow.operators import levels as LV
from tidewindow.schema import BAR
from tidewindow.sources import dayfiles as DF, files as FI

T0 = dt.datetime(2024, 3, 4, tzinfo=dt.timezone.utc)


def bar(i, o=1.0, h=None, l=None, c=None, v=5.0, delay=0, name="X", step=60):
    c = o if c is None else c
    opened = T0 + dt.timedelta(seconds=step * i)
    closed = opened + dt.timedelta(seconds=step)
    return (name, "1m", opened, closed, closed + dt.timedelta(seconds=delay), o, h or max(o, c), l or min(o, c), c, "bid", v, "quote_activity")


def test_resample_keeps_gaps_and_delays(spark):
    rows = [bar(i, 1.0 + i, delay=90 if i == 2 else 0) for i in range(5)] + [bar(i) for i in (5, 6, 8, 9)]
    df = spark.createDataFrame(rows, BAR)
    out = RS.resample(df, "1m", "5m").collect()
    assert len(out) == 1 and out[0].open == 1.0 and out[0].close == 5.0 and out[0].volume == 25.0
    assert out[0].available_at == out[0].close_time
    late = spark.createDataFrame([bar(i, delay=400 if i == 2 else 0) for i in range(5)], BAR)
    assert RS.resample(late, "1m", "5m").where("available_at > close_time").count() == 1
    gap = RS.incomplete_windows(df, "1m", "5m").collect()
    assert [(g.expected, g.observed) for g in gap] == [(5, 4)]
    assert RS.conservation(df, "1m", "5m").first().conserved


def test_sessions_follow_daylight_saving(spark):
    rows = [(dt.datetime(2024, 1, 10, 8, 30, tzinfo=dt.timezone.utc),), (dt.datetime(2024, 7, 10, 7, 30, tzinfo=dt.timezone.utc),),
            (dt.datetime(2024, 1, 10, 7, 30, tzinfo=dt.timezone.utc),), (dt.datetime(2024, 1, 10, 3, 0, tzinfo=dt.timezone.utc),)]
    df = spark.createDataFrame(rows, "open_time timestamp")
    out = S.classify(df).collect()
    by = {r.open_time.replace(tzinfo=None): r for r in out}
    names = sorted((k.month, k.hour, r.regime) for k, r in by.items())
    assert (1, 8, "asia_london_overlap") in names and (7, 7, "asia_london_overlap") in names
    assert (1, 7, "asia_only") in names
    night = next(w for w in S.NAMED_WINDOWS if w.crosses_midnight)
    row = df.select(S.contains(F.col("open_time"), night).alias("in"), S.instance_date(F.col("open_time"), night).alias("d"), "open_time").where(F.hour("open_time") == 3).first()
    assert row["in"] and row.d == dt.date(2024, 1, 9)


def test_row_contract_and_fingerprint(spark):
    rows = [bar(0), bar(1, h=0.5), bar(2, v=None), bar(3, v=-1.0)]
    df = spark.createDataFrame(rows, BAR)
    good, bad = Q.split_valid(df)
    assert good.count() == 1 and bad.count() == 3
    assert Q.fingerprint(df).first() == Q.fingerprint(df.orderBy(F.desc("open_time"))).first()


def test_day_files_decode_and_quarantine(spark, tmp_path):
    rec = lambda s, o=100, c=101, l=99, h=102, v=1.5: struct.pack(">5if", s, o, c, l, h, v)
    good = lzma.compress(rec(0) + rec(60) + rec(180))
    cases = {"2024-01-02": good, "2024-01-03": lzma.compress(rec(60) + rec(60)), "2024-01-04": lzma.compress(rec(0)[:-1]),
             "2024-01-05": b"junk", "2024-01-06": lzma.compress(rec(0, h=90))}
    folder = tmp_path / "EUR"
    folder.mkdir()
    for day, content in cases.items():
        (folder / f"{day}.bin").write_bytes(content)
    files = DF.day_files(spark, str(folder / "*.bin"))
    bars, bad = DF.decode_days(files, F.lit(100.0))
    assert bars.count() == 3 and bars.agg(F.max("high")).first()[0] == 1.02
    assert {str(r.day): r.fault for r in bad.collect()} == {
        "2024-01-03": "not_increasing", "2024-01-04": "partial_record", "2024-01-05": "not_decodable", "2024-01-06": "bad_ohlc"}
    from tidewindow.streaming.ingest import ingest_new_days

    for _ in range(2):
        ingest_new_days(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"), F.lit(100.0))
    assert spark.read.parquet(str(tmp_path / "out" / "bars")).count() == 3


def test_write_once_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    path = str(tmp_path / "t")
    assert FI.write_once(df, path) == "written" and FI.write_once(df, path) == "identical"
    try:
        FI.write_once(df.where("i = 1"), path)
        raise AssertionError("a different table must be refused")
    except ValueError:
        pass
    FI.write_csv([df, df.withColumn("x", F.lit(1.5))], str(tmp_path / "c"))
    assert FI.read_csv(spark, str(tmp_path / "c"), "i int, s string, x double").where("x is null").count() == 2


def _loop_exit(path, d, p0, d0, entry, tp, sl, stop):
    mae = mfe = 0.0
    for m, high, low, close in path:
        if m > stop:
            break
        fr = sorted((d * (high - p0) / abs(d0), d * (low - p0) / abs(d0)))
        hit_tp, hit_sl = fr[1] >= tp, sl is not None and fr[0] <= -sl
        if hit_tp or hit_sl:
            price = p0 - d * sl * abs(d0) if hit_sl else p0 + d * tp * abs(d0)
            gain = max(0.0, d * (p0 + d * tp * abs(d0) - entry)) if hit_tp and not hit_sl else 0.0
            return ("ambiguous" if hit_tp and hit_sl else "tp" if hit_tp else "sl", m, d * (price - entry), max(mfe, gain))
        mfe = max(mfe, d * (high - entry), d * (low - entry))
        if m == stop:
            return ("time_stop", m, d * (close - entry), mfe)
    return (None, None, None, mfe)


def test_barrier_outcomes_match_a_loop(spark):
    rnd = random.Random(7)
    rows, paths = [], {}
    for i in range(60):
        d, p0, d0 = rnd.choice((1, -1)), 100.0, rnd.choice((-4.0, 4.0))
        path, p = [], p0
        for m in range(1, 13):
            p += rnd.gauss(0, 1)
            if rnd.random() < 0.12:
                continue
            path.append((m, p + abs(rnd.gauss(0, 0.7)), p - abs(rnd.gauss(0, 0.7)), p))
        paths[i] = (d, p0, d0, path)
        rows.append((i, d, p0, d0, 0.1, True, 0, p0, 0.0, path))
    schema = ("i int, direction int, p0 double, d0 double, pip double, executed boolean, wait int, entry_price double, "
              "r_at_entry double, path array<struct<m:int,high:double,low:double,close:double>>")
    out = OC.barrier_outcomes(spark.createDataFrame(rows, schema), (6, 12)).collect()
    assert len(out) == 60 * 32
    for r in out:
        d, p0, d0, path = paths[r.i]
        reason, m, gross, mfe = _loop_exit(path, d, p0, d0, p0, r.tp, r.sl, r.stop)
        assert r.exit_reason == reason and r.holding == m
        assert gross is None and r.gross_adverse is None or abs(gross - r.gross_adverse) < 1e-9
        assert abs(mfe - r.mfe) < 1e-9


def test_break_even_matches_bisection(spark):
    rnd = random.Random(8)
    rows = [(g, rnd.gauss(mu, 4.0), 0.5, 0.3, conv) for g, mu, conv in (("a", 2.0, True), ("b", -3.0, True), ("c", 1.0, False), ("d", 9.0, True)) for _ in range(80)]
    df = spark.createDataFrame(rows, "g string, x double, spread double, commission double, conv boolean")
    got = {r.g: r.break_even_slippage for r in CO.break_even(df, ["g"], "x", "spread", "commission", "conv").collect()}
    for g in "abcd":
        data = [r for r in rows if r[0] == g]

        def mean(s):
            total = 0.0
            for _, x, sp, cm, conv in data:
                v = x - sp - s
                total += (v * (0.993 if v > 0 else 1.007) if conv else v) - cm
            return total / len(data)

        if mean(0.0) <= 0:
            assert got[g] == 0.0
            continue
        lo, hi = 0.0, 1000.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if mean(mid) > 0 else (lo, mid)
        assert abs(got[g] - lo) < 1e-7


def test_pca_residuals_match_numpy(spark):
    rng = np.random.default_rng(9)
    n, size, w, rw = 90, 4, 20, 10
    prices = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, (n, 1)) + rng.normal(0, 0.004, (n, size)), axis=0))
    rows = [("u", 60 * i, *map(float, prices[i])) for i in range(n)]
    panel = spark.createDataFrame(rows, "universe string, t long, " + ", ".join(f"p{i} double" for i in range(size)))
    members = [f"m{i}" for i in range(size)]
    for rank_width in (16, 4096):
        got = {(r.t, r.member): r.residual_z for r in PN.pca_residuals(panel, members, w, 2, rw, 600, rank_width).collect()}
        ret = np.diff(np.log(prices), axis=0)
        res, want = [], {}
        for i in range(w, len(ret)):
            prior = ret[i - w:i]
            x = (ret[i] - prior.mean(0)) / prior.std(0, ddof=1)
            _, vec = np.linalg.eigh(np.corrcoef(prior, rowvar=False))
            lead = vec[:, -2:]
            e = x - lead @ (lead.T @ x)
            if len(res) >= rw:
                hist = np.array(res[-rw:])
                for k in range(size):
                    want[(60 * (i + 1), members[k])] = (e[k] - hist.mean(0)[k]) / hist.std(0, ddof=1)[k]
            res.append(e)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_failed_breakouts_match_a_loop(spark):
    rnd = random.Random(10)
    rows, p, minute = [], 100.0, 0
    for _ in range(200):
        minute += rnd.choice((1, 1, 1, 1, 1, 1, 1, 3))
        p += rnd.gauss(0, 0.5)
        p += (100 - p) * 0.1
        rows.append(bar(minute, p, p + 0.3, p - 0.3, p))
    bars = spark.createDataFrame(rows, BAR)
    base = int(T0.timestamp())
    levels = [("X", "L1", "f", "upper", 100.4, 2.0, base + 60, base + 7000), ("X", "L2", "f", "lower", 99.6, 2.0, base + 1000, base + 12000)]
    ldf = spark.createDataFrame(levels, "instrument string, level_id string, anchor_family string, side string, price double, scale double, available_s long, expires_s long")
    got = {(r.level_id, r.breakout_s, r.at, r.outside_closes) for r in LV.failed_breakouts(bars, ldf, 60, 5, (0.1,), 600).collect()}
    want = set()
    for _, lid, _, side, price, scale, avail, expires in levels:
        blocked, episode, previous, seen = False, None, None, False
        for r in rows:
            at, high, low, close = int(r[4].timestamp()), r[6], r[7], r[8]
            gap = previous is not None and at - previous != 60
            previous = at
            if not avail < at < expires:
                continue
            if not seen:
                seen, blocked = True, at - avail > 60
            elif gap:
                episode, blocked = None, True
            out = close > price if side == "upper" else close < price
            depth = max(0.0, high - price if side == "upper" else price - low) / scale
            if blocked:
                blocked = out
                continue
            if episode is None:
                if out and depth >= 0.1:
                    episode = [at, 1]
                continue
            if out:
                episode[1] += 1
            else:
                if at <= episode[0] + 300:
                    want.add((lid, episode[0], at, episode[1]))
                episode = None
    assert want and got == want
