"""DuckDB statements for the registered queries, composed from named CTEs."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
QUERIES: dict[str, str] = {}


def r(x: str) -> str:
    return (f"CASE WHEN abs({x}) < 1e-6::DOUBLE THEN 0::DOUBLE WHEN abs({x}) < 1000 THEN round({x} + 2.71828e-7::DOUBLE, 6) "
            f"ELSE round({x} + 2.71828e-4::DOUBLE, 3) END")


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", sql))
    return [n for n in CTES if n in words]


def compose(sql: str) -> str:
    chosen: set[str] = set()
    todo = _needs(sql)
    while todo:
        n = todo.pop()
        if n not in chosen:
            chosen.add(n)
            todo.extend(_needs(CTES[n]))
    order = [n for n in CTES if n in chosen]
    # Steps that several later ones read are computed once.
    once = {n for n in ("cands", "candx", "ents", "entp", "touch", "cellx", "prior", "outs", "priced", "costs", "finished", "imm", "atlas", "acell", "ptr", "ptx")}
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in once else ''}({CTES[n]})" for n in order)
    body = sql.strip()
    head, body = (re.sub(r'(?<![".])\bat\b(?!")', '"at"', x) for x in (head, body))
    head, body = (re.sub(r'\.at\b', '."at"', x) for x in (head, body))
    if not head:
        return body
    if body.startswith("WITH "):
        return "WITH " + head + ",\n" + body[5:]
    return "WITH " + head + "\n" + body


def query(name: str, sql: str) -> None:
    QUERIES[name] = compose(sql)


def local(tz: str, s: str) -> str:
    return f"timezone('{tz}', to_timestamp({s}))"


def clock(tz: str, s: str) -> str:
    return f"(hour({local(tz, s)})*60 + minute({local(tz, s)}))"


SESSIONS = {"asia": ("Asia/Tokyo", 540, 1080), "london": ("Europe/London", 480, 1020),
            "new_york": ("America/New_York", 480, 1020)}
NAMED = {
    "asian_kz_20_00_et": (1200, 0), "london_kz_02_05_et": (120, 300), "london_core_02_04_et": (120, 240),
    "new_york_kz_07_10_et": (420, 600), "new_york_kz_0830_1100_et": (510, 660),
    "london_close_10_12_et": (600, 720), "new_york_lunch_11_13_et": (660, 780),
}


def inside(tz: str, lo: int, hi: int, s: str) -> str:
    c = clock(tz, s)
    return f"({c} >= {lo} OR {c} < {hi})" if lo > hi else f"({c} >= {lo} AND {c} < {hi})"


def session_list(s: str) -> str:
    parts = ", ".join(
        f"CASE WHEN {inside(tz, lo, hi, s)} THEN '{n}' END" for n, (tz, lo, hi) in sorted(SESSIONS.items())
    )
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


def session_date(anchor: str, s: str) -> str:
    cases = " ".join(f"WHEN '{n}' THEN CAST({local(tz, s)} AS DATE)" for n, (tz, _, _) in SESSIONS.items())
    return f"CASE {anchor} {cases} END"


# ---------------------------------------------------------------- ticks and bars
cte("ticks", """
SELECT event_type || '.' || CAST(user_id // 150 AS VARCHAR) AS instrument, ts, event_id, user_id,
       epoch_us(ts) // 1000000 AS s,
       round(value * sc)::BIGINT + 100 * sc AS ticks,
       (round(value * sc)::BIGINT + 100 * sc)::DOUBLE / sc::DOUBLE AS price,
       CASE WHEN k >= 20 THEN 1::DOUBLE ELSE 0::DOUBLE END AS weight,
       (k - 10)::DOUBLE / 1000::DOUBLE AS raw_spread
FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k,
             CASE WHEN event_type IN ('click', 'view') THEN 100 ELSE 1000 END AS sc FROM events)""")
cte("bars", """
SELECT instrument, (s // 3600) * 3600 AS t, (s // 3600) * 3600 + 3600 AS at,
       arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close,
       sum(weight) AS volume, 3600 AS tf_s
FROM ticks GROUP BY ALL""")
cte("win", """
SELECT b.instrument, g.tf_s, (b.t // g.tf_s) * g.tf_s AS t, arg_min(open, b.t) AS open, max(high) AS high,
       min(low) AS low, arg_max(close, b.t) AS close, sum(volume) AS volume, count(*) AS observed,
       g.tf_s // 3600 AS expected
FROM bars b, (VALUES (7200), (14400), (28800)) g(tf_s) GROUP BY b.instrument, g.tf_s, (b.t // g.tf_s) * g.tf_s""")
OBS = """
SELECT *, NOT (volume = 0 AND open = high AND high = low AND low = close) AS active,
       {sess} AS sess, {tf} AS timeframe FROM {src}"""
cte("obs", OBS.format(sess=session_list("t"), tf="'1h'", src="bars"))
cte("robs", OBS.format(
    sess=session_list("t"), tf="CASE tf_s WHEN 7200 THEN '2h' WHEN 14400 THEN '4h' ELSE '8h' END",
    src="(SELECT instrument, tf_s, t, t + tf_s AS at, open, high, low, close, volume FROM win WHERE observed = expected)"))

# ---------------------------------------------------------------- labels and features
cte("labels_long", """
SELECT o.*, h.h AS horizon_s,
       CASE WHEN o.active AND x.active THEN x.close / o.close - 1 END AS ret
FROM robs o CROSS JOIN (VALUES (7200), (14400), (28800), (86400)) h(h)
LEFT JOIN robs x ON x.instrument = o.instrument AND x.tf_s = o.tf_s AND x.at = o.at + h.h""")


def band(src: str) -> str:
    return f"""
SELECT *, CASE WHEN full_n AND mx > mn THEN (close - middle0) / sd END AS z,
       CASE WHEN full_n THEN middle0 END AS middle, CASE WHEN full_n AND mx > mn THEN sd END AS dispersion
FROM (
 SELECT o.*, n.n AS lookback,
  avg(CASE WHEN active THEN close END) OVER w AS middle0,
  stddev_samp(CASE WHEN active THEN close END) OVER w AS sd,
  max(CASE WHEN active THEN close END) OVER w AS mx, min(CASE WHEN active THEN close END) OVER w AS mn,
  count(CASE WHEN active THEN close END) OVER w = n.n AND t - min(t) OVER w = (n.n - 1) * tf_s AS full_n
 FROM {src} o, (VALUES (4), (8)) n(n)
 WINDOW w AS (PARTITION BY instrument, tf_s, n.n ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)
)"""


def band_one(src: str, n: int) -> str:
    return f"""
SELECT *, CASE WHEN full_n AND mx > mn THEN (close - middle0) / sd END AS z,
       CASE WHEN full_n THEN middle0 END AS middle, CASE WHEN full_n AND mx > mn THEN sd END AS dispersion
FROM (
 SELECT o.*, {n} AS lookback,
  avg(CASE WHEN active THEN close END) OVER w AS middle0,
  stddev_samp(CASE WHEN active THEN close END) OVER w AS sd,
  max(CASE WHEN active THEN close END) OVER w AS mx, min(CASE WHEN active THEN close END) OVER w AS mn,
  count(CASE WHEN active THEN close END) OVER w = {n} AND t - min(t) OVER w = ({n} - 1) * tf_s AS full_n
 FROM {src} o
 WINDOW w AS (PARTITION BY instrument, tf_s ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)
)"""


def vol_one(src: str, n: int) -> str:
    return f"""
SELECT * EXCLUDE (sd, nr, mx, mn, r0, t0), {n} AS lookback,
       CASE WHEN nr = {n} AND mx > mn AND t - t0 = ({n} - 1) * tf_s THEN sd END AS volatility
FROM (
 SELECT *, stddev_samp(r0) OVER w AS sd, count(r0) OVER w AS nr, max(r0) OVER w AS mx, min(r0) OVER w AS mn,
        min(t) OVER w AS t0
 FROM (SELECT *, CASE WHEN active AND lag(active) OVER p AND t - lag(t) OVER p = tf_s
                      THEN close / lag(close) OVER p - 1 END AS r0
       FROM {src} WINDOW p AS (PARTITION BY instrument, tf_s ORDER BY t))
 WINDOW w AS (PARTITION BY instrument, tf_s ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)
)"""


cte("bandf", "SELECT * FROM (" + band_one("robs", 4) + ") UNION ALL SELECT * FROM (" + band_one("robs", 8) + ")")
cte("volf", "SELECT * FROM (" + vol_one("robs", 4) + ") UNION ALL SELECT * FROM (" + vol_one("robs", 8) + ")")
cte("vwapf", f"""
SELECT *, close - vwap AS absolute, close / vwap - 1 AS relative, (close / vwap - 1) / volatility AS z
FROM (
 SELECT *, CASE WHEN sum(w0) OVER s > 0 THEN sum((high + low + close) / 3 * w0) OVER s / sum(w0) OVER s END AS vwap
 FROM (SELECT *, CASE WHEN active THEN volume END AS w0, {session_date("anchor", "t")} AS session_date
       FROM (SELECT *, unnest(sess) AS anchor FROM volf))
 WINDOW s AS (PARTITION BY instrument, tf_s, lookback, anchor, session_date ORDER BY t
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)""")
cte("finec", f"""
SELECT instrument, at, anchor, session_date, sum(pv) OVER s AS pv, sum(w0) OVER s AS w0
FROM (SELECT instrument, at, anchor, {session_date("anchor", "t")} AS session_date,
             CASE WHEN active THEN (high + low + close) / 3 * volume END AS pv,
             CASE WHEN active THEN volume END AS w0
      FROM (SELECT *, unnest(sess) AS anchor FROM obs))
WINDOW s AS (PARTITION BY instrument, anchor, session_date ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
cte("finef", """
SELECT *, close - vwap AS absolute, close / vwap - 1 AS relative, (close / vwap - 1) / volatility AS z
FROM (SELECT v.* EXCLUDE (vwap, absolute, relative, z), CASE WHEN f.w0 > 0 THEN f.pv / f.w0 END AS vwap
      FROM vwapf v ASOF LEFT JOIN finec f
      ON v.instrument = f.instrument AND v.anchor = f.anchor AND v.session_date = f.session_date AND v.at >= f.at)""")

# ---------------------------------------------------------------- states, candidates, paths
cte("states", """
SELECT instrument, 'band' AS benchmark_family, timeframe AS signal_timeframe, session, lookback, at, active, close,
       middle AS e0, z FROM (SELECT *, unnest(list_prepend(NULL, sess)) AS session FROM bandf WHERE z IS NOT NULL)
UNION ALL
SELECT instrument, 'vwap', timeframe, anchor, lookback, at, active, close, vwap, z FROM vwapf WHERE z IS NOT NULL
UNION ALL
SELECT instrument, 'vwap-fine', timeframe, anchor, lookback, at, active, close, vwap, z FROM finef WHERE z IS NOT NULL""")
cte("sides", """
SELECT s.*, d.d AS direction,
       coalesce(CASE WHEN z < -0.75::DOUBLE THEN 1 WHEN z > 0.75::DOUBLE THEN -1 END = d.d, false) AS qualifying
FROM states s, (VALUES (1), (-1)) d(d) WHERE active""")
cte("cands", """
SELECT * EXCLUDE (kind, prev, active, qualifying, close), close AS p0, close - e0 AS d0, 0.75::DOUBLE AS signal_threshold,
       'candidate-' || substr(sha256(concat_ws('|', instrument, benchmark_family, signal_timeframe,
           coalesce(session, 'None'), CAST(direction AS VARCHAR), CAST(lookback AS VARCHAR), CAST(at AS VARCHAR))), 1, 24)
           AS candidate_event_id,
       CASE WHEN split_part(instrument, '.', 1) IN ('click', 'view') THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END AS pip,
       split_part(instrument, '.', 1) IN ('purchase', 'signup') AS converted
FROM (SELECT *, lag(kind) OVER (PARTITION BY instrument, benchmark_family, signal_timeframe, session, direction, lookback
                                ORDER BY at) AS prev
      FROM (SELECT *, CASE WHEN qualifying THEN 'Q' WHEN abs(z) < 0.75::DOUBLE THEN 'R' END AS kind FROM sides)
      WHERE kind IS NOT NULL)
WHERE kind = 'Q' AND (prev IS NULL OR prev = 'R')""")
cte("signals", """
SELECT * EXCLUDE (active, close), close AS p0, close - e0 AS d0,
       CASE WHEN split_part(instrument, '.', 1) IN ('click', 'view') THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END AS pip
FROM (SELECT s.*, th.threshold, CASE WHEN z < -threshold THEN 1 WHEN z > threshold THEN -1 END AS direction
      FROM states s, (VALUES (1::DOUBLE), (1.5::DOUBLE), (2::DOUBLE), (2.5::DOUBLE)) th(threshold) WHERE active)
WHERE direction IS NOT NULL""")

# ================================================================ foundation
query("bar_ingest", f"""
SELECT instrument, t AS open_s, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close,
       volume FROM bars""")
query("resample_bars", f"""
SELECT instrument, timeframe, t AS open_s, at AS available_s, {r('open')} AS open, {r('high')} AS high,
       {r('low')} AS low, {r('close')} AS close, volume FROM robs""")
query("resample_incomplete", """
SELECT instrument, CASE tf_s WHEN 7200 THEN '2h' WHEN 14400 THEN '4h' ELSE '8h' END AS timeframe, t AS open_s, expected, observed
FROM win WHERE observed <> expected""")
query("resample_conservation", """
SELECT w.*, b.n AS source_rows, w.accounted_rows = b.n AS conserved FROM (
 SELECT instrument, CASE tf_s WHEN 7200 THEN '2h' WHEN 14400 THEN '4h' ELSE '8h' END AS timeframe,
       count(*) FILTER (observed = expected) AS complete_windows,
       count(*) FILTER (observed <> expected) AS incomplete_windows,
       CAST(sum(CASE WHEN observed = expected THEN expected ELSE observed END) AS BIGINT) AS accounted_rows
 FROM win GROUP BY ALL) w JOIN (SELECT instrument, count(*) AS n FROM bars GROUP BY 1) b USING (instrument)""")
PIP = "CASE WHEN split_part(instrument, '.', 1) IN ('click', 'view') THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END"
query("scalar_columns", f"""
SELECT instrument, t AS open_s, 3600 AS tf_s, 3600 AS alias_s, {PIP} AS pip, {r('(high + low + close) / 3')} AS hlc3,
       active, {r('close / open - 1')} AS bar_return, {r('ln(close / open)')} AS log_return,
       {r('high - greatest(open, close)')} AS upper_wick, {r('least(open, close) - low')} AS lower_wick,
       {r('greatest(high - low, abs(high - open), abs(low - open))')} AS true_range,
       strftime(make_timestamp(t * 1000000), '%Y-%m') AS month,
       year(make_timestamp(t * 1000000)) || '-Q' || quarter(make_timestamp(t * 1000000)) AS quarter
FROM obs""")
query("tick_decode", f"SELECT event_id AS tick_id, instrument, ticks, {r('price')} AS price, {PIP} AS pip FROM ticks")
query("point_in_time_view", """
SELECT instrument, count(*) AS bars, max(at) AS last_s FROM bars WHERE at <= 1705276800 GROUP BY 1""")
_named = ", ".join(
    f"CASE WHEN {inside('America/New_York', lo, hi, 't')} THEN '{n}' END" for n, (lo, hi) in sorted(NAMED.items()))
query("session_labels", f"""
SELECT instrument, t AS open_s, array_to_string(sess, '|') AS sessions,
       CASE WHEN len(sess) = 0 THEN 'outside_major_sessions' WHEN len(sess) = 1 THEN sess[1] || '_only'
            ELSE array_to_string(sess, '_') || '_overlap' END AS regime,
       array_to_string(list_filter([{_named}], lambda x: x IS NOT NULL), '|') AS named,
       {inside('Europe/London', 480, 1020, 't')} AS in_london,
       strftime({local('Asia/Tokyo', 't')}, '%Y-%m-%d %H:%M') AS tokyo_clock
FROM obs""")
NY = "America/New_York"


def utc_of(day: str, minutes: int) -> str:
    return f"epoch_us(timezone('{NY}', CAST({day} AS TIMESTAMP) + INTERVAL {minutes} MINUTE)) // 1000000"


query("session_bounds", f"""
SELECT instrument, t AS open_s, strftime(d, '%Y-%m-%d') AS ny_date, {utc_of('d', 480)} AS ny_open_s,
       {utc_of('d', 1020)} AS ny_close_s, {utc_of('d', 1200)} AS night_open_s, {utc_of('d', 1440)} AS night_close_s,
       {utc_of('d', 1020)} AS day_open_s, {utc_of('d', 1440 + 1020)} AS day_close_s
FROM (SELECT *, CAST({local(NY, 't')} AS DATE) AS d FROM bars)""")
_since = " ".join(
    f"WHEN '{n}' THEN {clock(tz, 't')} - {lo}" for n, (tz, lo, hi) in SESSIONS.items())
_until = " ".join(
    f"WHEN '{n}' THEN {hi} - {clock(tz, 't')}" for n, (tz, lo, hi) in SESSIONS.items())
query("session_minutes", f"""
SELECT instrument, t AS open_s, one AS session, CASE one {_since} END AS from_open, CASE one {_until} END AS to_close
FROM (SELECT *, CASE WHEN len(sess) = 1 THEN sess[1] END AS one FROM obs)""")
query("dataset_gaps", """
SELECT instrument, p AS start_s, t AS end_s FROM (
 SELECT instrument, t, lag(at) OVER (PARTITION BY instrument ORDER BY t) AS p FROM bars) WHERE t > p""")
cte("line_bars", """
SELECT CAST(l_suppkey AS VARCHAR) AS instrument, epoch_us(l_shipdate) // 1000000 AS o,
       epoch_us(l_shipdate) // 1000000 + 86400 * CASE WHEN l_linenumber = 7 THEN 2 ELSE 1 END AS c,
       epoch_us(l_shipdate) // 1000000 + 86400 * (l_linenumber % 3) AS av,
       l_quantity AS op, l_extendedprice / 2000::DOUBLE AS hi, l_discount * 200::DOUBLE AS lo, l_tax * 500::DOUBLE AS cl,
       CASE WHEN l_returnflag = 'R' THEN 'quote' ELSE 'bid' END AS pb,
       CASE WHEN l_linestatus = 'O' THEN l_quantity END AS vol,
       CASE WHEN l_returnflag = 'A' THEN 'none' ELSE 'tick' END AS vs
FROM lineitem""")
query("row_contract", """
SELECT v AS violation, count(*) AS rows FROM (
 SELECT unnest(list_filter([
   CASE WHEN av < c THEN 'available_before_close' END,
   CASE WHEN hi < greatest(op, cl, lo) THEN 'high_below_body' END,
   CASE WHEN lo > least(op, cl, hi) THEN 'low_above_body' END,
   CASE WHEN pb NOT IN ('bid','ask','mid','trade','other','unknown') THEN 'unknown_price_basis' END,
   CASE WHEN vs = 'none' AND vol IS NOT NULL THEN 'volume_without_semantics' END,
   CASE WHEN vs <> 'none' AND vol IS NULL THEN 'volume_missing' END], lambda x: x IS NOT NULL)) AS v FROM line_bars)
GROUP BY 1""")
query("dataset_contract", """
WITH u AS (SELECT *, count(*) AS same FROM line_bars GROUP BY ALL),
 sp AS (SELECT instrument, o, c, sum(same) AS n, sum(same - 1) AS copies, count(*) AS variants FROM u GROUP BY ALL),
 x AS (SELECT *, max(c) OVER (PARTITION BY instrument ORDER BY o, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp)
SELECT x.instrument, '1d' AS timeframe, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(copies) AS BIGINT) AS duplicate_rows,
       CAST(sum(variants - 1) AS BIGINT) AS duplicate_intervals, count(*) FILTER (c - o <> 86400) AS wrong_length,
       count(*) FILTER (reach > o) AS overlaps, any_value(m.a) AS one_basis, any_value(m.b) AS one_volume_kind
FROM x JOIN (SELECT instrument, count(DISTINCT pb) = 1 AS a, count(DISTINCT vs) = 1 AS b FROM line_bars GROUP BY 1) m
USING (instrument) GROUP BY x.instrument""")
query("universe_audit", f"""
WITH span AS (SELECT min(t) // 86400 * 86400 AS lo, (max(t) // 86400 + 1) * 86400 AS hi FROM bars)
SELECT b.instrument, bars, distinct_bars, bad_prices, coalesce(long_gaps, 0) AS long_gaps,
       coalesce(max_gap_s, 0) AS max_gap_s, coalesce(gap_total_s, 0) AS gap_total_s, (hi - lo) // 3600 AS expected_bars,
       (hi - lo) // 3600 - distinct_bars AS missing_bars, bars - distinct_bars AS duplicate_bars,
       {r('distinct_bars / ((hi - lo) / 3600)::DOUBLE')} AS coverage, (hi - lo) // 86400 - days AS absent_days
FROM span, (SELECT instrument, count(*) AS bars, count(DISTINCT t) AS distinct_bars,
             count(*) FILTER (high < low OR low <= 0) AS bad_prices, count(DISTINCT t // 86400) AS days
      FROM bars GROUP BY 1) b
LEFT JOIN (SELECT instrument, count(*) FILTER (g >= 10800) AS long_gaps, max(g) AS max_gap_s, CAST(sum(g) AS BIGINT) AS gap_total_s
  FROM (SELECT instrument, t - lag(at) OVER (PARTITION BY instrument ORDER BY t) AS g FROM bars
        UNION ALL SELECT instrument, min(t) - (SELECT lo FROM span) FROM bars GROUP BY 1
        UNION ALL SELECT instrument, (SELECT hi FROM span) - max(at) FROM bars GROUP BY 1) WHERE g > 0 GROUP BY 1) h USING (instrument)""")
query("absent_days", """
SELECT p.k AS instrument, strftime(d, '%Y-%m-%d') AS day
FROM (SELECT DISTINCT o_orderpriority AS k FROM orders) p,
     (SELECT unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS d)
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = p.k AND CAST(o_orderdate AS DATE) = CAST(d AS DATE))""")
query("calendar_partition", """
SELECT k AS instrument, count(*) AS calendar_days, CAST(sum(p) AS BIGINT) AS present_days, CAST(sum(a) AS BIGINT) AS absent_days,
       count(*) FILTER (p = 1 AND a = 1) AS conflicts, count(*) FILTER (p = 0 AND a = 0) AS unexplained,
       count(*) FILTER (p = 1 AND a = 1) = 0 AND count(*) FILTER (p = 0 AND a = 0) = 0 AS exact_partition
FROM (SELECT s.k, d, CASE WHEN o.day IS NULL THEN 0 ELSE 1 END AS p,
             CASE WHEN o.day IS NOT NULL AND day(d) = 31 THEN 1 ELSE 0 END AS a
      FROM (SELECT DISTINCT o_orderstatus AS k FROM orders) s
      CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS DATE) AS d)
      LEFT JOIN (SELECT DISTINCT o_orderstatus AS k, CAST(o_orderdate AS DATE) AS day FROM orders) o ON o.k = s.k AND o.day = d)
GROUP BY 1""")
cte("ub", "SELECT DISTINCT split_part(instrument, '.', 2) AS universe, split_part(instrument, '.', 1) AS member, t FROM bars")
query("sync_audit", f"""
WITH c AS (SELECT universe, t, count(*) AS n FROM ub GROUP BY 1, 2),
 x AS (SELECT universe, count(*) FILTER (n = 5) AS common_clocks, count(*) AS union_clocks FROM c GROUP BY 1)
SELECT universe, member, count(*) AS clocks, any_value(common_clocks) AS common_clocks, any_value(union_clocks) AS union_clocks,
       count(*) - any_value(common_clocks) AS lost_to_sync,
       {r('any_value(common_clocks) / any_value(union_clocks)::DOUBLE')} AS common_ratio
FROM ub JOIN x USING (universe) GROUP BY 1, 2""")
query("sync_pairs", """
SELECT a.universe, a.member AS left_member, b.member AS right_member, count(*) AS common_clocks
FROM ub a JOIN ub b ON a.universe = b.universe AND a.t = b.t AND a.member < b.member GROUP BY 1, 2, 3""")
query("day_audit", f"""
SELECT instrument, strftime(make_timestamp(t * 1000000), '%Y-%m-%d') AS day, count(*) AS bars, {r('min(low)')} AS min_low,
       {r('max(high)')} AS max_high, min(volume) AS min_volume, max(volume) AS max_volume, sum(volume) AS total_volume,
       any_value(gaps) AS gaps, """ + ", ".join(f"any_value(w{f}) AS windows_{f}, any_value(i{f}) AS incomplete_{f}" for f in (2, 4, 8)) + """
FROM bars JOIN (SELECT instrument, t // 86400 AS d, count(*) FILTER (t - before > 3600) AS gaps FROM
  (SELECT instrument, t, lag(t) OVER (PARTITION BY instrument, t // 86400 ORDER BY t) AS before FROM bars) GROUP BY 1, 2) g USING (instrument)
""" + "".join(f"""JOIN (SELECT instrument, d, count(*) FILTER (n = {f}) AS w{f}, count(*) FILTER (n < {f}) AS i{f} FROM
  (SELECT instrument, t // 86400 AS d, t // {f * 3600} AS w, count(*) AS n FROM bars GROUP BY 1, 2, 3) GROUP BY 1, 2) x{f} USING (instrument)
""" for f in (2, 4, 8)) + "WHERE g.d = t // 86400 AND " + " AND ".join(f"x{f}.d = g.d" for f in (2, 4, 8)) + " GROUP BY 1, 2")
query("plausibility", f"""
SELECT instrument, {r('min(low)')} AS min_low, {r('max(high)')} AS max_high, count(*) FILTER (volume < 0) AS negative_volume,
       min(low) >= any_value(lo) AS above_floor, max(high) <= any_value(hi) AS below_ceiling
FROM bars JOIN (VALUES ('click', 100.0::DOUBLE, 400.0::DOUBLE), ('error', 100.5::DOUBLE, 500.0::DOUBLE),
  ('purchase', 100.0::DOUBLE, 600.0::DOUBLE), ('signup', 99.0::DOUBLE, 450.0::DOUBLE), ('view', 100.0::DOUBLE, 700.0::DOUBLE)) v(k, lo, hi)
ON split_part(instrument, '.', 1) = k GROUP BY 1""")
query("reconcile_tables", """
SELECT side, mismatched, count(*) AS keys FROM (
 SELECT CASE WHEN o.k IS NULL THEN 'right_only' WHEN l.k IS NULL THEN 'left_only' ELSE 'both' END AS side,
        CASE WHEN o.k IS NOT NULL AND l.k IS NOT NULL THEN array_to_string(list_filter(
          [CASE WHEN o.n <> l.n THEN 'rows' END, CASE WHEN o.y <> l.y THEN 'year' END], lambda x: x IS NOT NULL), '|') END AS mismatched
 FROM (SELECT o_orderkey AS k, count(*) AS n, max(year(o_orderdate)) AS y FROM orders GROUP BY 1) o
 FULL JOIN (SELECT l_orderkey AS k, max(l_linenumber) AS n, min(year(l_shipdate)) AS y FROM lineitem GROUP BY 1) l ON o.k = l.k)
GROUP BY 1, 2""")
query("event_identity", """
SELECT instrument, t AS open_s, 'bar-' || substr(sha256(concat_ws('|', instrument, '1h', CAST(t AS VARCHAR), 'bid')), 1, 24) AS bar_id
FROM bars""")
query("part_completeness", """
WITH p AS (SELECT o_orderstatus AS run, o_custkey % 9 AS part, o_orderkey AS g, o_orderpriority AS src FROM orders)
SELECT run, groups, split_groups, rows, found_parts, undeclared_parts, sources, declared_rows,
       found_parts = 8 AND undeclared_parts = 0 AND split_groups = 0 AND sources = 1 AND coalesce(rows = declared_rows, false) AS complete
FROM (SELECT run, count(*) AS groups, count(*) FILTER (n > 1) AS split_groups, CAST(sum(m) AS BIGINT) AS rows
      FROM (SELECT run, g, count(DISTINCT part) AS n, count(*) AS m FROM p GROUP BY 1, 2) GROUP BY 1)
JOIN (SELECT run, count(DISTINCT part) FILTER (part < 8) AS found_parts, count(DISTINCT part) FILTER (part >= 8) AS undeclared_parts
      FROM p GROUP BY 1) USING (run)
JOIN (SELECT run, count(DISTINCT coalesce(src, '-')) AS sources FROM p GROUP BY 1) USING (run)
LEFT JOIN (SELECT o_orderstatus AS run, count(*) AS declared_rows FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1) USING (run)""")
query("duplicate_identity", """
SELECT verdict, count(*) AS identities, CAST(sum(n) AS BIGINT) AS rows FROM (
 SELECT CASE WHEN count(*) = 1 THEN 'unique' WHEN count(DISTINCT (l_partkey, l_quantity)) = 1 THEN 'identical' ELSE 'conflict' END AS verdict,
        count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY 1""")
query("period_guard", """
SELECT year(l_shipdate) AS year, count(*) AS rows FROM lineitem
WHERE NOT CAST(l_shipdate AS DATE) BETWEEN DATE '1995-06-01' AND DATE '1999-06-30' GROUP BY 1""")
query("orphan_rows", """
SELECT l_returnflag, count(*) AS rows, count(DISTINCT l_orderkey) AS orders FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1""")
query("expected_counts", """
SELECT event_type, 'both' AS side, CASE WHEN count(*) <> count(DISTINCT user_id) * 13 THEN 'n' ELSE '' END AS mismatched,
       count(*) AS left_n, count(DISTINCT user_id) * 13 AS right_n FROM events GROUP BY 1""")
query("tick_validation", """
SELECT instrument, CASE WHEN raw_spread < 0 THEN 'negative_spread' WHEN weight = 0 THEN 'no_weight' ELSE 'ok' END AS reason,
       count(*) AS rows FROM ticks GROUP BY 1, 2""")
query("incremental_ingest", """
SELECT instrument, strftime(make_timestamp(d * 86400000000), '%Y-%m-%d') AS day FROM (
 SELECT DISTINCT instrument, s // 86400 AS d FROM ticks
 EXCEPT SELECT DISTINCT instrument, t // 86400 FROM bars WHERE volume >= 7)""")
cte("spread_rows", f"""
SELECT instrument, unnest(list_prepend('overall', sess)) AS session, greatest(0::DOUBLE, sp) AS spread
FROM (SELECT *, {session_list("t")} AS sess FROM (
  SELECT instrument, (s // 5) * 5 AS t, arg_max(raw_spread, ts) AS sp FROM ticks GROUP BY 1, 2))""")
cte("spreads", """
SELECT instrument, session, count(*) AS samples, avg(spread) AS mean, quantile_cont(spread, 0.75) AS p75,
       quantile_cont(spread, 0.90) AS p90, quantile_cont(spread, 0.95) AS p95, quantile_cont(spread, 0.99) AS p99
FROM spread_rows GROUP BY 1, 2""")
query("spread_profile", f"""
SELECT instrument, session, samples, {r('mean')} AS mean, {r('p75')} AS p75, {r('p90')} AS p90, {r('p95')} AS p95,
       {r('p99')} AS p99 FROM spreads""")
query("panel_check", """
SELECT universe, count(*) AS clocks, count(*) AS distinct_clocks, 0 AS non_finite, 0 AS non_positive, min(t) AS first_s, max(t) AS last_s
FROM (SELECT universe, t FROM ub GROUP BY 1, 2 HAVING count(*) = 5) GROUP BY 1""")

# ================================================================ benchmarks
query("forward_outcomes", f"""
SELECT instrument, timeframe, t AS open_s, active, CAST(horizon_s AS BIGINT) AS horizon_s, {r('ret')} AS ret FROM labels_long""")
query("observation_audit", """
SELECT instrument, timeframe, count(*) FILTER (horizon_s = 7200) AS source_bars,
 count(*) FILTER (horizon_s = 7200 AND active) AS active_bars, count(*) FILTER (horizon_s = 7200 AND NOT active) AS inactive_bars,
""" + ", ".join(
    f"count(ret) FILTER (horizon_s = {h}) AS valid_{h}, count(*) FILTER (horizon_s = {h} AND ret IS NULL) AS unavailable_{h}"
    for h in (7200, 14400, 28800, 86400)) + " FROM labels_long GROUP BY 1, 2")
query("band_features", f"""
SELECT instrument, timeframe, t AS open_s, lookback, {r('middle')} AS middle, {r('dispersion')} AS dispersion, {r('z')} AS z FROM bandf""")
VW = f"""
SELECT instrument, timeframe, t AS open_s, anchor, strftime(session_date, '%Y-%m-%d') AS session_date, lookback,
       {r('vwap')} AS vwap, {r('absolute')} AS absolute, {r('relative')} AS relative, {r('volatility')} AS volatility, {r('z')} AS z
FROM """
query("vwap_features", VW + "vwapf")
query("fine_vwap_features", VW + "finef")
cte("months", """
SELECT instrument, tf_s, count(DISTINCT CASE WHEN active THEN strftime(make_timestamp(t * 1000000), '%Y-%m') END) AS months
FROM robs GROUP BY 1, 2""")


def benchmark(name, features, group, grid):
    cte(f"sg_{name}", f"""
SELECT f.*, l.horizon_s, d.d AS direction, th.th AS threshold,
       CASE WHEN f.z < -th.th THEN 1 WHEN f.z > th.th THEN -1 END AS side,
       CASE WHEN f.z < -th.th THEN 1 WHEN f.z > th.th THEN -1 END * l.ret AS signed
FROM {features} f
CROSS JOIN (VALUES (1::DOUBLE), (1.5::DOUBLE), (2::DOUBLE), (2.5::DOUBLE)) th(th) CROSS JOIN (VALUES ('all'), ('long'), ('short')) d(d)
JOIN labels_long l ON l.instrument = f.instrument AND l.tf_s = f.tf_s AND l.t = f.t
WHERE f.active AND f.z IS NOT NULL AND (f.z < -th.th OR f.z > th.th)
  AND (d.d = 'all' OR (d.d = 'long' AND f.z < -th.th) OR (d.d = 'short' AND f.z > th.th))""")
    cte(f"bm_{name}", f"""
SELECT g.instrument, g.timeframe, g.{group}, g.lookback, g.threshold, CAST(g.horizon_s AS BIGINT) AS horizon_s, g.direction,
       count(s.z) AS signal_count, count(s.z) FILTER (s.side = 1) AS long_count, count(s.z) FILTER (s.side = -1) AS short_count,
       count(s.signed) AS valid_outcome_count, avg(s.signed) AS mean, median(s.signed) AS median,
       avg(CASE WHEN s.signed > 0 THEN 1::DOUBLE WHEN s.signed IS NOT NULL THEN 0::DOUBLE END) AS win_rate,
       CASE WHEN count(s.signed) >= 2 THEN stddev_samp(s.signed) END AS stddev, any_value(m.months) AS months
FROM (SELECT g0.*, th.th AS threshold, d.d AS direction, h.h AS horizon_s FROM ({grid}) g0
      CROSS JOIN (VALUES (1::DOUBLE), (1.5::DOUBLE), (2::DOUBLE), (2.5::DOUBLE)) th(th) CROSS JOIN (VALUES ('all'), ('long'), ('short')) d(d)
      CROSS JOIN (VALUES (7200), (14400), (28800), (86400)) h(h)) g
LEFT JOIN sg_{name} s ON s.instrument = g.instrument AND s.tf_s = g.tf_s AND s.lookback = g.lookback
     AND s.{group} IS NOT DISTINCT FROM g.{group} AND s.threshold = g.threshold AND s.direction = g.direction
     AND s.horizon_s = g.horizon_s
JOIN months m ON m.instrument = g.instrument AND m.tf_s = g.tf_s
WHERE g.horizon_s >= g.tf_s AND g.horizon_s % g.tf_s = 0
GROUP BY ALL""")
    query(f"{name}_benchmark", f"""
SELECT instrument, timeframe, {group}, lookback, threshold, horizon_s, direction, signal_count, long_count, short_count,
       valid_outcome_count, {r('mean')} AS mean, {r('median')} AS median, {r('win_rate')} AS win_rate, {r('stddev')} AS stddev,
       {r('stddev / sqrt(valid_outcome_count)')} AS standard_error,
       {r('CASE WHEN stddev > 0 THEN mean / (stddev / sqrt(valid_outcome_count)) END')} AS t_stat, months,
       signal_count - valid_outcome_count AS unavailable_count, {r('signal_count / months::DOUBLE')} AS monthly_frequency
FROM bm_{name}""")


cte("bandc", "SELECT *, unnest(list_prepend(NULL, sess)) AS context FROM bandf")
benchmark("band", "bandc", "context", "SELECT DISTINCT b.instrument, b.tf_s, b.timeframe, n.n AS lookback, c.c AS context FROM robs b, (VALUES (4), (8)) n(n), (VALUES (NULL), ('asia'), ('london'), ('new_york')) c(c)")
benchmark("vwap", "vwapf", "anchor", "SELECT DISTINCT instrument, tf_s, timeframe, lookback, anchor FROM vwapf")
benchmark("fine_vwap", "finef", "anchor", "SELECT DISTINCT instrument, tf_s, timeframe, lookback, anchor FROM finef")
query("replication_inventory", """
SELECT family, timeframe, session, count(*) AS rows, CAST(sum(CASE WHEN direction = 'all' THEN signal_count END) AS BIGINT) AS signals
FROM (SELECT 'vwap' AS family, timeframe, anchor AS session, direction, signal_count FROM bm_vwap
      UNION ALL SELECT 'vwap-fine', timeframe, anchor, direction, signal_count FROM bm_fine_vwap
      UNION ALL SELECT 'band', timeframe, context, direction, signal_count FROM bm_band) GROUP BY 1, 2, 3""")
query("exact_totals", f"""
SELECT instrument, timeframe, CAST(horizon_s AS BIGINT) AS horizon_s, count(ret) AS n, {r('sum(ret)')} AS total, {r('avg(ret)')} AS mean
FROM labels_long GROUP BY 1, 2, 3""")

# ================================================================ signals and paths
query("signal_grid", f"""
SELECT instrument, benchmark_family, signal_timeframe, session, direction, lookback, threshold, at, {r('p0')} AS p0, {r('e0')} AS e0,
       {r('d0')} AS d0, {r('z')} AS z FROM signals""")
query("state_sides", f"""
SELECT instrument, benchmark_family, signal_timeframe, session, direction, lookback, count(*) AS states,
       count(*) FILTER (qualifying) AS qualifying, {r('avg(z)')} AS mean_z FROM sides GROUP BY 1, 2, 3, 4, 5, 6""")
query("rearmed_events", f"""
SELECT candidate_event_id, instrument, benchmark_family, signal_timeframe, session, direction, lookback, at, {r('p0')} AS p0,
       {r('e0')} AS e0, {r('d0')} AS d0, {r('z')} AS z, signal_threshold FROM cands""")


def pathed(name, src, ident, steps):
    cte(name, f"""
SELECT s.*, (b.at - s.at) // 3600 AS m, b.high AS ph, b.low AS pl, b.close AS pc
FROM {src} s JOIN bars b ON b.instrument = s.instrument AND b.at > s.at AND b.at <= s.at + {steps} * 3600""")


cte("sig", "SELECT *, row_number() OVER () AS rid FROM signals")
pathed("sigp", "sig", "rid", 24)
_snap = ", ".join(f"max(CASE WHEN m = {h} THEN pc END) AS c{h}" for h in (1, 2, 4, 8, 24))
_lvl = ", ".join(f"min(CASE WHEN direction * (CASE WHEN direction > 0 THEN ph ELSE pl END - p0) / abs(d0) >= {v} THEN m END) AS t{round(v*100)}"
                 for v in (0.25, 0.5, 0.75, 1.0))
cte("sigd", f"""
SELECT s.*, coalesce(a.n, 0) = 24 AS full_path, a.* EXCLUDE (rid, n), p.x1, p.x2, p.x4, greatest(0, mf) AS mfe0, greatest(0, ma) AS mae0,
       array_to_string(list_filter(range(1, 25), lambda q: NOT list_contains(coalesce(a.ms, []), q)), ',') AS missing
FROM sig s LEFT JOIN (
 SELECT rid, count(*) AS n, list(m) AS ms, {_snap}, {_lvl}, max(f) AS mf, max(a) AS ma, arg_min(m, (-f, m)) AS tf, arg_min(m, (-a, m)) AS ta
 FROM (SELECT *, direction * (CASE WHEN direction > 0 THEN ph ELSE pl END - p0) AS f,
              -direction * (CASE WHEN direction > 0 THEN pl ELSE ph END - p0) AS a FROM sigp) GROUP BY rid) a USING (rid)
LEFT JOIN (SELECT s.rid, max(CASE WHEN s.at - b.at = 3600 THEN b.close END) AS x1, max(CASE WHEN s.at - b.at = 7200 THEN b.close END) AS x2,
                  max(CASE WHEN s.at - b.at = 14400 THEN b.close END) AS x4
           FROM sig s JOIN bars b ON b.instrument = s.instrument AND b.at IN (s.at - 3600, s.at - 7200, s.at - 14400) GROUP BY 1) p USING (rid)""")
_cols = []
for h in (1, 2, 4, 8, 24):
    _cols += [f"direction * (c{h} - p0) AS move_h{h}", f"direction * (c{h} / p0 - 1) * 10000 AS bps_h{h}",
              f"direction * (c{h} - p0) / pip AS pips_h{h}", f"direction * (c{h} - p0) / abs(d0) AS reversion_h{h}"]
_cols += [f"CASE WHEN full_path THEN t{v} END AS t{v}" for v in (25, 50, 75, 100)]
_cols += ["CASE WHEN full_path THEN mf / abs(d0) END AS max_reversion"]
for n, t in (("mae", "ta"), ("mfe", "tf")):
    _cols += [f"CASE WHEN full_path THEN {n}0 END AS {n}", f"CASE WHEN full_path THEN {n}0 / pip END AS {n}_pips",
              f"CASE WHEN full_path THEN {n}0 / p0 * 10000 END AS {n}_bps", f"CASE WHEN full_path THEN {n}0 / abs(d0) END AS {n}_fraction",
              f"CASE WHEN full_path THEN CASE WHEN {'ma' if n == 'mae' else 'mf'} = {n}0 THEN {t} ELSE 0 END END AS time_to_{n}"]
for h in (1, 2, 4):
    _cols += [f"p0 - x{h} AS pre_raw_h{h}", f"direction * (p0 - x{h}) AS pre_signed_h{h}", f"abs(p0 - x{h}) / abs(d0) AS impulse_h{h}"]
SETUP = "instrument, benchmark_family, signal_timeframe, session, direction, lookback, threshold"
cte("sigx", f"SELECT {SETUP}, at, pip, full_path AS path_complete, missing, " + ", ".join(_cols) + " FROM sigd")
_names = [c.rsplit(" AS ", 1)[1] for c in _cols]
_ints = {"t25", "t50", "t75", "t100", "time_to_mae", "time_to_mfe"}
query("path_diagnostics", f"SELECT {SETUP}, at, path_complete, missing, "
      + ", ".join(n if n in _ints else f"{r(n)} AS {n}" for n in _names) + " FROM sigx")
cte("dirp", "SELECT s.* , (b.at - s.at) // 3600 AS m, b.high AS ph, b.low AS pl, b.close AS pc FROM cands s JOIN bars b ON b.instrument = s.instrument AND b.at > s.at AND b.at <= s.at + 43200")
_d = []
for h in (3, 6, 12):
    c = f"max(CASE WHEN m = {h} THEN pc END)"
    _d += [(f"any_value(direction) * ({c} - any_value(p0))", f"move_h{h}"), (f"any_value(direction) * ({c} / any_value(p0) - 1) * 10000", f"bps_h{h}"),
           (f"any_value(direction) * ({c} - any_value(p0)) / any_value(pip)", f"pips_h{h}")]
for n, v in (("mae", "a"), ("mfe", "f")):
    _d += [(f"CASE WHEN count(*) = 12 THEN max({v}) END", n), (f"CASE WHEN count(*) = 12 THEN max({v}) / any_value(pip) END", f"{n}_pips")]
_d += [("CASE WHEN count(*) = 12 THEN max(f) / any_value(p0) * 10000 END", "mfe_bps")]
query("directional_paths", f"""
SELECT c.candidate_event_id, coalesce(path_complete, false) AS path_complete, d.* EXCLUDE (candidate_event_id, path_complete)
FROM cands c LEFT JOIN (
SELECT candidate_event_id, count(*) = 12 AS path_complete, {", ".join(f"{r(a)} AS {b}" for a, b in _d)},
       CASE WHEN count(*) = 12 THEN arg_min(m, (-a, m)) END AS time_to_mae, CASE WHEN count(*) = 12 THEN arg_min(m, (-f, m)) END AS time_to_mfe
FROM (SELECT *, greatest(0, direction * (ph - p0), direction * (pl - p0)) AS f,
             greatest(0, -direction * (ph - p0), -direction * (pl - p0)) AS a FROM dirp) GROUP BY 1) d USING (candidate_event_id)""")
_m = ["count(*) AS observations", "count(*) FILTER (path_complete) AS complete_paths",
      f"{r('count(*) FILTER (path_complete) / count(*)::DOUBLE')} AS complete_fraction"]
for h in (1, 2, 4, 8, 24):
    _m.append(f"count(pips_h{h}) AS n_h{h}")
    for k in ("bps", "pips", "reversion"):
        _m += [f"{r(f'avg({k}_h{h})')} AS mean_{k}_h{h}", f"{r(f'median({k}_h{h})')} AS {k}_h{h}_median"]
for v in (25, 50, 75, 100):
    _m += [f"count(t{v}) AS hit{v}_count", f"{r(f'avg(t{v})')} AS mean_t{v}", f"{r(f'median(t{v})')} AS t{v}_median",
           f"CASE WHEN count(*) FILTER (path_complete) > 0 THEN {r(f'count(t{v}) / (count(*) FILTER (path_complete))::DOUBLE')} END AS hit{v}_rate"]
for k in ("mae_bps", "mfe_bps", "time_to_mae", "time_to_mfe"):
    _m.append(f"{r(f'median({k})')} AS {k}_median")
for h in (1, 2, 4):
    _m += [f"count(impulse_h{h}) AS n_presignal_h{h}", f"{r(f'median(pre_raw_h{h} / pip)')} AS pre_raw_pips_h{h}_median",
           f"{r(f'median(pre_signed_h{h} / pip)')} AS pre_signed_pips_h{h}_median"]
    _m += [f"{r(f'quantile_cont(impulse_h{h}, {p})')} AS impulse_h{h}_{n}" for n, p in (("p25", .25), ("median", .5), ("p75", .75))]
for k in ("mae_pips", "mae_fraction", "mfe_pips", "mfe_fraction", "max_reversion"):
    _m += [f"{r(f'quantile_cont({k}, {p})')} AS {k}_{n}" for n, p in (("median", .5), ("p75", .75), ("p90", .9))]
query("path_matrix", f"SELECT {SETUP}, " + ", ".join(_m) + " FROM sigx GROUP BY 1, 2, 3, 4, 5, 6, 7")

# ================================================================ entries, races, outcomes
pathed("candp", "cands", "candidate_event_id", 32)
cte("candx", """
SELECT *, direction * (ph - p0) / abs(d0) AS f1, direction * (pl - p0) / abs(d0) AS f2,
       greatest(direction * (ph - p0) / abs(d0), direction * (pl - p0) / abs(d0)) AS fv,
       least(direction * (ph - p0) / abs(d0), direction * (pl - p0) / abs(d0)) AS av,
       direction * (pc - p0) > 0 AS reclaim FROM candp""")
cte("ext", "SELECT candidate_event_id, min(m) AS em FROM candx WHERE m <= 8 AND av <= -0.25 GROUP BY 1")
cte("waits", """
SELECT c.candidate_event_id, 'reclaim' AS entry_mode, 4 AS lim, (SELECT min(m) FROM candx x WHERE x.candidate_event_id = c.candidate_event_id AND m <= 4 AND reclaim) AS wait, NULL AS em FROM cands c
UNION ALL
SELECT c.candidate_event_id, 'extension-reclaim', 8, (SELECT min(m) FROM candx x WHERE x.candidate_event_id = c.candidate_event_id AND m <= 8 AND reclaim AND m >= e.em), e.em
FROM cands c LEFT JOIN ext e USING (candidate_event_id)""")
cte("ents", """
SELECT c.*, 'immediate' AS entry_mode, true AS executed, 0 AS wait, p0 AS entry_price, 0::DOUBLE AS r_at_entry,
       0::DOUBLE AS pre_entry_favorable, 0::DOUBLE AS pre_entry_adverse, NULL::BIGINT AS time_to_extension, NULL::BIGINT AS extension_to_entry
FROM cands c
UNION ALL BY NAME
SELECT c.*, w.entry_mode, w.wait IS NOT NULL AS executed, w.wait, e.pc AS entry_price, c.direction * (e.pc - c.p0) / abs(c.d0) AS r_at_entry,
       greatest(0, coalesce(x.fv, 0)) AS pre_entry_favorable, least(0, coalesce(x.av, 0)) AS pre_entry_adverse,
       CASE WHEN w.em <= coalesce(w.wait, w.lim) THEN w.em END AS time_to_extension, w.wait - w.em AS extension_to_entry
FROM cands c JOIN waits w USING (candidate_event_id)
LEFT JOIN candx e ON e.candidate_event_id = c.candidate_event_id AND e.m = w.wait
LEFT JOIN (SELECT w.candidate_event_id, w.entry_mode, max(fv) AS fv, min(av) AS av FROM waits w JOIN candx p
           ON p.candidate_event_id = w.candidate_event_id AND p.m <= coalesce(w.wait, w.lim) GROUP BY 1, 2) x
     ON x.candidate_event_id = c.candidate_event_id AND x.entry_mode = w.entry_mode""")
query("entry_rules", f"""
SELECT candidate_event_id, entry_mode, executed, wait, {r('entry_price')} AS entry_price, {r('r_at_entry')} AS r_at_entry,
       {r('pre_entry_favorable')} AS pre_entry_favorable, {r('pre_entry_adverse')} AS pre_entry_adverse, time_to_extension, extension_to_entry FROM ents""")
cte("hits", """
SELECT c.*, h.h AS horizon, r25, e25, r50, e50 FROM cands c CROSS JOIN (VALUES (2), (4), (8)) h(h) LEFT JOIN (
 SELECT candidate_event_id, g.h, min(CASE WHEN fv >= 0.25 THEN m END) AS r25, min(CASE WHEN av <= -0.25 THEN m END) AS e25,
        min(CASE WHEN fv >= 0.5 THEN m END) AS r50, min(CASE WHEN av <= -0.5 THEN m END) AS e50
 FROM candx, (VALUES (2), (4), (8)) g(h) WHERE m <= g.h GROUP BY 1, 2) x ON x.candidate_event_id = c.candidate_event_id AND x.h = h.h""")


def ordering(t):
    return (f"CASE WHEN r{t} IS NULL AND e{t} IS NULL THEN 'none' WHEN e{t} IS NULL OR r{t} < e{t} THEN 'reversion' "
            f"WHEN r{t} IS NULL OR e{t} < r{t} THEN 'extension' ELSE 'ambiguous_same_minute' END")


cte("races", f"SELECT *, {ordering(25)} AS o25, {ordering(50)} AS o50 FROM hits")
query("barrier_race", """
SELECT candidate_event_id, horizon, r25 AS time_to_reversion25, e25 AS time_to_extension25, o25 AS ordering_25,
       r50 AS time_to_reversion50, e50 AS time_to_extension50, o50 AS ordering_50 FROM races""")
REG = "instrument, benchmark_family, signal_timeframe, session, direction, lookback"


def nearest(x, p):
    return f"list_sort(list({x}) FILTER ({x} IS NOT NULL))[greatest(1, CAST(ceil({p}::DOUBLE * count({x})) AS INTEGER))]"


QS = (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95))
_rr = ["count(*) AS candidates"]
for t in (25, 50):
    for side, c in (("reversion", f"r{t}"), ("extension", f"e{t}")):
        _rr += [f"{r(f'count({c}) / count(*)::DOUBLE')} AS {side}{t}_hit_fraction", f"{nearest(c, 0.5)}::DOUBLE AS time_to_{side}{t}_median"]
    for o in ("reversion", "extension", "ambiguous_same_minute", "none"):
        inner = f"count(*) FILTER (o{t} = '{o}') / count(*)::DOUBLE"
        _rr.append(f"{r(inner)} AS order{t}_{o}")
query("race_report", f"SELECT {REG}, horizon, " + ", ".join(_rr) + " FROM races GROUP BY 1, 2, 3, 4, 5, 6, 7")
cte("barr", f"""
SELECT {REG}, unnest(['R>=+0.25', 'R>=+0.50', 'R<=-0.25', 'R<=-0.50']) AS barrier, unnest([r25, r50, e25, e50]) AS steps FROM races WHERE horizon = 8""")
query("first_passage_report", f"""
SELECT {REG}, barrier, count(*) AS candidates, count(steps) AS hits, {r('count(steps) / count(*)::DOUBLE')} AS hit_fraction,
       {r('avg(steps)')} AS mean_steps, """ + ", ".join(
    f"{r(f'count(*) FILTER (steps <= {m}) / count(*)::DOUBLE')} AS hit_by_{m}" for m in (2, 4, 8)) + ", "
    + ", ".join(f"{nearest('steps', p)}::DOUBLE AS {n}" for n, p in QS[:5]) + " FROM barr GROUP BY 1, 2, 3, 4, 5, 6, 7")
query("hazard_report", f"""
SELECT {REG}, barrier, lo, hi, count(*) FILTER (steps IS NULL OR steps > lo) AS at_risk,
       count(*) FILTER (steps > lo AND steps <= hi) AS new_hits,
       {r('coalesce(count(*) FILTER (steps > lo AND steps <= hi) / nullif(count(*) FILTER (steps IS NULL OR steps > lo), 0)::DOUBLE, 0)')} AS conditional_hit
FROM barr, (VALUES (0, 2), (2, 4), (4, 8)) i(lo, hi) GROUP BY ALL""")
_ew = ["count(*) AS candidates", "count(*) FILTER (executed) AS executed", "count(*) FILTER (NOT executed) AS no_entry",
       f"{r('count(*) FILTER (NOT executed) / count(*)::DOUBLE')} AS no_entry_fraction"]
for k, c in (("wait", "w1"), ("ext", "w2"), ("reclaim", "w3")):
    _ew.append(f"{r(f'avg({c})')} AS mean_{k}")
    _ew += [f"{nearest(c, p)}::DOUBLE AS {k}_{n}" for n, p in QS[:5]]
_ew += [f"{r(f'count(*) FILTER (w1 <= {m}) / count(*)::DOUBLE')} AS entry_by_{m}" for m in (1, 2, 4)]
_ew.append(f"{r('coalesce(count(*) FILTER (w3 = 0) / nullif(count(*) FILTER (executed), 0)::DOUBLE, 0)')} AS same_step_fraction")
query("entry_wait_report", f"SELECT {REG}, entry_mode, " + ", ".join(_ew) + """
FROM (SELECT *, CASE WHEN executed THEN wait END AS w1, CASE WHEN executed THEN time_to_extension END AS w2,
             CASE WHEN executed THEN extension_to_entry END AS w3 FROM ents WHERE entry_mode <> 'immediate')
GROUP BY 1, 2, 3, 4, 5, 6, 7""")
cte("entp", """
SELECT e.*, x.m - e.wait AS k, x.pc, x.fv, x.av,
       greatest(0, e.direction * (x.ph - e.entry_price), e.direction * (x.pl - e.entry_price)) AS fm,
       greatest(0, -e.direction * (x.ph - e.entry_price), -e.direction * (x.pl - e.entry_price)) AS am
FROM ents e JOIN candx x ON x.candidate_event_id = e.candidate_event_id AND x.m > e.wait AND x.m <= e.wait + 24 WHERE e.executed""")
cte("grid_cells", """
SELECT tp, sl, stop FROM (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1::DOUBLE)) a(tp),
 (VALUES (NULL::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1::DOUBLE)) b(sl), (VALUES (6), (12), (24)) c(stop)""")
cte("touch", """
SELECT candidate_event_id, entry_mode, tp, sl, stop, min(CASE WHEN fv >= tp THEN k END) AS tpk, min(CASE WHEN av <= -sl THEN k END) AS slk,
       max(CASE WHEN k = stop THEN pc END) AS dc
FROM entp, grid_cells WHERE k <= stop GROUP BY ALL""")
cte("cellx", """
SELECT e.*, g.tp, g.sl, g.stop, t.tpk, t.slk, t.dc, least(t.tpk, t.slk) AS tk,
       CASE WHEN NOT e.executed THEN 'no_entry' WHEN e.r_at_entry >= g.tp THEN 'passed' ELSE 'executed' END AS status
FROM ents e CROSS JOIN grid_cells g LEFT JOIN touch t ON t.candidate_event_id = e.candidate_event_id AND t.entry_mode = e.entry_mode
  AND t.tp = g.tp AND t.sl IS NOT DISTINCT FROM g.sl AND t.stop = g.stop""")
cte("prior", """
SELECT c.candidate_event_id, c.entry_mode, c.tp, c.sl, c.stop, max(p.fm) AS f, max(p.am) AS a, arg_min(p.k, (-p.fm, p.k)) AS tf, arg_min(p.k, (-p.am, p.k)) AS ta
FROM cellx c JOIN entp p ON p.candidate_event_id = c.candidate_event_id AND p.entry_mode = c.entry_mode AND p.k < coalesce(c.tk, c.stop + 1)
WHERE c.status = 'executed' GROUP BY ALL""")
cte("outs", """
SELECT *, CASE WHEN complete THEN direction * (adv - entry_price) / pip END AS pips_adverse,
       CASE WHEN complete THEN direction * (fav - entry_price) / pip END AS pips_favorable,
       CASE WHEN complete THEN direction * (adv - entry_price) / entry_price * 10000 END AS bp_adverse,
       CASE WHEN complete THEN direction * (adv - entry_price) / abs(d0) END AS fraction_adverse,
       CASE WHEN status = 'executed' THEN greatest(a0, xa) END AS mae, CASE WHEN status = 'executed' THEN greatest(f0, xf) END AS mfe,
       CASE WHEN complete THEN greatest(a0, xa, coalesce(fa, 0)) END AS mae_bound, CASE WHEN complete THEN greatest(f0, xf, coalesce(ff, 0)) END AS mfe_bound,
       CASE WHEN status = 'executed' THEN CASE WHEN xa > a0 THEN tk ELSE ta0 END END AS time_to_mae,
       CASE WHEN status = 'executed' THEN CASE WHEN xf > f0 THEN tk ELSE tf0 END END AS time_to_mfe,
       0.75::DOUBLE AS signal_threshold, 'none' AS filter_family, 'none-v1' AS filter_spec_id,
       coalesce(exit_reason = 'ambiguous', false) AS ambiguous, CASE WHEN complete THEN coalesce(tk, stop) END AS holding
FROM (SELECT *, CASE WHEN complete THEN CASE WHEN tk IS NULL THEN 'time_stop' WHEN tpk = slk THEN 'ambiguous' WHEN tpk = tk THEN 'tp' ELSE 'sl' END END AS exit_reason,
  CASE WHEN slk = tk THEN slp WHEN tpk = tk THEN tpp ELSE dc END AS adv, CASE WHEN tpk = tk THEN tpp WHEN slk = tk THEN slp ELSE dc END AS fav,
  CASE WHEN tpk = tk AND tpk IS DISTINCT FROM slk THEN greatest(0, direction * (tpp - entry_price)) ELSE 0 END AS xf,
  CASE WHEN slk = tk AND tpk IS DISTINCT FROM slk THEN greatest(0, -direction * (slp - entry_price)) ELSE 0 END AS xa
 FROM (SELECT c.*, c.status = 'executed' AND (c.tk IS NOT NULL OR c.dc IS NOT NULL) AS complete, c.p0 + c.direction * c.tp * abs(c.d0) AS tpp,
        c.p0 - c.direction * c.sl * abs(c.d0) AS slp, coalesce(p.f, 0) AS f0, coalesce(p.a, 0) AS a0,
        CASE WHEN coalesce(p.f, 0) > 0 THEN p.tf ELSE 0 END AS tf0, CASE WHEN coalesce(p.a, 0) > 0 THEN p.ta ELSE 0 END AS ta0, b.fm AS ff, b.am AS fa
  FROM cellx c LEFT JOIN prior p ON p.candidate_event_id = c.candidate_event_id AND p.entry_mode = c.entry_mode AND p.tp = c.tp
       AND p.sl IS NOT DISTINCT FROM c.sl AND p.stop = c.stop
  LEFT JOIN entp b ON b.candidate_event_id = c.candidate_event_id AND b.entry_mode = c.entry_mode AND b.k = c.tk))""")
_oc = ["pips_adverse", "pips_favorable", "bp_adverse", "fraction_adverse", "mae", "mfe", "mae_bound", "mfe_bound"]
query("barrier_outcomes", "SELECT candidate_event_id, entry_mode, tp, sl, stop, status, complete, exit_reason, holding, "
      + ", ".join(f"{r(c)} AS {c}" for c in _oc) + ", time_to_mae, time_to_mfe FROM outs")
CONFIG = ("instrument, benchmark_family, signal_timeframe, session, direction, lookback, "
          "signal_threshold, filter_family, filter_spec_id, entry_mode, tp, sl, stop")
N = "count(*) FILTER (complete)"


def frac(cond, whole=N):
    return r(f"coalesce(count(*) FILTER ({cond}) / nullif({whole}, 0)::DOUBLE, 0)")


_om = ["count(DISTINCT candidate_event_id) AS candidates", "count(*) FILTER (status = 'executed') AS executed",
       "count(*) FILTER (status = 'no_entry') AS no_entry", "count(*) FILTER (status = 'passed') AS passed",
       f"{N} AS complete_trades", "count(*) FILTER (status = 'executed' AND NOT complete) AS incomplete_trades",
       "count(*) FILTER (ambiguous) AS ambiguous_count", f"{frac('ambiguous')} AS ambiguous_fraction"]
for n, cond in (("tp", "exit_reason = 'tp'"), ("sl", "exit_reason IN ('sl', 'ambiguous')"), ("time_stop", "exit_reason = 'time_stop'")):
    _om += [f"count(*) FILTER ({cond}) AS {n}_count", f"{frac(cond)} AS {n}_fraction"]
_om += [f"{r('avg(pips_adverse)')} AS mean_pips", f"{r('avg(pips_favorable)')} AS mean_pips_favorable", f"{r('avg(bp_adverse)')} AS mean_bp",
        f"{frac('pips_adverse > 0')} AS win_fraction", f"{frac('pips_adverse < 0')} AS loss_fraction", f"{frac('pips_adverse = 0')} AS zero_fraction"]
_om += [f"{r('avg(CASE WHEN complete THEN mae / pip END)')} AS mean_mae_pips", f"{r('avg(CASE WHEN complete THEN mfe / pip END)')} AS mean_mfe_pips",
        f"{r('avg(CASE WHEN complete THEN wait END)')} AS mean_wait"]
for k, x in (("pips_adverse", "pips_adverse"), ("bp_adverse", "bp_adverse"), ("mae_pips", "q_mae"), ("mfe_pips", "q_mfe"), ("holding", "holding"),
             ("wait", "q_wait"), ("r_at_entry", "q_r"), ("pre_entry_adverse", "q_pre")):
    _om += [f"{r(nearest(x, p))} AS {k}_{n}" for n, p in QS]
OUTQ = """(SELECT *, CASE WHEN complete THEN mae / pip END AS q_mae, CASE WHEN complete THEN mfe / pip END AS q_mfe,
 CASE WHEN complete THEN wait END AS q_wait, CASE WHEN complete THEN r_at_entry END AS q_r, CASE WHEN complete THEN pre_entry_adverse END AS q_pre FROM outs)"""
query("outcome_matrix", f"SELECT {CONFIG}, " + ", ".join(_om) + f" FROM {OUTQ} GROUP BY ALL")
cte("odist", f"""
SELECT {CONFIG}, unnest(['gross_pips', 'mae_pips', 'mfe_pips', 'holding']) AS metric, unnest([pips_adverse, mae / pip, mfe / pip, holding::DOUBLE]) AS x
FROM outs WHERE complete""")
query("outcome_distributions", f"SELECT {CONFIG}, metric, sample_count, unnest(['p10','p25','median','p75','p90','p95']) AS quantile, unnest(v) AS value FROM (SELECT {CONFIG}, metric, count(x) AS sample_count, ["
      + ", ".join(r(nearest("x", p)) for _, p in QS) + "] AS v FROM odist GROUP BY ALL)")
query("trade_validation", """
SELECT instrument, CASE WHEN NOT complete THEN 'incomplete' WHEN NOT (isfinite(pips_adverse) AND isfinite(pips_favorable)) THEN 'not_finite' ELSE 'valid' END AS verdict,
 count(*) AS rows FROM outs GROUP BY 1, 2""")
query("run_totals", """
SELECT instrument, count(DISTINCT candidate_event_id) AS candidates, count(*) FILTER (status = 'no_entry') AS no_entry,
 count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'executed') AS executed,
 count(*) FILTER (status = 'executed' AND NOT complete) AS incomplete, count(*) FILTER (ambiguous) AS ambiguous FROM outs GROUP BY 1""")

# ================================================================ costs
cte("costs", f"""
SELECT instrument, session, st AS statistic, sl.s AS slippage, v / {PIP} AS spread,
       CASE WHEN split_part(instrument, '.', 1) IN ('purchase', 'signup') THEN CASE WHEN session = 'asia' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END ELSE 0.07::DOUBLE END AS commission
FROM (SELECT instrument, session, unnest(['mean', 'p75', 'p90', 'p95']) AS st, unnest([mean, p75, p90, p95]) AS v FROM spreads),
     (VALUES (0::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) sl(s)""")


def net(g):
    v = f"({g} - spread - slippage)"
    return f"CASE WHEN converted AND {v} > 0 THEN {v} * 0.993::DOUBLE WHEN converted AND {v} < 0 THEN {v} * 1.007::DOUBLE ELSE {v} END - commission"


cte("costless", """
SELECT DISTINCT o.instrument FROM (SELECT DISTINCT instrument, coalesce(session, 'overall') AS session FROM outs WHERE complete) o
LEFT JOIN (SELECT DISTINCT instrument, session FROM costs) k ON k.instrument = o.instrument AND k.session = o.session WHERE k.session IS NULL""")
cte("priced", f"""
SELECT *, {net('pips_adverse')} AS net_adverse, {net('pips_favorable')} AS net_favorable
FROM (SELECT o.*, CASE WHEN x.instrument IS NULL THEN 'covered' ELSE 'blocked' END AS cost_status, c.statistic, c.slippage, c.spread, c.commission
      FROM outs o LEFT JOIN costless x ON x.instrument = o.instrument
      LEFT JOIN costs c ON x.instrument IS NULL AND c.instrument = o.instrument AND c.session = coalesce(o.session, 'overall') WHERE o.complete)""")
query("cost_coverage", """
SELECT instrument, CASE WHEN instrument IN (SELECT c.instrument FROM cands c LEFT JOIN
   (SELECT DISTINCT instrument, session FROM costs WHERE NOT (session = 'asia' AND instrument LIKE 'signup%')) k
   ON k.instrument = c.instrument AND k.session = coalesce(c.session, 'overall') WHERE k.session IS NULL) THEN 'blocked' ELSE 'covered' END AS cost_status,
   count(*) AS candidates FROM cands GROUP BY 1, 2""")
query("priced_scenarios", f"""
SELECT instrument, session, entry_mode, statistic, slippage, cost_status, count(*) AS rows, {r('sum(net_adverse)')} AS net_adverse, {r('sum(net_favorable)')} AS net_favorable,
       {r('avg(spread + slippage + commission)')} AS modeled_cost, {r('max(spread)')} AS spread, {r('max(commission)')} AS commission
FROM priced GROUP BY 1, 2, 3, 4, 5, 6""")
CC = CONFIG + ", statistic, slippage"
cte("ccells", f"""
SELECT {CC}, count(*) AS trades, avg(net_adverse) AS mean_net, avg(net_favorable) AS mean_net_favorable,
 avg(CASE WHEN net_adverse > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS win_fraction, avg(CASE WHEN net_adverse < 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS loss_fraction,
 avg(CASE WHEN net_adverse = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS zero_fraction,
 coalesce(sum(CASE WHEN net_adverse > 0 THEN net_adverse END), 0) AS gains, coalesce(-sum(CASE WHEN net_adverse < 0 THEN net_adverse END), 0) AS losses,
 avg(pips_adverse) AS mean_gross, avg(spread + slippage + commission) AS mean_cost, max(spread + commission) AS fixed0, """
    + ", ".join(f"{nearest('net_adverse', p)} AS {n}" for n, p in QS[:5]) + " FROM priced GROUP BY ALL")
PF = "CASE WHEN losses > 0 THEN " + r('gains / losses') + " WHEN gains > 0 THEN 'inf'::DOUBLE ELSE 0::DOUBLE END"
def even(keys):
    """Slippage at which the mean net result crosses zero, per keys."""
    return f"""
WITH t AS (SELECT {keys}, pips_adverse - spread AS x, commission AS cm, converted FROM priced WHERE slippage = 0 AND cost_status = 'covered'),
 g AS (SELECT {keys}, count(*) AS n, sum(x) AS sx, max(cm) AS cm, bool_or(converted) AS cv, sum(CASE WHEN x > 0 THEN x * 0.993::DOUBLE ELSE x * 1.007::DOUBLE END) AS v0 FROM t GROUP BY ALL),
 k AS (SELECT {keys}, x, count(*) OVER w AS nl, sum(x) OVER w AS xl FROM t WHERE converted
       WINDOW w AS (PARTITION BY {keys} ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 s AS (SELECT {", ".join("g." + c for c in keys.split(", "))}, max(k.nl) AS nl, arg_max(k.xl, k.nl) AS xl FROM g JOIN k
       ON {" AND ".join(f"k.{c} IS NOT DISTINCT FROM g.{c}" for c in keys.split(", "))}
       WHERE 0.993::DOUBLE * (g.sx - k.xl - (g.n - k.nl) * k.x) + 1.007::DOUBLE * (k.xl - k.nl * k.x) > g.cm * g.n GROUP BY ALL),
 v AS (SELECT g.*, coalesce(s.nl, 0) AS nl, coalesce(s.xl, 0) AS xl, CASE WHEN cv THEN v0 / n - cm ELSE sx / n - cm END AS mean0
       FROM g LEFT JOIN s ON {" AND ".join(f"s.{c} IS NOT DISTINCT FROM g.{c}" for c in keys.split(", "))})
SELECT {keys}, b FROM (SELECT *, CASE WHEN mean0 <= 0 THEN 0 WHEN cv
 THEN (0.993::DOUBLE * (sx - xl) + 1.007::DOUBLE * xl - cm * n) / (0.993::DOUBLE * (n - nl) + 1.007::DOUBLE * nl) ELSE mean0 END AS b FROM v)"""


BEK = "instrument, session, entry_mode, tp, statistic"
query("break_even", f"SELECT {BEK}, {r('b')} AS break_even_slippage FROM ({even(BEK)})")

query("cost_cells", f"SELECT {CC.replace(', ', ', c.').replace('instrument', 'c.instrument', 1)}, trades, " + ", ".join(f"{r(c)} AS {c}" for c in (
    "mean_net", "mean_net_favorable", "win_fraction", "loss_fraction", "zero_fraction", "mean_gross", "mean_cost", *[n for n, _ in QS[:5]]))
      + f", {PF} AS profit_factor, {r('mean_gross - fixed0 - slippage')} AS headroom, {r('b')} AS break_even_slippage,"
      + f" {r('CASE WHEN b IS NOT NULL THEN greatest(0::DOUBLE, b - slippage) END')} AS extra_slippage"
      + f" FROM ccells c LEFT JOIN ({even(CONFIG + ', statistic')}) e ON "
      + " AND ".join(f"e.{x} IS NOT DISTINCT FROM c.{x}" for x in (CONFIG + ", statistic").split(", ")))
query("regime_breadth", f"""
SELECT instrument, signal_timeframe, session, direction, entry_mode, statistic, slippage, count(*) AS cells, count(*) FILTER (mean_net > 0) AS net_positive,
 {r('count(*) FILTER (mean_net > 0) / count(*)::DOUBLE')} AS net_positive_fraction, count(*) FILTER (mean_gross > 0) AS gross_positive,
 {r('coalesce(count(*) FILTER (mean_gross > 0 AND mean_net > 0) / nullif(count(*) FILTER (mean_gross > 0), 0)::DOUBLE, 0)')} AS surviving_fraction
FROM ccells GROUP BY 1, 2, 3, 4, 5, 6, 7""")
# ================================================================ families
SCOPE = "signal_timeframe = '2h' AND session = 'london' AND direction = -1"
cte("scands", f"SELECT * FROM cands WHERE {SCOPE}")


def _overlap(keys, definition, lookback):
    return f"""
SELECT instrument, '{definition}' AS definition, {lookback} AS lookback, CAST(sum(b) AS BIGINT) AS band_clocks, CAST(sum(v) AS BIGINT) AS vwap_clocks,
 CAST(sum(b * v) AS BIGINT) AS both_clocks, CAST(sum(b * (1 - v)) AS BIGINT) AS band_only_clocks,
 {r('sum(b * (1 - v)) / nullif(sum(b), 0)::DOUBLE')} AS band_only_rate, {r('sum(b * v) / nullif(sum(b), 0)::DOUBLE')} AS band_overlap_rate,
 {r('sum(b * v) / nullif(sum(v), 0)::DOUBLE')} AS vwap_overlap_rate, count(*) AS union_clocks
FROM (SELECT {keys}, max(CASE WHEN benchmark_family = 'band' THEN 1 ELSE 0 END) AS b, max(CASE WHEN benchmark_family <> 'band' THEN 1 ELSE 0 END) AS v
      FROM scands GROUP BY ALL) GROUP BY 1, 2, 3"""


query("family_overlap", _overlap("instrument, lookback, at", "strict-specification", "CAST(lookback AS VARCHAR)")
      + " UNION ALL " + _overlap("instrument, at", "execution-level", "'all'"))
cte("finished", "SELECT * FROM outs WHERE complete")
cte("imm", "SELECT * FROM finished WHERE entry_mode = 'immediate'")
cte("classed", f"""
SELECT t.*, unnest(CASE WHEN benchmark_family = 'band' THEN ['band-standalone', CASE WHEN v THEN 'intersection' ELSE 'band-only' END]
                   ELSE [CASE WHEN b THEN 'intersection' ELSE 'vwap-only' END] END) AS event_class
FROM (SELECT * FROM imm WHERE {SCOPE}) t
JOIN (SELECT instrument, at, bool_or(benchmark_family = 'band') AS b, bool_or(benchmark_family <> 'band') AS v FROM imm WHERE {SCOPE} GROUP BY 1, 2) f
ON f.instrument = t.instrument AND f.at = t.at""")


def streak(src, keys, value):
    ks = ", ".join(keys)
    return f"""
SELECT {ks}, max(n) AS max_losing_streak FROM (
 SELECT {ks}, grp, sum(loss) AS n FROM (
  SELECT {ks}, loss, row_number() OVER (PARTITION BY {ks} ORDER BY at, candidate_event_id)
         - row_number() OVER (PARTITION BY {ks}, loss ORDER BY at, candidate_event_id) AS grp
  FROM (SELECT *, CASE WHEN {value} < 0 THEN 1 ELSE 0 END AS loss FROM {src})) GROUP BY {ks}, grp, loss) GROUP BY {ks}"""


ECK = ["instrument", "event_class", "benchmark_family", "tp", "sl", "stop"]


def on(a, b, keys):
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


query("event_class_metrics", f"""
SELECT b.*, {r('m.sd')} AS monthly_std, m.pm AS positive_months, m.tm AS total_months, m.wm AS worst_month, {r('m.wv')} AS worst_month_mean,
       CAST(s.max_losing_streak AS BIGINT) AS max_losing_streak
FROM (SELECT {", ".join(ECK)}, count(*) AS trades, count(DISTINCT candidate_event_id) AS candidates, count(DISTINCT at) AS clocks,
 {r('count(*) / 12::DOUBLE')} AS trades_per_month, {r('avg(pips_adverse)')} AS expectancy,
 {r('sum(CASE WHEN pips_adverse > 0 THEN pips_adverse ELSE 0 END) / nullif(-sum(CASE WHEN pips_adverse < 0 THEN pips_adverse ELSE 0 END), 0)')} AS profit_factor,
 {r('avg(CASE WHEN pips_adverse > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END)')} AS win_rate FROM classed GROUP BY ALL) b
JOIN (SELECT {", ".join(ECK)}, stddev_samp(v) AS sd, count(*) FILTER (v > 0) AS pm, count(*) AS tm, arg_min(mo, (v, mo)) AS wm, min(v) AS wv
      FROM (SELECT {", ".join(ECK)}, strftime(make_timestamp(at * 1000000), '%Y-%m') AS mo, avg(pips_adverse) AS v FROM classed GROUP BY ALL) GROUP BY ALL) m
  ON {on('m', 'b', ECK)}
JOIN ({streak('classed', ECK, 'pips_adverse')}) s ON {on('s', 'b', ECK)}""")
query("plateau_breadth", f"""
SELECT instrument, event_class, benchmark_family, statistic, slippage, count(*) AS cells, count(*) FILTER (e > 0) AS net_positive,
 {r('count(*) FILTER (e > 0) / count(*)::DOUBLE')} AS net_positive_fraction, count(*) FILTER (g > 0) AS gross_positive,
 {r('coalesce(count(*) FILTER (g > 0 AND e > 0) / nullif(count(*) FILTER (g > 0), 0)::DOUBLE, 0)')} AS surviving_fraction
FROM (SELECT instrument, event_class, benchmark_family, statistic, slippage, lookback, tp, sl, stop, avg(pips_adverse) AS g, avg({net('pips_adverse')}) AS e
      FROM (SELECT t.*, k.statistic, k.slippage, k.spread, k.commission FROM classed t
            LEFT JOIN costs k ON k.instrument = t.instrument AND k.session = t.session) GROUP BY ALL) GROUP BY 1, 2, 3, 4, 5""")
CORK = ["instrument", "signal_timeframe", "session", "direction", "lookback", "tp", "sl", "stop"]
query("outcome_correlation", f"""
SELECT {", ".join("b." + k for k in CORK)}, v.benchmark_family AS vwap_family, count(*) AS pairs,
       CASE WHEN max(b.pips_adverse) > min(b.pips_adverse) AND max(v.pips_adverse) > min(v.pips_adverse)
            THEN {r('corr(b.pips_adverse, v.pips_adverse)')} END AS correlation
FROM imm b JOIN imm v ON {on('b', 'v', CORK + ['at'])} AND b.benchmark_family = 'band' AND v.benchmark_family <> 'band'
WHERE b.session IS NOT NULL GROUP BY ALL""")
cte("cb", "SELECT DISTINCT instrument, at FROM cands WHERE benchmark_family = 'band'")
cte("cv", "SELECT DISTINCT instrument, at FROM cands WHERE benchmark_family = 'vwap'")
query("clock_sets", " UNION ALL ".join(
    f"SELECT instrument, count(*) AS clocks, '{n}' AS \"set\" FROM ({q}) GROUP BY 1" for n, q in (
        ("band", "SELECT * FROM cb"), ("vwap", "SELECT * FROM cv"), ("union", "SELECT * FROM cb UNION SELECT * FROM cv"),
        ("both", "SELECT * FROM cb INTERSECT SELECT * FROM cv"), ("band_only", "SELECT * FROM cb EXCEPT SELECT * FROM cv"),
        ("vwap_only", "SELECT * FROM cv EXCEPT SELECT * FROM cb"))))
SETK = ["instrument", "signal_timeframe", "session", "direction", "benchmark_family", "lookback", "signal_threshold", "entry_mode", "filter_family", "filter_spec_id"]
EXITK = ["tp", "sl", "stop"]
cte("atlas", f"""
SELECT candidate_event_id, at, {", ".join(SETK + EXITK)}, 'gross' AS scenario, pips_adverse AS value FROM finished
UNION ALL
SELECT candidate_event_id, at, {", ".join(SETK + EXITK)},
       CASE statistic WHEN 'mean' THEN 'mean+0.00' WHEN 'p75' THEN 'p75+0.10' WHEN 'p90' THEN 'p90+0.25' ELSE 'p95+0.50' END, net_adverse
FROM priced WHERE (statistic = 'mean' AND slippage = 0) OR (statistic = 'p75' AND slippage = 0.1::DOUBLE)
  OR (statistic = 'p90' AND slippage = 0.25::DOUBLE) OR (statistic = 'p95' AND slippage = 0.5::DOUBLE)""")
ATK = [*SETK, *EXITK, "scenario"]
query("atlas_cells", f"""
SELECT b.* EXCLUDE (gains, losses), {PF} AS profit_factor, m.* EXCLUDE ({", ".join(ATK)}), CAST(s.max_losing_streak AS BIGINT) AS max_losing_streak
FROM (SELECT {", ".join(ATK)}, count(*) AS trades, {r('count(*) / 12::DOUBLE')} AS trades_per_month, count(DISTINCT candidate_event_id) AS candidates,
 {r('avg(value)')} AS expectancy, {r('sum(value)')} AS total, {r('avg(CASE WHEN value > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END)')} AS win_rate,
 sum(CASE WHEN value > 0 THEN value ELSE 0 END) AS gains, -sum(CASE WHEN value < 0 THEN value ELSE 0 END) AS losses FROM atlas GROUP BY ALL) b
JOIN (SELECT {", ".join(ATK)}, count(*) FILTER (v > 0) AS positive_months, count(*) FILTER (v < 0) AS negative_months, 12 - count(v) AS no_trade_months,
 {r('min(coalesce(v, 0))')} AS worst_month, {r('max(coalesce(v, 0))')} AS best_month, {r('avg(coalesce(v, 0))')} AS monthly_mean, {r('stddev_pop(coalesce(v, 0))')} AS monthly_std
 FROM (SELECT {", ".join("k." + x for x in ATK)}, k.mo, x.v FROM (SELECT DISTINCT {", ".join(ATK)}, mo FROM atlas, range(1, 13) g(mo)) k
       LEFT JOIN (SELECT {", ".join(ATK)}, month(make_timestamp(at * 1000000)) AS mo, sum(value) AS v FROM atlas GROUP BY ALL) x ON {on('x', 'k', ATK + ['mo'])})
 GROUP BY {", ".join(ATK)}) m ON {on('m', 'b', ATK)}
JOIN ({streak('atlas', ATK, 'value')}) s ON {on('s', 'b', ATK)}""")
cte("acell", f"SELECT {', '.join(ATK)}, avg(value) AS expectancy, count(*) AS trades FROM atlas GROUP BY ALL")
query("setup_families", f"""
SELECT c.*, t.candidates, t.opportunities FROM (
 SELECT {", ".join(SETK)}, scenario, count(*) AS exit_cells, count(*) FILTER (expectancy > 0) AS positive_cells,
  {r('count(*) FILTER (expectancy > 0) / count(*)::DOUBLE')} AS positive_fraction, {r('min(expectancy)')} AS min_expectancy, {r('max(expectancy)')} AS max_expectancy,
  {r('median(expectancy)')} AS median_expectancy FROM acell GROUP BY {", ".join(SETK)}, scenario) c
JOIN (SELECT {", ".join(SETK)}, count(DISTINCT candidate_event_id) AS candidates, count(DISTINCT (instrument, signal_timeframe, at, direction)) AS opportunities
      FROM finished GROUP BY {", ".join(SETK)}) t ON {on('t', 'c', SETK)}""")
query("execution_families", """
SELECT instrument, signal_timeframe, session, direction, entry_mode, count(DISTINCT (instrument, signal_timeframe, at, direction)) AS opportunities,
 count(DISTINCT (benchmark_family, lookback)) AS memberships,
 array_to_string(list_sort(list(DISTINCT benchmark_family)), '|') AS variants, array_to_string(list_sort(list(DISTINCT CAST(lookback AS VARCHAR))), '|') AS lookbacks
FROM finished GROUP BY 1, 2, 3, 4, 5""")
HYK = [*SETK[1:], *EXITK]
cte("hyp", f"""
SELECT *, printf('H%04d', dense_rank() OVER (ORDER BY {", ".join(k + " NULLS FIRST" for k in HYK)})) AS hypothesis_id FROM acell""")
query("hypotheses", f"""
SELECT {", ".join(HYK)}, scenario, count(DISTINCT instrument) AS instruments_tested, count(*) FILTER (expectancy > 0) AS instruments_positive, hypothesis_id
FROM hyp GROUP BY ALL""")
query("hypothesis_support", f"SELECT hypothesis_id, scenario, instrument, {r('expectancy')} AS expectancy FROM hyp")
query("reference_overlap", f"""
WITH ex AS (SELECT DISTINCT {", ".join(SETK)}, at FROM finished),
 rf AS (SELECT DISTINCT instrument, signal_timeframe, at, direction FROM finished WHERE {SCOPE} AND benchmark_family <> 'band')
SELECT {", ".join(SETK)}, opportunities, intersection, {r('intersection / opportunities::DOUBLE')} AS overlap_rate,
 opportunities - intersection AS unique_to_setup, (SELECT count(*) FROM rf) - intersection AS reference_only
FROM (SELECT {", ".join("e." + k for k in SETK)}, count(*) AS opportunities, count(f.at) AS intersection FROM ex e LEFT JOIN rf f
 ON f.instrument = e.instrument AND f.signal_timeframe = e.signal_timeframe AND f.at = e.at AND f.direction = e.direction GROUP BY {", ".join("e." + k for k in SETK)})""")

# ================================================================ corpus
LANES = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT) AS l{i}" for i in range(4))
WHOLE = "sha256(concat_ws('|', children::VARCHAR, coalesce(l0, 0)::VARCHAR, coalesce(l1, 0)::VARCHAR, coalesce(l2, 0)::VARCHAR, coalesce(l3, 0)::VARCHAR))"
TICKTEXT = " || ".join(f"length(x.{c}) || ':' || x.{c}" for c in ("a", "b", "c"))
BELOW = "string_agg(period || '=' || sha256, '|' ORDER BY period)"


def nodes(tag, where):
    cte(f"cday{tag}", f"""
SELECT series, period, children, {WHOLE} AS sha256 FROM (SELECT series, period, count(*) AS children, {LANES} FROM (
 SELECT instrument AS series, strftime(ts, '%Y-%m-%d') AS period, sha256({TICKTEXT}) AS h
 FROM (SELECT *, event_id::VARCHAR AS a, epoch_us(ts)::VARCHAR AS b, ticks::VARCHAR AS c FROM ticks WHERE {where}) x) GROUP BY 1, 2)""")
    cte(f"cmon{tag}", f"SELECT series, substr(period, 1, 7) AS period, count(*) AS children, sha256({BELOW}) AS sha256 FROM cday{tag} GROUP BY 1, 2")
    cte(f"cyear{tag}", f"SELECT series, substr(period, 1, 4) AS period, count(*) AS children, sha256({BELOW}) AS sha256 FROM cmon{tag} GROUP BY 1, 2")
    cte(f"cser{tag}", f"SELECT series, NULL::VARCHAR AS period, count(*) AS children, sha256({BELOW}) AS sha256 FROM cyear{tag} GROUP BY 1")
    cte(f"croot{tag}", f"SELECT NULL::VARCHAR AS series, NULL::VARCHAR AS period, children, {WHOLE} AS sha256 FROM (SELECT count(*) AS children, {LANES} FROM (SELECT sha256(series || '=' || sha256) AS h FROM cser{tag}))")


nodes("now", "true")
nodes("old", "ts < TIMESTAMP '2024-01-15 12:00:00'")
query("corpus_identity", " UNION ALL ".join(
    f"SELECT '{level}' AS level, series, period, children, sha256 FROM c{t}now"
    for level, t in (("day", "day"), ("month", "mon"), ("year", "year"), ("series", "ser"), ("corpus", "root"))))
cte("cdiff", """
SELECT coalesce(n.series, o.series) AS series, CASE WHEN o.sha256 IS NULL THEN 'added' WHEN n.sha256 IS NULL THEN 'missing' WHEN n.sha256 <> o.sha256 THEN 'changed' END AS verdict
FROM cdaynow n FULL JOIN cdayold o ON o.series = n.series AND o.period = n.period""")
_cd = ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}_days" for v in ("added", "missing", "changed"))
query("corpus_recheck", f"""
SELECT 'series' AS level, s.series, d.added_days, d.missing_days, d.changed_days, s.sha256, true AS verified FROM csernow s JOIN (SELECT series, {_cd} FROM cdiff GROUP BY 1) d USING (series)
UNION ALL SELECT 'corpus', NULL, d.added_days, d.missing_days, d.changed_days, r.sha256, true FROM crootnow r, (SELECT {_cd} FROM cdiff) d""")
query("declared_parts", """
SELECT part AS declared, count(*) AS rows, count(*) FILTER (instrument <> part) AS mixed_rows, max(CASE WHEN instrument <> part THEN instrument END) AS example,
 CASE WHEN count(*) FILTER (instrument <> part) > 0 THEN 'mixed' ELSE 'clean' END AS verdict
FROM (SELECT *, CASE WHEN raw_spread < 0 THEN split_part(instrument, '.', 1) || '.0' ELSE instrument END AS part FROM ticks) GROUP BY 1""")

_mday = lambda c: f"strftime(make_timestamp({c} * 86400000000), '%Y-%m-%d')"
query("corpus_registry", f"""
WITH m AS (SELECT instrument, split_part(instrument, '.', 1) AS k, count(*) AS n, min(s // 86400) AS a, max(s // 86400) AS b,
                  min(CASE WHEN raw_spread >= 0 THEN s // 86400 END) AS qa, max(CASE WHEN raw_spread >= 0 THEN s // 86400 END) AS qb FROM ticks GROUP BY 1),
 c AS (SELECT *, k = 'error' AS torn, CASE WHEN k IN ('click', 'view') THEN 100 ELSE 1000 END AS scale,
              k <> 'error' AND qa <> a AS off_a, k <> 'error' AND qb <> b AS off_b FROM m),
 u AS (SELECT DISTINCT v.k || '.' || CAST(user_id // 150 AS VARCHAR) AS instrument FROM events,
       (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) v(k))
SELECT instrument, CASE WHEN n IS NOT NULL THEN 2 END AS documents, CASE WHEN n IS NOT NULL THEN CAST(torn AS INT) END AS unreadable, scale,
 CASE WHEN off_a IS NOT TRUE THEN {_mday('a')} END AS first_day, CASE WHEN off_b IS NOT TRUE THEN {_mday('b')} END AS last_day, n AS rows,
 CASE WHEN n IS NOT NULL THEN '' END AS missing,
 CASE WHEN n IS NOT NULL THEN concat_ws(',', CASE WHEN off_a THEN 'first_day' END, CASE WHEN off_b THEN 'last_day' END) END AS conflicts,
 CASE WHEN n IS NOT NULL THEN CASE WHEN k = 'signup' THEN 'scale' ELSE '' END END AS mismatched,
 CASE WHEN n IS NULL THEN 'absent' WHEN torn THEN 'unreadable' WHEN off_a OR off_b THEN 'conflict' WHEN k = 'signup' THEN 'mismatch' ELSE 'verified' END AS status
FROM u LEFT JOIN c USING (instrument)""")

# ================================================================ process
PRC = "instrument, benchmark_family, signal_timeframe, session, lookback"
cte("resid", f"SELECT {PRC}, at, any_value(close) AS p0, any_value(e0) AS e0, any_value(close) - any_value(e0) AS dev FROM sides GROUP BY {PRC}, at")
query("residual_rows", f"SELECT {PRC}, count(*) AS rows, {r('avg(dev)')} AS mean_deviation, max(at) AS last_s FROM resid GROUP BY 1, 2, 3, 4, 5")
cte("trans", f"""
SELECT *, count(x) OVER (PARTITION BY {PRC} ORDER BY at ROWS UNBOUNDED PRECEDING) AS transitions
FROM (SELECT *, CASE signal_timeframe WHEN '2h' THEN 7200 WHEN '4h' THEN 14400 ELSE 28800 END AS tf,
             CASE WHEN at - lag(at) OVER q = CASE signal_timeframe WHEN '2h' THEN 7200 WHEN '4h' THEN 14400 ELSE 28800 END THEN lag(dev) OVER q END AS x
      FROM resid WINDOW q AS (PARTITION BY {PRC} ORDER BY at))""")
cte("pairs", f"SELECT {PRC}, transitions AS rk, x, dev AS y FROM trans WHERE x IS NOT NULL")
cte("fits", f"""
SELECT a.*, sxy / sxx AS phi0 FROM (
 SELECT p.instrument, p.benchmark_family, p.signal_timeframe, p.session, p.lookback, p.rk, avg(o.x) AS mx, avg(o.y) AS my,
  sum((o.x - g.mx) * (o.x - g.mx)) AS sxx, sum((o.x - g.mx) * (o.y - g.my)) AS sxy, sum((o.y - g.my) * (o.y - g.my)) AS syy
 FROM pairs p JOIN pairs o ON {on('o', 'p', ['instrument', 'benchmark_family', 'signal_timeframe', 'session', 'lookback'])} AND o.rk BETWEEN p.rk - 15 AND p.rk
 JOIN (SELECT {PRC}, rk, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM pairs
       WINDOW w AS (PARTITION BY {PRC} ORDER BY rk ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)) g
   ON {on('g', 'p', ['instrument', 'benchmark_family', 'signal_timeframe', 'session', 'lookback', 'rk'])}
 WHERE p.rk >= 16 GROUP BY ALL) a""")
cte("ou0", f"""
SELECT t.*, f.phi0 AS phi, f.my - f.phi0 * f.mx AS intercept, greatest(0, f.syy - f.phi0 * f.sxy) AS sse, f.sxx, f.syy
FROM trans t LEFT JOIN fits f ON {on('f', 't', ['instrument', 'benchmark_family', 'signal_timeframe', 'session', 'lookback'])} AND f.rk = t.transitions""")
cte("ou1", """
SELECT *, sse / 14 AS var0, CASE WHEN transitions < 16 THEN 'insufficient_history' WHEN phi <= 0 THEN 'phi_non_positive' WHEN phi >= 1 THEN 'phi_not_below_one' END AS invalid_reason,
 CASE WHEN transitions < 16 THEN 'unavailable' WHEN phi <= 0 OR phi >= 1 THEN 'invalid' ELSE 'valid' END AS status FROM ou0""")
cte("ou", """
SELECT *, CASE WHEN status = 'valid' THEN -ln(phi) / (tf / 60::DOUBLE) END AS kappa, CASE WHEN status = 'valid' THEN intercept / (1 - phi) END AS long_run_mean,
 CASE WHEN status = 'valid' THEN sqrt(var0) / sqrt(1 - phi * phi) END AS stationary_sigma,
 CASE WHEN status = 'valid' THEN ln(2) / (-ln(phi) / (tf / 60::DOUBLE)) END AS half_life,
 CASE WHEN status = 'valid' THEN (dev - intercept / (1 - phi)) / (sqrt(var0) / sqrt(1 - phi * phi)) END AS score FROM ou1""")
query("process_states", f"""
SELECT {PRC}, at, {r('dev')} AS deviation, transitions, status, invalid_reason, {r('phi')} AS phi, {r('intercept')} AS intercept, {r('sqrt(var0 / sxx)')} AS phi_se,
 {r('CASE WHEN phi IS NOT NULL THEN sqrt(var0) END')} AS innovation_sigma, {r('1 - sse / syy')} AS r_squared, {r('kappa')} AS kappa, {r('long_run_mean')} AS long_run_mean, {r('half_life')} AS half_life,
 {r('stationary_sigma')} AS stationary_sigma, {r('score')} AS score FROM ou""")
cte("aligned", f"""
SELECT c.*, o.status, o.invalid_reason, o.half_life, o.score FROM cands c LEFT JOIN ou o
ON {on('o', 'c', ['instrument', 'benchmark_family', 'signal_timeframe', 'session', 'lookback', 'at'])}""")
query("candidate_alignment", f"""
SELECT benchmark_family, coalesce(status, 'missing') AS status, invalid_reason, count(*) AS candidates, {r('avg(half_life)')} AS mean_half_life
FROM aligned GROUP BY 1, 2, 3""")
cte("gated", """
SELECT *, reason = 'eligible' AS eligible FROM (
SELECT *, score * -direction AS ds, CASE WHEN NOT coalesce(session = 'london' AND direction = -1 AND benchmark_family <> 'band', false) THEN 'outside_frozen_signal_scope'
 WHEN status IS NULL THEN 'missing_exact_state' WHEN status <> 'valid' THEN 'ou_status_' || status
 WHEN score * -direction <= 0.5 THEN 'directional_score_not_strictly_above_threshold' WHEN half_life > 600 THEN 'half_life_above_cap' ELSE 'eligible' END AS reason FROM aligned)""")
query("gate_decisions", f"SELECT candidate_event_id, eligible, reason AS eligibility_reason, {r('ds')} AS directional_score, {r('half_life')} AS half_life FROM gated")
cte("replay", """
SELECT o.instrument, o.pips_adverse, o.mfe / o.pip AS mfe_pips, o.mae / o.pip AS mae_pips, unnest(CASE WHEN g.eligible THEN ['ungated', 'gated'] ELSE ['ungated'] END) AS variant
FROM imm o JOIN gated g USING (candidate_event_id)
WHERE o.session = 'london' AND o.direction = -1 AND o.benchmark_family <> 'band' AND o.stop IN (12, 24) AND o.tp IN (0.75, 1) AND o.sl IN (0.25, 0.5)""")
query("replay_comparison", f"""
SELECT variant, instrument, n, {r('mean')} AS mean, {r('win_rate')} AS win_rate, {PF} AS profit_factor, {r('mean_mfe')} AS mean_mfe, {r('mean_mae')} AS mean_mae, {r('med')} AS median,
 {r("n / max(CASE WHEN variant = 'ungated' THEN n END) OVER (PARTITION BY instrument)::DOUBLE")} AS retention
FROM (SELECT variant, coalesce(instrument, 'ALL') AS instrument, count(*) AS n, avg(pips_adverse) AS mean, avg(CASE WHEN pips_adverse > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS win_rate,
 sum(CASE WHEN pips_adverse > 0 THEN pips_adverse ELSE 0 END) AS gains, -sum(CASE WHEN pips_adverse < 0 THEN pips_adverse ELSE 0 END) AS losses, avg(mfe_pips) AS mean_mfe, avg(mae_pips) AS mean_mae,
 median(pips_adverse) AS med FROM replay GROUP BY GROUPING SETS ((variant, instrument), (variant)))""")
query("gated_outcomes", f"""
SELECT o.instrument, 'ornstein-uhlenbeck' AS filter_family, 'ou-v1' AS filter_spec_id, o.entry_mode, o.tp, o.sl, o.stop, count(*) AS candidates,
 count(*) FILTER (o.complete) AS complete_trades, count(*) FILTER (o.status = 'passed') AS passed, {r('avg(o.pips_adverse)')} AS mean_pips
FROM outs o JOIN gated g USING (candidate_event_id) WHERE g.eligible GROUP BY ALL""")
cte("shk", """
SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY instrument, tf_s, lookback ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
FROM (SELECT *, CASE WHEN abs(z) >= 1.5 THEN 'H' WHEN abs(z) < 0.5 THEN 'L' END AS kind FROM bandf WHERE z IS NOT NULL)""")
cte("shk2", """
SELECT *, coalesce(coalesce(kind, prev) = 'H', false) AS active1, coalesce(kind = 'H' AND (prev IS NULL OR prev = 'L'), false) AS emitted FROM shk""")
query("band_shocks", """
SELECT instrument, timeframe, lookback, at, active1 AS shock_active, emitted AS event_emitted, CASE WHEN active1 THEN sg ELSE 0 END AS shock_sign,
 -CASE WHEN active1 THEN sg ELSE 0 END AS fade_direction
FROM (SELECT *, last_value(CASE WHEN emitted THEN CAST(sign(z) AS INTEGER) END IGNORE NULLS) OVER (PARTITION BY instrument, tf_s, lookback ORDER BY at ROWS UNBOUNDED PRECEDING) AS sg FROM shk2)""")

# ================================================================ levels and breakouts


def utc(tz, day, minutes):
    return f"epoch_us(timezone('{tz}', CAST({day} AS TIMESTAMP) + INTERVAL {minutes} MINUTE)) // 1000000"


cte("fxd", f"""
SELECT instrument, h, l, known, e0 FROM (
 SELECT instrument, d, count(DISTINCT t) AS n, max(high) AS h, min(low) AS l, max(at) AS known, any_value({utc(NY, 'd', 1020)}) AS s0, any_value({utc(NY, 'd', 2460)}) AS e0
 FROM (SELECT *, CAST({local(NY, 't')} - INTERVAL 17 HOUR AS DATE) AS d FROM bars) GROUP BY 1, 2) WHERE n * 3600 = e0 - s0""")
cte("anchors", f"""
SELECT d.instrument, 'previous-day' AS fam, d.day, NULL::DOUBLE AS h, NULL::DOUBLE AS l, {utc(NY, 'd.day', 1020)} AS known, {utc(NY, 'd.day', 1020)} AS ready, {utc(NY, 'd.day', 2460)} AS expires
FROM (SELECT instrument, CAST({local(NY, 't')} AS DATE) AS day FROM bars GROUP BY 1, 2) d JOIN (SELECT instrument, max(at) AS mx FROM bars GROUP BY 1) m USING (instrument)
WHERE {utc(NY, 'd.day', 1020)} <= m.mx
UNION ALL
SELECT instrument, 'asia-session', day, h, l, known, e, {utc('Asia/Tokyo', 'day + 1', 540)} FROM (
 SELECT instrument, day, count(DISTINCT t) AS n, max(high) AS h, min(low) AS l, max(at) AS known, any_value({utc('Asia/Tokyo', 'day', 540)}) AS s, any_value({utc('Asia/Tokyo', 'day', 1080)}) AS e
 FROM (SELECT *, CAST({local('Asia/Tokyo', 't')} AS DATE) AS day FROM bars WHERE {inside('Asia/Tokyo', 540, 1080, 't')}) GROUP BY 1, 2) WHERE n * 3600 = e - s
UNION ALL
SELECT instrument, 'london-opening', day, h, l, known, s + 7200, {utc('Europe/London', 'day', 1020)} FROM (
 SELECT instrument, day, count(DISTINCT t) AS n, max(high) AS h, min(low) AS l, max(at) AS known, any_value({utc('Europe/London', 'day', 480)}) AS s
 FROM (SELECT *, CAST({local('Europe/London', 't')} AS DATE) AS day FROM bars WHERE {inside('Europe/London', 480, 600, 't')}) GROUP BY 1, 2) WHERE n = 2""")
cte("lvls", """
SELECT instrument, fam || '-' || tag || '-' || strftime(day, '%Y-%m-%d') AS level_id, fam AS anchor_family, side, CASE WHEN tag = 'high' THEN hh ELSE ll END AS price, scale,
 available_s, expires AS expires_s
FROM (SELECT a.instrument, a.fam, a.day, a.expires, coalesce(a.h, f.h) AS hh, coalesce(a.l, f.l) AS ll, f.h - f.l AS scale, greatest(a.ready, a.known, f.known) AS available_s
      FROM anchors a ASOF JOIN fxd f ON a.instrument = f.instrument AND a.ready >= f.e0), (VALUES ('upper', 'high'), ('lower', 'low')) s(side, tag)
WHERE scale > 0 AND available_s < expires""")
query("structural_levels", f"SELECT instrument, level_id, anchor_family, side, {r('price')} AS price, {r('scale')} AS scale, available_s, expires_s FROM lvls")
cte("fb0", """
SELECT l.*, d.d AS md, b.at, b.close, CASE WHEN side = 'upper' THEN b.close > price ELSE b.close < price END AS o,
 greatest(0, CASE WHEN side = 'upper' THEN b.high - price ELSE price - b.low END) / scale AS depth, coalesce(b.at - b.pa <> 3600, false) AS gap
FROM (SELECT *, lag(at) OVER (PARTITION BY instrument ORDER BY at) AS pa FROM bars) b
JOIN lvls l ON l.instrument = b.instrument AND b.at > l.available_s AND b.at < l.expires_s, (VALUES (0::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) d(d)""")
cte("fb1", """
SELECT *, sum(CASE WHEN rn = 1 OR gap OR po IS DISTINCT FROM o THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, level_id, md ORDER BY at ROWS UNBOUNDED PRECEDING) AS run
FROM (SELECT *, row_number() OVER w AS rn, lag(o) OVER w AS po FROM fb0 WINDOW w AS (PARTITION BY instrument, level_id, md ORDER BY at))""")
cte("fbrun", """
SELECT instrument, level_id, md, run, bool_and(o) AS outside, arg_min(CASE WHEN rn = 1 THEN at - available_s <= 3600 ELSE NOT gap AND NOT po END, at) AS fresh,
 min(CASE WHEN depth >= md THEN at END) AS broke, max(at) AS last_at FROM fb1 GROUP BY 1, 2, 3, 4""")
cte("fb", """
SELECT r.instrument, r.level_id, x.anchor_family, r.md AS minimum_depth, x.side, x.price, x.scale, CASE WHEN x.side = 'upper' THEN -1 ELSE 1 END AS direction, r.broke AS breakout_s, x.at,
 x.close AS p0, (SELECT depth FROM fb1 q WHERE q.instrument = r.instrument AND q.level_id = r.level_id AND q.md = r.md AND q.at = r.broke) AS initial_depth,
 (SELECT max(depth) FROM fb1 q WHERE q.instrument = r.instrument AND q.level_id = r.level_id AND q.md = r.md AND q.at BETWEEN r.broke AND x.at) AS max_depth,
 (SELECT count(*) FROM fb1 q WHERE q.instrument = r.instrument AND q.level_id = r.level_id AND q.md = r.md AND q.run = r.run AND q.at >= r.broke) AS outside_closes,
 (x.at - r.broke) // 3600 AS steps_to_reclaim, greatest(0, CASE WHEN x.side = 'upper' THEN x.price - x.close ELSE x.close - x.price END) / x.scale AS reclaim_inside
FROM fbrun r JOIN fb1 x ON x.instrument = r.instrument AND x.level_id = r.level_id AND x.md = r.md AND x.at = r.last_at + 3600
WHERE r.outside AND r.fresh AND r.broke IS NOT NULL AND NOT x.o AND NOT x.gap AND x.at <= r.broke + 6 * 3600""")
query("failed_breakouts", f"""
SELECT instrument, level_id, anchor_family, minimum_depth, side, {r('price')} AS price, {r('scale')} AS scale, direction, breakout_s, at, {r('p0')} AS p0, {r('initial_depth')} AS initial_depth,
 {r('max_depth')} AS max_depth, outside_closes, steps_to_reclaim, {r('reclaim_inside')} AS reclaim_inside FROM fb""")


def observed(name, src):
    """Directional paths over eight steps for any event table with instrument, at, direction, p0."""
    hs = ", ".join(f"max(CASE WHEN m = {h} THEN pc END) AS c{h}" for h in (1, 2, 4, 8))
    cte(name, f"""
SELECT e.*, coalesce(a.n, 0) = 8 AS path_complete, {", ".join(f"e.direction * (a.c{h} - e.p0) / {PIP.replace('instrument', 'e.instrument')} AS pips_h{h}" for h in (1, 2, 4, 8))},
 CASE WHEN a.n = 8 THEN a.f / {PIP.replace('instrument', 'e.instrument')} END AS mfe_pips, CASE WHEN a.n = 8 THEN a.a / {PIP.replace('instrument', 'e.instrument')} END AS mae_pips
FROM {src} e LEFT JOIN (SELECT instrument, at, direction, p0, count(*) AS n, {hs}, max(greatest(0, direction * (ph - p0), direction * (pl - p0))) AS f,
   max(greatest(0, -direction * (ph - p0), -direction * (pl - p0))) AS a
 FROM (SELECT s.instrument, s.at, s.direction, s.p0, (b.at - s.at) // 3600 AS m, b.high AS ph, b.low AS pl, b.close AS pc
       FROM (SELECT DISTINCT instrument, at, direction, p0 FROM {src}) s JOIN bars b ON b.instrument = s.instrument AND b.at > s.at AND b.at <= s.at + 28800) GROUP BY ALL) a
ON a.instrument = e.instrument AND a.at = e.at AND a.direction = e.direction AND a.p0 = e.p0""")


observed("fbo", "fb")
cte("fbu", "SELECT DISTINCT ON (instrument, at, direction) * FROM fbo ORDER BY instrument, at, direction, anchor_family, level_id")
cte("fbud", "SELECT DISTINCT ON (instrument, at, direction, minimum_depth) * FROM fbo ORDER BY instrument, at, direction, minimum_depth, anchor_family, level_id")


def text_map(src, keys, key):
    ks = ", ".join(keys)
    return f"(SELECT {ks}, max(n) AS top, array_to_string(list_sort(list(kk || '=' || n)), ',') AS txt FROM (SELECT {ks}, {key} AS kk, count(*) AS n FROM {src} GROUP BY ALL) GROUP BY {ks})"


MONTH = "strftime(make_timestamp(at * 1000000), '%Y-%m')"
QUARTER = "year(make_timestamp(at * 1000000)) || '-Q' || quarter(make_timestamp(at * 1000000))"


def scope(src, keys):
    a = ["count(*) AS events", "count(DISTINCT at) AS clocks"]
    for h in (1, 2, 4, 8):
        x = f"pips_h{h}"
        a += [f"count({x}) AS n_h{h}", f"{r(f'avg({x})')} AS mean_h{h}", f"{r(f'avg(CASE WHEN {x} > 0 THEN 1::DOUBLE WHEN {x} IS NOT NULL THEN 0::DOUBLE END)')} AS win_rate_h{h}",
              f"{r(f'coalesce(sum(CASE WHEN {x} > 0 THEN {x} END), 0) / nullif(-sum(CASE WHEN {x} < 0 THEN {x} END), 0)')} AS profit_factor_h{h}"]
        a += [f"{r(f'quantile_cont({x}, {p})')} AS {x}_{n}" for n, p in QS[:5]]
    a += ["count(*) FILTER (path_complete) AS complete_paths"]
    for m in ("mfe", "mae"):
        a += [f"{r(f'avg({m}_pips)')} AS mean_{m}_pips", f"{r(f'median({m}_pips)')} AS {m}_pips_median"]
    a += [f"{r('CASE WHEN median(mae_pips) > 0 THEN median(mfe_pips) / median(mae_pips) END')} AS mfe_to_mae"]
    return f"""
SELECT b.*, mo.txt AS month_counts, qu.txt AS quarter_counts, ins.instruments, ins.adequate_instruments, ins.positive_instruments, len(string_split(mo.txt, ',')) AS active_months,
 {r('ins.top / b.events::DOUBLE')} AS max_instrument_share, {r('qu.top / b.events::DOUBLE')} AS max_quarter_share
FROM (SELECT {", ".join(keys)}, {", ".join(a)} FROM {src} GROUP BY {", ".join(keys)}) b
JOIN {text_map(src, keys, MONTH)} mo ON {on('mo', 'b', keys)} JOIN {text_map(src, keys, QUARTER)} qu ON {on('qu', 'b', keys)}
JOIN (SELECT {", ".join(keys)}, max(n) AS top, count(*) AS instruments, count(*) FILTER (n >= 10) AS adequate_instruments, count(*) FILTER (m > 0) AS positive_instruments
      FROM (SELECT {", ".join(keys)}, instrument AS ikey, count(*) AS n, avg(pips_h8) AS m FROM {src} GROUP BY ALL) GROUP BY ALL) ins ON {on('ins', 'b', keys)}"""


_zero = ["events", "clocks", "complete_paths", "instruments", "adequate_instruments", "positive_instruments", "active_months", "n_h1", "n_h2", "n_h4", "n_h8"]


def dense(axes, cells):
    keys = [*axes, "cell_instrument"]
    grid = ", ".join(f"(SELECT unnest([{', '.join(v)}]) AS {k})" for k, v in axes.items())
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in _zero)
    return (f"SELECT * REPLACE ({zero}) FROM (SELECT g.*, c.* EXCLUDE ({', '.join(keys)}) FROM (SELECT {', '.join(keys)} FROM "
            f"(SELECT DISTINCT instrument AS cell_instrument FROM bars), {grid}) g LEFT JOIN ({cells}) c ON {on('c', 'g', keys)})")


cte("fbcell", "SELECT *, instrument AS cell_instrument FROM fbo")
cte("fbd", "SELECT DISTINCT ON (instrument, at, direction, minimum_depth) * FROM fbo ORDER BY instrument, at, direction, minimum_depth, anchor_family, level_id")
cte("fbfam", "SELECT *, 'family' AS scope FROM fbu")
query("breakout_summary", f"""
SELECT *, 'cell' AS scope FROM ({dense({'anchor_family': ["'previous-day'", "'asia-session'", "'london-opening'"], 'minimum_depth': ["0::DOUBLE", "0.05::DOUBLE", "0.1::DOUBLE"]},
                                         scope('fbcell', ['anchor_family', 'minimum_depth', 'cell_instrument']))})
UNION ALL BY NAME SELECT *, 'depth' AS scope FROM ({scope('fbud', ['minimum_depth'])})
UNION ALL BY NAME SELECT * FROM ({scope('fbfam', ['scope'])})""")
cte("refclk", "SELECT DISTINCT instrument, at FROM cands WHERE benchmark_family <> 'band' AND direction = -1")


def near(src):
    return f"(SELECT e.*, (SELECT min(abs(c.at - e.at)) FROM refclk c WHERE c.instrument = e.instrument AND abs(c.at - e.at) <= 28800) AS g FROM {src} e)"


_ov = ["count(*) AS events"]
for w in (0, 7200, 14400, 28800):
    _ov += [f"count(*) FILTER (g <= {w}) AS overlap_w{w}", f"{r(f'count(*) FILTER (g <= {w}) / count(*)::DOUBLE')} AS overlap_rate_w{w}",
            f"count(*) - count(*) FILTER (g <= {w}) AS unique_w{w}"]
cte("fbnear", f"SELECT * FROM {near('(SELECT DISTINCT anchor_family, instrument, at, direction FROM fbo)')}")
cte("fball", f"SELECT * FROM {near('(SELECT DISTINCT instrument, at, direction FROM fbo)')}")
query("breakout_overlap", f"""
SELECT anchor_family, 'ALL' AS scope_instrument, {", ".join(_ov)} FROM fbnear GROUP BY 1
UNION ALL SELECT anchor_family, instrument, {", ".join(_ov)} FROM fbnear GROUP BY 1, 2
UNION ALL SELECT 'ALL', instrument, {", ".join(_ov)} FROM fball GROUP BY 2
UNION ALL SELECT 'ALL', 'ALL', {", ".join(_ov)} FROM fball HAVING count(*) > 0""")
query("breakout_decision", f"""
SELECT *, CASE WHEN unique_rate IS NULL OR decision = 'INCONCLUSIVE' THEN 'INSUFFICIENT EVIDENCE' WHEN unique_rate >= 0.5 AND decision = 'PASS' THEN 'INDEPENDENT CANDIDATE'
  WHEN unique_rate >= 0.5 THEN 'PARTIALLY ORTHOGONAL' ELSE 'LIKELY REFERENCE FILTER/TIMING LAYER' END AS independence
FROM (
SELECT 'family' AS scope, (SELECT {r('(count(*) - count(*) FILTER (g <= 28800)) / count(*)::DOUBLE')} FROM fball) AS unique_rate, events, n AS n_h8, {r('m')} AS mean_h8, {r('md')} AS pips_h8_median,
 CASE WHEN events >= 100 AND n >= 100 AND m > 0 AND md >= 0 AND (SELECT count(*) FROM (SELECT 1 FROM fbu GROUP BY instrument HAVING count(*) >= 20)) >= 2
   AND (SELECT count(*) FROM (SELECT 1 FROM fbu GROUP BY instrument HAVING avg(pips_h8) > 0)) >= 2
   AND (SELECT max(c) FROM (SELECT count(*) AS c FROM fbu GROUP BY instrument)) / events::DOUBLE <= 0.6
   AND (SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT {QUARTER} AS q FROM fbu) GROUP BY q)) / events::DOUBLE <= 0.5
   AND (SELECT count(*) FROM (SELECT 1 FROM fbd GROUP BY minimum_depth HAVING avg(pips_h8) > 0)) = 3
  THEN 'PASS' WHEN events >= 100 AND n >= 100 THEN 'KILL' ELSE 'INCONCLUSIVE' END AS decision
FROM (SELECT count(*) AS events, count(pips_h8) AS n, avg(pips_h8) AS m, median(pips_h8) AS md FROM fbu) WHERE events > 0)""")

# ================================================================ trend exhaustion
cte("tf0", """
SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, abs(close - pc) AS stp
FROM (SELECT *, lag(close) OVER w AS pc, lag(volume) OVER w AS pv, lag(t, 24) OVER w AS t24 FROM obs WINDOW w AS (PARTITION BY instrument ORDER BY t))""")
cte("tf1", """
SELECT *, sum(tr) OVER (PARTITION BY instrument ORDER BY t ROWS BETWEEN 23 PRECEDING AND 4 PRECEDING) / 20 AS atr,
 sum(stp) OVER (PARTITION BY instrument ORDER BY t ROWS BETWEEN 10 PRECEDING AND 4 PRECEDING) AS chg,
 lag(close, 4) OVER w AS te, lag(close, 11) OVER w AS ts0, max(high) OVER (PARTITION BY instrument ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS top,
 min(low) OVER (PARTITION BY instrument ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS bot
FROM tf0 WINDOW w AS (PARTITION BY instrument ORDER BY t)""")
cte("tff", """
SELECT *, CASE WHEN atr > 0 THEN abs(displacement) / atr END AS normalized_displacement, CASE WHEN chg > 0 THEN abs(displacement) / chg ELSE 0 END AS efficiency,
 CASE WHEN up > 0 THEN top - te WHEN up < 0 THEN te - bot END AS extension, up * (close - te) AS retained, up * (close - pc) AS last_move,
 high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick, abs(close - open) AS body,
 CASE WHEN close <> open THEN (high - greatest(open, close) + least(open, close) - low) / abs(close - open) END AS wick_body_ratio, high - low AS bar_range, volume - pv AS volume_change
FROM (SELECT *, te - ts0 AS displacement, CAST(sign(te - ts0) AS INTEGER) AS up FROM tf1 WHERE t - t24 = 24 * 3600)""")
_tc = ["atr", "displacement", "normalized_displacement", "efficiency", "extension", "retained", "last_move", "upper_wick", "lower_wick", "body", "wick_body_ratio", "bar_range"]
query("trend_features", "SELECT instrument, t AS open_s, up AS trend_direction, volume_change, " + ", ".join(f"{r(c)} AS {c}" for c in _tc) + " FROM tff")
cte("tef", """
SELECT f.*, th.th AS threshold, coalesce(normalized_displacement > th.th AND efficiency >= 0.15 AND extension >= 0.25 * atr AND retained <= 0.1 * atr AND last_move < 0 AND atr > 0 AND up <> 0, false) AS flag
FROM tff f, (VALUES (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE)) th(th)""")
cte("te", f"""
SELECT *, -up AS direction, close AS p0, {session_list("at")} AS atsess FROM (
 SELECT *, lag(flag) OVER w AS pf, lag(t) OVER w AS pt FROM tef WINDOW w AS (PARTITION BY instrument, threshold ORDER BY t))
WHERE flag AND NOT (coalesce(pf, false) AND coalesce(pt = t - 3600, false))""")
_sa = " ".join(f"WHEN '{n}' THEN {clock(tz, 'at')} - {lo}" for n, (tz, lo, hi) in SESSIONS.items())
_ua = " ".join(f"WHEN '{n}' THEN {hi} - {clock(tz, 'at')}" for n, (tz, lo, hi) in SESSIONS.items())
cte("tex", f"""
SELECT *, CASE WHEN len(atsess) = 1 THEN atsess[1] END AS session_label,
 'trend-exhaustion-' || substr(sha256(concat_ws('|', instrument, CAST(at AS VARCHAR), printf('%.2f', threshold))), 1, 24) AS event_id FROM te""")
cte("tey", f"SELECT *, CASE session_label {_sa} END AS from_open, CASE session_label {_ua} END AS to_close FROM tex")
query("trend_exhaustion", f"""
SELECT event_id, instrument, at, threshold, direction, {r('normalized_displacement')} AS normalized_displacement, {r('efficiency')} AS efficiency, {r('extension')} AS extension,
 {r('retained')} AS retained, session_label, from_open, to_close FROM tey""")
observed("teo", "tey")
cte("tep", "SELECT * FROM teo WHERE threshold = 0.6")
cte("tecell", "SELECT *, instrument AS cell_instrument FROM teo")
query("exhaustion_summary", f"""
SELECT *, 'instrument' AS scope FROM ({dense({'threshold': ["0.4::DOUBLE", "0.6::DOUBLE", "0.8::DOUBLE"]}, scope('tecell', ['threshold', 'cell_instrument']))})
UNION ALL BY NAME SELECT *, 'threshold' AS scope FROM ({scope('teo', ['threshold'])})""")
query("exhaustion_expectancy", f"""
SELECT threshold, kind, key, count(*) AS events, {r('avg(pips_h8)')} AS expectancy FROM (
 SELECT threshold, pips_h8, 'instrument' AS kind, instrument AS key FROM teo UNION ALL SELECT threshold, pips_h8, 'month', {MONTH} FROM teo
 UNION ALL SELECT threshold, pips_h8, 'quarter', {QUARTER} FROM teo) GROUP BY 1, 2, 3""")
query("exhaustion_decision", f"""
SELECT threshold, events, n AS n_h8, {r('m')} AS mean_h8, {r('md')} AS pips_h8_median, plateau,
 CASE WHEN events >= 100 AND n >= 100 AND m > 0 AND md >= 0 AND plateau
   AND (SELECT count(*) FROM (SELECT 1 FROM tep GROUP BY instrument HAVING count(*) >= 20)) >= 2
   AND (SELECT count(*) FROM (SELECT 1 FROM tep GROUP BY instrument HAVING avg(pips_h8) > 0)) >= 2
   AND (SELECT max(c) FROM (SELECT count(*) AS c FROM tep GROUP BY instrument)) / events::DOUBLE <= 0.6
   AND (SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT {QUARTER} AS q FROM tep) GROUP BY q)) / events::DOUBLE <= 0.5
  THEN 'PASS' WHEN events >= 100 AND n >= 100 THEN 'KILL' ELSE 'INCONCLUSIVE' END AS decision
FROM (SELECT threshold, count(*) AS events, count(pips_h8) AS n, avg(pips_h8) AS m, median(pips_h8) AS md FROM tep GROUP BY 1),
 (SELECT coalesce(p > 0 AND w >= 0.5 * p, false) AS plateau FROM (
  SELECT max(CASE WHEN threshold = 0.6 THEN m END) AS p, min(CASE WHEN threshold <> 0.6 THEN coalesce(m, '-inf'::DOUBLE) END) AS w
  FROM (SELECT threshold, avg(pips_h8) AS m FROM teo GROUP BY 1)))""")
query("exhaustion_overlap", f"SELECT instrument, {', '.join(_ov)} FROM {near('(SELECT * FROM teo WHERE threshold = 0.6)')} GROUP BY 1")
query("exhaustion_plateau", f"""
SELECT {r('p')} AS primary_mean, {r('w')} AS weakest_neighbour, coalesce(p > 0 AND w >= 0.5 * p, false) AS plateau
FROM (SELECT max(CASE WHEN threshold = 0.6 THEN m END) AS p, min(CASE WHEN threshold <> 0.6 THEN coalesce(m, '-inf'::DOUBLE) END) AS w
      FROM (SELECT threshold, avg(pips_h8) AS m FROM teo GROUP BY 1))""")

# ================================================================ ranking and bootstraps
cte("qual", f"""
SELECT event_id, instrument, at, direction, CASE WHEN direction > 0 THEN 'long' ELSE 'short' END AS side, session_label, (at - 1704067200) // 259200 + 1 AS fold,
 normalized_displacement, efficiency, extension / atr AS extension_atr, retained / atr AS retained_atr, upper_wick / atr AS upper_wick_atr, lower_wick / atr AS lower_wick_atr,
 body / atr AS body_atr, bar_range / atr AS range_atr, wick_body_ratio, from_open::DOUBLE AS from_open, to_close::DOUBLE AS to_close,
 pips_h8 * {PIP} / atr AS target, pips_h8 AS pips, mfe_pips, mae_pips FROM teo WHERE threshold = 0.6 AND pips_h8 IS NOT NULL""")
_num = ["normalized_displacement", "efficiency", "extension_atr", "retained_atr", "upper_wick_atr", "lower_wick_atr", "body_atr", "range_atr", "wick_body_ratio", "from_open", "to_close"]
query("quality_rows", "SELECT event_id, instrument, at, direction, side, session_label, fold, "
      + ", ".join(f"{r(c)} AS {c}" for c in [*_num, "target", "pips", "mfe_pips", "mae_pips"]) + " FROM qual")
cte("qlong", "SELECT event_id, target, pips, mfe_pips, mae_pips, unnest([" + ", ".join(f"'{c}'" for c in _num) + "]) AS predictor, unnest([" + ", ".join(_num) + "]) AS x FROM qual")
query("predictor_quantiles", f"""
SELECT predictor, count(x) AS count, count(*) - count(x) AS missing, {r('(count(*) - count(x)) / count(*)::DOUBLE')} AS missing_rate, {r('min(x)')} AS p00, {r('max(x)')} AS p100, """
      + ", ".join(f"{r(f'quantile_cont(x, {p})')} AS {n}" for n, p in (("p10", .1), ("p25", .25), ("p50", .5), ("p75", .75), ("p90", .9))) + " FROM qlong GROUP BY 1")
OSUM = f"""count(*) AS n, {r('avg(target)')} AS mean_target, {r('avg(pips)')} AS mean_pips,
 {r('coalesce(sum(CASE WHEN pips > 0 THEN pips END), 0) / nullif(-sum(CASE WHEN pips < 0 THEN pips END), 0)')} AS profit_factor,
 {r('avg(CASE WHEN pips > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END)')} AS win_rate, {r('avg(mfe_pips)')} AS mean_mfe, {r('avg(mae_pips)')} AS mean_mae,
 {r('median(target)')} AS target_median, {r('median(pips)')} AS pips_median"""
query("predictor_quintiles", f"""
SELECT predictor, bucket, {OSUM} FROM (SELECT *, ntile(5) OVER (PARTITION BY predictor ORDER BY x, event_id) AS bucket FROM qlong WHERE x IS NOT NULL) GROUP BY 1, 2""")
query("predictor_deciles", f"""
SELECT predictor, bucket, {OSUM} FROM (SELECT *, ntile(10) OVER (PARTITION BY predictor ORDER BY x, event_id) AS bucket, count(*) OVER (PARTITION BY predictor) AS held
 FROM qlong WHERE x IS NOT NULL) WHERE held >= 10 GROUP BY 1, 2""")
query("category_outcomes", f"""
SELECT category, value, {OSUM} FROM (SELECT *, unnest(['instrument', 'side', 'session_label']) AS category, unnest([instrument, side, coalesce(session_label, 'none')]) AS value FROM qual) GROUP BY 1, 2""")
cte("scored", f"""
SELECT event_id, instrument, direction, fold, {QUARTER} AS quarter, coalesce(session_label, 'none') AS session_label, target, pips, 'displacement' AS family, normalized_displacement AS score FROM qual
UNION ALL SELECT event_id, instrument, direction, fold, {QUARTER}, coalesce(session_label, 'none'), target, pips, 'extension', round(extension_atr, 1) FROM qual""")
cte("rk", """
SELECT *, rn > n - ceil(n * 0.2::DOUBLE) AS t20, rn > n - ceil(n * 0.1::DOUBLE) AS t10 FROM (
 SELECT *, row_number() OVER w AS rn, ntile(5) OVER w AS bucket, count(*) OVER (PARTITION BY family) AS n,
  rank() OVER (PARTITION BY family ORDER BY score) + (count(*) OVER (PARTITION BY family, score) - 1) / 2::DOUBLE AS rs,
  rank() OVER (PARTITION BY family ORDER BY target) + (count(*) OVER (PARTITION BY family, target) - 1) / 2::DOUBLE AS rt
 FROM scored WINDOW w AS (PARTITION BY family ORDER BY score, event_id))""")


def share(col):
    return f"(SELECT max(k) / sum(k)::DOUBLE FROM (SELECT count(*) AS k FROM rk z WHERE z.family = e.family AND z.t20 GROUP BY z.{col}))"


cte("ev0", """
SELECT family, count(*) AS n, avg(target) AS baseline, count(*) FILTER (t20) AS top20_n, avg(target) FILTER (t20) AS top20_mean, avg(pips) FILTER (t20) AS top20_pips, median(pips) FILTER (t20) AS top20_median,
 coalesce(sum(pips) FILTER (t20 AND pips > 0), 0) / nullif(-sum(pips) FILTER (t20 AND pips < 0), 0) AS top20_profit_factor, count(*) FILTER (t10) AS top10_n,
 avg(target) FILTER (t10) AS top10_mean, """ + ", ".join(f"avg(target) FILTER (bucket = {q}) AS q{q}" for q in range(1, 6)) + ", corr(rs, rt) AS spearman FROM rk GROUP BY 1")
cte("ev", f"""
SELECT *, top20_mean - baseline AS top20_lift, top10_mean - baseline AS top10_lift, q5 - q1 AS top_minus_bottom,
 CAST(q1 <= q2 AS INTEGER) + CAST(q2 <= q3 AS INTEGER) + CAST(q3 <= q4 AS INTEGER) + CAST(q4 <= q5 AS INTEGER) AS ordered_pairs,
 {share('instrument')} AS max_instrument_share, {share('direction')} AS max_direction_share, {share('fold')} AS max_fold_share, {share('quarter')} AS max_quarter_share, {share('session_label')} AS max_session_label_share,
 (SELECT count(*) FROM (SELECT 1 FROM rk z WHERE z.family = e.family AND z.t20 GROUP BY z.instrument HAVING avg(z.pips) > 0)) AS top20_positive_instruments FROM ev0 e""")
query("ranking_evaluation", "SELECT family, n, top20_n, top10_n, ordered_pairs, top20_positive_instruments, " + ", ".join(f"{r(c)} AS {c}" for c in (
    "baseline", "top20_mean", "top20_pips", "top20_median", "top20_profit_factor", "top10_mean", "q1", "q2", "q3", "q4", "q5", "spearman", "top20_lift", "top10_lift", "top_minus_bottom",
    "max_instrument_share", "max_direction_share", "max_fold_share", "max_quarter_share", "max_session_label_share")) + " FROM ev")
query("ranking_decision", """
WITH v AS (SELECT *, CASE family WHEN 'displacement' THEN 1 ELSE 2 END AS o, coalesce(top20_lift, '-inf'::DOUBLE) AS li, coalesce(spearman, '-inf'::DOUBLE) AS rh,
 coalesce(n >= 1000 AND top20_n >= 200 AND top20_pips > 0 AND top20_median >= 0 AND top20_positive_instruments >= 3 AND top20_profit_factor >= 1.2 AND top20_lift >= 0.05 AND spearman >= 0.05 AND ordered_pairs >= 3
  AND max_instrument_share <= 0.4 AND max_fold_share <= 0.3 AND max_quarter_share <= 0.6, false) AS ok FROM ev),
 ld AS (SELECT * FROM v ORDER BY li DESC, rh DESC, o LIMIT 1)
SELECT (SELECT count(*) FROM v WHERE ok) AS passing,
 coalesce((SELECT v.family FROM v, ld WHERE v.li >= ld.li - 0.02 AND v.rh >= ld.rh - 0.01 ORDER BY v.o LIMIT 1), (SELECT family FROM ld)) AS selected,
 CASE WHEN (SELECT bool_or(n < 1000 OR top20_n < 200) FROM v) THEN 'INCONCLUSIVE' WHEN (SELECT count(*) FROM v WHERE ok) >= 2 THEN 'PROMOTE_TO_FROZEN_CANDIDATE' ELSE 'PARK' END AS decision""")


def drawn(n, seed, a, b):
    mix = f"(({seed} + {a} * 7919 + {b} * 104729) * 2654435761 % 4294967296)"
    return f"(({mix} // 65536 + {mix} % 65536 * 65536) % {n})"


cte("blk", "SELECT family, fold, row_number() OVER (PARTITION BY family ORDER BY fold) - 1 AS i, count(*) OVER (PARTITION BY family) AS k FROM (SELECT DISTINCT family, fold FROM scored)")
cte("reps", f"""
SELECT s.family, s.rep, f.fold FROM (SELECT b.family, g.rep, {drawn('b.k', 20, 'g.rep', 'b.i')} AS pick FROM blk b, range(2000) g(rep)) s
JOIN blk f ON f.family = s.family AND f.i = s.pick""")
cte("boot", """
SELECT family, rep, avg(pips) FILTER (rn > n - ceil(n * 0.2::DOUBLE)) AS top_pips, avg(target) FILTER (rn > n - ceil(n * 0.2::DOUBLE)) AS top_target,
 avg(target) FILTER (rn > n - ceil(n * 0.2::DOUBLE)) - avg(target) FILTER (rn <= ceil(n * 0.2::DOUBLE)) AS top_minus_bottom
FROM (SELECT r.family, r.rep, s.pips, s.target, row_number() OVER (PARTITION BY r.family, r.rep ORDER BY s.score, s.event_id) AS rn, count(*) OVER (PARTITION BY r.family, r.rep) AS n
      FROM reps r JOIN scored s ON s.family = r.family AND s.fold = r.fold) GROUP BY 1, 2""")
query("fold_bootstrap", "SELECT family, " + ", ".join(
    f"{r(f'quantile_cont({c}, {p})')} AS {c}_{n}" for c in ("top_pips", "top_target", "top_minus_bottom") for n, p in (("lo", .025), ("hi", .975))) + " FROM boot GROUP BY 1")
cte("cal", "SELECT d, row_number() OVER (ORDER BY d) - 1 AS source_day FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) <= 5")


def dbl(c):
    return f"CASE WHEN {c} = 1 THEN '1.0' ELSE CAST({c} AS VARCHAR) END"


cte("ptx", f"""
SELECT *, CASE WHEN cost_status <> 'covered' THEN 'no_cost' WHEN sl IS NULL THEN 'no_stop' WHEN NOT (stop_pips > 0 AND gap > 0) THEN 'no_risk'
  WHEN isodow(make_timestamp(at * 1000000)) > 5 THEN 'weekend' ELSE 'taken' END AS admission
FROM (SELECT *, abs(p0 + direction * r_at_entry * abs(d0) - (p0 - direction * sl * abs(d0))) / pip AS stop_pips,
             direction * (p0 + direction * r_at_entry * abs(d0) - (p0 - direction * sl * abs(d0))) AS gap
      FROM priced WHERE entry_mode = 'immediate' AND benchmark_family <> 'band' AND (cost_status <> 'covered' OR (statistic = 'mean' AND slippage = 0.1::DOUBLE)))""")
query("trade_admission", "SELECT instrument, benchmark_family, admission, count(*) AS trades FROM ptx GROUP BY 1, 2, 3")
cte("ptr", f"""
SELECT candidate_event_id, instrument, session, 'benchmark_family=' || benchmark_family || '|lookback=' || lookback || '|tp=' || {dbl('tp')} || '|sl=' || {dbl('sl')} || '|stop=' || stop AS policy,
 source_day, at + wait * 3600 AS entry_s, at + (wait + holding) * 3600 AS exit_s, pips_adverse, net_adverse, stop_pips, net_adverse / stop_pips AS r
FROM ptx JOIN cal ON cal.d = CAST(make_timestamp(at * 1000000) AS DATE) WHERE admission = 'taken'""")
query("priced_trades", "SELECT candidate_event_id, instrument, session, policy, source_day, entry_s, exit_s, " + ", ".join(f"{r(c)} AS {c}" for c in ("pips_adverse", "net_adverse", "stop_pips", "r")) + " FROM ptr")
cte("pday", "SELECT policy, source_day, count(*) AS n, sum(r) AS s, min(entry_s) AS lo, max(exit_s) AS hi FROM ptr GROUP BY 1, 2")
cte("picks", f"""
SELECT p.p AS path, b.b * 5 + o.o AS day, ({drawn('262', 11, 'p.p', 'b.b')} + o.o) % 262 AS source_day FROM range(50000) p(p), range(4) b(b), range(5) o(o)""")
query("bootstrap_picks", "SELECT path, day, source_day, source_day IN (SELECT source_day FROM ptr) AS has_trades FROM picks WHERE path < 2000")
query("rebased_trades", f"""
SELECT path, policy, CAST(sum(n) AS BIGINT) AS trades, {r('sum(s)')} AS total_r, min(lo + (day - picks.source_day) * 86400) AS first_s, max(hi + (day - picks.source_day) * 86400) AS last_s
FROM pday JOIN picks ON picks.source_day = pday.source_day WHERE path < 2000 GROUP BY 1, 2""")
cte("ptot", "SELECT policy, path, sum(s) AS total_r FROM pday JOIN picks ON picks.source_day = pday.source_day GROUP BY 1, 2")
query("bootstrap_distribution", f"""
SELECT policy, count(*) AS paths, {r('avg(total_r)')} AS mean_r, {r('avg(CASE WHEN total_r > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END)')} AS positive_share, """
      + ", ".join(f"{r(nearest('total_r', p))} AS {n}" for n, p in (("p05", .05), ("p25", .25), ("median", .5), ("p75", .75), ("p95", .95))) + " FROM ptot GROUP BY 1")
query("policy_summary", f"""
SELECT 'ACROSS_POLICIES' AS universe, count(*) AS policies, {r('min(m)')} AS worst, {r('avg(CASE WHEN m > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END)')} AS positive_share,
 {r(nearest('m', .25))} AS p25, {r(nearest('m', .5))} AS mid, {r(nearest('m', .75))} AS p75 FROM (SELECT policy, {nearest('total_r', .5)} AS m FROM ptot GROUP BY 1)""")
