"""Event paths: the bars of a bounded number of steps after (and before) a signal.

Bars are grouped once into blocks of one path length; a signal joins the one block that
covers its path.  Neither side is multiplied by the path length in a shuffle, and everything
after the join is expressions over a bounded array.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tidewindow.operators.chunks import same_keys

# Fixed values of the path study, in steps of the base bar.
FIRST_PASSAGE_LEVELS = (0.25, 0.50, 0.75, 1.00)


def attach_paths(signals: DataFrame, bars: DataFrame, at: str, step_s: int, steps: int, back: int = 0) -> DataFrame:
    """Adds ``path`` (steps 1..``steps``) and, with ``back``, ``past`` (steps 1..``back`` ago).

    Only bars available exactly on the step clock count.  Elements: m, high, low, close.
    """
    span = step_s * max(steps, back)
    block = F.floor(F.col("_a") / span).cast("long")
    reach = F.array(block - 1, block, block + 1) if back else F.array(block - 1, block)
    blocks = (
        bars.select(
            "instrument",
            F.unix_seconds("available_at").alias("_a"),
            "high",
            "low",
            "close",
        )
        .select("*", F.explode(reach).alias("_b"))
        .groupBy("instrument", "_b")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_a").alias("a"), "high", "low", "close"))).alias("_block"))
    )
    placed = signals.withColumn("_b", F.floor(F.col(at) / span).cast("long"))
    joined = (
        placed.alias("l").join(blocks.alias("r"), same_keys(["instrument", "_b"]), "left").select("l.*", "r._block")
    )
    start = F.col(at)
    empty = F.coalesce("_block", F.array().cast("array<struct<a:bigint,high:double,low:double,close:double>>"))

    def rel(x):
        return x["a"] - start

    ahead = F.filter(empty, lambda x: (rel(x) > 0) & (rel(x) <= steps * step_s) & (rel(x) % step_s == 0))
    out = joined.withColumn(
        "path",
        F.transform(
            ahead,
            lambda x: F.struct(
                (rel(x) / step_s).cast("int").alias("m"),
                x["high"].alias("high"),
                x["low"].alias("low"),
                x["close"].alias("close"),
            ),
        ),
    )
    if back:
        behind = F.filter(empty, lambda x: (rel(x) < 0) & (rel(x) >= -back * step_s) & (rel(x) % step_s == 0))
        out = out.withColumn(
            "past",
            F.transform(
                behind,
                lambda x: F.struct((-rel(x) / step_s).cast("int").alias("m"), x["close"].alias("close")),
            ),
        )
    return out.drop("_block", "_b")


def at_step(path: str, step: int, field: str = "close") -> Column:
    return F.get(F.filter(path, lambda x: x["m"] == step), F.lit(0))[field]


def first_step(path: str, condition) -> Column:
    """First step whose bar satisfies ``condition``; NULL when none does."""
    return F.array_min(F.transform(F.filter(path, condition), lambda x: x["m"]))


def missing_steps(path: str, steps: int) -> Column:
    return F.array_except(F.sequence(F.lit(1), F.lit(steps)), F.transform(path, lambda x: x["m"]))


def _peak(moves: Column) -> Column:
    return F.array_max(F.transform(moves, lambda x: x["v"]))


def _peak_time(moves: Column, peak: Column) -> Column:
    return F.array_min(F.transform(F.filter(moves, lambda x: x["v"] == peak), lambda x: x["m"]))


def _moves(fn) -> Column:
    return F.transform("path", lambda x: F.struct(x["m"].alias("m"), fn(x).alias("v")))


def path_diagnostics(signals: DataFrame, steps: int, horizons, past=(), levels=FIRST_PASSAGE_LEVELS) -> DataFrame:
    """Snapshots, first passage, excursions and pre-signal impulse of frozen signals.

    Needs direction, p0, d0, pip and the arrays of :func:`attach_paths`.  Snapshots survive a
    missing bar; everything path-wide is NULL unless all steps are present.
    """
    d, p0, d0, pip = F.col("direction"), F.col("p0"), F.abs(F.col("d0")), F.col("pip")
    good = lambda x: F.when(d > 0, x["high"]).otherwise(x["low"])
    bad = lambda x: F.when(d > 0, x["low"]).otherwise(x["high"])
    rows = signals.withColumns(
        {
            "missing_steps": missing_steps("path", steps),
            "path_complete": F.size("path") == steps,
            "_fav": _moves(lambda x: d * (good(x) - p0)),
            "_adv": _moves(lambda x: -d * (bad(x) - p0)),
        }
    )
    full = F.col("path_complete")
    out = {}
    for h in horizons:
        move = d * (at_step("path", h) - p0)
        out |= {
            f"move_h{h}": move,
            f"bps_h{h}": d * (at_step("path", h) / p0 - 1.0) * 10_000,
            f"pips_h{h}": move / pip,
            f"reversion_h{h}": move / d0,
        }
    for level in levels:
        # The fraction itself is compared, so that equality at a level is decided exactly.
        hit = first_step("path", lambda x: d * (good(x) - p0) / d0 >= level)
        out[f"t{round(level * 100)}"] = F.when(full, hit)
    out["max_reversion"] = F.when(full, _peak(F.col("_fav")) / d0)
    for name, moves in (("mfe", "_fav"), ("mae", "_adv")):
        peak = F.greatest(F.lit(0.0), _peak(F.col(moves)))
        out |= {
            name: F.when(full, peak),
            f"{name}_pips": F.when(full, peak / pip),
            f"{name}_bps": F.when(full, peak / p0 * 10_000),
            f"{name}_fraction": F.when(full, peak / d0),
            f"time_to_{name}": F.when(full, F.coalesce(_peak_time(F.col(moves), peak), F.lit(0))),
        }
    for h in past:
        raw = p0 - F.get(F.filter("past", lambda x: x["m"] == h), F.lit(0))["close"]
        out |= {f"pre_raw_h{h}": raw, f"pre_signed_h{h}": d * raw, f"impulse_h{h}": F.abs(raw) / d0}
    return rows.withColumns(out).drop("_fav", "_adv")


def directional_paths(requests: DataFrame, steps: int, horizons) -> DataFrame:
    """The same without an equilibrium; each step's excursion is clamped at zero."""
    d, p0, pip = F.col("direction"), F.col("p0"), F.col("pip")
    clamp = lambda x, s: F.greatest(F.lit(0.0), s * d * (x["high"] - p0), s * d * (x["low"] - p0))
    rows = requests.withColumns(
        {
            "missing_steps": missing_steps("path", steps),
            "path_complete": F.size("path") == steps,
            "_fav": _moves(lambda x: clamp(x, 1)),
            "_adv": _moves(lambda x: clamp(x, -1)),
        }
    )
    full = F.col("path_complete")
    out = {}
    for h in horizons:
        move = d * (at_step("path", h) - p0)
        out |= {
            f"move_h{h}": move,
            f"bps_h{h}": d * (at_step("path", h) / p0 - 1.0) * 10_000,
            f"pips_h{h}": move / pip,
        }
    for name, moves in (("mfe", "_fav"), ("mae", "_adv")):
        peak = _peak(F.col(moves))
        out |= {
            name: F.when(full, peak),
            f"{name}_pips": F.when(full, peak / pip),
            f"{name}_bps": F.when(full, peak / p0 * 10_000),
            f"time_to_{name}": F.when(full, _peak_time(F.col(moves), peak)),
        }
    return rows.withColumns(out).drop("_fav", "_adv")
