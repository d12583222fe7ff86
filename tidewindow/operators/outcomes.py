"""Entries and barrier outcomes over bounded path arrays (first of target, stop, clock)."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewindow.operators.paths import first_step

# Fixed values of the outcome grid.
TP_FRACTIONS = (0.25, 0.50, 0.75, 1.00)
SL_FRACTIONS = (None, 0.25, 0.50, 1.00)
ENTRY_MODES = ("immediate", "reclaim", "extension-reclaim")


def _fraction(x: Column, field: str) -> Column:
    return F.col("direction") * (x[field] - F.col("p0")) / F.abs(F.col("d0"))


def _fav(x: Column) -> Column:
    return F.greatest(_fraction(x, "high"), _fraction(x, "low"))


def _adv(x: Column) -> Column:
    return F.least(_fraction(x, "high"), _fraction(x, "low"))


def with_entries(candidates: DataFrame, reclaim_steps: int, extension_steps: int, extension: float = 0.25, modes=ENTRY_MODES) -> DataFrame:
    """One row per (candidate, entry mode of ``modes``): executed flag, wait, price and pre-entry extremes."""
    d, p0 = F.col("direction"), F.col("p0")
    reclaimed = lambda x: d * (x["close"] - p0) > 0
    rows = candidates.withColumns(
        {
            "_reclaim": first_step("path", lambda x: (x["m"] <= reclaim_steps) & reclaimed(x)),
            "_ext": first_step("path", lambda x: (x["m"] <= extension_steps) & (_adv(x) <= -extension)),
        }
    )
    rows = rows.withColumn(
        "_ext_entry",
        first_step("path", lambda x: (x["m"] <= extension_steps) & (x["m"] >= F.col("_ext")) & reclaimed(x)),
    )

    def mode(name, wait, limit, ext=None):
        upto = F.coalesce(wait, F.lit(limit))
        seen = F.filter("path", lambda x: x["m"] <= upto)
        extreme = lambda pick, f: pick(F.lit(0.0), F.coalesce(
            (F.array_max if pick is F.greatest else F.array_min)(F.transform(seen, f)), F.lit(0.0)))
        price = F.get(F.filter("path", lambda x: x["m"] == wait), F.lit(0))["close"]
        # The extension clock only counts up to the entry: later bars are not yet known.
        ext_known = F.when(ext <= upto, ext) if ext is not None else F.lit(None).cast("int")
        return F.struct(
            F.lit(name).alias("entry_mode"),
            wait.isNotNull().alias("executed"),
            wait.alias("wait"),
            price.alias("entry_price"),
            (d * (price - p0) / F.abs(F.col("d0"))).alias("r_at_entry"),
            extreme(F.greatest, _fav).alias("pre_entry_favorable"),
            extreme(F.least, _adv).alias("pre_entry_adverse"),
            ext_known.alias("time_to_extension"),
            (wait - ext_known).alias("extension_to_entry"),
        )

    none = F.lit(None).cast("int")
    immediate = F.struct(
        F.lit("immediate").alias("entry_mode"),
        F.lit(True).alias("executed"),
        F.lit(0).alias("wait"),
        p0.alias("entry_price"),
        F.lit(0.0).alias("r_at_entry"),
        F.lit(0.0).alias("pre_entry_favorable"),
        F.lit(0.0).alias("pre_entry_adverse"),
        none.alias("time_to_extension"),
        none.alias("extension_to_entry"),
    )
    every = dict(
        zip(
            ENTRY_MODES,
            (
                immediate,
                mode("reclaim", F.col("_reclaim"), reclaim_steps),
                mode("extension-reclaim", F.col("_ext_entry"), extension_steps, F.col("_ext")),
            ),
        )
    )
    keep = [c for c in candidates.columns]
    return rows.select(*keep, F.explode(F.array(*[every[m] for m in modes])).alias("_e")).select(*keep, "_e.*")


def race(candidates: DataFrame, horizons, levels=(0.25, 0.50)) -> DataFrame:
    """Reversion against extension: first steps, hits and order, one row per horizon."""
    steps = {}
    for level in levels:
        tag = round(level * 100)
        steps[f"_r{tag}"] = first_step("path", lambda x: _fav(x) >= level)
        steps[f"_e{tag}"] = first_step("path", lambda x: _adv(x) <= -level)
    rows = candidates.withColumns(steps).drop("path")

    def at(h):
        fields = [F.lit(h).alias("horizon")]
        for level in levels:
            tag = round(level * 100)
            r = F.when(F.col(f"_r{tag}") <= h, F.col(f"_r{tag}"))
            e = F.when(F.col(f"_e{tag}") <= h, F.col(f"_e{tag}"))
            order = (
                F.when(r.isNull() & e.isNull(), "none")
                .when(e.isNull() | (r < e), "reversion")
                .when(r.isNull() | (e < r), "extension")
                .otherwise("ambiguous_same_minute")
            )
            fields += [
                r.alias(f"time_to_reversion{tag}"),
                e.alias(f"time_to_extension{tag}"),
                order.alias(f"ordering_{tag}"),
            ]
        return F.struct(*fields)

    keep = [c for c in candidates.columns if c != "path"]
    return rows.select(*keep, F.explode(F.array(*[at(h) for h in horizons])).alias("_h")).select(*keep, "_h.*")


def _excursion(sign: int, x: Column) -> Column:
    d, entry = F.col("direction"), F.col("entry_price")
    return F.greatest(F.lit(0.0), sign * d * (x["high"] - entry), sign * d * (x["low"] - entry))


def _walk(entries: DataFrame, longest: int, excursions: bool = True) -> DataFrame:
    """Adds the entry's own path ``_p`` and, with ``excursions``, ``_run``: certain extremes before each of its bars."""
    wait = F.col("wait")
    seen = lambda x: [_excursion(1, x).alias("f"), _excursion(-1, x).alias("a")] if excursions else []
    own = F.transform(
        F.filter("path", lambda x: (x["m"] > wait) & (x["m"] <= wait + longest)),
        lambda x: F.struct(
            (x["m"] - wait).alias("m"), x["close"].alias("close"), _fav(x).alias("fr"), _adv(x).alias("ar"), *seen(x)
        ),
    )
    walked = entries.withColumn("_p", F.when(F.col("executed"), own))
    if not excursions:
        return walked.drop("path")
    # Element i holds the extremes of the first i bars; ties keep the earlier step.
    running = F.expr(
        """aggregate(_p, array(named_struct('f', 0.0D, 'tf', 0, 'a', 0.0D, 'ta', 0)), (s, x) -> concat(s, array(
             named_struct('f', greatest(element_at(s, -1).f, x.f),
                          'tf', if(x.f > element_at(s, -1).f, x.m, element_at(s, -1).tf),
                          'a', greatest(element_at(s, -1).a, x.a),
                          'ta', if(x.a > element_at(s, -1).a, x.m, element_at(s, -1).ta)))))"""
    )
    walked = walked.withColumn("_run", running)
    return walked.withColumn("_m", F.transform("_p", lambda x: x["m"])).drop("path")


def _barrier(condition, excursions: bool = True) -> Column:
    """First bar that touches: its step and extremes, and what was certain before it."""
    bar = F.get(F.filter("_p", condition), F.lit(0))
    if not excursions:
        return F.struct(bar["m"].alias("at"))
    before = F.get("_run", F.array_position("_m", bar["m"]).cast("int") - 1)
    return F.when(
        bar["m"].isNotNull(),
        F.struct(bar["m"].alias("at"), bar["f"].alias("f"), bar["a"].alias("a"), before.alias("before")),
    )


def _clock(stop: int, excursions: bool = True) -> Column:
    """Close at the deadline (NULL when that bar is missing) and the extremes up to it."""
    bar = F.get(F.filter("_p", lambda x: x["m"] == stop), F.lit(0))
    if not excursions:
        return F.struct(bar["close"].alias("close"))
    seen = F.size(F.filter("_m", lambda m: m <= stop))
    return F.struct(bar["close"].alias("close"), F.get("_run", seen).alias("upto"))


def _first_touches(entries: DataFrame, stops, tps, sls) -> DataFrame:
    """Adds, per entry, the step of each level's first touch (``_tp..``, ``_sl..``) and whether each deadline
    has its bar (``_at..``): all that a cell's flags need, so no excursion is walked."""
    c, tag = F.col, lambda v: f"{round(v * 100)}"
    wait, longest = c("wait"), max(stops)
    # Both fractions of a bar once, not once per level.
    own = F.transform(
        F.filter("path", lambda x: (x["m"] > wait) & (x["m"] <= wait + longest)),
        lambda x: F.struct((x["m"] - wait).alias("m"), _fav(x).alias("fr"), _adv(x).alias("ar")),
    )
    keep = [x for x in entries.columns if x != "path"]
    rows = entries.select(*keep, own.alias("_p"))
    touch = lambda hit: F.get(F.filter("_p", hit), F.lit(0))["m"]
    steps = {f"_tp{tag(v)}": touch(lambda x: x["fr"] >= v) for v in tps}
    steps |= {f"_sl{tag(v)}": touch(lambda x: x["ar"] <= -v) for v in sls if v is not None}
    steps |= {f"_at{v}": F.exists("_p", lambda x: x["m"] == v) for v in stops}
    return rows.withColumns(steps).select(*keep, *steps)


def outcome_counts(entries: DataFrame, stops, tps=TP_FRACTIONS, sls=SL_FRACTIONS) -> DataFrame:
    """Per entry, how many of its grid cells are no_entry, passed, executed, incomplete, ambiguous.

    No cell becomes a row: a cell is incomplete where its target, its stop and its deadline all fail,
    so counts of targets, stops and deadlines that fail are multiplied.
    """
    c, tag = F.col, lambda v: f"{round(v * 100)}"
    rows = _first_touches(entries, stops, tps, sls)
    keep = [x for x in entries.columns if x != "path"]
    one = lambda hit: F.coalesce(hit, F.lit(False)).cast("int")
    total = lambda items: reduce(lambda a, b: a + b, items, F.lit(0))
    passed = {tp: one(c("r_at_entry") >= tp) for tp in tps}
    up, down = {tp: c(f"_tp{tag(tp)}") for tp in tps}, {sl: c(f"_sl{tag(sl)}") for sl in sls if sl is not None}
    open_up = lambda stop: total((1 - passed[tp]) * (1 - one(up[tp] <= stop)) for tp in tps)
    open_down = lambda stop: total(1 - one(down[sl] <= stop) if sl is not None else F.lit(1) for sl in sls)
    within = lambda step: total(one(step <= stop) for stop in stops)
    n, per_tp = len(tps) * len(sls) * len(stops), len(sls) * len(stops)
    behind = total(passed.values()) * per_tp
    when = lambda count: F.when(c("executed"), count).otherwise(0)
    counts = {
        "no_entry": F.when(c("executed"), 0).otherwise(n),
        "passed": when(behind),
        "executed_cells": when(n - behind),
        "incomplete": when(total((1 - one(c(f"_at{stop}"))) * open_up(stop) * open_down(stop) for stop in stops)),
        "ambiguous": when(total((1 - passed[tp]) * one(up[tp] == x) * within(x) for tp in tps for x in down.values())),
    }
    return rows.select(*keep, *[v.alias(k) for k, v in counts.items()])


def with_trade(entries: DataFrame, stops, tps=TP_FRACTIONS, sls=SL_FRACTIONS) -> DataFrame:
    """The entries, without their paths, of which at least one grid cell is a complete trade.

    That takes a target not yet passed, and a bar that meets the least such target, the least stop or a deadline.
    """
    wait, live = F.col("wait"), [F.when(~F.coalesce(F.col("r_at_entry") >= tp, F.lit(False)), F.lit(float(tp))) for tp in tps]
    target, losses = F.array_min(F.array(*live)), [sl for sl in sls if sl is not None]

    def ends(x):
        hit = (x["m"] - wait).isin(*stops) | (_fav(x) >= target)
        return hit | (_adv(x) <= -min(losses)) if losses else hit

    met = F.exists("path", lambda x: (x["m"] > wait) & (x["m"] <= wait + max(stops)) & ends(x))
    return entries.where(F.col("executed") & target.isNotNull() & met).drop("path")


def barrier_outcomes(entries: DataFrame, stops, tps=TP_FRACTIONS, sls=SL_FRACTIONS, excursions: bool = True) -> DataFrame:
    """Outcome of every grid cell for every entry; without ``excursions`` the columns of mae and mfe are left out.

    The path is walked once per entry, each barrier level and deadline is resolved once, and
    the cells only combine those few structs.  ``status``: executed, passed (the target is
    already behind the entry) or no_entry.
    """
    c = F.col
    d, scale = c("direction"), F.abs(c("d0"))
    tag = lambda v: f"{round(v * 100)}"
    rows = _walk(entries, max(stops), excursions)
    resolved = {f"_tp{tag(v)}": _barrier(lambda x: x["fr"] >= v, excursions) for v in tps}
    resolved |= {f"_sl{tag(v)}": _barrier(lambda x: x["ar"] <= -v, excursions) for v in sls if v is not None}
    resolved |= {f"_stop{v}": _clock(v, excursions) for v in stops}
    keep = [x for x in entries.columns if x != "path"]
    rows = rows.withColumns(resolved).select(*keep, *resolved)
    no_stop = F.lit(None).cast(rows.schema[f"_tp{tag(tps[0])}"].dataType)
    cells = F.array(
        *[
            F.struct(
                F.lit(float(tp)).alias("tp"),
                F.lit(sl).cast("double").alias("sl"),
                F.lit(stop).alias("stop"),
                c(f"_tp{tag(tp)}").alias("_tp"),
                (no_stop if sl is None else c(f"_sl{tag(sl)}")).alias("_sl"),
                c(f"_stop{stop}").alias("_clock"),
            )
            for tp in tps
            for sl in sls
            for stop in stops
        ]
    )
    rows = rows.select(*keep, F.inline(cells))
    tp_at = F.when(c("_tp.at") <= c("stop"), c("_tp.at"))
    sl_at = F.when(c("_sl.at") <= c("stop"), c("_sl.at"))
    status = F.when(~c("executed"), "no_entry").when(c("r_at_entry") >= c("tp"), "passed").otherwise("executed")
    rows = rows.withColumns({"status": status, "_touch": F.least(tp_at, sl_at)})
    touched, live = c("_touch").isNotNull(), c("status") == "executed"
    rows = rows.withColumns(
        {
            "complete": live & (touched | c("_clock.close").isNotNull()),
            "_by_tp": touched & F.coalesce(tp_at == c("_touch"), F.lit(False)),
            "_by_sl": touched & F.coalesce(sl_at == c("_touch"), F.lit(False)),
            "_tp_price": c("p0") + d * c("tp") * scale,
            "_sl_price": c("p0") - d * c("sl") * scale,
        }
    )
    done, by_tp, by_sl = c("complete"), c("_by_tp"), c("_by_sl")
    gain = F.greatest(F.lit(0.0), d * (c("_tp_price") - c("entry_price")))
    loss = F.greatest(F.lit(0.0), -d * (c("_sl_price") - c("entry_price")))
    adverse = F.when(by_sl, c("_sl_price")).when(by_tp, c("_tp_price")).otherwise(c("_clock.close"))
    favorable = F.when(by_tp, c("_tp_price")).when(by_sl, c("_sl_price")).otherwise(c("_clock.close"))
    rows = rows.withColumns(
        {
            "exit_reason": F.when(
                done,
                F.when(~touched, "time_stop").when(by_tp & by_sl, "ambiguous").when(by_tp, "tp").otherwise("sl"),
            ),
            "holding": F.when(done, F.coalesce("_touch", "stop")),
            "ambiguous": done & by_tp & by_sl,
            "gross_adverse": F.when(done, d * (adverse - c("entry_price"))),
            "gross_favorable": F.when(done, d * (favorable - c("entry_price"))),
        }
    )
    rows = rows.withColumns(
        {
            "pips_adverse": c("gross_adverse") / c("pip"),
            "pips_favorable": c("gross_favorable") / c("pip"),
            "bp_adverse": c("gross_adverse") / c("entry_price") * 10_000,
            "bp_favorable": c("gross_favorable") / c("entry_price") * 10_000,
            "fraction_adverse": c("gross_adverse") / scale,
            "fraction_favorable": c("gross_favorable") / scale,
        }
    )
    if not excursions:
        return rows.drop(*[x for x in rows.columns if x.startswith("_")])
    bar = F.when(by_tp, c("_tp")).when(by_sl, c("_sl"))
    rows = rows.withColumns(
        {
            "_bar": bar,
            "_certain": F.when(touched, bar["before"]).otherwise(c("_clock.upto")),
            "_exit_f": F.when(by_tp & ~by_sl, gain).otherwise(0.0),
            "_exit_a": F.when(by_sl & ~by_tp, loss).otherwise(0.0),
        }
    )
    rows = rows.withColumns(
        {
            "mae": F.when(live, F.greatest("_certain.a", "_exit_a")),
            "mfe": F.when(live, F.greatest("_certain.f", "_exit_f")),
            "mae_bound": F.when(done, F.greatest("_certain.a", "_exit_a", "_bar.a")),
            "mfe_bound": F.when(done, F.greatest("_certain.f", "_exit_f", "_bar.f")),
            "time_to_mae": F.when(live, F.when(c("_exit_a") > c("_certain.a"), c("_touch")).otherwise(c("_certain.ta"))),
            "time_to_mfe": F.when(live, F.when(c("_exit_f") > c("_certain.f"), c("_touch")).otherwise(c("_certain.tf"))),
        }
    )
    return rows.withColumns({"mae_pips": c("mae") / c("pip"), "mfe_pips": c("mfe") / c("pip")}).drop(*[x for x in rows.columns if x.startswith("_")])
