"""The outcome grid where its rows are the result: all of a cell is worked out before cells become rows.

:func:`outcomes.barrier_outcomes` says the same in expressions, cell by cell.  It keeps the way in which
entries were dealt, which groupings of the grid need; the Arrow walk here does not.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewindow.operators.outcomes import SL_FRACTIONS, TP_FRACTIONS

EXTREMES = "struct<f:double,tf:int,a:double,ta:int>"  # most favorable and adverse move, and their steps
TOUCH, DEADLINE = f"struct<at:int,f:double,a:double,before:{EXTREMES}>", f"struct<close:double,upto:{EXTREMES}>"


def _numbers(column):
    """Doubles of an Arrow column, and which of them are NULL."""
    return column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _of_two(x, y, pick=np.maximum):
    """SQL's greatest of two (numbers, nulls): a NULL gives way, a NaN does not.  With ``np.fmin``, its least."""
    return np.where(x[1], y[0], np.where(y[1], x[0], pick(x[0], y[0]))), x[1] & y[1]


def _running(moves, steps):
    """Running maximum of each row's ``moves`` before each of its bars, and the step that set it (ties: the earlier)."""
    most = np.maximum.accumulate(np.pad(moves, ((0, 0), (1, 0))), axis=1)
    raised = (moves > most[:, :-1]) | (np.isnan(moves) & ~np.isnan(most[:, :-1]))
    last = np.maximum.accumulate(np.pad(raised * np.arange(1, moves.shape[1] + 1), ((0, 0), (1, 0))), axis=1)
    return most, np.take_along_axis(np.pad(steps, ((0, 0), (1, 0))), last, axis=1)


def _walker(stops, tps, sls):
    """An Arrow function from an entry and its path to the first touch of each level and the state at each deadline."""
    longest = max(stops)

    def walk(path: pa.Array, wait: pa.Array, executed: pa.Array, direction: pa.Array, p0: pa.Array, d0: pa.Array, entry: pa.Array) -> pa.Array:
        n = len(path)
        wait, direction = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (wait, direction))
        row = np.repeat(np.arange(n), path.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        m, *prices = path.flatten().flatten()
        m = m.to_numpy(zero_copy_only=False) - wait[row]
        own = executed.fill_null(False).to_numpy(zero_copy_only=False)[row] & (m > 0) & (m <= longest)
        row, m = row[own], m[own]
        (high, low, close), d = ((x[own], gone[own]) for x, gone in map(_numbers, prices)), direction[row]
        # Where an entry's own bars lie: one line an entry.
        place = np.arange(len(row)) - np.searchsorted(row, row)
        width = int(place.max(initial=-1)) + 1

        def lines(x, dtype):
            out = np.zeros((n, width), dtype)
            out[row, place] = x
            return out

        def moves(base, sign=1, size=None):
            """The bar's two moves from a price in a direction, as parts of ``size``."""
            base, gone = (x[row] for x in _numbers(base))
            for x, none in (high, low):
                move = sign * d * (x - base)
                yield (move if size is None else move / size), none | gone

        size = np.abs(_numbers(d0)[0])[row]
        if not size.all():
            raise ZeroDivisionError("d0 is zero")
        (up, no_up), (down, no_down) = (_of_two(*moves(p0, 1, size), pick) for pick in (np.maximum, np.fmin))
        zero = (np.zeros(len(row)), np.zeros(len(row), bool))
        f, a = (_of_two(zero, _of_two(*moves(entry, sign)))[0] for sign in (1, -1))
        step = lines(m, np.int32)
        f_most, f_step = _running(lines(f, float), step)
        a_most, a_step = _running(lines(a, float), step)
        every = np.arange(n)

        def first(hit):
            """Per entry: whether a bar hits, and the first that does."""
            at = np.flatnonzero(hit)
            at = at[np.append(True, row[at][1:] != row[at][:-1])] if len(at) else at
            found, bar = np.zeros(n, bool), np.zeros(n, np.int64)
            found[row[at]], bar[row[at]] = True, at
            return found, bar

        def struct(**fields):
            return pa.StructArray.from_arrays(list(fields.values()), list(fields))

        def masked(values, known, kind):
            return pa.array(values, kind, mask=~known)

        def extremes(upto, known):
            return struct(
                f=masked(f_most[every, upto], known, pa.float64()), tf=masked(f_step[every, upto], known, pa.int32()),
                a=masked(a_most[every, upto], known, pa.float64()), ta=masked(a_step[every, upto], known, pa.int32()),
            )

        def at_bar(values, found, bar, kind):
            out = np.zeros(n, values.dtype)
            out[found] = values[bar[found]]
            return masked(out, found, kind)

        def touch(hit):
            found, bar = first(hit)
            upto = np.zeros(n, np.int64)
            upto[found] = place[bar[found]]
            kept = (at_bar(x, found, bar, k) for x, k in ((m, pa.int32()), (f, pa.float64()), (a, pa.float64())))
            return struct(**dict(zip("at f a".split(), kept)), before=extremes(upto, found))

        def deadline(stop):
            found, bar = first((m == stop) & ~close[1])
            upto = np.bincount(row[m <= stop], minlength=n)
            known = executed.fill_null(False).to_numpy(zero_copy_only=False)
            return struct(close=at_bar(close[0], found, bar, pa.float64()), upto=extremes(upto, known))

        # A NaN is above every level, as SQL orders it.
        out = [touch(~no_up & ((up >= v) | np.isnan(up))) for v in tps]
        out += [touch(~no_down & (down <= -v)) for v in sls if v is not None]
        out += [deadline(v) for v in stops]
        return pa.StructArray.from_arrays(out, [f"_{i}" for i in range(len(out))])

    kinds = [TOUCH] * (len(tps) + len([v for v in sls if v is not None])) + [DEADLINE] * len(stops)
    return F.arrow_udf(walk, "struct<" + ",".join(f"_{i}:{kind}" for i, kind in enumerate(kinds)) + ">")


RESULTS = ("gross", "pips", "bp", "fraction")  # of an exit: both bounds of each become columns
EXCURSIONS = ("mae", "mfe", "mae_bound", "mfe_bound", "time_to_mae", "time_to_mfe", "mae_pips", "mfe_pips")


def _ending(at, price, seen, bar=None, gain=None, loss=None, values=(), finish=None) -> Column:
    """What a trade that ends at ``price`` comes to: ``seen`` are the extremes certain before, ``bar`` the last
    bar, whose extremes only bound, ``gain`` or ``loss`` what the exit itself is certain to reach."""
    c, none = F.col, F.lit(0.0)
    d, gross = c("direction"), c("direction") * (price - c("entry_price"))
    fields = {"gross": gross, "pips": gross / c("pip"), "bp": gross / c("entry_price") * 10_000, "fraction": gross / F.abs(c("d0"))}
    reached = {"f": none if gain is None else F.greatest(none, gain), "a": none if loss is None else F.greatest(none, loss)}
    for name, x in (("mae", "a"), ("mfe", "f")):
        most = F.greatest(seen[x], reached[x])
        bound = most if bar is None else F.greatest(most, bar[x])
        time = seen[f"t{x}"] if reached[x] is none else F.when(reached[x] > seen[x], at).otherwise(seen[f"t{x}"])
        # Without a close at the deadline nothing bounds the trade, but what was seen is certain.
        fields |= {name: most, f"{name}_bound": F.when(at.isNotNull(), bound), f"time_to_{name}": time, f"{name}_pips": most / c("pip")}
    kept = {k: v if finish is None or k.startswith("time") else finish(v) for k, v in fields.items() if k in values}
    return F.struct(at.alias("at"), *[v.alias(k) for k, v in kept.items()])


def outcome_grid(entries: DataFrame, stops, tps=TP_FRACTIONS, sls=SL_FRACTIONS, values=RESULTS + EXCURSIONS, finish=None) -> DataFrame:
    """Outcome of every grid cell for every entry, as :func:`outcomes.barrier_outcomes` gives it.

    The path is walked once per entry as Arrow arrays, and what a trade comes to is worked out once
    per barrier level and deadline (and passed to ``finish``, a rounding say), for the ``values``
    asked for; a cell only picks one of these.
    """
    c = F.col
    d, scale = c("direction"), F.abs(c("d0"))
    tag = lambda v: f"{round(v * 100)}"
    names = [f"_tp{tag(v)}" for v in tps] + [f"_sl{tag(v)}" for v in sls if v is not None] + [f"_stop{v}" for v in stops]
    keep = [x for x in entries.columns if x != "path"]
    walk = _walker(tuple(stops), tuple(tps), tuple(sls))
    inputs = [c("path"), c("wait").cast("int"), c("executed"), c("direction").cast("int"), *[c(x).cast("double") for x in ("p0", "d0", "entry_price")]]
    rows = entries.select(*keep, walk(*inputs).alias("_w")).select(*keep, *[c(f"_w._{i}").alias(x) for i, x in enumerate(names)])

    def touched_at(name, price, **reached):
        bar = c(name)
        reached = {k: v * (price - c("entry_price")) for k, v in reached.items()}
        return F.when(bar["at"].isNotNull(), _ending(bar["at"], price, bar["before"], bar, values=values, finish=finish, **reached))

    def timed_out(stop):
        bar = c(f"_stop{stop}")
        at = F.when(bar["close"].isNotNull(), F.lit(stop))
        return _ending(at, bar["close"], bar["upto"], values=values, finish=finish)

    ends = {f"_tp{tag(v)}": touched_at(f"_tp{tag(v)}", c("p0") + d * F.lit(float(v)) * scale, gain=d) for v in tps}
    ends |= {f"_sl{tag(v)}": touched_at(f"_sl{tag(v)}", c("p0") - d * F.lit(float(v)) * scale, loss=-d) for v in sls if v is not None}
    ends |= {f"_stop{v}": timed_out(v) for v in stops}
    rows = rows.select(*keep, *[v.alias(k) for k, v in ends.items()])
    no_stop, never = F.lit(None).cast(rows.schema[f"_tp{tag(tps[0])}"].dataType), max(stops) + 1
    when = {f"_at{k}": F.coalesce(c(k)["at"], F.lit(never)) for k in ends}
    rows = rows.select(*keep, *ends, *[v.alias(k) for k, v in when.items()])
    cells = F.array(
        *[
            F.struct(
                F.lit(float(tp)).alias("tp"),
                F.lit(sl).cast("double").alias("sl"),
                F.lit(stop).alias("stop"),
                c(f"_at_tp{tag(tp)}").alias("_tp_at"),
                (F.lit(never) if sl is None else c(f"_at_sl{tag(sl)}")).alias("_sl_at"),
                c(f"_at_stop{stop}").alias("_end"),
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
    # One projection: a row of the grid is copied once more, not once a step.
    status = F.when(~c("executed"), "no_entry").when(c("r_at_entry") >= c("tp"), "passed").otherwise("executed")
    live = c("executed") & ~F.coalesce(c("r_at_entry") >= c("tp"), F.lit(False))
    by_tp = (c("_tp_at") <= c("stop")) & (c("_tp_at") <= c("_sl_at"))
    by_sl = (c("_sl_at") <= c("stop")) & (c("_sl_at") <= c("_tp_at"))
    touch = F.least("_tp_at", "_sl_at")
    done = live & ((touch <= c("stop")) | (c("_end") < never))
    out = {
        "status": status,
        "complete": done,
        "exit_reason": F.when(
            done,
            F.when(touch > c("stop"), "time_stop").when(c("_tp_at") == c("_sl_at"), "ambiguous").when(by_tp, "tp").otherwise("sl"),
        ),
        "holding": F.when(done, F.least(touch, "stop")),
        "ambiguous": done & by_tp & by_sl,
    }
    # Where one bar meets both, the stop is the adverse end and the target the favorable one; no end is certain
    # then, so mae leaves out the loss that a stop makes certain by the target's end, and mfe the other way round.
    # An end without a close holds no result.
    stop_first = F.when(~live, None).when(by_sl, c("_sl")).when(by_tp, c("_tp")).otherwise(c("_clock"))
    target_first = F.when(~live, None).when(by_tp, c("_tp")).when(by_sl, c("_sl")).otherwise(c("_clock"))
    for v in RESULTS:
        if v in values:
            out |= {f"{v}_adverse": stop_first[v], f"{v}_favorable": target_first[v]}
    for v in EXCURSIONS:
        if v in values:
            out[v] = (target_first if "mae" in v else stop_first)[v]
    return rows.select(*keep, "tp", "sl", "stop", *[v.alias(k) for k, v in out.items()])
