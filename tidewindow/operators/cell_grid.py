"""Reports on the outcome grid, worked out as arrays where the events of a cell lie.

:func:`outcomes.barrier_outcomes` and the reports of ``summaries`` say the same in expressions, a row per event
and cell.  Here a row is one event with its path and costs: entries, barriers, cells, scenarios and statistics
are matrices of (events, cells), and only what a report returns becomes a row.
"""

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewindow.operators.outcomes import ENTRY_MODES, SL_FRACTIONS, TP_FRACTIONS
from tidewindow.operators.summaries import QUANTS

TP, SL, STOP = range(3)
CHUNK = 500  # events worked on at once, or one group
NONE = np.nan
NAMELESS = "nu"  # what families.scenario_names calls trades without a price: a NULL in two characters


def near6(x):
    """``study.near6`` of an array; NaN stands for NULL."""
    size = np.abs(x)
    small, large = (np.rint((x + nudge) * per) / per for nudge, per in ((2.71828e-7, 1e6), (2.71828e-4, 1e3)))
    return np.where(size < 1e-6, 0.0, np.where(size < 1000, small, large))


def _over(part, whole):
    """``part / whole``, NaN where there is nothing to divide by."""
    return np.where(whole != 0, part / np.where(whole != 0, whole, 1), NONE)


def _fraction(part, whole):
    return np.where(whole != 0, part / np.where(whole != 0, whole, 1), 0.0)


def _doubles(column) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(NONE).to_numpy(zero_copy_only=False)


class Grid:
    """Outcomes of whole groups of events in every cell, one entry mode at a time."""

    def __init__(self, rows: pa.RecordBatch, starts, stops, reclaim: int, extension: int, level: float = 0.25):
        c = rows.column
        self.rows, self.starts, self.stops = rows, starts, stops
        self.size = np.diff(np.append(starts, len(rows)))
        self.group = np.repeat(np.arange(len(starts)), self.size)
        self.cells = np.array([(tp, NONE if sl is None else sl, stop) for tp in TP_FRACTIONS for sl in SL_FRACTIONS for stop in stops])
        where = np.array([(t, s, x) for t in range(len(TP_FRACTIONS)) for s in range(len(SL_FRACTIONS)) for x in range(len(stops))])
        self.pick = [where[:, i] for i in range(3)]
        self.limits = (reclaim, extension, level)
        self.d = c("direction").cast(pa.float64()).to_numpy(zero_copy_only=False)[:, None]
        self.p0, self.d0, self.pip = (_doubles(c(x))[:, None] for x in ("p0", "d0", "pip"))
        self.scale = np.abs(self.d0)
        self.at = c("at").to_numpy(zero_copy_only=False)
        again = np.append(False, (self.at[1:] == self.at[:-1]) & (self.group[1:] == self.group[:-1]))
        self.clocks = None if not again.any() else np.flatnonzero(~again)
        path, steps = c("path"), extension + max(stops)
        row = np.repeat(np.arange(len(rows)), path.value_lengths().to_numpy(zero_copy_only=False))
        if not self.scale[row].all():
            raise ZeroDivisionError("d0 is zero")
        m, *prices = path.flatten().flatten()
        m = m.to_numpy(zero_copy_only=False)
        # A bar lies at its step, and a step without one is NaN, which meets no level.
        self.high, self.low, self.close = (self._lines(row, m, _doubles(x), steps) for x in prices)
        parts = [self.d * (x - self.p0) / self.scale for x in (self.high, self.low)]
        self.up, self.down = np.fmax(*parts), np.fmin(*parts)

    def _lines(self, row, m, values, steps):
        out = np.full((len(self.rows), steps + 1), NONE)
        out[row, m] = values
        return out

    def _first(self, hit, never):
        """Per event the first step (column) that hits."""
        return np.where(hit.any(axis=1), hit.argmax(axis=1), never)

    def enter(self, mode: str):
        """Wait (-1: no entry) and the extreme seen against the trade before it, as ``outcomes.with_entries``."""
        reclaim, extension, level = self.limits
        if mode == "immediate":
            return np.zeros(len(self.rows), np.int64), np.zeros(len(self.rows))
        limit, step = (reclaim if mode == "reclaim" else extension), np.arange(self.up.shape[1])
        reclaimed = (self.d * (self.close - self.p0) > 0) & (step <= limit)
        if mode != "reclaim":
            reached = self._first((self.down <= -level) & (step <= limit), limit + 1)
            reclaimed &= step >= reached[:, None]
        wait = self._first(reclaimed, -1)
        upto = np.where(wait < 0, limit, wait)
        seen = np.where(step <= upto[:, None], self.down, NONE)
        return wait, np.fmin(np.fmin.reduce(seen, axis=1), 0.0)

    def trade(self, mode: str, excursions: bool) -> None:
        """Sets what every cell comes to under an entry mode: matrices of (events, cells)."""
        every, longest = np.arange(len(self.rows))[:, None], max(self.stops)
        self.wait, self.pre_adverse = self.enter(mode)
        self.executed = self.wait >= 0
        wait = np.maximum(self.wait, 0)
        own = np.minimum(wait[:, None] + np.arange(longest + 1), self.up.shape[1] - 1)
        # Step 0 is the entry's own bar and never counts.
        up, down, high, low, close = (np.take_along_axis(x, own, axis=1) for x in (self.up, self.down, self.high, self.low, self.close))
        up[:, 0] = down[:, 0] = NONE
        entry = self.p0 if mode == "immediate" else self.close[every, wait[:, None]]
        self.entry = np.where(self.executed[:, None], entry, NONE)
        self.r = np.zeros(len(wait)) if mode == "immediate" else (self.d * (self.entry - self.p0) / self.scale)[:, 0]
        never = longest + 1
        tp_at = np.stack([self._first(up >= v, never) for v in TP_FRACTIONS], axis=1)
        sl_at = np.stack([np.full(len(wait), never) if v is None else self._first(down <= -v, never) for v in SL_FRACTIONS], axis=1)
        tp_price = self.p0 + self.d * np.array(TP_FRACTIONS) * self.scale
        sl_price = self.p0 - self.d * np.array([NONE if v is None else v for v in SL_FRACTIONS]) * self.scale
        gross = [self.d * (price - self.entry) for price in (tp_price, sl_price, close[:, list(self.stops)])]
        t, s, x = self.pick
        stop = self.cells[:, STOP].astype(int)
        tp_at, sl_at = tp_at[:, t], sl_at[:, s]
        touch = np.minimum(tp_at, sl_at)
        self.touched = touch <= stop
        self.passed = (self.executed[:, None] & (self.r[:, None] >= np.array(TP_FRACTIONS)))[:, t]
        self.live = self.executed[:, None] & ~self.passed
        self.done = self.live & (self.touched | ~np.isnan(gross[2])[:, x])
        self.by_tp, self.by_sl = self.touched & (tp_at == touch), self.touched & (sl_at == touch)
        self.holding = np.where(self.touched, touch, stop)

        def ends(values, sl_first):
            tp, sl, timed = values[0][:, t], values[1][:, s], values[2][:, x]
            if sl_first:
                return np.where(self.by_sl, sl, np.where(self.by_tp, tp, timed))
            return np.where(self.by_tp, tp, np.where(self.by_sl, sl, timed))

        pips = [v / self.pip for v in gross]
        self.adverse, self.favorable = ends(pips, True), ends(pips, False)
        self.bp = partial(ends, [v / self.entry * 10_000 for v in gross], True)
        if not excursions:
            return
        runs = []
        for sign in (1, -1):
            move = np.fmax(np.fmax(sign * self.d * (high - self.entry), sign * self.d * (low - self.entry)), 0.0)
            move[:, 0] = 0.0
            runs.append(np.maximum.accumulate(move, axis=1))
        f, a = runs
        certain = np.where(self.touched, touch - 1, stop)
        f, a = f[every, certain], a[every, certain]
        gain, loss = np.maximum(gross[0], 0.0)[:, t], np.maximum(-gross[1], 0.0)[:, s]
        self.mae = np.where(self.by_sl & ~self.by_tp, np.maximum(a, loss), a) / self.pip
        self.mfe = np.where(self.by_tp & ~self.by_sl, np.maximum(f, gain), f) / self.pip

    def total(self, x, there=None):
        """Sum (count, of flags) per group and cell, where ``there``."""
        x = x if there is None else np.where(there, x, 0)
        return np.add.reduceat(x, self.starts, axis=0, dtype=np.int64 if x.dtype == bool else None)

    def distinct(self, there):
        """Distinct clocks, and so events, per group and cell."""
        if self.clocks is None:
            return self.total(there)
        first = np.logical_or.reduceat(there, self.clocks, axis=0)
        return np.add.reduceat(first, np.searchsorted(self.clocks, self.starts), axis=0, dtype=np.int64)

    def blocks(self):
        """Groups of about one size, and the rows of each side by side (the last is repeated)."""
        bits = np.ceil(np.log2(self.size)).astype(int)
        for bit in np.unique(bits):
            groups = np.flatnonzero(bits == bit)
            place = np.arange(self.size[groups].max())
            inside = place < self.size[groups][:, None]
            yield groups, np.where(inside, self.starts[groups][:, None] + place, self.starts[groups][:, None]), inside

    def ordered(self, x, there):
        """Per block of groups: its groups and ``x`` (groups, cells, rows) in ascending order, NaN behind."""
        kept = np.where(there, x, NONE)
        for groups, rows, inside in self.blocks():
            yield groups, np.sort(np.where(inside[:, None, :], kept[rows].transpose(0, 2, 1), NONE), axis=2)

    def quantiles(self, x, there, wanted) -> dict:
        """Nearest-rank quantiles per group and cell; NaN where there is no value."""
        out = {q: np.full((len(self.starts), len(self.cells)), NONE) for q in wanted}
        for groups, values in self.ordered(x, there):
            n = (~np.isnan(values)).sum(axis=2)
            for q, p in wanted.items():
                rank = np.maximum(np.ceil(p * n).astype(int), 1) - 1
                out[q][groups] = np.take_along_axis(values, rank[:, :, None], axis=2)[:, :, 0]
        return out


class Costs:
    """The cost scenarios of every group: matrices of (groups, scenarios), one instrument and session a group."""

    def __init__(self, grid: Grid):
        rows = grid.rows.take(pa.array(grid.starts)).select(["cost_status", "scenarios", "converted"])
        held = rows.column("scenarios")
        self.covered = np.array(rows.column("cost_status").to_pylist()) == "covered"
        n = np.where(self.covered, held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
        held = held.filter(pa.array(n > 0))
        flat = held.flatten()
        self.there = np.arange(int(n.max(initial=0))) < n[:, None]
        self.names, self.code = pa.array([], pa.string()), np.zeros(self.there.shape, int)
        self.spread, self.slippage, self.commission = (np.full(self.there.shape, NONE) for _ in range(3))
        if len(flat):
            names = flat.field("statistic").dictionary_encode()
            self.names = names.dictionary
            self.code[self.there] = names.indices.to_numpy(zero_copy_only=False)
            for x in ("spread", "slippage", "commission"):
                getattr(self, x)[self.there] = _doubles(flat.field(x))
        self.converted = rows.column("converted").to_numpy(zero_copy_only=False).astype(bool)

    def net(self, pips, converted, spread, slippage, commission):
        """``scalars.net_pips`` of arrays."""
        x = pips - spread - slippage
        return np.where(converted, np.where(x > 0, x * 0.993, x * 1.007), x) - commission


def _whole_groups(batches: Iterator[pa.RecordBatch], keys) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that come in the order of ``keys``, as whole groups of about ``CHUNK`` rows, and where each group starts."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        # The last group may go on in the next batch.
        last = int(_starts(table, keys)[-1]) if len(table) >= CHUNK else 0
        yield from _cut(table.slice(0, last), keys)
        held = table.slice(last)
    if held is not None:
        yield from _cut(held, keys)


def _starts(table: pa.Table, keys) -> np.ndarray:
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _cut(table: pa.Table, keys):
    starts, first = _starts(table, keys), 0
    while first < len(starts):
        after = max(int(np.searchsorted(starts, starts[first] + CHUNK)), first + 1)
        end = int(starts[after]) if after < len(starts) else len(table)
        own = starts[first:after]
        yield table.slice(own[0], end - own[0]).combine_chunks().to_batches()[0], own - own[0]
        first = after


def _column(values, kind=None):
    """An Arrow column of an array: doubles are rounded, and NaN becomes NULL."""
    if isinstance(values, pa.Array):
        return values
    if values.dtype == float and kind != "plain":
        values = near6(values)
    return pa.array(values, mask=np.isnan(values) if values.dtype == float else None)


def _nested(there, columns: dict, plain=()) -> pa.ListArray:
    """One list of structs per group, of the entries that are ``there``, from arrays of one shape (groups first)."""
    counts = there.reshape(len(there), -1).sum(axis=1)
    offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
    fields = [x[there] if isinstance(x, np.ndarray) else x(there) for x in columns.values()]
    fields = [_column(x, "plain" if k in plain else None) for k, x in zip(columns, fields)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, list(columns)))


EXITS = ("tp", "sl", "stop")


def _exits(grid: Grid, extra: int = 0) -> dict:
    shape = (len(grid.starts), len(grid.cells)) + (1,) * extra
    tp, sl, stop = (np.broadcast_to(grid.cells[:, i].reshape((1, -1) + (1,) * extra), shape) for i in range(3))
    return {"tp": tp, "sl": sl, "stop": stop.astype(np.int64)}


def _spread_out(columns: dict, shape) -> dict:
    return {k: np.broadcast_to(x, shape) if isinstance(x, np.ndarray) else x for k, x in columns.items()}


def matrix(grid: Grid) -> pa.ListArray:
    """``summaries.outcome_matrix`` of every cell."""
    g, done = grid, grid.done
    total, n = g.total, g.total(done)
    x = g.adverse
    mean = lambda v: _over(total(np.broadcast_to(v, done.shape), done), n)
    share = lambda flag: _fraction(total(flag & done), n)
    ambiguous, stop_like = g.by_tp & g.by_sl, g.by_sl
    tp, timed = g.by_tp & ~g.by_sl, ~g.touched
    wait, r, pre = (v[:, None].astype(float) for v in (g.wait, g.r, g.pre_adverse))
    every = np.ones(done.shape, bool)
    out = _exits(g) | {
        "candidates": g.distinct(every),
        "executed": total(g.live), "no_entry": total(every & ~g.executed[:, None]), "passed": total(g.passed),
        "complete_trades": n, "incomplete_trades": total(g.live & ~done),
        "ambiguous_count": total(ambiguous & done), "ambiguous_fraction": share(ambiguous),
        "tp_count": total(tp & done), "tp_fraction": share(tp),
        "sl_count": total(stop_like & done), "sl_fraction": share(stop_like),
        "time_stop_count": total(timed & done), "time_stop_fraction": share(timed),
        "mean_pips": mean(x), "mean_pips_favorable": mean(g.favorable), "mean_bp": mean(bp := g.bp()),
        "win_fraction": share(x > 0), "loss_fraction": share(x < 0), "zero_fraction": share(x == 0),
        "mean_mae_pips": mean(g.mae), "mean_mfe_pips": mean(g.mfe), "mean_wait": mean(wait),
    }
    values = {
        "pips_adverse": x, "bp_adverse": bp, "mae_pips": g.mae, "mfe_pips": g.mfe, "holding": g.holding.astype(float),
        "wait": wait, "r_at_entry": r, "pre_entry_adverse": pre,
    }
    for name, v in values.items():
        out |= {f"{name}_{q}": found for q, found in g.quantiles(v, done, QUANTS).items()}
    return _nested(np.ones(n.shape, bool), out, EXITS)


def distributions(grid: Grid) -> pa.ListArray:
    """``summaries.long_distributions`` of every cell with trades, its metrics and quantiles side by side."""
    n = grid.total(grid.done)
    out = _exits(grid) | {"sample_count": n}
    for name, v in {"gross_pips": grid.adverse, "mae_pips": grid.mae, "mfe_pips": grid.mfe, "holding": grid.holding.astype(float)}.items():
        out |= {f"{name}_{q}": found for q, found in grid.quantiles(v, grid.done, QUANTS).items()}
    return _nested(n > 0, out, EXITS)


def _split(grid: Grid, costs: Costs):
    """Trades that are priced, and those that are blocked or refused."""
    finite = np.isfinite(grid.adverse) & np.isfinite(grid.favorable)
    priced = grid.done & finite & costs.covered[grid.group][:, None]
    return priced, grid.done & ~priced


def _labels(names: pa.Array, code):
    """Text of every entry by its number; NULL under a negative one."""

    def take(there):
        index = code[there]
        return pa.DictionaryArray.from_arrays(pa.array(index, pa.int32(), mask=index < 0), names).cast(pa.string())

    return take


def _statistics(costs: Costs, shape):
    """The statistic of every scenario, NULL in the places behind the last."""
    behind = shape[-1] - costs.code.shape[1]
    code = np.pad(costs.code, ((0, 0), (0, behind)), constant_values=-1)
    return _labels(costs.names, np.broadcast_to(code[:, None, :] if len(shape) == 3 else code, shape))


def _scenarios(grid: Grid, costs: Costs, priced):
    """Each scenario's number, and the net results of all trades under it."""
    g, conv = grid.group, costs.converted[grid.group][:, None]
    for i in range(costs.there.shape[1]):
        fixed = [x[g, i][:, None] for x in (costs.spread, costs.slippage, costs.commission)]
        there = priced & costs.there[g, i][:, None]
        yield i, there, *[np.where(there, costs.net(x, conv, *fixed), 0.0) for x in (grid.adverse, grid.favorable)]


def _factor(gains, losses):
    return np.where(losses > 0, _over(gains, losses), np.where(gains > 0, np.inf, 0.0))


def priced_cells(grid: Grid) -> pa.ListArray:
    """``summaries.scenario_cells`` of every cell and scenario; trades without a price come last, under no scenario."""
    costs = Costs(grid)
    priced, other = _split(grid, costs)
    scenarios = costs.there.shape[1]
    shape = (len(grid.starts), len(grid.cells), scenarios + 1)
    names = ("mean_net", "mean_net_favorable", "win_fraction", "loss_fraction", "zero_fraction", "profit_factor", "mean_gross", "mean_cost")
    wanted = {k: v for k, v in QUANTS.items() if k != "p95"}
    out = {k: np.full(shape, NONE) for k in (*names, *wanted, "headroom", "break_even_slippage", "extra_slippage")}
    trades = np.zeros(shape, np.int64)
    n, gross = grid.total(priced), grid.total(grid.adverse, priced)
    mean_gross = _over(gross, n)
    for i, there, net, best in _scenarios(grid, costs, priced):
        known = costs.there[:, i][:, None]
        trades[:, :, i] = np.where(known, n, 0)
        gains, losses = grid.total(np.maximum(net, 0.0)), -grid.total(np.minimum(net, 0.0))
        win, loss = grid.total(net > 0, there), grid.total(net < 0, there)
        sp, sl, cm = (x[:, i][:, None] for x in (costs.spread, costs.slippage, costs.commission))
        found = (
            grid.total(net) / np.maximum(n, 1), grid.total(best) / np.maximum(n, 1), _over(win, n), _over(loss, n), _over(n - win - loss, n),
            _factor(gains, losses), mean_gross, sp + sl + cm,
        )
        for name, x in zip(names, found):
            out[name][:, :, i] = x
        out["headroom"][:, :, i] = mean_gross - (sp + cm) - sl
    for groups, values in grid.ordered(grid.adverse, priced):
        known = ~np.isnan(values)
        count, conv = known.sum(axis=2), costs.converted[groups][:, None]
        # Net results rise with gross ones, so one order serves all scenarios.
        for q, p in wanted.items():
            rank = np.maximum(np.ceil(p * count).astype(int), 1) - 1
            x = np.take_along_axis(values, rank[:, :, None], axis=2)
            fixed = [v[groups][:, None, :] for v in (costs.spread, costs.slippage, costs.commission)]
            out[q][groups, :, :scenarios] = costs.net(x, conv[:, :, None], *fixed)
        held, place = np.where(known, values, 0.0), np.arange(1, values.shape[2] + 1)
        low, whole = np.cumsum(held, axis=2), held.sum(axis=2)
        done = {}
        for i in range(scenarios):
            spread, commission = costs.spread[groups, i], costs.commission[groups, i]
            # Slippages of a statistic share its spread and so its zero.
            key = (spread.tobytes(), commission.tobytes())
            if key not in done:
                done[key] = _break_even(values, known, place, count, low, whole, mean_gross[groups], spread[:, None], commission[:, None], conv)
            out["break_even_slippage"][groups, :, i] = done[key]
    extra = out["break_even_slippage"][:, :, :scenarios] - costs.slippage[:, None, :]
    out["extra_slippage"][:, :, :scenarios] = np.maximum(extra, 0.0)
    rest = grid.total(other)
    trades[:, :, -1] = rest
    out["mean_gross"][:, :, -1] = _over(grid.total(grid.adverse, other), rest)
    out["profit_factor"][:, :, -1] = 0.0
    slippage = np.pad(costs.slippage, ((0, 0), (0, 1)), constant_values=NONE)[:, None, :]
    columns = _exits(grid, 1) | {"statistic": _statistics(costs, shape), "slippage": slippage, "trades": trades} | out
    return _nested(trades > 0, _spread_out(columns, shape), (*EXITS, "slippage"))


def _break_even(values, known, place, n, low, whole, mean_gross, spread, commission, converted):
    """The slippage at which a cell's mean net result is zero; see ``costs.break_even``."""
    kink = values - spread[:, :, None]
    upto = low - place * spread[:, :, None]
    above = (whole - n * spread)[:, :, None] - upto
    total = 0.993 * (above - (n[:, :, None] - place) * kink) + 1.007 * (upto - place * kink)
    # The total falls with slippage: trades whose kink is still above the target are those before the zero.
    before = known & (total > (commission * n)[:, :, None])
    lost, lost_sum = before.sum(axis=2), np.where(before, kink, 0.0).sum(axis=2)
    flat = np.where(known, kink, 0.0)
    root = _over(0.993 * (flat.sum(axis=2) - lost_sum) + 1.007 * lost_sum - commission * n, 0.993 * (n - lost) + 1.007 * lost)
    mean = np.where(converted, _over(np.where(flat > 0, flat * 0.993, flat * 1.007).sum(axis=2), n) - commission, mean_gross - spread - commission)
    return np.where(mean <= 0, 0.0, np.where(converted, root, mean))


def priced_sums(grid: Grid) -> pa.ListArray:
    """Sums of every scenario over the cells of a group, to be merged (``priced_scenarios``)."""
    costs = Costs(grid)
    priced, other = _split(grid, costs)
    shape = (len(grid.starts), costs.there.shape[1] + 2)
    sums = {k: np.full(shape, NONE) for k in ("slippage", "net_adverse", "net_favorable", "spread", "commission", "modeled")}
    rows = np.zeros(shape, np.int64)
    for i, there, net, best in _scenarios(grid, costs, priced):
        rows[:, i] = grid.total(there).sum(axis=1)
        sums["net_adverse"][:, i], sums["net_favorable"][:, i] = grid.total(net).sum(axis=1), grid.total(best).sum(axis=1)
        for x in ("spread", "slippage", "commission"):
            sums[x][:, i] = getattr(costs, x)[:, i]
        sums["modeled"][:, i] = (sums["spread"][:, i] + sums["slippage"][:, i] + sums["commission"][:, i]) * rows[:, i]
    finite = np.isfinite(grid.adverse) & np.isfinite(grid.favorable)
    rows[:, -2], rows[:, -1] = grid.total(other & finite).sum(axis=1), grid.total(other & ~finite).sum(axis=1)
    status = np.broadcast_to(np.array([0] * (shape[1] - 2) + [1, 2]), shape)
    texts = {"statistic": _statistics(costs, shape), "cost_status": _labels(pa.array(["covered", "blocked", "refused"]), status)}
    columns = texts | {"rows": rows} | sums
    return _nested(rows > 0, columns, tuple(sums))


def positive_cells(grid: Grid) -> pa.ListArray:
    """How many cells of a group stay positive under every scenario, to be merged (``regime_breadth``)."""
    costs = Costs(grid)
    priced, other = _split(grid, costs)
    shape = (len(grid.starts), costs.there.shape[1] + 1)
    out = {k: np.zeros(shape, np.int64) for k in ("cells", "net_positive", "gross_positive", "both_positive")}

    def put(i, n, gross, net):
        there, g, x = n > 0, gross > 0, net > 0
        for k, v in zip(out, (there, there & x, there & g, there & g & x)):
            out[k][:, i] = v.sum(axis=1)

    gross = grid.total(grid.adverse, priced)
    for i, there, net, _ in _scenarios(grid, costs, priced):
        put(i, grid.total(there), gross, grid.total(net))
    rest = grid.total(other)
    put(-1, rest, grid.total(grid.adverse, other), np.zeros(rest.shape))
    slippage = np.pad(costs.slippage, ((0, 0), (0, 1)), constant_values=NONE)
    return _nested(out["cells"] > 0, {"statistic": _statistics(costs, shape), "slippage": slippage} | out, ("slippage",))


def atlas(headline, grid: Grid) -> pa.ListArray:
    """``summaries.cell_metrics`` of every cell: gross, under each headline scenario, and of trades without a price."""
    costs = Costs(grid)
    priced, other = _split(grid, costs)
    month = grid.at.astype("datetime64[s]").astype("datetime64[M]").astype(np.int64)
    new = np.append(True, month[1:] != month[:-1]) | np.append(True, grid.group[1:] != grid.group[:-1])
    months = np.flatnonzero(new)
    # Months of a group, and the years they make, as segments of the segments before.
    year = month[months] // 12
    own = grid.group[months]
    years = np.flatnonzero(np.append(True, (year[1:] != year[:-1]) | (own[1:] != own[:-1])))
    of_months, of_years = np.searchsorted(own, np.arange(len(grid.starts))), np.searchsorted(own[years], np.arange(len(grid.starts)))
    count = np.cumsum(grid.done, axis=0)
    parts = [("gross", grid.done, grid.adverse)]
    conv = costs.converted[grid.group][:, None]
    for statistic, slippage in headline:
        match = costs.there & (costs.slippage == slippage) & (costs.code == costs.names.index(statistic).as_py())
        where = match.argmax(axis=1)[grid.group] if match.size else None
        there = priced & match.any(axis=1)[grid.group][:, None]
        value = grid.adverse
        if where is not None:
            value = costs.net(value, conv, *[x[grid.group, where][:, None] for x in (costs.spread, costs.slippage, costs.commission)])
        parts.append((f"{statistic}+{slippage:.2f}", there, value))
    parts.append((NAMELESS, other, None))
    rows = []
    for _, there, value in parts:
        n = grid.total(there)
        blank = value is None
        x = np.zeros(there.shape) if blank else np.where(there, value, 0.0)
        sums = np.add.reduceat(x, months, axis=0)
        traded = np.logical_or.reduceat(there, months, axis=0)
        over = lambda v, how=np.add: how.reduceat(v, of_months, axis=0)
        counted = over(traded.astype(np.int64))
        all_months = 12 * np.add.reduceat(np.logical_or.reduceat(traded, years, axis=0).astype(np.int64), of_years, axis=0)
        idle = all_months - counted
        total = over(sums)
        mean = _over(total, all_months)
        off = np.where(traded, sums - mean[own], 0.0) ** 2
        worst, best = over(np.where(traded, sums, np.inf), np.minimum), over(np.where(traded, sums, -np.inf), np.maximum)
        gains, losses = grid.total(np.maximum(x, 0.0)), -grid.total(np.minimum(x, 0.0))
        lost = there & (x < 0)
        place = count if there is grid.done else np.cumsum(there, axis=0)
        base = np.pad(place, ((1, 0), (0, 0)))[grid.starts]
        broken = np.maximum.accumulate(np.where(there & ~lost, place, 0), axis=0)
        run = np.where(lost, place - np.maximum(broken, base[grid.group]), 0)
        none = np.full(n.shape, NONE)
        rows.append(
            {
                "trades": n,
                "candidates": grid.distinct(there),
                "expectancy": none if blank else _over(grid.total(x), n),
                "total": none if blank else grid.total(x),
                "profit_factor": _factor(gains, losses),
                "win_rate": none if blank else _over(grid.total(x > 0), n),
                "positive_months": over((traded & (sums > 0)).astype(np.int64)),
                "negative_months": over((traded & (sums < 0)).astype(np.int64)),
                "no_trade_months": idle,
                "worst_month": np.where(idle > 0, np.minimum(worst, 0.0), worst),
                "best_month": np.where(idle > 0, np.maximum(best, 0.0), best),
                "monthly_mean": mean,
                "monthly_std": np.sqrt(_over(over(off) + idle * np.nan_to_num(mean) ** 2, all_months)),
                "max_losing_streak": np.maximum.reduceat(run, grid.starts, axis=0),
                "trades_per_month": _over(n, all_months),
            }
        )
    stacked = {k: np.stack([r[k] for r in rows], axis=2) for k in rows[0]}
    shape = stacked["trades"].shape
    names = _labels(pa.array([name for name, _, _ in parts], pa.string()), np.broadcast_to(np.arange(len(parts)), shape))
    columns = _exits(grid, 1) | {"scenario": names} | stacked
    return _nested(stacked["trades"] > 0, _spread_out(columns, shape), EXITS)


def _fields(names, kind):
    return {x: kind for x in names}


EXIT_FIELDS = {"tp": "double", "sl": "double", "stop": "bigint"}
WHOLE = ("candidates", "executed", "no_entry", "passed", "complete_trades", "incomplete_trades", "ambiguous_count", "tp_count", "sl_count", "time_stop_count")
MATRIX = EXIT_FIELDS | {
    x: "bigint" if x in WHOLE else "double"
    for x in (
        "candidates", "executed", "no_entry", "passed", "complete_trades", "incomplete_trades", "ambiguous_count", "ambiguous_fraction",
        "tp_count", "tp_fraction", "sl_count", "sl_fraction", "time_stop_count", "time_stop_fraction", "mean_pips", "mean_pips_favorable",
        "mean_bp", "win_fraction", "loss_fraction", "zero_fraction", "mean_mae_pips", "mean_mfe_pips", "mean_wait",
        *[f"{v}_{q}" for v in ("pips_adverse", "bp_adverse", "mae_pips", "mfe_pips", "holding", "wait", "r_at_entry", "pre_entry_adverse") for q in QUANTS],
    )
}
METRICS = ("gross_pips", "mae_pips", "mfe_pips", "holding")
DISTRIBUTIONS = EXIT_FIELDS | {"sample_count": "bigint"} | _fields([f"{m}_{q}" for m in METRICS for q in QUANTS], "double")
PRICED = EXIT_FIELDS | {"statistic": "string", "slippage": "double", "trades": "bigint"} | _fields(
    ("mean_net", "mean_net_favorable", "win_fraction", "loss_fraction", "zero_fraction", "profit_factor", "mean_gross", "mean_cost",
     "p10", "p25", "median", "p75", "p90", "headroom", "break_even_slippage", "extra_slippage"), "double",
)
SUMS = {"statistic": "string", "cost_status": "string", "rows": "bigint"} | _fields(
    ("slippage", "net_adverse", "net_favorable", "spread", "commission", "modeled"), "double"
)
POSITIVE = {"statistic": "string", "slippage": "double"} | _fields(("cells", "net_positive", "gross_positive", "both_positive"), "bigint")
ATLAS = EXIT_FIELDS | {"scenario": "string", "trades": "bigint", "candidates": "bigint"} | _fields(
    ("expectancy", "total", "profit_factor", "win_rate"), "double"
) | _fields(("positive_months", "negative_months", "no_trade_months"), "bigint") | _fields(
    ("worst_month", "best_month", "monthly_mean", "monthly_std"), "double"
) | {"max_losing_streak": "bigint", "trades_per_month": "double"}


def report(paths: DataFrame, keys, what: Callable[[Grid], pa.ListArray], fields: dict, stops, reclaim: int, extension: int,
           modes=ENTRY_MODES, excursions: bool = False) -> DataFrame:
    """The rows of ``what`` for every group of ``keys`` and entry mode; ``paths`` are events with their path,
    dealt by some of ``keys`` and sorted by ``keys`` and ``at``.  Doubles come rounded."""
    keys = list(keys)
    kinds = dict(paths.dtypes)

    def run(batches):
        with np.errstate(all="ignore"):
            for rows, starts in _whole_groups(batches, keys):
                grid = Grid(rows, starts, stops, reclaim, extension)
                own = rows.take(pa.array(starts)).select(keys)
                for mode in modes:
                    grid.trade(mode, excursions)
                    cells = what(grid)
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns, pa.array([mode] * len(own), pa.string()), cells], [*keys, "entry_mode", "cells"]
                    )

    cells = "array<struct<" + ",".join(f"`{k}`:{v}" for k, v in fields.items()) + ">>"
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "entry_mode string", f"cells {cells}"])
    return paths.mapInArrow(run, schema).select(*keys, "entry_mode", F.inline("cells"))
