"""Column functions shared by the operators: clocks, prices, moves and costs."""

from functools import reduce

from pyspark.sql import Column, functions as F

# Seconds per timeframe unit, and the vendor aliases of timeframes.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
TIMEFRAME_ALIASES = {"M1": "1m", "M5": "5m", "M15": "15m", "H1": "1h"}


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts)


def timeframe_seconds(label: Column) -> Column:
    """``15m`` -> 900; anything that is not a fixed lower-case duration -> NULL."""
    amount = F.regexp_extract(label, r"^([1-9][0-9]*)[smhd]$", 1)
    unit = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
    return F.when(
        amount != "", amount.cast("long") * unit[F.right(label, F.lit(1))]
    ).cast("long")


def normalize_timeframe(label: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for kv in TIMEFRAME_ALIASES.items() for x in kv])
    return F.coalesce(aliases[F.upper(F.trim(label))], F.lower(F.trim(label)))


def decode_price(ticks: Column, scale: Column) -> Column:
    return ticks.cast("double") / scale.cast("double")


def pip_size(precision: Column) -> Column:
    """One pip is ten of the last quoted decimal."""
    return F.pow(F.lit(10.0), (F.lit(1) - precision).cast("double"))


def typical_price(high: Column, low: Column, close: Column) -> Column:
    return (high + low + close) / F.lit(3.0)


def is_flat_inactive(o: Column, h: Column, l: Column, c: Column, v: Column) -> Column:
    return F.coalesce((v == 0) & (o == h) & (h == l) & (l == c), F.lit(False))


def arithmetic_return(later: Column, earlier: Column) -> Column:
    return F.try_divide(later, earlier) - 1.0


def reversion_fraction(direction: Column, price: Column, p0: Column, d0: Column) -> Column:
    """Share of the frozen deviation that a price has given back (1 = full reversion)."""
    return direction * (price - p0) / F.abs(d0)


def true_range(high: Column, low: Column, previous_close: Column) -> Column:
    return F.greatest(high - low, F.abs(high - previous_close), F.abs(low - previous_close))


def upper_wick(o: Column, h: Column, c: Column) -> Column:
    return h - F.greatest(o, c)


def lower_wick(o: Column, l: Column, c: Column) -> Column:
    return F.least(o, c) - l


def breach_depth(side: Column, price: Column, high: Column, low: Column, scale: Column) -> Column:
    beyond = F.when(side == "upper", high - price).otherwise(price - low)
    return F.greatest(F.lit(0.0), beyond) / scale


def reclaim_depth(side: Column, price: Column, close: Column, scale: Column) -> Column:
    inside = F.when(side == "upper", price - close).otherwise(close - price)
    return F.greatest(F.lit(0.0), inside) / scale


def converted_pips(value: Column, converted: Column) -> Column:
    """Currency conversion haircut: gains shrink, losses grow, zero stays (fixed 0.7 %)."""
    return F.when(converted & (value > 0), value * 0.993).when(
        converted & (value < 0), value * 1.007
    ).otherwise(value)


def net_pips(gross: Column, spread: Column, slippage: Column, commission: Column, converted: Column) -> Column:
    return converted_pips(gross - spread - slippage, converted) - commission


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def quarter_key(ts: Column) -> Column:
    return F.concat(F.year(ts), F.lit("-Q"), F.quarter(ts))


def policy_key(*fields: str) -> Column:
    """``a=1|b=x`` identity over the named fields, in the order given."""
    return F.concat_ws(
        "|",
        *[
            F.concat(F.lit(f + "="), F.coalesce(F.col(f).cast("string"), F.lit("None")))
            for f in fields
        ],
    )


def identity_hash(prefix: str, *parts: Column) -> Column:
    """Short stable id: the first 24 hex digits of SHA-256 over the joined parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 24))


def compatible_horizon(horizon_s: Column, timeframe: Column) -> Column:
    """Whether a horizon can land on a bar of this timeframe; an unknown timeframe has none."""
    tf = timeframe_seconds(timeframe)
    return F.coalesce((horizon_s >= tf) & (horizon_s % tf == 0), F.lit(False))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
