"""Explicit table schemas and the fixed vocabularies of the bar contract."""

from pyspark.sql import types as T

# Allowed price bases and volume meanings of a bar.
PRICE_BASES = ("bid", "ask", "mid", "trade", "other", "unknown")
VOLUME_SEMANTICS = ("traded", "tick", "quote_activity", "unknown", "none")

BAR = T.StructType(
    [
        T.StructField("instrument", T.StringType(), False),
        T.StructField("timeframe", T.StringType(), False),
        T.StructField("open_time", T.TimestampType(), False),
        T.StructField("close_time", T.TimestampType(), False),
        T.StructField("available_at", T.TimestampType(), False),
        T.StructField("open", T.DoubleType(), False),
        T.StructField("high", T.DoubleType(), False),
        T.StructField("low", T.DoubleType(), False),
        T.StructField("close", T.DoubleType(), False),
        T.StructField("price_basis", T.StringType(), False),
        T.StructField("volume", T.DoubleType(), True),
        T.StructField("volume_semantics", T.StringType(), False),
    ]
)

DAY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("instrument", T.StringType(), False),
        T.StructField("day", T.DateType(), False),
        T.StructField("content", T.BinaryType(), False),
    ]
)

SPREAD = T.StructType(
    [
        T.StructField("instrument", T.StringType(), False),
        T.StructField("session", T.StringType(), False),
        T.StructField("statistic", T.StringType(), False),
        T.StructField("pips", T.DoubleType(), False),
    ]
)

COMMISSION = T.StructType(
    [
        T.StructField("instrument", T.StringType(), False),
        T.StructField("session", T.StringType(), True),
        T.StructField("pips", T.DoubleType(), False),
    ]
)

TRADE_KEYS = (
    "instrument",
    "benchmark_family",
    "signal_timeframe",
    "session",
    "direction",
    "lookback",
    "signal_threshold",
    "filter_family",
    "entry_mode",
    "tp",
    "sl",
    "stop",
)
