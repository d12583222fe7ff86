"""Day-file ingest: compressed fixed-width records to validated one-minute bars.

One file is one record of work on an executor; decoding is a small vectorised helper and all
checks after it are columns.
"""

import lzma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewindow.operators.quality import split_valid
from tidewindow.sources.staging import stage

# Fixed value: record layout (seconds of day, open, close, low, high, volume; big-endian).
RECORD = np.dtype([("s", ">i4"), ("o", ">i4"), ("c", ">i4"), ("l", ">i4"), ("h", ">i4"), ("v", ">f4")])
DECODED = "path string, instrument string, day date, n int, s int, o int, h int, l int, c int, v double, error string"


def day_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Binary files under ``.../<instrument>/<yyyy-mm-dd>.<ext>`` with their SHA-256.

    Spark's file sources skip files of no bytes: :func:`declared_days` names those as lacking.
    """
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(
        "path",
        F.regexp_extract("path", r"/([^/]+)/(\d{4}-\d{2}-\d{2})\.[^/]*$", 1).alias("instrument"),
        F.to_date(F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})\.[^/]*$", 1)).alias("day"),
        "content",
        F.sha2("content", 256).alias("sha256"),
    )


def _decode(batches):
    columns = ["path", "instrument", "day", "n", "s", "o", "h", "l", "c", "v", "error"]
    for batch in batches:
        for path, instrument, day, content in zip(batch.path, batch.instrument, batch.day, batch.content):
            error, rows = None, np.zeros(0, RECORD)
            try:
                raw = lzma.decompress(bytes(content)) if len(content) else b""
                if not raw:
                    error = "empty_file"
                elif len(raw) % RECORD.itemsize:
                    error = "partial_record"
                else:
                    rows = np.frombuffer(raw, RECORD)
            except lzma.LZMAError:
                error = "not_decodable"
            if error:
                yield pd.DataFrame([[path, instrument, day, *[None] * 7, error]], columns=columns)
                continue
            out = pd.DataFrame({k: rows[k].astype("int64") for k in ("s", "o", "h", "l", "c")})
            out["v"] = rows["v"].astype("float64")
            out["n"] = np.arange(len(out))
            out = out.assign(path=path, instrument=instrument, day=day, error=None)
            yield out[columns]


def decode_days(files: DataFrame, scale: Column, step_s: int = 60) -> tuple[DataFrame, DataFrame]:
    """(bars, quarantine).  A file with any bad record, or without one, is rejected as a whole.

    Both results read the decoded rows, so these are written once and no file is decoded again.
    """
    raw = stage(files.select("path", "instrument", "day", "content").mapInPandas(_decode, DECODED))
    c = F.col
    # One day of one file at most: the partition is bounded by the records of a day.
    order = Window.partitionBy("path").orderBy("n")
    fault = (
        F.when(c("error").isNotNull(), c("error"))
        .when((c("s") < 0) | (c("s") >= 86400), "outside_day")
        .when(c("s") % step_s != 0, "off_grid")
        .when(c("s") <= F.lag("s").over(order), "not_increasing")
        .when(F.isnan("v") | (c("v") < 0), "bad_volume")
        .when((c("h") < F.greatest("o", "c", "l")) | (c("l") > F.least("o", "c", "h")), "bad_ohlc")
    )
    marked = raw.withColumn("fault", fault)
    bad = marked.where("fault is not null").groupBy("path", "instrument", "day").agg(
        F.min("fault").alias("fault"), F.count("*").alias("records")
    )
    good = marked.join(bad.select("path"), "path", "left_anti")
    opened = F.timestamp_seconds(F.unix_date("day").cast("long") * 86400 + c("s"))
    closed = F.timestamp_seconds(F.unix_date("day").cast("long") * 86400 + c("s") + step_s)
    bars = good.select(
        "instrument",
        F.lit("1m").alias("timeframe"),
        opened.alias("open_time"),
        closed.alias("close_time"),
        closed.alias("available_at"),
        *[(c(k) / scale).alias(name) for k, name in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))],
        F.lit("bid").alias("price_basis"),
        c("v").alias("volume"),
        F.lit("quote_activity").alias("volume_semantics"),
    )
    return bars, bad


def declared_days(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files whose hash matches the manifest, declared days that are missing or differ)."""
    keys = ["instrument", "day"]
    matched = files.join(manifest.select(*keys, F.col("sha256").alias("_want")), keys).where(F.col("sha256") == F.col("_want"))
    lacking = manifest.join(matched.select(*keys), keys, "left_anti")
    return matched.drop("_want"), lacking


def mixed_or_repeated_days(files: DataFrame) -> DataFrame:
    return files.groupBy("instrument", "day").agg(F.count("*").alias("files")).where("files > 1")


def assemble(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid bars and quarantined ones, by the row contract."""
    return split_valid(bars)
