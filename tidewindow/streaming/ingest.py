"""Resumable ingest of day files: the checkpoint remembers what is already loaded."""

from pyspark.sql import Column, SparkSession, functions as F

from tidewindow.sources.dayfiles import decode_days


def ingest_new_days(spark: SparkSession, source: str, target: str, checkpoint: str, scale: Column, step_s: int = 60):
    """Load files that appeared since the last run, write bars by (instrument, day), stop.

    A batch replaces the partitions of the days it carries, so a batch that runs again after a
    lost driver or executor leaves the same rows.
    """
    stream = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .load(source)
    )

    def load(batch, _):
        files = batch.select(
            "path",
            F.regexp_extract("path", r"/([^/]+)/(\d{4}-\d{2}-\d{2})\.[^/]*$", 1).alias("instrument"),
            F.to_date(F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})\.[^/]*$", 1)).alias("day"),
            "content",
        )
        bars, bad = decode_days(files, scale, step_s)
        (
            bars.withColumn("day", F.to_date("open_time"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("instrument", "day")
            .parquet(f"{target}/bars")
        )
        (
            bad.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("instrument", "day")
            .parquet(f"{target}/quarantine")
        )

    query = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
