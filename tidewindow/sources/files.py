"""Text and columnar files with explicit schemas, and writes that never replace content."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidewindow.operators.quality import fingerprint


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON document per file (registries, manifests, cost profiles)."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def cost_dimensions(document: DataFrame) -> DataFrame:
    """Flatten ``spreads: map<instrument, map<session, map<statistic, pips>>>`` to rows."""
    by_instrument = document.select(F.explode("spreads").alias("instrument", "_s"))
    by_session = by_instrument.select("instrument", F.explode("_s").alias("session", "_p"))
    return by_session.select("instrument", "session", F.explode("_p").alias("statistic", "pips"))


def write_jsonl(df: DataFrame, path: str, order=(), partition_by=()) -> None:
    """JSON lines; with ``order`` the files hold consecutive key ranges, sorted inside."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_csv(parts, path: str) -> None:
    """Rows of all parts under the union of their columns; NULL becomes an empty cell."""
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    out.write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_once(df: DataFrame, path: str) -> str:
    """``written``, or ``identical`` when the same rows are already there; else fails."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        df.write.mode("errorifexists").parquet(path)
        return "written"
    old, new = fingerprint(spark.read.parquet(path)).first(), fingerprint(df).first()
    if old != new:
        raise ValueError(f"{path} already holds different rows")
    return "identical"


def file_commitments(spark: SparkSession, pattern: str) -> DataFrame:
    """Path, size and SHA-256 of every file with a byte in it; the scan passes empty files over."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
