"""Parts of a table whose file names declare what they hold, checked in the scan itself."""

from pyspark.sql import DataFrame, functions as F


def declared(scan: DataFrame, pattern: str, column: str = "declared") -> DataFrame:
    """The rows of a file scan with what their own file's path declares (group 1 of ``pattern``).

    The path is the scan's hidden ``_metadata`` column: nothing is listed, joined or read twice.  It
    comes percent-encoded.  A path that does not match declares NULL.
    """
    path = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    found = F.regexp_extract(path, pattern, 1)
    return scan.withColumn(column, F.when(found != "", found))


def part_report(rows: DataFrame, value: str, column: str = "declared") -> DataFrame:
    """Per declared part: rows, rows that carry another value (or none), and the verdict."""
    other = ~F.col(value).eqNullSafe(F.col(column))
    out = rows.groupBy(column).agg(
        F.count("*").alias("rows"), F.count_if(other).alias("mixed_rows"), F.max(F.when(other, F.col(value))).alias("example"),
    )
    verdict = F.when(F.col(column).isNull(), "undeclared").when(F.col("mixed_rows") > 0, "mixed").otherwise("clean")
    return out.withColumn("verdict", verdict)


def clean_parts(rows: DataFrame, value: str, column: str = "declared") -> DataFrame:
    """Rows of the parts that hold what they declare; a part with one other row is left out whole."""
    good = part_report(rows, value, column).where("verdict = 'clean'").select(column)
    return rows.join(good, column, "left_semi")
