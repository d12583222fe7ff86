"""Mixing sources to target weights: floor(rate) copies of a document plus one hash-seeded draw.

Defined cases: null text has size 0 and is never worth a word, but is repeated like any other row;
null sources are one source, ordered last; a source without words has target 0 and no copies;
identical rows draw alike, and a null doc_id draws by the hash of its text; an empty table gives no rows.
Other columns of the documents pass through untouched, whatever their names.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewindow.llm.columns import columns_kept
from tidewindow.sources.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 17


def words_in(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(_source, source_size, target, rate) from rows (_source, _size): one row per source.

    Sources share the total by weight; a target above ``most`` times its source is cut there and
    the excess reshared.  In order of size/weight the cut sources come first, so the level of
    the others is the largest level that any prefix of cut sources leaves.
    The windows run over one row per source, never over documents.
    """
    by_source = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    shares = F.array(*[F.lit(w) for w in weights])
    weighted = by_source.withColumn("_w", F.get(shares, place % len(weights)).cast("long")).withColumn(
        "_cap", F.lit(most) * F.col("source_size")
    )
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole) - before) / rest
    return (
        weighted.withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(whole))
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .select("_source", "source_size", "target", "rate")
    )


def copies_of(rate, doc_id, mark, seed: int = SEED) -> Column:
    """floor(rate) plus one with the probability of its fraction; the same row always draws the same."""
    bits = F.xxhash64(F.lit(seed), doc_id, F.when(doc_id.isNull(), mark))
    draw = bits.bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")


def with_rates(rows: DataFrame, source: str, targets: DataFrame) -> DataFrame:
    """Attach the source's figures.  ``targets`` is a written table of known size: Spark broadcasts
    it below the session's threshold and otherwise joins by shuffle, splitting hot sources."""
    return rows.join(targets, rows[source].eqNullSafe(targets["_source"]), "left").drop("_source")


@columns_kept
def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The documents, each as often as the mix takes it; same columns as ``docs``."""
    sizes = docs.select(F.col("source").alias("_source"), words_in(F.col("text")).alias("_size"))
    targets = stage(source_targets(sizes, weights, most).select("_source", F.col("rate").alias("_rate")))
    copies = copies_of(F.col("_rate"), F.col("doc_id"), F.xxhash64("text"), seed)
    return (
        with_rates(docs, "source", targets)
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies)))
        .select(*docs.columns)
    )


def mix_sizes(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken: the mix without its texts, from one scan of them."""
    sized = stage(
        docs.select(
            "doc_id",
            F.col("source").alias("_source"),
            words_in(F.col("text")).alias("_size"),
            F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("_text"),
        )
    )
    targets = stage(source_targets(sized, weights, most))
    rows = with_rates(sized.withColumnRenamed("_source", "_of"), "_of", targets)
    copies = copies_of(F.col("rate"), F.col("doc_id"), F.col("_text"), seed)
    return rows.select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * copies).alias("taken")
    )
