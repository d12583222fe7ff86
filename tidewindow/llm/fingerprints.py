"""Document fingerprints: the bottom-k sketch of a text's word shingles, in SQL functions only.

A sketch is the ascending array of the k smallest distinct hashes of a text's shingles (five words;
a text of fewer words is one shingle, a text without words has the empty sketch).  The sketch of
a union is the k smallest of two sketches, so parts merge; of that union's k hashes the share that
both sketches hold estimates resemblance, and the k-th hash estimates how many distinct shingles
there are.  Sets of at most k shingles are held whole and give exact figures.

A row's arrays take about 60 bytes a word of its text; nothing is gathered across rows.

Defined cases: null text is empty; two empty sketches are alike (1), an empty and another are not
(0); rows of one doc_id share the document that follows that id, which is the row of the next
greater id with the smallest text hash; null ids come last, and after them the first id again; a
document alone follows itself; an empty table gives no rows; other columns are not read.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewindow.sources.staging import stage

SPACE = r"[\x20\x09-\x0D]+"
WORDS = 5
SIZE = 128


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, words: int = WORDS) -> Column:
    """The hashes of all shingles, repeats included: a hash over the hashes of their words."""

    def windows(h):
        whole = F.aggregate(h, F.lit(0).cast("long"), lambda seed, x: F.xxhash64(seed, x))
        several = F.transform(
            F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)])
        )
        return (
            F.when(F.size(h) == 0, F.array().cast("array<long>")).when(F.size(h) < words, F.array(whole)).otherwise(several)
        )

    hashes = F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    return let(hashes, windows)


def sketch(text: Column, size: int = SIZE, words: int = WORDS) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingles(text, words))), 1, size)


def merge(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of both sets together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the union's shingles that both sets hold."""

    def share(union):
        both = F.size(F.array_intersect(F.array_intersect(a, b), union))
        return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))

    return let(merge(a, b, size), share)


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles: exact below ``size``, else by the largest hash kept."""
    part = (F.element_at(a, -1) / F.lit(2.0**64)) + 0.5
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / part)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` holds too."""
    held = resemblance(a, b, size) * distinct_shingles(merge(a, b, size), size)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), held / distinct_shingles(a, size)))


def merged(sketches: DataFrame, keys: list[str], column: str = "sketch", size: int = SIZE) -> DataFrame:
    """One sketch per key from the sketches of its parts: distinct hashes, ranked; no group is gathered."""
    hashes = sketches.select(*keys, F.explode(column).alias("_hash")).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    least = hashes.withColumn("_place", place).where(F.col("_place") <= size)
    kept = least.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(column))
    return sketches.select(*keys).distinct().join(kept, keys, "left").withColumn(
        column, F.coalesce(column, F.array().cast("array<long>"))
    )


def text_form(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


KEY = ("none", "id")  # whether the row has no id, and the id: in this order null ids come last


def _following(ids: DataFrame) -> DataFrame:
    """``ids`` (none, id, cut) with the id before it in cyclic order and that one's cut.

    Ids are dealt in order into parts; a window runs inside each part, and the parts' ends meet
    in a table of one row per part.
    """
    parts = stage(ids.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()))
    row = F.struct(*KEY, "cut")
    rows = parts.withColumn("before", F.lag(row).over(Window.partitionBy("part").orderBy(*KEY)))
    ends = parts.groupBy("part").agg(F.max(row).alias("last"))
    along, whole = Window.orderBy("part"), Window.partitionBy()
    ends = ends.select(
        F.col("part").alias("_part"), F.coalesce(F.lag("last").over(along), F.max_by("last", "part").over(whole)).alias("end")
    )
    before = F.coalesce("before", "end")
    return rows.join(ends, F.col("part") == F.col("_part")).select(
        *KEY, before["none"].alias("before_none"), before["id"].alias("before_id"), before["cut"].alias("cut")
    )


def with_next(docs: DataFrame, size: int = SIZE, words: int = WORDS) -> DataFrame:
    """doc_id, text, sketch, and of the next document by id its opening ``head`` and ``next_sketch``.

    Only openings travel to the rows before them, as long as the longest text of that id asks for.
    Both joins deal the texts by id, so that Spark shuffles them once; sketches are made after it.
    """
    own = F.coalesce("doc_id", F.lit(0).cast("long")).alias("id")
    rows = docs.select(F.col("doc_id").isNull().alias("none"), own, F.coalesce("text", F.lit("")).alias("text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    wanted = stage(_following(rows.groupBy(*KEY).agg(F.max(quarter).alias("cut"))))
    opening = F.struct(F.xxhash64("text"), F.expr("left(text, cut)").alias("head"), sketch(F.col("text"), size, words).alias("next_sketch"))
    before = [F.col(f"before_{c}").alias(c) for c in KEY]
    heads = rows.join(wanted, list(KEY)).groupBy(*before).agg(F.min(opening).alias("next"))
    doc_id = F.when(~F.col("none"), F.col("id")).alias("doc_id")
    return rows.join(heads, list(KEY)).select(
        doc_id, "text", sketch(F.col("text"), size, words).alias("sketch"), "next.head", "next.next_sketch"
    )


def fingerprints(docs: DataFrame, size: int = SIZE, words: int = WORDS) -> DataFrame:
    """Every text and its edited text (its last quarter replaced by the next document's opening):
    both sketches, their resemblance, and that to the next document."""
    rows = with_next(docs, size, words)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.left(F.col("head"), quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), size, words))
    own, changed = F.col("sketch"), F.col("edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        text_form(own).alias("fingerprint"), text_form(changed).alias("edited_fingerprint"),
        resemblance(own, changed, size).alias("near_edited"), resemblance(own, F.col("next_sketch"), size).alias("near_next"),
        containment(changed, own, size).alias("edited_within"), distinct_shingles(own, size).alias("n_shingles"),
    )
