"""A registry of corpora from manifests that differ in shape, one row per corpus.

Manifests stay what they are, JSON texts; each is read once as a VARIANT, and a field is looked up at
every path where some manifest keeps it.  All claims about one field of one corpus meet in a shuffle
that combines them map-side (least and greatest value, count), so any number of manifests of one
corpus is a few rows.  Nothing is overruled in silence: claims that differ are named as conflicts,
fields without a claim as missing, and a text that is no JSON is counted.

Defined cases: a NULL or unreadable text claims nothing but is counted; a value that its declared type
cannot hold is no claim, so its field is missing; a JSON null is no claim; rows without a key form one entry
under the key NULL; an empty table gives no entries.
"""

from pyspark.sql import DataFrame, functions as F

from tidewindow.operators.chunks import same_keys


def claims(documents: DataFrame, key: str, text: str, fields: dict) -> DataFrame:
    """(key, field, value): what each document says, values as text of the field's type.

    ``fields``: name -> (type, (path, ...)).  A document that keeps a field at two paths claims it twice.
    """
    read = documents.select(F.col(key), F.try_parse_json(text).alias("_v"))
    told = [
        F.struct(F.lit(name).alias("field"), F.try_variant_get("_v", path, kind).cast("string").alias("value"))
        for name, (kind, paths) in fields.items()
        for path in paths
    ]
    # One more item per document counts it; its value says whether it could be read.
    seen = F.struct(F.lit("").alias("field"), F.when(F.col("_v").isNotNull(), "read").alias("value"))
    return read.select(key, F.inline(F.array(seen, *told))).where("field = '' or value is not null")


def registry(documents: DataFrame, key: str, text: str, fields: dict) -> DataFrame:
    """Per key: documents, unreadable ones, every field's value (NULL where claims differ), missing and
    conflicting fields, comma-joined in the order of ``fields``."""
    told = claims(documents, key, text, fields).groupBy(key, "field").agg(
        F.count("*").alias("_rows"), F.count("value").alias("_told"), F.min("value").alias("_least"), F.max("value").alias("_most")
    )
    of = lambda name, x: F.max(F.when(F.col("field") == name, x))
    agree = F.col("_least") == F.col("_most")
    entries = told.groupBy(key).agg(
        of("", F.col("_rows")).alias("documents"), of("", F.col("_rows") - F.col("_told")).alias("unreadable"),
        *[of(name, F.when(agree, F.col("_least"))).cast(kind).alias(name) for name, (kind, _) in fields.items()],
        F.collect_set(F.when(F.col("field") != "", F.col("field"))).alias("_claimed"),
        F.collect_set(F.when((F.col("field") != "") & ~agree, F.col("field"))).alias("_split"),
    )
    named = lambda test: F.array_join(F.array_compact(F.array(*[F.when(test(n), F.lit(n)) for n in fields])), ",")
    return entries.select(
        key, "documents", "unreadable", *fields,
        named(lambda n: ~F.array_contains("_claimed", n)).alias("missing"),
        named(lambda n: F.array_contains("_split", n)).alias("conflicts"),
    )


def validated(entries: DataFrame, expected: DataFrame, key: str, required=()) -> DataFrame:
    """Entries against the declared universe: adds ``mismatched`` (columns of ``expected`` that differ)
    and ``status``.

    Both sides are one row a key.  A declared key without an entry is ``absent``, an entry nobody declared
    ``undeclared``; else the first of ``unreadable``, ``conflict``, ``incomplete`` (a ``required`` field
    is missing), ``mismatch`` that holds, or ``verified``.
    """
    compared = [c for c in expected.columns if c != key]
    have = entries.withColumn("_have", F.lit(True)).alias("l")
    want = expected.withColumn("_want", F.lit(True)).alias("r")
    joined = have.join(want, same_keys([key]), "full_outer")
    both = F.col("l._have").isNotNull() & F.col("r._want").isNotNull()
    off = F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in compared])
    mismatched = F.when(both, F.array_join(F.array_compact(off.cast("array<string>")), ","))
    lacking = F.arrays_overlap(F.split("l.missing", ","), F.lit(list(required))) if required else F.lit(False)
    status = (
        F.when(F.col("l._have").isNull(), "absent")
        .when(F.col("r._want").isNull(), "undeclared")
        .when(F.col("l.unreadable") > 0, "unreadable")
        .when(F.col("l.conflicts") != "", "conflict")
        .when(lacking, "incomplete")
        .when(mismatched != "", "mismatch")
        .otherwise("verified")
    )
    return joined.select(
        F.coalesce(f"l.{key}", f"r.{key}").alias(key), *[F.col(f"l.{c}").alias(c) for c in entries.columns if c != key],
        mismatched.alias("mismatched"), status.alias("status"),
    )
