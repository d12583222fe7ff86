"""SimHash near duplicates through deletion-variant signatures.

Fingerprints that differ in four bits or fewer, cut into three segments, have a segment that differs
in one bit at most.  Every distinct fingerprint is indexed under each of its segments with each one
bit blanked (64 variants); fingerprints under one variant are compared, and those within four bits
are linked by the edges of a forest, never by all pairs.  A variant with more than ``BLOCK``
fingerprints is dealt into blocks, and every two blocks meet in a task of their own, so that no
group has to fit in a task and no candidate is dropped.  Components join links in the end.

Defined cases: null text is empty; texts without a word have fingerprint zero and link like any
other; equal fingerprints are one class; null doc_ids keep their row and are never a component's id
unless all of its ids are null; an empty table gives no rows.
"""

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewindow.llm.columns import columns_kept
from tidewindow.llm.components import components
from tidewindow.sources.staging import stage

WORDS = 4
SEED = 42
BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
BLOCK = 2048
STEP = 1 << 16


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # for bytes: A-Z only, and the six white-space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [0] + [e + 1 for e in ends[:-1]]
    shingles = [joined[a:b] for a, b in zip(starts, ends[WORDS - 1 :] or ends[-1:])]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", len(shingles))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        found = [fingerprint(x.as_py()) for x in batch.column("text")]
        signed = pa.array(np.array(found, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), signed], ["doc_id", "mark", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text, which tells rows of one id apart) and fp."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, mark long, fp long")


def _segment(first: int, size: int):
    return F.shiftrightunsigned(F.col("fp"), first).bitwiseAND(F.lit((1 << size) - 1))


def variants(distinct: DataFrame) -> DataFrame:
    """(key, fp): the wildcard bit's number above the segment's value without that bit."""
    keys = [
        _segment(first, size).bitwiseAND(F.lit(~(1 << i))).bitwiseOR(F.lit((first + i) << 22))
        for first, size in SEGMENTS
        for i in range(size)
    ]
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _hot_keys(distinct: DataFrame, block: int) -> DataFrame:
    """(hot, blocks) of variants that may hold more than ``block``: counted on whole segment values,
    three rows per fingerprint, since such a variant has a value that holds half of them."""
    values = distinct.select(
        F.explode(F.array(*[F.struct(F.lit(s).alias("s"), _segment(*x).alias("v")) for s, x in enumerate(SEGMENTS)])).alias("x")
    )
    crowded = values.groupBy("x.s", "x.v").agg(F.count("*").alias("n")).where(F.col("n") > block // 2)
    blank = [
        F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i, f=first: F.struct(
            F.col("v").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
            .bitwiseOR(F.call_function("shiftleft", (i + F.lit(f)).cast("long"), F.lit(22))).alias("hot")))
        for first, size in SEGMENTS
    ]
    every = F.when(F.col("s") == 0, blank[0]).when(F.col("s") == 1, blank[1]).otherwise(blank[2])
    keys = crowded.select(F.explode(every).alias("y"), "n").select("y.hot", "n")
    return keys.groupBy("hot").agg((F.ceil(F.sum("n") / (block // 2)) + 1).cast("int").alias("blocks"))


def candidates(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, lo, hi, fp): fingerprints of one group may be near; no group exceeds about two blocks."""
    hot = stage(_hot_keys(distinct, block))
    rows = variants(distinct)
    if hot.isEmpty():
        zero = F.lit(0).alias
        return rows.select("key", zero("lo"), zero("hi"), "fp")
    rows = rows.join(hot, F.col("key") == F.col("hot"), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    rows = rows.select("key", "fp", F.coalesce(own, F.lit(0)).alias("own"), other.alias("other"))
    return rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")


def forest(group, fp, bits: int = BITS):
    """Edges (i, root) that join all near rows of each group; ``group`` numbers are ascending."""
    parent = np.arange(len(fp))
    ends = np.searchsorted(group, group, "right")  # where each row's group ends
    ahead = ends - np.arange(len(fp)) - 1
    rows = np.flatnonzero(ahead > 0)
    step = 1
    while len(rows):
        near = np.bitwise_count(fp[rows] ^ fp[rows + step]) <= bits
        a, b = rows[near], rows[near] + step
        while len(a):
            x, y = parent[a], parent[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if len(a):
                np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
                while not np.array_equal(up := parent[parent], parent):
                    parent = up
        step += 1
        rows = rows[ahead[rows] >= step]
    moved = np.flatnonzero(parent != np.arange(len(fp)))
    return moved, parent[moved]


def _links(batches):
    """Rows come sorted by group; a group may span batches, so its tail waits for the next one."""

    def linked(keys, fp):
        change = np.any(keys[1:] != keys[:-1], axis=1)
        group = np.concatenate([[0], np.cumsum(change)])
        a, b = forest(group, fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

    held = None
    for batch in batches:
        now = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "lo", "hi", "fp")], 1)
        now = now if held is None else np.concatenate([held, now])
        same = np.all(now[:, :3] == now[-1, :3], axis=1)
        cut = int(np.flatnonzero(~same).max(initial=-1)) + 1
        held = now[cut:]
        if cut:
            yield linked(now[:cut, :3], np.ascontiguousarray(now[:cut, 3]))
    if held is not None and len(held):
        yield linked(held[:, :3], np.ascontiguousarray(held[:, 3]))


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between near fingerprints: a forest per group, which keeps what reaches what."""
    rows = candidates(distinct, block).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return rows.mapInArrow(_links, "a long, b long")


def near_components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, mark, fp, component_id for every document."""
    rows = stage(fingerprints(docs))
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), block))
    member = roots.join(classes, F.col("node") == F.col("fp")).select("node", "root", "least")
    member = stage(member)
    smallest = member.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    linked = stage(member.join(smallest, F.col("root") == F.col("of")).select("node", "component_id"))
    named = classes.join(linked, F.col("fp") == F.col("node"), "left")
    named = stage(named.select(F.col("fp").alias("_fp"), F.coalesce("component_id", "least").alias("component_id")))
    return rows.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "mark", "fp", "component_id")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _without_ids(docs: DataFrame, rows: DataFrame, block: int) -> DataFrame | None:
    """The rows that go from components without any id, as (doc_id, mark); there the least text hash stays."""
    lost = rows.where("component_id IS NULL").select(F.col("mark").alias("_of")).distinct()
    if lost.isEmpty():
        return None
    mark = F.xxhash64("text")
    alone = docs.where(F.col("doc_id").isNull()).join(lost, mark == F.col("_of"), "left_semi").select(mark.alias("doc_id"), "text")
    return near_components(alone, block).where("mark != component_id").select(F.lit(None).cast("long").alias("doc_id"), "mark")


@columns_kept
def one_per_component(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One document of each component, that of its smallest id; same columns as ``docs``.

    Of different texts under that id, or where no text has an id, the one of the least text hash
    stays; rows repeated whole stay once.  What goes is looked up by id and text hash, so texts are
    not shuffled while that list is small.
    """
    rows = stage(near_components(docs, block).select("doc_id", "mark", "component_id"))
    best = rows.where("doc_id = component_id").groupBy(F.col("component_id").alias("_of")).agg(F.min("mark").alias("_best"))
    named = rows.join(best, F.col("component_id") == F.col("_of"))
    gone = named.where("NOT doc_id <=> component_id OR mark != _best").select("doc_id", "mark")
    unnamed = _without_ids(docs, rows, block)
    gone = gone if unnamed is None else gone.unionByName(unnamed)
    drop = stage(gone.select(F.col("doc_id").alias("_drop"), F.col("mark").alias("_mark")).distinct())
    kept = docs.join(drop, F.expr("doc_id <=> _drop AND xxhash64(text) = _mark"), "left_anti")
    twice = rows.groupBy("doc_id", "mark").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    twice = stage(twice.join(drop, F.expr("_id <=> _drop") & (twice["_mark"] == drop["_mark"]), "left_anti"))
    if twice.isEmpty():
        return kept
    same = F.expr("doc_id <=> _id AND xxhash64(text) = _mark")
    again = kept.join(twice, same, "left_semi").withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"]).drop("_text")
    return kept.join(twice, same, "left_anti").unionByName(again)
