"""Exact dedup through a cuckoo-filter index over SHA-256 digests, bucketed by digest.

Copies are combined in every map task first, so a group of any size sends a bucket one row per map
batch.  In a bucket a filter miss inserts the digest without a look-up; a hit is verified against
the bucket's stored content keys; an overflow doubles the filter and refills it from those keys.

Defined cases: null text counts as empty text; texts are equal when identical; the row with the
largest doc_id stays (null ids are smallest); of rows repeated under that id exactly one stays;
an empty table gives no rows.  Other columns pass through :func:`drop_copies` untouched.
"""

from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewindow.llm.columns import columns_kept
from tidewindow.sources.staging import stage

SLOTS = 4
KICKS = 200
NO_ID = -(1 << 63)  # stands for a null id inside the index
INDEX = "digest binary, keep_id long, keep_row long, same long, group_size long"


class CuckooIndex:
    """Approximate membership with deletion, over live digests that it also stores exactly."""

    def __init__(self, buckets: int = 256):
        self.content: dict[bytes, list] = {}
        self._clear(buckets)

    def _clear(self, buckets: int):
        self.mask, self.table = buckets - 1, array("H", bytes(2 * SLOTS * buckets))

    def _places(self, digest: bytes):
        key = int.from_bytes(digest[:8], "little")
        tag = (key >> 48) or 1
        first = key & self.mask
        return tag, first, first ^ (tag * 0x5BD1E995 & self.mask)

    def _slot(self, place: int, tag: int) -> int:
        base = place * SLOTS
        for i in range(base, base + SLOTS):
            if self.table[i] == tag:
                return i
        return -1

    def may_hold(self, digest: bytes) -> bool:
        tag, a, b = self._places(digest)
        return self._slot(a, tag) >= 0 or self._slot(b, tag) >= 0

    def _put(self, digest: bytes) -> bool:
        tag, place, other = self._places(digest)
        for p in (place, other):
            if (i := self._slot(p, 0)) >= 0:
                self.table[i] = tag
                return True
        for kick in range(KICKS):
            i = place * SLOTS + kick % SLOTS
            tag, self.table[i] = self.table[i], tag
            place ^= tag * 0x5BD1E995 & self.mask
            if (i := self._slot(place, 0)) >= 0:
                self.table[i] = tag
                return True
        return False

    def insert(self, digest: bytes, value: list):
        """Add a digest that is not live."""
        self.content[digest] = value
        if not self._put(digest):
            self._refill(2 * (self.mask + 1))

    def _refill(self, buckets: int):
        self._clear(buckets)
        for digest in self.content:
            if not self._put(digest):
                return self._refill(2 * buckets)

    def find(self, digest: bytes):
        """The value of a live digest: a filter hit that the stored content confirms."""
        return self.content.get(digest) if self.may_hold(digest) else None

    def delete(self, digest: bytes) -> bool:
        if self.find(digest) is None:
            return False
        tag, a, b = self._places(digest)
        i = self._slot(a, tag)
        self.table[i if i >= 0 else self._slot(b, tag)] = 0
        del self.content[digest]
        return True


def merge(old: list, new: list):
    """[keep_id, keep_row, same, group_size]: the larger id wins; rows of the kept id add up."""
    if new[0] > old[0]:
        old[:3] = new[:3]
    elif new[0] == old[0]:
        old[1:3] = max(old[1], new[1]), old[2] + new[2]
    old[3] += new[3]


def _rows(batch):
    names = ("digest", "keep_id", "keep_row", "same", "group_size")
    for digest, *value in zip(*[batch.column(n).to_pylist() for n in names]):
        yield digest, value


def _batches(content: dict, size: int = 20_000):
    items = list(content.items())
    for i in range(0, len(items), size):
        part = items[i : i + size]
        columns = [pa.array([k for k, _ in part], pa.binary())]
        columns += [pa.array([v[j] for _, v in part], pa.int64()) for j in range(4)]
        yield pa.RecordBatch.from_arrays(columns, ["digest", "keep_id", "keep_row", "same", "group_size"])


def _combine(batches):
    """Copies within a batch become one row before anything is shuffled."""
    for batch in batches:
        found: dict = {}
        for digest, value in _rows(batch):
            if (old := found.get(digest)) is None:
                found[digest] = value
            else:
                merge(old, value)
        yield from _batches(found)


def _insert_all(index: CuckooIndex, batch):
    for digest, value in _rows(batch):
        if (old := index.find(digest)) is None:
            index.insert(digest, value)
        else:
            merge(old, value)


def _build(batches):
    index = CuckooIndex()
    for batch in batches:
        _insert_all(index, batch)
    yield from _batches(index.content)


def _change(batches):
    """Rows come ordered by _step: 0 the index as it was, 1 insertions, 2 deletions."""
    index = CuckooIndex()
    for batch in batches:
        steps = batch.column("_step").to_numpy()
        for step in sorted(set(steps.tolist())):
            part = batch.filter(pa.array(steps == step))
            if step < 2:
                _insert_all(index, part)
            else:
                for digest in part.column("digest").to_pylist():
                    index.delete(digest)
    yield from _batches(index.content)


def sha256_of(text) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _entries(docs: DataFrame, row: Column) -> DataFrame:
    return docs.select(
        F.unhex(sha256_of(F.col("text"))).alias("digest"),
        F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("keep_id"),
        row.cast("long").alias("keep_row"),
        F.lit(1).cast("long").alias("same"),
        F.lit(1).cast("long").alias("group_size"),
    )


def build_index(entries: DataFrame) -> DataFrame:
    """One row per distinct text.  A partition of the shuffle is one bucket of the index."""
    return entries.mapInArrow(_combine, INDEX).repartition("digest").mapInArrow(_build, INDEX)


def change_index(index: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The index after inserting documents and then deleting texts (every copy of each)."""
    rows = index.withColumn("_step", F.lit(0))
    for step, docs in ((1, inserted), (2, deleted)):
        if docs is not None:
            added = _entries(docs, F.lit(0)).mapInArrow(_combine, INDEX)
            rows = rows.unionByName(added.withColumn("_step", F.lit(step)))
    return rows.repartition("digest").sortWithinPartitions("_step").mapInArrow(_change, INDEX)


def dedup_decisions(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document, dropped ones too."""
    rows = stage(_entries(docs, F.monotonically_increasing_id()))
    index = build_index(rows).select("digest", F.col("keep_id").alias("_keep"), F.col("keep_row").alias("_row"), F.col("group_size").alias("_size"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.join(index, "digest").select(
        real("keep_id").alias("doc_id"),
        real("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("keep_row") == F.col("_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@columns_kept
def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns.

    Documents meet the list of repeated texts in a join by digest: one shuffle of the texts, the same
    at every size.
    """
    index = stage(build_index(_entries(docs, F.lit(0))).where("group_size > 1").drop("keep_row", "group_size"))
    index = index.select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep"), F.col("same").alias("_same")).hint("merge")
    digest = F.unhex(sha256_of(F.col("text")))
    rows = docs.withColumn("_of", digest).join(index, F.col("_of") == F.col("_digest"), "left")
    stays = F.col("_keep").isNull() | (F.coalesce(F.col("doc_id"), F.lit(NO_ID)) == F.col("_keep"))
    rows = rows.where(stays)
    if index.where("_same > 1").isEmpty():
        return rows.select(*docs.columns)
    again = F.col("_same") > 1
    single = rows.where(again.isNull() | ~again).select(*docs.columns)
    return single.unionByName(rows.where(again).dropDuplicates(["_of", "doc_id"]).select(*docs.columns))
