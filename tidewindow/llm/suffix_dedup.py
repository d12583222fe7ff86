"""Removal of byte strings that an earlier document holds, by a hash-compared suffix sort.

A string of ``LENGTH`` bytes has a minimiser, the least of its ``GRAM``-byte hashes; consecutive
strings of one minimiser form a run, a stretch of at most ``LENGTH - GRAM + 1`` starts.  Equal
strings have equal minimisers, so:

1. minimisers that two documents hold are found by a count with a map-side combine;
2. only runs of such minimisers go on.  Of equal runs all documents but the first lose every string;
3. the distinct runs of a minimiser are compared as suffixes: sorted from the minimiser on by a
   mergesort that finds common extensions by binary search over prefix polynomial hashes, which
   gives every stretch of suffixes that agree on n bytes; those that agree to the left as well are
   one string, and all but its smallest document lose it.  Bytes verify every equality that counts;
4. a minimiser with more than ``CROWD`` distinct runs is not sorted in one task: its strings are
   grouped as they are, with a map-side combine.

No text is shuffled whole but to meet its own marks, and equal copies are combined before every
shuffle, so a group of copies of any size stays small.

Defined cases: null text is empty; texts under ``LENGTH`` bytes lose nothing; rows of one doc_id do
not shorten each other; a null doc_id neither loses nor causes a loss; an empty table gives no rows.
A character may be cut: kept bytes are bytes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewindow.llm.tokens import slices
from tidewindow.sources.staging import stage

LENGTH = 50
GRAM = 24
REACH = LENGTH - GRAM + 1  # starts that can share a minimiser: at most 27, which fits the masks below
CROWD = 2000
CHUNK = 1 << 18  # bytes hashed at a time: some fifteen arrays of eight bytes a byte
AT_ONCE = 16_000  # runs compared at a time
TABLE = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64)  # a number for every byte value
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
# at: start << 26 | minimiser's offset << 21 | starts << 16 | mark of the text
RUNS = "gram long, run long, doc long, at long"
CONTEXTS = "gram long, run long, doc long, at long, crowd boolean, bytes binary"
MASKS = "gram long, run long, mask long"


class PrefixHash:
    """Hash of any stretch of a byte array in constant time (polynomial, modulo 2^64)."""

    def __init__(self, data, base: int = BASES[0]):
        n = len(data) + 1
        self.back = _powers(pow(base, -1, 2**64), n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(TABLE[data] * _powers(base, n)[:-1], out=self.sums[1:])

    def __call__(self, start, end):
        return (self.sums[end] - self.sums[start]) * self.back[start]


_KEPT: dict = {}


def _powers(base: int, n: int):
    kept = _KEPT.get(base)
    if kept is None or len(kept) < n:
        out = np.ones(max(n, CHUNK + 4096), np.uint64)
        have = 1
        while have < len(out):
            more = min(have, len(out) - have)
            out[have : have + more] = out[:more] * np.uint64(pow(base, have, 2**64))
            have += more
        _KEPT[base] = kept = out
    return kept[:n]


def _mixed(h):
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _least(keys, width: int):
    """Minimum of every ``width`` consecutive keys."""
    have = 1
    while 2 * have <= width:
        keys, have = np.minimum(keys[:-have], keys[have:]), 2 * have
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :]) if width > have else keys


def runs_of(data, bounds):
    """(gram, run, text number, start in text, offset of the minimiser, starts) of texts laid end to end."""
    out = []
    for lo in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        part = data[lo : lo + CHUNK + LENGTH - 1]
        value = PrefixHash(part)
        at = np.arange(len(part) - GRAM + 1)
        gram = _mixed(value(at, at + GRAM))
        # The smallest hash, and among equals the leftmost place: both depend on the string alone.
        place = (_least((gram & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64), REACH) & np.uint64((1 << 24) - 1)).astype(np.int64)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(np.clip(bounds, lo, lo + len(place))))
        whole = np.arange(lo, lo + len(place)) + LENGTH <= bounds[text + 1]
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        start = np.flatnonzero(new)
        # A run ends before the next run and at its text's last start.
        end = np.minimum(np.append(start[1:], len(place)), np.maximum(bounds[text[start] + 1] - LENGTH + 1 - lo, 0))
        n = end - start
        run = _mixed(value(start, start + n + LENGTH - 1) + n.astype(np.uint64))
        out.append((gram[place[start]], run, text[start], start + lo - bounds[text[start]], place[start] - start, n))
    if not out:
        return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 4
    return [np.concatenate(c) for c in zip(*out)]


def _laid(column):
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _grams(batches):
    """(gram, n): n is 2 where one slice already shows two documents."""
    for batch in batches:
        for part in slices(batch):
            gram, _, text, *_ = runs_of(*_laid(part.column("text")))
            doc = part.column("doc_id").to_numpy()[text]
            order = np.lexsort((doc, gram))
            gram, doc = gram[order], doc[order]
            first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(gram)) - 1 if len(gram) else first
            n = 1 + (doc[first] != doc[last]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gram[first].view(np.int64)), pa.array(n)], ["gram", "n"])


def _runs(batches):
    for batch in batches:
        for part in slices(batch):
            gram, run, text, start, offset, n = runs_of(*_laid(part.column("text")))
            doc, mark = part.column("doc_id").to_numpy()[text], part.column("mark").to_numpy()[text]
            at = start << 26 | offset << 21 | n << 16 | mark
            columns = [gram.view(np.int64), run.view(np.int64), doc, at]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "run", "doc", "at"])


def _contexts(batches):
    """The bytes of each listed run of a document."""
    for batch in batches:
        for part in slices(batch):
            data, bounds = _laid(part.column("text"))
            found = part.column("found")
            gram, run, at, crowd = found.flatten().flatten()
            row = np.repeat(np.arange(part.num_rows), found.value_lengths().to_numpy())
            doc, at = part.column("doc_id").to_numpy()[row], at.to_numpy()
            start, size = bounds[row] + (at >> 26), (at >> 16 & 31) + LENGTH - 1
            for lo in range(0, len(at), AT_ONCE):
                now = slice(lo, lo + AT_ONCE)
                ends = np.cumsum(size[now])
                taken = data[np.arange(ends[-1]) + np.repeat(start[now] - ends + size[now], size[now])]
                offsets = pa.py_buffer(np.append(0, ends).astype(np.int32))
                texts = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(taken)])
                columns = [gram[now], run[now], pa.array(doc[now]), pa.array(at[now]), crowd[now], texts]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "run", "doc", "at", "crowd", "bytes"])


class Suffixes:
    """Suffixes of many byte strings, ordered within groups by a mergesort over hashed comparisons."""

    def __init__(self, data, start, end, group, base: int = BASES[0]):
        self.data, self.start, self.end, self.value = data, start, end, PrefixHash(data, base)
        self.order = self._sorted(group)

    def common(self, x, y):
        """Length of the common extension of suffixes x and y: binary search over equal hashes."""
        a, b = self.start[x], self.start[y]
        lo = np.zeros(len(x), np.int64)
        hi = np.minimum(self.end[x] - a, self.end[y] - b)
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.value(a, a + mid) == self.value(b, b + mid)
            lo = np.where(open_ & same, mid, lo)
            hi = np.where(open_ & ~same, mid - 1, hi)
        return lo

    def _before(self, x, y, ties):
        """x sorts before y; equal suffixes do where ``ties`` is set."""
        n = self.common(x, y)
        a, b = self.start[x] + n, self.start[y] + n
        more_x, more_y = a < self.end[x], b < self.end[y]
        last = len(self.data) - 1
        less = self.data[np.minimum(a, last)] < self.data[np.minimum(b, last)]
        return np.where(more_x & more_y, less, np.where(more_x == more_y, ties, ~more_x))

    def _sorted(self, group):
        """``group`` is ascending.  All pairs of neighbouring runs of a width are merged at once."""
        n = len(group)
        order = np.arange(n)
        first = np.searchsorted(group, group, "left")
        stop = np.searchsorted(group, group, "right")
        width = 1
        while True:
            active = np.flatnonzero(stop - first > width)
            if not len(active):
                return order
            inside = active - first[active]
            pair = first[active] + inside // (2 * width) * (2 * width)
            middle = np.minimum(pair + width, stop[active])
            right = active >= middle
            # Where each row stands in the other run of its pair.
            base = np.where(right, pair, middle)
            lo, hi = base.copy(), np.where(right, middle, np.minimum(pair + 2 * width, stop[active]))
            while (live := np.flatnonzero(lo < hi)).size:
                mid = (lo[live] + hi[live]) >> 1
                mine, other = order[active[live]], order[mid]
                # A left row passes smaller right rows; a right row passes left rows up to equal ones.
                passed = self._before(other, mine, right[live])
                lo[live] = np.where(passed, mid + 1, lo[live])
                hi[live] = np.where(passed, hi[live], mid)
            own = active - np.where(right, middle, pair)
            merged = order.copy()
            merged[pair + own + lo - base] = order[active]
            order, width = merged, 2 * width


def _equal_bytes(data, a, b, n):
    """Whether n bytes from a and from b are equal, row by row (n is at most a few dozen)."""
    same = np.ones(len(a), bool)
    last = len(data) - 1
    for i in range(int(n.max(initial=0))):
        same &= (i >= n) | (data[np.minimum(a + i, last)] == data[np.minimum(b + i, last)])
    return same


def lost_strings(gram, doc, at, texts):
    """Masks of the starts that each run loses to a smaller document; rows are ascending by gram."""
    for base in BASES:
        masks = _lost(gram, doc, at, texts, base)
        if masks is not None:
            return masks
    raise RuntimeError("hashes of three bases collide")


def _lost(gram, doc, at, texts, base):
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size)
    offset, n = at >> 21 & 31, at >> 16 & 31
    anchor = end - size + offset
    suffixes = Suffixes(data, anchor, end, gram, base)
    order = suffixes.order
    left, right = order[:-1], order[1:]
    shared = np.where(gram[left] == gram[right], suffixes.common(left, right), -1)
    shared = np.minimum(shared, LENGTH)
    if not _equal_bytes(data, anchor[left], anchor[right], shared).all():
        return None
    masks = np.zeros(len(gram), np.int64)
    for j in range(REACH):
        has = (j <= offset) & (offset - j < n)
        stretch = np.append(0, np.cumsum(shared < LENGTH - j))
        rows, of = order[has[order]], stretch[has[order]]
        if not len(rows):
            continue
        before = suffixes.value(anchor[rows] - j, anchor[rows])
        by = np.lexsort((doc[rows], before, of))
        rows, of, before = rows[by], of[by], before[by]
        new = np.append(True, (of[1:] != of[:-1]) | (before[1:] != before[:-1]))
        head = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
        if not _equal_bytes(data, anchor[rows] - j, anchor[head] - j, np.full(len(rows), j)).all():
            return None
        later = doc[rows] > doc[head]
        masks[rows[later]] |= np.int64(1) << (offset[rows[later]] - j)
    return masks


def _sorted_groups(batches, most: int = AT_ONCE):
    """Rows come sorted by gram; whole grams are compared together, about ``most`` rows at a time."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        if held.num_rows >= most:
            gram = held.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut:
                yield _compared(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield _compared(held)


def _compared(t):
    gram, run, doc, at = (t.column(c).to_numpy() for c in ("gram", "run", "doc", "at"))
    masks = lost_strings(gram, doc, at, t.column("bytes").to_pylist())
    keep = masks != 0
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (gram, run, masks)], ["gram", "run", "mask"])


def _strings(batches):
    """Every string of crowded runs: (string, gram, run, doc, bit of its start)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 5000):
            rows = []
            part = batch.slice(lo, 5000)
            for gram, run, doc, at, data in zip(*[part.column(c).to_pylist() for c in ("gram", "run", "doc", "at", "bytes")]):
                rows += [(data[t : t + LENGTH], gram, run, doc, 1 << t) for t in range(at >> 16 & 31)]
            columns = zip(zip(*rows), [pa.binary()] + [pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["string", "gram", "run", "doc", "bit"])


def marked_places(docs: DataFrame, crowd_size: int = CROWD) -> DataFrame:
    """(doc, mark, place) of every run that loses strings; place is start << 27 | mask of the starts."""
    spark = docs.sparkSession
    rows = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").bitwiseAND(F.lit(0xFFFF)).alias("mark")
    )
    # Each step is written; its shuffle files may go as soon as it is.
    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(tidy, "false")
    spark.conf.set(tidy, "true")
    try:
        grams = rows.select("doc_id", "text").mapInArrow(_grams, "gram long, n long")
        known = stage(grams.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"))
        runs = stage(rows.mapInArrow(_runs, RUNS).join(known, "gram", "left_semi"))
        least = stage(runs.groupBy("gram", "run").agg(F.min("doc").alias("first"), F.min_by("at", "doc").alias("at")))
        several = stage(least.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
        crowd = (F.col("n") > crowd_size).alias("crowd")
        listed = least.join(several, "gram").select("first", "gram", "run", "at", crowd)
        listed = listed.groupBy(F.col("first"), F.col("at").bitwiseAND(F.lit(0xFFFF)).alias("of"))
        listed = stage(listed.agg(F.collect_list(F.struct("gram", "run", "at", "crowd")).alias("found")))
        texts = rows.join(listed, (F.col("doc_id") == F.col("first")) & (F.col("mark") == F.col("of")))
        contexts = stage(texts.select("doc_id", "text", "found").mapInArrow(_contexts, CONTEXTS))
        calm = contexts.where(~F.col("crowd")).repartition("gram").sortWithinPartitions("gram")
        masks = calm.mapInArrow(_sorted_groups, MASKS)
        crowded = contexts.where("crowd")
        if not crowded.isEmpty():
            strings = crowded.mapInArrow(_strings, "string binary, gram long, run long, doc long, bit long")
            smallest = stage(strings.groupBy("string").agg(F.min("doc").alias("first")))
            lost = strings.join(smallest, "string").where("doc > first")
            masks = masks.unionByName(lost.groupBy("gram", "run").agg(F.bit_or("bit").alias("mask")))
        # The first document of a run loses what the mask says wherever it has the run, the others all of it.
        decided = stage(least.select("gram", "run", "first").join(stage(masks), ["gram", "run"], "left"))
        starts = F.shiftright(F.col("at"), 16).bitwiseAND(F.lit(31)).cast("int")
        full = F.call_function("shiftleft", F.lit(1).cast("long"), starts) - 1
        mask = F.when(F.col("doc") > F.col("first"), full).otherwise(F.col("mask"))
        place = F.shiftleft(F.shiftright(F.col("at"), 26), 27).bitwiseOR(mask)
        marks = runs.join(decided, ["gram", "run"]).where((F.col("doc") > F.col("first")) | F.col("mask").isNotNull())
        return stage(marks.select("doc", F.col("at").bitwiseAND(F.lit(0xFFFF)).alias("mark"), place.alias("place")))
    finally:
        spark.conf.set(tidy, before)


def spans_of(places, at_once: int = 1 << 14):
    """Maximal removed stretches (starts, ends) from packed places.

    Runs are opened into their starts a slice at a time, so a text that is removed whole needs a few
    longs per run, not per byte; a stretch that a slice leaves open goes on in the next.
    """
    places = np.unique(np.asarray(places, np.int64))
    if len(places):  # one row a run
        places = np.bitwise_or.reduceat(places, np.flatnonzero(np.diff(places >> 27, prepend=-1)))
    spans: list = []
    for lo in range(0, len(places), at_once):
        part = places[lo : lo + at_once]
        row, t = np.nonzero(part[:, None] >> np.arange(REACH) & 1)
        start = np.unique((part[row] >> 27) + t)
        if not len(start):
            continue
        gap = np.flatnonzero(start[1:] > start[:-1] + LENGTH)
        a, b = start[np.append(0, gap + 1)], start[np.append(gap, len(start) - 1)] + LENGTH
        if spans and a[0] <= spans[-1][1][-1]:
            before = spans[-1]
            a[0], b[0] = min(a[0], before[0][-1]), max(b[0], before[1][-1])
            spans[-1] = (before[0][:-1], before[1][:-1])
        spans.append((a, b))
        if len(spans) > 1 and not len(spans[-2][0]):
            del spans[-2]
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*spans))


def _cut(batches):
    for batch in batches:
        rows, held = [], 0
        for doc, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("places")):
            data = (text.as_py() or "").encode()
            kept, removed, spans = data, 0, 0
            if places.is_valid:
                a, b = spans_of(places.values.to_numpy())
                cuts = np.concatenate([[0], np.stack([a, b], 1).reshape(-1), [len(data)]]).tolist()
                kept = b"".join(data[i:j] for i, j in zip(cuts[::2], cuts[1::2]))
                removed, spans = len(data) - len(kept), len(a)
            rows.append((doc, len(data), removed, spans, kept))
            held += len(kept)
            if len(rows) == 1000 or held > CHUNK:
                yield _kept(rows)
                rows, held = [], 0
        if rows:
            yield _kept(rows)


def _kept(rows):
    kinds = [pa.int64()] * 4 + [pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def cut_repeats(docs: DataFrame, crowd_size: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) for every document."""
    marks = marked_places(docs, crowd_size)
    places = marks.groupBy(F.col("doc").alias("_doc"), F.col("mark").alias("_mark")).agg(F.collect_list("place").alias("places"))
    places = stage(places)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").bitwiseAND(F.lit(0xFFFF)).alias("mark"))
    rows = rows.join(places, (F.col("doc_id") == F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return rows.select("doc_id", "text", "places").mapInArrow(_cut, schema)
