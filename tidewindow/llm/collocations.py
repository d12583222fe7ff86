"""Phrase collocations counted through a prefix-free parse of the corpus.

Texts split into pieces, and a piece is cut after every word that triggers by its own hash, so equal
passages give equal chunks wherever they stand.  A chunk carries the ``LONGEST - 1`` words after it:
a phrase belongs to the chunk that holds its first word, and overlaps are counted once.  Distinct
chunks and their frequencies are the dictionary; phrases of n words are counted inside distinct
chunks, weighted, and only where both phrases of n - 1 words within may be frequent.  That test is a
bit table of fixed size whose false positives cost rows but change no count.  From three words on
the dictionary is one of runs: the stretches of chunks whose pairs may all be frequent.

Memory of a task: one text (its bytes and one piece's words, long pieces in blocks), ``HELD`` chunks
while parsing, and about 100 bytes a word for the ``TEXT`` bytes of chunks that are counted together.

Defined cases: null text is empty; null lang counts as ``und``, as does the lang of that name; a
text without words counts nothing; repeated rows count each; an empty table gives no rows; other
columns are not read.
"""

import re
from collections import Counter
from functools import partial
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidewindow.sources.staging import stage

LONGEST = 5
LEAST = 100
SHOWN = 2000
PERCENT = 100  # a phrase goes when a longer one has this share of its occurrences
TRIGGER = 32
BLOCK = 1 << 14  # words of a long piece that are cut together
LONG = 1 << 20  # bytes from which a piece is read word by word
HELD = 1 << 18
TEXT = 1 << 23
BITS = 26
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
CHUNKS = "lang binary, chunk binary, own long, freq long"

PIECE = re.compile(rb"[^.,;:!?\n-\r]+")
WORD = re.compile(rb"[^ \t]+")


def _blocks(piece: bytes, longest: int):
    """(words, own): the piece's words, long pieces in blocks that carry the words after them."""
    if len(piece) < LONG:
        words = piece.split()
        if words:
            yield words, len(words)
        return
    found = (m.group() for m in WORD.finditer(piece))
    words = list(islice(found, BLOCK + longest - 1))
    while words:
        own = min(BLOCK, len(words)) if len(words) == BLOCK + longest - 1 else len(words)
        yield words, own
        words = words[own:]
        words += islice(found, BLOCK + longest - 1 - len(words))


def chunks(text: bytes, longest: int = LONGEST, trigger: int = TRIGGER):
    """(chunk, own): space-joined words, of which the first ``own`` are the chunk's own."""
    for piece in PIECE.finditer(text.lower()):  # for bytes: A-Z only
        for words, size in _blocks(piece.group(), longest):
            start = 0
            for i in range(size):
                if i + 1 == size or crc32(words[i]) % trigger == 0:
                    yield b" ".join(words[start : i + longest]), i + 1 - start
                    start = i + 1


def _batch(columns):
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _parse(batches, longest, trigger):
    held = Counter()

    def flush():
        keys = list(held)
        yield _batch({
            "lang": pa.array([k[0] for k in keys], pa.binary()), "chunk": pa.array([k[1] for k in keys], pa.binary()),
            "own": pa.array([k[2] for k in keys], pa.int64()), "freq": pa.array(held.values(), pa.int64()),
        })
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            lang = lang.as_py()
            for chunk, own in chunks(text.as_py(), longest, trigger):
                held[lang, chunk, own] += 1
                if len(held) >= HELD:
                    yield from flush()
    yield from flush()


def dictionary(docs: DataFrame, longest: int = LONGEST, trigger: int = TRIGGER) -> DataFrame:
    """(lang, chunk, own, freq): the distinct chunks of the parse; chunks are combined map-side."""
    rows = docs.select(
        F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    parsed = rows.mapInArrow(partial(_parse, longest=longest, trigger=trigger), CHUNKS)
    return parsed.groupBy("lang", "chunk", "own").agg(F.sum("freq").alias("freq"))


class Words:
    """The words of a block of chunks as numbers, with a rolling hash of every phrase."""

    def __init__(self, lang, chunk):
        lists = pc.split_pattern(chunk, " ")
        encoded = lists.flatten().dictionary_encode()
        self.lang, self.vocabulary, self.codes = lang, encoded.dictionary, encoded.indices.to_numpy()
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
        self.size = np.diff(ends, prepend=0)
        self.row = np.repeat(np.arange(len(chunk)), self.size)
        self.at = np.arange(len(self.codes)) - np.repeat(ends - self.size, self.size)
        self.left = self.size[self.row] - self.at
        known = np.fromiter(map(xxhash.xxh64_intdigest, self.vocabulary.to_pylist()), np.uint64, len(self.vocabulary))
        langs = lang.dictionary_encode()
        salts = np.fromiter(map(xxhash.xxh64_intdigest, langs.dictionary.to_pylist()), np.uint64, len(langs.dictionary))
        self.lang_codes = langs.indices.to_numpy()
        self.salt = salts[self.lang_codes][self.row]
        self.one = known[self.codes]

    def hashes(self, n: int):
        """Of the n words from each place on; of no meaning where fewer are left."""
        h = self.one.copy()
        for j in range(1, n):
            h[:-j] = h[:-j] * FACTOR + self.one[j:]
        return (h ^ self.salt) * MIX

    def may_be_frequent(self, n: int, table):
        bit = self.hashes(n) >> np.uint64(64 - BITS)
        return ((table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool) & (self.left >= n)

    def phrases(self, places, n: int):
        parts = [self.vocabulary.take(pa.array(self.codes[places + j])) for j in range(n)]
        return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, b" ")

    def same(self, a, b, n: int):
        alike = self.lang_codes[self.row[a]] == self.lang_codes[self.row[b]]
        for j in range(n):
            alike &= self.codes[a + j] == self.codes[b + j]
        return alike


def tally(block, n: int, table=None):
    """(lang, gram, f) of the block's phrases of n words that start at a chunk's own words, where
    ``table`` allows both phrases of n - 1 words within."""
    words = Words(block["lang"], block["chunk"])
    own = block["own"].to_numpy()
    fine = (words.at < own[words.row]) & (words.left >= n)
    if n > 1:
        inner = words.may_be_frequent(n - 1, table)
        fine[:-1] &= inner[:-1] & inner[1:]
    places = np.flatnonzero(fine)
    keys = words.hashes(n)[places]
    order = np.argsort(keys, kind="stable")
    places, keys = places[order], keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    spread = np.diff(first, append=len(keys))
    if not words.same(places, np.repeat(places[first], spread), n).all():  # two phrases of one hash: each place alone
        first = np.arange(len(places))
    counts = np.add.reduceat(block["freq"].to_numpy()[words.row[places]], first) if len(places) else np.empty(0, np.int64)
    kept = places[first]
    return _batch({
        "lang": words.lang.take(pa.array(words.row[kept])), "gram": words.phrases(kept, n), "f": pa.array(counts, pa.int64()),
    })


def runs(block, table):
    """(lang, chunk, own, freq) of the stretches of three words or more whose pairs ``table`` allows."""
    words = Words(block["lang"], block["chunk"])
    pairs = words.may_be_frequent(2, table)
    edge = np.diff(pairs.astype(np.int8), prepend=0, append=0)
    start, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # last: the run's final word
    own = block["own"].to_numpy()[words.row[start]] - words.at[start]
    kept = (last - start >= 2) & (own > 0)
    start, size, own = start[kept], (last - start + 1)[kept], own[kept]
    ends = np.cumsum(size, dtype=np.int64)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
    lists = pa.LargeListArray.from_arrays(np.append(0, ends), words.vocabulary.take(pa.array(words.codes[places])))
    return _batch({
        "lang": words.lang.take(pa.array(words.row[start])), "chunk": pc.binary_join(lists, b" "),
        "own": pa.array(np.minimum(own, size)), "freq": block["freq"].take(pa.array(words.row[start])),
    })


def _blocks_of(batches):
    """Batches joined until they hold ``TEXT`` bytes of chunks."""
    held, size = [], 0

    def joined():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= TEXT:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _count(batches, n, table):
    for block in _blocks_of(batches):
        yield tally(block, n, table and table.value)


def _runs(batches, table):
    for block in _blocks_of(batches):
        yield runs(block, table.value)


def _bits(batches, n):
    for batch in batches:
        if batch.num_rows:
            words = Words(batch["lang"], batch["gram"])
            bit = words.hashes(n)[words.at == 0] >> np.uint64(64 - BITS)
            yield _batch({
                "word": pa.array((bit >> np.uint64(6)).astype(np.int64)),
                "bits": pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64)),
            })


def bit_table(frequent: DataFrame, n: int) -> np.ndarray:
    """At most 2**BITS bits come to the driver, by 64-bit words that the executors have combined."""
    rows = frequent.select("lang", "gram").mapInArrow(partial(_bits, n=n), "word long, bits long")
    rows = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.uint64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table


def frequent_phrases(parse: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, gram, words, f) of all phrases of 1 to ``longest`` words with f >= ``least``.

    A frequent phrase holds frequent phrases only, so a length is counted from what the one before
    it left; each length is one pass over the dictionary.
    """
    sc = parse.sparkSession.sparkContext
    levels, table = [], None
    for n in range(1, longest + 1):
        if n == 3:
            found = parse.mapInArrow(partial(_runs, table=table), CHUNKS)
            parse = stage(found.groupBy("lang", "chunk", "own").agg(F.sum("freq").alias("freq")))
        rows = parse.mapInArrow(partial(_count, n=n, table=table), "lang binary, gram binary, f long")
        found = rows.groupBy("lang", "gram").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        found = stage(found.select("lang", "gram", F.lit(n).alias("words"), "f"))
        levels.append(found)
        bits = bit_table(found, n)
        if not bits.any():
            break
        table = sc.broadcast(bits)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _cuts(candidates: DataFrame) -> DataFrame:
    """One row per candidate and cut: its first ``k`` words and the rest."""
    words = F.split(F.col("gram").cast("string"), " ")
    rows = candidates.select("lang", "gram", "words", F.col("f").alias("a"), words.alias("of"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    part = lambda start, n: F.array_join(F.slice("of", start, n), " ").cast("binary")
    return rows.select(
        "lang", "gram", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest")
    )


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, gram, a, l, r, n, score) by the lowest-scoring cut; arithmetic on 38-digit decimals."""
    left = frequent.select("lang", F.col("gram").alias("first"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("gram").alias("rest"), F.col("f").alias("r"))
    rows = _cuts(frequent.where("words > 1")).join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    score = F.expr(
        "(cast(1000 * cast(a as decimal(18,0)) as decimal(19,0)) * cast(n as decimal(19,0)))"
        " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    )
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return rows.groupBy("lang", "gram").agg(F.first("a").alias("a"), F.first("n").alias("n"), lowest).select(
        "lang", "gram", "a", "cut.l", "cut.r", "n", "cut.score"
    )


def covered(frequent: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(lang, gram) of phrases that a longer candidate accounts for."""
    words = F.split(F.col("gram").cast("string"), " ")
    longer = frequent.where("words > 2").select("lang", "words", F.col("f").alias("longer"), words.alias("of"))
    inner = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    gram = F.array_join(F.slice("of", F.col("start"), F.col("size")), " ").cast("binary").alias("gram")
    most = inner.select("lang", gram, "longer").groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
    enough = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("f").cast("decimal(20,0)") * percent
    return frequent.where("words > 1").join(most, ["lang", "gram"]).where(enough).select("lang", "gram")


def collocations(docs: DataFrame, least: int = LEAST, shown: int = SHOWN, longest: int = LONGEST, trigger: int = TRIGGER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first ``shown`` collocations."""
    parse = stage(dictionary(docs, longest, trigger))
    totals = parse.groupBy("lang").agg(F.sum(F.col("own") * F.col("freq")).alias("n"))
    frequent = frequent_phrases(parse, least, longest)
    rows = scored(frequent, totals).join(covered(frequent), ["lang", "gram"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "gram")
    return (
        rows.withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= shown)
        .select(F.col("lang").cast("string").alias("lang"), "rank", F.col("gram").cast("string").alias("phrase"), "a", "l", "r", "n", "score")
    )
