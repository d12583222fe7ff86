"""Language identification by prediction by partial matching.

Per language a tree of byte contexts up to three bytes (ASCII letters folded) holds how often each
byte followed.  A context with n events of d kinds codes a seen byte at count/(n+d) and escapes to
the next shorter context at d/(n+d); below the empty context all 256 bytes are alike.  After
training the statistics are frozen, so the exact code length of every (context, byte) is a table and
a text costs one look-up per byte for all languages together.  The shortest code wins, ties go to
the smaller language.  score is the winner's share of 2^-(code length) over all languages.

Learning uses a bounded sample: about ``per_language`` documents of every language, whole texts,
chosen by a hash of their id; counts are summed by Spark and the trees are trimmed to ``grams`` nodes.
Prediction reads every whole text.

Defined cases: null text, or text without a letter, is ``und`` with score 0; without any learned
language every text is ``und``; rows repeated predict alike; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewindow.llm.columns import columns_kept
from tidewindow.llm.tokens import slices

ORDER = 3
PER_LANGUAGE = 1500
GRAMS = 200_000
UNKNOWN = "und"
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
PAD = np.full(ORDER, 10, np.uint8)


def held_out(n: int, rest: int) -> Column:
    """crc32 of the id as text, modulo n, equals rest; never null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == rest, F.lit(False))


def byte_rows(column, fold=True):
    """All texts of an Arrow column as one byte array, each after three line feeds: (bytes, starts, ends)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    ends = np.cumsum(sizes + ORDER)
    starts = ends - sizes
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    own = np.ones(len(out), bool)
    for i in range(ORDER):
        out[starts - 1 - i] = 10
        own[starts - 1 - i] = False
    out[own] = FOLD[data] if fold else data
    return out, starts, ends


def grams_of(data):
    """For every byte the number of itself and the three before it."""
    wide = data.astype(np.uint32)
    out = wide.copy()
    for i in range(1, ORDER + 1):
        out[i:] |= wide[:-i] << np.uint32(8 * i)
    return out


def _count(batches):
    for batch in batches:
        lang = batch.column("lang").to_numpy(zero_copy_only=False)
        for name in sorted(set(lang)):
            data, starts, ends = byte_rows(batch.column("text").filter(pa.array(lang == name)))
            grams = grams_of(data)
            keep = np.ones(len(grams), bool)
            for i in range(1, ORDER + 1):
                keep[starts - i] = False
            found, n = np.unique(grams[keep], return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(found), "gram": pa.array(found.astype(np.int64)), "n": pa.array(n.astype(np.int64))})


class Model:
    """Frozen code lengths: for every order the known grams (sorted) and a row of bits per language."""

    def __init__(self, langs, counts, grams: int = GRAMS):
        """counts: (language number, gram, n) arrays of the longest grams."""
        lang, gram, n = counts
        self.langs, size = langs, len(langs)
        self.keys, self.bits, self.escapes = [], [], []
        lower = None
        for order in range(ORDER + 1):
            part = gram & ((1 << 8 * (order + 1)) - 1)
            keys, at = np.unique(part, return_inverse=True)
            table = np.zeros((len(keys), size))
            np.add.at(table, (at, lang), n)
            if len(keys) > grams:
                best = np.sort(np.argsort(-table.sum(1), kind="stable")[:grams])
                keys, table = keys[best], table[best]
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total = np.zeros((len(contexts), size))
            kinds = np.zeros((len(contexts), size))
            np.add.at(total, of, table)
            np.add.at(kinds, of, table > 0)
            both = np.where(total > 0, total + kinds, 1)
            escape = np.where(total > 0, -np.log2(np.where(total > 0, kinds, 1) / both), 0)
            below = np.full((len(keys), size), 8.0) if lower is None else lower(keys & ((1 << 8 * order) - 1))
            seen = -np.log2(np.where(table > 0, table, 1) / both[of])
            bits = np.where(table > 0, seen, escape[of] + below)
            self.keys.append(keys)
            self.bits.append(bits.astype(np.float32))
            self.escapes.append((contexts, escape.astype(np.float32)))
            lower = self._cost_at(order)

    @classmethod
    def of(cls, fields: dict) -> "Model":
        """A trained model from its fields: plain arrays, which is what executors are sent."""
        model = cls.__new__(cls)
        vars(model).update(fields)
        return model

    def _cost_at(self, order):
        return lambda keys: self.cost(keys, order)

    def cost(self, keys, order: int):
        """Bits (rows x languages) of grams of one order: by table, else escape and the shorter context."""
        out = np.empty((len(keys), len(self.langs)), np.float32)
        if order < 0:
            out[:] = 8.0
            return out
        at, known = find(self.keys[order], keys)
        out[known] = self.bits[order][at[known]]
        if not known.all():
            lost = keys[~known]
            rest = self.cost(lost & ((1 << 8 * order) - 1), order - 1)
            contexts, escape = self.escapes[order]
            c, held = find(contexts, lost >> 8)
            rest[held] += escape[c[held]]
            out[~known] = rest
        return out


def find(table, keys):
    """Places of keys in a sorted table, and which are in it."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Scorer:
    """A worker's view of the model: two direct tables replace the search for the longest grams.

    Bytes are numbered as far as the known grams use them (0: never), which keeps the tables small.
    """

    def __init__(self, model: Model):
        self.model = model
        contexts, keys = model.escapes[ORDER][0], model.keys[ORDER]
        used = np.unique(np.concatenate([keys >> 8 * i & 255 for i in range(ORDER + 1)]))
        self.code = np.zeros(256, np.int64)
        self.code[used] = np.arange(1, len(used) + 1)
        self.base = len(used) + 1
        self.context = np.zeros(self.base**ORDER, np.int32)
        self.context[self._number(contexts)] = np.arange(1, len(contexts) + 1)
        self.row = np.zeros(self.base * (len(contexts) + 1), np.int32)
        self.row[self._place(keys)] = np.arange(1, len(keys) + 1)
        self.bits = [np.append(np.float32(0), model.bits[ORDER][:, i]) for i in range(len(model.langs))]

    def _number(self, contexts):
        out = self.code[contexts >> 16 & 255]
        for shift in (8, 0):
            out = out * self.base + self.code[contexts >> shift & 255]
        return out

    def _place(self, grams):
        return self.context[self._number(grams >> 8)] * np.int64(self.base) + self.code[grams & 255]

    def lengths(self, data, starts, ends, chunk: int = 1 << 18):
        """Code length in bits of every text, rows x languages."""
        out = np.zeros((len(starts), len(self.model.langs)))
        grams = grams_of(data)
        for lo in range(0, len(data), chunk):
            part = grams[lo : lo + chunk]
            at = self.row[self._place(part)]
            first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, lo + len(part), "left")
            a = np.clip(starts[first:last] - lo, 0, len(part))
            b = np.clip(ends[first:last] - lo, 0, len(part))
            lost = np.flatnonzero(at == 0)
            more = self.model.cost(part[lost].astype(np.int64), ORDER) if len(lost) else None
            for i, bits in enumerate(self.bits):
                cost = bits[at].astype(np.float64)
                if more is not None:
                    cost[lost] = more[:, i]
                total = np.append(0.0, np.cumsum(cost))
                out[first:last, i] += total[b] - total[a]
        return out


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, grams: int = GRAMS) -> Model:
    """Fit on labelled documents (text, lang).  Sizes by language are counted over all of them."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], (np.zeros(0, np.int64),) * 3)
    share = F.create_map(*[F.lit(x) for name in langs for x in (name, per_language / sizes[name])])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counted = known.where(draw < share).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    rows = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = rows.orderBy(F.desc("n"), "lang", "gram").limit(grams * 2).toArrow()
    number = np.searchsorted(np.array(langs, object), rows.column("lang").to_numpy())
    return Model(langs, (number.astype(np.int64), rows.column("gram").to_numpy(), rows.column("n").to_numpy()), grams)


def _predictor(shared, kept):
    def predict(batches):
        model = Model.of(shared.value)
        scorer = Scorer(model) if model.langs else None
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                n = part.num_rows
                lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
                if scorer is not None:
                    data, starts, ends = byte_rows(part.column("text"))
                    bits = scorer.lengths(data, starts, ends)
                    best = bits.argmin(1)
                    share = 1 / np.exp2(np.clip(bits[np.arange(n), best][:, None] - bits, -1000, 0)).sum(1)
                    letters = part.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
                    lang[letters] = np.array(model.langs, object)[best[letters]]
                    score[letters] = share[letters]
                names = [c for c in part.schema.names if c in kept]
                columns = [part.column(c) for c in names] + [pa.array(lang, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "_lang", "_score"])

    return predict


def has_letter(text) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """The named columns, then _lang and _score, for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    rows = docs.withColumn("_letters", has_letter(F.col("text"))).select(*dict.fromkeys([*columns, "text", "_letters"]))
    fields = [rows.schema[c] for c in dict.fromkeys(columns)]
    schema = T.StructType([*fields, T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())])
    return rows.mapInArrow(_predictor(shared, set(columns)), schema)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    model = train(docs.where(~held_out(3, 1)), per_language)
    rows = predict(docs, model, "doc_id")
    return rows.select("doc_id", held_out(3, 1).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


@columns_kept
def keep_identified(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The documents in some language: those that are predicted ``und`` go.  Same columns as ``docs``.

    Where no label teaches a language, the documents with a letter stay.
    """
    model = train(docs.where(~held_out(3, 1)), per_language)
    if not model.langs:
        return docs.where(has_letter(F.col("text")))
    return predict(docs, model, *docs.columns).where(F.col("_lang") != UNKNOWN).select(*docs.columns)
