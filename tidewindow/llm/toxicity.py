"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in the words and word
openings it holds; a document's is their noisy-or, 1 - prod(1 - p), and the weights are fitted to
document labels alone by gradient descent on the cross-entropy of that noisy-or.  The trained model
then scores sentences, which locates the offending ones.

Learning uses a bounded sample: about ``per_label`` labelled documents of each label, whole texts,
chosen by a hash of their id, and at most ``FEATURES`` features of them, the ones whose document
counts tell the labels apart best.  Prediction reads every whole text.

Defined cases: null text is empty; a text without a word has no sentence and score 0; null labels
teach nothing; an id labelled twice counts as toxic if any label says so; without both labels in the sample
all scores are 0; rows repeated score alike; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from tidewindow.llm.language_id import find, held_out
from tidewindow.llm.tokens import KEY_BYTES, Words, slices
from tidewindow.sources.staging import stage

PER_LABEL = 4000
FEATURES = 4000
LEAST_DOCS = 4
OPENINGS = (3, 4, 5, 6)  # bytes
STEPS = 300
RATE = 0.3
PENALTY = 1e-3
END = np.zeros(256, bool)
END[[10, 33, 46, 63]] = True  # line feed ! . ?
ODD = np.uint64(0x9E3779B97F4A7C15)


def feature_keys(words: Words):
    """(word number, feature) for every word: a 64-bit key of the word and of each of its openings."""
    low, sizes = words.low(), words.sizes
    whole = (low ^ (sizes.astype(np.uint64) << np.uint64(56))) * ODD
    long = np.flatnonzero((sizes > 8) & (sizes <= KEY_BYTES))
    whole[long] ^= words.high(long) * np.uint64(0xC2B2AE3D27D4EB4F)
    numbers = np.arange(len(sizes))
    out = [(numbers[sizes <= KEY_BYTES], whole[sizes <= KEY_BYTES])]
    for n in OPENINGS:
        mine = np.flatnonzero(sizes > n)
        mask = np.uint64((1 << 8 * n) - 1)
        out.append((mine, (low[mine] & mask) * ODD + np.uint64(n)))
    return np.concatenate([a for a, _ in out]), np.concatenate([k for _, k in out]).view(np.int64)


def sentence_numbers(words: Words):
    """A number per word that differs between sentences and between texts."""
    if not len(words.starts):
        return np.zeros(0, np.int64)
    at = np.cumsum(END[words.data])[words.starts] + words.text
    return np.cumsum(np.diff(at, prepend=at[0]) > 0)


def _document_features(batches):
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"))
            number, key = feature_keys(words)
            pairs = np.unique(np.stack([words.text[number], key], 1), axis=0)
            toxic = part.column("toxic").to_numpy().astype(np.int64)
            for label in (0, 1):
                keys, n = np.unique(pairs[toxic[pairs[:, 0]] == label, 1], return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "toxic": pa.array(np.full(len(keys), label)), "n": pa.array(n)})


def _bags(features):
    """Per document: how many sentences, and (sentence, feature) pairs of the chosen features."""

    def bags(batches):
        keys = np.array(features, np.int64)
        for batch in batches:
            for part in slices(batch):
                x = Bags(part.column("text"), keys)
                rows = {"toxic": part.column("toxic"), "sentences": pa.array(x.sentences)}
                cut = np.searchsorted(x.hit_text, np.arange(part.num_rows + 1))
                first = np.concatenate([[0], np.cumsum(x.sentences)])[x.hit_text]
                pack = lambda v: pa.array([v[a:b].tolist() for a, b in zip(cut, cut[1:])], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(rows | {"sentence": pack(x.hit_sentence - first), "feature": pack(x.hit_feature)})

    return bags


class Bags:
    """Sentences of many texts and the known features they hold, each once."""

    def __init__(self, column, keys):
        words = Words(column)
        of = sentence_numbers(words)
        texts = len(words.bounds) - 1
        count = int(of.max(initial=-1)) + 1
        self.text_of = np.zeros(count, np.int64)
        self.text_of[of] = words.text
        self.sentences = np.bincount(self.text_of, minlength=texts).astype(np.int64)
        number, key = feature_keys(words)
        at, known = find(keys, key)
        pairs = np.unique(of[number[known]] * max(1, len(keys)) + at[known])
        self.hit_sentence, self.hit_feature = pairs // max(1, len(keys)), pairs % max(1, len(keys))
        self.hit_text = self.text_of[self.hit_sentence]
        self.words, self.of = words, of


class Model:
    def __init__(self, keys, weights, bias):
        self.keys, self.weights, self.bias = keys, weights, bias

    def sentence_scores(self, bags: Bags):
        z = np.full(len(bags.text_of), self.bias)
        np.add.at(z, bags.hit_sentence, self.weights[bags.hit_feature])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def document_scores(self, bags: Bags):
        quiet = np.log1p(-np.minimum(self.sentence_scores(bags), 1 - 1e-12))
        return -np.expm1(np.bincount(bags.text_of, quiet, len(bags.sentences)))


def fit(keys, toxic, sentences, sentence, feature, document):
    """Weights and bias from flat hits (sentence numbers run over all documents)."""
    weights, bias = np.zeros(len(keys)), -4.0
    of = np.repeat(np.arange(len(toxic)), sentences)
    total = len(of)
    share = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum()))
    moments = [np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)]
    for step in range(1, STEPS + 1):
        z = np.clip(bias + np.bincount(sentence, weights[feature], total), -30, 30)
        p = 1 / (1 + np.exp(-z))
        quiet = np.bincount(of, np.log1p(-p), len(toxic))
        doc = np.clip(-np.expm1(quiet), 1e-9, 1 - 1e-12)
        # d loss / d log(1-p) is y (1-P)/P - (1-y); d log(1-p) / dz is -p.
        slope = share * (np.where(toxic == 1, -(1 - doc) / doc, 1.0))
        dz = slope[of] * p
        gradient = np.append(np.bincount(feature, dz[sentence], len(keys)) + PENALTY / max(1, len(keys)) * weights, dz.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, features: int = FEATURES) -> Model:
    """Fit on documents (doc_id, text) whose id has a label (doc_id, toxic)."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    empty = Model(np.zeros(0, np.int64), np.zeros(0), -40.0)
    if len(sizes) < 2:
        return empty
    share = F.when(F.col("toxic") == 1, per_label / sizes[1]).otherwise(per_label / sizes[0])
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = marks.where(draw < share)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    sample = stage(sample)
    counts = sample.mapInArrow(_document_features, "key long, toxic long, n long").groupBy("key").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("yes"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("no"),
    )
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return empty
    # Difference of the labels' shares in standard errors.
    both = (F.col("yes") + F.col("no")) / F.lit(float(size[0] + size[1]))
    apart = F.abs(F.col("yes") / size[1] - F.col("no") / size[0]) / F.sqrt(both * (1 - both) + F.lit(1e-6))
    best = counts.where(F.col("yes") + F.col("no") >= LEAST_DOCS).orderBy(apart.desc(), "key").limit(features).toArrow()
    keys = np.sort(best.column("key").to_numpy())
    bags = sample.mapInArrow(_bags(keys.tolist()), "toxic int, sentences long, sentence array<long>, feature array<long>").toArrow()
    toxic = bags.column("toxic").to_numpy().astype(np.int64)
    sentences = bags.column("sentences").to_numpy()
    flat = lambda c: pa.compute.list_flatten(bags.column(c)).to_numpy()
    document = pa.compute.list_parent_indices(bags.column("sentence")).to_numpy()
    first = np.concatenate([[0], np.cumsum(sentences)])
    weights, bias = fit(keys, toxic, sentences, flat("sentence") + first[document], flat("feature"), document)
    return Model(keys, weights, bias)


def _score(shared):
    def score(batches):
        model = Model(**shared.value)
        for batch in batches:
            for part in slices(batch):
                found = model.document_scores(Bags(part.column("text"), model.keys))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    return score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    return docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id long, score double")


def _locate(shared, least):
    def locate(batches):
        model = Model(**shared.value)
        for batch in batches:
            for part in slices(batch):
                bags = Bags(part.column("text"), model.keys)
                scores = model.sentence_scores(bags)
                words = bags.words
                first = np.full(len(scores), len(words.data))
                last = np.zeros(len(scores), np.int64)
                np.minimum.at(first, bags.of, words.starts)
                np.maximum.at(last, bags.of, words.starts + words.sizes)
                bad = np.flatnonzero(scores >= least)
                text = bags.text_of[bad]
                ids = part.column("doc_id").take(pa.array(text))
                raw = [(part.column("text")[int(t)].as_py() or "").encode() for t in text]
                start, end = first[bad] - words.bounds[text], last[bad] - words.bounds[text]
                spans = [r[a:b].decode(errors="replace") for r, a, b in zip(raw, start, end)]
                columns = [ids, pa.array(start), pa.array(end), pa.array(spans, pa.string()), pa.array(scores[bad])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "sentence", "score"])

    return locate


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, byte span, sentence and score of every sentence at ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    schema = "doc_id long, start long, end long, sentence string, score double"
    return docs.select("doc_id", "text").mapInArrow(_locate(shared, least), schema)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from the rows that are not held out."""
    model = train(docs.where(~held_out(5, 0)), labels.where(~held_out(5, 0)))
    rows = predict(docs, model)
    return rows.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
