"""Toxicity against plain loops: features and sentences, the noisy-or of a document, the descent."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewindow.llm import toxicity as TX
from tidewindow.llm.tokens import KEY_BYTES, Words

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TEXTS = [
    "You fool! Go away. GO", "one two\nthree?four", "", None, "...!?", "a" * 17 + " " + "b" * 16 + " seven77", "été ÉTÉ naïveté. 漢字漢字漢字 漢",
    "fool fool. fool", "Rosebush, rose-bush; ROSE", "x. " * 50 + "tail",
]


def features_of(word):
    """Names of what a word holds: itself if it fits a key, and its proper openings."""
    return ([("word", word)] if len(word) <= KEY_BYTES else []) + [(n, word[:n]) for n in TX.OPENINGS if len(word) > n]


def sentences_of(text):
    # A-Z only: other capitals keep their case.
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = [WORD.findall(s) for s in re.split(rb"[\n!.?]", raw)]
    return [{f for w in s for f in features_of(w)} for s in words if s]


def key_names(texts):
    """Feature name -> key, each asked of a text with that one word."""
    out = {}
    for word in {w for t in texts if t for w in WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))}:
        _, keys = TX.feature_keys(Words(pa.array([word.decode()])))
        out |= dict(zip(features_of(word), keys.tolist()))
        assert len(keys) == len(features_of(word))
    assert len(set(out.values())) == len(out)
    return out


def loop_score(text, weights, bias):
    quiet = 1.0
    for sentence in sentences_of(text):
        quiet *= 1 - 1 / (1 + math.exp(-(bias + sum(weights.get(f, 0.0) for f in sentence))))
    return 1 - quiet


@pytest.mark.parametrize("bias", [-4.0, -0.5, 2.0])
def test_document_scores_equal_a_loop(bias):
    names = key_names(TEXTS)
    rng = np.random.default_rng(5)
    chosen = {f: float(rng.normal()) for f in sorted(names, key=str) if rng.random() < 0.6}
    order = sorted(chosen, key=names.get)
    model = TX.Model(np.array([names[f] for f in order]), np.array([chosen[f] for f in order]), bias)
    got = model.document_scores(TX.Bags(pa.array(TEXTS), model.keys))
    assert got == pytest.approx([loop_score(t, chosen, bias) for t in TEXTS], abs=1e-12)
    # One text at a time is the same as all together.
    alone = [model.document_scores(TX.Bags(pa.array([t], pa.string()), model.keys))[0] for t in TEXTS]
    assert alone == pytest.approx(got.tolist(), abs=1e-12)


def _bags():
    """Documents as lists of sentences, a sentence a set of feature numbers."""
    rng = np.random.default_rng(8)
    docs = [[set(rng.choice(6, rng.integers(1, 4), replace=False).tolist()) for _ in range(rng.integers(1, 5))] for _ in range(30)]
    toxic = np.array([int(any({0, 1} <= s for s in d)) for d in docs])
    toxic[:3] = [1, 0, 1]
    return docs, toxic


def _loss(x, docs, toxic):
    """Cross-entropy of the noisy-or, both labels weighing half, and the penalty."""
    total = TX.PENALTY / (len(x) - 1) * sum(w * w for w in x[:-1]) / 2
    for doc, y in zip(docs, toxic):
        quiet = math.prod(1 - 1 / (1 + math.exp(-(x[-1] + sum(x[f] for f in s)))) for s in doc)
        total -= 0.5 / (toxic == y).sum() * math.log(1 - quiet if y else quiet)
    return total


def _slope(x, docs, toxic):
    out = np.array([TX.PENALTY / (len(x) - 1) * w for w in x[:-1]] + [0.0])
    for doc, y in zip(docs, toxic):
        p = [1 / (1 + math.exp(-(x[-1] + sum(x[f] for f in s)))) for s in doc]
        whole = 1 - math.prod(1 - v for v in p)
        for s, v in zip(doc, p):
            d = 0.5 / (toxic == y).sum() * v * (-(1 - whole) / whole if y else 1.0)
            for f in [*s, -1]:
                out[f] += d
    return out


def test_descent_equals_a_loop_on_the_loss():
    docs, toxic = _bags()
    x = np.append(np.zeros(6), -4.0)
    first, second = np.zeros(7), np.zeros(7)
    for step in range(1, TX.STEPS + 1):
        slope = _slope(x, docs, toxic)
        if step in (1, 2, 50, TX.STEPS):
            for i in range(7):
                e = np.eye(7)[i] * 1e-5
                assert slope[i] == pytest.approx((_loss(x + e, docs, toxic) - _loss(x - e, docs, toxic)) / 2e-5, abs=1e-7)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        x = x - TX.RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    flat = [(i, f, d) for i, (d, s) in enumerate((d, s) for d, doc in enumerate(docs) for s in doc) for f in sorted(s)]
    sentence, feature, document = (np.array(c) for c in zip(*flat))
    weights, bias = TX.fit(np.arange(6), toxic, np.array([len(d) for d in docs]), sentence, feature, document)
    assert weights == pytest.approx(x[:-1], abs=1e-6) and bias == pytest.approx(x[-1], abs=1e-6)
    assert _loss(x, docs, toxic) < _loss(np.append(np.zeros(6), -4.0), docs, toxic)
