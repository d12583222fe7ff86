"""What a worker of op7 holds at a time, and the runs' bytes, against plain slices."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tidewindow.llm import suffix_dedup as SD


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def letters(n, seed=3):
    return np.random.default_rng(seed).integers(97, 123, n).astype(np.uint8)


def test_runs_of_a_slice_of_texts_stay_small():
    data = letters(4 << 20)
    bounds = np.arange(0, len(data) + 1, 1 << 12)
    SD._KEPT.clear()
    assert peak_mb(lambda: SD.runs_of(data, bounds)) < 120


def test_sorted_groups_stay_small():
    n, size = 100_000, 76
    data = letters(n * size)
    texts = pa.array([data[i * size : (i + 1) * size].tobytes() for i in range(n)], pa.binary())
    gram, doc = np.arange(n) // 4, np.arange(n)
    at = np.full(n, 26 << 21 | 27 << 16)
    columns = [pa.array(c) for c in (gram, doc, doc, at)] + [pa.array(np.zeros(n, bool)), texts]
    batch = pa.RecordBatch.from_arrays(columns, ["gram", "run", "doc", "at", "crowd", "bytes"])
    parts = [batch.slice(lo, 10_000) for lo in range(0, n, 10_000)]
    SD._KEPT.clear()
    assert peak_mb(lambda: list(SD._sorted_groups(parts))) < 120


def test_runs_do_not_depend_on_where_slices_end(monkeypatch):
    """Every start of a text lies in exactly one run, whose minimiser is its own."""
    words = [b"", b"short", letters(700, 1).tobytes(), b"", letters(49).tobytes(), letters(50).tobytes(), b"ab" * 300]
    data, bounds = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    for chunk in (64, 333, 1 << 18):
        monkeypatch.setattr(SD, "CHUNK", chunk)
        _, _, text, start, offset, n = SD.runs_of(data, bounds)
        starts = [(t, s + i) for t, s, k in zip(text.tolist(), start.tolist(), n.tolist()) for i in range(k)]
        assert starts == [(t, s) for t, w in enumerate(words) for s in range(max(0, len(w) - SD.LENGTH + 1))]
        assert ((offset >= n - 1) & (offset <= SD.LENGTH - SD.GRAM)).all()


def test_contexts_are_the_bytes_of_their_runs(monkeypatch):
    monkeypatch.setattr(SD, "AT_ONCE", 3)
    texts = ["x" * 60 + "é" * 40, None, "0123456789" * 12, "z" * 55]
    found = [[(1, 2, 5 << 26 | 3 << 16), (3, 4, 70 << 26 | 1 << 16)], [], [(5, 6, i << 26 | 27 << 16) for i in range(6)], [(7, 8, 1 << 26 | 2 << 16)]]
    of = [[dict(gram=g, run=r, at=a, crowd=a & 1 << 26 > 0) for g, r, a in f] for f in found]
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("run", pa.int64()), ("at", pa.int64()), ("crowd", pa.bool_())]))
    batch = pa.RecordBatch.from_arrays([pa.array([9, 8, 7, 6]), pa.array(texts), pa.array(of, kind)], ["doc_id", "text", "found"])
    for part in (batch, batch.slice(1)):
        want = []
        for doc, text, runs in zip(*[part.column(c).to_pylist() for c in ("doc_id", "text", "found")]):
            for x in runs:
                start, n = x["at"] >> 26, x["at"] >> 16 & 31
                data = text.encode()[start : start + n + SD.LENGTH - 1]
                want.append({"gram": x["gram"], "run": x["run"], "doc": doc, "at": x["at"], "crowd": x["crowd"], "bytes": data})
        got = pa.Table.from_batches(list(SD._contexts([part])))
        assert got.to_pylist() == want
