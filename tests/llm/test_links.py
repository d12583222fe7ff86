"""SimHash, components, repeated strings, top-k, archives and the pipeline against plain loops."""

import hashlib
import io
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewindow.llm import components, mixing, simhash, suffix_dedup, topk, warc
from tidewindow.llm.queries import ORACLES, QUERIES

import checks

SF = "/root/testdata/sf0.001"


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(500, 500 + i) for i in range(1, 300)] + [(9, 9), (3, 2), (2, 3)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(-5, 40)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = roots({n for e in edges for n in e}, edges)
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def bits_of(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_rows(mixed_rows):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [r[:4] for r in mixed_rows]
    for i in range(60):
        words = list(base)
        words[rng.randrange(300)] = f"x{i}"
        rows.append((2000 + i, " ".join(words), "en", "n"))
    return rows


@pytest.mark.parametrize("block", [4, 2048])
def test_simhash_against_all_pairs(documents, mixed_rows, block):
    rows = near_rows(mixed_rows)
    got = simhash.near_components(documents(rows), block).withColumn("hex", simhash.hex_digits("fp")).collect()
    prints = {}
    for doc, text, *_ in rows:
        prints.setdefault(bits_of(text), []).append(doc)
    distinct = sorted(prints)
    edges = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 4]
    root = roots(distinct, edges)
    least = defaultdict(list)
    for p in distinct:
        least[root[p]] += [d for d in prints[p] if d is not None]
    want = Counter((doc, f"{bits_of(text):016x}", min(least[root[bits_of(text)]], default=None)) for doc, text, *_ in rows)
    assert Counter((r.doc_id, r.hex, r.component_id) for r in got) == want
    assert len(edges) > 100


def test_one_document_of_each_component_stays(documents, mixed_rows):
    """Also where ids are null or stand on several texts, and where rows are repeated whole."""
    base = [f"k{i}" for i in range(300)]
    near = [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in (5, 90, 200)]
    far = [" ".join([*(f"z{j}" for j in range(300))][:i] + ["changed"]) for i in (290, 299)]
    rows = near_rows(mixed_rows) + [(None, t, "en", "n") for t in near] + [(7000, t, "en", "n") for t in far] + [(7000, far[1], "en", "n")]
    docs = documents(rows)
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    prints = sorted({bits_of(t) for _, t, *_ in rows})
    root = roots(prints, [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 4])
    ids, stay = defaultdict(list), Counter()
    for doc, text, *_ in rows:
        ids[root[bits_of(text)]].append(doc)
    for r in kept.collect():
        of = root[bits_of(r.text)]
        stay[of] += 1
        assert r.doc_id == min((d for d in ids[of] if d is not None), default=None)
    assert stay == Counter(dict.fromkeys(root.values(), 1)) and any(set(v) == {None} for v in ids.values())
    empty = documents([])
    assert simhash.one_per_component(empty).count() == simhash.near_components(empty).count() == 0


INSIDE = "_source _rate _copy _of _digest _keep _same _drop _mark _letters _lang _score _text _best _id other0".split()


def test_stages_leave_columns_of_any_name_alone(spark, documents, mixed_rows):
    import corpus_pipeline

    docs = documents([r[:4] for r in mixed_rows] + [(20 + i, f"These are the words of text number {i}, plainly.", "en", "a") for i in range(9)])
    docs = docs.select("doc_id", "text", "lang", "source", *[F.concat(F.lit(f"{c}:"), F.coalesce("text", F.lit("-"))).alias(c) for c in INSIDE])
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, SF)
        rows = out.collect()
        assert out.columns == docs.columns and rows, name
        assert all(r[c] == f"{c}:{'-' if r.text is None else r.text}" for r in rows for c in INSIDE), name


def test_both_mixes_draw_alike_without_ids(documents):
    docs = documents([(None, f"text {i} " + "word " * (9 + i % 4), "en", f"s{i % 5}") for i in range(120)])
    taken = mixing.mix(docs).select(F.sum(mixing.words_in(F.col("text")))).first()[0]
    assert taken == mixing.mix_sizes(docs).agg(F.sum("taken")).first()[0] > 0


def test_forest_joins_each_group_s_near_rows():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 30, np.uint64)
    fp = base[rng.integers(0, 30, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    group = np.sort(rng.integers(0, 12, 400))
    a, b = simhash.forest(group, fp)
    edges = [(i, j) for i in range(400) for j in range(i) if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= 4]
    assert roots(range(400), zip(a.tolist(), b.tolist())) == roots(range(400), edges) and len(a) < len(edges)


def loop_repeats(rows):
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        for i in range(len(data) - 49):
            first.setdefault(data[i : i + 50], doc)
    out = Counter()
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49) if doc is not None else ():
            if first[data[i : i + 50]] < doc:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def repeat_rows(mixed_rows):
    rng = random.Random(11)
    line = "This very common line stands in many of the documents, always the same."
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    noise = lambda n: "".join(rng.choice("klmnopqrstuv ") for _ in range(n))
    rows = [(r[0], r[1]) for r in mixed_rows]
    rows += [(100 + i, noise(rng.randrange(90)) + line + noise(rng.randrange(90))) for i in range(60)]
    rows += [(300 + i, noise(30) + passage[rng.randrange(200) : rng.randrange(200, 400)] + noise(30)) for i in range(60)]
    rows += [(400, "a" * 300), (401, "ba" + "a" * 120), (402, "ab" * 90), (403, "ab" * 30 + "a" * 60), (404, "a" * 50), (405, "a" * 49)]
    rows += [(406, "né" * 40), (407, "xé" * 3 + "né" * 30), (500, passage), (500, line + line), (500, passage)]
    return rows


@pytest.mark.parametrize("crowd", [3, 2000])
def test_repeated_strings_against_a_loop(documents, mixed_rows, crowd):
    rows = repeat_rows(mixed_rows)
    got = suffix_dedup.cut_repeats(documents(rows), crowd).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == loop_repeats(rows)


def test_repeats_of_an_empty_table(documents):
    assert suffix_dedup.cut_repeats(documents([])).count() == 0


def test_suffix_sort_is_lexicographic():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(300)] + [b"a" * 20, b"a" * 20]
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = end - np.array([len(t) for t in texts])
    group = np.sort(np.array([rng.randrange(9) for _ in texts]))
    order = suffix_dedup.Suffixes(data, start, end, group).order
    assert [(group[i], texts[i]) for i in order] == sorted((group[i], t) for i, t in enumerate(texts))


def test_runs_cut_long_arrays_alike(monkeypatch):
    rng = np.random.default_rng(9)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    bounds = np.array([0, 10, 1200, 1200, 1249, 5000])

    def strings(found):
        gram, _, text, start, offset, n = found
        return {(int(t), int(s) + i, int(g), int(o) - i) for g, t, s, o, k in zip(gram, text, start, offset, n) for i in range(k)}

    whole = strings(suffix_dedup.runs_of(data, bounds))
    assert len(whole) == sum(max(0, b - a - 49) for a, b in zip(bounds, bounds[1:]))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 333)
    assert strings(suffix_dedup.runs_of(data, bounds)) == whole


def vectors(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(120)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8)]
    rows += [(2003, [float("inf")] * 8), (2100, [1.0, 2.0]), (2200, []), (None, [1.0] * 8), (300, [9.0] * 8), (2300, [1e6] * 8)]
    return rows, spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, rank int, score string")


def loop_top(rows, k=10):
    taken = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for i, q in taken:
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in taken if j != i)[:k]
            for rank, (s, j) in enumerate(scores, 1):
                out[i, rank, j, -s] += 1
    return out


@pytest.mark.parametrize("sizes", [dict(pivots=5, block=16, queries=3), dict()])
def test_top_k_is_exact(spark, sizes):
    rows, df = vectors(spark)
    got = topk.top_k(df, topk.F.col("vec_id") % 100 == 0, **sizes)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, got.collect())) == loop_top(rows)


def test_top_k_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], schema)
    assert [tuple(r) for r in topk.top_k(few, topk.F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 2, 3 * 1024**2), (0, 2, 1, 2 * 1024**2)]
    assert topk.top_k(spark.createDataFrame([], schema), topk.F.col("vec_id") == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema), topk.F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("copies", (2, 12))
def test_top_k_of_a_repeated_query(spark, copies):
    rows = [(0, [100.0])] * copies + [(i, [float(i)]) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, topk.F.col("vec_id") == 0, pivots=1)  # one annulus
    want = Counter({(0, r, 31 - r, (31 - r) * 100 * 1024**2): copies for r in range(1, 11)})
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("size", (1e2, 1e5, 5e5))
def test_top_k_of_large_components(spark, size):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=8) * size).tolist()) for i in range(300)] + [(900, [size] * 8), (901, [size] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, topk.F.col("vec_id") % 100 == 0, pivots=7, block=32)
    assert Counter(map(tuple, got.collect())) == loop_top(rows)


def test_scores_beyond_a_long_are_refused(spark):
    ask = lambda rows: topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), topk.F.col("vec_id") == 0)
    with pytest.raises(Exception, match="does not fit a long"):
        ask([(0, [1e14, 1.0]), (1, [1e14, 1.0])]).collect()
    with pytest.raises(Exception, match="component times 1024 does not fit"):
        ask([(0, [1e17]), (1, [1.0])]).collect()
    # The query's own score is none, parts of a sum may wrap, and the very edge still fits.
    rows = [(0, [1e9, 1e9]), (1, [1.0, 1.0]), (2, [1e9, -1e9])]
    assert Counter(map(tuple, ask(rows).collect())) == loop_top(rows)
    a, b = np.array([[2**62, 2**31]]), np.array([[-2, 0], [2, 0], [1, 2**31]])
    topk.refuse_overflow(a, b[:1], np.zeros((1, 1), bool))
    for row in (b[1:2], b[2:]):
        with pytest.raises(OverflowError):
            topk.refuse_overflow(a, row, np.zeros((1, 1), bool))


PAGES = "page_id long, url string, html string, kept string, bytes long"


def page_rows():
    long = "<p>é</p>" * 200
    return [
        (1, "http://a\r\nX: y", long), (5, "u", long), (3, None, long), (None, "u", long), (7, "v", None), (8, "v", ""), (9, "v", "short"),
        (10, "v", "short"), (11, "w", "z" * 999), (12, "w", "z" * 999), (13, "w", "z" * 1000), (14, "w", "z" * 1000), (14, "w", "z" * 1000),
        (15, "x", "\r\n\r\n" * 500), (16, "x", "0123456789" * 300_000), (None, "y", "q" * 2000), (None, "y", "q" * 2000),
    ]


def test_archives_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame([r + ("k", 1) for r in rows], PAGES).repartition(3)
    got = warc.read_archives(warc.write_archives(pages), with_payload=True).collect()
    groups = defaultdict(list)
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            groups[data].append(i)
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        keep = max(groups[data], default=None)
        revisit = keep is not None and i != keep
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    for r in got:
        assert r.record_type == "revisit" or hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    empty = warc.write_archives(spark.createDataFrame([], PAGES))
    assert empty.count() == 0 and warc.read_archives(empty).count() == 0


def test_damaged_archives_are_refused():
    import gzip

    record = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").digest(), False, None)
    good = gzip.compress(record)
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(good + good))] == [1, 1]
    for bad in (record.replace(b"payload", b"Payload"), record.replace(b"Length: 87", b"Length: 86"), record[:-3]):
        if bad != record:
            with pytest.raises(ValueError):
                list(warc.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(Exception):
        list(warc.read_records(io.BytesIO(good[:-20])))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_statements(spark, name):
    line = checks.compare(spark, name, QUERIES[name], ORACLES[name], SF, checks.connect(SF))
    assert line.startswith("OK"), line


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline_stages_take_effect(spark, documents, mixed_rows):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, []
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(function(spark, docs, SF))
        assert docs.columns == columns
        texts.append([(r.doc_id, r.text) for r in docs.collect()])
    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert set(texts[0]) == {x for x in source if x[1] and any(c.isalpha() for c in x[1])}
    last = {}
    for doc, text in texts[0]:
        last[text] = max(doc, last.get(text, doc))
    assert sorted(texts[1]) == sorted((d, t) for t, d in last.items())
    prints = {d: bits_of(t) for d, t in texts[1]}
    ids = sorted(prints)
    root = roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert sorted(d for d, _ in texts[2]) == sorted({d for d in ids if root[d] == d})
    assert set(texts[3]) <= set(texts[2])
    pieces = corpus_pipeline.run(spark, SF).collect()
    tokens = Counter()
    for p in pieces:
        tokens[p.doc_id, p.doc_tokens] += p.length
    copies = Counter(d for d, _ in texts[3])
    assert {d: n // size for (d, size), n in tokens.items()} == dict(copies)
