"""Mixing, exact dedup, language ID, packing, licenses and toxicity against plain loops."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewindow.llm import exact_dedup, language_id, licenses, mixing, packing, toxicity
from tidewindow.llm.tokens import Vocabulary, Words

import pyarrow as pa

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def words_of(text):
    return SPLIT.findall(text or "")


def loop_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, cut = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in cut)
        open_ = [s for s in order if s not in cut]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in cut else level * weight[s] for s in order}
        cut |= above


def test_mixing_targets_and_copies(documents, mixed_rows):
    docs = documents(mixed_rows + [(100 + i, prose_line(i), "en", f"s{i % 4}") for i in range(400)])
    got = mixing.mix_sizes(docs).collect()
    sizes = defaultdict(int)
    by_id = {}
    for r in docs.collect():
        sizes[r.source] += len(words_of(r.text))
        by_id[r.doc_id] = (len(words_of(r.text)), r.source)
    want = loop_targets(sizes)
    assert len(got) == docs.count()
    taken = defaultdict(int)
    for r in got:
        if r.doc_id is not None:
            size, source = by_id[r.doc_id]
            assert r.size == size and r.source_size == sizes[source]
            assert r.target == pytest.approx(want[source])
            taken[source] += r.taken
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert sum({s: t for s, t in want.items()}.values()) == pytest.approx(sum(sizes.values()))
    for s in ("s0", "s1", "s2", "s3"):
        assert abs(taken[s] - want[s]) < 0.2 * want[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sizes(docs.repartition(5)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect() if r.doc_id is not None and by_id[r.doc_id][0])
    assert copies == Counter({k: n for k, n in Counter({r.doc_id: r.taken // r.size for r in got if r.size and r.doc_id not in (None, 7)}).items() if n}) + Counter({7: copies[7]})


def prose_line(i):
    return " ".join(f"w{(i * k) % 53}" for k in range(20 + i % 7))


def test_empty_tables(documents):
    docs = documents([])
    assert mixing.mix_sizes(docs).count() == mixing.mix(docs).count() == 0
    assert exact_dedup.dedup_decisions(docs).count() == exact_dedup.drop_copies(docs).count() == 0
    assert language_id.identify(docs).count() == language_id.keep_identified(docs).count() == 0
    assert packing.pack(docs).count() == licenses.scan_licenses(docs).count() == 0
    labels = documents([], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs, labels).count() == 0


def test_exact_dedup_against_a_loop(documents, mixed_rows):
    rows = mixed_rows + [(1000 + i, f"copy {i % 5}", None, None) for i in range(500)]
    docs = documents(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(-1 if r[0] is None else r[0])
    got = exact_dedup.dedup_decisions(docs).collect()
    assert len(got) == len(rows)
    stays = Counter()
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = groups[text]
        assert r.group_size == len(ids) and (-1 if r.keep_id is None else r.keep_id) == max(ids)
        assert not r.kept or r.doc_id == r.keep_id
        stays[text] += r.kept
    assert set(stays.values()) == {1} and len(stays) == len(groups)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text or "" for r in kept.collect()) == Counter(groups.keys())


def test_cuckoo_index_inserts_deletes_and_grows():
    index = exact_dedup.CuckooIndex(buckets=2)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, d in enumerate(digests):
        assert index.find(d) is None
        index.insert(d, [i])
    assert index.mask + 1 > 2 and all(index.find(d) == [i] for i, d in enumerate(digests))
    for d in digests[::2]:
        assert index.delete(d) and not index.delete(d)
    assert all((index.find(d) is None) == (i % 2 == 0) for i, d in enumerate(digests))
    left = sum(1 for x in index.table if x)
    assert left == len(index.content) == 1500
    # A false positive of the filter is caught by the stored content.
    forged = digests[1][:8] + bytes(24)
    assert index.may_hold(forged) and index.find(forged) is None


def test_index_changes(documents):
    first = documents([(i, f"t{i % 7}") for i in range(50)])
    index = exact_dedup.build_index(exact_dedup._entries(first, exact_dedup.F.lit(0)))
    changed = exact_dedup.change_index(index, documents([(90, "t1"), (91, "new")]), documents([(0, "t3"), (1, "absent")]))
    got = {bytes(r.digest): (r.keep_id, r.group_size) for r in changed.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    assert len(got) == 7 and sha("t3") not in got
    assert got[sha("t1")] == (90, 7 + 1) and got[sha("new")] == (91, 1)


LANGS = {"en": "the and of with that from this", "fr": "être été leçon élève après où", "de": "über straße mädchen größe für und"}


def test_language_of_held_out_texts(documents):
    rows, number = [], 0
    rng = np.random.default_rng(3)
    for _ in range(60):
        for lang, words in LANGS.items():
            number += 1
            rows.append((number, " ".join(rng.choice(words.split(), 30)), None if number % 10 == 0 else lang, "s"))
    docs = documents(rows + [(900, None, "en"), (901, "12 34", "fr"), (902, "", None), (None, rows[0][1], None)])
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[900].score == 0
    right = [got[n].lang_pred == list(LANGS)[(n - 1) % 3] for n in range(1, number + 1)]
    assert np.mean(right) > 0.98
    for n, r in got.items():
        if n is not None:
            assert r.held_out == (zlib.crc32(str(n).encode()) % 3 == 1) and 0 <= r.score <= 1
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == number + 1
    unlabelled = documents([(1, "abc"), (2, "12"), (3, None)])
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}
    assert [r.doc_id for r in language_id.keep_identified(unlabelled).collect()] == [1]


def test_code_lengths_are_the_tree_s():
    """The tables give what walking the context tree gives."""
    texts = {0: b"abracadabra abacus", 1: b"la la lalala bla"}
    counts = {}
    for lang, t in texts.items():
        grams = language_id.grams_of(np.concatenate([language_id.PAD, np.frombuffer(t, np.uint8)]))[3:]
        for g in grams.tolist():
            counts[lang, g] = counts.get((lang, g), 0) + 1
    keys = sorted(counts)
    model = language_id.Model(["x", "y"], tuple(np.array(c) for c in ([k[0] for k in keys], [k[1] for k in keys], [counts[k] for k in keys])))
    scorer = language_id.Scorer(model)

    def walk(lang, context, byte):
        for order in range(3, -1, -1):
            c = context[3 - order :]
            seen = Counter()
            padded = b"\n\n\n" + texts[lang]
            for i in range(3, len(padded)):
                if padded[i - order : i] == c:
                    seen[padded[i]] += 1
            n, d = sum(seen.values()), len(seen)
            if n:
                if byte in seen:
                    return -np.log2(seen[byte] / (n + d)) + walk.cost
                walk.cost += -np.log2(d / (n + d))
        return 8 + walk.cost

    probe = "abra la zulu"
    data, starts, ends = language_id.byte_rows(pa.array([probe, None, "b"]))
    got = scorer.lengths(data, starts, ends, chunk=5)
    padded = b"\n\n\n" + probe.encode()
    for lang in (0, 1):
        total = 0
        for i in range(3, len(padded)):
            walk.cost = 0
            total += walk(lang, padded[i - 3 : i], padded[i])
        assert got[0, lang] == pytest.approx(total, rel=1e-5)
    assert got[1].tolist() == [0, 0]


def check_pieces(pieces, lengths):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for d, start, n, s, offset in pieces:
        assert n > 0
        by_doc[d].append((start, n)), by_sequence[s].append((offset, n))
    for d, size in enumerate(lengths):
        at = 0
        for start, n in sorted(by_doc[d]):
            assert start == at
            at += n
        assert at == size
    padding = 0
    for rows in by_sequence.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding, {s: sum(packing.piece_cost(n) for _, n in rows) for s, rows in by_sequence.items()}


@pytest.mark.parametrize("lengths", [[1], [2048], [2047, 1], [5000, 1, 1, 1], [1300], [700] * 9, [3] * 3000, []])
def test_plan_covers_every_token_once(lengths):
    padding, _ = check_pieces(packing.plan(lengths).tolist(), lengths)
    assert padding == 0


def test_plan_balances_cost():
    lengths = np.random.default_rng(1).integers(1, 1500, 800)
    padding, costs = check_pieces(packing.plan(lengths).tolist(), lengths)
    plain = sum(packing.piece_cost(int(n)) for n in lengths) / len(costs)
    assert padding == 0 and np.std(list(costs.values())[:-9]) < 0.35 * plain


def test_packing_of_documents(documents, mixed_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = mixed_rows + [(50, "<|endoftext|> a <|endoftext|>"), (51, "don't  stop\n\n now'LL 3.14 …")]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = Counter()
    for r in rows:
        ids[r[0], tuple(coder.encode(r[1] or "", add_special_tokens=False).ids + [1])] += 1
    pieces = packing.pack(documents(rows), batch_tokens=20_000).collect()
    of = {(doc, len(t)): np.array(t, "<u4") for doc, t in ids}
    total = Counter()
    for p in pieces:
        t = of[p.doc_id, p.doc_tokens]
        assert zlib.crc32(t[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        total[p.doc_id, p.doc_tokens] += p.length
    assert total == Counter({(d, len(t)): n * len(t) for (d, t), n in ids.items()})
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for rows_ in by_sequence.values():
        rows_.sort()
        assert [o for o, _ in rows_] == np.cumsum([0] + [n for _, n in rows_])[:-1].tolist() and sum(rows_[-1]) <= 2048


LICENSED = [
    (1, "Released under the MIT License."), (2, "mit\nLicense, MIT-license and the Apache License, Version 2.0 of Apache license"),
    (3, "GNU General Public License general public licence"), (4, "license mit apache"), (5, None), (6, ""), (None, "MIT LICENSE"),
    (7, licenses.TEMPLATES["mit"].upper()), (8, licenses.TEMPLATES["bsd"].replace("binary", "other odd words")), (8, "mit license"),
    (9, "mitlicense émit license 1mit license"), (10, "of the of the and the to the"), (11, "mit license " * 3000),
]


def test_licenses_against_a_loop(documents):
    rows = [r + (None, None) for r in LICENSED]
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = Counter()
    for doc, text, *_ in rows:
        words = pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        at, names = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            at += here
            names |= {label} if here else set()
        want[doc, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names))] += 1
    got = licenses.scan_licenses(documents(rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    labels = {(r.doc_id, r.n_words): r.labels for r in got}
    assert labels[7, len(licenses.TEMPLATES["mit"].split())] == "mit" and "bsd" in labels[8, len(licenses.TEMPLATES["bsd"].split()) + 2]
    assert labels[10, 8] == ""


def test_every_template_yields_its_label(documents):
    names = list(licenses.TEMPLATES)
    rows = [(i, f"Zzz 2020. {licenses.TEMPLATES[n]}. qqq") for i, n in enumerate(names)] + [(99, "all rights, or rights reserved")]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(rows)).collect()}
    for i, name in enumerate(names):
        assert licenses.LABELS.get(name, name) in got[i].labels.split(",") and got[i].score == 1
    assert got[names.index("reserved")].labels == "reserved" and (got[99].labels, got[99].score) == ("", 0)


def test_automaton_matching_statistics():
    texts = [[1, 2, 3, 1, 2, 4], [2, 3, 5, 1], [7, 1, 2]]
    automaton = licenses.Automaton(texts)
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    rng = np.random.default_rng(5)
    for _ in range(50):
        read = rng.integers(1, 8, 30).tolist()
        state = length = 0
        for i, word in enumerate(read):
            state, length = automaton.step(state, length, word)
            assert length == max((n for n in range(1, 7) if tuple(read[max(0, i - n + 1) : i + 1]) in runs and n <= i + 1), default=0)
            run = read[i - length + 1 : i + 1]
            ends = {
                (number, end) for number, t in enumerate(texts) for end in range(length - 1, len(t)) if t[end - length + 1 : end + 1] == run
            }
            found = {(number, end) for number, places in automaton.ends[state].items() for end in places}
            assert length == 0 or found == ends


def _best_chain(matches, gap):
    """Most words of any chain, by trying every one."""

    def extend(last):
        s, p, n = last
        after = [m for m in matches if s + n <= m[0] <= s + n + gap and p + n <= m[1] <= p + n + gap]
        return n + max((extend(m) for m in after), default=0)

    return max((extend(m) for m in matches), default=0)


def test_license_chains_against_every_chain():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(6)]
    spans_seen = 0
    for _ in range(60):
        templates = {f"t{k}": " ".join(rng.choice(words, rng.integers(5, 14))) for k in range(3)}
        scanner = licenses.Scanner({"mit license": "mit"}, templates)
        text = []
        for _ in range(4):
            t = list(templates.values())[rng.integers(3)].split()
            cut = int(rng.integers(0, len(t)))
            text += t[:cut] + ["other"] * int(rng.integers(0, 3)) + t[cut:] + ["zzz"] * int(rng.integers(0, 12))
        plain = [t.split() for t in templates.values()]
        inside = lambda run: any(run == t[a : a + len(run)] for t in plain for a in range(len(t) - len(run) + 1))  # noqa: E731, B023
        longest = [max((n for n in range(1, i + 2) if inside(text[i - n + 1 : i + 1])), default=0) for i in range(len(text))]
        want = {}
        for i, n in enumerate(longest):
            if n and (i + 1 == len(text) or longest[i + 1] <= n):
                run = text[i - n + 1 : i + 1]
                for k, t in enumerate(plain):
                    if n >= min(licenses.LEAST, len(t)):
                        places = [a for a in range(len(t) - n + 1) if t[a : a + n] == run]
                        want.setdefault(k + 1, set()).update((i - n + 1, a, n) for a in places)
        _, found = scanner.matches(pa.array([" ".join(text)]))
        got = {k: set(v) for k, v in found[0][1].items()} if found else {}
        assert got == {k: v for k, v in want.items() if v}
        for number, runs in got.items():
            most, spans = scanner.chains(number, sorted(runs))
            assert most == _best_chain(runs, licenses.GAP)
            size = len(plain[number - 1])
            enough = lambda n: 2 * n >= size or n >= licenses.ENOUGH  # noqa: E731, B023
            assert all(enough(n) for *_, n in spans) and bool(spans) == enough(most)
            assert not spans or max(n for *_, n in spans) == most
            spans.sort()
            assert all(b < a for (_, b, _), (a, _, _) in zip(spans, spans[1:]))
            spans_seen += len(spans)
    assert spans_seen > 100


def test_license_spans_lie_where_the_notices_do(documents):
    t = licenses.TEMPLATES
    noisy = t["lgpl"].replace("gnu lesser general", "gnu lesser (general)").replace("warranty", "").replace("modify it", "modify it freely")
    rows = [
        (1, f"a b. {t['isc']} x y z {t['mpl']}"), (2, noisy), (3, f"{t['mit']} q r {t['mit']}"), (4, t["cc-by-sa"]), (5, "no notice"),
        (6, None), (7, ("word " * 50 + t["bsd"] + " ") * 300), (None, t["cc-by"]),
    ]
    docs = documents([r + (None, None) for r in rows])
    spans = {}
    for r in licenses.find_spans(docs).collect():
        if r.labels_text:
            spans.setdefault(r.doc_id, []).append((r.template, r.first_word, r.last_word, r.covered_words))
    n = {k: len(v.split()) for k, v in t.items()}
    assert sorted(spans[1], key=lambda x: x[1]) == [
        ("isc", 2, n["isc"] + 1, n["isc"]), ("mpl", n["isc"] + 5, n["isc"] + n["mpl"] + 4, n["mpl"])
    ]
    assert [s[0] for s in spans[2]] == ["lgpl"] and spans[2][0][3] == n["lgpl"]
    assert [s[1:3] for s in spans[3]] == [(0, n["mit"] - 1), (n["mit"] + 2, 2 * n["mit"] + 1)]
    assert {s[0] for s in spans[4]} == {"cc-by-sa"} and {s[0] for s in spans[None]} == {"cc-by"}
    assert len(spans[7]) == 300 and not {5, 6} & set(spans)
    labels = {r.doc_id: r.labels for r in licenses.scan_licenses(docs).collect()}
    assert labels == {1: "isc,mpl", 2: "lgpl", 3: "mit", 4: "cc-by-sa", 5: "", 6: "", 7: "bsd", None: "cc-by"} | {2: labels[2]}
    assert set(labels[2].split(",")) == {"gpl", "lgpl"} or labels[2] == "lgpl"


def test_vocabulary_finds_words_exactly():
    texts = ["Alpha alphabet alphabets, ALPHABETICAL alphabetically!", None, "", "é alphabeé 0alpha alphabeticaé", "a" * 40]
    vocabulary = Vocabulary([b"alpha", b"alphabet", b"alphabets", b"alphabetical", "é".encode(), b"a"])
    words = Words(pa.array(texts))
    got = vocabulary.find(words)
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    flat = [w.encode() for t in texts for w in pattern.findall((t or "").lower())]
    assert [vocabulary.words[i] if i >= 0 else None for i in got] == [w if w in vocabulary.words else None for w in flat]


def test_toxicity_is_learned_from_document_labels(documents):
    rng = np.random.default_rng(2)
    clean = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        sentences = [" ".join(rng.choice(clean, 8)) for _ in range(rng.integers(1, 9))]
        toxic = i % 6 == 0
        if toxic:
            sentences.insert(int(rng.integers(0, len(sentences) + 1)), f"{rng.choice(clean)} you grobb{'aeiou'[i % 5]}{i % 7} fool")
        rows.append((i, ". ".join(sentences) + ".", None, None))
        labels.append((i, 0, int(toxic)))
    labels += [(5000, 1, None), (None, 1, 1), (0, 1, 1)]
    docs = documents(rows + [(2000, None), (2001, ""), (None, "hello there"), (2002, "...")])
    marks = documents(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, marks).collect()}
    held = [r for n, r in got.items() if n is not None and n < 1200 and r.held_out]
    assert held and np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.97
    for n, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert n is None or r.held_out == (zlib.crc32(str(n).encode()) % 5 == 0)
    assert got[2000].score == got[2001].score == got[2002].score == 0
    model = toxicity.train(docs, marks)
    bad = toxicity.offending_sentences(docs.where("doc_id < 60"), model).collect()
    assert {r.doc_id for r in bad} == set(range(0, 60, 6)) and all("grobb" in r.sentence for r in bad)
    text = {r[0]: r[1] for r in rows}
    assert all(text[r.doc_id].encode()[r.start : r.end].decode() == r.sentence for r in bad)


def test_one_label_teaches_nothing(documents):
    docs = documents([(1, "a b"), (2, "c")])
    marks = documents([(1, 0, 1)], "doc_id long, quality int, toxic int")
    assert all(r.score < 1e-9 for r in toxicity.score_toxicity(docs, marks).collect())
