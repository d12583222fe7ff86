"""Conversation repair, fingerprints and collocations against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidewindow.llm import collocations, conversation_repair, fingerprints
from tidewindow.llm.queries import ORACLES, QUERIES

import checks

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"

# ---- conversations


def loop_edits(rows):
    """Cheapest (cost, audit, roles said) by a forward search over all edit texts of (initial, fault)."""
    moves = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})

    def inserted(now):
        grew = True
        while grew:
            grew = False
            for q, (cost, audit, said) in list(now.items()):
                for role in "ua":
                    if role in moves[q]:
                        new = (cost + 3, audit + "I", said + [(role, None)])
                        to = moves[q][role]
                        if to not in now or new[:2] < now[to][:2]:
                            now[to], grew = new, True
        return now

    now = inserted({0: (0, "", [])})
    for i, (initial, fault) in enumerate(rows):
        after = {}

        def offer(q, new):
            if q not in after or new[:2] < after[q][:2]:
                after[q] = new

        for q, (cost, audit, said) in now.items():
            offer(q, (cost + 4, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            if initial in moves[q]:
                offer(moves[q][initial], (cost + more, audit + "K", said + [(None, i)]))
            for role in "ua":
                if role in moves[q]:
                    offer(moves[q][role], (cost + 3 + more, audit + "R", said + [(role, i)]))
        now = inserted(after)
    return min((now[q] for q in (0, 3) if q in now), key=lambda x: x[:2])


def loop_repairs(table):
    out = {}
    rows_of = defaultdict(list)
    for conv, turn, role, text in table:
        rows_of.setdefault(conv, [])
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows_of[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, rows in rows_of.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, marks = set(), []
        for turn, role, text in rows:
            body = text.strip(BLANKS)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marks.append((role[:1], fault))
        turns = {t for t, *_ in rows if t is not None}
        cost, audit, said = loop_edits(marks)
        spoken = []
        for role, i in said:
            role = {"u": "user", "a": "assistant", None: i is not None and rows[i][1]}[role]
            spoken.append(f"{role}:{rows[i][2] if i is not None else ''}")
        faults = Counter(f for _, f in marks)
        pairs = [a + b for (a, _), (b, _) in zip(marks, marks[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(spoken).encode()).hexdigest(),
        )
    return out


def table_rows():
    rng = random.Random(5)
    texts = ["Yes.", "No", "Go on!", "", " \t", "What?", "Well, ", "Good. \n", None, "same.", "fin. ", "été?"]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "urgent"]
    rows = []
    for conv in range(400):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(roles) if rng.random() < 0.4 else roles[turn % 2]
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), role, rng.choice(texts) if rng.random() < 0.4 else f"t{turn}."))
    rows += rows[:40] + [(None, 1, "user", "a."), (None, None, "assistant", "b."), (900, None, None, None)]
    rows += [(901, t, ("user", "assistant")[rng.random() < 0.5], f"turn {t}.") for t in range(3000)]
    rows += [(902, t, "user", "ok.") for t in range(500)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, word string, fault int, header string, place int"


def test_repairs_against_a_search(spark):
    rows = table_rows()
    data = spark.createDataFrame([r + ("x", 1, "y", 2) for r in rows], SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(data).collect()}
    want = loop_repairs(rows)
    assert got == want
    assert {len(w[6]) for w in want.values()} > {0, 1, 2} and any("R" in w[6] and "I" in w[6] for w in want.values())


def test_repairs_of_an_empty_table_and_of_the_given_one(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.repair(empty).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, SF).collect()}
    assert got == loop_repairs(rows)


def test_a_conversation_that_lost_all_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = conversation_repair.repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_endings_are_shared():
    """Ordered by their reverse, the words make one node per distinct ending."""
    rng = random.Random(3)
    words = sorted({bytes(rng.choices(b"uaUAsx", k=rng.randrange(1, 12))) for _ in range(800)})
    path = conversation_repair.Ending()
    for w in words:
        path.turn_to(w)
    assert path.made == len({w[:i] for w in words for i in range(1, len(w) + 1)}) < sum(map(len, words))


# ---- fingerprints


def long_hash(seed, x):
    return xxhash.xxh64_intdigest((x & (2**64 - 1)).to_bytes(8, "little"), seed=seed)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def loop_shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]

    def chain(values):
        seed = 42
        for x in values:
            seed = long_hash(seed, x)
        return seed

    if not h:
        return set()
    if len(h) < 5:
        whole = 0
        for x in h:
            whole = chain([whole, x])
        return {signed(whole)}
    return {signed(chain(h[i : i + 5])) for i in range(len(h) - 4)}


def loop_likeness(a, b, k=128):
    a, b = sorted(a)[:k], sorted(b)[:k]
    union = sorted({*a, *b})[:k]
    return len({*a} & {*b} & {*union}) / len(union) if union else 1.0


def digits(a, k=128):
    return "".join(f"{x & (2**64 - 1):016x}" for x in sorted(a)[:k])


def loop_fingerprints(rows):
    """Rows (id, text); spark's signed text hash picks the row that stands for an id."""
    least = {}
    for doc, text in rows:
        mark = signed(xxhash.xxh64_intdigest((text or "").encode(), seed=42))
        least[doc] = min(least.get(doc, (mark, text or "")), (mark, text or ""))
    ids = sorted(least, key=lambda d: (d is None, d or 0))
    following = {d: least[e][1] for d, e in zip(ids, ids[1:] + ids[:1])}
    out = []
    for doc, text in rows:
        text, after = text or "", following[doc]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = map(loop_shingles, (text, edited, after))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((doc, len(text), digest, digits(a), digits(b), loop_likeness(a, b), loop_likeness(a, c)))
    return Counter(out)


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_fingerprints_against_a_loop(spark, documents, mixed_rows):
    rng = random.Random(9)
    rows = [r[:4] for r in mixed_rows] + [(100 + i, " ".join(rng.choices("ab cd ef gh".split(), k=rng.randrange(40))), "en", "a") for i in range(60)]
    got = fingerprints.fingerprints(documents(rows)).select(*COLUMNS).collect()
    assert Counter(tuple(r) for r in got) == loop_fingerprints([r[:2] for r in rows])
    assert fingerprints.fingerprints(documents([])).count() == 0
    alone = fingerprints.fingerprints(documents([(4, "one two three four five six", "en", "a")])).first()
    assert alone.near_next == 1.0 and alone.n_shingles == 2


def test_fingerprints_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_fingerprints"](spark, SF).select(*COLUMNS).collect()
    assert Counter(tuple(r) for r in got) == loop_fingerprints(rows)


def test_sketches_merge_and_estimate(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(9000)]
    a, b = " ".join(words[:6000]), " ".join(words[2000:9000])
    parts = [(1, " ".join(words[i : i + 504])) for i in range(0, 6000, 500)]
    parts = [(1, " ".join(words[i : min(i + 504, 6000)])) for i in range(0, 6000, 500)] + [(2, "")]
    sketched = spark.createDataFrame(parts, "k long, text string").select("k", fingerprints.sketch(F.col("text")).alias("sketch"))
    merged = {r.k: r.sketch for r in fingerprints.merged(sketched, ["k"]).collect()}
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    row = row.select(
        "a", fingerprints.resemblance(F.col("a"), F.col("b")).alias("near"), fingerprints.distinct_shingles(F.col("a")).alias("n"),
        fingerprints.containment(F.col("a"), F.col("b")).alias("within"),
    ).first()
    assert merged == {1: row.a, 2: []} and row.a == sorted(loop_shingles(a))[:128]
    assert abs(row.near - 4000 / 9000) < 0.13 and abs(row.n / 5996 - 1) < 0.3 and abs(row.within - 2 / 3) < 0.25


# ---- collocations


def loop_collocations(rows, least, shown):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang or "und"] += len(words)
            for i in range(len(words)):
                for m in range(1, min(5, len(words) - i) + 1):
                    f[lang or "und"][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        n, listed = total[lang], []
        candidates = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        longer = Counter()
        for q, b in candidates.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    longer[q[i : i + m]] = max(longer[q[i : i + m]], b)
        for p, a in candidates.items():
            inside = 100 * longer[p] >= 100 * a
            if not inside:
                cuts = [(1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                listed.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(listed)[:shown], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return Counter(out)


def phrase_rows(mixed_rows):
    rng = random.Random(12)
    rows = [r[:4] for r in mixed_rows]
    for i in range(120):
        parts = [" ".join(rng.choices("New york Old town été big \x00x de la".split(), k=rng.randrange(12))) for _ in range(6)]
        rows.append((500 + i, rng.choice([", ", ".\n", "\t", "; "]).join(parts), rng.choice(["en", "fr", None, "und"]), "a"))
    return rows + rows[-20:]


@pytest.mark.parametrize("trigger", [2, 32])
def test_collocations_against_a_loop(documents, mixed_rows, trigger):
    rows = phrase_rows(mixed_rows)
    got = collocations.collocations(documents(rows), least=6, shown=70, trigger=trigger).collect()
    want = loop_collocations(rows, 6, 70)
    assert Counter(tuple(r) for r in got) == want and len(want) > 150
    assert collocations.collocations(documents([])).count() == 0


def test_collocations_against_duckdb(spark):
    line = checks.compare(spark, "op13", QUERIES["op13_collocations"], ORACLES["op13_collocations"], SF, checks.connect(SF))
    assert line.startswith("OK"), line


@pytest.mark.parametrize("mix", [0xD6E8FEB86659FD93, 1 << 62])  # the second makes most hashes clash
def test_chunks_hold_each_phrase_once(monkeypatch, mix):
    monkeypatch.setattr(collocations, "MIX", np.uint64(mix))
    monkeypatch.setattr(collocations, "LONG", 300)
    monkeypatch.setattr(collocations, "BLOCK", 7)
    rng = random.Random(1)
    text = ".".join(" ".join(rng.choices("a b c d e".split(), k=n)) for n in (0, 1, 3, 5, 40, 300, 7, 11, 12))
    got, want = Counter(), Counter()
    rows = [(b"en", chunk, own, 1) for chunk, own in collocations.chunks(text.encode(), trigger=3)]
    block = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "chunk", "own", "freq"])
    every = np.full(1 << 20, -1, np.int64).view(np.uint64)
    for n in (1, 2, 3, 4, 5):
        found = collocations.tally(block if n < 3 else collocations.runs(block, every), n, every)
        for gram, f in zip(found["gram"].to_pylist(), found["f"].to_pylist()):
            got[gram] += f
    for piece in text.split("."):
        words = piece.split()
        for n in range(1, 6):
            want.update(" ".join(words[i : i + n]).encode() for i in range(len(words) - n + 1))
    assert got == want


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**14
    frequent = [("en", b"a b", 2, big), ("en", b"a", 1, big + 7), ("en", b"b", 1, big + 11)]
    rows = collocations.scored(
        spark.createDataFrame(frequent, "lang string, gram binary, words int, f long"), spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    ).collect()
    assert [r.score for r in rows] == [1000 * big * 9 * 10**15 // ((big + 7) * (big + 11))]
