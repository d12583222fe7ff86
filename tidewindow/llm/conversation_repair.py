"""Conversation repair through one suffix-shared automaton over all conversations.

A row's symbol is its role's class with its fault; a conversation is the word of its symbols.  The
distinct words are ordered by their reverse and dealt into ranges, so that words which share an
ending stand together.  Walking them, a stack holds the nodes of the current ending from the last
row backwards: a node is made once for all words through it, with the cost-to-go and the best edit
of each grammar state.  From a grammar state every edit letter leads to one place, so the least
letter among the cheapest is the ASCII-least audit, and a word's audit is read off its own nodes.

Memory: a task holds one word (a byte a row) and its nodes; texts stream in order of their
conversation and are hashed as they pass.  The hash of one conversation is a chain, so it is the
work of one task however long the conversation is; its faults are found by groupings that split.

Defined cases: null ids, roles and texts count as one space in the damage key, the role and the
text; rows of one turn stand by role, then by the SHA-256 of their text, after damage; null turns
come first; conversations of null id are one; an empty role has an initial that no edit keeps;
a conversation without rows after damage has zeros and an empty audit; an empty table gives no rows;
other columns are not read.
"""

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewindow.sources.staging import stage

VISIBLE = r"[^\x20\x09-\x0D]"
FINISHED = r"[.!?][\x20\x09-\x0D]*\z"
DAMAGES = 20

REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
# The grammar (s?(ua)+)?: state -> initial -> state.  A conversation may end in 0 or 3.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
GONE = ord("x")  # blank and duplicate rows: one symbol, since they can only be deleted
STATES = len(GRAMMAR)
FAR = 1 << 40


def _settle(cost, letter):
    """Let insertions carry cost-to-go from state to state; I yields to D and wins over K and R."""
    for _ in range(STATES):
        for q, moves in enumerate(GRAMMAR):
            for initial, to in moves.items():
                if initial in ROLES:
                    c = INSERT + cost[to]
                    if c < cost[q] or (c == cost[q] and letter[q] > "I"):
                        cost[q], letter[q] = c, "I"
    return tuple(cost), "".join(letter)


@lru_cache(None)
def ending():
    return _settle([0 if q in ENDS else FAR for q in range(STATES)], [" "] * STATES)


@lru_cache(1 << 16)
def step(symbol: int, after: tuple):
    """Cost-to-go and best letter per grammar state before a row of ``symbol``, given those after it."""
    if symbol == GONE:
        return _settle([DELETE + c for c in after], ["D"] * STATES)
    initial = chr(symbol).lower()
    short = CUT_SHORT if chr(symbol).isupper() else 0
    cost, letter = [], []
    for q, moves in enumerate(GRAMMAR):
        ways = [(DELETE + after[q], "D")]
        if initial in moves:
            ways.append((short + after[moves[initial]], "K"))
        ways += [(REROLE + short + after[to], "R") for i, to in moves.items() if i in ROLES]
        best = min(ways)
        cost.append(best[0])
        letter.append(best[1])
    return _settle(cost, letter)


class Ending:
    """The automaton's path for the current word, from its end; common endings keep their nodes."""

    def __init__(self):
        self.word, self.nodes, self.made = b"", [(*ending(), 0)], 0

    def turn_to(self, word: bytes):
        """``word`` reversed; returns nothing, leaves one node per ending in ``nodes``."""
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[shared] == self.word[shared]:
            shared += 1
        del self.nodes[shared + 1 :]
        for symbol in word[shared:]:
            cost, letters, base = self.nodes[-1]
            cost, letters = step(symbol, cost)
            low = min(cost)  # nodes hold costs above their least, so that few kinds of nodes recur
            self.nodes.append((tuple(c - low for c in cost), letters, base + low))
            self.made += 1
        self.word = word

    def audit(self):
        """(cost, letters) of the whole word from the grammar's start."""
        cost, _, base = self.nodes[-1]
        out, q, at = [], 0, len(self.word)
        while True:
            letter = self.nodes[at][1][q]
            if letter == " ":
                return base + cost[0], "".join(out)
            out.append(letter)
            if letter == "I" or letter == "R":
                q = next(to for initial, to in GRAMMAR[q].items() if initial in ROLES)
            elif letter == "K":
                q = GRAMMAR[q][chr(self.word[at - 1]).lower()]
            at -= letter != "I"


def _audits(batches):
    path = Ending()
    for batch in batches:
        costs, audits = [], []
        for word in batch.column("word").to_pylist():
            path.turn_to(word)
            cost, audit = path.audit()
            costs.append(cost)
            audits.append(audit)
        yield pa.RecordBatch.from_arrays(
            [batch.column("word"), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["word", "cost", "audit"]
        )


def audits(words: DataFrame) -> DataFrame:
    """(word, cost, audit) of distinct reversed words (binary column ``word``)."""
    ordered = words.distinct().repartitionByRange("word").sortWithinPartitions("word")
    return ordered.mapInArrow(_audits, "word binary, cost long, audit string")


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the table's rows as they are after damage; 0 copies are gone."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % DAMAGES
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def faults(damaged: DataFrame) -> DataFrame:
    """(conv_id, turn, role, mark, n, symbol, fault): equal rows of a turn as one, with their number.

    ``fault`` is that of the first of them; every other of the n is a duplicate unless blank.
    """
    blank = ~F.col("text").rlike(VISIBLE)
    fault = F.when(blank, "blank").when(~F.col("text").rlike(FINISHED), "truncated").otherwise("")
    light = damaged.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("mark"), fault.alias("fault"), "copies")
    light = light.groupBy("conv_id", "turn", "role", "mark", "fault").agg(F.sum("copies").alias("n"))
    # Where a role and text come back in many turns, the join splits them; the first turn is one row.
    turn = F.when(F.col("n") > 0, F.struct("turn"))
    keys = [F.col(c).alias(f"of_{c}") for c in ("conv_id", "role", "mark")]
    first = light.where("fault != 'blank'").groupBy(*keys).agg(F.min(turn).alias("first"))
    same = F.expr("conv_id <=> of_conv_id AND role = of_role AND mark = of_mark")
    own = F.expr("fault = 'blank' OR turn <=> first.turn")
    fault = F.when(own, F.col("fault")).otherwise("duplicate").alias("fault")
    return light.join(first, same, "left").select("conv_id", "turn", "role", "mark", "n", fault)


class _Tally:
    def __init__(self, conv):
        self.conv, self.word = conv, bytearray()
        self.least = self.most = self.turn = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None

    def add(self, turn, role, n, fault):
        if turn is not None and turn != self.turn:
            self.distinct += 1
            self.turn = turn
            self.least = turn if self.least is None else self.least
            self.most = turn
        initial = role[:1]
        pair = self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.illegal += pair + (n - 1)  # a role beside itself is never legal
        self.before = initial
        live = 0
        if fault == "blank":
            self.blank += n
        elif fault == "duplicate":
            self.duplicate += n
        else:
            live = 1
            self.duplicate += n - 1
            self.truncated += fault == "truncated"
            symbol = initial if initial in ("s", "u", "a") else "o"
            self.word.append(ord(symbol.upper() if fault else symbol))
        self.word.extend(bytes([GONE]) * (n - live))

    def row(self):
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, bytes(self.word[::-1])


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, word binary"
SUMMARY_TYPES = [pa.int64()] * 6 + [pa.binary()]


def _summaries(batches):
    """Rows come in order of their conversation; one conversation is tallied at a time."""
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    now = None
    for batch in batches:
        done = []
        for conv, turn, role, n, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "n", "fault"))):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row())
                now = _Tally(conv)
            if n:
                now.add(turn, role, n, fault)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), SUMMARY_TYPES)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.row(), SUMMARY_TYPES)], names)


ORDER = ("conv_id", "turn", "role", "mark")  # ascending, nulls first


class _Repair:
    """One conversation's rows and audit, as they stream by."""

    def __init__(self, header):
        self.header, self.letters = header, header["audit"]
        self.at, self.state, self.first = 0, 0, True
        self.hash = hashlib.sha256()

    def _say(self, role, text):
        self.hash.update((("" if self.first else "\n") + role + ":").encode())
        self.hash.update(text)
        self.first = False
        self.state = GRAMMAR[self.state][role[0]]

    def _next_role(self):
        return ROLES[next(i for i in GRAMMAR[self.state] if i in ROLES)]

    def insertions(self):
        while self.letters[self.at : self.at + 1] == "I":
            self._say(self._next_role(), b"")
            self.at += 1

    def row(self, role, text):
        self.insertions()
        letter = self.letters[self.at]
        self.at += 1
        if letter != "D":
            self._say(role if letter == "K" else self._next_role(), text)

    def digest(self):
        self.insertions()
        return self.hash.hexdigest()


OUTCOME = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repairs(batches):
    names = [x.split()[0] for x in OUTCOME.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def rows(done):
        columns = [[r.header[c] for r in done] for c in names[:-1]] + [[r.digest() for r in done]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    now = None
    for batch in batches:
        done = []
        columns = [batch.column(c).to_pylist() for c in ("header", "role", "n")]
        for i, (header, role, n) in enumerate(zip(*columns)):
            if header is not None:
                if now is not None:
                    done.append(now)
                now = _Repair(header)
                continue
            text = batch.column("text")[i].as_py()
            for _ in range(n):
                now.row(role, text)
        if done:
            yield rows(done)
    if now is not None:
        yield rows([now])


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits, and the hash of what they leave."""
    damaged = damage(conversations)
    ordered = faults(damaged).repartition("conv_id").sortWithinPartitions(*ORDER)
    counts = stage(ordered.select("conv_id", "turn", "role", "n", "fault").mapInArrow(_summaries, SUMMARY))
    found = audits(counts.select("word"))
    headers = counts.join(found, "word").select(
        "conv_id", F.struct("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").alias("header")
    )
    texts = damaged.where("copies > 0").select(
        "conv_id", F.lit(1).alias("place"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("mark"),
        F.col("text").cast("binary").alias("text"), F.col("copies").alias("n"),
    )
    rows = headers.withColumn("place", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place", *ORDER[1:])
    return rows.select("header", "role", "text", "n").mapInArrow(_repairs, OUTCOME)
