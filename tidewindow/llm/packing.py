"""Cost-balanced packing of token sequences.

A document costs linear + quadratic * n (attention) per piece; in descending order every piece goes
to the sequence of lowest cost that still has room for it.  A document's whole multiples of the
capacity fill sequences of their own.  What finds no room is cut into the room that is left, so all
sequences of a batch but the last are full; the last is cut at powers of two, which need no padding.
A batch is a bounded number of tokens of one task: nothing is shuffled, and a hot source is many batches.

Defined cases: null text is empty text; an empty text is its end id alone; rows repeated under an
id are packed one by one; null ids stay null; an empty table gives no rows.
"""

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 2048
END = 1
VOCABULARY = "byte_bpe_50k"
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
BATCH_TOKENS = 1 << 21
BATCH_BITS = 33
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def piece_cost(n):
    return LINEAR * n + QUADRATIC * n * n


def plan(lengths, capacity: int = CAPACITY):
    """Rows (document, start, length, sequence, offset) as an array; every token lies in one row.

    ``lengths`` are token counts of one batch.  Sequences are numbered from 0.
    """
    lengths = np.asarray(lengths, np.int64)
    full, rest = lengths // capacity, lengths % capacity
    out = []
    doc = np.repeat(np.arange(len(lengths)), full)
    if len(doc):
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
        zero = np.zeros_like(doc)
        out.append(np.stack([doc, nth * capacity, zero + capacity, np.arange(len(doc)), zero], 1))
    base, total = len(doc), int(rest.sum())
    count = -(-total // capacity)
    if count:
        room = np.full(count, capacity, np.int64)
        room[-1] = total - (count - 1) * capacity  # the last one is as long as what remains
        size = room.copy()
        cost = np.zeros(count)
        rows, late = [], []

        def put(d, start, n, s):
            rows.append((d, start, n, base + s, size[s] - room[s]))
            room[s] -= n
            cost[s] += piece_cost(n)

        for d in np.argsort(-rest, kind="stable"):
            n = int(rest[d])
            if not n:
                break
            s = int(np.argmin(np.where(room >= n, cost, np.inf)))
            if room[s] >= n:
                put(d, full[d] * capacity, n, s)
            else:
                late.append((d, int(full[d] * capacity), n))
        order = np.argsort(cost, kind="stable")
        spare = [int(s) for s in order if room[s]]
        for d, start, n in late:
            while n:
                s = spare[-1]
                m = min(n, int(room[s]))
                put(d, start, m, s)
                start, n = start + m, n - m
                if not room[s]:
                    spare.pop()
        last = np.array(rows, np.int64)
        out.append(_cut_last(last, base + count - 1, int(size[-1]), capacity))
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


def _cut_last(rows, last: int, size: int, capacity: int):
    """Cut the last sequence at powers of two: 1300 tokens are 1024 + 256 + 16 + 4."""
    if size == capacity:
        return rows
    mine = rows[rows[:, 3] == last]
    mine = mine[np.argsort(mine[:, 4])]
    bounds = np.cumsum([0] + [1 << b for b in range(capacity.bit_length(), -1, -1) if size >> b & 1])
    cuts = np.union1d(bounds[:-1], mine[:, 4])
    of = np.searchsorted(mine[:, 4], cuts, "right") - 1
    part = np.searchsorted(bounds, cuts, "right") - 1
    length = np.diff(np.append(cuts, size))
    pieces = np.stack([mine[of, 0], mine[of, 1] + cuts - mine[of, 4], length, last + part, cuts - bounds[part]], 1)
    return np.concatenate([rows[rows[:, 3] != last], pieces])


def encoder(folder: str | None = None, vocabulary: str = VOCABULARY):
    """text -> ids of the public byte-level vocabulary, by its rank file (the same ids, in less time)."""
    import public_tokenizers as public
    import tiktoken

    path = f"{folder}/{vocabulary}.tiktoken" if folder else public.path(f"{vocabulary}.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    end = {"<|endoftext|>": len(ranks)}
    coder = tiktoken.Encoding("public", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=end)
    # With the library's defaults the end token's string in a text is that token.
    return lambda text: coder.encode(text, allowed_special="all") if "<|endoftext|>" in text else coder.encode_ordinary(text)


def _packer(folder, capacity, batch_tokens):
    def pack(batches):
        encode, part, done = encoder(folder), TaskContext.get().partitionId() << BATCH_BITS, 0
        ids, tokens, held = [], [], 0

        def packed(first):
            rows = plan([len(t) for t in tokens], capacity)
            crc = [zlib.crc32(tokens[d][s : s + n]) for d, s, n in rows[:, :3].tolist()]
            columns = [
                pa.array([ids[d] for d in rows[:, 0].tolist()], pa.int64()),
                pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(crc, pa.int64()),
                pa.array([len(tokens[d]) for d in rows[:, 0].tolist()], pa.int64()),
                pa.array(rows[:, 3] + part + first), pa.array(rows[:, 4]),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays(columns, names), int(rows[:, 3].max(initial=-1)) + 1

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = encode(text.as_py() or "")
                found.append(END)
                ids.append(doc_id)
                tokens.append(np.array(found, "<u4"))
                held += len(found)
                if held >= batch_tokens:
                    out, n = packed(done)
                    done += n
                    yield out
                    ids, tokens, held = [], [], 0
        if tokens:
            yield packed(done)[0]

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizers: str | None = None, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row per piece; a sequence belongs to one task, whose number is in the upper bits of its id."""
    return docs.select("doc_id", "text").mapInArrow(_packer(tokenizers, capacity, batch_tokens), PIECES)
