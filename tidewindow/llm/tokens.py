"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Word bytes: digits, letters and everything outside ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
KEY_BYTES = 16
GAP = 32  # the byte between texts; no word byte, no sentence end


def text_bytes(column):
    """(lower-cased bytes with a space after every text, offset of every text and of the end)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(int(bounds[-1]), GAP, np.uint8)
    own = np.ones(len(out), bool)
    own[bounds[1:] - 1] = False
    out[own] = LOWER[data]
    return out, bounds


def slices(batch, column: str = "text", most: int = 4 << 20):
    """A record batch in parts of bounded text (a single text may be longer)."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


class Words:
    """starts, sizes and text number of all words; key() packs their first bytes exactly."""

    def __init__(self, column):
        self.data, self.bounds = text_bytes(column)
        word = WORD[self.data]
        edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.starts = np.flatnonzero(edge == 1)
        self.sizes = np.flatnonzero(edge == -1) - self.starts
        self.first = np.searchsorted(self.starts, self.bounds)  # first word of every text, and the count
        self.text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.first))
        padded = np.concatenate([self.data, np.zeros(KEY_BYTES, np.uint8)])
        self._eight = [np.ascontiguousarray(padded[i : i + 8 * ((len(padded) - i) // 8)]).view("<u8") for i in range(8)]

    def _pack(self, at, sizes):
        """The first min(size, 8) bytes from each place as a number."""
        out = np.zeros(len(at), np.uint64)
        for i in range(8):
            mine = np.flatnonzero(at & 7 == i)
            out[mine] = self._eight[i][at[mine] >> 3]
        keep = np.minimum(sizes, 8).astype(np.uint64) * np.uint64(8)
        mask = np.where(sizes >= 8, ~np.uint64(0), (np.uint64(1) << np.minimum(keep, np.uint64(63))) - np.uint64(1))
        return out & mask

    def low(self):
        return self._pack(self.starts, self.sizes)

    def high(self, which):
        return self._pack(self.starts[which] + 8, self.sizes[which] - 8)


def packed(word: bytes):
    return int.from_bytes(word[:8], "little"), int.from_bytes(word[8:KEY_BYTES], "little"), len(word)


class Vocabulary:
    """Numbers of known words (at most KEY_BYTES bytes each), found exactly."""

    def __init__(self, words):
        self.words = sorted(set(words))
        if any(len(w) > KEY_BYTES or not w for w in self.words):
            raise ValueError(f"words have 1 to {KEY_BYTES} bytes")
        self.short = self._table([(packed(w)[0], i) for i, w in enumerate(self.words) if len(w) <= 8])
        self.long = self._table([(packed(w)[0], packed(w)[1], i) for i, w in enumerate(self.words) if len(w) > 8])

    @staticmethod
    def _table(rows):
        rows.sort()
        width = len(rows[0]) if rows else 2
        return [np.array([r[j] for r in rows], np.uint64 if j < width - 1 else np.int64) for j in range(width)]

    def find(self, words: Words):
        """The number of each word, or -1.  A word of up to 8 bytes has no zero byte, so its key is its own."""
        out = np.full(len(words.starts), -1, np.int64)
        low, sizes = words.low(), words.sizes
        keys, numbers = self.short[0], self.short[-1]
        if len(keys):
            mine = np.flatnonzero(sizes <= 8)
            at = np.minimum(np.searchsorted(keys, low[mine]), len(keys) - 1)
            out[mine] = np.where(keys[at] == low[mine], numbers[at], -1)
        if len(self.long) == 3 and len(self.long[0]):
            keys, ends, numbers = self.long
            mine = np.flatnonzero((sizes > 8) & (sizes <= KEY_BYTES))
            at = np.searchsorted(keys, low[mine])
            mine, at = mine[at < len(keys)], at[at < len(keys)]
            same = keys[at] == low[mine]
            mine, at = mine[same], at[same]
            high = words.high(mine)
            while len(mine):  # words that share their first 8 bytes stand together
                hit = ends[at] == high
                out[mine[hit]] = numbers[at[hit]]
                more = ~hit & (at + 1 < len(keys))
                mine, at, high = mine[more], at[more] + 1, high[more]
                same = keys[at] == low[mine]
                mine, at, high = mine[same], at[same], high[same]
        return out
