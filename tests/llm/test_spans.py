"""Removed stretches of op7 against a byte mask, whatever the slices."""

import numpy as np
import pytest

from tidewindow.llm.suffix_dedup import LENGTH, REACH, spans_of


def loop_spans(places):
    covered = set()
    for p in places:
        for t in range(REACH):
            if p >> t & 1:
                covered |= set(range((p >> 27) + t, (p >> 27) + t + LENGTH))
    out = []
    for x in sorted(covered):
        if out and out[-1][1] == x:
            out[-1][1] = x + 1
        else:
            out.append([x, x + 1])
    return [tuple(s) for s in out]


@pytest.mark.parametrize("at_once", [1, 2, 7, 1 << 14])
@pytest.mark.parametrize("seed", range(8))
def test_spans_equal_a_byte_mask(at_once, seed):
    rng = np.random.default_rng(seed)
    starts = np.cumsum(rng.integers(1, 90, 60))
    masks = rng.integers(0, 1 << REACH, 60) & rng.integers(0, 1 << REACH, 60) * rng.integers(0, 2, 60)
    places = (starts << 27 | masks).tolist()
    # Out of order, repeated, and one run with two masks.
    places = [*rng.permutation(places).tolist(), places[3], int(starts[5]) << 27 | 1, int(starts[5]) << 27 | 1 << 26]
    a, b = spans_of(places, at_once)
    assert list(zip(a.tolist(), b.tolist())) == loop_spans(places)


def test_no_places_and_a_text_removed_whole():
    assert [x.tolist() for x in spans_of([])] == [[], []] and [x.tolist() for x in spans_of([5 << 27])] == [[], []]
    whole = (np.arange(0, 27 * 5000, 27) << 27) | ((1 << REACH) - 1)
    a, b = spans_of(whole, 16)
    assert (a.tolist(), b.tolist()) == ([0], [27 * 5000 + LENGTH - 1])
