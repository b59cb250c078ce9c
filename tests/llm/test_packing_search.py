"""The index of the packing search against a walk over all bins."""

import time

import numpy as np
import pytest

from tessera.llm.packing import Rests, _leaving, least_bins, pack


def walk(bins, n, fill, size):
    """The largest gain of a move or exchange of a piece of n, by trying all."""
    best = 0
    for full, pieces in bins.values():
        outs = [0, *pieces, *(x + y for i, x in enumerate(pieces) for y in pieces[i + 1 :])]
        for out in outs:
            d = n - out
            if d > 0 and full + d <= size:
                best = max(best, (full + d) ** 2 + (fill - d) ** 2 - full**2 - fill**2)
    return best


def test_best_place_equals_a_walk():
    rng = np.random.default_rng(3)
    size = 60
    for _ in range(40):
        rests, bins = Rests(size), {}
        for b in range(int(rng.integers(1, 12))):
            pieces = [int(x) for x in rng.integers(1, 12, int(rng.integers(1, 6)))]
            bins[b] = (sum(pieces), pieces)
            rests.add(b, sum(pieces), pieces)
        for b in [b for b in bins if rng.random() < 0.3]:
            rests.remove(b)
            del bins[b]
        for n in range(1, 40):
            fill = n + int(rng.integers(0, size - n))
            got, best = rests.best(n, fill), walk(bins, n, fill, size)
            if got is None:
                assert best <= 0
                continue
            full, pieces = bins[got[0]]
            d = got[1] + n - full
            assert (full + d) ** 2 + (fill - d) ** 2 - full**2 - fill**2 == best
            out = _leaving(list(range(len(pieces))), np.array(pieces), full - got[1])
            assert sum(pieces[j] for j in out) == full - got[1] and len(out) <= 2


@pytest.mark.parametrize("low, high", [(1100, 1101), (300, 1400), (640, 1300), (1, 9)])
def test_large_groups_are_quick_and_whole(low, high):
    lengths = np.random.default_rng(low).integers(low, high, 20_000)
    since = time.process_time()
    bins = pack(lengths, 2048)
    assert time.process_time() - since < 30
    assert sorted(i for b in bins for i in b) == list(range(20_000)) and max(int(lengths[b].sum()) for b in bins) <= 2048
    assert least_bins(lengths, 2048) <= len(bins)
