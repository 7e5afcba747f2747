"""The FM-index against brute force on random sequences."""

import numpy as np
import pytest

from keelson.llm.fmindex import FMIndex


def sequences(rng, count, sigma, longest):
    return [list(rng.integers(1, sigma, rng.integers(1, longest))) for _ in range(count)]


def joined(seqs):
    out = []
    for s in seqs:
        out += [int(x) for x in s] + [0]
    return np.array(out, dtype=np.int64)


@pytest.mark.parametrize("seed,sigma", [(0, 3), (1, 5), (2, 40), (3, 2)])
def test_search_and_locate(seed, sigma):
    rng = np.random.default_rng(seed)
    text = joined(sequences(rng, 20, sigma, 40))
    index = FMIndex(text, sigma, sample=4)
    patterns = [list(map(int, rng.integers(1, sigma, rng.integers(1, 6)))) for _ in range(60)]
    width = max(map(len, patterns))
    matrix = np.zeros((len(patterns), width), dtype=np.int64)
    for i, p in enumerate(patterns):
        matrix[i, width - len(p) :] = p
    lo, hi = index.search(matrix, np.array([len(p) for p in patterns]))
    for i, p in enumerate(patterns):
        want = [k for k in range(len(text) - len(p) + 1) if list(text[k : k + len(p)]) == p]
        assert sorted(index.locate(np.arange(lo[i], hi[i]))) == want


@pytest.mark.parametrize("seed,sigma,cap", [(0, 3, 5), (1, 2, 7), (2, 9, 3), (3, 3, 8), (4, 2, 50)])
def test_matching_statistics(seed, sigma, cap):
    rng = np.random.default_rng(seed)
    text = joined(sequences(rng, 15, sigma, 30))
    index = FMIndex(text, sigma, cap=cap)
    queries = sequences(rng, 12, sigma, 30)
    flat = np.concatenate([np.array(q, dtype=np.int64) for q in queries])
    ends = np.cumsum([len(q) for q in queries])
    starts = ends - np.array([len(q) for q in queries])
    size, row = index.matching_statistics(flat, starts, ends)
    where = index.locate(row)
    for s, e in zip(starts, ends):
        for i in range(s, e):
            want = 0
            while want < cap and i + want < e:
                p = list(flat[i : i + want + 1])
                if not any(list(text[k : k + len(p)]) == p for k in range(len(text) - len(p) + 1)):
                    break
                want += 1
            assert size[i] == want
            if want:
                assert list(text[where[i] : where[i] + want]) == list(flat[i : i + want])
