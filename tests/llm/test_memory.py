"""Arrays that tasks of the operators hold."""

import tracemalloc

import numpy as np
import pytest

from pairwell.llm import near_duplicates


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_repeated_tokens(n):
    tokens = np.random.default_rng(n).integers(0, max(1, n // 2), n).astype(np.uint64)
    names, times = np.unique(tokens, return_counts=True)
    found, counts = near_duplicates.repeated(tokens.copy())
    assert found.tolist() == names[times >= 3].tolist() and counts.tolist() == times[times >= 3].tolist()


def test_counting_tokens_holds_little_beside_them():
    tokens = np.random.default_rng(1).integers(0, 1 << 62, 1_000_000).astype(np.uint64)
    tracemalloc.start()
    near_duplicates.repeated(tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6  # np.unique took 33 MB
