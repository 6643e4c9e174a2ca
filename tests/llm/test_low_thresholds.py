"""op10's tiles at thresholds whose linked sets differ in size by more than half."""

import numpy as np
import pytest

from flock.llm.jaccard_join import bands, tile_keys


@pytest.mark.parametrize("percent", range(50, 67))
def test_linked_sets_are_one_band_apart(percent):
    low = bands(percent)[:, 0]
    n = np.arange(1, 3000)
    assert (np.searchsorted(low, n * 100 // percent, "right") <= np.searchsorted(low, n, "right") + 1).all()


@pytest.mark.parametrize("percent", [50, 55, 60, 65, 66])
def test_contained_sets_share_a_tile(percent):
    rng = np.random.default_rng(percent)
    for n in [*range(2, 40), 61, 97, 250]:
        for _ in range(6):
            b = np.unique(rng.integers(0, 2**63, n * 100 // percent).astype(np.uint64))
            a = np.sort(rng.choice(b, n, replace=False))
            rows, tiles = tile_keys(np.concatenate([a, b]), np.array([0, n, n + len(b)]), percent)
            assert n == len(b) or set(tiles[rows == 0].tolist()) & set(tiles[rows == 1].tolist()), n
