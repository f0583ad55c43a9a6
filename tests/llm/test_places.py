"""Look-ups of the language model in one of many hash ranges."""

import numpy as np
import pytest

from carefold.llm import lmscore


class Counted(np.ndarray):
    """Counts how often it is looked into."""
    looks = 0

    def __getitem__(self, key):
        Counted.looks += 1
        return super().__getitem__(key)


@pytest.mark.parametrize("ranges", [1, 64, 4096, 1 << 30])
@pytest.mark.parametrize("which", [0, 0.5, 1])
def test_a_narrow_range_takes_as_few_steps_as_all_hashes(ranges, which):
    rng = np.random.default_rng(ranges)
    width = 2**64 // ranges
    low = int(which * (ranges - 1)) * width
    hashes = rng.integers(0, width - 1, 20_000, dtype=np.uint64, endpoint=True) + np.uint64(low)
    found = lmscore.distinct(hashes)
    Counted.looks = 0
    got = lmscore.places(found.view(Counted), hashes)
    assert (np.asarray(got) == np.searchsorted(found, hashes)).all()
    assert Counted.looks < 50


def test_places_at_the_ends():
    top = np.uint64(2**64 - 1)
    for found in ([0], [7], [0, top], [0, 1, 2], [top], [5, top]):
        found = np.array(found, np.uint64)
        assert (lmscore.places(found, found[::-1]) == np.arange(len(found))[::-1]).all()
