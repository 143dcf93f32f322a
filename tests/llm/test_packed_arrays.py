"""Arrays of op8 as they travel: byte planes by zstd."""

import zlib

import numpy as np
import pytest
from lodestrata.llm import lm_scoring as lm


@pytest.mark.parametrize("top", [0, 1, 255, 256, (1 << 24) + 5, (1 << 32) - 1, 1 << 32, (1 << 64) - 1])
@pytest.mark.parametrize("many", [0, 1, 50, 5000])
def test_numbers_come_back(top, many):
    x = np.random.default_rng(many).integers(0, top, many, np.uint64, endpoint=True)
    x[:1] = top
    assert np.array_equal(lm._from_planes(lm._planes(x)), x)
    x.sort()
    assert np.array_equal(lm._from_ascending(lm._ascending(x)), x)
    if top < 1 << 63:
        assert np.array_equal(lm._counts(lm._planes(x.astype(np.int64))), x.astype(np.int64))


def test_probabilities_come_back():
    p = np.random.default_rng(1).random(3000).astype(np.float32)
    assert np.array_equal(lm._from_real(lm._real(p)), p)


def test_only_bytes_that_numbers_have_travel():
    rng = np.random.default_rng(2)
    x = np.minimum(rng.zipf(1.3, 100_000), 60_000)
    assert len(lm._planes(x)) < len(zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1))
    assert len(lm._planes(np.arange(100))) == 1 + 4 + 100  # short arrays are not compressed
