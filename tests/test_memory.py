"""Steps whose memory must not grow with the tables."""

import tracemalloc

import numpy as np

from siltstone.operators import vectors as V


def test_products_are_taken_in_bounded_pieces():
    rng = np.random.default_rng(1)
    rows, asks = rng.normal(size=(8192, 4)), rng.normal(size=(2048, 4))
    tracemalloc.start()
    got = V._scored(np.arange(2048) + 10_000, asks, np.arange(8192), rows, 2, -1.0, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 2 * 2048 and peak < 64 << 20  # one product of all would be 128 MB



def test_embeddings_leave_python_as_packed_numbers():
    import pandas as pd

    got = V._embed.func(pd.Series([["a", "b"], []]))
    assert all(isinstance(x, np.ndarray) and x.dtype == np.float64 and len(x) == 512 for x in got)
    assert got[0].tolist() == V.hashed_embedding(["a", "b"])
