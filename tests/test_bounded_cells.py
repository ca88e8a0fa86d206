"""Memory of encoders and cells does not grow with the batch or the tables."""

import numpy as np

from shotsmith.operators.blocks import CELL_BLOCKS, TopRows, grid_shape, tiles, topk_rows
from shotsmith.operators.embed import ENCODE_CHARS, PooledEncoder


class Recording:
    """A token encoder that notes the characters of each call."""
    calls: list[int] = []

    def load(self):
        def tokens(texts):
            self.calls.append(sum(map(len, texts)))
            return [(np.full((2, 3), float(len(t))), np.ones(2)) for t in texts]
        return tokens


def test_pooled_encoder_holds_token_vectors_of_a_slice():
    texts = ["x" * 1000] * 400 + ["", "y" * (ENCODE_CHARS + 5), "z"]
    got = PooledEncoder(Recording()).load()(texts)
    assert [v[0] for v in got] == [float(len(t)) for t in texts]
    assert max(Recording.calls) == ENCODE_CHARS + 5 and sorted(Recording.calls)[-2] <= ENCODE_CHARS


def test_cell_sides_are_bounded():
    for n in (10_000, 1_000_000, 50_000_000):
        rows, cols = grid_shape(n, n, 12, 5, 2048)
        assert n / rows <= CELL_BLOCKS * 2048 and n / cols <= CELL_BLOCKS * 2048
        assert rows * cols >= 36


def test_top_rows_tile_by_tile():
    """Ties, copies, NaN, repeated ids: the rows of one sort over all scores."""
    rng = np.random.default_rng(8)
    for trial in range(40):
        n, m, k = int(rng.integers(1, 20)), int(rng.integers(1, 40)), int(rng.integers(1, 7))
        s = rng.integers(-3, 4, size=(n, m)) / 3.0 if trial % 3 else rng.normal(size=(n, m)) * 1e-5
        s[rng.random(s.shape) < 0.1] = np.nan
        q_ids, p_ids = rng.integers(0, 12, n), np.sort(rng.integers(0, 12, m))
        best = TopRows(q_ids, p_ids, k, trial % 2 == 0)
        for p_at in tiles(m, 7):
            for q_at in tiles(n, 5):
                best.offer(q_at, p_at, s[np.ix_(q_at, p_at)].copy())
        want = topk_rows(s, q_ids, p_ids, k, trial % 2 == 0)
        assert best.frame().values.tolist() == want.values.tolist()
