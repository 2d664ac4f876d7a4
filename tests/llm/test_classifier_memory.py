"""The classifier takes a batch apart a few rows at a time."""

import numpy as np
import pyarrow as pa

from atollkit.llm import quality


def test_a_batch_is_taken_in_small_runs(monkeypatch):
    made, plain = [], quality._features
    monkeypatch.setattr(quality, "_features", lambda rows: made.append(sum(map(len, rows)) + 1024 * len(rows)) or plain(rows))
    texts = [f"word {i} " * (i % 400) for i in range(3000)]
    x = np.concatenate(list(quality.column_runs(pa.array(texts))))
    assert max(made) <= quality.RUN + max(map(len, texts)) + 1024 and len(x) == len(texts)
    assert np.allclose(x, plain([t.encode() for t in texts]), atol=1e-6)
    assert not list(quality.column_runs(pa.array([], pa.string())))
