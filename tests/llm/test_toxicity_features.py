from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from strandline.llm import toxicity


def test_every_feature_that_passes_is_fitted(monkeypatch):
    """20,000 features in toxic rows only, half of them rare."""
    n = 20_000
    f = np.arange(n)
    p = np.where(f % 2, 400, 30)
    counts = pa.table({"f": np.append(f, -1), "q": np.append(np.zeros(n, np.int64), 1000), "p": np.append(p, 500)})
    monkeypatch.setattr(toxicity, "_document_counts", lambda train: SimpleNamespace(toArrow=lambda: counts))
    rows = [f[i::10] if i < 10 else f[:0] for i in range(20)]
    sizes = np.append(0, np.cumsum([len(x) for x in rows]))
    monkeypatch.setattr(toxicity, "_sample", lambda *a: (np.concatenate(rows), sizes, (np.arange(20) < 10).astype(float)))
    assert (toxicity.fit(None, steps=5).weights[:n] > 0).all()


def test_blocks_give_the_same_products():
    r = np.random.default_rng(3)
    dense = r.random((50, 30)) < 0.2
    dense[7] = False
    col, bounds = np.nonzero(dense)[1].astype(np.int32), np.append(0, np.cumsum(dense.sum(axis=1)))
    ratio, w, e = r.normal(size=30), r.normal(size=30), r.normal(size=50)
    for block in (1, 17, 1 << 20):
        rows = toxicity._Rows(col, bounds, ratio, block)
        assert np.allclose(rows.times(w), dense * ratio @ w) and np.allclose(rows.transposed_times(e), (dense * ratio).T @ e)


def test_fit_reaches_the_optimum():
    """Against plain gradient descent on dense rows, run until it stands still; a row without features and unlike classes are there."""
    r = np.random.default_rng(8)
    dense = r.random((60, 12)) < 0.3
    dense[5] = False
    ratio, y = r.normal(size=12), (r.random(60) < 0.25).astype(float)
    weight, penalty = np.where(y > 0, 0.4 / y.sum(), 0.6 / (1 - y).sum()), 1e-2
    rows = toxicity._Rows(np.nonzero(dense)[1].astype(np.int32), np.append(0, np.cumsum(dense.sum(axis=1))), ratio)
    w, b = toxicity._descend(rows, y, weight, penalty, 200, 1e-9)
    x, matrix = np.zeros(13), np.column_stack([dense * ratio, np.ones(60)])
    for _ in range(50_000):
        x -= 0.5 * (matrix.T @ (weight * (1 / (1 + np.exp(-matrix @ x)) - y)) + penalty * np.append(x[:-1], 0))
    assert np.allclose(np.append(w, b), x, atol=1e-5)


def test_one_class_of_rows_and_no_features():
    none = toxicity._Rows(np.zeros(0, np.int32), np.zeros(5, np.int64), np.zeros(0))
    w, b = toxicity._descend(none, np.array([1.0, 0, 0, 0]), np.full(4, 0.25), 1e-4, 100, 1e-9)
    assert not len(w) and abs(b - np.log(1 / 3)) < 1e-6
