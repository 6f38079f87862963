import numpy as np
import pytest

from panelstack.operators.boost import _drawn, boost, Settings, score_boosted, softmax

FEATURES = ["a", "b"]


def data(n=400):
    r = np.random.default_rng(3)
    x = r.integers(0, 12, (n, 2)).astype(float)
    k = np.where(x[:, 0] + r.integers(0, 4, n) > 9, 2, np.where(x[:, 1] > 6, 1, 0))
    return x, k, r.choice([0.5, 1.0, 2.0], n), r.random(n) < 0.25


def frame(spark, x, y, w, held, parts=3):
    rows = [(i, *map(float, v), float(t), float(u), bool(h)) for i, (v, t, u, h) in enumerate(zip(x, y, w, held, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, w double, held boolean").repartition(parts)


def plain(x, g, h, depth, least, l1, l2, step):
    """One tree by trying every threshold of every node; returns what it adds to each row."""
    out = np.zeros(len(x))

    def soft(v):
        return np.sign(v) * max(abs(v) - l1, 0)

    def grow(rows, level):
        total = soft(g[rows].sum()) ** 2 / (h[rows].sum() + l2)
        best = (1e-12, None)
        for f in range(x.shape[1]):
            for cut in sorted(set(x[:, f]))[:-1]:
                low = rows[x[rows, f] <= cut]
                high = rows[x[rows, f] > cut]
                if min(len(low), len(high)) < least or min(h[low].sum(), h[high].sum()) < 1.0:
                    continue
                gain = soft(g[low].sum()) ** 2 / (h[low].sum() + l2) + soft(g[high].sum()) ** 2 / (h[high].sum() + l2) - total
                if gain > best[0] + 1e-12:
                    best = (gain, (low, high))
        if level == depth or best[1] is None:
            out[rows] = -step * soft(g[rows].sum()) / (h[rows].sum() + l2)
        else:
            for part in best[1]:
                grow(part, level + 1)

    grow(np.arange(len(x)), 0)
    return out


@pytest.mark.parametrize("l1", [0.0, 0.7])
def test_softmax_rounds_equal_plain_boosting(spark, l1):
    x, k, w, _ = data()
    model = boost(frame(spark, x, k, w, np.zeros(len(x), bool)), FEATURES, "y", weight_col="w", rounds=4, max_depth=3, step=0.3, min_leaf=5, l1=l1, l2=0.5)
    margin = np.tile(np.log(np.array([w[k == c].sum() for c in range(3)]) / w.sum()), (len(x), 1))
    for _ in range(4):
        p = softmax(margin)
        margin = margin + np.column_stack([plain(x, w * (p[:, c] - (k == c)), w * 2 * p[:, c] * (1 - p[:, c]), 3, 5, l1, 0.5, 0.3) for c in range(3)])
    assert model.labels == [0.0, 1.0, 2.0] and len(model.trees.trees) == 12
    assert model.probabilities(x) == pytest.approx(softmax(margin), abs=1e-9)
    got = {r.id: r for r in score_boosted(frame(spark, x, k, w, np.zeros(len(x), bool)), model, ["id"], digits=6).collect()}
    assert [got[i].predicted_class for i in range(len(x))] == margin.argmax(axis=1).tolist()
    assert [got[i].class_confidence for i in range(len(x))] == pytest.approx((softmax(margin).max(axis=1) * 100).tolist(), abs=1e-5)
    # Fewer rounds of the same model are the model of fewer rounds.
    two = boost(frame(spark, x, k, w, np.zeros(len(x), bool)), FEATURES, "y", weight_col="w", rounds=2, max_depth=3, step=0.3, min_leaf=5, l1=l1, l2=0.5)
    assert model.probabilities(x, 2) == pytest.approx(two.probabilities(x), abs=1e-12)


def test_squared_loss_stops_early_and_samples_alike(spark):
    x, k, w, held = data(600)
    y = 3.0 * x[:, 0] + np.random.default_rng(1).standard_normal(600) * 6
    args = dict(objective="squared", validation_col="held", patience=5, rounds=60, max_depth=3, step=0.3, row_share=0.7, col_share=0.5, min_leaf=3, min_hessian=0.0)
    one = boost(frame(spark, x, y, w, held, 1), FEATURES, "y", **args)
    many = boost(frame(spark, x, y, w, held, 5), FEATURES, "y", **args)
    assert one.trees.raw(x) == pytest.approx(many.trees.raw(x), abs=1e-9)
    best = int(np.argmin(one.losses))
    assert len(one.trees.trees) == best < 60 and len(one.losses) - 1 - best >= 5
    # The recorded loss is the loss of the kept trees on the held rows.
    assert one.losses[best] == pytest.approx(((one.trees.raw(x[held])[:, 0] - y[held]) ** 2).mean())
    assert one.losses[0] == pytest.approx(((y[held] - y[~held].mean()) ** 2).mean())
    u = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 20_000)
    assert abs(_drawn(u, 3, Settings(row_share=0.7)).mean() - 0.7) < 0.02


def test_leaf_budget_and_missing_values(spark):
    x, k, w, held = data()
    model = boost(frame(spark, x, k, w, held), FEATURES, "y", rounds=2, max_depth=10, max_leaves=4, min_hessian=0.0)
    assert max(int((t.feature < 0).sum()) for t in model.trees.trees) == 4
    with pytest.raises(Exception, match="missing values"):
        boost(frame(spark, x, k, w, held).selectExpr("CAST(NULL AS DOUBLE) AS a", "b", "y"), FEATURES, "y", rounds=1)
