import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstack.operators.explain import contribution_summary
from panelstack.operators.learn import boosted_regressor, decision_tree_regressor, random_forest_classifier, random_forest_regressor
from panelstack.operators.trees import game, read_trees, tree_contributions

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    x = r.integers(0, 9, (600, 4)).astype(float)
    y = x[:, 0] * 2 + np.where(x[:, 1] > 4, x[:, 2], -x[:, 2]) + r.standard_normal(600)
    data = [(i, *map(float, v), float(t), float(t > 8) + float(t > 14)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, d double, y double, k double").persist()


def expectation(tree, x, known, node=0):
    """The tree's output where only ``known`` features follow the row, by plain recursion."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = int(tree.left[node]), int(tree.right[node])
    if f in known:
        return expectation(tree, x, known, left if x[f] <= tree.threshold[node] else right)
    return (tree.cover[left] * expectation(tree, x, known, left) + tree.cover[right] * expectation(tree, x, known, right)) / tree.cover[node]


def by_subsets(trees, x, output):
    n = len(x)
    phi = np.zeros(n)
    value = {s: sum(w * expectation(t, x, s)[output] for t, w in zip(trees.trees, trees.scale, strict=True)) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
    for s, v in value.items():
        for j in set(range(n)) - set(s):
            w = math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n)
            phi[j] += w * (value[tuple(sorted((*s, j)))] - v)
    return phi


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted", "classifier"])
def test_contributions_equal_subsets_and_add_up(spark, rows, kind):
    model = {"tree": lambda: decision_tree_regressor(rows, FEATURES, "y", 4, 5), "forest": lambda: random_forest_regressor(rows, FEATURES, "y", trees=5, max_depth=4),
             "boosted": lambda: boosted_regressor(rows, FEATURES, "y", maxIter=4, maxDepth=3), "classifier": lambda: random_forest_classifier(rows, FEATURES, "k", trees=4, max_depth=4)}[kind]()
    output = 2 if kind == "classifier" else 0
    trees = read_trees(spark, model, FEATURES)
    found = tree_contributions(rows, ["id"], trees, output).collect()
    mine = {}
    for r in found:
        mine.setdefault(r.id, []).append(r)
    scored = {r.id: (r.probability[output] if kind == "classifier" else r.prediction) for r in model.transform(rows).collect()}
    assert len(mine) == 600
    for i, parts in mine.items():
        assert [p.feature for p in parts] == FEATURES
        assert parts[0].prediction == pytest.approx(scored[i], abs=1e-9)
        assert parts[0].base + sum(p.contribution for p in parts) == pytest.approx(scored[i], abs=1e-9)
    for i in range(0, 600, 60):
        x = np.array([p.value for p in mine[i]])
        assert [p.contribution for p in mine[i]] == pytest.approx(by_subsets(trees, x, output).tolist(), abs=1e-9)


def test_summary_and_missing_values(spark, rows):
    trees = read_trees(spark, decision_tree_regressor(rows, FEATURES, "y", 3, 5), FEATURES)
    top = contribution_summary(tree_contributions(rows, ["id"], trees)).collect()
    assert top[0].feature in ("a", "c") and [r["rank"] for r in top] == [1, 2, 3, 4]
    assert tree_contributions(rows.limit(0), ["id"], trees).count() == 0
    with pytest.raises(Exception, match="missing values"):
        tree_contributions(rows.withColumn("a", F.lit(None).cast("double")), ["id"], trees).collect()


def test_game_of_many_players():
    r = np.random.default_rng(0)
    share, known = r.uniform(0.05, 1, 7), r.integers(0, 2, (10, 7)).astype(bool)
    got = game(share, known)
    total = known.all(axis=1) - share.prod()
    assert got.sum(axis=1) == pytest.approx(total.tolist(), abs=1e-12)
