"""Trained trees as arrays: scoring by any prefix of them, and exact tree-path Shapley values.

A model's nodes are read from its saved form (a few kilobytes a tree, bounded by the depth and
number of trees) and travel with the tasks; rows are scored and explained in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from panelstack.session import drop_path, scratch_path


@dataclass
class Tree:
    """Nodes by number, the root first; ``feature`` is -1 in a leaf; rows with x <= threshold go left; ``value`` is (nodes, outputs)."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            here = at[rows]
            rows, here = rows[self.feature[here] >= 0], here[self.feature[here] >= 0]
            goes = x[rows, self.feature[here]] <= self.threshold[here]
            at[rows] = np.where(goes, self.left[here], self.right[here])
        return at

    def leaves(self) -> Iterator[tuple[int, list[tuple[int, bool, float]]]]:
        """Each leaf with its path: (node, goes left, share of the node's cover that goes on)."""
        stack: list[tuple[int, list]] = [(0, [])]
        while stack:
            node, path = stack.pop()
            if self.feature[node] < 0:
                yield node, path
                continue
            for child, goes in ((self.left[node], True), (self.right[node], False)):
                stack.append((int(child), [*path, (node, goes, self.cover[child] / self.cover[node])]))


@dataclass
class Trees:
    """A sum of trees: output = base + sum of scale * value of the row's leaf."""

    features: list[str]
    trees: list[Tree]
    scale: list[float]
    base: np.ndarray
    labels: list[int] = field(default_factory=list)

    def raw(self, x: np.ndarray, first: int | None = None) -> np.ndarray:
        """(rows, outputs) of the first trees (all by default); a mean of trees has to be rescaled by the caller."""
        out = np.tile(self.base.astype(float), (len(x), 1))
        for t, s in zip(self.trees[:first], self.scale[:first]):
            out += s * t.value[t.leaf_of(x)]
        return out

    def expected(self) -> np.ndarray:
        """Output when no feature is known: leaves weighed by their cover."""
        out = self.base.astype(float).copy()
        for t, s in zip(self.trees, self.scale):
            leaf = t.feature < 0
            out += s * (t.cover[leaf] / t.cover[0]) @ t.value[leaf]
        return out

    def shapley(self, x: np.ndarray, output: int = 0) -> np.ndarray:
        """(rows, features): path-dependent Shapley values of one output."""
        out = np.zeros((len(x), len(self.features)))
        for t, s in zip(self.trees, self.scale):
            _add_tree(out, t, x, s * t.value[:, output])
        return out


def _add_tree(out: np.ndarray, tree: Tree, x: np.ndarray, value: np.ndarray) -> None:
    """Add one tree's Shapley values.

    A leaf plays a game of its own: the features on its path, each known (the row passes all its splits, 1 or 0) or
    unknown (the cover's share passes).  Rows that pass the same features share the result, so the
    subset polynomial is formed once for each pattern that occurs.
    """
    inner = np.flatnonzero(tree.feature >= 0)
    goes = np.zeros((len(tree.feature), len(x)), bool)
    goes[inner] = (x[:, tree.feature[inner]] <= tree.threshold[inner]).T
    for leaf, path in tree.leaves():
        if not path or value[leaf] == 0.0:
            continue
        share: dict[int, float] = {}
        passes: dict[int, np.ndarray] = {}
        for node, left, part in path:
            f = int(tree.feature[node])
            ok = goes[node] if left else ~goes[node]
            share[f] = share.get(f, 1.0) * part
            passes[f] = passes[f] & ok if f in passes else ok
        fs = list(share)
        code = np.zeros(len(x), np.int64)
        for k, f in enumerate(fs):
            code |= passes[f].astype(np.int64) << k
        seen, at = np.unique(code, return_inverse=True)
        known = (seen[:, None] >> np.arange(len(fs))) & 1 == 1
        part = value[leaf] * game(np.array([share[f] for f in fs]), known)
        for k, f in enumerate(fs):
            out[:, f] += part[at, k]


def game(share: np.ndarray, known: np.ndarray) -> np.ndarray:
    """(patterns, players) Shapley values of the product game: a known player counts 1 or 0, an unknown one its share.

    Subsets are summed by size: the coefficients of prod_k (share_k + known_k t), with one player's factor divided out.
    """
    n, m = known.shape
    poly = np.zeros((n, m + 1))
    poly[:, 0] = 1.0
    for k in range(m):
        grown = poly * share[k]
        grown[:, 1:] += poly[:, :-1] * known[:, k:k + 1]
        poly = grown
    weight = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
    out = np.zeros((n, m))
    for k in range(m):
        # Without player k: by synthetic division where it is known, by its share where it is not.
        rest, carry = np.zeros((n, m)), np.zeros(n)
        for s in range(m - 1, -1, -1):
            carry = poly[:, s + 1] - share[k] * carry
            rest[:, s] = np.where(known[:, k], carry, poly[:, s] / share[k])
        out[:, k] = rest @ weight * (known[:, k] - share[k])
    return out


def read_trees(spark: SparkSession, model: PipelineModel, features: list[str]) -> Trees:
    """The trees of a fitted pipeline's last stage: a tree, a forest (mean; for classes the mean class shares) or a boosted regressor."""
    last = model.stages[-1]
    path = scratch_path(spark, "trees")
    last.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    else:
        nodes = nodes.selectExpr("0 AS treeID", "*")
    pdf = nodes.selectExpr("treeID", "id", "prediction", "impurityStats", "rawCount", "leftChild", "rightChild", "split.featureIndex AS feature",
                           "split.leftCategoriesOrThreshold AS cut", "split.numCategories AS categories").orderBy("treeID", "id").toPandas()
    drop_path(spark, path)
    if (pdf.categories > 0).any():
        raise ValueError("categorical splits are not supported")
    classes = int(getattr(last, "numClasses", 0) or 0)
    trees = []
    for _, t in pdf.groupby("treeID", sort=True):
        if classes:
            stats = np.stack(t.impurityStats.to_numpy()).astype(float)
            value = stats / stats.sum(axis=1, keepdims=True)
        else:
            value = t.prediction.to_numpy()[:, None]
        trees.append(Tree(t.feature.to_numpy(np.int64), np.array([c[0] if len(c) else np.nan for c in t.cut]), t.leftChild.to_numpy(np.int64), t.rightChild.to_numpy(np.int64),
                          value, t.rawCount.to_numpy(float)))
    weights = [float(w) for w in last.treeWeights] if hasattr(last, "treeWeights") else [1.0]
    boosted = type(last).__name__.startswith("GBT")
    scale = weights if boosted else [w / sum(weights) for w in weights]
    return Trees(features, trees, scale, np.zeros(max(1, classes)))


def _matrix(pdf: pd.DataFrame, features: list[str]) -> np.ndarray:
    x = pdf[features].to_numpy(float)
    if np.isnan(x).any():
        raise ValueError(f"missing values in {[f for f in features if pdf[f].isna().any()]}: fill them first")
    return x


def tree_contributions(df: DataFrame, id_cols: list[str], trees: Trees, output: int = 0) -> DataFrame:
    """Long (ids, prediction, feature, value, contribution, base) of one output; base + sum(contributions) = prediction.

    The columns are those of :func:`linear_contributions`, so summaries and top rows work on both.  Missing
    features are an error, as in the models.
    """
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in id_cols) + ", prediction double, feature string, value double, contribution double, base double"
    base, n = float(trees.expected()[output]), len(trees.features)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf, trees.features)
            phi = trees.shapley(x, output)
            out = pdf[id_cols].loc[pdf.index.repeat(n)].reset_index(drop=True)
            out["prediction"] = np.repeat(trees.raw(x)[:, output], n)
            out["feature"], out["value"], out["contribution"], out["base"] = trees.features * len(x), x.ravel(), phi.ravel(), base
            yield out

    return df.select(*id_cols, *[c for c in trees.features if c not in id_cols]).mapInPandas(run, schema)
