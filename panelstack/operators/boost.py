"""Gradient-boosted trees from distributed histograms: softmax over all classes in one model, or squared loss.

Rows are binned once and kept as blocks.  A level of all of a round's trees costs one job: every task
adds up gradient, hessian and rows by (class, node, feature, bin), the sums are added on the executors, and the
driver, which sees (nodes x features x bins) numbers whatever the rows, picks the splits.  Every row's margins
are carried from round to round, so a round costs the same at any age, early stopping needs no second fit, and
probabilities come out of the model.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstack.operators.quantiles import order_statistics
from panelstack.operators.trees import Tree, Trees, _matrix
from panelstack.session import ensure_checkpoint_dir, materialize

#: Rows of a block; bins of a feature; rounds between cuts of the margins' lineage.
BLOCK_ROWS, BINS, CUT_EVERY = 1 << 16, 64, 25

# The three class boosters.  Leaf-wise growth is taken level by level: the best gains first, up to so many leaves.
CLASS_PRESETS = {
    "xgb": {"rounds": 300, "step": 0.1, "max_depth": 6, "max_leaves": None, "min_leaf": 1, "l2": 1.0, "min_hessian": 1.0},
    "lgb": {"rounds": 300, "step": 0.05, "max_depth": 10, "max_leaves": 31, "min_leaf": 20, "l2": 0.0, "min_hessian": 1e-3},
    "lgb_tuned": {"rounds": 300, "step": 0.01, "max_depth": 30, "max_leaves": 15, "min_leaf": 10, "l2": 0.0, "min_hessian": 1e-3},
}
# The two regression boosters.
REGRESSION_PRESETS = {
    "lgb": {"rounds": 500, "step": 0.05, "max_depth": 6, "max_leaves": 31, "min_leaf": 20, "min_hessian": 1e-3, "l1": 0.1, "l2": 0.1, "row_share": 0.8, "col_share": 0.8},
    "xgb": {"rounds": 500, "step": 0.05, "max_depth": 6, "max_leaves": None, "min_leaf": 1, "min_hessian": 20.0, "l1": 0.1, "l2": 0.1, "row_share": 0.8, "col_share": 0.8},
}


@dataclass
class Settings:
    rounds: int = 300
    step: float = 0.1
    max_depth: int = 6
    max_leaves: int | None = None
    min_leaf: int = 1
    min_hessian: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    row_share: float = 1.0
    col_share: float = 1.0
    seed: int = 42


@dataclass
class Boosted:
    """The trees (of each round one a class), the classes, and the loss on the validation rows after each round."""

    trees: Trees
    labels: list
    losses: list[float] = field(default_factory=list)

    def probabilities(self, x: np.ndarray, rounds: int | None = None) -> np.ndarray:
        return softmax(self.trees.raw(x, None if rounds is None else rounds * len(self.labels)))


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_points(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Thresholds of each feature: the midpoints between neighbouring quantiles that differ (exact order statistics)."""
    probs = [i / bins for i in range(bins + 1)]
    stats = order_statistics(df, features, probs)
    out = []
    for f in features:
        seen = np.unique([stats.around[(f, p)][1] for p in probs] if stats.n.get(f) else [])
        out.append((seen[1:] + seen[:-1]) / 2)
    return out


def _blocks(features: list[str], cuts: list[np.ndarray]):
    """Function for mapInArrow: blocks of binned rows."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(f).to_numpy(zero_copy_only=False) for f in features]).astype(float)
            if np.isnan(x).any():
                raise ValueError("missing values in the features: fill them first")
            binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]).astype(np.uint8 if max(map(len, cuts)) < 256 else np.uint16)
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_w", "_u", "_held")]
            blobs = [pickle.dumps((binned[i:i + BLOCK_ROWS], *[c[i:i + BLOCK_ROWS] for c in cols])) for i in range(0, len(x), BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], names=["blob"])

    return run


class Growing:
    """A tree of one class while it grows; thresholds are bin numbers: a row goes left where its bin is at most that."""

    def __init__(self, total: tuple[float, float, float]):
        self.feature, self.cut, self.left, self.right = [-1], [0], [-1], [-1]
        self.sums = [total]
        self.open = [0]

    def arrays(self):
        return np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.right)

    def split(self, node: int, feature: int, cut: int, low: tuple, high: tuple) -> None:
        n = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, n, n + 1
        for s in (low, high):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(-1)
            self.right.append(-1)
            self.sums.append(s)
        self.open += [n, n + 1]


def _walk(arrays, binned: np.ndarray) -> np.ndarray:
    feature, cut, left, right = arrays
    at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
    while len(rows):
        here = at[rows]
        inner = feature[here] >= 0
        rows, here = rows[inner], here[inner]
        at[rows] = np.where(binned[rows, feature[here]] <= cut[here], left[here], right[here])
    return at


def _gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    if not classes:
        return w[:, None] * (margin - y[:, None]), w[:, None].astype(float)
    p = softmax(margin)
    return w[:, None] * (p - (y[:, None] == np.arange(classes))), w[:, None] * np.maximum(2 * p * (1 - p), 1e-16)


def _loss(margin: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> float:
    if not classes:
        return float((w * (margin[:, 0] - y) ** 2).sum())
    return float(-(w * np.log(np.maximum(softmax(margin)[np.arange(len(y)), y.astype(int)], 1e-15))).sum())


def _drawn(u: np.ndarray, round_: int, settings: Settings) -> np.ndarray:
    """Rows of this round: by a hash of the row's own number, so the draw does not hang on the partitions."""
    if settings.row_share >= 1:
        return np.ones(len(u), bool)
    x = u.view(np.uint64) ^ np.uint64((settings.seed * 1_000_003 + round_) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 < settings.row_share


def _histograms(state, growing, slots, round_, settings, classes, bins):
    """For mapPartitions over blocks: (slots, features, bins, 3) sums of gradient, hessian, rows, and the validation loss and weight."""

    def run(blocks):
        total, loss = None, np.zeros(2)
        for (binned, y, w, u, held), margin in blocks:
            if held.any():
                loss += _loss(margin[held], y[held], w[held], classes), w[held].sum()
            use = ~held & _drawn(u, round_, settings)
            binned, y, w, margin = binned[use], y[use], w[use], margin[use]
            g, h = _gradients(margin, y, w, classes)
            n_features = binned.shape[1]
            if total is None:
                total = np.zeros((sum(len(s) for s in slots), n_features, bins, 3))
            base = 0
            for k, (arrays, nodes) in enumerate(zip(growing, slots)):
                if len(nodes):
                    place = np.full(len(arrays[0]), -1)
                    place[nodes] = np.arange(len(nodes))
                    slot = place[_walk(arrays, binned)]
                    rows = np.flatnonzero(slot >= 0)
                    key = ((slot[rows, None] * n_features + np.arange(n_features)) * bins + binned[rows]).ravel()
                    size = len(nodes) * n_features * bins
                    for c, v in enumerate((g[rows, k], h[rows, k], np.ones(len(rows)))):
                        total[base:base + len(nodes), ..., c] += np.bincount(key, np.repeat(v, n_features), size).reshape(len(nodes), n_features, bins)
                base += len(nodes)
        if total is not None:
            yield total, loss

    return state.mapPartitions(run).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]), 2)


def _score(g, h, s: Settings):
    shrunk = np.sign(g) * np.maximum(np.abs(g) - s.l1, 0.0)
    return shrunk * shrunk / (h + s.l2)


def _best_split(hist: np.ndarray, allowed: np.ndarray, s: Settings):
    """(gain, feature, bin, sums of the low side, sums of the high side) of one node, or None."""
    low = np.cumsum(hist, axis=1)[:, :-1]
    whole = hist[0].sum(axis=0)
    high = whole - low
    fine = (low[..., 2] >= s.min_leaf) & (high[..., 2] >= s.min_leaf) & (low[..., 1] >= s.min_hessian) & (high[..., 1] >= s.min_hessian) & allowed[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _score(low[..., 0], low[..., 1], s) + _score(high[..., 0], high[..., 1], s) - _score(whole[0], whole[1], s)
    gain = np.where(fine & np.isfinite(gain), gain, -np.inf)
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return (float(gain[f, b]), int(f), int(b), tuple(low[f, b]), tuple(high[f, b])) if gain[f, b] > 1e-12 else None


def boost(train: DataFrame, features: list[str], label: str, objective: str = "softmax", weight_col: str | None = None, validation_col: str | None = None,
          patience: int | None = None, bins: int = BINS, **settings) -> Boosted:
    """Boosted trees with second-order gains and leaf penalties (``l1``, ``l2``); see :class:`Settings` for the rest.

    ``softmax``: of each round one tree a class on the shared probabilities; the hessian is 2 p (1 - p).
    ``squared``: one tree a round on the residuals.  Rows marked by ``validation_col`` are not learnt from; with ``patience``
    the rounds end once their loss has not fallen for so many, and the trees up to the best round are kept.
    """
    s = Settings(**settings)
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    rows = train.where(F.col(label).isNotNull())
    labels = sorted(r[0] for r in rows.select(label).distinct().collect()) if objective == "softmax" else []
    y = F.lit(-1.0)
    if labels:
        for k, value in enumerate(labels):
            y = F.when(F.col(label) == F.lit(value), float(k)).otherwise(y)
    else:
        y = F.col(label).cast("double")
    held = F.coalesce(F.col(validation_col), F.lit(False)) if validation_col else F.lit(False)
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    values = [F.col(f).cast("double").alias(f) for f in features]
    named = rows.select(*values, y.alias("_y"), weight.alias("_w"), F.xxhash64(*features, label).alias("_u"), held.alias("_held"))
    cuts = cut_points(named.where(~F.col("_held")), features, bins)
    width = max(map(len, cuts), default=0) + 1
    stored = materialize(named.mapInArrow(_blocks(features, cuts), "blob binary"), "boost-blocks")
    classes, outputs = len(labels), max(1, len(labels))
    prior = named.where(~F.col("_held")).groupBy(F.col("_y").cast("int").alias("k") if labels else F.lit(0).alias("k")).agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("wy")).collect()
    total = sum(r.w for r in prior)
    base = np.zeros(outputs)
    for r in prior:
        base[r.k] = math.log(r.w / total) if labels else r.wy / total
    made: list[Tree] = []
    losses: list[float] = []
    rng = np.random.default_rng(s.seed)
    state = stored.rdd.map(lambda r: pickle.loads(bytes(r.blob))).map(lambda b: (b, np.tile(base, (len(b[1]), 1)))).persist(StorageLevel.MEMORY_AND_DISK)
    before = None
    for round_ in range(s.rounds):
        allowed = [_draw(rng, len(features), s.col_share) for _ in range(outputs)]
        growing = [Growing((0.0, 0.0, 0.0)) for _ in range(outputs)]
        for depth in range(s.max_depth):
            slots = [t.open for t in growing]
            if not any(slots):
                break
            hist, loss = _histograms(state, [t.arrays() for t in growing], slots, round_, s, classes, width)
            if depth == 0:
                if before is not None:  # this round's margins are kept now
                    before.unpersist()
                if loss[1]:
                    losses.append(loss[0] / loss[1])
            at = 0
            for t, mask, nodes in zip(growing, allowed, slots):
                if depth == 0:
                    t.sums[0] = tuple(hist[at][0].sum(axis=0))
                found = [(split, node) for i, node in enumerate(nodes) if (split := _best_split(hist[at + i], mask, s))]
                at += len(nodes)
                t.open = []
                room = math.inf if s.max_leaves is None else s.max_leaves - t.feature.count(-1)
                for split, node in sorted(found, key=lambda x: (-x[0][0], x[1])):
                    if room <= 0:
                        break
                    t.split(node, *split[1:])
                    room -= 1
        if len(losses) > 1 and patience and _stalled(losses, patience):
            break
        grown = [_finished(t, cuts, k, outputs, s) for k, t in enumerate(growing)]
        made += grown
        steps = [(t.arrays(), tree.value) for t, tree in zip(growing, grown)]
        following = state.map(lambda b, steps=steps: (b[0], b[1] + sum(v[_walk(a, b[0][0])] for a, v in steps))).persist(StorageLevel.MEMORY_AND_DISK)
        if round_ % CUT_EVERY == CUT_EVERY - 1:
            following.checkpoint()
        before, state = state, following
    if validation_col and losses:
        if len(losses) * outputs <= len(made):  # the loss after the last round
            final = state.map(lambda b: np.array([_loss(b[1][b[0][4]], b[0][1][b[0][4]], b[0][2][b[0][4]], classes), b[0][2][b[0][4]].sum()])).reduce(lambda a, b: a + b)
            losses.append(final[0] / final[1])
        if patience:
            made = made[:int(np.argmin(losses)) * outputs]
    for kept in (before, state):
        if kept is not None:
            kept.unpersist()
    return Boosted(Trees(features, made, [1.0] * len(made), base, labels), labels, losses)


def _stalled(losses: list[float], patience: int) -> bool:
    return len(losses) - 1 - int(np.argmin(losses)) >= patience


def _draw(rng, n: int, share: float) -> np.ndarray:
    mask = np.ones(n, bool)
    if share < 1:
        mask[:] = False
        mask[rng.permutation(n)[:max(1, round(share * n))]] = True
    return mask


def _finished(t: Growing, cuts: list[np.ndarray], k: int, outputs: int, s: Settings) -> Tree:
    """The grown tree with real thresholds; leaves hold step * -soft(G) / (H + l2) for their class."""
    feature, cut, left, right = t.arrays()
    sums = np.array(t.sums)
    value = np.zeros((len(feature), outputs))
    leaf = feature < 0
    g, h = sums[:, 0], sums[:, 1]
    weight = -np.sign(g) * np.maximum(np.abs(g) - s.l1, 0.0) / np.maximum(h + s.l2, 1e-16)
    value[leaf, k] = s.step * weight[leaf]
    threshold = np.array([cuts[f][c] if f >= 0 else np.nan for f, c in zip(feature, cut)])
    return Tree(feature, threshold, left, right, value, np.maximum(sums[:, 2], 1e-300))


def score_boosted(df: DataFrame, model: Boosted, keep: list[str], rounds: int | None = None, digits: int = 1) -> DataFrame:
    """keep, predicted_class, class_confidence (probability of that class * 100), probabilities by class; regressions: keep, prediction."""
    types = dict(df.dtypes)
    ids = ", ".join(f"`{c}` {types[c]}" for c in keep)
    schema = f"{ids}, predicted_class int, class_confidence double, probabilities array<double>" if model.labels else f"{ids}, prediction double"

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, out = _matrix(pdf, model.trees.features), pdf[keep].copy()
            if model.labels:
                p = model.probabilities(x, rounds)
                best = p.argmax(axis=1)
                out["predicted_class"] = np.array(model.labels)[best].astype("int32")
                out["class_confidence"], out["probabilities"] = p.max(axis=1) * 100, list(p)
            else:
                out["prediction"] = model.trees.raw(x, rounds)[:, 0]
            yield out

    scored = df.select(*keep, *[c for c in model.trees.features if c not in keep]).mapInPandas(run, schema)
    return scored.withColumn("class_confidence", F.round("class_confidence", digits)) if model.labels else scored
