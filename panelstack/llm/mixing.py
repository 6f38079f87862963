"""Mixing documents to target token shares of soft domains.

A softmax classifier on hashed byte trigrams, fitted on a bounded sample of the
labelled rows, gives every document its posterior over the domains.  The sample's
trigrams are counted inside tasks; the driver gets the buckets in use, never a text.  Document
rates r >= 0 then solve

    min  (s - t)' M^-1 (s - t) / 2,   s = sum_d w_d p_d r_d,   M = sum_d w_d p_d p_d'

with w_d the document's share of all tokens, p_d its posterior and t the targets:
the expected share of every domain meets its target where that is possible.  In
the metric of the weights the gradient of a document is p_d M^-1 (s - t) and the
largest eigenvalue is 1, so accelerated projected gradient steps of length 1
from r = 1 converge.  Under "cover" the bound is r >= 1, so that every document keeps
a copy; targets that are then out of reach get the least squares solution, and the
shares that are reached are logged.  A step is one distributed sum over a narrow written table; the driver
keeps the steps' K-vectors, and a document's rate is replayed from them.  A
document is repeated floor(r + u) times, u a hash of its id in [0, 1).

Defined cases: null text counts as empty (0 tokens, posterior of an empty text,
rate by that posterior); labels without a document teach nothing; without labels
all rates are 1; a domain without labelled rows is left out and the other targets
are scaled up; repeated rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstack.llm.common import fresh, lean, one_row, slices, text_bytes
from panelstack.session import materialize

#: Labelled documents of each domain that the fit reads at most (in expectation); hashed trigrams; characters of a long text.
PER_DOMAIN, BUCKETS, CHARS_PER_DOC = 1500, 4096, 1 << 16
#: Target token shares by the `quality` label.
TARGETS = {1: 0.85, 0: 0.15}
STEPS, TOLERANCE, STALL = 80, 1e-9, 1e-6


def trigram_features(texts: list[bytes]) -> np.ndarray:
    """(texts, BUCKETS) square roots of the shares of hashed byte trigrams."""
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    out = np.zeros((len(texts), BUCKETS), np.float32)
    if len(raw) < 3:
        return out
    code = (raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(20)
    inside = owner[2:] == owner[:-2]
    counts = np.bincount(owner[:-2][inside] * BUCKETS + code[inside], minlength=out.size).reshape(out.shape)
    np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)), out=out, casting="unsafe")
    return out


def sliced_features(texts: list[bytes]):
    """(begin, end, features) of consecutive lower-cased texts, so many at a time that the arrays stay small."""
    for begin, end in slices([len(t) + BUCKETS for t in texts], 2 << 20):
        yield begin, end, trigram_features([t.lower() for t in texts[begin:end]])


def sparse_features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The buckets in use (16 bits each) and their features of every lower-cased text."""
    out = []
    for _, _, x in sliced_features(texts):
        used = [np.flatnonzero(row) for row in x]
        out += [(at.astype(np.uint16), row[at]) for row, at in zip(x, used, strict=True)]
    return out


def count_tokens(text: bytes) -> int:
    """Runs without ASCII white space."""
    return len(text.split())


@dataclass
class Domains:
    names: list = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    def posteriors(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty((len(texts), len(self.names)))
        if not self.names:
            return out
        for begin, end, x in sliced_features(texts):
            z = x @ self.weights + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[begin:end] = z / z.sum(axis=1, keepdims=True)
        return out


def fit_domains(rows: list[tuple[tuple[np.ndarray, np.ndarray], object, float]], ridge: float = 3e-4, steps: int = 150) -> Domains:
    """Weighted softmax regression from (sparse features, domain, documents it stands for)."""
    names = sorted({r[1] for r in rows})
    if not names:
        return Domains()
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for row, ((at, value), _, _) in zip(x, rows, strict=True):
        row[at] = value
    y = np.array([names.index(r[1]) for r in rows])
    weight = np.array([r[2] for r in rows], np.float32)
    weight /= weight.sum()
    w, b = np.zeros((BUCKETS, len(names)), np.float32), np.zeros(len(names), np.float32)
    prior = np.array([weight[y == k].sum() for k in range(len(names))])
    b += np.log(prior)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None]
        g = x.T @ p + ridge * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= (0.3 * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        b -= (2.0 * p.sum(axis=0)).astype(np.float32)
    return Domains(names, w, b)


def training_rows(docs: DataFrame, labels: DataFrame, domain: str = "quality", per_domain: int = PER_DOMAIN) -> list[tuple[tuple[np.ndarray, np.ndarray], object, float]]:
    """A bounded sample of labelled documents, by a hash of the id: (sparse features of the text, domain, documents it stands for).

    Tasks count the trigrams: a row takes 24 KB of the driver at most, however long its text.
    """
    known = labels.filter(F.col(domain).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(domain).alias("domain")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    rate = {k: min(1.0, per_domain / n) for k, n in counts.items()}
    u = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keep = F.lit(False)
    for k, r in rate.items():
        keep = keep | ((F.col("domain") == k) & (u < r))
    spread = F.expr(f"CASE WHEN length(text) <= {CHARS_PER_DOC} THEN text ELSE array_join(transform(sequence(0, 63), "
                    f"i -> substring(text, cast(1 + i * (length(text) - {CHARS_PER_DOC // 64}) / 63 AS int), {CHARS_PER_DOC // 64})), ' ') END")
    # About per_domain rows of each domain: a bounded side.
    # One row an id, so that a repeated id cannot fill the sample.
    texts = one_row(docs.select("doc_id", spread.alias("text")).join(F.broadcast(known.filter(keep)), "doc_id"), "domain")

    def run(batches):
        for b in batches:
            at, values = zip(*sparse_features(text_bytes(b.column("text")))) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("domain"), *[pa.array([x.tobytes() for x in c], pa.binary()) for c in (at, values)]],
                                             names=["doc_id", "domain", "at", "value"])

    kinds = dict(texts.dtypes)
    found = texts.mapInArrow(lean(run), f"doc_id {kinds['doc_id']}, domain {kinds['domain']}, at binary, value binary").collect()
    found.sort(key=lambda r: r["doc_id"])
    return [((np.frombuffer(r["at"], np.uint16), np.frombuffer(r["value"], np.float32)), r["domain"], 1 / rate[r["domain"]]) for r in found]


def replay(p: np.ndarray, steps: list[list[float]], least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rates (``least`` or more) of posteriors after accelerated projected gradient steps, and the point where the next gradient is taken."""
    r = y = np.ones(len(p))
    for k, c in enumerate(steps):
        before, r = r, np.maximum(least, y + p @ np.array(c))
        y = r + k / (k + 3) * (r - before)
    return r, y


@dataclass
class Mixture:
    domains: Domains
    steps: list[list[float]]
    totals: dict  # expected tokens of each domain before mixing
    targets: dict  # target tokens
    reached: dict  # expected tokens after mixing
    least: float = 0.0  # lower bound of all rates

    def reached_shares(self) -> dict:
        """Expected token share of each domain after mixing."""
        total = sum(self.reached.values())
        return {n: v / total for n, v in self.reached.items()} if total > 0 else {}


def memberships(docs: DataFrame, domains: Domains) -> DataFrame:
    """pos, doc_id, tokens and posterior of every document, written to the shared folder."""

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column("text"))
            p = domains.posteriors(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("pos"), b.column("doc_id"), pa.array([count_tokens(t) for t in texts], pa.int64()), pa.array(list(p), pa.list_(pa.float64()))],
                names=["pos", "doc_id", "tokens", "posterior"])

    rows = docs.select(F.monotonically_increasing_id().alias("pos"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(lean(run), "pos long, doc_id long, tokens long, posterior array<double>"), "mix-members")


def fit_rates(members: DataFrame, domains: Domains, targets: dict, total: float | str | None = None) -> Mixture:
    """Projected-gradient rates.  ``total``: tokens wanted (None: as many as there are; "cover": all rates are 1 or more, at the
    least total that meets the targets so, or where there is none, near the least at which no domain shrinks)."""
    k, least = len(domains.names), 1.0 if total == "cover" else 0.0

    def sums(steps):
        """Sums of w p r, w p y, w p p' and w, from one row a task."""
        def run(batches):
            s, s_next, m, n = np.zeros(k), np.zeros(k), np.zeros((k, k)), 0.0
            for b in batches:
                if b.num_rows:
                    w = b.column("tokens").to_numpy(zero_copy_only=False).astype(float)
                    p = np.stack(b.column("posterior").to_numpy(zero_copy_only=False))
                    r, y = replay(p, steps, least)
                    s += p.T @ (w * r)
                    s_next += p.T @ (w * y)
                    m += (p * w[:, None]).T @ p
                    n += w.sum()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.float64()) for x in (*s, *s_next, *m.ravel(), n)], names=names)

        names = [f"c{i}" for i in range(2 * k + k * k + 1)]
        one = members.select("tokens", "posterior").mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
        flat = np.array([x or 0.0 for x in one])
        return flat[:k], flat[k:2 * k], flat[2 * k:-1].reshape(k, k), flat[-1]

    if not k:
        return Mixture(domains, [], {}, {}, {}, least)
    s, _, m, tokens = sums([])
    share = np.array([float(targets.get(n, 0.0)) for n in domains.names])
    if tokens <= 0 or share.sum() <= 0:
        return Mixture(domains, [], {}, {}, {}, least)
    share /= share.sum()
    start = s / tokens
    inverse = np.linalg.pinv(m / tokens, rcond=1e-10)
    if total == "cover":
        # The first step is M^-1 (scale * share) - 1 (M maps ones to the present shares): nowhere negative from 1 / min on.
        first = inverse @ share
        scale = float(1 / first.min()) if first.min() > 1e-6 else float(np.max(start[share > 0] / share[share > 0]))
    else:
        scale = 1.0 if total is None else float(total) / tokens
    goal = share * scale
    steps: list[list[float]] = []
    now = ahead = start
    for _ in range(STEPS):
        if np.abs(goal - now).max() <= TOLERANCE:
            break
        steps.append((inverse @ (goal - ahead)).tolist())
        s, s_next, _, _ = sums(steps)
        before, now, ahead = now, s / tokens, s_next / tokens
        if np.abs(now - before).max() <= STALL:  # the targets are out of reach: the least squares solution stands
            break
    as_map = lambda v: dict(zip(domains.names, (v * tokens).tolist(), strict=True))
    mixture = Mixture(domains, steps, as_map(start), as_map(goal), as_map(now), least)
    if np.abs(goal - now).max() > 1e-3 * scale:
        logging.getLogger(__name__).warning("target shares %s are out of reach, reached: %s", dict(zip(domains.names, share.tolist(), strict=True)), mixture.reached_shares())
    return mixture


def _copies(rate: F.Column, *key: str) -> F.Column:
    u = F.pmod(F.xxhash64(*key, F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("int")


def rates(members: DataFrame, mixture: Mixture) -> DataFrame:
    """doc_id, tokens, posterior, rate and copies of every document."""
    steps, least = mixture.steps, mixture.least

    def run(batches):
        for b in batches:
            p = np.stack(b.column("posterior").to_numpy(zero_copy_only=False)) if b.num_rows and steps else np.zeros((b.num_rows, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replay(p, steps, least)[0], pa.float64())], names=[*b.schema.names, "rate"])

    kinds = "pos long, doc_id long, tokens long, posterior array<double>, rate double"
    return members.mapInArrow(run, kinds).withColumn("copies", _copies(F.col("rate"), "doc_id", "pos"))


def apply(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """The documents repeated (or left out) by their rates, all columns as they were; no shuffle."""
    steps, domains, least = mixture.steps, mixture.domains, mixture.least
    pos, rate, copy = (fresh(docs, c) for c in ("__pos", "__rate", "__copy"))

    def run(batches):
        for b in batches:
            r = replay(domains.posteriors(text_bytes(b.column("text"))), steps, least)[0] if steps else np.ones(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r, pa.float64())], names=[*b.schema.names, rate])

    rows = docs.withColumn(pos, F.monotonically_increasing_id())
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", {rate} double"
    return (rows.mapInArrow(lean(run), kinds).withColumn(copy, F.explode(F.array_repeat(F.lit(1), _copies(F.col(rate), "doc_id", pos))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
