"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on windows of toxic and of ordinary
text.  What the toxic dictionary holds at the beginnings of words, and from any
character outside ASCII, is kept where toxic training documents use it clearly
more often than ordinary ones; appended
to the ordinary dictionary it gives the toxic one, so that both compress
ordinary text alike.  Every window of a text is compressed with both; the bytes
saved by the toxic dictionary, at several window widths, are turned into a
probability by a logistic calibration on training rows that took no part in
training the dictionaries.

The fit takes a bounded sample of the labelled rows (``per_class`` documents of
each label, chosen by a hash of the id and weighted back to their share);
scoring covers whole texts of all rows without a shuffle.

Defined cases: null text counts as empty; an empty text has no windows and gets
the calibrated probability of zero savings; labels without a document, null ids
and null labels teach nothing; with no label or one class only, the score is the
share of label 1 (0 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstack.llm.common import WordHasher, lean, one_row, shingles, text_bytes

#: Documents of each label that the fit reads at most (in expectation).  Of a longer text it takes this many
#: characters in 64 slices spread evenly over the whole.
PER_CLASS, CHARS_PER_DOC = 3000, 1 << 16
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
#: (window bytes, zstandard strategy, shortest match, search effort) of each distance.
SCALES = ((512, 1, 6, 1), (128, 1, 5, 1), (192, 5, 4, 32), (64, 5, 5, 32))
ORDINARY_BYTES, TOXIC_BYTES = 8192, 112640
_GRAMS = (5, 6, 7, 8, 10, 24)


def windows(text: bytes, width: int) -> list[bytes]:
    """The whole text in windows of about ``width`` bytes that end behind a space where there is one."""
    out, at, n = [], 0, len(text)
    while at < n:
        to = min(n, at + width)
        if to < n:
            cut = text.rfind(b" ", at, to)
            if cut > at:
                to = cut + 1
        out.append(text[at:to])
        at = to
    return out


def word_starts(text: bytes) -> set[bytes]:
    """First bytes of the text's words, in several lengths, behind a space; and bytes from every character outside ASCII, as scripts may set no spaces."""
    words = set(text.split())
    out = {b" " + w[:n] for w in words for n in _GRAMS if len(w) >= n or n == _GRAMS[-1]}
    for w in words:
        if not w.isascii():
            out.update(w[i:i + n] for i in range(len(w)) if w[i] >= 0xC0 for n in _GRAMS if i + n <= len(w))
    return out


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)
    prior: float = 0.0


class Distances:
    """Bytes saved by the toxic dictionary in the windows of a text."""

    def __init__(self, model: Model):
        self.pairs = [(w, self._compressor(model.ordinary, s, m, t), self._compressor(model.ordinary + model.toxic, s, m, t)) for w, s, m, t in SCALES]

    @staticmethod
    def _compressor(content: bytes, strategy: int, match: int, target: int):
        params = zstandard.ZstdCompressionParameters(compression_level=3, strategy=strategy, min_match=match, search_log=5, hash_log=15, chain_log=15, window_log=16,
                                                     target_length=target)
        words = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(compression_params=params, dict_data=words)

    def features(self, text: bytes) -> list[float]:
        out = [1.0]
        for width, ordinary, toxic in self.pairs:
            saved = [len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text, width)]
            total = float(sum(saved))
            out += [10 * width / 512 * total / (len(saved) + 0.5) / 5, sum(s >= 2 for s in saved) / (len(saved) + 0.5), min(max(saved, default=0), 16) / 8]
        out.append(np.log1p(len(text)) / 10)
        return out


def unlike(texts: list[bytes]) -> np.ndarray:
    """True for the first of texts that look alike (any of four least five-word hashes is shared): copies must not vote twice."""
    words, seen, out = WordHasher(), set(), np.ones(len(texts), bool)
    for i, t in enumerate(texts):
        h = shingles(words(t)[1], 5)
        if len(h):
            least = {(k, int((h * np.uint64(m)).min())) for k, m in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))}
            out[i] = not least & seen
            seen |= least
    return out


def train_dictionaries(texts: list[bytes], toxic: np.ndarray) -> Model:
    """Dictionaries from lower-cased texts and their labels."""
    def content(rows, width, size, k, d):
        parts = [w for t in rows for w in windows(t, width)]
        try:
            return zstandard.train_dictionary(size, parts, k=k, d=d).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself
            return b"".join(parts)[:size]

    bad, good = [t for t, y in zip(texts, toxic, strict=True) if y], [t for t, y in zip(texts, toxic, strict=True) if not y]
    ordinary = content(good, 256, ORDINARY_BYTES, 64, 8)
    candidates = word_starts(content(bad, 256, TOXIC_BYTES, 24, 6))
    seen_bad, seen_good = Counter(), Counter()
    for rows, seen in ((bad, seen_bad), (good, seen_good)):
        for t in rows:
            seen.update(word_starts(t) & candidates)
    found = []
    for c in candidates:
        x, share = seen_bad[c], (seen_good[c] + 0.5) / (len(good) + 1)
        rate = x / max(1, len(bad))
        z = (rate - share) / np.sqrt(share * (1 - share) / max(1, len(bad)) + 1e-12)
        if x >= 3 and rate > 6 * share and z > 10:
            found.append((z, c))
    kept: list[bytes] = []
    for _, c in sorted(found, reverse=True):
        if not any(c in k or k in c for k in kept):
            kept.append(c)
    return Model(ordinary, b"\x00".join(reversed(kept)))  # the strongest stand nearest to the window


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[bytes, int, float]]) -> Model:
    """Model from (text, label, weight); every third row only calibrates."""
    if not rows:
        return Model()
    y = np.array([r[1] for r in rows], float)
    weight = np.array([r[2] for r in rows], float)
    prior = float((y * weight).sum() / weight.sum())
    texts = [r[0].lower() for r in rows]
    first = unlike(texts)
    texts, y, weight = [t for t, f in zip(texts, first, strict=True) if f], y[first], weight[first]
    third = np.zeros(len(texts), bool)
    for label in (0, 1):
        third[np.flatnonzero(y == label)[::3]] = True
    if min((y[~third] == 1).sum(), (y[~third] == 0).sum(), (y[third] == 1).sum(), (y[third] == 0).sum()) == 0:
        return Model(prior=prior)
    model = train_dictionaries([t for t, h in zip(texts, third, strict=True) if not h], y[~third] == 1)
    distances = Distances(model)
    x = np.array([distances.features(t) for t, h in zip(texts, third, strict=True) if h])
    w = weight[third] / weight[third].mean()
    return Model(model.ordinary, model.toxic, calibrate(x, y[third], w).tolist(), prior)


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[tuple[bytes, int, float]]:
    """A bounded sample of labelled documents: (text, label, documents it stands for), ordered by a hash of the id.

    Only rows that may be learnt from should be passed.
    """
    # A label for an id is settled first: of several the largest counts.
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = {y: min(1.0, per_class / n) for y, n in counts.items()}
    if not rate:
        return []
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keep = F.lit(False)
    for y, r in rate.items():
        keep = keep | ((F.col("toxic") == y) & (u < r))
    chosen = known.filter(keep)  # about per_class rows of each label
    spread = F.expr(f"CASE WHEN length(text) <= {CHARS_PER_DOC} THEN text ELSE array_join(transform(sequence(0, 63), "
                    f"i -> substring(text, cast(1 + i * (length(text) - {CHARS_PER_DOC // 64}) / 63 AS int), {CHARS_PER_DOC // 64})), ' ') END")
    rows = docs.select("doc_id", spread.alias("text")).join(F.broadcast(chosen), "doc_id")
    # One row an id, so that a repeated id cannot fill the sample.
    found = one_row(rows, "toxic").select("doc_id", "text", "toxic", u.alias("u")).collect()
    found.sort(key=lambda r: (r["u"], r["doc_id"], r["text"] or ""))
    return [((r["text"] or "").encode(), int(r["toxic"]), 1 / rate[r["toxic"]]) for r in found]


def probabilities(model: Model):
    """Function from a list of texts (bytes) to their scores."""
    if not model.weights:
        return lambda texts: np.full(len(texts), model.prior)
    distances, w = Distances(model), np.array(model.weights)

    def run(texts):
        x = np.array([distances.features(t.lower()) for t in texts]).reshape(-1, len(w))
        return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))

    return run


def _kinds(docs: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of the documents and ``score``, the probability of label 1 (a column of that name is replaced)."""
    docs = docs.drop("score")

    def run(batches):
        judge = probabilities(model)
        for b in batches:
            found = judge(text_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, "score"])

    return docs.mapInArrow(lean(run), f"{_kinds(docs)}, score double")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, all columns as they were."""

    def run(batches):
        judge = probabilities(model)
        for b in batches:
            yield b.filter(pa.array(judge(text_bytes(b.column("text"))) < threshold, pa.bool_()))

    return docs.mapInArrow(lean(run), _kinds(docs))
