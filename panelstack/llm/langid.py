"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers of a few units read a window of bytes from both ends;
a softmax over their joined states labels every byte, and a document's
probabilities are the mean over all its bytes.  Texts are cut into windows whole,
and the windows of many documents are the lanes of one numpy computation.  The
network is trained in numpy by backpropagation through time, on windows of a
bounded sample of labelled documents (``per_lang`` each, by a hash of id and text).

Defined cases: null texts, and texts without a letter, are ``und`` with score 0;
so is everything when no labelled row is given; with one language all others get
that one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstack.llm.common import lean, slices, text_bytes

#: Documents of each language that training samples (in expectation); languages above which a network has MANY_UNITS units
#: and a sampled text fewer characters (the sample's characters stay bounded, every language is learnt).
PER_LANG, MANY_LANGS, MANY_UNITS = 300, 256, 24
UNITS, WINDOW, TRAIN_WINDOW, LANES, TRAIN_LANES, STEPS = 10, 128, 48, 4096, 256, 300
UNDETERMINED = "und"


def sigmoid(x: np.ndarray, out=None) -> np.ndarray:
    out = np.negative(x, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


@dataclass
class Net:
    langs: list[str]
    w: dict[str, np.ndarray]

    def states(self, side: str, seq: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """States (time, lane, unit) of one direction; ``seq`` (time, lane) in reading order.  Outside a text the state stays zero."""
        table, u = self.w["x" + side], self.w["u" + side]
        k = u.shape[0]
        t_max, n = seq.shape
        out = np.empty((t_max, n, k), np.float32)
        h = np.zeros((n, k), np.float32)
        x, g = np.empty((n, 3 * k), np.float32), np.empty((n, 3 * k), np.float32)
        zr, c = np.empty((n, 2 * k), np.float32), np.empty((n, k), np.float32)
        for t in range(t_max):
            np.take(table, seq[t], axis=0, out=x, mode="clip")
            np.dot(h, u, out=g)
            np.add(x[:, :2 * k], g[:, :2 * k], out=zr)
            sigmoid(zr, out=zr)
            np.multiply(zr[:, k:], g[:, 2 * k:], out=c)
            c += x[:, 2 * k:]
            np.tanh(c, out=c)
            h = out[t]
            np.subtract(out[t - 1] if t else 0, c, out=h)
            h *= zr[:, :k]
            h += c  # z * (before - c) + c
            if inside is not None:
                h *= inside[t][:, None]
        return out

    def probabilities(self, seq: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """Probabilities (time, lane, language) of every position of windows (time, lane)."""
        fwd, bwd = self.states("f", seq), self.states("b", seq[::-1], None if inside is None else inside[::-1])[::-1]
        k = fwd.shape[2]
        wo = self.w["o"]
        logits = fwd.reshape(-1, k) @ wo[:k] + np.ascontiguousarray(bwd).reshape(-1, k) @ wo[k:] + self.w["c"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.reshape(*seq.shape, -1)

    def document(self, texts: list[bytes]) -> np.ndarray:
        """Mean position probabilities of each text; texts must not be empty."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        lanes = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(texts)), lanes)
        first = np.cumsum(lanes) - lanes
        at = (np.cumsum(sizes) - sizes)[doc] + (np.arange(len(doc)) - first[doc]) * WINDOW
        left = np.minimum(WINDOW, (np.cumsum(sizes))[doc] - at)
        sums = np.zeros((len(texts), len(self.langs)))
        # Whole windows run together; the others run by length, so that little is computed outside of texts.
        whole, rest = np.flatnonzero(left == WINDOW), np.flatnonzero(left < WINDOW)
        rest = rest[np.argsort(left[rest], kind="stable")]
        n_lanes = min(LANES, max(16, LANES * 64 // len(self.langs)))  # probabilities of a chunk: 128 MB up to 16384 languages
        for order in (x[i:i + n_lanes] for x in (whole, rest) for i in range(0, len(x), n_lanes)):
            t_max = int(left[order].max())
            index = at[order][None, :] + np.arange(t_max)[:, None]
            inside = np.arange(t_max)[:, None] < left[order][None, :]
            seq = np.where(inside, raw[np.minimum(index, len(raw) - 1)], 0)
            full = inside.all()
            p = self.probabilities(seq, None if full else inside)
            if not full:
                p *= inside[:, :, None]
            lane_sums = p.sum(axis=0)
            np.add.at(sums, doc[order], lane_sums)
        return sums / sizes[:, None]


def loss_and_grads(net: Net, seq: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of all positions and its gradients, by backpropagation through time."""
    w, (t_max, n) = net.w, seq.shape
    k = w["uf"].shape[0]
    grads = {name: np.zeros_like(v) for name, v in w.items()}
    tape, outs = {}, {}
    for side in "fb":
        s = seq if side == "f" else seq[::-1]
        h, steps, out = np.zeros((n, k), np.float32), [], np.empty((t_max, n, k), np.float32)
        for t in range(t_max):
            x, g = w["x" + side][s[t]], h @ w["u" + side]
            zr = sigmoid(x[:, :2 * k] + g[:, :2 * k])
            c = np.tanh(x[:, 2 * k:] + zr[:, k:] * g[:, 2 * k:])
            new = c + zr[:, :k] * (h - c)
            steps.append((h, zr, c, g[:, 2 * k:]))
            out[t] = h = new
        tape[side], outs[side] = (s, steps), out
    fwd, bwd = outs["f"], outs["b"][::-1]
    logits = fwd @ w["o"][:k] + bwd @ w["o"][k:] + w["c"]
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    loss = float(-np.log(np.maximum(p[:, np.arange(n), labels], 1e-9)).mean())
    d = p
    d[:, np.arange(n), labels] -= 1
    d /= t_max * n
    flat = d.reshape(-1, d.shape[2])
    grads["o"][:k] = fwd.reshape(-1, k).T @ flat
    grads["o"][k:] = np.ascontiguousarray(bwd).reshape(-1, k).T @ flat
    grads["c"][:] = flat.sum(axis=0)
    for side in "fb":
        s, steps = tape[side]
        back = d @ (w["o"][:k] if side == "f" else w["o"][k:]).T
        if side == "b":
            back = back[::-1]
        u, gx, carry = w["u" + side], np.zeros((t_max, n, 3 * k), np.float32), np.zeros((n, k), np.float32)
        for t in range(t_max - 1, -1, -1):
            h, zr, c, hc = steps[t]
            z, r = zr[:, :k], zr[:, k:]
            dh = back[t] + carry
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * hc * r * (1 - r)
            gx[t] = np.concatenate([dz, dr, dc], axis=1)
            dg = np.concatenate([dz, dr, dc * r], axis=1)
            grads["u" + side] += h.T @ dg
            carry = dh * z + dg @ u.T
        rows, flat_x = s.reshape(-1), gx.reshape(-1, 3 * k)
        hot = np.argsort(rows, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(rows[hot]) != 0])
        grads["x" + side][rows[hot][cut]] = np.add.reduceat(flat_x[hot], cut, axis=0)
    return loss, grads


def train(rows: list[tuple[bytes, str]], units: int | None = None, steps: int = STEPS, seed: int = 7) -> Net | None:
    """Network from (text, language); every language weighs the same, every document of one too."""
    rows = [r for r in rows if r[0]]
    if not rows:
        return None
    langs = sorted({r[1] for r in rows})
    units = units or (UNITS if len(langs) <= MANY_LANGS else MANY_UNITS)
    rng = np.random.default_rng(seed)

    def start(*shape):
        return (rng.standard_normal(shape) * 0.3).astype(np.float32)

    w = {"xf": start(256, 3 * units), "xb": start(256, 3 * units), "uf": start(units, 3 * units), "ub": start(units, 3 * units),
         "o": start(2 * units, len(langs)), "c": np.zeros(len(langs), np.float32)}
    net = Net(langs, w)
    texts: dict[str, list] = {lang: [] for lang in langs}
    for t, lang in rows:
        texts[lang].append(t)
    by = list(texts.values())
    m, v = ({a: np.zeros_like(b) for a, b in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        labels = rng.integers(0, len(langs), TRAIN_LANES)
        seq = np.zeros((TRAIN_WINDOW, TRAIN_LANES), np.uint8)
        for i, y in enumerate(labels):
            text = by[y][rng.integers(len(by[y]))]
            at = rng.integers(max(1, len(text) - TRAIN_WINDOW + 1))
            piece = np.frombuffer(text[at:at + TRAIN_WINDOW], np.uint8)
            seq[:, i] = np.resize(piece, TRAIN_WINDOW)  # a short text is repeated
        _, grads = loss_and_grads(net, seq, labels)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * (1 - 0.9 * step / steps)
        for name, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[name] += 0.1 * (g - m[name])
            v[name] += 0.01 * (g * g - v[name])
            w[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def training_rows(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[bytes, str]]:
    """A bounded sample of (text, lang): about ``per_lang`` rows of each language, by a hash of id and text.

    Copies of a row count once, so rows without an id or of one id are drawn like all others.  Of a long text it takes 16 slices of 512 characters spread over the whole,
    fewer where there are more than MANY_LANGS languages.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    key = F.xxhash64("doc_id", "text")
    counts = known.groupBy("lang").agg(F.greatest(F.lit(1), F.approx_count_distinct(key)).alias("n")).collect()
    if not counts:
        return []
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_lang / r["n"])) for r in counts], "lang string, rate double")
    u = F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30))
    chars = max(128, 8192 * MANY_LANGS // max(MANY_LANGS, len(counts)))
    n = max(2, chars // 512)
    spread = F.expr(f"CASE WHEN length(text) <= {chars} THEN text ELSE array_join(transform(sequence(0, {n - 1}), "
                    f"i -> substring(text, cast(1 + i * (length(text) - {chars // n}) / {n - 1} AS int), {chars // n})), ' ') END")
    rows = known.join(F.broadcast(rates), "lang").filter(u < F.col("rate")).select("doc_id", "lang", spread.alias("text")).distinct().collect()
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["text"])):
        found.setdefault(r["lang"], []).append((r["text"].encode(), r["lang"]))
    for r in counts:  # a language whose rows all missed the sample
        if r["lang"] not in found:
            found[r["lang"]] = [(x["text"].encode(), r["lang"]) for x in known.filter(F.col("lang") == r["lang"]).select(spread.alias("text")).limit(1).collect()]
    return [x for lang in sorted(found) for x in found[lang]]


def predictor(net: Net | None, block_bytes: int = 4 << 20):
    """Function for mapInArrow over rows with ``text`` and ``lettered``: the row without them, lang_pred and score."""

    def run(batches):
        for b in batches:
            texts, lettered = text_bytes(b.column("text")), b.column("lettered").to_pylist()
            pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            todo = [i for i, x in enumerate(lettered) if x and texts[i]] if net else []
            for begin, end in slices([len(texts[i]) for i in todo], block_bytes):
                p = net.document([texts[i] for i in todo[begin:end]])
                for i, j, s in zip(todo[begin:end], p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    pred[i], score[i] = net.langs[j], min(1.0, s)
            keep = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if n not in ("text", "lettered")]
            yield pa.RecordBatch.from_arrays([*(c for _, c in keep), pa.array(pred), pa.array(score, pa.float64())], names=[*(n for n, _ in keep), "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: Net | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with ``lang_pred`` and ``score``."""
    rows = docs.select(*keep, F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c not in ("text", "lettered"))
    return rows.mapInArrow(lean(predictor(net)), f"{kinds}, lang_pred string, score double")
