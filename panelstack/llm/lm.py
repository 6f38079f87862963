"""Language-model scores by online logistic context mixing.

A text is lower-cased (A-Z) and coded bit by bit: every byte is a path through a
fixed binary code tree, and an end mark closes the text.  For each bit the
hashed contexts of the last 1, 2, 3, 4 and 6 bytes give a bit predictor each,
from two counts.  A mixer adds their log-odds with weights from a set that a gate
picks (how much the longer contexts have seen, and the bit's depth); a refining
map, by tree node and mixed log-odds, corrects what comes out.  The bits' costs
add up to the text's log probability.

Learning reads every training text twice: first the predictors' counts, summed by
slot over all tasks; then mixer weights and refining map, learnt online in every
task (predict, then update; a bit's own occurrence is taken out of the counts)
and averaged by the number of bits.  Scoring uses the finished model, so results
do not depend on any order.  As a bit's cost depends on seven bytes only, the
distinct seven-byte windows of a block are costed once each.

The token baseline needs the corpus count of every word: blocks of documents send
their distinct word hashes (64 bits) with counts, dealt by hash range, and get the
corpus counts back, so a frequent word travels once a block.  The predictors'
tables have a fixed size (SLOT_BITS); words have no limit.

Defined cases: null text counts as empty (one end token); a null id hashes as the
empty text; with no training rows every bit costs one half and N = V = 0; repeated
rows each count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstack.llm.common import WordHasher, lean, mix64, pack, slices, text_bytes, unpack
from panelstack.session import materialize

#: Context lengths in bytes and the log2 size of their tables.
ORDERS, SLOT_BITS = (1, 2, 3, 4, 6), (16, 18, 20, 21, 22)
#: Bytes by expected frequency, the most frequent first, for the code tree; all other bytes come after.
SYMBOLS = " etaoinshrdlucmfgpbywvk.,\nqzxj\x00\xc3'-!|*0123456789"
#: Pseudo-count of both bits, levels of evidence, gated sets, cells of the refining map.
PRIOR, LEVELS, DEPTHS, CELLS = 0.2, 4, 4, 33
SETS = LEVELS**3 * DEPTHS
BLOCK_ROWS, BLOCK_BYTES, SLICE_BYTES, BATCH = 4096, 16 << 20, 4 << 20, 1 << 14
MOST_COUNTED = 2.0 ** (255 / 12) - 1
PIECE_BITS = 16
SPAN = max(ORDERS)


def code_tree() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman code of the bytes by rank: nodes (256, depth), bits (256, depth), lengths."""
    ranked = list(SYMBOLS.encode("latin-1"))
    weight = {b: 1 / (ranked.index(b) + 2) if b in ranked else 1e-4 for b in range(256)}
    heap = [(w, b, b) for b, w in weight.items()]
    heapq.heapify(heap)
    kids, fresh = {}, 256
    while len(heap) > 1:
        (w1, _, a), (w2, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        kids[fresh] = (a, b)
        heapq.heappush(heap, (w1 + w2, fresh, fresh))
        fresh += 1
    paths, stack = {}, [(heap[0][2], [])]
    while stack:
        node, path = stack.pop()
        if node < 256:
            paths[node] = path
        else:
            stack += [(kids[node][k], [*path, (node - 256, k)]) for k in (0, 1)]
    depth = max(map(len, paths.values()))
    nodes, bits = np.zeros((256, depth), np.int64), np.zeros((256, depth), np.int8)
    for b, path in paths.items():
        for t, (node, k) in enumerate(path):
            nodes[b, t], bits[b, t] = node, k
    return nodes, bits, np.array([len(paths[b]) for b in range(256)])


def quantised(pairs: np.ndarray) -> np.ndarray:
    """(n, 2) counts of both bits on a logarithmic scale of 256 steps; small ones stay exact.

    Where one of a pair is beyond the scale (2.5 million) both are scaled down together, so their ratio stays.
    """
    pairs = pairs.astype(np.float64)
    pairs = pairs * np.minimum(1.0, MOST_COUNTED / np.maximum(pairs.max(axis=1, keepdims=True), 1.0))
    return np.minimum(255, np.rint(12 * np.log2(1 + pairs))).astype(np.uint16)


def numbered(batches):
    """Batches with a column ``block``: runs of a task's rows of at most BLOCK_ROWS rows and, unless one text is longer, BLOCK_BYTES bytes."""
    from pyspark import TaskContext

    block, rows, held = TaskContext.get().partitionId() << 32, 0, 0
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
        out = []
        for size in sizes:
            if rows and (rows >= BLOCK_ROWS or held + size > BLOCK_BYTES):
                block, rows, held = block + 1, 0, 0
            rows, held = rows + 1, held + size
            out.append(block)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "block"])


def lookup_tables() -> dict[str, np.ndarray]:
    """Log-odds and evidence level of a pair of quantised counts, as they are and with one occurrence of the bit taken out."""
    n = 2.0 ** (np.arange(256) / 12) - 1
    less = np.maximum(n - 1, 0)
    n0, n1 = np.meshgrid(n, n, indexing="ij")
    l0, l1 = np.meshgrid(less, less, indexing="ij")

    def odds(a, b):
        return (np.log(b + PRIOR) - np.log(a + PRIOR)).astype(np.float32).ravel()

    def level(total):
        return np.digitize(total, [0.5, 2.5, 15.5]).astype(np.uint8).ravel()

    return {"odds": odds(n0, n1), "level": level(n0 + n1), "odds0": odds(l0, n1), "odds1": odds(n0, l1), "level0": level(l0 + n1), "level1": level(n0 + l1)}


class Coder:
    """Windows of text and the steps of their codes."""

    def __init__(self) -> None:
        self.nodes, self.bits, self.lengths = code_tree()
        # By depth, so that a step reads one row.
        self.nodes, self.bits = np.ascontiguousarray(self.nodes.T), np.ascontiguousarray(self.bits.T)
        self.node_hash = self.nodes.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        look = lookup_tables()
        self.odds, self.level = look["odds"], look["level"]
        # The bit shifts the index: first half for a 0, second for a 1, each without that occurrence.
        self.own_odds, self.own_level = np.r_[look["odds0"], look["odds1"]], np.r_[look["level0"], look["level1"]]

    @staticmethod
    def lay_out(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
        """Texts between runs of zeros, and where each begins; a zero behind a text is its end mark."""
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = SPAN + np.r_[0, np.cumsum(sizes + SPAN + 1)[:-1]] if len(texts) else sizes
        gap = b"\0" * (SPAN + 1)
        return (b"\0" * SPAN + gap.join(texts) + b"\0").lower(), begins

    @staticmethod
    def windows(laid: bytes, at: np.ndarray) -> np.ndarray:
        """The SPAN bytes before and the byte at each position, as one number (an eight-byte view at every offset)."""
        n = len(laid) - SPAN
        return np.ndarray(n, ">u8", laid + b"\0", strides=(1,))[at].astype(np.uint64) >> np.uint64(8)

    def texts_windows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Windows of all bytes and end marks of the texts, and how many each text has."""
        laid, _ = self.lay_out(texts)
        sizes = np.array([len(t) for t in texts], np.int64) + 1
        keep = np.ones(int((sizes + SPAN).sum()) - SPAN, bool)
        ends = np.cumsum(sizes + SPAN)[:-1]  # behind each text but the last: SPAN zeros that are nobody's
        for j in range(1, SPAN + 1):
            keep[ends - j] = False
        return self.windows(laid, keep), sizes

    @staticmethod
    def contexts(keys: np.ndarray) -> list[np.ndarray]:
        past = keys >> np.uint64(8)
        return [mix64((past & np.uint64((1 << 8 * o) - 1)) + np.uint64(o << 56)) for o in ORDERS]

    @staticmethod
    def slots(context: np.ndarray, node_hash: np.ndarray, bits: int) -> np.ndarray:
        h = context ^ node_hash
        h *= np.uint64(0x9FB21C651E98DF25)
        h >>= np.uint64(64 - bits)
        return h.view(np.int64)

    def by_length(self, keys: np.ndarray) -> np.ndarray:
        """Order of the windows by falling code length: the windows of a depth are then the first ones."""
        return np.argsort(-self.lengths[(keys & np.uint64(255)).astype(np.int64)].astype(np.int8), kind="stable")

    def steps(self, keys: np.ndarray):
        """For each depth of windows in that order: how many go on, their nodes, node hashes and bits."""
        byte = (keys & np.uint64(255)).astype(np.int64)
        left = np.bincount(self.lengths[byte], minlength=len(self.nodes) + 1)
        for t in range(len(self.nodes)):
            n = int(left[t + 1:].sum())
            if not n:
                return
            yield t, n, self.nodes[t].take(byte[:n]), self.node_hash[t].take(byte[:n]), self.bits[t].take(byte[:n])

    def count(self, keys: np.ndarray, weights: np.ndarray, counts: list[np.ndarray]) -> None:
        for begin in range(0, len(keys), 1 << 16):
            part, own = keys[begin:begin + (1 << 16)], weights[begin:begin + (1 << 16)]
            order = self.by_length(part)
            part, own = part[order], own[order]
            contexts = self.contexts(part)
            for _, n, _, node_hash, bit in self.steps(part):
                for o, c in enumerate(contexts):
                    at = self.slots(c[:n], node_hash, SLOT_BITS[o])
                    at <<= 1
                    at += bit
                    np.add.at(counts[o], at, own[:n])

    def inputs(self, model_tables, contexts, n, node_hash, t, bit=None) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of every predictor (and a constant) and the gate, with or without a bit's own occurrence."""
        x = np.empty((len(ORDERS) + 1, n), np.float32)
        x[-1] = 0.3
        gate = np.full(n, min(t, DEPTHS - 1), np.int64)
        odds, level = (self.odds, self.level) if bit is None else (self.own_odds, self.own_level)
        shift = None if bit is None else bit.astype(np.int64) << 16
        for o, c in enumerate(contexts):
            pair = model_tables[o].take(self.slots(c[:n], node_hash, SLOT_BITS[o])).astype(np.int64)
            if shift is not None:
                pair += shift
            odds.take(pair, out=x[o], mode="clip")
            if o >= len(ORDERS) - 3:
                gate *= LEVELS
                gate += level.take(pair)
        return x, gate


def mixed(weights: np.ndarray, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Gated sum of the inputs; ``weights`` (input, set)."""
    z = weights[0].take(gate) * x[0]
    for o in range(1, len(x)):
        z += weights[o].take(gate) * x[o]
    return z


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def refine_at(z: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell (of the flat map) left of each log-odds, and the share of the one right of it."""
    place = (np.clip(z, -7.99, 7.99) + 8) * ((CELLS - 1) / 16)
    cell = place.astype(np.int32)
    return node * CELLS + cell, place - cell.astype(z.dtype)


def refined(z, node, table) -> np.ndarray:
    cell, part = refine_at(z, node)
    low = table.take(cell)
    p = squash(np.clip(z, -12, 12))
    p += low
    p += part * (table.take(cell + 1) - low)
    p *= 0.5
    return np.clip(p, 1e-6, 1 - 1e-6)


class Mixer:
    """Gated weights and refining map, learnt online."""

    def __init__(self) -> None:
        self.w = np.full((len(ORDERS) + 1, SETS), 0.3)
        self.curve = np.full((len(ORDERS) + 1, SETS), 1.0)
        self.hits = np.zeros((2, 255 * CELLS))
        self.mass, self.cost = 0.0, 0.0

    def learn(self, coder: Coder, tables, keys: np.ndarray, weights: np.ndarray, rate: float = 0.15) -> None:
        for begin in range(0, len(keys), BATCH):
            part, own = keys[begin:begin + BATCH], weights[begin:begin + BATCH].astype(np.float64)
            order = coder.by_length(part)
            part, own = part[order], own[order]
            contexts = coder.contexts(part)
            for t, n, node, node_hash, bit in coder.steps(part):
                x, gate = coder.inputs(tables, contexts, n, node_hash, t, bit)
                z = mixed(self.w, x, gate)
                p = squash(np.clip(z, -12, 12))
                c = own[:n]
                err, bend = (bit - p) * c, p * (1 - p) * c
                self.cost -= float((c * np.log2(np.where(bit, p, 1 - p))).sum())
                self.mass += float(c.sum())
                for o in range(len(x)):
                    grad = np.bincount(gate, weights=err * x[o], minlength=SETS)
                    self.curve[o] = 0.995 * self.curve[o] + np.bincount(gate, weights=bend * x[o] * x[o], minlength=SETS)
                    self.w[o] += rate * grad / self.curve[o]
                cell, share = refine_at(z, node)
                for move, s in ((0, 1 - share), (1, share)):
                    self.hits[0] += np.bincount(cell + move, weights=s * c * bit, minlength=self.hits.shape[1])[:self.hits.shape[1]]
                    self.hits[1] += np.bincount(cell + move, weights=s * c, minlength=self.hits.shape[1])[:self.hits.shape[1]]


def refine_table(hits: np.ndarray) -> np.ndarray:
    start = np.tile(squash(np.arange(CELLS) * 16 / (CELLS - 1) - 8), 255)
    return ((hits[0] + 20 * start) / (hits[1] + 20)).astype(np.float32)


class Finder:
    """Places of numbers in a sorted array of distinct ones that holds them all: a direct table by hash, checked, with binary search for the rest."""

    BITS = 22

    def __init__(self) -> None:
        self.table = np.zeros(1 << self.BITS, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        h >>= np.uint64(64 - self.BITS)
        return h.view(np.int64)

    def __call__(self, keys: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, np.int64)
        self.table[self._slot(distinct)] = np.arange(len(distinct), dtype=np.int32)
        at = self.table.take(self._slot(keys))
        missed = np.flatnonzero(distinct.take(at, mode="clip") != keys)  # another key has the slot, or one of an earlier call
        at[missed] = np.searchsorted(distinct, keys[missed])
        return at


def distinct_sorted(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def words_of(texts: list[bytes], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Owner and 63-bit hash (the last bit is 0) of every word of the texts."""
    starts, hashes = hasher(b"\n".join(texts).lower())
    ends = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.searchsorted(starts, ends), prepend=0)  # starts are sorted
    return np.repeat(np.arange(len(texts)), per_text), hashes & ~np.uint64(1)


def distinct_windows(coder: Coder, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct windows, sorted, and how often each stands in them."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    for a, b in slices([len(t) + 8 for t in texts], SLICE_BYTES):
        new, n = np.unique(coder.texts_windows(texts[a:b])[0], return_counts=True)
        at = np.searchsorted(keys, new)
        old = keys[np.minimum(at, len(keys) - 1)] == new if len(keys) else np.zeros(len(new), bool)
        counts[at[old]] += n[old].astype(np.uint32)
        keys, counts = np.insert(keys, at[~old], new[~old]), np.insert(counts, at[~old], n[~old].astype(np.uint32))
    return keys, counts


def pack_counts(part: np.ndarray) -> bytes:
    """Counts as a bit map of the used slots, one byte for each, and the large ones."""
    used = part[part > 0]
    return pack(np.packbits(part > 0), np.minimum(used, 255).astype(np.uint8), used[used >= 255])


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Used slots and their counts."""
    bits, small, large = unpack(blob)
    n = small.astype(np.int64)
    n[small == 255] = large
    return np.flatnonzero(np.unpackbits(bits)), n


def _batch(kind, rows):
    """Rows (block, bucket, n, blob) of one kind."""
    block, bucket, n, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64()), pa.array(blob, pa.binary())],
                                      names=["kind", "block", "bucket", "n", "blob"])


GATHERED = "kind int, block long, bucket int, n long, blob binary"
COUNTS, WORDS, STATS = 0, 1, 2


def gather(bucket_bits: int):
    """For mapInArrow over (train, text): the task's predictor counts, and every block's distinct words with training counts."""

    def run(batches):
        coder, hasher = Coder(), WordHasher()
        counts = [np.zeros(2 << b, np.uint32) for b in SLOT_BITS]
        block, words, train_docs = None, [], 0

        def close():
            # The last bit tells training words, so that one plain sort counts them.
            every = np.sort(np.concatenate(words))
            first = np.flatnonzero(np.r_[True, every[1:] >> np.uint64(1) != every[:-1] >> np.uint64(1)]) if len(every) else np.zeros(0, np.int64)
            keys = every[first] & ~np.uint64(1)
            seen = np.add.reduceat((every & np.uint64(1)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            bucket = (keys >> np.uint64(64 - bucket_bits)).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
            rows = [(block, int(bucket[a]), int(b - a), pack(keys[a:b], seen[a:b])) for a, b in zip(cut, np.r_[cut[1:], len(keys)], strict=True)]
            return _batch(WORDS, rows) if rows else None

        for b in numbered(batches):
            blocks = b.column("block").to_numpy(zero_copy_only=False)
            train = b.column("train").to_numpy(zero_copy_only=False).astype(bool)
            texts = text_bytes(b.column("text"))
            edges = np.r_[np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]), len(blocks)] if len(blocks) else np.zeros(1, int)
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if blocks[a] != block:
                    if block is not None and (done := close()) is not None:
                        yield done
                    block, words = int(blocks[a]), []
                for i, j in slices([len(t) + 1 for t in texts[a:z]], SLICE_BYTES):
                    owner, hashes = words_of(texts[a + i:a + j], hasher)
                    words.append(hashes | train[a + i:a + j][owner].astype(np.uint64))
            taught = [t for t, y in zip(texts, train, strict=True) if y]
            train_docs += len(taught)
            keys, times = distinct_windows(coder, taught)
            coder.count(keys, times, counts)
        if block is not None and (done := close()) is not None:
            yield done
        rows = []
        for o, table in enumerate(counts):
            for piece, part in enumerate(table.reshape(-1, 2 << PIECE_BITS)):
                if part.any():
                    rows.append((o, piece, 0, pack_counts(part)))
        if rows:
            yield _batch(COUNTS, rows)
        yield _batch(STATS, [(0, 0, train_docs, b"")])

    return run


def sum_counts(batches):
    """For mapInArrow over predictor counts sorted by (order, piece): one piece of quantised counts each."""
    at, total = None, None

    def out():
        pairs = quantised(total.reshape(-1, 2))
        return _batch(COUNTS, [(at[0], at[1], 0, pack(pairs[:, 0] << np.uint16(8) | pairs[:, 1]))])

    for b in batches:
        blobs = (x.as_py() for x in b.column("blob"))  # one at a time
        for o, piece, blob in zip(b.column("block").to_pylist(), b.column("bucket").to_pylist(), blobs, strict=True):
            if (o, piece) != at:
                if at is not None:
                    yield out()
                at, total = (o, piece), np.zeros(2 << PIECE_BITS, np.int64)
            slot, n = unpack_counts(blob)
            total[slot] += n
    if at is not None:
        yield out()


def answer_words(batches):
    """For mapInArrow over words sorted by bucket: the corpus counts of every block's words, and what the bucket adds to N and V."""
    at, held = None, []

    def out():
        asked = [unpack(blob) for _, blob in held]
        keys, inverse = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([a[1] for a in asked]), minlength=len(keys)).astype(np.int64)
        begin = 0
        for (block, _), (own, _) in zip(held, asked, strict=True):
            yield _batch(WORDS, [(block, at, len(own), pack(counts[inverse[begin:begin + len(own)]].astype(np.uint32 if counts.max(initial=0) < 2**32 else np.int64)))])
            begin += len(own)
        yield _batch(STATS, [(int((counts > 0).sum()), at, int(counts.sum()), b"")])

    for b in batches:
        for bucket, block, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "blob")), strict=True):
            if bucket != at:
                if held:
                    yield from out()
                at, held = bucket, []
            held.append((block, blob))
    if held:
        yield from out()


def learn_mixer(tables_of):
    """For mapInArrow over training texts: the task's weights (times its bits), refining hits, bits and cost."""

    def run(batches):
        coder, mixer, tables = Coder(), Mixer(), tables_of()
        for b in batches:
            keys, times = distinct_windows(coder, text_bytes(b.column("text")))
            order = np.argsort(mix64(keys), kind="stable")  # windows come in an order without pattern
            mixer.learn(coder, tables, keys[order], times[order])
        if mixer.mass:
            yield pa.RecordBatch.from_arrays([pa.array([pack(mixer.w * mixer.mass, mixer.hits, np.array([mixer.mass, mixer.cost]))], pa.binary())], names=["blob"])

    return run


def sum_mixers(batches):
    total = None
    for b in batches:
        for blob in b.column("blob").to_pylist():
            parts = unpack(blob)
            total = parts if total is None else [x + y for x, y in zip(total, parts, strict=True)]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pack(*total)], pa.binary())], names=["blob"])


class Scorer:
    """Log probabilities of texts under a finished model."""

    #: Windows whose costs are remembered between slices.
    KNOWN = 1 << 21

    def __init__(self, tables, weights, refine):
        self.coder, self.tables, self.w, self.refine = Coder(), tables, weights.astype(np.float32), refine
        self.keys, self.cost, self.find = np.zeros(0, np.uint64), np.zeros(0), Finder()

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Natural log probability of the last byte of each window."""
        out = np.empty(len(keys))
        for begin in range(0, len(keys), BATCH):
            part = keys[begin:begin + BATCH]
            order = self.coder.by_length(part)
            part = part[order]
            contexts, cost = self.coder.contexts(part), np.zeros(len(part))
            for t, n, node, node_hash, bit in self.coder.steps(part):
                x, gate = self.coder.inputs(self.tables, contexts, n, node_hash, t)
                p = refined(mixed(self.w, x, gate), node, self.refine)
                cost[:n] += np.log(np.where(bit, p, 1 - p))
            out[begin + order] = cost
        return out

    def remembered(self, keys: np.ndarray) -> np.ndarray:
        """Costs of sorted distinct windows; those that were met before are looked up."""
        at = np.searchsorted(self.keys, keys)
        old = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.empty(len(keys))
        out[old] = self.cost[at[old]]
        out[~old] = self.costs(keys[~old])
        if len(self.keys) + len(keys) > self.KNOWN:
            self.keys, self.cost = keys, out
        else:
            self.keys, self.cost = np.insert(self.keys, at[~old], keys[~old]), np.insert(self.cost, at[~old], out[~old])
        return out

    def texts(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in slices([len(t) + 8 for t in texts], SLICE_BYTES):
            keys, sizes = self.coder.texts_windows(texts[a:b])
            distinct = distinct_sorted(keys)
            cost = self.remembered(distinct)
            out[a:b] = np.add.reduceat(cost.take(self.find(keys, distinct)), np.cumsum(sizes) - sizes)
        return out / np.log(10)


def score_block(model_of, n_words: int, n_distinct: int, train_docs: int):
    """For a cogrouped applyInArrow: scores of a block's documents, given the answers to its words."""
    all_tokens, kinds = n_words + train_docs, n_distinct + (train_docs > 0)
    scale = np.log10(all_tokens + 0.1 * (kinds + 1))
    cache: dict = {}

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if "scorer" not in cache:
            cache["scorer"], cache["hasher"] = Scorer(*model_of()), WordHasher()
        texts = text_bytes(docs.column("text").combine_chunks())
        owner, hashes = [], []
        for a, b in slices([len(t) + 1 for t in texts], SLICE_BYTES):
            o, h = words_of(texts[a:b], cache["hasher"])
            owner.append(o + a)
            hashes.append(h)
        owner, hashes = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (owner, hashes))
        keys = distinct_sorted(hashes)
        got = sorted(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True))
        counts = np.concatenate([unpack(blob)[0].astype(np.int64) for _, blob in got]) if got else np.zeros(0, np.int64)
        if len(counts) != len(keys):
            raise RuntimeError("a block's documents changed between two reads of the input")
        own = counts.take(cache["scorer"].find(hashes, keys)) if len(keys) else np.zeros(0, np.int64)
        n = len(texts)
        n_tokens = np.bincount(owner, minlength=n) + 1
        known = np.bincount(owner, weights=own > 0, minlength=n).astype(np.int64) + (train_docs > 0)
        base = np.bincount(owner, weights=np.log10(own + 0.1), minlength=n) + np.log10(train_docs + 0.1) - n_tokens * scale
        score = cache["scorer"].texts(texts)
        bits = np.array([-x * np.log2(10) / len(t) if t else np.nan for x, t in zip(score, texts, strict=True)])
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(known, pa.int64()),
                         "train_tokens": pa.array(np.full(n, all_tokens), pa.int64()), "base_score": pa.array(base, pa.float64()),
                         "score": pa.array(score, pa.float64()), "bits_per_byte": pa.array(bits, pa.float64(), mask=np.isnan(bits))})

    return run


def score(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (null without bytes) of every whole text; held-out rows teach nothing."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = size["n"] // BLOCK_ROWS + size["bytes"] // BLOCK_BYTES + 1
    bucket_bits = max(4, int(blocks).bit_length())  # about as many buckets as blocks: a bucket's words stay as many as a block's
    gathered = materialize(rows.select((~F.col("held_out")).alias("train"), "text").mapInArrow(lean(gather(bucket_bits)), GATHERED), "lm-gathered")
    train_docs = gathered.filter(F.col("kind") == STATS).agg(F.sum("n")).first()[0] or 0

    pieces = (gathered.filter(F.col("kind") == COUNTS).repartition("block", "bucket").sortWithinPartitions("block", "bucket")
              .mapInArrow(lean(sum_counts), GATHERED).select("block", "bucket", "blob").collect())  # the tables' fixed size at most
    tables = [np.zeros(1 << b, np.uint16) for b in SLOT_BITS]
    for r in pieces:
        tables[r["block"]][r["bucket"] << PIECE_BITS:(r["bucket"] + 1) << PIECE_BITS] = unpack(r["blob"])[0]
    held_tables = spark.sparkContext.broadcast(tables)

    parts = (rows.filter(~F.col("held_out")).select("text").mapInArrow(lean(learn_mixer(lambda: held_tables.value)), "blob binary")
             .repartition(8).mapInArrow(sum_mixers, "blob binary").collect())  # eight rows of a fixed size
    weights, refine = Mixer().w, refine_table(np.zeros((2, 255 * CELLS)))
    if parts:
        total = [sum(x) for x in zip(*(unpack(r["blob"]) for r in parts), strict=True)]
        weights, refine = total[0] / total[2][0], refine_table(total[1])

    answers = materialize(gathered.filter(F.col("kind") == WORDS).select("block", "bucket", "blob").repartition("bucket").sortWithinPartitions("bucket")
                          .mapInArrow(lean(answer_words), GATHERED), "lm-answers")
    stats = answers.filter(F.col("kind") == STATS).agg(F.sum("n").alias("n"), F.sum("block").alias("v")).first()
    judge = score_block(lambda: (held_tables.value, weights, refine), stats["n"] or 0, stats["v"] or 0, train_docs)
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    placed = rows.mapInArrow(lean(numbered), "doc_id long, text string, held_out boolean, block long")
    return (placed.groupBy("block").cogroup(answers.filter(F.col("kind") == WORDS).select("block", "bucket", "blob").groupBy("block"))
            .applyInArrow(judge, kinds))
