"""Near-duplicates by ProbMinHash over weighted five-word shingles.

A shingle that stands c times in a text has weight c.  Its arrivals form a
Poisson process of rate c, seeded by the shingle; each arrival falls into one of
the registers, a register keeps its first arrival, and a shingle stops as soon as
its next arrival is later than the slowest register of its text.  Equal registers
estimate the probability Jaccard similarity.  Bands of registers give candidates,
their registers a first estimate, and the exact probability Jaccard of the whole
texts decides (0.8 and more).

Texts with equal word sequences are one class from the start, so copies are never
compared.  A bucket's texts are first compared with one of them; after components
are formed, the registers of a bucket's texts that are still in different components
are compared with each other inside tasks, in blocks, so no link between different texts of a bucket is lost, and no
group is expanded into all of its pairs.  What can be lost is what shares no band:
at similarity 0.8 less than one pair in 100,000.

Defined cases: words are runs without ASCII white space, A-Z lower-cased; a text
of fewer than five words is one shingle; a text without words (null, empty) is
alone in its class; rows that repeat an id are rows of their own; null ids are
allowed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstack.llm.common import WordHasher, fresh, lean, mix64, pack, shingles, slices, text_bytes, unpack
from panelstack.llm.components import components
from panelstack.session import materialize

SHINGLE, SIMILARITY = 5, 0.8
#: Registers are dealt into bands first; the rest sharpens the estimate.
BANDS, ROWS, REGISTERS = 40, 6, 720
#: A pair whose registers agree less is not looked at again: 4.5 standard errors below the similarity.
ESTIMATE = SIMILARITY - 4.5 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
BLOCK_BYTES = 4 << 20
#: Members of a bucket that are compared at a time, and rows of a bucket from which it is split.
MEMBERS, SALT_ROWS = 256, 16384
#: Blocks of a bucket that are dealt into one group; two groups meet in one task.
CELL_BLOCKS = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def weighted(text: bytes, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, their counts, and the word hashes of a text."""
    words = hasher(text.lower())[1]
    hashes, counts = np.unique(shingles(words, SHINGLE), return_counts=True)
    return hashes, counts, words


def prob_min_hash(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """(texts, registers) winning shingle hashes; ``owner`` is the text of each (hash, weight); texts without shingles keep 0."""
    first = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    slowest = np.full(texts, np.inf)
    state, clock = hashes.copy(), np.zeros(len(hashes))
    rate = weights.astype(np.float64)
    while len(owner):
        state = state + _STEP
        draw = mix64(state)
        # 53 bits for the waiting time; the register comes from a second mix of the same state.
        clock = clock - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        at = clock / rate
        live = at < slowest[owner]
        owner, state, clock, rate, hashes, at, draw = owner[live], state[live], clock[live], rate[live], hashes[live], at[live], draw[live]
        slot = owner * registers + (mix64(draw ^ _STEP) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        winner[slot[won]] = hashes[won]
        active = np.flatnonzero(np.bincount(owner, minlength=texts))
        slowest[active] = first.reshape(texts, registers)[active].max(axis=1)
    return winner.reshape(texts, registers)


def probability_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Sum over common elements i of 1 / sum_j max(x_j / x_i, y_j / y_i), by sorting the ratios y / x."""
    keys = np.union1d(h1, h2)
    if not len(keys):
        return 0.0
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, h1)], y[np.searchsorted(keys, h2)] = w1, w2
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.cumsum(x)  # x of all with a ratio up to this one
    above = y.sum() - np.cumsum(y)
    common = (x > 0) & (y > 0)
    last = np.searchsorted(ratio, ratio[common], side="right") - 1  # equal ratios count as below
    return float((1 / (below[last] / x[common] + above[last] / y[common])).sum())


def signatures(batches):
    """For mapInArrow: pos, doc_id, two halves of the digest of the words, band hashes, a byte of every register.

    A text without words has null digest and bands.
    """
    hasher = WordHasher()
    salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
    for b in batches:
        texts = text_bytes(b.column("text"))
        for begin, end in slices(list(map(len, texts)), BLOCK_BYTES):
            n = end - begin
            owner, hashes, counts, k1, k2 = [], [], [], [], []
            for i, t in enumerate(texts[begin:end]):
                h, c, words = weighted(t, hasher)
                owner.append(np.full(len(h), i))
                hashes.append(h)
                counts.append(c)
                d = hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None
                k1.append(int.from_bytes(d[:8], "big", signed=True) if d else None)
                k2.append(int.from_bytes(d[8:], "big", signed=True) if d else None)
            sig = prob_min_hash(np.concatenate(owner), np.concatenate(hashes), np.concatenate(counts), n)
            grouped = sig[:, :BANDS * ROWS].reshape(n, BANDS, ROWS)
            band = np.broadcast_to(salt, (n, BANDS)).copy()
            for r in range(ROWS):
                band = mix64(band * np.uint64(31) + grouped[:, :, r])
            band = band.view(np.int64)
            short = (mix64(sig) & np.uint64(255)).astype(np.uint8)
            cut = slice(begin, end)
            yield pa.RecordBatch.from_arrays(
                [b.column("pos")[cut], b.column("doc_id")[cut], pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array([row if k is not None else None for row, k in zip(band, k1, strict=True)], pa.list_(pa.int64())),
                 pa.array([row.tobytes() for row in short], pa.binary())], names=["pos", "doc_id", "k1", "k2", "bands", "sig"])


def agreeing(batches):
    """For mapInArrow over pairs with signatures: the pairs whose registers agree often enough."""
    for b in batches:
        if not b.num_rows:
            continue
        a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint8).reshape(-1, REGISTERS) for x in ("sig_a", "sig_b"))
        keep = pa.array(_share(a, c) >= ESTIMATE)
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])


def similar(batches):
    """For mapInArrow over pairs with texts: a, b and the exact similarity of pairs that reach it."""
    hasher = WordHasher()
    for b in batches:
        out, known, name = [], None, None
        for i, j, s, t in zip(*(b.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
            if i != name:
                name, known = i, weighted((s or "").encode(), hasher)
            h, c, _ = weighted((t or "").encode(), hasher)
            value = probability_jaccard(known[0], known[1], h, c)
            if value >= SIMILARITY - 1e-12:
                out.append((i, j, value))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])


def compare(one: tuple, other: tuple, h: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of bucket ``h`` in different components whose registers agree.

    A pair is reported by the least of its common buckets only.
    """
    (pos_a, root_a, sig_a, band_a), (pos_b, root_b, sig_b, band_b) = one, other
    first, second = [], []
    for i in range(len(pos_a)):
        near = np.flatnonzero(root_b[i + 1:] != root_a[i]) + i + 1 if same else np.flatnonzero(root_b != root_a[i])
        near = near[_share(sig_b[near], sig_a[i]) >= ESTIMATE]
        if len(near):
            common = np.where(band_b[near] == band_a[i], band_a[i], np.iinfo(np.int64).max).min(axis=1)
            near = near[common == h]
            first.append(np.minimum(pos_b[near], pos_a[i]))
            second.append(np.maximum(pos_b[near], pos_a[i]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second))


def _members(held: list) -> tuple:
    pos, roots, sigs, bands = zip(*held, strict=True)
    return np.array(pos, np.int64), np.array(roots, np.int64), np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, REGISTERS), np.array(bands, np.int64)


def pack_blocks(batches):
    """For mapInArrow over (h, salt, n, root, pos, sig, bands) sorted by them: one row for each block of a bucket's members.

    Pairs inside a block are compared at once; the block itself goes on only where its bucket has others.
    """
    key, size, held, number = None, 0, [], 0

    def block():
        own = _members(held)
        a, b = compare(own, own, key[0], True)
        alone = size <= MEMBERS
        if alone and not len(a):
            return None
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1] << 32 | number], pa.int64()), pa.array([held[0][1]], pa.int64()), pa.array([held[-1][1]], pa.int64()),
                                           pa.array([None if alone else pack(*own)], pa.binary()), pa.array([a], pa.list_(pa.int64())), pa.array([b], pa.list_(pa.int64()))],
                                          names=["h", "block", "low", "high", "blob", "a", "b"])

    for x in batches:
        for h, salt, n, *member in zip(*(x.column(c).to_pylist() for c in ("h", "salt", "n", "pos", "root", "sig", "bands")), strict=True):
            if (h, salt) != key or len(held) >= MEMBERS:
                if held and (done := block()):
                    yield done
                number = number + 1 if (h, salt) == key else 0
                key, size, held = (h, salt), n, []
            held.append(member)
    if held and (done := block()):
        yield done


def compare_cell(t: pa.Table) -> pa.Table:
    """For applyInArrow over the blocks of a cell (two groups of a bucket's blocks): arrays a, b of the pairs between blocks of the two."""
    h, one, other = (t.column(c)[0].as_py() for c in ("h", "one", "other"))
    blocks = sorted(zip(t.column("block").to_pylist(), t.column("own").to_pylist(), t.column("low").to_pylist(), t.column("high").to_pylist(), t.column("blob").to_pylist(), strict=True), key=lambda b: b[0])
    opened = [tuple(unpack(b[4])) for b in blocks]
    first, second = [], []
    for i, (_, own, low, high, _) in enumerate(blocks):
        for j in range(i + 1, len(blocks)):
            _, with_, low_j, high_j, _ = blocks[j]
            if (min(own, with_), max(own, with_)) == (one, other) and not low == high == low_j == high_j:
                a, b = compare(opened[i], opened[j], h, False)
                first.append(a)
                second.append(b)
    return pa.table({"a": pa.array([np.concatenate(first) if first else []], pa.list_(pa.int64())), "b": pa.array([np.concatenate(second) if second else []], pa.list_(pa.int64()))})


def _share(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Estimated similarity from the share of equal register bytes."""
    return ((sig == other).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _torn(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(h, pos, n, root) of the members of buckets that hold more than one component."""
    placed = shared.join(roots.select(F.col("node").alias("pos"), "root"), "pos", "left").select("h", "pos", "n", F.coalesce("root", "pos").alias("root"))
    torn = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("h")
    return placed.join(torn, "h", "left_semi")


def _agree(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) whose signatures agree."""
    return (pairs.join(sigs.select(F.col("pos").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("pos").alias("b"), F.col("sig").alias("sig_b")), "b")
            .select("a", "b", "sig_a", "sig_b").mapInArrow(lean(agreeing), "a long, b long"))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with their exact similarity, where it is reached."""
    return (pairs.join(texts.select(F.col("pos").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("pos").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b").mapInArrow(lean(similar), "a long, b long, similarity double"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: pos, doc_id, class_id (least id of its class), class_size, kept (one row a class)."""
    rows = docs.select(F.monotonically_increasing_id().alias("pos"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(rows.mapInArrow(lean(signatures), "pos long, doc_id long, k1 long, k2 long, bands array<long>, sig binary"), "near-signatures")
    # One row for each word sequence; its first position stands for all copies.
    copies = signed.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("pos").alias("rep"))
    sigs = signed.select("pos", "sig")
    members = (signed.select("pos", "bands").join(copies.select(F.col("rep").alias("pos")), "pos", "left_semi")
               .select("pos", F.explode("bands").alias("h")))
    buckets = members.groupBy("h").agg(F.min("pos").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(members.join(buckets, "h"), "near-buckets")  # rows of buckets with company only
    # Whole texts of all documents with company, fetched once.  That side grows with the data: it is never broadcast.
    texts = materialize(rows.select("pos", "text").join(shared.select("pos").distinct().hint("merge"), "pos", "left_semi"), "near-texts")
    # A bucket's texts are compared with its least member first; what this links is one component.
    stars = shared.filter("pos <> hub").select(F.col("hub").alias("a"), F.col("pos").alias("b")).distinct()
    roots = materialize(components(_verify(_agree(stars, sigs), texts).select("a", "b")), "near-roots")
    # Texts that share a bucket and are still apart are compared with each other, block by block.
    apart = (_torn(shared, roots).join(signed.select("pos", "sig", "bands"), "pos")
             .select("h", F.pmod(F.xxhash64("pos"), F.ceil(F.col("n") / SALT_ROWS)).alias("salt"), "n", "root", "pos", "sig", "bands"))
    blocks = materialize(apart.repartition("h", "salt").sortWithinPartitions("h", "salt", "root", "pos")
                         .mapInArrow(lean(pack_blocks), "h long, block long, low long, high long, blob binary, a array<long>, b array<long>"), "near-blocks")
    # Blocks of a bucket are dealt into groups; two groups meet in one task (a cell), so a block travels once a group, not once a block.
    wide = blocks.filter("blob IS NOT NULL").select("h", "block", "low", "high", "blob")
    groups = wide.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / CELL_BLOCKS).alias("groups"))
    dealt = wide.join(groups, "h").withColumn("own", F.pmod(F.xxhash64("block"), F.col("groups")))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    cells = dealt.select("h", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("other"), "own", "block", "low", "high", "blob")
    between = cells.groupBy("h", "one", "other").applyInArrow(compare_cell, "a array<long>, b array<long>")
    across = blocks.select("a", "b").union(between).select(F.inline(F.arrays_zip("a", "b"))).distinct()
    more = _verify(across, texts).select("a", "b")
    final = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    lone = F.coalesce("rep", "pos")
    known = (signed.select("pos", "doc_id", "k1", "k2").join(copies, ["k1", "k2"], "left").select("pos", "doc_id", lone.alias("node"))
             .join(final, "node", "left").select("pos", "doc_id", F.coalesce("root", "node").alias("root")))
    known = materialize(known, "near-known")
    owner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "pos"))
    classes = known.groupBy("root").agg(owner.alias("o"), F.count(F.lit(1)).alias("class_size"))
    return (known.join(classes, "root")
            .select("pos", "doc_id", F.col("o.doc_id").alias("class_id"), "class_size", (F.col("pos") == F.col("o.pos")).alias("kept")))


def drop_near(docs: DataFrame) -> DataFrame:
    """The documents with one of each class, all columns as they were.  ``docs`` is read several times and should be a stored table."""
    pos = fresh(docs, "__pos")
    lost = near_classes(docs).filter(~F.col("kept")).select(F.col("pos").alias(pos))
    return docs.withColumn(pos, F.monotonically_increasing_id()).join(lost, pos, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
