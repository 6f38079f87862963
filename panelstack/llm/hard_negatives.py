"""Hard-negative mining over Hilbert-ordered candidate blocks with zone maps.

Vectors are sorted along a Hilbert curve and packed, as Parquet rows, into blocks of near
vectors; beside its vectors a block keeps each dimension's least and greatest part (its zone)
and the labels it holds.  From zones alone interval arithmetic bounds every score that an anchor can
reach in a block, which chooses the blocks an anchor has to read: for its positives those whose
upper bound reaches the k-th best same-label score of the anchor's own block, for its negatives those whose
bounds meet one of its score windows.  Anchors travel in the Hilbert order too, so anchors
of a group want the same blocks, and a block travels to the groups that chose it only.

Scores are exact integers of any size: parts are integers held as doubles, products are summed as
doubles where they stay below 2**53 and as Python integers beyond; a score that no long holds is
given as the nearest long, ranked by its exact value.

Defined cases: rows with a null label, a null or empty vector, or null or non-finite parts (also
where the scaled part is no finite double) take no part; vectors meet vectors of their own length
only; rows that repeat an id are rows of their own (an anchor leaves out its own row alone); ties go
to the smaller id, null ids last; null ids are no anchors and keep their label; an anchor without positives or without
negatives in a window has no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstack.llm.common import pack, unpack
from panelstack.session import materialize

#: Rows of a block; blocks whose anchors, whose zones, and whose rows at most meet in one task; bits of a dimension on the curve.
BLOCK_ROWS, ANCHOR_BLOCKS, ZONE_BLOCKS, READ_BLOCKS, BITS = 256, 32, 32, 32, 3
#: Share of the positive's score that a negative may have, as whole numbers of a hundred.
LEAST, MOST = 50, 95


# --- integers of any size -----------------------------------------------------------------------

def order_key(score: int) -> bytes:
    """Bytes that sort like the integer: sign and length, then the magnitude (complemented below zero)."""
    size = (abs(score).bit_length() + 7) // 8
    if score >= 0:
        return struct.pack(">H", 0x8000 + size) + score.to_bytes(size, "big")
    return struct.pack(">H", 0x7FFF - size) + ((1 << 8 * size) - 1 + score).to_bytes(size, "big")


def from_key(key: bytes) -> int:
    head, = struct.unpack(">H", key[:2])
    value = int.from_bytes(key[2:], "big")
    return value if head >= 0x8000 else value - (1 << 8 * (len(key) - 2)) + 1


def as_long(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``x`` with ``q``: int64, or Python integers where they may not fit a double."""
    if not x.size or float(np.abs(x).max()) * float(np.abs(q).max()) * len(q) < 2.0**53:
        return (x @ q).astype(np.int64)
    whole = np.array([int(v) for v in q], object)
    return np.array([int(np.dot(np.array([int(v) for v in row], object), whole)) for row in x], object)


# --- curve ----------------------------------------------------------------------------------------

def hilbert_keys(x: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Place of each row on the Hilbert curve over a grid of 2**bits cells a dimension between ``low`` and ``high``.

    Axes are turned into the curve's transposed index a bit level at a time, all rows at once, and the
    index bits are strung together, the highest level first.
    """
    n, dims = x.shape
    with np.errstate(over="ignore", invalid="ignore"):
        share = np.nan_to_num((x / 2 - low / 2) / np.where(high > low, high / 2 - low / 2, 1.0))
    axes = np.minimum((np.clip(share, 0, 1) * (1 << bits)).astype(np.int64), (1 << bits) - 1).T.copy()
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for d in range(dims):
            # Where the axis has the bit the first axis is reflected, elsewhere the two exchange their lower bits.
            has = (axes[d] & bit) != 0
            swap = np.where(has, 0, (axes[0] ^ axes[d]) & below)
            axes[0] ^= np.where(has, below, swap)
            axes[d] ^= swap
    for d in range(1, dims):
        axes[d] ^= axes[d - 1]
    turned = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        turned ^= np.where((axes[-1] >> level) & 1, (1 << level) - 1, 0)
    axes ^= turned
    index = np.stack([(axes >> level) & 1 for level in range(bits - 1, -1, -1)])  # level, dimension, row
    return [row.tobytes() for row in np.packbits(index.reshape(bits * dims, n).astype(np.uint8).T, axis=1)]


def ranges(batches):
    """For mapInArrow over (dim, vec): least and greatest part of each dimension, a row for each vector length of the task."""
    low, high = {}, {}
    for b in batches:
        dims = np.array(b.column("dim").to_pylist(), np.int64)
        flat, starts = b.column("vec").values.to_numpy(zero_copy_only=False), b.column("vec").offsets.to_numpy()
        for dim in np.unique(dims).tolist():
            x = flat[starts[:-1][dims == dim][:, None] + np.arange(dim)]
            low[dim] = np.minimum(low.get(dim, np.inf), x.min(axis=0))
            high[dim] = np.maximum(high.get(dim, -np.inf), x.max(axis=0))
    if low:
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array([v.tolist() for v in low.values()], pa.list_(pa.float64())), pa.array([v.tolist() for v in high.values()], pa.list_(pa.float64()))],
                                         names=["dim", "low", "high"])


def keyed(spans: dict[int, tuple[list[float], list[float]]]):
    """Function for mapInArrow: adds the curve's key to rows (dim, num, vec_id, label, vec)."""

    def run(batches):
        for b in batches:
            dims = np.array(b.column("dim").to_pylist(), np.int64)
            keys: list = [None] * b.num_rows
            vectors = b.column("vec").to_pylist()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                low, high = (np.array(s) for s in spans[dim])
                for i, k in zip(at.tolist(), hilbert_keys(np.array([vectors[i] for i in at.tolist()], np.float64), low, high), strict=True):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=[*b.schema.names, "key"])

    return run


# --- blocks ---------------------------------------------------------------------------------------

def best_of(found: list, k: int) -> list:
    """The k first of (score, null id, id, num, ...) by score downwards, then id, then row number."""
    return sorted(found, key=lambda r: (-r[0], r[1], r[2], r[3]))[:k]


def blocks_of(anchor_step: int, positives: int):
    """Function for mapInArrow over rows sorted by (dim, key): one row a block, with its zone, labels and anchors.

    An anchor is kept with the k-th best same-label score of its own block, from which its search starts.
    """

    def run(batches):
        from pyspark import TaskContext
        part, made = TaskContext.get().partitionId(), 0
        dim, held = None, []

        def block():
            nums, ids, labels, vecs = zip(*held, strict=True)
            null, ids = np.array([i is None for i in ids]), np.array([i or 0 for i in ids], np.int64)
            nums, labels, x = np.array(nums, np.int64), np.array(labels, np.int64), np.array(vecs, np.float64)
            asks = np.flatnonzero(~null & (ids % anchor_step == 0))
            floors = []
            for a in asks.tolist():
                same = np.flatnonzero((labels == labels[a]) & (nums != nums[a]))
                s = sorted(scores(x[same], x[a]).tolist(), reverse=True)
                floors.append(order_key(int(s[positives - 1])) if len(s) >= positives else b"")
            anchors = pack(ids[asks], nums[asks], labels[asks], x[asks], np.array([f.hex() for f in floors], "S")) if len(asks) else None
            row = ([dim], [part], [made], [x.min(axis=0).tolist()], [x.max(axis=0).tolist()], [np.unique(labels).tolist()], [nums[asks].tolist()], [anchors], [pack(nums, null, ids, labels, x)])
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["dim", "part", "number", "low", "high", "labels", "asks", "anchors", "blob"])

        for b in batches:
            for d, *row in zip(*(b.column(c).to_pylist() for c in ("dim", "num", "vec_id", "label", "vec")), strict=True):
                if held and (d != dim or len(held) >= BLOCK_ROWS):
                    yield block()
                    made, held = made + 1, []
                dim = d
                held.append(row)
        if held:
            yield block()

    return run


class Anchors:
    """Anchors of some blocks side by side, each with score windows [(least, most)] it wants rows from."""

    def __init__(self, blobs: list[bytes], windows: dict[int, list] | None = None):
        parts = [unpack(b) for b in blobs]
        self.ids, self.nums, self.labels, self.x = (np.concatenate([p[i] for p in parts]) for i in range(4))
        floors = [bytes.fromhex(f.decode()) for p in parts for f in p[4].tolist()]
        self.floors = [from_key(f) if f else None for f in floors]
        # Of each window: its anchor's place, the positive's number and rank, least and greatest score.
        self.windows = []
        if windows is not None:
            for i, num in enumerate(self.nums.tolist()):
                for positive, positive_id, rank, key in windows.get(num, ()):
                    p = from_key(key)
                    least, most = -(-LEAST * p // 100), MOST * p // 100
                    if least <= most:
                        self.windows.append((i, positive, positive_id, rank, p, least, most))


def interval(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of ``q`` (anchors x dims) with anything in the box, rounding errors allowed for."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        least, most = up @ low + down @ high, up @ high + down @ low
        slack = 1e-12 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)))
    return np.nan_to_num(least - slack, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(most + slack, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def _as_float(score: int | None, toward: float) -> float:
    """A double on the safe side of the integer."""
    if score is None:
        return -np.inf
    try:
        return float(np.nextafter(float(score), toward))
    except OverflowError:
        return toward if (score > 0) == (toward > 0) else float(np.nextafter(-toward, 0))


def wanted(anchors: Anchors, low, high, labels) -> np.ndarray:
    """Whether the block has to be read, for each anchor (positives) or each window (negatives)."""
    least, most = interval(np.array(low), np.array(high), anchors.x)
    if not anchors.windows:
        floor = np.array([_as_float(f, -np.inf) for f in anchors.floors])
        return np.isin(anchors.labels, labels) & (most >= floor)
    at = np.array([w[0] for w in anchors.windows])
    from_, to = np.array([_as_float(w[5], -np.inf) for w in anchors.windows]), np.array([_as_float(w[6], np.inf) for w in anchors.windows])
    other = (anchors.labels != labels[0]) | (len(labels) > 1)
    return other[at] & (most[at] >= from_) & (least[at] <= to)


def _windows(t: pa.Table) -> dict[int, list] | None:
    """Windows by anchor number, from the column of the second pass."""
    if "windows" not in t.schema.names:
        return None
    out: dict[int, list] = {}
    for rows in t.column("windows").to_pylist():
        for w in rows or ():
            out.setdefault(w["num"], []).append((w["positive_num"], w["positive_id"], w["rank"], w["key"]))
    return out


def choose(asked: pa.Table, zones: pa.Table) -> pa.Table:
    """For a cogrouped applyInArrow over an anchor group and a zone group: the blocks that some anchor has to read."""
    out = []
    if asked.num_rows and zones.num_rows:
        anchors = Anchors(asked.column("anchors").to_pylist(), _windows(asked))
        second = "windows" in asked.schema.names
        for block, low, high, labels in zip(*(zones.column(c).to_pylist() for c in ("block", "low", "high", "labels")), strict=True):
            if (not second or anchors.windows) and wanted(anchors, low, high, labels).any():
                out.append(block)
    dim, group = (zones.column(c)[0].as_py() if out else 0 for c in ("dim", "ag"))
    return pa.table({"dim": pa.array([dim] * len(out), pa.int32()), "ag": pa.array([group] * len(out), pa.int64()), "block": pa.array(out, pa.int64())})


HIT = "num long, vec_id long, positive_num long, positive_id long, positive_rank int, positive_score long, key binary, score long, hit_num long, no_id boolean, hit_id long"


def search(k: int):
    """For a cogrouped applyInArrow over an anchor group and the blocks it chose in a zone group: each anchor's or window's first k rows there.

    Blocks are opened one at a time, those with the highest bounds first; what is found raises the floor for the rest.
    """

    def run(asked: pa.Table, read: pa.Table) -> pa.Table:
        rows = []
        second = "windows" in asked.schema.names
        if asked.num_rows and read.num_rows:
            anchors = Anchors(asked.column("anchors").to_pylist(), _windows(asked))
            todo = []
            for low, high, labels, blob in zip(*(read.column(c).to_pylist() for c in ("low", "high", "labels", "blob")), strict=True):
                todo.append((float(interval(np.array(low), np.array(high), anchors.x)[1].max()), low, high, labels, blob))
            todo.sort(key=lambda t: -t[0])
            slots = len(anchors.windows) if second else len(anchors.nums)
            best: list[list] = [[] for _ in range(slots)]
            for _, low, high, labels, blob in todo:
                want = np.flatnonzero(wanted(anchors, low, high, labels)) if slots else ()
                if not len(want):
                    continue
                nums, null, ids, own, x = unpack(blob)
                last, s = None, None
                for slot in want.tolist():
                    i = anchors.windows[slot][0] if second else slot
                    if i != last:
                        last, s = i, scores(x, anchors.x[i])
                    if second:
                        _, _, _, _, _, least, most = anchors.windows[slot]
                        hit = np.flatnonzero((own != anchors.labels[i]) & (s >= least) & (s <= most))
                    else:
                        hit = np.flatnonzero((own == anchors.labels[i]) & (nums != anchors.nums[i]))
                    if len(hit) > k and s.dtype != object:
                        edge = np.partition(s[hit], len(hit) - k)[len(hit) - k]
                        hit = hit[s[hit] >= edge]
                    new = [(int(s[j]), bool(null[j]), int(ids[j]), int(nums[j])) for j in hit.tolist()]
                    best[slot] = best_of(best[slot] + new, k)
                    if len(best[slot]) == k:
                        worst = best[slot][-1][0]
                        if second:
                            w = anchors.windows[slot]
                            anchors.windows[slot] = (*w[:5], max(w[5], worst), w[6])
                        elif anchors.floors[slot] is None or worst > anchors.floors[slot]:
                            anchors.floors[slot] = worst
            for slot, found in enumerate(best):
                if second:
                    i, positive, positive_id, rank, p, _, _ = anchors.windows[slot]
                else:
                    i, positive, positive_id, rank, p = slot, 0, None, 0, 0
                rows += [(int(anchors.nums[i]), int(anchors.ids[i]), positive, positive_id, rank, as_long(p), order_key(s), as_long(s), num, none, id_) for s, none, id_, num in found]
        cols = list(zip(*rows, strict=True)) or [()] * 11
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        return pa.table({n.split()[0]: pa.array(c, t) for n, c, t in zip(HIT.split(", "), cols, kinds, strict=True)})

    return run


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("key"), "no_id", "hit_id", "hit_num")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def candidate_blocks(rows: DataFrame, anchor_step: int, positives: int) -> DataFrame:
    """Blocks in the order of the curve, written as Parquet: dim, block (0, 1, ... in that order), low, high, labels, asks, anchors, blob."""
    ends = rows.select("dim", "vec").mapInArrow(ranges, "dim int, low array<double>, high array<double>")
    ends = ends.select("dim", F.posexplode(F.arrays_zip("low", "high")).alias("d", "x")).groupBy("dim", "d").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    spans = {r.dim: ([x.low for x in r.all], [x.high for x in r.all]) for r in ends.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("d", "low", "high"))).alias("all")).collect()}
    shape = "dim int, part int, number int, low array<double>, high array<double>, labels array<long>, asks array<long>, anchors binary, blob binary"
    order = ["dim", "key", F.col("vec_id").asc_nulls_last(), "num"]
    ordered = rows.mapInArrow(keyed(spans), "dim int, num long, vec_id long, label long, vec array<double>, key binary").repartitionByRange(*order).sortWithinPartitions(*order)
    made = materialize(ordered.drop("key").mapInArrow(blocks_of(anchor_step, positives), shape), "negative-blocks")
    # Totals of the partitions (as many rows as there are partitions) make the numbers run on.
    before, start = [], 0
    for r in made.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        before.append((r.part, start))
        start += r.n
    starts = made.sparkSession.createDataFrame(before, "part int, start long")
    return made.join(F.broadcast(starts), "part").withColumn("block", F.col("start") + F.col("number")).drop("part", "number", "start")


def _meet(asked: DataFrame, blocks: DataFrame, k: int, anchor_groups: int, zone_blocks: int) -> DataFrame:
    """Choose by zones, then read what was chosen: ``asked`` has dim, ag, anchors and in the second pass windows."""
    zones = blocks.select("dim", "block", "low", "high", "labels", F.expr(f"block div {zone_blocks}").alias("zg"))
    zone_groups = zones.agg(F.max("zg")).first()[0]

    def each(last: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))

    cell = ["dim", "ag", "zg"]
    chosen = _apart(asked.withColumn("zg", each(zone_groups))).groupBy(*cell).cogroup(zones.withColumn("ag", each(anchor_groups)).groupBy(*cell)).applyInArrow(choose, "dim int, ag long, block long")
    reads = materialize(chosen.withColumn("rg", F.expr(f"block div {READ_BLOCKS}")), "negative-reads")
    cell = ["dim", "ag", "rg"]
    read = reads.join(blocks.select("block", "low", "high", "labels", "blob"), "block")
    sent = asked.join(reads.select(*cell).distinct(), ["dim", "ag"])
    return _apart(sent).groupBy(*cell).cogroup(read.groupBy(*cell)).applyInArrow(search(k), HIT)


def _apart(df: DataFrame) -> DataFrame:
    """The same columns under identities of their own, for a cogroup with a table of the same origin."""
    return df.select([F.col(c).alias(c) for c in df.columns])


def mine(vectors: DataFrame, anchor_step: int = 50, positives: int = 5, negatives: int = 3, scale: float = 256.0, flip: tuple[int, int] | None = None,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", anchor_blocks: int = ANCHOR_BLOCKS, zone_blocks: int = ZONE_BLOCKS) -> DataFrame:
    """anchor_id, anchor_num, positive_id, positive_num, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``anchor_step``; ``flip`` (m, c) makes the label (label + 1) mod c
    where the id is divisible by m.  Every group of ``anchor_blocks`` blocks' anchors meets every group of
    ``zone_blocks`` zones, so zones travel as often as there are anchor groups: raise both with the table
    (4096 anchors and as many zones are some megabytes).
    """
    name, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    if flip:
        label = F.when(F.coalesce(name % flip[0] == 0, F.lit(False)), (label + 1) % flip[1]).otherwise(label)
    rows = vectors.select(F.monotonically_increasing_id().alias("num"), name.alias("vec_id"), label.alias("label"),
                          F.transform(F.col(vec_col), lambda x: x.cast("double") * F.lit(scale)).alias("vec"))
    fine = F.col("label").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # From 2**52 on a double is whole; floor() would pass through a long.
    whole = F.transform("vec", lambda x: F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x))
    rows = materialize(rows.filter(fine).select(F.size("vec").alias("dim"), "num", "vec_id", "label", whole.alias("vec")), "negative-rows")
    blocks = candidate_blocks(rows, anchor_step, positives)
    asked = blocks.filter("anchors IS NOT NULL").select("dim", "block", F.expr(f"block div {anchor_blocks}").alias("ag"), "asks", "anchors")
    last = asked.agg(F.max("ag")).first()[0] or 0
    if blocks.isEmpty():
        return blocks.sparkSession.createDataFrame([], NEGATIVES)
    found = _meet(asked.select("dim", "ag", "anchors"), blocks, positives, last, zone_blocks)
    best = materialize(_first(found, ["num"], positives), "negative-positives")
    # The windows go back to the block of their anchor: at most ``positives`` for each of its anchors.
    window = F.struct("num", F.col("hit_num").alias("positive_num"), F.when(~F.col("no_id"), F.col("hit_id")).alias("positive_id"), "rank", "key").alias("w")
    own = asked.select("block", F.explode("asks").alias("num")).join(best.select("num", window), "num").groupBy("block").agg(F.collect_list("w").alias("windows"))
    third = _meet(asked.join(own, "block").select("dim", "ag", "anchors", "windows"), blocks, negatives, last, zone_blocks)
    return (_first(third, ["num", "positive_num"], negatives)
            .select(F.col("vec_id").alias("anchor_id"), F.col("num").alias("anchor_num"), "positive_id", "positive_num", "rank",
                    F.when(~F.col("no_id"), F.col("hit_id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


NEGATIVES = "anchor_id long, anchor_num long, positive_id long, positive_num long, rank int, negative_id long, positive_score long, negative_score long"
