"""Exact top-k inner products by aggregation without random access.

Vectors are packed into blocks; a block keeps one sorted list for each dimension.
A query reads all lists from the end that its weight's sign favours, in layers.
What is read counts in full, what is not read lies between the list's far end
and the point reached (the frontier), which gives every candidate a lower and an
upper bound.  Once the k-th best lower bound (or score so far) beats the upper
bounds of all others, the reading stops; only those still open get their scores
resolved, in exact integers.  Queries and candidates meet block by block.

Defined cases: vectors that are null, empty or hold null or non-finite parts take
no part; vectors meet only vectors of their own length; rows that repeat an id
are rows of their own (a query leaves out its own row alone); ties go to the
smaller id, null ids last; parts may be of any size: products are summed as doubles while
they stay below 2**53 and as Python integers beyond, a score that no long holds is given as the nearest
long and ranked by its exact value; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstack.llm.common import pack, unpack
from panelstack.llm.hard_negatives import as_long, order_key
from panelstack.llm.hard_negatives import scores as whole_scores
from panelstack.session import materialize

#: Rows of a candidate block and of a query block; share of the lists read before each look at the bounds.
BLOCK_ROWS, QUERY_ROWS, LAYERS = 4096, 1024, (0.35, 0.5, 0.7)
#: Blocks of a group (of queries, of candidates); two groups meet in one task.
GROUP_BLOCKS = 4


def scaled(vectors: list, scale: float) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector, whole numbers held as doubles; None for those that take no part."""
    out = []
    for v in vectors:
        if not v or None in v:
            out.append(None)
            continue
        with np.errstate(over="ignore"):
            x = np.floor(np.asarray(v, np.float64) * scale)
        out.append(x if np.isfinite(x).all() else None)
    return out


def pack_blocks(scale: float, rows: int):
    """Function for mapInArrow over rows sorted by (dim, id): blocks of ids, row numbers and integer vectors."""

    def run(batches):
        dim, ids, nums, vecs, made = None, [], [], [], 0

        def block():
            null = np.array([i is None for i in ids])
            blob = pack(np.array([i or 0 for i in ids], np.int64), null, np.array(nums, np.int64), np.stack(vecs))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([nums[0]], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([blob], pa.binary())],
                                              names=["dim", "block", "n", "blob"])

        for b in batches:
            cols = (b.column("num").to_pylist(), b.column("vec_id").to_pylist(), scaled(b.column("vec").to_pylist(), scale))
            for num, i, v in zip(*cols, strict=True):
                if v is None:
                    continue
                if ids and (len(v) != dim or len(ids) >= rows):
                    yield block()
                    ids, nums, vecs = [], [], []
                dim = len(v)
                ids.append(i)
                nums.append(num)
                vecs.append(v)
        if ids:
            yield block()

    return run


class Lists:
    """A block of candidates with a sorted list for each dimension."""

    def __init__(self, vectors: np.ndarray):
        self.x = vectors.astype(np.float64)
        self.sorted = np.sort(self.x, axis=0)

    def upper(self, up: np.ndarray, down: np.ndarray, depth: float, rows) -> np.ndarray:
        """Upper bounds (rows x queries) once a share ``depth`` of every list is read.

        ``up``/``down`` are the positive and the negative weights; lists are read from
        the top for the first and from the bottom for the second.
        """
        n = len(self.sorted)
        d = min(n - 1, int(depth * n))
        x = self.x[rows]
        return np.maximum(x, self.sorted[n - 1 - d]) @ up + np.minimum(x, self.sorted[d]) @ down


def search_block(lists: Lists, ids, null, nums, q, q_nums, best, k: int, layers=LAYERS) -> None:
    """Fold one block into ``best``: for each query a list of (-score, null id, id, num), sorted, at most k."""
    qf = q.astype(np.float64).T
    up, down = np.maximum(qf, 0), np.minimum(qf, 0)
    exact = float(np.abs(lists.x).max(initial=0)) * float(np.abs(qf).max(initial=0)) * max(1, q.shape[1]) < 2**53
    with np.errstate(over="ignore"):
        slack = 0.0 if exact else 1e-9 * float(np.abs(lists.x).max()) * np.abs(qf).sum(axis=0)
    open_q = np.arange(len(q))
    floor = np.array([np.nextafter(float(-b[k - 1][0]), -np.inf) if len(b) >= k else -np.inf for b in best], np.float64)
    if np.isinf(floor).any():
        # No k results yet: the lists' far ends give lower bounds, and the k-th best of them the first floor.
        low = np.minimum(lists.x, lists.sorted[-1]) @ up + np.maximum(lists.x, lists.sorted[0]) @ down
        if len(low) > k + 1:
            kth = np.partition(low, len(low) - k - 1, axis=0)[len(low) - k - 1]  # one of them may be the query's own row
            floor = np.maximum(floor, kth - slack)
    rows = np.arange(len(ids))
    alive = None
    for depth in layers:
        if not len(open_q) or not len(rows):
            break
        bound = lists.upper(up[:, open_q], down[:, open_q], depth, rows) + (slack if np.isscalar(slack) else slack[open_q])
        alive = bound >= floor[open_q]  # ties may still win by a smaller id
        keep_rows, keep_q = alive.any(axis=1), alive.any(axis=0)
        rows, open_q, alive = rows[keep_rows], open_q[keep_q], alive[np.ix_(keep_rows, keep_q)]
    if alive is None or not alive.size:
        return
    if exact:
        scores = (lists.x[rows] @ qf[:, open_q]).astype(np.int64)
    else:
        scores = np.stack([whole_scores(lists.x[rows], qf[:, j]).astype(object) for j in open_q], axis=1)
    for j, qi in enumerate(open_q.tolist()):
        at = np.flatnonzero(alive[:, j] & (scores[:, j] >= floor[qi]) & (nums[rows] != q_nums[qi]))
        if len(at) > k:
            s = scores[at, j]
            kth = np.sort(s)[len(s) - k]
            at = at[s >= kth]
            r = rows[at]
            at = at[np.lexsort((nums[r], ids[r], null[r], -scores[at, j]))[:k]]
        r = rows[at]
        new = zip((-scores[at, j]).tolist(), null[r].tolist(), ids[r].tolist(), nums[r].tolist(), strict=True)
        best[qi] = sorted([*best[qi], *new])[:k]


def nra(k: int):
    """For a cogrouped applyInArrow over a cell's query blocks and candidate blocks: each query's best rows of the cell."""

    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = []
        queries = [unpack(q) for q in asked.column("blob").to_pylist()]
        best = [[[] for _ in q[0]] for q in queries]
        held = sorted(zip(blocks.column("block").to_pylist(), blocks.column("blob").to_pylist(), strict=True))
        for _, blob in held:  # one candidate block is open at a time
            ids, null, nums, vecs = unpack(blob)
            lists = Lists(vecs)
            for q, found in zip(queries, best, strict=True):
                search_block(lists, ids, null, nums, q[3], q[2], found, k)
        for q, found in zip(queries, best, strict=True):
            rows += [(int(i), int(num), order_key(-hit[0]), as_long(-hit[0]), *hit[1:]) for i, num, hits in zip(q[0], q[2], found, strict=True) for hit in hits]
        cols = list(zip(*rows, strict=True)) or [()] * 7
        names = ("query_id", "query_num", "key", "score", "no_id", "vec_id", "num")
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, kinds, strict=True)})

    return run


def top_k(vectors: DataFrame, queries: F.Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, query_num (tells repeated ids apart), rank, vec_id, score of each query's k best rows.

    ``queries`` is a condition on ``vec_id``.  Query blocks and candidate blocks are dealt
    into groups of about GROUP_BLOCKS; a cell is one group of each, so queries and
    candidates of one dimension meet once, and no task holds more than two groups.
    A cell gives k rows a query at most; those are ranked last.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).withColumn("num", F.monotonically_increasing_id())
    rows = materialize(rows.filter(F.col("vec").isNotNull()), "topk-rows").withColumn("dim", F.size("vec"))
    order = ["dim", F.col("vec_id").asc_nulls_last(), "num"]
    shape = "dim int, block long, n int, blob binary"
    blocks = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack_blocks(scale, BLOCK_ROWS), shape), "topk-blocks")
    asked = materialize(rows.filter(queries).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack_blocks(scale, QUERY_ROWS), shape), "topk-queries")
    q_groups, c_groups = (-(-t.count() // GROUP_BLOCKS) or 1 for t in (asked, blocks))

    def group(n: int) -> F.Column:
        return F.pmod(F.xxhash64("block"), F.lit(n))

    def all_of(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    cells_q = asked.select("dim", "block", "blob", group(q_groups).alias("qg")).withColumn("cg", all_of(c_groups))
    cells_c = blocks.select("dim", "block", "blob", group(c_groups).alias("cg")).withColumn("qg", all_of(q_groups))
    key = ["dim", "qg", "cg"]
    found = cells_q.groupBy(*key).cogroup(cells_c.groupBy(*key)).applyInArrow(nra(k), "query_id long, query_num long, key binary, score long, no_id boolean, vec_id long, num long")
    w = Window.partitionBy("query_num").orderBy(F.desc("key"), "no_id", "vec_id", "num")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "query_num", "rank", F.when(~F.col("no_id"), F.col("vec_id")).alias("vec_id"), "score"))
