"""Exact duplicates by Patricia tries.

Every task inserts its whole normalised texts into a compressed radix trie
(map-side combine: a text leaves a task once, with its best row and its count),
so a group of copies costs one row a task however large it is.  A trie over its
byte budget spills its heaviest subtrees downstream.  The rows are then dealt by
(byte length, content hash) and sorted by both; each run of equal keys goes into
a small trie that compares full byte strings.  Members find their class by
length and SHA-256.

Defined cases: null text counts as empty, and empty texts are copies of each
other; of repeated ids the later row of the input wins; null ids lose to any id;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstack.llm.common import fresh, lean, text_bytes

#: Bytes of text that a task's trie holds before it spills.
TRIE_BYTES = 64 << 20


def common_length(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving (slices compare in C)."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1  # a[:low] is common; the prefix is at most high long
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    __slots__ = ("edge", "kids", "best", "count")

    def __init__(self, edge: bytes):
        self.edge, self.kids, self.best, self.count = edge, {}, None, 0


class Patricia:
    """Compressed radix trie from byte strings to (best key of the rows, number of rows)."""

    def __init__(self, budget: int | None = None):
        self.root, self.budget, self.held, self.under = Node(b""), budget, 0, {}

    def add(self, text: bytes, key: tuple, count: int = 1) -> None:
        node, at, n = self.root, 0, len(text)
        fresh = False
        while at < n:
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Node(text[at:])
                node, fresh = kid, True
                break
            edge = kid.edge
            same = common_length(edge, text[at:at + len(edge)])
            if same < len(edge):  # split the edge
                upper = node.kids[text[at]] = Node(edge[:same])
                kid.edge = edge[same:]
                upper.kids[kid.edge[0]] = kid
                kid = upper
            node, at = kid, at + same
        if node.best is None or key > node.best:
            node.best = key
        node.count += count
        if self.budget and fresh:
            self.held += n
            self.under[text[0]] = self.under.get(text[0], 0) + n

    def walk(self, first: int | None = None):
        """(text, best, count) of every terminal, below one first byte or everywhere."""
        stack = [(b"", self.root)] if first is None else [(b"", self.root.kids[first])]
        while stack:
            prefix, node = stack.pop()
            prefix += node.edge
            if node.best is not None:
                yield prefix, node.best, node.count
            stack.extend((prefix, k) for k in node.kids.values())

    def spill(self):
        """Give up the heaviest subtrees until half the budget is free."""
        while self.budget and self.held > self.budget // 2 and self.under:
            first = max(self.under, key=self.under.get)
            yield from self.walk(first)
            del self.root.kids[first]
            self.held -= self.under.pop(first)


def digest_members(batches):
    """pos, doc_id, byte length and SHA-256 of each normalised text."""
    for b in batches:
        texts = [t.lower() for t in text_bytes(b.column("text"))]  # bytes.lower() touches A-Z only
        yield pa.RecordBatch.from_arrays(
            [b.column("pos"), b.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()),
             pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], names=["pos", "doc_id", "n_bytes", "sha"])


def _rows(entries, limit: int = 8 << 20):
    """Batches of (n_bytes, hash, body, best_id, best_pos, n) from trie terminals."""
    held, size = [], 0

    def batch():
        bodies = [e[0] for e in held]
        digests = [hashlib.sha256(t).digest() for t in bodies]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(map(len, bodies)), pa.int64()),
             pa.array([int.from_bytes(d[8:16], "big", signed=True) for d in digests], pa.int64()), pa.array(bodies, pa.binary()),
             pa.array([e[1][1] if e[1][0] else None for e in held], pa.int64()), pa.array([e[1][2] for e in held], pa.int64()),
             pa.array([e[2] for e in held], pa.int64())], names=["n_bytes", "hash", "body", "best_id", "best_pos", "n"])

    for e in entries:
        held.append(e)
        size += len(e[0]) + 64
        if size > limit:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


ENTRY = "n_bytes long, hash long, body binary, best_id long, best_pos long, n long"


def combine_locally(largest: bool = True, budget: int = TRIE_BYTES):
    """Function for mapInArrow: one row for each distinct text of a task (or of what was spilt at once)."""

    def entries(batches):
        trie = Patricia(budget)
        for b in batches:
            ids, poss = b.column("doc_id").to_pylist(), b.column("pos").to_pylist()
            for t, i, p in zip(text_bytes(b.column("text")), ids, poss, strict=True):
                trie.add(t.lower(), _key(i, p, largest))
                if trie.held > budget:
                    yield from trie.spill()
        yield from trie.walk()

    return lambda batches: _rows((t, _plain(k, largest), n) for t, k, n in entries(batches))


def _key(doc_id, pos, largest: bool) -> tuple:
    """Sorts rows so that the one to keep is the greatest."""
    if doc_id is None:
        return (0, 0, pos)
    return (1, doc_id, pos) if largest else (1, -doc_id, pos)


def _plain(key: tuple, largest: bool) -> tuple:
    return key if largest else (key[0], -key[1], key[2])


def merge_owners(largest: bool = True):
    """Function for mapInArrow over entries sorted by (n_bytes, hash): one row for each distinct text."""

    def classes(batches):
        run, trie = None, Patricia()
        for b in batches:
            lens, hashes, bodies = (b.column(c).to_pylist() for c in ("n_bytes", "hash", "body"))
            ids, poss, counts = (b.column(c).to_pylist() for c in ("best_id", "best_pos", "n"))
            for i in range(len(lens)):
                if run != (lens[i], hashes[i]):
                    yield from trie.walk()
                    run, trie = (lens[i], hashes[i]), Patricia()
                trie.add(bodies[i], _key(ids[i], poss[i], largest), counts[i])
        yield from trie.walk()

    def owners(batches):
        held = []

        def batch():
            keys = [_plain(k, largest) for _, k, _ in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([t[0] for t, _, _ in held], pa.int64()), pa.array([t[1] for t, _, _ in held], pa.binary()),
                 pa.array([k[1] if k[0] else None for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64()),
                 pa.array([n for _, _, n in held], pa.int64())], names=["n_bytes", "sha", "keep_id", "keep_pos", "group_size"])

        for text, key, n in classes(batches):
            held.append(((len(text), hashlib.sha256(text).digest()), key, n))
            if len(held) >= 8192:
                yield batch()
                held = []
        if held:
            yield batch()

    return owners


def exact_owners(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """One row a document: doc_id, pos, keep_id, group_size, kept, text_sha256.

    ``keep``: "max" or "min", the identifier that owns a group.  ``pos`` tells rows with one id apart.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep must be 'max' or 'min'")
    largest = keep == "max"
    rows = docs.select(F.monotonically_increasing_id().alias("pos"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    members = rows.mapInArrow(lean(digest_members), "pos long, doc_id long, n_bytes long, sha binary")
    owners = (rows.mapInArrow(lean(combine_locally(largest, budget)), ENTRY)
              .repartition("n_bytes", "hash").sortWithinPartitions("n_bytes", "hash")
              .mapInArrow(lean(merge_owners(largest)), "n_bytes long, sha binary, keep_id long, keep_pos long, group_size long"))
    return (members.join(owners, ["n_bytes", "sha"])  # a hot class is one owner row: AQE splits the members' side
            .select("pos", "doc_id", "keep_id", "group_size", (F.col("pos") == F.col("keep_pos")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")))


def keep_owners(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The documents without their exact duplicates, all columns as they were.  ``docs`` is read twice and should be a stored table."""
    pos = fresh(docs, "__pos")
    lost = exact_owners(docs, keep).filter(~F.col("kept")).select(F.col("pos").alias(pos))
    return docs.withColumn(pos, F.monotonically_increasing_id()).join(lost, pos, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
