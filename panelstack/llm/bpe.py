"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A block of documents is cut into pieces by the public pattern; its distinct
pieces are laid out in one array of byte ids.  An inverted index from merge rank
to positions then replays the merges in rank order over all pieces at once: a
merge touches its positions only, and re-indexes just their two neighbours.
Each task replays its own blocks, so nothing is shuffled.  Ids equal those of
the tiktoken library for the same ranks: a piece that is itself a token stays
whole, the lowest rank goes first and, in a piece, the leftmost of equal ranks.

Defined cases: null text counts as empty (no ids, empty digests); pieces of any
length are merged whole; repeated rows give repeated results; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstack.llm.common import lean, slices

#: Bytes of text whose pieces are merged together, and pieces that a task remembers.
BLOCK_BYTES = 2 << 20
MEMO_PIECES = 250_000
_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """Tokens by id and the rank that joins each pair of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for t, r in ranks.items():
            self.tokens[r] = t
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        keys, to = [], []
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    to.append(r)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(to, np.int32)[order]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], _NONE)

    def one(self, piece: bytes) -> list[int]:
        """Plain merge of a single piece."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], _NONE), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; merges run in rank order over all pieces."""
        whole = [self.ranks.get(p) for p in pieces]
        todo = [i for i, w in enumerate(whole) if w is None and pieces[i]]
        out: list = [[w] if w is not None else [] for w in whole]
        if not todo:
            return out
        sizes = np.array([len(pieces[i]) for i in todo])
        n, ends = int(sizes.sum()), np.cumsum(sizes)
        ids = self.byte_id[np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prv[ends - sizes] = -1
        alive, rank_at = np.ones(n, bool), np.full(n, _NONE, np.int32)
        odd: set[int] = set()
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(positions: np.ndarray, now: int) -> None:
            """Index the pairs that begin at these positions."""
            follow = nxt[positions]
            ranks = np.where(follow >= 0, self.rank(ids[positions], ids[np.maximum(follow, 0)]), _NONE)
            rank_at[positions] = ranks
            good = ranks != _NONE
            positions, ranks = positions[good], ranks[good]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, group in zip(ranks[np.r_[0, cuts]].tolist(), np.split(positions, cuts), strict=True):
                if r < now:  # a lower rank came up late: such a piece is merged alone
                    odd.update(np.searchsorted(ends, group, side="right").tolist())
                elif r in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    heapq.heappush(heap, r)

        put(np.arange(n), -1)
        while heap:
            r = heapq.heappop(heap)
            groups = index.pop(r)
            at = np.unique(np.concatenate(groups)) if len(groups) > 1 else np.sort(groups[0])
            at = at[alive[at] & (rank_at[at] == r)]
            if not len(at):
                continue
            if len(at) > 1:
                clash = nxt[at[:-1]] == at[1:]  # the second starts with the token that the first takes
                if clash.any():
                    start = np.r_[True, ~clash]
                    run_begin = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                    odd_one = (np.arange(len(at)) - run_begin) % 2 == 1
                    at = at[~odd_one]
            right = nxt[at]
            after = nxt[right]
            ids[at] = r
            alive[right] = False
            rank_at[right] = _NONE
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            touched = np.concatenate([at, before[before >= 0]])
            put(np.unique(touched) if len(touched) > 1 else touched, r)
        kept = np.flatnonzero(alive)
        bounds = np.searchsorted(kept, ends)
        flat, begin = ids[kept].tolist(), 0
        for k, (i, end) in enumerate(zip(todo, bounds.tolist(), strict=True)):
            out[i] = self.one(pieces[i]) if k in odd else flat[begin:end]
            begin = end
        return out


class Numbers(dict):
    """Numbers of pieces in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def digests(ranks: dict[bytes, int], pattern: str, block_bytes: int = BLOCK_BYTES):
    """Function for mapInArrow: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A block's rows leave Arrow block by block, and its texts keep the numbers of their pieces only: the
    strings of one text's pieces stand at a time, besides those of the distinct ones.
    """

    def run(batches):
        import regex
        merges, cut, number, lines, raw = Merges(ranks), regex.compile(pattern), Numbers(), [], []
        for b in batches:
            texts, counts, id_sha, out_sha = b.column("text"), [], [], []
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for begin, end in slices(sizes, block_bytes):
                held = [np.fromiter(map(number.__getitem__, cut.findall(t or "")), np.int32) for t in texts.slice(begin, end - begin).to_pylist()]
                for ids in merges.replay([p.encode() for p in islice(number, len(lines), None)]):
                    lines.append(" ".join(map(str, ids)))
                    raw.append(b"".join(map(merges.tokens.__getitem__, ids)))
                for pieces in held:
                    pieces = pieces.tolist()
                    line = " ".join(map(lines.__getitem__, pieces))
                    counts.append(line.count(" ") + 1 if line else 0)
                    id_sha.append(hashlib.sha256(line.encode()).hexdigest())
                    out_sha.append(hashlib.sha256(b"".join(map(raw.__getitem__, pieces))).hexdigest())
                if len(number) > MEMO_PIECES:
                    for memo in (number, lines, raw):
                        memo.clear()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_sha, pa.string()), pa.array(out_sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the token ids of each whole text."""

    def run(batches):
        import regex
        merges, cut = Merges(ranks), regex.compile(pattern)
        for b in batches:
            texts = [t if t is not None else "" for t in b.column("text").to_pylist()]
            for begin, end in slices(list(map(len, texts)), BLOCK_BYTES):
                pieces = [[p.encode() for p in cut.findall(t)] for t in texts[begin:end]]
                new = list({p for ps in pieces for p in ps})
                memo = dict(zip(new, merges.replay(new), strict=True))
                ids = [[i for p in ps for i in memo[p]] for ps in pieces]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(begin, end - begin), pa.array(ids, pa.list_(pa.int32()))],
                                                 names=["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode(ids: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text bytes of each list of ids (null: no bytes)."""

    def run(batches):
        tokens = {r: t for t, r in ranks.items()}
        for b in batches:
            raw = [b"".join(tokens[i] for i in row or ()) for row in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "body"])

    return ids.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, body binary")


def encode_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text; count and digests of ids and decoded bytes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(digests(ranks, pattern)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
