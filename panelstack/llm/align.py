"""Cross-tokenizer alignment with corpus-wide pair counts by external spill counting.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (pieces, which add
the space) the text.  Byte offsets where tokens of both end cut them into groups; an A and
a B token of one group are linked.  How many documents hold an id pair linked is counted
so:

* a task makes blocks of documents; a block keeps its records (document, pair, links) and
  spills its distinct pairs with their numbers of documents as one zstandard run for each
  radix of the A id, ordered by A id, then B id (side-major);
* runs of a radix are merged k at a time, by a heap of the last pairs of their open chunks,
  level after level until one merge is left; that one meets all pairs of an A id next to each
  other, so the A id's maximum is known as soon as its last pair has passed;
* every merge hands back to its runs the totals of their own pairs, down to the blocks, whose
  records turn them into sums a document.

No task holds more than a block or FAN_IN open chunks and a radix' distinct pairs, whatever
pair or A id is frequent: a pair stands once in a run, however many documents hold it.

Both tokenizers work word by word (no piece of B has a space after another character, and A
cuts before a space), so a text is cut where a single space parts two other characters and
each distinct word is encoded once a task.

Defined cases: null and empty texts, and texts whose joined token bytes differ from space
and text (such as those that hold U+2581), have no tokens: zeros and an empty digest; rows that
repeat an id are rows of their own and documents of their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstack.llm.common import lean, mix64, pack, release, unpack
from panelstack.session import materialize

#: Text bytes of a block; radixes of the A id; runs of a merge; records of a run's chunk.
BLOCK_BYTES, RADIXES, FAN_IN, CHUNK = 8 << 20, 64, 32, 1 << 16
#: Words a task holds after a block before it forgets all but the often used ones (half as many, 16 MB at most); words that are encoded side by side (4096 * 2 at most fit their number's bits).
WORDS, TOGETHER = 200_000, 8192
_CUT, _ODD = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s | \s|^\s|\s$")


def words_of(text: str) -> list[str]:
    """The text cut at single spaces between two characters that are none, those spaces left out."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b


def radix_of(pairs: np.ndarray) -> np.ndarray:
    return (mix64((pairs >> 32).astype(np.uint64)) % np.uint64(RADIXES)).astype(np.int64)


class Tokenizers:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, path_a: str, path_b: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # The printable stand-ins of byte-level entries: printable bytes stand for themselves, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = [x for x in range(256) if x not in plain]
        stand = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(spare)}
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.bytes_a = [bytes(stand[c] for c in t) if (t := self.a.id_to_token(i)) and all(c in stand for c in t) else (t or "").encode() for i in range(size)]
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            self.bytes_b.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        self.len_a, self.len_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))

        # Ids as text with what follows them: for A a comma or, behind a group's last, a bar; for B a comma, a group's end or a word's end.
        self.text_a = np.array([f"{i}{end}" for i in range(size) for end in ",|"], object)
        self.text_b = np.array([f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;\0"], object)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A for the words with a space before each, of B for the words with spaces between; None where bytes differ."""
        text = " ".join(words)
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a, bytes_b, meant = self.bytes_a, self.bytes_b, (" " + text).encode()
        if b"".join([bytes_a[x] for x in a]) != meant or b"".join([bytes_b[x] for x in b]) != meant:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


class Words:
    """What is known of distinct words: ids by group as text, counts, linked pairs."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.uses = np.zeros(0, np.int64)
        self.digest: list[str] = []
        self.sizes = np.zeros((0, 5), np.int64)  # n_a, n_b, groups, links, 1 where the bytes differ
        self.starts, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def used(self, at: np.ndarray) -> None:
        """Count a block's words; once many are held, forget those that are not used again (called between blocks)."""
        counts = np.bincount(at, minlength=len(self.digest))
        counts[:len(self.uses)] += self.uses
        self.uses = counts
        if len(self.index) <= WORDS and sum(map(len, self.digest)) + sum(map(len, self.index)) <= 32 << 20:
            return
        names, often = list(self.index), np.flatnonzero(counts > 1)
        often = often[np.argsort(-counts[often], kind="stable")][:WORDS // 2]
        sizes = np.array([len(names[i]) + len(self.digest[i]) for i in often.tolist()], np.int64)
        kept = np.sort(often[np.cumsum(sizes) <= 16 << 20])
        reps = self.starts[kept + 1] - self.starts[kept]
        place = ranges(self.starts[kept], reps)
        self.index = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.digest, self.sizes, self.uses = [self.digest[i] for i in kept.tolist()], self.sizes[kept], counts[kept] // 2
        self.starts, self.pairs, self.times = np.concatenate([[0], np.cumsum(reps)]), self.pairs[place], self.times[place]

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts one after another, and each text's number of words."""
        parts, index = [words_of(t) for t in texts], self.index
        fresh = [w for w in dict.fromkeys(chain.from_iterable(parts)) if w not in index]
        if fresh:
            self._learn(fresh)
            index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
        return np.fromiter(map(index.__getitem__, chain.from_iterable(parts)), np.int64), np.array([len(p) for p in parts], np.int64)

    def _learn(self, words: list[str]) -> None:
        begin = 0
        for i, w in enumerate(words):  # words with white space at an end cannot stand side by side
            if not w or w[0].isspace() or w[-1].isspace():
                self._join(words[begin:i])
                self._join([w])
                begin = i + 1
            elif i - begin >= TOGETHER:
                self._join(words[begin:i])
                begin = i
        self._join(words[begin:])

    def _join(self, words: list[str]) -> None:
        """Encode words side by side; where bytes differ, the halves apart."""
        if not words:
            return
        ids = self.tokenizers.encode(words)
        if ids is not None:
            self._add(words, *ids)
        elif len(words) > 1:  # halves, down to the words whose bytes differ
            self._join(words[:len(words) // 2])
            self._join(words[len(words) // 2:])
        else:
            self.digest.append("")
            self.sizes = np.concatenate([self.sizes, [[0, 0, 0, 0, 1]]])
            self.starts = np.append(self.starts, self.starts[-1])

    def _add(self, words: list[str], a: np.ndarray, b: np.ndarray) -> None:
        t, n = self.tokenizers, len(words)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        group_a, group_b, cuts = groups(t.len_a[a], t.len_b[b])
        word = np.searchsorted(ends, cuts)  # of each group: a word's end is a cut
        word_a = word[group_a]
        size_a, size_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        sizes = np.stack([np.bincount(word, x, n) for x in (size_a, size_b, np.ones(len(cuts)), size_a * size_b, np.zeros(len(cuts)))], axis=1).astype(np.int64)
        reps = size_b[group_a]
        first = (np.cumsum(size_b) - size_b)[group_a]
        key, times = np.unique(np.repeat(word_a << 44 | a << 22, reps) | b[ranges(first, reps)], return_counts=True)
        self.sizes = np.concatenate([self.sizes, sizes])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.bincount(key >> 44, minlength=n))])
        self.pairs, self.times = np.concatenate([self.pairs, pair_key(key >> 22 & 0x3FFFFF, key & 0x3FFFFF)]), np.concatenate([self.times, times])
        # The digests: A's tokens of a group, then B's, each with what follows it.
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[ends_a - 1] = 1
        end_b[ends_b - 1] = 1 + np.r_[word[1:] != word[:-1], True]
        said = np.empty(len(a) + len(b), object)
        said[np.arange(len(a)) + (ends_b - size_b)[group_a]] = t.text_a[2 * a + end_a]
        said[np.arange(len(b)) + ends_a[group_b]] = t.text_b[3 * b + end_b]
        self.digest += "".join(said.tolist()).split("\0")[:n]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of all ranges one after another."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def groups(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group number of each A and each B token from their byte lengths, and the offsets at which groups end."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    cuts = np.intersect1d(*(e[np.diff(e, prepend=-1) > 0] for e in (end_a, end_b)), assume_unique=True)
    return np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), cuts


def spilled(pairs: np.ndarray, values: np.ndarray) -> bytes:
    """A run: chunks of sorted pairs (as differences) and values, each a zstandard frame behind its length."""
    import zstandard
    squeeze, out = zstandard.ZstdCompressor(level=3).compress, []
    for i in range(0, len(pairs), CHUNK):
        p = pairs[i:i + CHUNK]
        frame = squeeze(np.concatenate([np.diff(p, prepend=np.int64(0)), values[i:i + CHUNK]]).tobytes())
        out += [struct.pack("<I", len(frame)), frame]
    return b"".join(out)


def chunks(run: bytes):
    """The chunks of a run, (pairs, values), opened one at a time."""
    import zstandard
    open_, at = zstandard.ZstdDecompressor().decompress, 0
    while at < len(run):
        n, = struct.unpack_from("<I", run, at)
        both = np.frombuffer(open_(run[at + 4:at + 4 + n]), np.int64)
        at += 4 + n
        yield np.cumsum(both[:len(both) // 2]), both[len(both) // 2:]


def whole(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    parts = list(chunks(run)) or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts])


def merged(runs: list[bytes]):
    """(pairs, summed values) of all runs in order, piece by piece; one chunk of each run is open.

    The heap holds the last pair of every open chunk: up to the least of them all runs are complete.
    """
    streams = [chunks(r) for r in runs]
    head: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def more(i: int) -> None:
        if (c := next(streams[i], None)) is not None:
            head[i] = c
            heapq.heappush(heap, (int(c[0][-1]), i))

    for i in range(len(streams)):
        more(i)
    while heap:
        least, _ = heap[0]
        keys, values = [], []
        while heap and heap[0][0] == least:
            _, i = heapq.heappop(heap)
            p, v = head.pop(i)
            keys.append(p)
            values.append(v)
            more(i)
        for i, (p, v) in head.items():
            cut = int(np.searchsorted(p, least, "right"))
            if cut:
                keys.append(p[:cut])
                values.append(v[:cut])
                head[i] = p[cut:], v[cut:]
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        yield key, np.bincount(at, np.concatenate(values), len(key)).astype(np.int64)


def totals(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = list(merged(runs)) or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts])


def with_best(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """2 * count, plus 1 where the count is the highest of the pair's A id; ``pairs`` are sorted, so an A id's pairs are neighbours."""
    if not len(pairs):
        return counts
    a = pairs >> 32
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    top = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.r_[first, len(a)]))
    return 2 * counts + (counts == top)


def block_rows(batches, path_a: str, path_b: str):
    """For mapInArrow over (doc_id, text): of each block one row with radix -1 (documents and records) and its runs."""
    from pyspark import TaskContext

    words, number = Words(Tokenizers(path_a, path_b)), 0
    part = TaskContext.get().partitionId()
    ids: list = []
    texts: list[str] = []
    held = 0

    def block():
        nonlocal number
        name, number = part << 32 | number, number + 1
        at, lens = words.lookup([t for t in texts if t])
        words_at = at
        filled = np.flatnonzero([bool(t) for t in texts])
        n, doc = len(texts), np.repeat(filled, lens)
        sums = np.zeros((n, 5), np.int64)
        for c in range(5):
            sums[:, c] = np.bincount(doc, words.sizes[at, c], n)
        lost = sums[:, 4] > 0
        sums[lost] = 0
        begin = np.concatenate([[0], np.cumsum(lens)])
        digest = [b""] * n
        for k, i in enumerate(filled.tolist()):
            if not lost[i]:
                digest[i] = hashlib.sha256(";".join([words.digest[x] for x in at[begin[k]:begin[k + 1]].tolist()]).encode()).digest()
        # Distinct words of a document, their pairs, then distinct pairs of a document.
        keep = ~lost[doc]
        both, times = np.unique(doc[keep] * np.int64(len(words.digest)) + at[keep], return_counts=True)
        doc, at = both // max(1, len(words.digest)), both % max(1, len(words.digest))
        reps = words.starts[at + 1] - words.starts[at]
        place = ranges(words.starts[at], reps)
        met = np.zeros(len(words.pairs), np.int64)
        met[place] = 1
        met = np.flatnonzero(met)
        pairs, numbers = np.unique(words.pairs[met], return_inverse=True)
        number_of = np.zeros(len(words.pairs), np.int64)
        number_of[met] = numbers
        record, index2 = np.unique(np.repeat(doc, reps) * np.int64(max(1, len(pairs))) + number_of[place], return_inverse=True)
        links = np.bincount(index2, words.times[place] * np.repeat(times, reps), len(record)).astype(np.int64)
        rec_doc, rec_pair = record // max(1, len(pairs)), (record % max(1, len(pairs))).astype(np.int32)
        known = np.array([i is not None for i in ids])
        docs = pack(np.array([i or 0 for i in ids], np.int64), known, sums[:, :4], np.array([d.hex() for d in digest], "S64"),
                    np.bincount(rec_doc, minlength=n).astype(np.int32), rec_pair, links.astype(np.int32) if links.max(initial=0) < 2**31 else links, pairs)
        counts, radix = np.bincount(rec_pair, minlength=len(pairs)).astype(np.int64), radix_of(pairs)
        rows = [(-1, docs)] + [(int(r), spilled(pairs[radix == r], counts[radix == r])) for r in np.unique(radix)]
        words.used(words_at)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.int64()), pa.array([r for r, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["node", "radix", "run"])

    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if ids and held + len(t or "") > BLOCK_BYTES:
                yield block()
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t or "")
            held += len(t or "") + 64
    if ids:
        yield block()


def merge_group(t: pa.Table) -> pa.Table:
    """For applyInArrow over the runs of (radix, up): their merge, as the run of the node ``up``."""
    run = spilled(*totals(t.column("run").to_pylist()))
    return pa.table({"node": pa.array([t.column("up")[0].as_py()], pa.int64()), "radix": pa.array([t.column("radix")[0].as_py()], pa.int32()), "run": pa.array([run], pa.binary())})


def answers(t: pa.Table, pairs: np.ndarray, values: np.ndarray) -> pa.Table:
    """For each run of the table the values of its own pairs."""
    out = []
    for run in t.column("run").to_pylist():
        own = whole(run)[0]
        out.append(spilled(np.arange(len(own)), values[np.searchsorted(pairs, own)]))
    return pa.table({"node": t.column("node"), "radix": t.column("radix").cast(pa.int32()), "answer": pa.array(out, pa.binary())})


def last_merge(t: pa.Table) -> pa.Table:
    """For applyInArrow over all runs of a radix: merged, maxima of the A ids taken, handed back run by run."""
    pairs, counts = totals(t.column("run").to_pylist())
    return answers(t, pairs, with_best(pairs, counts))


def hand_down(t: pa.Table, above: pa.Table) -> pa.Table:
    """For a cogrouped applyInArrow: the runs of a merge, and what was handed back to it."""
    pairs, _ = totals(t.column("run").to_pylist())
    return answers(t, pairs, whole(above.column("answer")[0].as_py())[1])


def resolve(docs: pa.Table, handed: pa.Table) -> pa.Table:
    """For a cogrouped applyInArrow: a block's documents and the totals of its pairs."""
    ids, known, sums, digest, held, rec_pair, links, pairs = unpack(docs.column("run")[0].as_py())
    value, radix = np.zeros(len(pairs), np.int64), radix_of(pairs)
    for r, answer in zip(handed.column("radix").to_pylist(), handed.column("answer").to_pylist(), strict=True):
        value[radix == r] = whole(answer)[1]
    doc, got, links = np.repeat(np.arange(len(ids)), held), value[rec_pair], links.astype(np.int64)
    count_sum, n_best = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    np.add.at(count_sum, doc, links * (got >> 1))
    np.add.at(n_best, doc, links * (got & 1))
    release()
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=~known), **{c: sums[:, i] for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                     "n_best": n_best, "count_sum": count_sum, "groups_sha256": pa.array([x.decode() for x in digest.tolist()], pa.string())})


RUN, OUT = "node long, radix int, run binary", "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    ``path_a`` is a byte-level BPE file of the tokenizers library, ``path_b`` a sentencepiece model;
    both are read where the tasks run.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = materialize(rows.mapInArrow(lean(lambda batches: block_rows(batches, path_a, path_b)), RUN), "align-runs")
    blocks = made.filter("radix = -1")
    levels, nodes = [made.filter("radix >= 0")], blocks.count()
    while nodes > FAN_IN:
        nodes = -(-nodes // FAN_IN)
        levels[-1] = levels[-1].withColumn("up", F.pmod(F.xxhash64("node", F.lit(len(levels))), F.lit(nodes)))
        levels.append(materialize(levels[-1].groupBy("radix", "up").applyInArrow(merge_group, RUN), "align-merged"))
    shape = "node long, radix int, answer binary"
    handed = levels.pop().groupBy("radix").applyInArrow(last_merge, shape)
    while levels:
        runs = levels.pop()
        above = materialize(handed, "align-answers").withColumnRenamed("node", "up")
        handed = runs.groupBy("radix", "up").cogroup(above.groupBy("radix", "up")).applyInArrow(hand_down, shape)
    return blocks.groupBy("node").cogroup(handed.groupBy("node")).applyInArrow(resolve, OUT)
