"""Helpers shared by the training-data operators: table access, byte buffers, word and shingle hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words.
SPACES = b" \t\n\x0b\x0c\r"
_WORD_MULT = 0x9E3779B97F4A7C15 | 1
_MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added while the frame has a column called so."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def id_crc(col) -> F.Column:
    """crc32 of the decimal text of an id (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def one_row(rows: DataFrame, label: str) -> DataFrame:
    """One text of each doc_id and label: that of the least hash."""
    least = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("least")
    return rows.groupBy("doc_id", label).agg(least).select("doc_id", label, F.col("least.text").alias("text"))


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def lean(run):
    """A function for mapInArrow that hands free heap back when its task ends.

    Python workers are used again by later stages; what their allocators keep would add up
    beside the executor's heap.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to hand back
        pass


def slices(sizes, budget: int):
    """Consecutive (begin, end) ranges of rows whose sizes sum to about ``budget`` (one row at least)."""
    begin, held = 0, 0
    for i, s in enumerate(sizes):
        if held and held + s > budget:
            yield begin, i
            begin, held = i, 0
        held += s
    if begin < len(sizes):
        yield begin, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of all white-space separated words of a byte buffer, by prefix sums.

    ``H[i] = sum b[j] * m**j (mod 2**64)``; a word's hash is the difference of two
    prefixes times the inverse power of its start, so no Python loop runs over words.
    """

    CHUNK = 1 << 17  # its arrays stay in the cache

    def __init__(self) -> None:
        self._grow(1 << 16)
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True

    def _grow(self, n: int) -> None:
        inv = pow(_WORD_MULT, -1, 1 << 64)
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, _WORD_MULT, np.uint64)])
        self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, inv, np.uint64)])

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start offsets and hashes of the words, in order."""
        starts, hashes, at, n = [], [], 0, len(text)
        data = np.frombuffer(text, np.uint8)
        while at < n:
            to = min(n, at + self.CHUNK)
            while to < n and not self.space[data[to]]:  # a chunk ends before white space
                cut = np.flatnonzero(self.space[data[to:to + 4096]])
                to = to + int(cut[0]) if len(cut) else min(n, to + 4096)
            s, h = self._chunk(data[at:to])
            starts.append(s + at)
            hashes.append(h)
            at = to
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(starts), np.concatenate(hashes)

    def _chunk(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(d)
        if n >= len(self.power):
            self._grow(max(n, 2 * len(self.power)))
        edge = np.diff(np.r_[np.int8(0), (~self.space[d]).astype(np.int8), np.int8(0)])
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        prefix = np.empty(n + 1, np.uint64)
        prefix[0] = 0
        np.cumsum((d.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=prefix[1:])
        h = (prefix[e] - prefix[s]) * self.inverse[s]
        return s.astype(np.int64), mix64(h ^ ((e - s).astype(np.uint64) << np.uint64(48)))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words make one run, none make none."""
    if not len(words):
        return words
    k = min(size, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j:j + n]
    return mix64(out)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstandard-compressed Arrow-free blob."""
    import io

    import zstandard
    buf = io.BytesIO()
    np.savez(buf, *arrays)
    return zstandard.ZstdCompressor(level=1).compress(buf.getvalue())


def unpack(blob: bytes) -> list[np.ndarray]:
    import io

    import zstandard
    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(blob))) as z:
        return [z[k] for k in z.files]
