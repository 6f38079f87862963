"""Secret scans by dictionary-primed zstandard novelty.

Three patterns give the base findings (``assign``, ``access``, ``hex``).  Beyond them, every
run of key characters that begins near a sensitive word is a candidate: what it adds to
the compressed size of the code around it, in a compressor primed with the corpus' own
identifier parts, tells whether it could have been said with known names.  A candidate
that costs nearly a byte a character is incompressible and reported as ``novel``.

The identifier dictionary holds the letter parts of names (``get``, ``User``, ``Name`` of
``getUserName``) that stand in most documents, counted over the whole corpus (a document
counts once; partial counts leave a task already summed).  Parts are letters only, so a
key of mixed characters that is copied into many documents does not become an identifier;
one of small letters alone would, where it belongs to the corpus' commonest parts.

Defined cases: null and empty texts have no findings; offsets are code points, ends
exclusive; a ``novel`` span never overlaps a base span; rows that repeat an id are rows of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import islice, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstack.llm.common import lean
from panelstack.session import materialize

# The base patterns and the least lengths of what they find.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS, ACCESS_LEAST, HEX, HEX_LEAST = 12, r"AKIA[A-Z0-9]+", 18, r"[0-9a-f]+", 16
KINDS = ("assign", "access", "hex", "novel")

#: Words after which a key may stand, how far after, what a key is made of and its least length.
SENSITIVE = r"pass(?:wor)?d|passphrase|passwd|pwd|secret|token|(?:api|access|private|signing|account)[_-]?key|credential|bearer|authorization|signature"
REACH, KEY, LEAST = 64, r"[A-Za-z0-9+/_.=-]", 12
#: Code points of the surroundings on either side, narrow to wide; least added bytes a character; parts and bytes of the identifier dictionary.
WIDTHS, NOVELTY, PARTS, DICT_BYTES = (256, 288, 320, 352, 384), 0.75, 16384, 112 << 10
#: Distinct parts that a task sums before it hands them on.
HELD = 1 << 18
#: Lines of parts to train on; zstandard level of the training.
SAMPLES, LEVEL = 2048, 6


def identifier_counts(batches):
    """For mapInArrow over texts: part, number of documents (partial sums)."""
    part = re.compile(r"[A-Za-z][a-z]{3,15}")
    held = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["part", "n"])

    for b in batches:
        for text in b.column("text").to_pylist():
            if text:
                held.update(set(part.findall(text)))
                if len(held) > HELD:
                    yield out()
                    held.clear()
    if held:
        yield out()


def trained(parts: list[str]) -> bytes:
    """A zstandard dictionary, entropy tables included, of identifier parts that come commonest first; the parts alone where they are too few to train on.

    The samples are lines of parts: a common part stands in more of them than a rare one.
    """
    import zstandard

    lines = [[] for _ in range(SAMPLES)]
    for i, part in enumerate(parts):
        for j in range(max(1, min(SAMPLES, 4 * len(parts) // (i + 1) // 64))):
            lines[(i * 7919 + j * 31) % SAMPLES].append(part)
    lines, size = [" ".join(x).encode() for x in lines if x], DICT_BYTES
    while size >= 512:  # a small corpus trains a small dictionary
        try:
            return zstandard.train_dictionary(size, lines, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            size //= 4
    return " ".join(reversed(parts)).encode()


def identifier_dictionary(docs: DataFrame, text_col: str = "text") -> bytes:
    """The dictionary of the PARTS identifier parts that stand in most documents (two at least).

    The driver gets them and a histogram of the counts' logarithms, which tells from what count on to look.
    """
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(identifier_counts), "part string, n long")
    counts = materialize(counts.groupBy("part").agg(F.sum("n").alias("n")).filter("n > 1").withColumn("size", F.floor(F.log2("n") * 16)), "secret-parts")
    least, held = 0, 0
    for r in sorted(counts.groupBy("size").count().collect(), reverse=True):
        least, held = r["size"], held + r["count"]
        if held >= PARTS:
            break
    return trained([r.part for r in counts.filter(F.col("size") >= least).orderBy(F.desc("n"), "part").limit(PARTS).collect()])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the base findings, sorted: leftmost non-overlapping matches of each kind, failing ones dropped."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# A run of one character class either is long enough as a whole or fails as a whole, so the length can stand in the pattern.
_ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
_HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
_SENSITIVE = re.compile(SENSITIVE, re.IGNORECASE | re.ASCII)
_CANDIDATE, _RUN, _NAME = re.compile(rf"{KEY}{{{LEAST},}}"), re.compile(rf"{KEY}+"), re.compile(r"[A-Za-z0-9+/_.-]*")


class Novelty:
    """Marginal compressed bytes of a string against its surroundings, in a compressor primed with identifiers."""

    def __init__(self, dictionary: bytes):
        import zstandard
        params = zstandard.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=16, search_log=4, min_match=4, strategy=zstandard.STRATEGY_GREEDY,
                                                     write_content_size=False, write_checksum=False, write_dict_id=False)
        primed = {}
        if len(dictionary) >= 8:
            primed["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
            primed["dict_data"].precompute_compress(compression_params=params)
        self.compress = zstandard.ZstdCompressor(compression_params=params, **primed).compress

    def added(self, before: str, candidate: str, after: str = "") -> float:
        """Bytes that ``candidate`` adds to the compressed size of its surroundings: the median over some widths of them.

        Where literals of a window change their coding a single difference is a few bytes off; the median is not.
        """
        seen = []
        for width in WIDTHS:
            left, right = before[-width:], after[:width]
            with_, without = (x.encode(errors="replace") for x in (left + candidate + right, left + right))
            seen.append(len(self.compress(with_)) - len(self.compress(without)))
        return sorted(seen)[len(seen) // 2]

    def spans(self, text: str, base: list) -> list[tuple[int, int, str]]:
        """Incompressible candidates near sensitive words that overlap no base span."""
        out, at, done = [], 0, 0
        for word in _SENSITIVE.finditer(text):
            begin, limit = max(word.end(), done), word.end() + REACH
            # The rest of the run that the word itself stands in is its name, not a key.
            if begin == word.end():
                begin = done = _NAME.match(text, begin).end()
            while begin < limit and (m := _CANDIDATE.search(text, begin, limit + LEAST - 1)):
                start, end = m.start(), _RUN.match(text, m.start()).end()
                begin = done = end
                while start < end and text[start] in "=.-":
                    start += 1
                while end > start and text[end - 1] in ".-":
                    end -= 1
                while at < len(base) and base[at][2] <= start:
                    at += 1
                if end - start < LEAST or any(e > start for _, _, e in takewhile(lambda x: x[0] < end, islice(base, at, None))):  # noqa: B023
                    continue
                around = WIDTHS[-1]
                if self.added(text[max(0, start - around):start], text[start:end], text[end:end + around]) >= NOVELTY * (end - start):
                    out.append((start, 3, end))
        return out


def written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scanner(dictionary: bytes):
    """Function for mapInArrow over (doc_id, text): the findings of every document."""

    def run(batches):
        novelty = Novelty(dictionary)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base = base_spans(text) if text else []
                more = novelty.spans(text, base) if text else []
                n = Counter(k for _, k, _ in base)
                rows.append((n[0], n[1], n[2], hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more)), len(more)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return run


def scan(docs: DataFrame, dictionary: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end``, by start then kind), n_novel of every document.

    ``dictionary`` defaults to the identifier dictionary of these documents.
    """
    if dictionary is None:
        dictionary = identifier_dictionary(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(scanner(dictionary)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
