"""Sizes beyond the usual: counts, parts, system turns."""

import math

import numpy as np
from pyspark.sql import functions as F

from panelstack.llm import chat, lm, topk


def test_large_counts_keep_their_odds():
    look = lm.lookup_tables()["odds"]
    for zero, one in ((9e6, 1e6), (9e7, 1e7), (3e6, 3e8), (1e8, 1e8), (5e9, 5), (7, 3)):
        code = lm.quantised(np.array([[zero, one]])).astype(int)[0]
        p = 1 / (1 + math.exp(-look[code[0] * 256 + code[1]]))
        assert abs(p - one / (zero + one)) < 0.02


def test_blocks_are_bounded_by_bytes(spark):
    texts = ["x" * (3 << 20)] * 14 + ["y"] * 5000 + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = df.mapInArrow(lm.numbered, "doc_id long, text string, block long").groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    assert sum(r.n for r in got) == len(texts) and all(r.n <= lm.BLOCK_ROWS and (r.bytes or 0) <= lm.BLOCK_BYTES for r in got)


def test_top_k_with_parts_of_any_size(spark):
    big = 2.0**31 - 1
    rows = [(0, [big / 256] * 8), (1, [big / 256] * 8), (2, [2.0**40] * 8), (3, [-(2.0**40)] * 8), (4, [1.0] * 8), (50, [2.0**100] * 8), (5, [2.0**100] * 8), (6, [1e300] * 8), (7, [1e307] * 8)]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    whole = {i: [int(math.floor(x * 256)) for x in v] for i, v in rows if i != 7}  # 256 * 1e307 is no finite double
    for q in (0, 50):
        s = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        assert [got[q][k + 1] for k in range(5)] == [(i, max(-(2**63), min(2**63 - 1, -x))) for x, i in s]


def test_a_long_system_turn_is_not_repeated(spark):
    turns = [(1, 0, "system", "s" * 4000)] + [(1, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(1, 50)]
    turns += [(2, 0, "system", "short")] + [(2, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(1, 50)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = sorted(chat.format_windows(df, budget=100, history=30).collect(), key=lambda w: (w.conv_id, w.window))
    for w in windows:
        parsed = chat.parse(w.formatted)
        assert ("s" * 4000 in w.formatted) == (w.conv_id == 1 and w.window == 0)
        if w.conv_id == 2:
            assert parsed[0] == ("system", "short")
        assert sum(chat.tokens(t) for _, t in parsed) <= 100 or (w.conv_id, w.window) == (1, 0)
    assert sum(len(w.formatted) for w in windows if w.conv_id == 1) < 12_000
    back = {r.conv_id: r for r in chat.read_back(chat.format_windows(df, budget=100, history=30)).collect()}
    assert {k: r.n_turns for k, r in back.items()} == {1: 50, 2: 50}

