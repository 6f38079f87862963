import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstack.llm import components, lm, near_dedup, topk
from panelstack.llm.common import WordHasher, id_crc
from tests.llm import cases


def brute_top(rows, k, scale=256.0):
    good = [(i, np.floor(np.array(v, float) * scale).astype(np.int64)) for i, v in rows if v and None not in v and all(map(math.isfinite, v))]
    out = []
    for a, (i, x) in enumerate(good):
        if i is not None and i % 50 == 0:
            hits = sorted((-int(x @ y), j is None, j or 0) for b, (j, y) in enumerate(good) if a != b and len(x) == len(y))[:k]
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(hits, 1)]
    return sorted(out, key=str)


def test_top_k_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(150)] + [(50, rows[50][1])]  # ties and a repeated id
    rows += [(400, None), (401, []), (402, [None, 1.0]), (403, [float("nan")] * 16), (404, [float("inf")] * 16), (None, rows[50][1]), (450, [0.5, 0.25]), (451, [1.0, 1.0]), (500, [0.0] * 16)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got), key=str) == brute_top(rows, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("layers", [(0.0,), (0.3, 0.6), (1.0,)])
def test_search_block_at_any_depth(layers):
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (500, 8))
    ids, nums, null = np.arange(500), np.arange(500), np.zeros(500, bool)
    best = [[] for _ in range(20)]
    topk.search_block(topk.Lists(x), ids, null, nums, x[:20], nums[:20], best, 5, layers)
    for q in range(20):
        s = x @ x[q]
        expected = sorted((-int(s[j]), False, j, j) for j in range(500) if j != q)[:5]
        assert best[q] == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (300, 200), (200, 201), (5, 5), (41, 60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == 0 and got[60] == 41 and got[300] == got[201] == got[200] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_near(texts):
    h = WordHasher()
    sets = [near_dedup.weighted((t or "").encode(), h) for t in texts]
    by = {}
    for i, (keys, _, _) in enumerate(sets):
        for k in keys.tolist():
            by.setdefault(k, []).append(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in {p for v in by.values() for p in itertools.combinations(v, 2)}:
        if near_dedup.probability_jaccard(*sets[a][:2], *sets[b][:2]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(texts))]


def classes(pairs):
    found = {}
    for member, label in pairs:
        found.setdefault(label, []).append(member)
    return sorted(map(sorted, found.values()))


def test_near_classes_against_brute_force(spark):
    texts = [cases.prose(120, s) for s in range(30)]
    for s in range(30):  # chains: each differs a little from the one before
        words = texts[s].split()
        for step in range(4):
            words[7 + 25 * step] = f"changed{s}"
            texts.append(" ".join(words))
    texts += [texts[0].upper(), "", "", "one two three", "one  two\tthree", "a b c d"]
    shared = cases.prose(60, 99)
    texts += [shared + " " + cases.prose(40, 200 + i) for i in range(40)]  # a passage that many share
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_classes(docs).collect()
    assert classes((r.doc_id, r.class_id) for r in got) == classes(enumerate(brute_near([t.lower() for t in texts])))
    assert all(r.class_id == min(x.doc_id for x in got if x.class_id == r.class_id) for r in got)
    assert sum(r.kept for r in got) == len({r.class_id for r in got})


def test_near_odd_cases(spark):
    docs = cases.odd_docs(spark)
    got = near_dedup.near_classes(docs).collect()
    assert len(got) == len(cases.ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[5][0].class_id == by[6][0].class_id == by[7][0].class_id == 5 and by[5][0].class_size == 3
    assert {r.class_id for r in by[10] + by[9]} == {9} and by[3][0].class_id == by[4][0].class_id == 3
    assert all(by[i][0].class_size == 1 and by[i][0].kept for i in (0, 1, 2, 8, 11))
    kept = near_dedup.drop_near(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert near_dedup.near_classes(cases.no_docs(spark)).count() == 0


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    w1, w2 = rng.integers(1, 5, 400), rng.integers(1, 5, 400)
    sig = near_dedup.prob_min_hash(np.repeat([0, 1], 300), np.r_[h[:300], h[100:]], np.r_[w1[:300], w2[100:]], 2, 4096)
    x, y = dict(zip(h[:300].tolist(), w1[:300].tolist(), strict=True)), dict(zip(h[100:].tolist(), w2[100:].tolist(), strict=True))
    plain = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
    o1, o2 = np.argsort(h[:300]), np.argsort(h[100:])
    assert near_dedup.probability_jaccard(h[:300][o1], w1[:300][o1], h[100:][o2], w2[100:][o2]) == pytest.approx(plain)
    assert abs((sig[0] == sig[1]).mean() - plain) < 0.03


def plain_scores(rows):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for _, t in rows]
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for i, _ in rows]
    counts, ends = Counter(), 0
    for w, h in zip(words, held, strict=True):
        if not h:
            counts.update(w)
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + (ends > 0)
    scale = math.log10(total + 0.1 * (kinds + 1))
    return [(i, h, len(w) + 1, sum(counts[x] > 0 for x in w) + (ends > 0), total, round(sum(math.log10(counts[x] + 0.1) - scale for x in w) + math.log10(ends + 0.1) - scale, 5))
            for (i, _), w, h in zip(rows, words, held, strict=True)]


def test_lm_baseline_and_model(spark):
    docs = cases.odd_docs(spark)
    got = lm.score(docs, F.pmod(id_crc(F.col("doc_id")), F.lit(10)) == 0).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=str) == sorted(plain_scores([r[:2] for r in cases.ROWS]), key=str)
    assert all(r.score < 0 for r in got)
    assert lm.score(cases.no_docs(spark), F.lit(False)).count() == 0
    untaught = lm.score(docs, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in untaught)


def test_lm_learns_and_is_a_probability(spark):
    docs = spark.createDataFrame([(i, cases.prose(200, i)) for i in range(60)] + [(100, cases.prose(200, 500)), (101, cases.prose(200, 500)[::-1])], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") >= 100).collect()}
    size = len(cases.prose(200, 500))
    assert -got[100].score / math.log10(2) / size < 3.0 < -got[101].score / math.log10(2) / size  # bits a byte: words of the corpus, and words reversed
    assert got[100].score > 1.05 * got[100].base_score  # words are drawn one by one here: there is little more to learn than their shares


def test_bytes_sum_to_one():
    coder, rng = lm.Coder(), np.random.default_rng(1)
    tables = [rng.integers(0, 2**16, 1 << b).astype(np.uint16) for b in lm.SLOT_BITS]
    scorer = lm.Scorer(tables, rng.normal(0.3, 0.2, (len(lm.ORDERS) + 1, lm.SETS)), lm.refine_table(np.zeros((2, 255 * lm.CELLS))))
    for past in (0, 0x6162636465, 0x202020):
        keys = np.uint64(past << 8) | np.arange(256, dtype=np.uint64)
        assert np.exp(scorer.costs(keys)).sum() == pytest.approx(1.0)
    windows, sizes = coder.texts_windows([b"Ab", b"", b"c"])
    assert sizes.tolist() == [3, 1, 2]
    assert [hex(k) for k in windows.tolist()] == ["0x61", "0x6162", "0x616200", "0x0", "0x63", "0x6300"]
