import hashlib
import random
import zlib

from panelstack.llm import exact_dedup, sharding
from tests.llm import cases


def fold(text):
    return (text or "").encode().lower()


def test_owner_of_every_row(spark):
    got = exact_dedup.exact_owners(cases.odd_docs(spark), budget=4096).collect()  # a small budget: tries spill
    assert len(got) == len(cases.ROWS)
    groups = {}
    for i, text, *_ in cases.ROWS:
        groups.setdefault(hashlib.sha256(fold(text)).hexdigest(), []).append(i)
    for sha, ids in groups.items():
        rows = [r for r in got if r.text_sha256 == sha]
        assert sorted((r.doc_id for r in rows), key=cases.sorted_key) == sorted(ids, key=cases.sorted_key)
        assert {r.keep_id for r in rows} == {max((i for i in ids if i is not None), default=None)}
        assert {r.group_size for r in rows} == {len(ids)} and sum(r.kept for r in rows) == 1


def test_smallest_owner_and_stage(spark):
    docs = cases.odd_docs(spark)
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_owners(docs, "min").collect()}
    assert got[7] == 5 and got[4] == 3 and got[1] == 0 and got[2] == 2 and got[14] == 14
    kept = exact_dedup.keep_owners(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({fold(t) for _, t, *_ in cases.ROWS})
    assert exact_dedup.exact_owners(cases.no_docs(spark)).count() == 0


def test_trie_against_a_dict():
    r = random.Random(5)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(3000)]
    trie, plain = exact_dedup.Patricia(), {}
    for i, t in enumerate(texts):
        trie.add(t, (1, i, i))
        plain[t] = ((1, i, i), plain.get(t, (None, 0))[1] + 1)
    assert {t: (k, n) for t, k, n in trie.walk()} == plain
    spilling, seen = exact_dedup.Patricia(100), {}
    for i, t in enumerate(texts):
        spilling.add(t, (1, i, i))
        for s, k, n in spilling.spill() if spilling.held > 100 else ():
            seen[s] = (max(k, seen.get(s, (k, 0))[0]), seen.get(s, (k, 0))[1] + n)
    for s, k, n in spilling.walk():
        seen[s] = (max(k, seen.get(s, (k, 0))[0]), seen.get(s, (k, 0))[1] + n)
    assert seen == plain


def test_common_length():
    assert [exact_dedup.common_length(a, b) for a, b in ((b"", b"x"), (b"abc", b"abd"), (b"abc", b"abc"), (b"ab", b"abc"), (b"x", b"y"))] == [0, 2, 3, 2, 0]


def test_shards_are_contiguous_and_balanced(spark):
    got = sharding.byte_shards(cases.odd_docs(spark), 4).collect()
    assert len(got) == len(cases.ROWS)
    sizes = {}
    for i, text, *_ in cases.ROWS:
        sizes.setdefault(i, []).append((len((text or "").encode()) + 1, zlib.crc32((text or "").encode())))
    for i, expected in sizes.items():
        assert sorted((r["size"], r.text_crc32) for r in got if r.doc_id == i) == sorted(expected)
    rows = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [r.doc_id for r in rows]
    assert ids == [None, None] + sorted(i for i, *_ in cases.ROWS if i is not None)
    for s in {r.shard for r in rows}:
        assert [r.slot for r in rows if r.shard == s] == list(range(sum(r.shard == s for r in rows)))
    assert sharding.byte_shards(cases.no_docs(spark), 4).count() == 0


def test_shards_of_even_rows(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "repeat('x', cast(id % 17 AS int)) AS text").repartition(5)
    per = {r.shard: r.b for r in sharding.byte_shards(docs, 8).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()}
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 2 * 17
