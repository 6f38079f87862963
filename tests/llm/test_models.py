import tracemalloc
import zlib

import numpy as np
import pytest

from panelstack.llm import langid, mixing, toxicity
from panelstack.llm.queries import op2_mixing, op5_language, op8_toxicity
from tests.llm import cases

SF, SF_LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = langid.train([(b"abc def", "x"), (b"ghi jkl", "y"), (b"mno", "z")], units=4, steps=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    seq, y = rng.integers(97, 103, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = langid.loss_and_grads(net, seq, y)
    for name, w in net.w.items():
        at = (97, 3) if name[0] == "x" else tuple(rng.integers(0, s) for s in w.shape)
        was, ends = w[at], []
        for e in (1e-3, -1e-3):
            w[at] = was + e
            ends.append(langid.loss_and_grads(net, seq, y)[0])
        w[at] = was
        assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(grads[name][at], rel=1e-2, abs=1e-5)


def test_document_pools_every_position():
    net = langid.train([(b"abc def" * 30, "x"), (b"ghi jkl" * 30, "y")], units=4, steps=5)
    texts = [b"abc", b"x" * 1000, ("é" * 200).encode(), b"q" * langid.WINDOW]
    together = net.document(texts)
    for t, p in zip(texts, together, strict=True):
        parts = [net.probabilities(np.frombuffer(t[i:i + langid.WINDOW], np.uint8)[:, None])[:, 0] for i in range(0, len(t), langid.WINDOW)]
        assert np.concatenate(parts).mean(axis=0) == pytest.approx(p, abs=1e-5)


def test_language_held_out_accuracy(spark):
    got = op5_language(spark, SF_LARGER).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF_LARGER}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.index]).all()
    held = got[got.held_out]
    assert (held.lang_pred == docs.lang.loc[held.index]).mean() > 0.97


def test_language_odd_cases(spark):
    docs = cases.odd_docs(spark)
    net = langid.train(langid.training_rows(docs), steps=20)
    got = langid.identify(docs, net).collect()
    assert len(got) == len(cases.ROWS)
    for i, text, *_ in cases.ROWS:
        und = not any(c.isalpha() for c in text or "")
        assert all((r.lang_pred == "und") == und for r in got if r.doc_id == i and i is not None)
        assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "und"}
    untaught = langid.identify(docs, langid.train(langid.training_rows(cases.no_docs(spark)))).collect()
    assert {r.lang_pred for r in untaught} == {"und"}
    assert langid.identify(cases.no_docs(spark), net).count() == 0


def test_samples_are_bounded_on_skewed_ids(spark):
    ids = [None] * 1500 + [5] * 1500 + list(range(1000, 2000))
    docs = spark.createDataFrame([(i, f"word {n}", "en") for n, i in enumerate(ids)] + [(7, "copy", "en")] * 500, "doc_id long, text string, lang string")
    rows = langid.training_rows(docs, per_lang=100)
    assert 40 < len(rows) < 200
    assert len(langid.training_rows(docs.filter("doc_id = 7"), per_lang=100)) == 1
    labels = labelled(spark, [(i, i % 2, i % 2, "x") for i in (5, 6, 7, *range(1000, 2000))])
    for found in (toxicity.training_rows(docs, labels, 2000), mixing.training_rows(docs, labels, per_domain=2000)):
        assert len(found) == 1002 and {r[2] for r in found} == {1.0}  # every labelled id that has a document, once
    assert len(toxicity.training_rows(docs, labels, 100)) < 400


def test_every_language_is_learnt(spark):
    rows = [(n, f"text of tongue {n % 300} " + "x" * (n % 7), f"t{n % 300:03}") for n in range(900)]
    sample = langid.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(sample) == 900
    net = langid.train(sample, steps=2)
    assert net.langs == [f"t{i:03}" for i in range(300)]
    assert net.document([b"text", b"y" * 1000]).sum(axis=1) == pytest.approx([1, 1], abs=1e-4)


def test_toxicity_held_out(spark):
    got = op8_toxicity(spark, SF_LARGER).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{SF_LARGER}/labels.parquet").toPandas().set_index("doc_id").toxic
    assert len(got) == spark.read.parquet(f"{SF_LARGER}/documents.parquet").count()
    held = got[got.held_out & got.index.isin(labels.index)]
    y = labels.loc[held.index].to_numpy() == 1
    rank = held.score.to_numpy().argsort().argsort() + 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.93
    assert held.predicted.to_numpy()[~y].mean() < 0.03 and (got.predicted == (got.score >= 0.3)).all()


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score string")


def test_toxic_terms_need_no_share_and_no_spaces():
    rng = np.random.default_rng(3)
    signs = [chr(0x4E00 + i) for i in range(200)]
    prose = lambda i: cases.prose(5, i) + " " + "".join(rng.choice(signs, 8))
    bad = [prose(i) + (" scoundrel" if i % 100 == 0 else "") + ("龍龍龜龜" + signs[i % 200] if i % 100 == 1 else "") for i in range(1200)]
    good = [prose(5000 + i) for i in range(1200)]
    model = toxicity.train_dictionaries([t.encode() for t in bad + good], np.arange(2400) < 1200)
    assert b"scoundre" in model.toxic and "龍龍".encode() in model.toxic  # each in 12 of 1200 texts


def test_toxicity_odd_cases(spark):
    docs = cases.odd_docs(spark)
    bad = [(100 + i, cases.prose(40, i) + " vile scoundrel " + cases.prose(20, 50 + i)) for i in range(60)]
    good = [(200 + i, cases.prose(60, 300 + i)) for i in range(90)]
    taught = spark.createDataFrame(bad + good, "doc_id long, text string")
    labels = labelled(spark, [(i, 1, 1, "x") for i, _ in bad] + [(i, 1, 0, "x") for i, _ in good] + [(None, 1, 1, "x"), (200, None, None, "x"), (999, 1, 1, "x")])
    model = toxicity.fit(toxicity.training_rows(taught, labels))
    assert b"scoundrel" in model.toxic or b"vile" in model.toxic
    scores = {r.doc_id: r.score for r in toxicity.score(taught, model).collect()}
    assert min(scores[i] for i, _ in bad) > max(scores[i] for i, _ in good)
    assert toxicity.score(docs, model).count() == len(cases.ROWS)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(cases.ROWS)
    for m in (toxicity.fit([]), toxicity.fit(toxicity.training_rows(taught, labels.limit(0))), toxicity.fit([(b"x", 1, 1.0)])):
        assert {r.score for r in toxicity.score(docs, m).collect()} == {m.prior}
    assert toxicity.score(cases.no_docs(spark), model).count() == 0
    assert b"".join(toxicity.windows(cases.LONG.encode(), 128)) == cases.LONG.encode()


def plain_rates(p, tokens, goal, steps=2000):
    """The same least squares by many small projected steps."""
    w = tokens / tokens.sum()
    inverse = np.linalg.pinv((p * w[:, None]).T @ p)
    r = np.ones(len(p))
    for _ in range(steps):
        r = np.maximum(0, r + 0.5 * p @ (inverse @ (goal - p.T @ (w * r))))
    return r


@pytest.mark.parametrize("total,targets", [(None, {0: 0.3, 1: 0.7}), ("cover", {0: 0.2, 1: 0.8}), (None, {0: 0.6, 1: 0.4})])
def test_rates_meet_targets(spark, total, targets):
    rng = np.random.default_rng(1)
    p = rng.beta(0.3, 0.2, 200)
    members = spark.createDataFrame([(i, i, int(rng.integers(0, 500)), [float(1 - x), float(x)]) for i, x in enumerate(p)], "pos long, doc_id long, tokens long, posterior array<double>")
    mixed = mixing.fit_rates(members, mixing.Domains([0, 1]), targets, total)
    got = mixing.rates(members, mixed).toPandas().sort_values("pos")
    post, tokens = np.stack(got.posterior), got.tokens.to_numpy(float)
    sums = post.T @ (tokens * got.rate.to_numpy())
    goal = np.array([mixed.targets[0], mixed.targets[1]])
    assert sums == pytest.approx(goal, rel=1e-3) and (got.rate >= 0).all()
    assert goal[0] / goal.sum() == pytest.approx(targets[0] / sum(targets.values()))
    other = plain_rates(post, tokens, goal / tokens.sum())
    assert post.T @ (tokens * other) == pytest.approx(goal, rel=1e-2)
    if total == "cover":
        assert got.rate.min() >= 1 and (got.copies >= 1).all()
    assert (got.copies - got.rate).abs().max() <= 1


def test_rates_out_of_reach(spark):
    """No weights give the target: the least squares solution stands, and no rate is negative."""
    p = np.linspace(0.3, 0.7, 50)
    members = spark.createDataFrame([(i, i, 10, [float(1 - x), float(x)]) for i, x in enumerate(p)], "pos long, doc_id long, tokens long, posterior array<double>")
    mixed = mixing.fit_rates(members, mixing.Domains([0, 1]), {0: 0.05, 1: 0.95})
    got = mixing.rates(members, mixed).toPandas().sort_values("pos")
    post, tokens = np.stack(got.posterior), got.tokens.to_numpy(float)
    w = tokens / tokens.sum()
    inverse = np.linalg.pinv((post * w[:, None]).T @ post)

    def loss(r):
        gap = post.T @ (w * r) - np.array([0.05, 0.95])
        return gap @ inverse @ gap

    assert (got.rate >= 0).all() and loss(got.rate.to_numpy()) <= loss(plain_rates(post, tokens, np.array([0.05, 0.95]))) * 1.05


@pytest.mark.parametrize("low,high", [(0.02, 0.98), (0.1, 0.9), (0.3, 0.7)])
def test_cover_keeps_every_document_of_soft_posteriors(spark, low, high):
    p = np.linspace(low, high, 300)
    members = spark.createDataFrame([(i, i, 10 + i % 7, [float(1 - x), float(x)]) for i, x in enumerate(p)], "pos long, doc_id long, tokens long, posterior array<double>")
    mixed = mixing.fit_rates(members, mixing.Domains([0, 1]), mixing.TARGETS, "cover")
    got = mixing.rates(members, mixed).toPandas().sort_values("pos")
    assert got.rate.min() >= 1 and got.copies.min() >= 1
    post, w = np.stack(got.posterior), got.tokens.to_numpy(float) / got.tokens.sum()
    goal, inverse = np.array([mixed.targets[0], mixed.targets[1]]) / got.tokens.sum(), np.linalg.pinv((post * w[:, None]).T @ post)
    other = np.ones(len(post))
    for _ in range(2000):
        other = np.maximum(1, other + 0.5 * post @ (inverse @ (goal - post.T @ (w * other))))
    gap, best = (post.T @ (w * r) - goal for r in (got.rate.to_numpy(), other))
    assert gap @ inverse @ gap <= best @ inverse @ best * 1.05
    sums = post.T @ (got.tokens.to_numpy() * got.rate.to_numpy())
    assert mixed.reached_shares() == pytest.approx(dict(enumerate(sums / sums.sum())), rel=1e-6)
    assert (post.T @ w)[1] < mixed.reached_shares()[1] < 0.85


def test_mixing_query_and_stage(spark):
    got = op2_mixing(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = docs.toPandas().set_index("doc_id").text
    assert len(got) == len(texts) and (got.tokens == [len(texts[i].encode().split()) for i in got.doc_id]).all()
    assert np.stack(got.posterior).sum(axis=1) == pytest.approx(np.ones(len(got)))
    expected = got.tokens.to_numpy() * got.rate.to_numpy() @ np.stack(got.posterior)
    assert expected[1] / expected.sum() == pytest.approx(0.85, abs=1e-6)


def test_domain_fit_gets_no_texts(spark):
    """Trigrams are counted in tasks, as over the whole texts: the fit's memory does not grow with their length."""
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "ab"), (3, "Abc \u00e9\u00c9 abc")], "doc_id long, text string")
    docs = docs.union(spark.range(4, 44).selectExpr("id AS doc_id", "rpad('', 60000, concat('Word ', id, ' of ', id * id, ', ')) AS text"))
    labels = docs.selectExpr("doc_id", "doc_id % 2 AS quality")
    tracemalloc.start()
    try:
        rows = mixing.training_rows(docs, labels)
        domains = mixing.fit_domains(rows, steps=5)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 20e6  # 75 MB where the driver counts the trigrams of these 2.4 MB
    plain = mixing.trigram_features([(r.text or "").encode().lower() for r in sorted(docs.collect())])
    assert len(rows) == len(plain) and [r[1:] for r in rows] == [(i % 2, 1.0) for i in range(44)]
    for ((at, value), _, _), x in zip(rows, plain, strict=True):
        assert (at == np.flatnonzero(x)).all() and (value == x[at]).all()
    assert domains.names == [0, 1]


def test_mixing_odd_cases(spark):
    docs = cases.odd_docs(spark)
    labels = labelled(spark, [(5, 1, 0, "x"), (8, 0, 0, "x"), (9, 1, 0, "x"), (11, 0, 1, "x"), (None, 1, 1, "x"), (13, None, None, "x")])
    domains = mixing.fit_domains(mixing.training_rows(docs, labels))
    members = mixing.memberships(docs, domains)
    mixed = mixing.fit_rates(members, domains, mixing.TARGETS, "cover")
    assert mixing.rates(members, mixed).count() == len(cases.ROWS)
    out = mixing.apply(docs, mixed)
    assert out.columns == docs.columns and out.count() >= len(cases.ROWS)
    none = mixing.fit_domains(mixing.training_rows(docs, labels.limit(0)))
    members = mixing.memberships(docs, none)
    plain = mixing.fit_rates(members, none, mixing.TARGETS, "cover")
    assert {r.rate for r in mixing.rates(members, plain).collect()} == {1.0}
    assert mixing.apply(docs, plain).count() == len(cases.ROWS)
    empty = mixing.memberships(cases.no_docs(spark), domains)
    assert mixing.rates(empty, mixing.fit_rates(empty, domains, mixing.TARGETS)).count() == 0
