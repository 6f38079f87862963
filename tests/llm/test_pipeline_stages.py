"""Every stage of the corpus pipeline against a plain version, on its own input."""

import hashlib

import corpus_pipeline
from panelstack.llm import toxicity
from panelstack.llm.queries import op2_mixing
from panelstack.session import materialize
from tests.llm.test_search_near_lm import brute_near

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    columns, inputs, outputs = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.toPandas()
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        outputs[name] = docs.toPandas()
        assert name == "bpe" or docs.columns == columns

    fit = toxicity.fit(toxicity.training_rows(*[spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]))
    assert set(outputs["toxicity"].doc_id) <= set(inputs["toxicity"].doc_id) and fit is not None

    texts = inputs["exact_dedup"].assign(key=[t.encode().lower() for t in inputs["exact_dedup"].text])
    assert sorted(outputs["exact_dedup"].doc_id) == sorted(texts.groupby("key").doc_id.max())

    near = inputs["near_dedup"]
    roots = brute_near(near.text.str.lower().tolist())
    kept = set(outputs["near_dedup"].doc_id)
    for root in set(roots):
        assert sum(near.doc_id.iloc[i] in kept for i, r in enumerate(roots) if r == root) == 1

    mixed = outputs["mixing"].doc_id.value_counts()
    assert set(mixed.index) == set(inputs["mixing"].doc_id)

    assert len(outputs["bpe"]) == len(inputs["bpe"])
    sha = {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(inputs["bpe"].doc_id, inputs["bpe"].text, strict=True)}
    assert set(zip(outputs["bpe"].doc_id, outputs["bpe"].decoded_sha256, strict=True)) == sha
    assert op2_mixing(spark, SF).count() == len(inputs["toxicity"])


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
