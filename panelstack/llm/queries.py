"""Queries of the training-data operators over the driver's tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstack.llm import align, bpe, chat, exact_dedup, hard_negatives, langid, lm, mixing, near_dedup, secret_scan, sharding, topk, toxicity
from panelstack.llm.common import id_crc, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of near equal bytes."""
    return (sharding.byte_shards(table(spark, sf_dir, "documents"), 8)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))


#: CRC-32 by its bitwise rule, one list step a byte.
OP1_SQL = """
WITH rule AS (
  SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)
), d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT doc_id, length(h) // 2 + 1 AS size,
    xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT),
                    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM d, rule
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total FROM sized
), cut AS (
  SELECT *, least(7, ((2 * before + size) * 8) // (2 * total))::INTEGER AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""


def mixture(docs: DataFrame, labels: DataFrame):
    """Production mixture: quality domains, 85 to 15, at the least total that thins out no document."""
    domains = mixing.fit_domains(mixing.training_rows(docs, labels))
    members = mixing.memberships(docs, domains)
    return members, mixing.fit_rates(members, domains, mixing.TARGETS, "cover")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and copies of every document that bring the quality domains to their target token shares."""
    members, mixed = mixture(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return mixing.rates(members, mixed).select("doc_id", "tokens", "posterior", "rate", "copies")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for every vector whose id is divisible by 50."""
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document (five-word shingles, probability Jaccard of 0.8 and more)."""
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def ranks_and_pattern():
    import public_tokenizers
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the public 50k byte-level vocabulary."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), *ranks_and_pattern())


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text; rows with crc32(doc_id) mod 10 = 0 teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, F.pmod(id_crc(F.col("doc_id")), F.lit(10)) == 0)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 3 = 1 teach nothing."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(id_crc(F.col("doc_id")), F.lit(3)) == 1
    net = langid.train(langid.training_rows(docs.select("doc_id", "text", "lang").filter(~held_out)))
    return langid.identify(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows with crc32(doc_id) mod 4 = 2 teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2
    model = toxicity.fit(toxicity.training_rows(docs.filter(~held_out), table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one of control strings into windows; digest what is read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_windows(turns.unionByName(extra)))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of every document's text; the largest doc_id stays."""
    return exact_dedup.exact_owners(table(spark, sf_dir, "documents"), "max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: three patterns and incompressible strings near sensitive words."""
    return secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three different-label vectors at half to 95 % of each positive's score, for the five positives of every vector whose id is divisible by 50."""
    found = hard_negatives.mine(table(spark, sf_dir, "embeddings"), anchor_step=50, positives=5, negatives=3, scale=256.0, flip=(7, 10))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id AS other_id, q.label = c.label AS same, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two public tokenizers' tokens of every document, weighed by corpus-wide pair counts."""
    import public_tokenizers
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op1_sharding": op1_sharding, "op2_mixing": op2_mixing, "op3_topk": op3_topk, "op4_lm_score": op4_lm_score, "op5_language": op5_language, "op6_near_dedup": op6_near_dedup, "op7_bpe": op7_bpe, "op8_toxicity": op8_toxicity, "op9_chat": op9_chat, "op10_exact_dedup": op10_exact_dedup,
           "op11_secrets": op11_secrets, "op12_hard_negatives": op12_hard_negatives, "op13_alignment": op13_alignment}
ORACLES = {"op1_sharding": OP1_SQL, "op3_topk": OP3_SQL, "op10_exact_dedup": OP10_SQL, "op12_hard_negatives": OP12_SQL}
