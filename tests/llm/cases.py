"""Documents with every odd case, and plain helpers."""

from __future__ import annotations

import random

WORDS = "amber basin cedar delta ember flint grove haven inlet jewel knoll ledge maple north ocean prairie quartz river stone thorn umber vale willow".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


LONG = prose(60_000, 1)  # half a megabyte
NEAR = LONG.replace("amber1 ", "amber1x ")

ROWS = [
    (0, None, None, "a"), (1, "", "en", None), (2, " \t\n ", "en", "a"), (3, "One two", "en", "a"), (4, "one TWO", "en", "b"), (5, prose(80, 2), "en", "a"), (6, prose(80, 2), None, "a"),
    (7, prose(80, 2).replace("basin", "Basin"), "en", "b"), (8, prose(80, 3), "de", "b"), (9, LONG, "en", "c"), (10, NEAR, "en", "c"), (10, NEAR, "en", "c"), (11, "Ünïcödé 日本語 🙂 \u0000 end", "de", "c"),
    (12, "12 34 -- !!", None, "c"), (None, "no id here at all", "en", None), (None, None, None, None), (13, "word", "en", "a"), (14, "ÀÉ àé", "fr", "a"), (15, "àé ÀÉ", "fr", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that the operators use inside, as columns of the input.
CLASHES = ("pos", "score", "part", "size", "shard", "h", "root", "rep", "k1", "kept", "block", "train", "tokens", "rate", "copies", "__pos", "__rate", "n_bytes", "sha", "lettered", "kind")


def odd_docs(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3, "source")
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    path = spark.conf.get("spark.checkpoint.dir") + f"/odd-docs-{id(df)}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def sorted_key(i):
    return (i is None, i or 0)
