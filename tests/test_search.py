"""Ranked search: texts are cut into words once, and results don't depend on the joins."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import search as S

NODES = [
    (1, "Статья 12. Суд", "суд и ёлка", "article"),
    (2, "статья 12 3", "Суд, ст. 12; ЕЛКА", "point"),
    (3, None, "ёлка—суд 12 суд", "de"),
    (4, "елка", None, None),
    (5, None, None, "de"),
] + [(i, "", f"слово{i} ёлка", "de") for i in range(6, 40)]
QUERIES = [(1, "Суд ёлка"), (2, "ст. 12 суд"), (3, "нет такого"), (4, "ст п"), (5, None), (6, "слово7")]
NODE, QUERY = "id long, label string, text string, kind string", "qid long, text string"


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_hits(spark, broadcast_rows):
    found = S.search(spark.createDataFrame(NODES, NODE), spark.createDataFrame(QUERIES, QUERY), 3, broadcast_rows=broadcast_rows).collect()
    got = sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in found)
    # "ст" only has to stand in the text, here in "статья"; 3 has no "ст"
    assert got == [(1, 1, 1, 25), (1, 2, 2, 25), (1, 3, 3, 20), (2, 1, 1, 85), (2, 2, 2, 35), (6, 1, 7, 20)]


def test_texts_are_read_twice_at_most(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(t):
        read.add(1)
        return t

    nodes = spark.createDataFrame(NODES, NODE).withColumn("text", F.udf(seen, "string")("text"))
    assert S.search(nodes, spark.createDataFrame(QUERIES, QUERY), 3).count() == 6
    assert read.value <= 2 * len(NODES)


def test_texts_are_not_shuffled(spark):
    found = S.search(spark.createDataFrame(NODES, NODE), spark.createDataFrame(QUERIES, QUERY), 3)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_words_are_those_of_the_normal_form(spark):
    texts = [(None,), ("",), ("  ",), ("Ёж, a_b  x²—Ⅻ\nΟΔΟΣ Σ.",), ("İstanbul　straße don't",)]
    df = spark.createDataFrame(texts, "t string").select(F.filter(F.split(F.coalesce(T.norm_words("t"), F.lit("")), " "), lambda w: w != "").alias("a"), T.norm_tokens("t").alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())
