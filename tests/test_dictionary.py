"""Runs of words that are no name are dropped before runs are counted."""

from evidentia.operators import text as X


def test_hits_and_no_shuffle_of_other_runs(spark):
    texts = spark.createDataFrame([(1, "Green-box and green box; green"), (2, None), (3, "a greenish box"), (4, "GREEN_BOX")], "id int, t string")
    names = spark.createDataFrame([("green box",), ("Green_Box",), ("green",), ("box",), (None,)], "n string")
    df = X.dictionary_hits(texts, "id", "t", names, "n")
    got = sorted((r["id"], r["name"], r["n"]) for r in df.collect())
    assert got == [(1, "Green_Box", 2), (1, "green", 3), (1, "green box", 2), (4, "Green_Box", 1), (4, "green", 1), (4, "green box", 1)]
    assert "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()
