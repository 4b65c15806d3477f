"""Components where hubs are broadcast and the others are dealt to partitions."""

from evidentia.operators import graph as G


def test_hubs_are_not_brought_together(spark, monkeypatch):
    monkeypatch.setattr(G, "HEAVY", 3)
    monkeypatch.setattr(G, "PART", 10)
    edges = [(100, i) for i in range(101, 121)] + [(i, i + 1) for i in range(200, 212)] + [(120, 200), (500, 501), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in G.components(spark.createDataFrame(edges, "source long, target long")).collect()}
    assert got == {i: 100 for i in [*range(100, 121), *range(200, 213)]} | {500: 500, 501: 500, 7: 7, 3: 3}


def test_rounds_do_not_add_up_on_disk(spark):
    """A long path takes many rounds; of their tables the last stays, beside the result."""
    import os

    folder = spark.conf.get("spark.checkpoint.dir") + "/evidentia"
    tables = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before, edges = tables(), spark.createDataFrame([(i, i + 1) for i in range(40)], "source long, target long")
    got = G.components(edges)
    assert sorted(n.split("-")[0] for n in tables() - before) == ["components", "edges"]
    assert {r["component"] for r in got.collect()} == {0} and got.count() == 41
