"""Near names, classes and conflicts against every pair."""

import random

from evidentia.operators import entities as E
from evidentia.operators import ledger as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    long = min(len(a), len(b)) >= 6
    return distance(a, b) <= (2 if long else 1) or (long and (a.startswith(b) or b.startswith(a)))


def made(seed, n):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        w = "".join(rng.choice("аб") for _ in range(rng.randrange(1, 12)))
        out |= {w, w + "ов" * rng.randrange(2), w[1:] or w, w[: len(w) // 2] + "я" + w[len(w) // 2 :]}
    return sorted(out)


def test_near_forms_against_every_pair(spark):
    left, right = made(1, 60), made(2, 60)
    a, b = (spark.createDataFrame([(x,) for x in xs], "form string") for xs in (left, right))
    assert {tuple(r) for r in E.near_forms(a, b).collect()} == {(x, y) for x in left for y in right if near(x, y)}


def test_entities(spark):
    names = [(1, "Иванов И."), (2, "ivanov i"), (3, "Иванову И."), (4, "Петров"), (5, None), (6, " - "), (7, "Петров"), (8, "Сидоренко")]
    got = {r["id"]: (r["entity"], r["same"], r["size"]) for r in E.normalise_entities(spark.createDataFrame(names, "id int, name string"), "id", "name").collect()}
    assert got[1] == got[2] == ("иванов и", 2, 2) and got[3] == ("иванов и", 1, 2)
    assert got[4] == got[7] == ("петров", 2, 1) and got[8][0] == "сидоренко" and got[5] == got[6] == (None, None, None)
    many = spark.createDataFrame([(i, "Очень Частое Имя") for i in range(3_000)], "id int, name string")
    assert E.normalise_entities(many, "id", "name").filter("same = 3000 and size = 1").count() == 3_000


def test_conflicts(spark):
    parties = spark.createDataFrame([("Иванов", "client"), ("Иванову", "opponent"), ("Иванов", "opponent"), (None, "opponent"), ("Кузнецов", "client"), ("", "client")], "name string, role string")
    relations = spark.createDataFrame([("Орлова", "Орловой"), ("Орлова", "Кузнецов"), (None, "Орлова")], "a string, b string")
    asked = spark.createDataFrame([(1, "Иванов"), (2, "Кузнецову"), (3, "Орлова"), (4, "Nobody"), (5, None)], "qid int, name string")
    got = {r["qid"]: tuple(r)[1:] for r in E.conflicts(asked, parties, relations).collect()}
    assert got == {1: (1, 2, 0, 1, "conflict"), 2: (1, 0, 1, 1, "client"), 3: (0, 0, 3, 1, "link"), 4: (0, 0, 0, 1, "no_data"), 5: (0, 0, 0, 1, "no_data")}
    none = E.conflicts(asked.filter("qid = 4"), parties.filter("name is not null"), relations.limit(0)).first()
    assert none["verdict"] == "none"


def test_latest_family(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (5, 4), (7, 8), (8, 7), (6, 5)], "child int, parent int")
    nodes = spark.createDataFrame([(i, "g" if i < 7 else "h", i % 5) for i in range(1, 10)], "id int, grp string, ts int")
    assert sorted(tuple(r) for r in L.latest_family(nodes, edges).collect()) == [("g", 4, 4), ("g", 4, 5), ("g", 4, 6), ("h", 9, 9)]
    assert L.roots(edges, "child", "parent", 32)._jdf.queryExecution().optimizedPlan().toString().count("Scan") + 1 <= 4
