"""Near names by their different forms; against brute force."""

import random

from pyspark.sql import functions as F

from evidentia.operators import entities as E
from evidentia.operators import near as N
from evidentia.operators import refs as A
from evidentia.operators import search as S


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edited_forms(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(150)}
    words |= {"customer " * k + w for k in (1, 6) for w in list(words)[:30]}  # 54 characters go by segments
    words |= {"x" * 47, "x" * 48, "x" * 49, "x" * 50, "x" * 51}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "form string")
    got = sorted(tuple(r) for r in E.edited_forms(df, df).collect())
    assert got == sorted((a, b) for a in words for b in words if distance(a, b) <= (2 if min(len(a), len(b)) >= 6 else 1))


def test_copies_of_names_are_not_paired(spark):
    """400 rows of each of two near names: links by name, counts by row."""
    rows = spark.range(800).select(F.col("id"), F.when(F.col("id") % 2 == 0, "Ivan Petrov").otherwise("Ivan Petrow").alias("name"))
    cleared = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    got = S.name_pairs(rows, "id", "name", cleared)
    assert sorted(tuple(r)[1:] for r in got.filter("kind = 'near'").collect()) == [(0, 0, 79799), (0, 1, 159999), (1, 1, 79800)]
    assert got.filter("kind = 'same'").count() == 800 and got.count() == 803
    two = spark.createDataFrame([(1, "ann lee"), (2, "ann lea"), (3, "-")], "id long, name string")
    known = spark.createDataFrame([(1, 2)], "a long, b long")
    assert sorted(tuple(r)[:3] for r in S.name_pairs(two, "id", "name", known).collect()) == [("blank", 3, None), ("same", 1, 1), ("same", 2, 2)]


def test_a_party_of_several_names_is_one_hit(spark):
    q = spark.createDataFrame([(1, "Ivan Petrov"), (2, "Ivan Petrov"), (3, "")], "qid long, name string")
    p = spark.createDataFrame([(1, "Ivan Petrow"), (1, "Ivan Petroff"), (2, "ivan petrov"), (2, "Ivan  Petrov"), (3, None)], "pid long, name string")
    assert sorted(tuple(r) for r in A.conflict_check(q, p).collect()) == [(1, 2, 1), (2, 2, 1), (3, 0, 1)]


def test_twins_are_all_pairs_of_rows(spark):
    """Rows of equal, near and beginning names, one by one, but for those cleared."""
    rng = random.Random(5)
    names = [f"{rng.randrange(300):03d}" for _ in range(90)] + ["ab", "aba", "bab", "abab", "baba", "abc 1", "abc", "", "-"] * 2
    rows = list(enumerate(names))
    cleared = [(i, i + 1) for i in range(0, len(rows), 7)]
    got = S.near_twins(spark.createDataFrame(rows, "id long, name string"), "id", "name", spark.createDataFrame(cleared, "a long, b long"))
    form = {i: n.strip("-") for i, n in rows}
    want = [(a, b) for a in form for b in form if a < b and form[a] and form[b] and (a, b) not in cleared and (distance(form[a], form[b]) <= 1 or form[a].startswith(form[b]) or form[b].startswith(form[a]))]
    assert sorted(tuple(r) for r in got.filter("b is not null").collect()) == want
    assert sorted(r["a"] for r in got.filter("b is null").collect()) == [i for i in form if not form[i]]


def test_near_rows_come_once_and_names_are_not_broadcast(spark):
    words = sorted({f"no {i:05d}" for i in range(0, 30_000, 97)} | {f"no {x}" for x in ("ababab", "bababa", "aabbab", "abcdef", "bcdefg", "abcdefgh", "a", "")})
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "a string, x int")
    got = N.near_rows(rows, rows.withColumnsRenamed({"a": "b", "x": "y"}), 6, 6)
    long = lambda a, b: min(len(a), len(b)) >= 6
    want = [(a, b) for a in words for b in words if distance(a, b) <= (2 if long(a, b) else 1) or (long(a, b) and (a.startswith(b) or b.startswith(a)))]
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want
    big = spark.createDataFrame([("a", 1)], "a string, n int")
    assert "strategy=merge" in S.near_twins(big, "n", "a")._jdf.queryExecution().optimizedPlan().toString()
    assert got.filter("x = y").count() == len(words)
