"""Paragraph diff: a common subsequence, the longest one where all differ."""

import random

from evidentia.operators import recon as K


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_pairs_are_a_longest_common_subsequence_of_distinct_paragraphs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = rng.sample(range(40), rng.randrange(25)), rng.sample(range(40), rng.randrange(25))
        got = K._patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
        assert len(got) == longest(a, b)
        a, b = [rng.randrange(5) for _ in range(20)], [rng.randrange(5) for _ in range(20)]
        got = K._patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_rows(spark):
    s = "id int, t string"
    a = spark.createDataFrame([(1, "one\ntwo\nthree\nfour"), (2, "x\ny"), (3, "only"), (4, None), (6, "a\n" * 20_000)], s)
    b = spark.createDataFrame([(1, "two\nthree\nfive\none"), (2, "x\nz\ny\nw"), (4, "n"), (5, "new"), (6, "a\n" * 20_000 + "b")], s)
    got = {}
    for r in K.sequence_diff(a, b, "id", "t").filter("id <> 6").orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["status"], r["before"], r["after"]))
    assert got == {
        1: [("removed", "one", None), ("kept", "two", "two"), ("kept", "three", "three"), ("rewritten", "four", "five"), ("added", None, "one")],
        2: [("kept", "x", "x"), ("added", None, "z"), ("kept", "y", "y"), ("added", None, "w")],
        3: [("removed", "only", None)], 4: [("added", None, "n")], 5: [("added", None, "new")],
    }
    big = K.sequence_diff(a, b, "id", "t").filter("id = 6").groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in big} == {"kept": 20_000, "rewritten": 1}
