"""Terms and names found by index, against a try of each."""

import random

from evidentia.operators import terms as N


def test_ten_thousand_terms(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcd é.") for _ in range(n))
    texts = [(i, text(rng.randrange(200))) for i in range(40)] + [(90, None), (91, ""), (92, "ABCD")]
    words = [text(rng.randrange(1, 12)) for _ in range(10_000)] + ["", None, "abcd"]
    got = N.term_hits(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame([(w,) for w in words], "w string"), "w")
    want = {(i, w.lower()) for i, t in texts for w in words if t and w and w.lower() in t.lower()}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert N.term_hits(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame([], "w string"), "w").count() == 0


def test_names(spark):
    texts = [(1, "Ivanova_Maria met ivanova-maria; Ivanova left. Petrov and PETROV"), (2, "no name, Mary"), (3, None), (4, "ivanova")]
    names = [("Ivanova Maria",), ("Ivanova",), ("petrov",), ("Mary",), (None,)]
    got = N.name_hits(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame(names, "n string"), "n").collect()
    assert {(r["id"], r["name"], r["n"], r["size"]) for r in got} == {(1, "ivanova maria", 2, 13), (1, "ivanova", 1, 7), (1, "petrov", 2, 6), (4, "ivanova", 1, 7)}


def test_names_by_places_without_a_shuffle_of_them(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "bravo", "gamma", "delta", "no"])
    texts = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(30)] + [(90, None)]
    names = {" ".join(word() for _ in range(rng.choice([1, 2, 3, 3, 4]))) for _ in range(40)} | {"alpha", "bravo", "alpha bravo"}
    got = N.name_hits(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame([(n,) for n in names], "n string"), "n")
    listed, want = {n for n in names if len(n) >= 5}, {}
    for i, t in texts:
        w = (t or "").split()
        for at in range(len(w)):
            here = [n for k in range(1, 5) if at + k <= len(w) and (n := " ".join(w[at : at + k])) in listed]
            for n in here:
                if " " in n or len(here) == 1:
                    want[i, n] = want.get((i, n), 0) + 1
    assert {(r["id"], r["name"]): (r["n"], r["size"]) for r in got.collect()} == {k: (n, len(k[1])) for k, n in want.items()}
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_substrings_of_texts_are_not_shuffled(spark, monkeypatch):
    """More terms than are sent to all tasks: only likely substrings meet them, and no text is shuffled."""
    monkeypatch.setattr(N, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(N, "PIECE", 50)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghij é\U0001f600") for _ in range(n))
    texts = [(i, text(300)) for i in range(60)] + [(90, None), (91, "")]
    words = sorted({t[k : k + n].lower() for _, t in texts[:60] for k in (0, 45, 120) for n in (9, 12)} | {text(9) for _ in range(3_000)})
    df = spark.createDataFrame(texts, "id int, t string")
    got = N.term_hits(df, "id", "t", spark.createDataFrame([(w,) for w in words], "w string"), "w")
    want = sorted((i, w) for i, t in texts for w in words if t and w in t.lower())
    assert sorted(tuple(r) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan and "explode" not in plan
    seen = N._likely([9, 12], N._key_filter(spark.createDataFrame([(w,) for w in words], "w string")))
    assert df.filter("t <> ''").mapInArrow(seen, "__id int, key string").count() <= len(want) + 60 * 600 // 100
