"""Renamed and renumbered items among other texts; numbers; hot templates."""

import random

from pyspark.sql import functions as F

from evidentia.llm import decontam

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(rng, n):
    return " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4))) for _ in range(n))


def item(rng, i):
    """A question with slots {0} (name), {1}, {2} (numbers) between own words."""
    return f"{words(rng, 5)} {{0}} {words(rng, 4)} {{1}} {words(rng, 6)} {{2}} km {words(rng, 4)} {{0}} {words(rng, 3)}"


def found(spark, docs, items, **more):
    got = decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more)
    return {(r["doc_id"], r["item_id"]): r["exact"] for r in got.collect()}


def test_precision_and_recall_on_renamed_items(spark):
    rng = random.Random(1)
    forms = [item(rng, i) for i in range(40)]
    items = [(i, f.format("Maria", 10 + i, 5)) for i, f in enumerate(forms)]
    docs, want = [], {}
    for d in range(300):
        kind, i = d % 5, rng.randrange(40)
        before, after = words(rng, rng.randrange(30)), words(rng, rng.randrange(30))
        if kind == 0:
            text, exact = items[i][1], True
        elif kind == 1:
            text, exact = forms[i].format("Peter", 700 + d, "2.5"), False
        elif kind == 2:
            text, exact = items[i][1].upper(), True
        elif kind == 3:  # another question of the same shape
            text, exact = item(rng, d).format("Maria", 10 + i, 5), None
        else:
            text, exact = words(rng, 60), None
        docs.append((d, f"{before} {text} {after}"))
        if exact is not None:
            want[d, i] = exact
    assert found(spark, docs, items) == want


def test_signs_and_decimals_are_part_of_a_number(spark):
    q = "The river rose by {0} percent over the whole of that long winter and then fell by {1} degrees"
    items = [(1, q.format("3.5", "-5"))]
    docs = [(1, q.format("35", "-5")), (2, q.format("3.5", "5")), (3, q.format("3.5", "-5")), (4, q.format("3,500.25", "7")), (5, "so: " + q.format("3.5", "-5.") + "!")]
    assert found(spark, docs, items) == {(1, 1): False, (2, 1): False, (3, 1): True, (4, 1): False, (5, 1): True}


def test_tables_of_numbers_do_not_multiply(spark):
    rng = random.Random(2)
    items = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(12))) for i in range(20)]
    docs = [(d, " ".join(str(rng.randrange(10**6)) for _ in range(3_000))) for d in range(20)]
    docs.append((99, "table: " + docs[0][1] + " " + items[7][1] + " end"))
    half = items[3][1].split()
    half[0:12:3] = ["1", "2", "3", "4"]  # a third of the values are others
    docs.append((98, " ".join(half)))
    assert found(spark, docs, items, cover=0.9) == {(99, 7): True, (98, 3): False}


def test_long_texts_null_ids_and_clashing_columns(spark):
    rng = random.Random(3)
    text = item(rng, 0).format("Maria", 4, 6)
    docs = [(1, words(rng, 40_000) + " " + text), (None, text), (2, None), (2, ""), (3, "x" * 200_000), (4, text), (4, text)]
    assert found(spark, docs, [(7, text), (8, None), (9, " ")]) == {(1, 7): True, (None, 7): True, (4, 7): True}
    more = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(1) for c in ("h", "at", "w", "item", "i", "d", "tw", "cw", "slots")})
    b = spark.createDataFrame([(7, text)], ITEMS).withColumns({c: F.lit(1) for c in ("h", "ih", "w", "heavy", "slots")})
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(more, b).collect()} == {(1, 7), (None, 7), (4, 7)}
