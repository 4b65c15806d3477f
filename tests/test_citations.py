"""Mentions of a text, the states of citations, and edges between documents."""

import datetime as dt

from evidentia.operators import citations as C

CODES = {"ГК": "gk", "НК": "nk", "Трудовой кодекс": "tk", "УК": "uk"}


def found(spark, text, own="own"):
    df = spark.createDataFrame([(1, own, text)], "id int, own string, text string")
    return [(r["kind"], r["number"], r["chapter"], r["code"], str(r["day"]) if r["day"] else None, r["act_number"]) for r in sorted(C.mentions(df, "text", CODES, "own").collect(), key=lambda r: r["ord"])]


def art(code, *numbers, chapter=None):
    return [("article", n, chapter, code, None, None) for n in numbers]


def test_forms(spark):
    assert found(spark, "По ст. 10 ГК РФ и статье 12.1 нк рф") == art("gk", "10") + art("nk", "12.1")
    assert found(spark, "статьи 1, 2 и 3-1 Трудового; статьями 5; 7 или 9 Трудовой кодекс") == art("tk", "5", "7", "9")
    assert found(spark, "ст.ст. 4 ГК, ст 8 ГК, ст. 9 ГК") == art("gk", "4", "8", "9")
    assert found(spark, "статьи 10–12, 15 ГК") == art("gk", "10", "11", "12", "15")
    assert found(spark, "статьи 9 - 7 ГК и ст. 1–99999 ГК") == art("gk", "9", "7", "1", "99999")
    assert found(spark, "ст. 214.7 главы 18.4 НК") == art("nk", "214.7", chapter="18.4")
    assert found(spark, "глава 18.4 НК, гл. 7 и 8 ГК") == [("chapter", "18.4", None, "nk", None, None), ("chapter", "7", None, "gk", None, None), ("chapter", "8", None, "gk", None, None)]
    assert found(spark, "п. 17 Пленума ВС РФ от 14.03.2011 № 8, пункты 3, 4 постановления Пленума ВС РФ от 08.09.2006") == [("point", "17", None, None, "2011-03-14", "8"), ("point", "3", None, None, "2006-09-08", None), ("point", "4", None, None, "2006-09-08", None)]


def test_this_and_the_same_code(spark):
    assert found(spark, "ст. 1 настоящего Кодекса, ст. 2 ГК, ст. 3 того же кодекса, ст. 4 настоящего Кодекса, ст. 5 того же Кодекса") == art("own", "1") + art("gk", "2", "3") + art("own", "4", "5")
    assert found(spark, "ст. 3 того же кодекса") == [] and found(spark, "ст. 3 настоящего кодекса", None) == []


def test_no_qualifier_no_mention(spark):
    assert found(spark, "ст. 10, стр. 5 ГК, часть 3 ГК, ст. 7 ГКО, пост. 8 ГК") == []
    assert found(spark, None) == [] and found(spark, "") == []
    assert len(found(spark, "ст. 5 ГК. " * 3_000)) == 3_000


def test_states(spark):
    sections = spark.createDataFrame(
        [("gk", "article", "10", "2", False, 900), ("gk", "article", "11", "2", True, 900), ("gk", "chapter", "2", None, False, 30), ("gk", "chapter", "3", None, False, 300), ("p1", "point", "17", None, False, 90), ("p2", "point", "15", None, True, 90)],
        "code string, kind string, number string, chapter string, repealed boolean, body_chars int",
    )
    day = dt.date
    acts = spark.createDataFrame([("p1", day(2011, 3, 14), 8), ("p2", day(2011, 3, 14), 9), ("p2x", day(2013, 1, 1), 1)], "code string, day date, act_number int")
    gaps = spark.createDataFrame([("gk", "99")], "code string, number string")
    asked = {
        "ст. 10 ГК": "found", "ст. 1 ГК": "missing", "ст. 100 ГК": "missing", "ст. 11 ГК": "repealed", "ст. 99 ГК": "known_missing", "ст. 10 главы 2 ГК": "found", "ст. 10 главы 5 ГК": "missing",
        "ст. 1 УК": "not_exported", "глава 2 ГК": "heading_only", "глава 3 ГК": "found", "п. 17 Пленума ВС РФ от 14.03.2011 № 8": "found", "п. 2 Пленума ВС РФ от 14.03.2011 № 8": "missing",
        "п. 15 Пленума ВС РФ от 14.03.2011 № 9": "repealed", "п. 17 Пленума ВС РФ от 14.03.2011": "ambiguous_date", "п. 1 Пленума ВС РФ от 01.01.2013": "not_exported", "п. 1 Пленума ВС РФ от 02.01.2013": "unknown_act", "ст. 5 ХХ": "unparsed", "": "unparsed",
    }
    q = spark.createDataFrame([(x,) for x in [*asked, None, "ст. 10 ГК"]], "q string")
    got = [(r["q"], r["status"]) for r in C.resolve(q, "q", CODES, sections, acts, gaps).collect()]
    assert sorted(got, key=repr) == sorted([*asked.items(), (None, "unparsed"), ("ст. 10 ГК", "found")], key=repr)


def test_edges(spark):
    nodes = spark.createDataFrame([("a1", "gk", "см. ст. 2 и 3 ГК, ст. 1 ГК"), ("a2", "gk", "ст. 1 настоящего Кодекса и ст. 77 ГК"), ("n1", "nk", "статьи 1–3 ГК; статьи 1–3 ГК")], "id string, code string, t string")
    targets = spark.createDataFrame([(f"a{i}", "gk", "article", str(i)) for i in (1, 2, 3)] + [("n1", "nk", "article", "1")], "id string, code string, kind string, number string")
    got = sorted(tuple(r) for r in C.reference_edges(nodes, "t", CODES, targets).collect())
    assert got == [(s, t, "references") for s, t in [("a1", "a2"), ("a1", "a3"), ("a2", "a1"), ("n1", "a1"), ("n1", "a2"), ("n1", "a3")]]
