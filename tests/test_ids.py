"""Identifiers, number words, rules and resets against hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from evidentia.functions import checks as C
from evidentia.functions.words import check_amount_words, spell_number
from evidentia.operators import ids as I


def test_accounts_against_bank_codes(spark):
    ids = [(1, "bik", "044525225"), (1, "bik", "042202824"), (1, "account", "40702810029160002367"), (1, "account", "40702810029160002368"), (2, "account", "40702810029160002368")]
    got = I.accounts_unkeyed(spark.createDataFrame(ids, "doc_id long, kind string, value string")).collect()
    assert [(r.doc_id, r.account) for r in got] == [(1, "40702810029160002368")]


def test_only_labelled_numbers_are_reported(spark):
    df = spark.createDataFrame([(1, "ИНН 1655248573 and 1655248572"), (2, "1655248573")], "id long, t string")
    assert [(r.id, r.value) for r in I.report_ids(df, "id", "t", "ИНН|INN", "[0-9]{10}", C.inn_valid).collect()] == [(1, "1655248573")]


def test_spelled_numbers(spark):
    want = {0: "ноль", 1: "один", 38998: "тридцать восемь тысяч девятьсот девяносто восемь", 21000: "двадцать одна тысяча", 2_000_011: "два миллиона одиннадцать", 999_000_000_000: "девятьсот девяносто девять миллиардов", 10**12: None}
    df = spark.createDataFrame([(k,) for k in want], "n long")
    assert {r.n: r.w for r in df.select("n", spell_number("n").alias("w")).collect()} == want
    assert spark.range(1).select(spell_number(F.lit(22), "f")).first()[0] == "двадцать две"


def test_spelled_cases(spark):
    want = {"nom": "две тысячи пятьсот сорок один", "gen": "двух тысяч пятисот сорока одного", "dat": "двум тысячам пятистам сорока одному", "acc": "две тысячи пятьсот сорок один", "ins": "двумя тысячами пятьюстами сорока одним", "pre": "двух тысячах пятистах сорока одном"}
    row = spark.range(1).select(*[spell_number(F.lit(2541), "m", c).alias(c) for c in want]).first()
    assert row.asDict() == want
    assert spark.range(1).select(spell_number(F.lit(51_000_080), "m", "ins")).first()[0] == "пятьюдесятью одним миллионом восемьюдесятью"


def test_amounts_against_their_words(spark):
    text = "сумма 38 998,29 (Тридцать восемь тысяч девятьсот девяносто восемь) рублей; 5000 (шесть тысяч); о 21 (двадцати одном) рубле"
    got = check_amount_words(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").collect()
    assert [(r.amount, r.ok) for r in got] == [(38998, True), (5000, False), (21, True)]


def test_date_before_a_number(spark):
    df = spark.createDataFrame([(1, "от 01.02.2024, от 03.04.2024 № 77"), (2, "№ 77 от 01.02.2024"), (3, "nothing")], "id long, t string")
    assert {r.id: str(r.near) for r in I.date_near(df, "id", "t", F.lit("№ 77")).collect()} == {1: "2024-04-03", 2: "None", 3: "None"}


def test_unmarked_supersedes(spark):
    d = dt.date
    rows = [(d(2024, 1, 1), "first", []), (d(2024, 2, 1), "this supersedes the rule of 2024-01-01", []), (d(2024, 3, 1), "replaces 2024-01-01", [d(2024, 1, 1)]), (d(2024, 4, 1), "supersedes 2023-01-01", [])]
    got = I.unmarked_supersedes(spark.createDataFrame(rows, "key date, body string, marked array<date>")).collect()
    assert [(r.key, r.older) for r in got] == [(d(2024, 2, 1), d(2024, 1, 1))]


def test_quota_resets(spark):
    t = lambda day: dt.datetime(2024, 5, day)
    rows = [("a", "w", t(1), 1, t(8), False), ("a", "w", t(9), 1, t(15), False), ("b", "w", t(9), 1, t(15), False), ("b", "w", t(9), 2, None, True), ("c", "w", t(8), 1, t(15), False), ("c", "w", t(9), 1, t(15), False)]
    df = spark.createDataFrame(rows, "provider string, limit_id string, ts timestamp, ord int, reset_at timestamp, corrupt boolean")
    assert {r.provider: r.state for r in I.quota_resets(df, F.lit(t(10))).collect()} == {"a": "reset", "b": "unknown", "c": "running"}


def test_rules(spark):
    lines = ['{"rule_id": "a", "expect": "present", "terms": ["x"]}', '{"rule_id": "b", "expect": "maybe", "terms": ["x"]}', '{"rule_id": "c", "expect": "absent", "terms": []}', "{bad", '{"rule_id": "d", "expect": "absent", "terms": ["y"]}', '{"rule_id": "d", "expect": "absent", "terms": ["z"]}']
    got = I.load_rules(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted((str(r.rule_id), str(r.problem)) for r in got) == [("None", "unreadable"), ("a", "None"), ("b", "unknown kind"), ("c", "no terms"), ("d", "duplicate id"), ("d", "duplicate id")]
