"""Number words read back, and sums of money against their words."""

import itertools
from decimal import Decimal

from pyspark.sql import functions as F

from evidentia.functions.words import CASES, spell_number
from evidentia.operators import money as M


def test_every_spelling_is_read(spark):
    numbers = [*range(1, 130), 200, 345, 999, 1000, 1001, 2002, 5000, 11_011, 21_000, 100_000, 999_999, 1_000_000, 2_000_002, 345_678_912, 999_999_999_999]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    spelled = [spell_number("n", g, c).alias(f"{g}{c}") for g, c in itertools.product("mfn", CASES)]
    rows = df.select("n", *spelled).collect()
    words = spark.createDataFrame([(r["n"], w) for r in rows for w in r[1:]], "n long, w string")
    read = words.select("n", M.read_words(F.split("w", " ")).alias("r"))
    assert read.filter("r.value is null or r.value <> n or not r.one_case").count() == 0


def test_other_forms_and_nonsense(spark):
    want = {
        "полтора миллиона": 1_500_000, "полторы тысячи": 1500, "два с половиной миллиона": 2_500_000, "пять целых две десятых": Decimal("5.2"), "одна целая двадцать пять сотых миллиона": 1_250_000, "тысяча": 1000, "миллион сто": 1_000_100,
        "сто двести": None, "двадцать одиннадцать": None, "пять двадцать": None, "тысяча миллион": None, "однако": None, "": None, "половиной": None, "десятых": None, "пять целых": None, "сто рублей": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "w string")
    got = {r["w"]: r["v"] for r in df.select("w", M.read_number(F.filter(F.split("w", " "), lambda x: x != "")).alias("v")).collect()}
    assert {k: None if v is None else Decimal(v) for k, v in want.items()} == got


def audited(spark, texts):
    rows = M.audit_money(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").collect()
    out = [[] for _ in texts]
    for r in sorted(rows, key=lambda r: (r["id"], r["quoted"], r["ord"])):
        out[r["id"]].append((r["amount"], r["currency"], r["status"]))
    return out


def test_audit(spark):
    D = Decimal
    cases = {
        "получить 1 000 (одну тысячу) рублей": [(D("1000.00"), "рубль", "ok")],
        "доплатить 3 000 (триста тысяч) рублей": [(D("3000.00"), "рубль", "mismatch")],
        "1 000 (одна тысяча рублей)": [(D("1000.00"), "рубль", "ok")],
        "сумма 1000 рублей (одна тысяча рублей 00 копеек)": [(D("1000.00"), "рубль", "ok")],
        "47 120,35 (сорок семь тысяч сто двадцать) руб.": [(D("47120.35"), "рубль", "ok")],
        "5 (одна тысяча одной) евро": [(D("5.00"), "евро", "mismatch")],
        "1 001 (одной тысячу один) рубль": [(D("1001.00"), "рубль", "mixed_cases")],
        "7 (несколько) долларов": [(D("7.00"), "доллар", "unreadable")],
        "100 руб.": [(D("100.00"), "рубль", "no_words")],
        "500 тыс. руб. и 12 млн ₽": [(D("500000.00"), "рубль", "abbreviated"), (D("12000000.00"), "рубль", "abbreviated")],
        "суд указал: «взыскать 100 руб. и 5 (шесть) рублей»": [(D("100.00"), "рубль", "quoted"), (D("5.00"), "рубль", "mismatch")],
        "триста тысяч (400 000) рублей, полтора миллиона (1 500 000) рублей": [(D("400000.00"), "рубль", "mismatch"), (D("1500000.00"), "рубль", "ok")],
        "смета (700 000) рублей; 5 штук (пять); дом 7": [],
        "10 USD, $ и 3 коп.": [(D("10.00"), "доллар", "no_words"), (D("3.00"), "копейка", "no_words")],
    }
    more = [None, "", "100 руб. " * 3_000]
    got = audited(spark, [*cases, *more])
    assert dict(zip(cases, got, strict=False)) == cases
    assert got[-3:-1] == [[], []] and len(got[-1]) == 3_000
