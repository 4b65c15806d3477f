"""Phrase mining against the plain definition."""

import random
import re
from collections import Counter

import duckdb
import pytest

from evidentia.llm import collocations
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string"


def brute(docs, least=30, most=2000, cover=80):
    f, n = Counter(), Counter()
    for _, text, lang in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang, tuple(w[i : i + k])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longest = {}
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                part = lang, p[i : i + k]
                longest[part] = max(longest.get(part, 0), a)
    rows = {}
    for (lang, p), a in candidates.items():
        if 100 * longest.get((lang, p), 0) >= cover * a:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, xs in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:most]))


def found(spark, docs, **more):
    return sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(docs, DOCS), **more).collect())


def made(seed, rows=120):
    rng = random.Random(seed)
    words = ["the", "of", "a", "Ä", "ß|", "x" * 70, "x" * 71, "#1", "été"]
    out = []
    for i in range(rows):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randrange(60)))
        out.append((i, rng.choice([text, text.upper(), "the of a the of a " * 5, text]), rng.choice(["en", "en", "de", None, "", "a\tb"])))
    return out


@pytest.mark.parametrize("budget", [1 << 20, 500, 40])
def test_against_brute_force(spark, budget):
    docs = made(budget)
    assert found(spark, docs, least=5, budget=budget) == brute(docs, least=5)


def test_top_is_cut_per_language(spark):
    docs = made(9)
    assert found(spark, docs, least=3, most=4, budget=200) == brute(docs, least=3, most=4)


def test_odd_rows(spark):
    docs = [(1, None, "en"), (2, "", "en"), (3, " ..\n\t ", None), (4, "one two", "en"), (4, "one two", "en"), (None, "one two three " * 20_000, None), (5, "y" * 300_000, "en"), (6, "a b " * 40, "x"), (7, "b, a. b", "x")]
    assert found(spark, docs) == brute(docs)
    assert found(spark, []) == []
    assert found(spark, [(1, "no phrase twice", "en")]) == []
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as key", "2 as w1", "3 as n", "'x' as label", "4 as code")
    assert sorted(tuple(r) for r in collocations.collocations(df).collect()) == brute(docs)


def test_small_budget_on_the_supplied_table(spark):
    """Groups of a few thousand suffixes, three levels of prefixes."""
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(collocations.ORACLE).fetchall())
    got = collocations.collocations(spark.read.parquet(f"{SF}/documents.parquet"), budget=1000)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_products_past_64_bits():
    """The scores are taken in decimals: 2000000 times a count of 2 ** 60."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    row = spark.range(1).selectExpr(f"cast({2**60} as bigint) n", "cast(3 as bigint) l", f"cast({2**60} as bigint) r")
    assert row.selectExpr("(cast(n as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r) s").first()["s"] == 2000000 * 2**60 // (3 + 2**60)


def test_collision_of_words_is_seen(spark, monkeypatch):
    real = collocations.words_of

    def weak(texts, langs, seed, second=False):
        data, start, size, h, ends, text, other = real(texts, langs, seed, second)
        return data, start, size, (h % 3 + 1) if seed == 0 else h, ends, text, other

    docs = made(5)
    monkeypatch.setattr(collocations, "words_of", weak)
    assert found(spark, docs, least=5) == brute(docs, least=5)
