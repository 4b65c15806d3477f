"""Base rules by plain code; the estimate against a plain concentration."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import quality_rules as q

DOCS = "doc_id long, text string, lang string, source string"


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "Élan", "ordinary", "words", "stand", "here", "and", "there", "so", "x" * rng.randrange(1, 12)]) for _ in range(n))


def made(seed, rows=400):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        n = rng.choice([3, 9, 10, 40, 120, 300])
        text = "\n".join(words(rng, max(1, n // 4)) for _ in range(4))
        kind = rng.random()
        if kind < 0.05:
            text = re.sub(" ", "&&& ", text)
        elif kind < 0.1:
            text = text + "\n" + text
        elif kind < 0.15:
            text = text.upper()
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b"])))
    return out


ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "a b c d e\na b c d e", "en", "a"), (4, "a b c d e\na b c d e", "en", "a"), (None, "tick tock " * 30_000, "en", "a"), (5, "y" * 300_000, "en", "a"), (6, "one two\x0bthree\x85four #|", "en", "a"), (7, "Aa aA\r\nAa aA\r\nAa aA", "xx", "z")]


def test_base_rules(spark):
    docs = made(1, 120) + ODD
    got = q.judge(spark.createDataFrame(docs, DOCS), ["doc_id"]).collect()
    want = Counter()
    for i, text, lang, source in docs:
        b = base(text)
        want[(i, lang, source, *b, b[0] < 10 or 100 * b[4] > 20 * b[0])] += 1
    assert Counter((r["doc_id"], r["lang"], r["source"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])


def plain_mcd(x, share=0.75, steps=15):
    floor = np.diag(np.array(list(q.FLOORS.values())) ** 2)
    x = x / q.UNIT

    def far(m, inverse):
        return np.maximum(np.einsum("ij,jk,ik->i", x - m, inverse, x - m), 0)

    def bins(d):
        return np.floor(np.log2(d + 2**-20) * q.FINE)

    def within(b, part):
        order = np.sort(b)
        return b <= order[int(np.ceil(part * len(b))) - 1]

    m = np.median(x, 0)
    mad = np.maximum(1.4826 * np.median(np.abs(x - m), 0), np.sqrt(np.diag(floor)))
    best = None
    s0 = np.cov(x.T, bias=True) + floor
    for m, s, logdet in ((x.mean(0), s0, np.linalg.slogdet(s0)[1]), (m, np.diag(mad**2), np.inf)):
        for _ in range(steps):
            b = within(bins(far(m, np.linalg.inv(s))), share)
            m, s = x[b].mean(0), np.cov(x[b].T, bias=True) + floor
            new = np.linalg.slogdet(s)[1]
            if abs(new - logdet) <= 1e-6:
                break
            logdet = new
        if best is None or new < best[0] - 1e-12:
            best = new, m, s
    d = far(best[1], np.linalg.inv(best[2]))
    middle = bins(d)[within(bins(d), 0.5)].max()
    return d / max(1, 2 ** ((middle + 1) / q.FINE) / q.chi_square(0.5))


def test_distances_against_plain_concentration(spark):
    docs = made(2, 500)
    got = q.judge(spark.createDataFrame(docs, DOCS), ["doc_id"], fewest=20)
    rows = got.select("*", *q.vector()).collect()
    groups = {}
    for r in rows:
        if not r["base_failed"]:
            groups.setdefault((r["lang"], r["source"]), []).append(r)
    assert len(groups) == 6
    for g in groups.values():
        x = np.unique(np.array([[r[c] for c in q.NAMES] for r in g], float), axis=0)
        want = dict(zip(map(tuple, x), plain_mcd(x), strict=True))
        for r in g:
            assert r["distance"] == pytest.approx(want[tuple(float(r[c]) for c in q.NAMES)], rel=1e-6, abs=1e-6)
            assert r["kept"] == (r["distance"] <= q.chi_square(1e-6))


def test_outliers_go_and_others_stay(spark):
    rng = random.Random(3)
    docs = [(i, words(rng, 150), "en", "a") for i in range(300)]
    docs += [(1000 + i, words(rng, 150).replace(" ", "#$% "), "en", "a") for i in range(20)]
    docs += [(2000 + i, "one text that stands here very often and has some words " * 1 + words(random.Random(9), 60), "en", "a") for i in range(400)]
    kept = {r["doc_id"]: r["kept"] for r in q.judge(spark.createDataFrame(docs, DOCS), ["doc_id"]).collect()}
    assert all(v == (not 1000 <= i < 2000) for i, v in kept.items())


def test_small_sources_are_judged_together(spark):
    rng = random.Random(4)
    docs = [(i, words(rng, 100 + i), "en", f"s{i % 40}") for i in range(200)] + [(900, words(rng, 150).replace(" ", "&&& "), "en", "s1"), (901, words(rng, 80), "fr", "only")]
    got = {r["doc_id"]: r for r in q.judge(spark.createDataFrame(docs, DOCS), ["doc_id"]).collect()}
    assert not got[900]["kept"] and got[901]["kept"] and got[901]["distance"] is None
    assert sum(not r["kept"] for r in got.values()) == 1


def test_empty_and_extra_columns(spark):
    assert q.judge(spark.createDataFrame([], DOCS), ["doc_id"]).collect() == []
    docs = spark.createDataFrame(made(5, 90), DOCS)
    more = docs.withColumns({c: F.lit(7) for c in ("grp", "n", "bin", "n_words", "x_words", "scale", "m_0")})
    assert sorted(map(repr, q.judge(docs, ["doc_id"]).collect())) == sorted(map(repr, q.judge(more, ["doc_id"]).collect()))


def test_chi_square():
    assert q.chi_square(0.5) == pytest.approx(5.348, abs=1e-3)
    assert q.chi_square(0.01) == pytest.approx(16.812, abs=1e-3)
