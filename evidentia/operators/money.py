"""Sums of money against their words: number words read as numbers, and an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.arrays import as_row, bound, match_groups
from evidentia.functions.words import CASES, FORMS

#: Words beside the forms of numbers, as hundredths or roles.
SCALES = {"thousand": 1000, "thousands": 1000, "million": 10**6, "millions": 10**6, "billion": 10**9, "billions": 10**9}
ONE_AND_HALF = "полтора полторы полутора".split()
HALF = "половиной половина половины".split()
WHOLE = "целых целая целой целую".split()
TENTHS = "десятых десятая десятой десятую".split()
HUNDREDTHS = "сотых сотая сотой сотую".split()
CURRENCIES = {"рубль": r"рубл\p{L}*|руб\.?|р\.|₽", "копейка": r"копе\p{L}*|коп\.?", "доллар": r"доллар\p{L}*|usd|\$", "евро": r"евро|eur|€", "тенге": r"тенге|kzt|₸", "цент": r"цент\p{L}*"}
ABBREVIATIONS = {"тыс": 1000, "млн": 10**6, "млрд": 10**9}
MINOR = ("копе", "коп", "цент")


GENDERS = "mfn"
ALL = 2**18 - 1


def _table() -> dict[str, tuple[str, int, int]]:
    """word -> role, value, bits. Bits of a number: the cases it can be in, six
    for each gender; of a scale: the cases after one, after two to four, and
    after others."""
    out: dict[str, tuple[str, int, int]] = {}

    def add(word: str, role: str, value: int, bits: int) -> None:
        out[word] = (role, value, bits | (out[word][2] if word in out else 0))

    for name, forms in FORMS.items():
        if name in SCALES:
            one, many = FORMS[name.removesuffix("s")], FORMS[f"{name.removesuffix('s')}s"]
            for w in forms:
                few = [one[1] if c in ("nom", "acc") else many[i] for i, c in enumerate(CASES)]
                others = [many[1] if c in ("nom", "acc") else many[i] for i, c in enumerate(CASES)]
                add(w, "scale", SCALES[name], sum(1 << (6 * k + i) for k, row in enumerate((one, few, others)) for i in range(6) if row[i] == w))
        else:
            own = [GENDERS.index(name[-1])] if name[-1] in GENDERS else [0, 1, 2]
            for i, w in enumerate(forms):
                add(w, "unit", int(name.rstrip(GENDERS)), sum(1 << (6 * g + i) for g in own))
    for role, value, names in (("half_more", 150, ONE_AND_HALF), ("half", 50, HALF), ("whole", 0, WHOLE), ("part", 10, TENTHS), ("part", 100, HUNDREDTHS), ("and", 0, ["с"])):
        for w in names:
            add(w, role, value, ALL)
    return out


def read_words(words: Column) -> Column:
    """(value, one_case) of an array of number words: hundreds, tens and ones in
    order under falling scales, `one and a half`, `two and a half`, and tenths or
    hundredths after a whole part. value is null for anything else; one_case
    says whether all words are in one case, scales in the form that their number
    asks for and ones and twos in its gender."""
    known = _table()
    table = F.create_map(*[x for w, (role, v, bits) in known.items() for x in (F.lit(w), F.struct(F.lit(role).alias("k"), F.lit(v).cast("long").alias("v"), F.lit(bits).alias("b")))])

    def state(total, cur, whole, last, ok, group, cases) -> Column:
        return F.struct(total.cast("long").alias("total"), cur.cast("long").alias("cur"), whole.cast("long").alias("whole"), last.cast("long").alias("last"), ok.alias("ok"), group.cast("int").alias("group"), cases.cast("int").alias("cases"))

    def step(at: Column, w: Column) -> Column:
        def with_kind(x: Column) -> Column:
            kind, v, bits = x["k"], x["v"], x["b"]
            cur, low = at["cur"], at["cur"] % 10_000  # hundredths: low is what stands under a hundred
            keep = (at["group"], at["cases"])
            free = F.when(v >= 100, cur == 0).when(v >= 10, low == 0).otherwise((low % 1000 == 0) & ((low == 0) | (low >= 2000)))
            unit = state(at["total"], cur + v * 100, at["whole"], at["last"], at["ok"] & free & (cur % 100 == 0), at["group"].bitwiseAND(bits), at["cases"])
            n = F.floor(cur / 100)
            teen = (n % 100).between(11, 14)
            shift = F.when((n % 10 == 1) & ~teen, 0).when((n % 10).between(2, 4) & ~teen, 6).otherwise(12)
            form = F.floor(bits / F.pow(F.lit(2.0), shift)).cast("int").bitwiseAND(63)
            own = F.when(v == 1000, F.shiftright(at["group"], 6)).otherwise(at["group"]).bitwiseAND(63)
            cases = F.when(cur == 0, 0).otherwise(at["cases"].bitwiseAND(form).bitwiseAND(own))
            scale = state(at["total"] + F.when(cur == 0, 100).otherwise(cur) * v, F.lit(0), F.lit(-1), v, at["ok"] & (v < at["last"]), F.lit(ALL), cases)
            part = state(at["total"], at["whole"] + F.floor(cur / v), F.lit(-1), at["last"], at["ok"] & (at["whole"] >= 0), *keep)
            more = state(at["total"], cur + v, at["whole"], at["last"], at["ok"] & (F.when(kind == "half", cur > 0).otherwise(cur == 0)), *keep)
            whole = state(at["total"], F.lit(0), cur, at["last"], at["ok"] & (at["whole"] < 0), *keep)
            bad = state(at["total"], cur, at["whole"], at["last"], F.lit(False), *keep)
            return F.when(kind == "unit", unit).when(kind == "scale", scale).when(kind == "part", part).when(kind.isin("half", "half_more"), more).when(kind == "whole", whole).when(kind == "and", at).otherwise(bad)

        return bound(F.try_element_at(table, w), with_kind)

    first = state(F.lit(0), F.lit(0), F.lit(-1), F.lit(10**12), F.lit(True), F.lit(ALL), F.lit(63))

    def ended(d: Column) -> Column:
        g = d["group"]
        last = g.bitwiseOR(F.shiftright(g, 6)).bitwiseOR(F.shiftright(g, 12)).bitwiseAND(63)
        value = F.when((F.size(words) > 0) & d["ok"] & (d["whole"] < 0), ((d["total"] + d["cur"]) / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)"))
        return F.struct(value.alias("value"), (d["cases"].bitwiseAND(last) != 0).alias("one_case"))

    return bound(F.aggregate(words, first, step), ended)


def read_number(words: Column) -> Column:
    """The value of read_words."""
    return read_words(words)["value"]


def currency_of(token: Column) -> Column:
    """The currency a word, sign or abbreviation stands for; null for others."""
    out = F.lit(None).cast("string")
    for name, pattern in CURRENCIES.items():
        out = F.when(token.rlike(rf"(?iuU)^(?:{pattern})$"), name).otherwise(out)
    return out


NUM = r"\d{1,3}(?:[ \x{A0}\x{202F}]\d{3})+|\d+"
CUR = "|".join(CURRENCIES.values())
AFTER = rf"(?iuU)(?<![\d.,])({NUM})([.,]\d{{1,2}})?(?!\d)\s*(тыс|млн|млрд)?\.?\s*({CUR})?(?![\p{{L}}])\s*(?:\(([^()]*\p{{L}}[^()]*)\)\s*({CUR})?(?![\p{{L}}]))?"


def _either(words: set[str]) -> str:
    """A pattern of any of the words, longer ones first, that tries each
    beginning once."""
    heads = sorted({w[0] for w in words if w})
    tails = [h + _either({w[1:] for w in words if w[:1] == h}) for h in heads]
    if not tails:
        return ""
    return f"(?:{'|'.join(tails)})" + ("?" if "" in words else "") if "" in words or len(tails) > 1 else tails[0]


def _before() -> str:
    numerals = _either(set(_table()))
    return rf"(?iuU)(?<!\p{{L}})((?:(?:{numerals})\s+)+)\(\s*({NUM})([.,]\d{{1,2}})?\s*\)\s*({CUR})(?![\p{{L}}])"


def _clean(words: Column) -> Column:
    """Number words in brackets, without a currency and what follows it."""
    w = F.regexp_replace(F.translate(F.lower(words), "ё-", "е "), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(w, rf"(?uU)(?:^|\s)(?:{CUR})(?:\s.*)?$", ""))


def audit_money(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ord, quoted, amount, currency, words, words_value, status of each sum:
    a number with a currency after it or after its words in brackets, or words
    with the number in brackets.

    status: ok; mixed_cases (the value is right, the words agree in no case);
    mismatch; unreadable (the words are no number); abbreviated (thousand or
    million shortened: the sum is the product, and should be written out);
    no_words; quoted (in a quotation, where words may be missing but must be
    right where they stand). Null texts hold no sums."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    quotes = F.array_join(F.regexp_extract_all(text, F.lit("«[^»]*»"), F.lit(0)), " ; ")
    sides = F.array(F.struct(F.lit(False).alias("quoted"), F.regexp_replace(text, "«[^»]*»", " ; ").alias("t")), F.struct(F.lit(True).alias("quoted"), quotes.alias("t")))
    rows = df.select(id_col, F.inline(sides)).filter(F.col("t").rlike(r"\d"))
    among = rf"(?iuU)(?<!\p{{L}})({CUR})(?!\p{{L}})"  # the currency in the brackets
    blank = lambda c: F.nullif(c, F.lit(""))

    def first(z: Column) -> Column:
        return F.struct(z[2].alias("n"), z[3].alias("frac"), F.lit("").alias("abbr"), z[4].alias("cur"), F.trim(z[1]).alias("words"))

    def second(z: Column) -> Column:
        cur = F.coalesce(blank(z[4]), blank(z[6]), blank(F.regexp_extract(z[5], among, 1)), F.lit(""))
        return F.struct(z[1].alias("n"), z[2].alias("frac"), z[3].alias("abbr"), cur.alias("cur"), z[5].alias("words"))

    def found(pieces: Column) -> Column:
        rest = F.array_join(F.transform(pieces, lambda z: F.element_at(z, -1)), " ; ")
        later = bound(match_groups(rest, AFTER, 6), lambda x: F.transform(F.slice(x, 2, F.size(x)), second))
        return F.concat(F.transform(F.slice(pieces, 2, F.size(pieces)), first), later)

    pieces = F.when(F.contains("t", F.lit("(")), match_groups(F.col("t"), _before(), 4)).otherwise(F.array(F.array("t")))
    each = F.filter(bound(pieces, found), lambda z: z["cur"] != "")
    rows = rows.select(id_col, "quoted", as_row(each, "each"))
    rows = rows.select(id_col, "quoted", F.posexplode("each").alias("ord", "z")).select(id_col, "quoted", "ord", "z.*")
    scale = F.lit(1)
    for name, times in ABBREVIATIONS.items():
        scale = F.when(F.lower("abbr") == name, times).otherwise(scale)
    whole = F.regexp_replace("n", r"[^0-9]", "").try_cast("decimal(15,0)")
    cents = F.rpad(F.regexp_replace("frac", "[.,]", ""), 2, "0")
    amount = ((whole + F.coalesce(F.when(F.col("frac") != "", cents.cast("decimal(4,0)") / 100), F.lit(0).cast("decimal(4,2)"))) * scale).cast("decimal(20,2)")
    rows = rows.withColumns({"amount": amount, "currency": currency_of(F.col("cur")), "words": F.nullif(_clean(F.col("words")), F.lit(""))})
    rows = rows.withColumn("read", F.when(F.col("words").isNotNull(), read_words(F.split("words", " "))))
    rows = rows.withColumns({"words_value": F.col("read.value"), "one_case": F.col("read.one_case")})
    free = F.col("words").rlike(rf"(?U)\b(?:{'|'.join([*ONE_AND_HALF, *HALF, *WHOLE])})\b")
    # Words give the whole part; a fraction in figures is that of the small unit.
    same = (F.col("words_value") == F.col("amount")) | (F.col("words_value") == F.floor("amount"))
    status = (
        F.when((F.col("abbr") != "") & F.col("words").isNull() & ~F.col("quoted"), "abbreviated").when(F.col("words").isNull(), F.when(F.col("quoted"), "quoted").otherwise("no_words"))
        .when(F.col("words_value").isNull(), "unreadable").when(~same, "mismatch").when(free | F.col("one_case"), F.when((F.col("abbr") != "") & ~F.col("quoted"), "abbreviated").otherwise("ok")).otherwise("mixed_cases")
    )
    return rows.select(id_col, "ord", "quoted", "amount", "currency", "words", "words_value", status.alias("status"))


def money_totals(audit: DataFrame, source_col: str) -> DataFrame:
    """source, currency, sums, total, faults (sums whose words are wrong)."""
    return audit.groupBy(source_col, "currency").agg(F.count("*").alias("sums"), F.sum("amount").alias("total"), F.count_if(F.col("status").isin("mismatch", "unreadable", "mixed_cases")).alias("faults"))
