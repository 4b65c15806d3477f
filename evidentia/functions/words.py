"""Whole numbers in Russian words, six cases and three genders, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASES = ("nom", "gen", "dat", "acc", "ins", "pre")


# Number words in the six cases, in the order of CASES. one and two
# have a row for each gender; scales a row for one and a row for several.
WORDS = """
0 ноль нуля нулю ноль нулем нуле
1m один одного одному один одним одном
1f одна одной одной одну одной одной
1n одно одного одному одно одним одном
2m два двух двум два двумя двух
2f две двух двум две двумя двух
2n два двух двум два двумя двух
3 три трех трем три тремя трех
4 четыре четырех четырем четыре четырьмя четырех
5 пять пяти пяти пять пятью пяти
6 шесть шести шести шесть шестью шести
7 семь семи семи семь семью семи
8 восемь восьми восьми восемь восемью восьми
9 девять девяти девяти девять девятью девяти
10 десять десяти десяти десять десятью десяти
11 одиннадцать одиннадцати одиннадцати одиннадцать одиннадцатью одиннадцати
12 двенадцать двенадцати двенадцати двенадцать двенадцатью двенадцати
13 тринадцать тринадцати тринадцати тринадцать тринадцатью тринадцати
14 четырнадцать четырнадцати четырнадцати четырнадцать четырнадцатью четырнадцати
15 пятнадцать пятнадцати пятнадцати пятнадцать пятнадцатью пятнадцати
16 шестнадцать шестнадцати шестнадцати шестнадцать шестнадцатью шестнадцати
17 семнадцать семнадцати семнадцати семнадцать семнадцатью семнадцати
18 восемнадцать восемнадцати восемнадцати восемнадцать восемнадцатью восемнадцати
19 девятнадцать девятнадцати девятнадцати девятнадцать девятнадцатью девятнадцати
20 двадцать двадцати двадцати двадцать двадцатью двадцати
30 тридцать тридцати тридцати тридцать тридцатью тридцати
40 сорок сорока сорока сорок сорока сорока
50 пятьдесят пятидесяти пятидесяти пятьдесят пятьюдесятью пятидесяти
60 шестьдесят шестидесяти шестидесяти шестьдесят шестьюдесятью шестидесяти
70 семьдесят семидесяти семидесяти семьдесят семьюдесятью семидесяти
80 восемьдесят восьмидесяти восьмидесяти восемьдесят восемьюдесятью восьмидесяти
90 девяносто девяноста девяноста девяносто девяноста девяноста
100 сто ста ста сто ста ста
200 двести двухсот двумстам двести двумястами двухстах
300 триста трехсот тремстам триста тремястами трехстах
400 четыреста четырехсот четыремстам четыреста четырьмястами четырехстах
500 пятьсот пятисот пятистам пятьсот пятьюстами пятистах
600 шестьсот шестисот шестистам шестьсот шестьюстами шестистах
700 семьсот семисот семистам семьсот семьюстами семистах
800 восемьсот восьмисот восьмистам восемьсот восемьюстами восьмистах
900 девятьсот девятисот девятистам девятьсот девятьюстами девятистах
thousand тысяча тысячи тысяче тысячу тысячей тысяче
thousands тысячи тысяч тысячам тысячи тысячами тысячах
million миллион миллиона миллиону миллион миллионом миллионе
millions миллионы миллионов миллионам миллионы миллионами миллионах
billion миллиард миллиарда миллиарду миллиард миллиардом миллиарде
billions миллиарды миллиардов миллиардам миллиарды миллиардами миллиардах
"""
FORMS = {name: tuple(forms) for name, *forms in (line.split() for line in WORDS.strip().splitlines())}
#: Scales from the greatest: name, and the gender of its own number.
SCALES = (("billion", "m"), ("million", "m"), ("thousand", "f"))


def _lists(gender: str, c: int) -> tuple[list[str], list[str], list[str]]:
    """Words of 0..19, of the tens and of the hundreds in one case."""

    def of(names) -> list[str]:
        return [FORMS[n][c] for n in names]

    units = of([f"1{gender}", f"2{gender}", *map(str, range(3, 20))])
    return ["", *units], ["", "", *of(map(str, range(20, 100, 10)))], ["", *of(map(str, range(100, 1000, 100)))]


def _pick(words, at: Column) -> Column:
    return F.nullif(F.element_at(F.array(*[F.lit(w) for w in words]), at.cast("int") + 1), F.lit(""))


def _triple(n: Column, gender: str, c: int) -> Column:
    """Words of 0..999; empty for 0."""
    units, tens, hundreds = _lists(gender, c)
    rest = n % 100
    low = F.when(rest < 20, _pick(units, F.least(rest, F.lit(19)))).otherwise(F.concat_ws(" ", _pick(tens, F.floor(rest / 10)), _pick(units, rest % 10)))
    return F.concat_ws(" ", _pick(hundreds, F.floor(n / 100)), low)


def spell_number(col, gender: str = "m", case: str = "nom") -> Column:
    """0 to 999 999 999 999 in words; NULL outside. gender (m, f, n) is that of
    the thing counted, case one of CASES (the accusative of things)."""
    n = (F.col(col) if isinstance(col, str) else col).cast("bigint")
    c = CASES.index(case)
    parts = []
    for i, (scale, own) in enumerate(SCALES):
        group = F.floor(n / 10 ** (9 - 3 * i)) % 1000
        teen = (group % 100).between(11, 14)
        one, many = FORMS[scale], FORMS[f"{scale}s"]
        if case in ("nom", "acc"):  # two to four take the genitive of one, others that of several
            other = F.when((group % 10).between(2, 4) & ~teen, one[1]).otherwise(many[1])
        else:
            other = F.lit(many[c])
        word = F.when((group % 10 == 1) & ~teen, one[c]).otherwise(other)
        parts.append(F.when(group > 0, F.concat_ws(" ", _triple(group, own, c), word)))
    parts.append(F.nullif(_triple(n % 1000, gender, c), F.lit("")))
    return F.when(n == 0, FORMS["0"][c]).when(n.between(1, 999_999_999_999), F.concat_ws(" ", *parts))


def check_amount_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, amount, words, ok for each number with words in brackets after it:
    whether the words, without a currency after them, spell the number in some
    case and gender."""
    pattern = r"(?iuU)([0-9]{1,3}(?:[ \x{A0}\x{202F}]?[0-9]{3})*)(?:[.,][0-9]{2})? ?\(([а-яё ]+)\)"
    text = F.col(text_col)
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("w"))
    rows = df.select(id_col, F.explode(pairs).alias("x")).select(id_col, F.regexp_replace("x.a", r"[^0-9]", "").cast("bigint").alias("amount"), F.trim(F.regexp_replace(F.translate(F.lower("x.w"), "ё", "е"), r"\s+", " ")).alias("words"))
    spelled = F.array(*[spell_number("amount", g, c) for g in ("m", "f", "n") for c in CASES])
    return rows.withColumn("ok", F.coalesce(F.array_contains(spelled, F.regexp_replace("words", r" (рубл|коп|доллар|евро|тенге).*$", "")), F.lit(False)))
