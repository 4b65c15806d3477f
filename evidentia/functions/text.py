"""Text measures, labels and normal forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and word lists.
GARBLED_SHARE, MIXED_SHARE, LEAST_BAD = 0.15, 0.08, 3
CONSONANTS = r"[bcdfghjklmnpqrstvwxz]{5}"
DATE = r"\b([0-3]?[0-9])\.([01]?[0-9])\.([0-9]{4})\b"
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(col) -> Column:
    return F.split(_col(col), "\n", -1)


def words(col) -> Column:
    return F.filter(F.split(_col(col), r"[ \t\n\r\f\x0B]+", -1), lambda w: F.length(w) > 0)


def letters_only(col) -> Column:
    return F.regexp_replace(_col(col), r"[^\p{L}]", "")


def signature(kind, col, size: int = 100) -> Column:
    """Kind and the text with digit runs as #, cut to size: groups by shape."""
    return F.concat_ws(":", _col(kind), F.left(F.regexp_replace(_col(col), r"[0-9]+", "#"), F.lit(size)))


def clip(col, size: int) -> Column:
    col = _col(col)
    return F.struct(F.left(col, F.lit(size)).alias("text"), (F.length(col) > size).alias("cut"))


NO_WORD = r"[^\p{L}\p{N}]+"


def _folded(col: Column) -> Column:
    return F.replace(F.lower(col), F.lit("ё"), F.lit("е"))


def norm_words(col) -> Column:
    """Lower case, ё as е, runs of anything but letters and digits as a space."""
    return F.trim(F.regexp_replace(_folded(_col(col)), NO_WORD, " "))


def norm_tokens(*cols) -> Column:
    """The words of norm_words of all cols, one after another; [] if all are NULL."""
    return F.array_remove(F.split(_folded(F.concat_ws(" ", *cols)), NO_WORD), F.lit(""))


def mixed_script(col) -> Column:
    """Words of 4+ characters, and those of them with letters of two alphabets."""
    long = F.filter(words(col), lambda w: F.length(w) >= 4)
    return F.struct(F.size(long).alias("assessed"), F.size(F.filter(long, lambda w: w.rlike(r"\p{IsLatin}") & w.rlike(r"\p{IsCyrillic}"))).alias("bad"))


def garbled(col) -> Column:
    """Words of 4+ letters, and those without a vowel, with five consonants in
    a row, a capital inside, or one letter four times in a row."""
    long = F.filter(words(col), lambda w: w.rlike(r"^[A-Za-z]{4,}$"))
    odd = F.filter(long, lambda w: ~w.rlike("(?i)[aeiouy]") | w.rlike("(?i)" + CONSONANTS) | w.rlike("[a-z][A-Z]") | w.rlike(r"(?i)(.)\1{3}"))
    return F.struct(F.size(long).alias("assessed"), F.size(odd).alias("bad"))


def repeats(col) -> Column:
    """Words with one letter four times in a row."""
    return F.size(F.filter(words(col), lambda w: w.rlike(r"(\p{L})\1{3}")))


#: Cyrillic letters that aren't Russian.
FOREIGN = r"[\x{0400}-\x{04FF}&&[^А-Яа-яЁё]]"


def page_verdict(mixed: Column, odd: Column, foreign: Column) -> Column:
    """The first rule that a page breaks: words of mixed alphabets, words that
    are none, each LEAST_BAD and a share of those assessed, or LEAST_BAD letters
    of a foreign alphabet (a count, say of FOREIGN)."""

    def over(x: Column, share: float) -> Column:
        return (x["bad"] >= LEAST_BAD) & (x["bad"] > x["assessed"] * share)

    return F.when(over(mixed, MIXED_SHARE), "mixed").when(over(odd, GARBLED_SHARE), "garbled").when(foreign >= LEAST_BAD, "foreign")


def alpha_share(col, inside: str = r"[A-Za-z]", least: int = 100) -> Column:
    """Share of letters that are inside the alphabet; NULL under `least` letters."""
    all_ = letters_only(col)
    return F.when(F.length(all_) >= least, F.length(F.regexp_replace(all_, rf"(?!{inside}).", "")) / F.length(all_))


def faux_alphabet(col, alike: str = "ABCEHKMOPTXaceopxy", share: float = 0.08, least: int = 100) -> Column:
    """Whether nearly all letters have a look-alike in another alphabet."""
    all_ = letters_only(col)
    apart = F.length(F.translate(all_, alike, "")) / F.length(all_)
    return F.when(F.length(all_) >= least, apart < share)


def has_table(col) -> Column:
    """An HTML table, three lines with two pipes, or three aligned lines."""
    rows = lines(col)
    piped = F.size(F.filter(rows, lambda x: F.regexp_count(x, F.lit(r"\|")) >= 2))
    aligned = F.size(F.filter(rows, lambda x: x.rlike(r"[^ ] {3,}[^ ]+ {3,}[^ ]")))
    return F.contains(F.lower(_col(col)), F.lit("<table")) | (piped >= 3) | (aligned >= 3)


def license_class(col) -> Column:
    """License family of a text; the order of the tests matters."""
    t = F.upper(F.regexp_replace(_col(col), r"[ \t\n\r]+", " "))
    strong = t.rlike("AGPL|AFFERO")
    return (
        F.when(_col(col).isNull() | (F.trim(t) == ""), "unknown")
        .when(strong, "copyleft")
        .when(t.rlike("LGPL|LESSER GENERAL PUBLIC"), "weak")
        .when(t.rlike("MPL|MOZILLA PUBLIC"), "weak")
        .when(t.rlike("GPL|GENERAL PUBLIC LICENSE"), "copyleft")
        .when(t.rlike("MIT LICENSE|APACHE|BSD|ISC LICENSE|UNLICENSE|PUBLIC DOMAIN|CC0"), "permissive")
        .otherwise("unknown")
    )


def is_repealed(head, body) -> Column:
    return F.concat(F.coalesce(_col(head), F.lit("")), F.left(F.coalesce(_col(body), F.lit("")), F.lit(400))).rlike(r"(?iu)утратил[аи]? силу|repealed|no longer in force|deprecated")


def freshness(date, today) -> Column:
    """unknown, suspicious (over three years of 365.25 days) or ok."""
    age = F.datediff(_col(today), _col(date)) / 365.25
    return F.when(_col(date).isNull(), "unknown").when(age > 3, "suspicious").otherwise("ok")


def is_due(date, today, days: int = 7) -> Column:
    late = F.datediff(_col(today), _col(date))
    return F.coalesce((late > days) | (late < 0), F.lit(True))


def excerpt(text, pattern: str) -> Column:
    """The sentence around the first match, bounded by a line feed or full stop.
    It is tried from the beginning of each sentence alone, so that the time is
    linear in the length of a sentence."""
    return F.nullif(F.trim(F.regexp_extract(_col(text), rf"(?<![^\n.])[^\n.]*(?:{pattern})[^\n.]*\.?", 0)), F.lit(""))


def finding_id(*parts) -> Column:
    return F.left(F.sha2(F.concat_ws("\x1f", *[_col(p) for p in parts]), 256), F.lit(16))


def integrity(col, declared) -> Column:
    """Whether the text's SHA-256 is the declared one; NULL if none is declared."""
    return F.when(_col(declared).isNotNull() & (_col(declared) != ""), F.sha2(_col(col), 256) == F.lower(_col(declared)))


def translit(col) -> Column:
    """Latin to Cyrillic, longest groups first."""
    out = F.lower(_col(col))
    for a, b in (("shch", "щ"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"), ("ya", "я"), ("yo", "ё")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, "abvgdeziyklmnoprstufhc", "абвгдезийклмнопрстуфхк")


def parse_dates(col) -> Column:
    """Distinct dates of a text, in order: dd.mm.yyyy and day month-name year."""
    t = _col(col)
    months = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(i))])
    dotted = F.transform(F.regexp_extract_all(t, F.lit(DATE), F.lit(0)), lambda m: F.try_to_date(F.concat_ws(".", F.lpad(F.split_part(m, F.lit("."), F.lit(1)), 2, "0"), F.lpad(F.split_part(m, F.lit("."), F.lit(2)), 2, "0"), F.split_part(m, F.lit("."), F.lit(3))), "dd.MM.yyyy"))
    named = F.transform(F.regexp_extract_all(t, F.lit(r"(?iu)([0-3]?[0-9])\s+(" + "|".join(MONTHS) + r")\s+([0-9]{4})"), F.lit(0)), lambda m: F.try_to_date(F.concat_ws("-", F.regexp_extract(m, "([0-9]{4})$", 1), F.lpad(F.element_at(months, F.lower(F.regexp_extract(m, r"(?u)([\p{L}]+)", 1))).cast("string"), 2, "0"), F.lpad(F.regexp_extract(m, "^([0-9]+)", 1), 2, "0")), "yyyy-MM-dd"))
    return F.array_distinct(F.filter(F.concat(dotted, named), lambda d: d.isNotNull()))


def money_parse(col) -> Column:
    """A money literal as DECIMAL(18,2): spaces group, a comma before one or two
    last digits is the fraction's, commas between triples group. NULL if it is
    no positive amount."""
    t = F.regexp_replace(_col(col), r"[\s  ]+", "")
    grouped = t.rlike(r"^[0-9]{1,3}(,[0-9]{3})+(\.[0-9]{1,2})?$")
    plain = F.when(grouped, F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    value = F.when(plain.rlike(r"^[0-9]+(\.[0-9]{1,2})?$"), plain.try_cast("decimal(18,2)"))
    return F.when(value > 0, value)


def plural_form(n, one, few, many) -> Column:
    n = F.abs(_col(n))
    return F.when((n % 100).between(11, 14), many).when(n % 10 == 1, one).when((n % 10).between(2, 4), few).otherwise(many)


def days_in_year(col) -> Column:
    return F.dayofyear(F.make_date(F.year(_col(col)), F.lit(12), F.lit(31)))


def term_end(start, days: int = 0, months: int = 0, years: int = 0) -> Column:
    """Last day of a term that begins the day after start: years, months and
    days in turn; years and months each end the day before."""
    first = F.date_add(_col(start), 1)
    end = first
    if years:
        end = F.date_sub(F.add_months(end, 12 * years), 1)
    if months:
        end = F.date_sub(F.add_months(end, months), 1)
    if days:
        end = F.date_add(end, days - 1)
    return end
