"""Check digits and identifier formats as column expressions.

All give NULL for NULL and false for a wrong shape.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight vectors, prefixes and region bounds of the identifiers.
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
ACCOUNT = (7, 1, 3)
BIK_PREFIXES = ("00", "01", "04", "10", "20")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits(col: Column) -> Column:
    return F.transform(F.split(col, ""), lambda c: c.cast("int"))


def weighted_sum(values: Column, weights) -> Column:
    """Sum of products of an integer array and weights."""
    pairs = F.zip_with(values, F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def check_digit(col, weights, modulus: int = 11, last: int = 10) -> Column:
    """Weighted sum of the first digits, mod modulus, mod last."""
    col = _col(col)
    return weighted_sum(digits(F.left(col, F.lit(len(weights)))), weights) % modulus % last


def _digit(col: Column, at: int) -> Column:
    return F.substring(col, at, 1).cast("int")


def inn_valid(col) -> Column:
    """Tax number of 10 digits (one check digit) or 12 (two)."""
    col = _col(col)
    ten = check_digit(col, INN10) == _digit(col, 10)
    twelve = (check_digit(col, INN11) == _digit(col, 11)) & (check_digit(col, INN12) == _digit(col, 12))
    return F.when(col.isNull(), None).when(col.rlike("^[0-9]{10}$"), ten).when(col.rlike("^[0-9]{12}$"), twelve).otherwise(False)


def ogrn_valid(col) -> Column:
    """Registry number: all but the last digit mod 11 (13) or mod 13 (15), mod 10."""
    col = _col(col)

    def of(n: int, m: int) -> Column:
        return (F.left(col, F.lit(n - 1)).cast("bigint") % m % 10).cast("int") == F.right(col, F.lit(1)).cast("int")

    return F.when(col.isNull(), None).when(col.rlike("^[0-9]{13}$"), of(13, 11)).when(col.rlike("^[0-9]{15}$"), of(15, 13)).otherwise(False)


def snils_valid(col) -> Column:
    """Insurance number: weights 9..1 mod 101, 100 as 0; one repeated digit is
    rejected first; up to 001-001-998 there is no check number."""
    bare = F.regexp_replace(_col(col), r"[^0-9]", "")
    number, check = F.left(bare, F.lit(9)).cast("bigint"), F.right(bare, F.lit(2)).cast("int")
    total = weighted_sum(digits(F.left(bare, F.lit(9))), range(9, 0, -1)) % 101
    return F.when(_col(col).isNull(), None).when(~bare.rlike("^[0-9]{11}$") | bare.rlike(r"^(\d)\1+$"), False).when(number <= 1001998, number > 0).otherwise(F.when(total == 100, 0).otherwise(total) == check)


def kpp_valid(col) -> Column:
    """Tax-reason code: 4 digits, 2 digits or capital letters, 3 digits, and a
    nonzero office."""
    col = _col(col)
    return col.rlike("^[0-9]{4}[0-9A-Z]{2}[0-9]{3}$") & (F.substring(col, 5, 2) != "00")


def bik_valid(col) -> Column:
    """Bank code: 9 digits, not one repeated, with a known prefix."""
    col = _col(col)
    return col.rlike("^[0-9]{9}$") & ~col.rlike(r"^(\d)\1+$") & F.left(col, F.lit(2)).isin(*BIK_PREFIXES)


def account_valid(account, bik) -> Column:
    """20-digit account keyed by its bank code: weights 7-1-3 in turn over three
    digits of the code and the account, sum a multiple of 10. Correspondent
    accounts (301...) take 0 and the 5th and 6th digit, others the last three."""
    account, bik = _col(account), _col(bik)
    seed = F.when(account.startswith("301"), F.concat(F.lit("0"), F.substring(bik, 5, 2))).otherwise(F.right(bik, F.lit(3)))
    total = weighted_sum(digits(F.concat(seed, account)), [ACCOUNT[i % 3] for i in range(23)])
    return F.when(account.isNull() | bik.isNull(), None).when(account.rlike("^[0-9]{20}$") & bik.rlike("^[0-9]{9}$"), total % 10 == 0).otherwise(False)


def luhn_valid(col) -> Column:
    """Luhn over digits, from the right."""
    values = F.reverse(digits(_col(col)))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 1, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v))
    return F.when(_col(col).isNull(), None).when(_col(col).rlike("^[0-9]+$"), F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)


def isin_valid(col) -> Column:
    """Two letters, nine letters or digits, a digit; Luhn with letters as 10..35."""
    col = _col(col)
    spelled = F.array_join(F.transform(F.split(col, ""), lambda c: F.conv(c, 36, 10)), "")
    return F.when(col.isNull(), None).when(col.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$"), luhn_valid(spelled)).otherwise(False)


def mod97_valid(col, least: int = 19) -> Column:
    """ISO 7064 MOD 97-10 over letters (10..35) and digits is 1; shorter than
    `least` is no such number."""
    bare = F.upper(F.regexp_replace(_col(col), r"[^0-9A-Za-z]", ""))
    spelled = F.transform(F.split(bare, ""), lambda c: F.conv(c, 36, 10))
    rest = F.aggregate(spelled, F.lit(0), lambda acc, c: ((acc * F.when(F.length(c) > 1, 100).otherwise(10) + c.cast("int")) % 97).cast("int"))
    return F.when(_col(col).isNull(), None).when(F.length(bare) >= least, rest == 1).otherwise(False)


def cadastre_check(col) -> Column:
    """NULL for a plausible cadastral number, else the reason."""
    t = F.trim(_col(col))
    shape = r"^([0-9]{2}):([0-9]{2}):([0-9]{6,7}):([0-9]+)$"
    district = F.regexp_extract(t, shape, 1).try_cast("int")
    return F.when(_col(col).isNull() | (t == ""), "empty").when(~t.rlike(shape), "shape").when((district < 1) | (district > 91), "district").when(F.regexp_extract(t, shape, 4).rlike("^0+$"), "parcel")
