"""Secret scan: base patterns, and windows of high entropy over candidates.

DataFrame functions only. Spans are code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.arrays import bound, placed

# Patterns of the base kinds, and smallest lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Candidates that fit one of these in whole are no secrets: words and numbers
#: without a mix of classes, dates and counters, paths and slugs of words and
#: numbers, UUIDs, and documented examples.
ALLOWED = (
    r"^[A-Za-z][a-z]*$",
    r"^[A-Z]+$",
    r"^[0-9]+$",
    r"^([A-Za-z]?[a-z]*|[0-9]+)([/_+-]+([A-Za-z]?[a-z]*|[0-9]+))+$",
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|xxxx",
)
#: Character class -> pattern and least entropy of a window (bits a character);
#: the first class that a candidate fits counts. Windows of 20 random
#: characters have about 3.4 bits over 16 characters, 3.85 over 36, 4.05 over 62.
CLASSES = {
    "hex": (r"^[0-9a-fA-F]+$", 2.8),
    "lower": (r"^[0-9a-z+/_-]+$", 3.6),
    "upper": (r"^[0-9A-Z+/_-]+$", 3.6),
    "mixed": (r"^[0-9A-Za-z]+$", 3.8),
    "base64": (r"^[0-9A-Za-z+/_-]+$", 3.8),
}


def _plogp(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


#: Characters that a candidate can hold; an index of 0 stands for any other.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Counts of the alphabet are kept in longs, PACKED of them each, of BITS bits.
PACKED, BITS = 12, 5


def window_entropy(word: Column, window: int) -> Column:
    """The largest Shannon entropy (bits a character) of any window of a word
    over ALPHABET; 0 for a word shorter than window (31 at most). Counts of the
    window's characters and the sum of c log2 c are carried along and changed by
    the character that enters and the one that leaves."""
    if window >= 1 << BITS:
        raise ValueError(f"window is under {1 << BITS}")

    def character(code: Column) -> Column:
        at = code - 1
        shift = F.pmod(at, F.lit(PACKED)) * BITS
        return F.struct(F.floor(at / PACKED).cast("int").alias("slot"), shift.alias("shift"), F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("unit"))

    codes = F.transform(F.split(word, ""), lambda c: character(F.instr(F.lit(ALPHABET), c)))
    none = F.lit(None).cast("struct<slot:int,shift:int,unit:bigint>")
    steps = bound(codes, lambda c: F.arrays_zip(c.alias("enter"), F.slice(F.concat(F.array_repeat(none, window), c), 1, F.size(c)).alias("leave")))
    zero = F.lit(0).cast("long")
    state = F.struct(F.array_repeat(zero, -(-len(ALPHABET) // PACKED)).alias("n"), F.lit(0).alias("seen"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def count(acc, c):
        return F.call_function("shiftright", F.get(acc["n"], c["slot"]), c["shift"]).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))

    def slide(acc, x):
        enter, leave = x["enter"], x["leave"]
        more, less = count(acc, enter), count(acc, leave)
        gain = _plogp(more + 1) - _plogp(more) - F.when(leave.isNotNull(), _plogp(less) - _plogp(less - 1)).otherwise(F.lit(0.0))
        changed = acc["sum"] + F.when(leave.isNotNull() & (enter["slot"] == leave["slot"]) & (enter["shift"] == leave["shift"]), F.lit(0.0)).otherwise(gain)
        counts = F.transform(acc["n"], lambda c, k: c + F.when(k == enter["slot"], enter["unit"]).otherwise(zero) - F.when(k == leave["slot"], leave["unit"]).otherwise(zero))
        here = F.when(acc["seen"] + 1 >= window, F.lit(math.log2(window)) - changed / window).otherwise(F.lit(0.0))
        return F.struct(counts.alias("n"), (acc["seen"] + 1).alias("seen"), changed.alias("sum"), F.greatest(acc["best"], here).alias("best"))

    return F.aggregate(steps, state, slide, lambda acc: acc["best"])


def scan_secrets(docs: DataFrame, text_col: str = "text", window: int = 20, classes: dict[str, tuple[str, float]] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with one more column, secrets: array of (kind, start, end), by
    start, then kind in the order assign, access, hex, entropy.

    assign, access and hex are the matches of the base patterns. entropy is a
    run of 20 or more letters, digits and +/_- of the text without the assign
    matches, that holds no access or hex match, isn't allow-listed, and has a
    window whose entropy reaches the bound of its character class (classes).

    A null text counts as empty and has no secrets. Rows, repeated or not, are
    judged each by itself without a shuffle; very long texts are scanned whole,
    in time linear in their length and matches. A column named secrets is
    replaced."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kinds = ("assign", "access", "hex")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def matches(t: str, pattern: str) -> Column:
        return placed(F.col(t), pattern, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))

    def spans(column: str, kind: str) -> Column:
        return F.coalesce(F.transform(F.col(column), lambda m: F.struct(F.lit(kind).alias("kind"), m["s"].alias("start"), m["e"].alias("end"))), none)

    rows = docs.withColumn("__t", text)
    values = F.regexp_extract_all("__t", F.lit(ASSIGN), F.lit(2))
    rows = rows.withColumn("__all", matches("__t", ASSIGN))
    rows = rows.withColumn("__a", F.when(F.col("__all").isNotNull(), F.transform(F.filter(F.arrays_zip(F.col("__all").alias("m"), values.alias("v")), lambda x: F.length(x["v"]) >= 6), lambda x: x["m"])))
    rows = rows.withColumn("__k", F.filter(matches("__t", ACCESS), lambda m: F.length(m["t"]) >= 20))
    rows = rows.withColumn("__h", matches("__t", HEX))
    # Candidates are runs between the assign matches, which are blanked in place.
    parts = F.arrays_zip(F.split("__t", ASSIGN, -1).alias("g"), F.col("__all").alias("m"), F.coalesce(values, F.array()).alias("v"))
    blank = F.array_join(F.transform(parts, lambda x: F.concat(x["g"], F.coalesce(F.when(F.length(x["v"]) >= 6, F.repeat(F.lit(" "), F.length(x["m"]["t"]))).otherwise(x["m"]["t"]), F.lit("")))), "")
    rows = rows.withColumn("__b", F.when(F.col("__a").isNull(), F.col("__t")).otherwise(blank))
    rows = rows.withColumn("__c", matches("__b", CANDIDATE))

    def fits(m: Column) -> Column:
        word = m["t"]
        listed = word.rlike(HEX) | word.rlike("AKIA[A-Z0-9]{16,}")
        for pattern in allowed:
            listed = listed | word.rlike(pattern)
        least = None
        for pattern, bits in classes.values():
            least = F.when(word.rlike(pattern), bits) if least is None else least.when(word.rlike(pattern), bits)
        return F.when(listed, F.lit(False)).otherwise(F.coalesce(window_entropy(word, window) >= least, F.lit(False)))

    rows = rows.withColumn("__e", F.filter("__c", fits))
    order = F.array(*[F.lit(k) for k in (*kinds, "entropy")])
    every = F.concat(*[spans(c, k) for c, k in zip(("__a", "__k", "__h", "__e"), (*kinds, "entropy"), strict=True)])
    found = F.transform(every, lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))
    found = F.transform(F.array_sort(found), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.withColumn("secrets", found).drop("__t", "__all", "__a", "__k", "__h", "__b", "__c", "__e")


def digest(secrets: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
