"""Places of matches in a text, and other scans of an array in linear time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items in one block of a scan.
BLOCK = 128


def bound(value: Column, use) -> Column:
    """use(value) with value computed once for each row, however often it stands
    in lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def as_row(value: Column, name: str) -> Column:
    """value in a column of a generated row. What is exploded from a computed
    array Spark computes again, for the filter of its size; from this it doesn't."""
    return F.inline(F.array(F.struct(value.alias(name))))


#: Marks in match_groups, in no text (Unicode reserves them for such a use).
MATCH, GROUP, OTHER = "\ufdd0", "\ufdd1", "\ufdd2"


def match_groups(text: Column, pattern: str, groups: int) -> Column:
    """Array of string arrays, by one pass of the pattern: [text before the first
    match], then for each match [match, its groups up to `groups` ('' for one
    that took no part), text up to the next match]."""
    marked = "".join(f"${i}{GROUP}" for i in range(groups + 1))
    t = F.regexp_replace(F.translate(text, MATCH + GROUP, OTHER * 2), pattern, MATCH + marked)
    return F.transform(F.split(t, MATCH, -1), lambda x: F.split(x, GROUP, -1))


def scan(items: Column, first: Column, emit, move, kind: str) -> Column:
    """Array (elements of SQL type kind) of emit(state, item) for each item, the
    state going from first on by move(state, item).

    Appending to an array copies it, so results are gathered in blocks of BLOCK
    and the blocks joined at the end."""

    def step(acc, x):
        return F.struct(F.concat(acc["done"], F.array(emit(acc["at"], x).cast(kind))).alias("done"), move(acc["at"], x).alias("at"))

    def in_block(x: Column, at: Column) -> Column:
        return F.aggregate(x, F.struct(F.array().cast(f"array<{kind}>").alias("done"), at.alias("at")), step)

    def block(acc, x):
        return bound(in_block(x, acc["at"]), lambda r: F.struct(F.concat(acc["done"], F.array(r["done"])).alias("done"), r["at"].alias("at")))

    def in_blocks(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, BLOCK))
        start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("done"), first.alias("at"))
        return F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["done"]))

    return bound(items, lambda x: F.when(F.size(x) <= BLOCK, in_block(x, first)["done"]).otherwise(in_blocks(x)))


def running_sums(numbers: Column) -> Column:
    """Array of the sums of all numbers before each one (0 for the first)."""
    return scan(numbers, F.lit(0), lambda at, x: at, lambda at, x: at + x, "int")


def match_starts(text: Column, pattern: str, found: Column) -> Column:
    """Start (code points, from 0) of each match of pattern, where found are
    all matches of it in order and each has a character at least: what stands
    between the matches, and the matches, add up."""

    def starts(pairs: Column) -> Column:
        before = running_sums(F.transform(pairs, lambda z: z["g"] + F.length(z["m"])))
        return F.transform(F.arrays_zip(before.alias("b"), pairs.alias("z")), lambda y: y["b"] + y["z"]["g"])

    def of(m: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(m)), F.length)
        return bound(F.arrays_zip(gaps.alias("g"), m.alias("m")), starts)

    return bound(found, of)


def placed(text: Column, pattern: str, found: Column) -> Column:
    """Array of (t, s, e): text, start and end of each match; see match_starts.
    Null without a match."""

    def of(m: Column) -> Column:
        spans = F.transform(F.arrays_zip(m.alias("m"), match_starts(text, pattern, m).alias("s")), lambda z: F.struct(z["m"].alias("t"), z["s"].alias("s"), (z["s"] + F.length(z["m"])).alias("e")))
        return F.when(F.size(m) > 0, spans)

    return bound(found, of)


def replace_matches(text: Column, pattern: str, new) -> Column:
    """text with each match m of pattern replaced by new(m)."""

    def of(t: Column) -> Column:
        parts = F.arrays_zip(F.split(t, pattern, -1).alias("g"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"))
        whole = F.array_join(F.transform(parts, lambda x: F.concat(x["g"], F.coalesce(new(x["m"]), F.lit("")))), "")
        return F.when(t.rlike(pattern), whole).otherwise(t)

    return bound(text, of)
