"""Pairs of near forms (strings) of two tables, each found once.

What all forms begin with is left out first. Forms of equal length that differ
in a few places share their rests without these places; the pair counts where
no other place is left out. Forms that are shifted against each other share one
or two rests of one character less, of which one counts. So dense names
(numbers) are never paired on a key that many others share, and pairs are summed
where they are found. Forms of different lengths, or of over MOST_SHORTENED
characters, are rarely near; their pairs are made distinct. Branches for lengths
that no two forms have are left out.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters up to which a form's keys are its shortened forms; others go by segments.
MOST_SHORTENED = 48


def shuffled(df: DataFrame) -> DataFrame:
    """df, not to be broadcast: Spark goes by a table's compressed size, and
    names shrink so much that millions of them would pass through the driver."""
    return df.hint("merge")


def _from(low: Column, high: Column) -> Column:
    """low to high; nothing where high is less (a plain sequence counts down)."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _rest(name: Column, i: Column, j: Column) -> Column:
    """A name less its characters i and j (one where they are equal, none at 0)."""
    return F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, j - i - 1), F.substring(name, j + 1, F.length(name)))


def _less(name: Column) -> Column:
    return F.array_distinct(F.transform(_from(F.lit(1), F.length(name)), lambda i: _rest(name, i, i)))


def _less_two(name: Column) -> Column:
    n = F.length(name)
    return F.array_distinct(F.flatten(F.transform(_from(F.lit(1), n - 1), lambda i: F.transform(_from(i + 1, n), lambda j: _rest(name, i, j)))))


def _char(name: Column, at: Column) -> Column:
    return F.substring(name, at, F.lit(1))


def _replaced(left: DataFrame, right: DataFrame, sizes: set[int], long: int) -> DataFrame:
    """Pairs of equal length that differ in two characters at most, in one below
    long: one pair for the places in which they differ."""
    spots = [(n, 0, 0) for n in sizes] + [(n, i, j) for n in sizes for i in range(1, n + 1) for j in range(i, n + 1 if n >= long else i + 1)]
    spots = F.broadcast(left.sparkSession.createDataFrame(spots, "__n int, __i int, __j int"))  # by lengths, not by rows

    def keys(df: DataFrame, name: str) -> DataFrame:
        rows = df.join(spots, F.length(name) == F.col("__n")).drop("__n")
        return rows.withColumn("__key", F.xxhash64(_rest(F.col(name), F.col("__i"), F.col("__j"))))

    a, b, i, j = (F.col(c) for c in ("a", "b", "__i", "__j"))
    rows = keys(left, "a").join(shuffled(keys(right, "b")), ["__key", "__i", "__j"])
    other = (i == 0) | ((_char(a, i) != _char(b, i)) & (_char(a, j) != _char(b, j)))
    return rows.filter(other & (_rest(a, i, j) == _rest(b, i, j)))


def _shifted(left: DataFrame, right: DataFrame, sizes: set[int]) -> DataFrame:
    """Pairs of equal length, differing in three characters and more, where one
    less a character is the other less another."""

    def keys(df: DataFrame, name: str) -> DataFrame:
        x, n = F.col(name), F.length(name)
        rows = df.filter(n.isin(*sorted(sizes))).withColumn("__s", F.filter(_from(F.lit(1), n), lambda i: (i == 1) | (_char(x, i) != _char(x, i - 1))))
        runs = F.transform("__s", lambda lo, k: F.struct(lo.alias(f"__{name}lo"), (F.coalesce(F.get("__s", k + 1), n + 1) - 1).alias(f"__{name}hi")))
        return rows.select("*", F.inline(runs)).drop("__s").withColumn("__key", F.xxhash64(_rest(x, F.col(f"__{name}lo"), F.col(f"__{name}lo"))))

    a, b = F.col("a"), F.col("b")
    # They differ first at f and last at l; between, one is the other moved by one.
    f, l = F.least("__ahi", "__bhi"), F.greatest("__alo", "__blo")  # noqa: E741
    rows = keys(left, "a").join(shuffled(keys(right, "b")), "__key").filter((l - f >= 2) & (_rest(a, F.col("__alo"), F.col("__alo")) == _rest(b, F.col("__blo"), F.col("__blo"))))
    many = F.size(F.filter(_from(f, l), lambda k: _char(a, k) != _char(b, k))) > 2
    twice = (F.col("__alo") > F.col("__bhi")) & (F.substring(a, f + 1, l - f) == F.substring(b, f, l - f))
    return rows.filter(many & ~twice)


def _edits(long: int, a: str = "a", b: str = "b") -> Column:
    """Whether a and b are within their number of edits."""
    both = F.least(F.length(a), F.length(b)) >= long
    return F.when(both, F.levenshtein(a, b, 2) >= 0).otherwise(F.levenshtein(a, b, 1) >= 0)


def is_near(a: str, b: str, long: int, least: int) -> Column:
    """Whether two forms are near; false where one is null or empty."""
    begins = (F.least(F.length(a), F.length(b)) >= least) & (F.startswith(F.col(a), F.col(b)) | F.startswith(F.col(b), F.col(a)))
    return F.coalesce((F.col(a) != "") & (F.col(b) != "") & (_edits(long, a, b) | begins), F.lit(False))


def _unequal(left: DataFrame, right: DataFrame, under: set, over: set, long: int) -> DataFrame:
    """Pairs of different lengths: under has (length of a, by how many b is
    longer), over (length of b, by how many a is longer)."""
    most = lambda n: 2 if n >= long else 1

    def tagged(keys: Column, role: int, d: int) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(role).alias("__role"), F.lit(d).alias("__d"), F.xxhash64(k).alias("__key")))

    def keys(df: DataFrame, name: str, shorter: set, longer: set, role: int) -> DataFrame:
        x, each = F.col(name), []
        for d, m in ((1, 1), (1, 2), (2, 2)):
            of = lambda some: sorted(n for n, e in some if e == d and most(n) == m)  # noqa: B023, E731
            for sizes, made, r in ((of(shorter), F.array(x) if d == m else _less(x), role), ([n + d for n in of(longer)], _less(x) if m == 1 else _less_two(x), 1 - role)):
                if sizes:
                    each.append(tagged(F.when(F.length(x).isin(*sizes), made).otherwise(F.array().cast("array<string>")), r, d))
        return df.select("*", F.inline(F.concat(*each)))

    rows = keys(left, "a", under, over, 0).join(shuffled(keys(right, "b", over, under, 1)), ["__role", "__d", "__key"])
    apart = F.when(F.col("__role") == 0, F.length("b") - F.length("a")).otherwise(F.length("a") - F.length("b"))
    return rows.filter((apart == F.col("__d")) & _edits(long)).drop("__role", "__d", "__key").distinct()


def _segments(name: Column, parts: int) -> Column:
    """(length, segment number, text): a name cut into parts of near equal size;
    of names within parts - 1 edits at least one segment is kept whole."""
    n = F.length(name)
    edge = lambda i: F.floor(n * i / parts).cast("int")
    return F.array(*[F.struct(n.alias("__len"), F.lit(i).alias("__seg"), F.substring(name, edge(i) + 1, edge(i + 1) - edge(i)).alias("__part")) for i in range(parts)])


def _probes(name: Column, parts: int) -> Column:
    """Where the segments of a name within parts - 1 edits can lie in this one."""
    far = parts - 1

    def of(size: Column) -> Column:
        each = []
        for i in range(parts):
            low = F.floor(size * i / parts).cast("int")
            width = F.floor(size * (i + 1) / parts).cast("int") - low
            each.append(_at(name, low, width, far, size, i))
        return F.concat(*each)

    sizes = F.sequence(F.greatest(F.length(name) - far, F.lit(1)), F.length(name) + far)
    return F.array_distinct(F.flatten(F.transform(sizes, of)))


def _at(name: Column, low: Column, width: Column, far: int, size: Column, seg: int) -> Column:
    places = F.sequence(F.greatest(low - far, F.lit(0)), low + far)
    found = F.transform(places, lambda at: F.struct(size.alias("__len"), F.lit(seg).alias("__seg"), F.substring(name, at + 1, width).alias("__part")))
    return F.filter(found, lambda x: F.length(x["__part"]) == width)


def _very_long(left: DataFrame, right: DataFrame, long: int) -> DataFrame:
    """Pairs one of which has over MOST_SHORTENED characters."""
    least = MOST_SHORTENED - 1
    a = left.filter(F.length("a") >= least).select("*", F.inline(_probes(F.col("a"), 3)))
    b = right.filter(F.length("b") >= least).select("*", F.inline(_segments(F.col("b"), 3)))
    rows = a.join(shuffled(b), ["__len", "__seg", "__part"]).filter((F.greatest(F.length("a"), F.length("b")) > MOST_SHORTENED) & _edits(long))
    return rows.drop("__len", "__seg", "__part").distinct()


def _begun(left: DataFrame, right: DataFrame, la: set[int], lb: set[int], least: int, long: int) -> list[DataFrame]:
    """Pairs one of which begins the other, of least characters, and too far
    apart in length to be within the edits."""

    def begins(df: DataFrame, other: DataFrame, x: str, y: str, own: set[int], begun: set[int]) -> DataFrame | None:
        far = lambda n: 2 if n >= long else 1
        sizes = sorted(n for n in begun if n >= least and any(m - n > far(n) for m in own))
        if not sizes:
            return None
        n = F.length(x)
        fits = [F.when(n - k > far(k), F.substring(F.col(x), F.lit(1), F.lit(k))) for k in sizes]
        rows = df.select("*", F.explode(F.filter(F.array(*fits), lambda s: s.isNotNull())).alias("__start"))
        return rows.join(shuffled(other.filter(F.length(y).isin(*sizes))), F.col("__start") == F.col(y)).drop("__start")

    each = (begins(left, right, "a", "b", la, lb), begins(right, left, "b", "a", lb, la))
    return [df for df in each if df is not None]


def near_rows(left: DataFrame, right: DataFrame, long: int | None, least: int | None) -> DataFrame:
    """left: a and more columns; right: b and more of other names; the rows of
    each are distinct, a and b neither null nor empty. Both rows' columns for
    each pair of rows whose a and b are within one edit, or two where both have
    long characters (None: never two), or one of which, of least characters
    (None: never), begins the other; equal ones too. Each pair comes once.

    left and right are cheap to read twice: tables in the shared folder."""
    (a0, a1, la), (b0, b1, lb) = (df.agg(F.min(c), F.max(c), F.collect_set(F.length(c))).first() for df, c in ((left, "a"), (right, "b")))
    names = [*left.columns, *right.columns]
    if not la or not lb:
        return left.join(right, F.lit(False)).select(*names)
    stem = os.path.commonprefix([min(a0, b0), max(a1, b1)])
    cut = len(stem)
    long, la, lb = 1 << 30 if long is None else long - cut, {n - cut for n in la}, {n - cut for n in lb}
    left, right = (df.withColumn(c, F.substring(c, cut + 1, 1 << 30)) for df, c in ((left, "a"), (right, "b")))
    some = lambda one, two: {(n, d) for n in one for d in (1, 2) if d <= (2 if n >= long else 1) and n + d in two and n + d <= MOST_SHORTENED}
    same, under, over = {n for n in la & lb if n <= MOST_SHORTENED}, some(la, lb), some(lb, la)
    found = []
    if same:
        found.append(_replaced(left, right, same, long))
    if shift := {n for n in same if n >= max(long, 3)}:
        found.append(_shifted(left, right, shift))
    if under or over:
        found.append(_unequal(left, right, under, over, long))
    if any(max(n, m) > MOST_SHORTENED and abs(n - m) < 3 for n in la for m in lb):
        found.append(_very_long(left, right, long))
    if least is not None:
        found += _begun(left, right, la, lb, max(least - cut, 0), long)
    whole = [F.concat(F.lit(stem), c).alias(c) if c in ("a", "b") else F.col(c) for c in names]
    out = None
    for df in found:
        out = df.select(*whole) if out is None else out.union(df.select(*whole))
    return left.join(right, F.lit(False)).select(*names) if out is None else out
