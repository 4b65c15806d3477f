"""Reconciliation: bags, registries, versions and journals compared by joins."""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections import Counter

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package


def crosscheck(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Bags (keys, n) compared: only_a, only_b, common counts of each key."""
    both = a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), keys, "full")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    return both.select(*keys, F.greatest(na - nb, F.lit(0)).cast("long").alias("only_a"), F.greatest(nb - na, F.lit(0)).cast("long").alias("only_b"), F.least(na, nb).cast("long").alias("common"))


def orphans(drafts: DataFrame, facts: DataFrame, low_trust: DataFrame, key: str) -> DataFrame:
    """Draft keys that no fact source has: class low_trust where a source of
    lower trust has them, else missing."""
    left = drafts.select(key).distinct().join(facts.select(key).distinct(), key, "left_anti")
    seen = low_trust.select(key).distinct().withColumn("seen", F.lit(True))
    return left.join(seen, key, "left").select(key, F.when(F.col("seen"), "low_trust").otherwise("missing").alias("class"))


def reconcile(index: DataFrame, register: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """key, status: every key's standing between an index, a register and the
    items there are: ok, missing_in_index, missing_in_register, ghost."""
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select(key).distinct().withColumn(name, F.lit(True))

    rows = flag(items, "i").join(flag(index, "x"), key, "full").join(flag(register, "r"), key, "full")
    status = F.when(F.col("i").isNull(), "ghost").when(F.col("x").isNull() & F.col("r").isNull(), "missing_in_both").when(F.col("x").isNull(), "missing_in_index").when(F.col("r").isNull(), "missing_in_register").otherwise("ok")
    return rows.select(key, status.alias("status"))


def drift(old: DataFrame, new: DataFrame, key: str, value: str, frozen: Column | None = None) -> DataFrame:
    """key, status: added, removed, changed or same; frozen rows are exempt."""
    rows = old.select(key, F.col(value).alias("o"), F.lit(True).alias("in_o")).join(new.select(key, F.col(value).alias("n"), F.lit(True).alias("in_n")), key, "full")
    status = F.when(F.col("in_o").isNull(), "added").when(F.col("in_n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed").otherwise("same")
    return rows.select(key, (F.when(frozen, "frozen").otherwise(status) if frozen is not None else status).alias("status"))


def scd2(old: DataFrame, new: DataFrame, key: str, value: str, day: str) -> DataFrame:
    """Versions after a load: old rows closed where changed or gone, new rows
    opened where new or changed, others kept open."""
    rows = old.select(key, F.col(value).alias("o"), F.lit(True).alias("in_o")).join(new.select(key, F.col(value).alias("n"), F.lit(True).alias("in_n")), key, "full")
    same = F.col("o").eqNullSafe(F.col("n")) & F.col("in_o") & F.col("in_n")
    day_ = F.lit(day).cast("date")
    none = F.lit(None).cast("date")
    versions = F.when(same, F.array(F.struct(F.col("o").alias("value"), none.alias("opened"), none.alias("closed")))).otherwise(
        F.concat(
            F.when(F.col("in_o"), F.array(F.struct(F.col("o").alias("value"), none.alias("opened"), day_.alias("closed")))).otherwise(F.array()),
            F.when(F.col("in_n"), F.array(F.struct(F.col("n").alias("value"), day_.alias("opened"), none.alias("closed")))).otherwise(F.array()),
        )
    )
    return rows.select(key, F.inline(versions))


def new_or_changed(df: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(manifest.select(*keys).distinct(), keys, "left_anti")


def bag_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def bag_union(df: DataFrame, key: str) -> DataFrame:
    """Counts of (source, key, n) by key: the most that any source has."""
    return df.groupBy(key).agg(F.max("n").alias("n"))


def symdiff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    rows = a.select(key).distinct().withColumn("a", F.lit(True)).join(b.select(key).distinct().withColumn("b", F.lit(True)), key, "full")
    return rows.filter("a is null or b is null").select(key, F.when(F.col("a"), "a").otherwise("b").alias("side"))


def supplement(catalog: DataFrame, known: DataFrame, key: str, row: str | None = None) -> DataFrame:
    """The catalog and the known rows whose key it doesn't list today. A source
    that stands twice among the known rows is an error: a key, or a value of the
    column row where several known rows may share a key."""
    row = row or key
    twice = known.groupBy(row).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{row} {twice[0][row]!r} stands {twice[0]['n']} times")
    return catalog.unionByName(known.join(catalog.select(key), key, "left_anti"))


def uniqueness_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, value, n for values that occur more than once."""
    parts = [df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(c).alias("column_name"), "value", "n") for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paragraph_diff(before: DataFrame, after: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, status, n: paragraphs kept, removed, added and rewritten. They are
    paired by hash and occurrence, so repeated paragraphs pair one to one; what
    is left between the same number of kept ones is rewritten, in turn, and the
    rest removed or added."""

    def parts(df: DataFrame, side: str) -> DataFrame:
        rows = df.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias(side, "p")).withColumn("h", F.md5("p"))
        nth = F.row_number().over(Window.partitionBy(id_col, "h").orderBy(side))
        return rows.select(id_col, "h", nth.alias("nth"), side)

    rows = parts(before, "a").join(parts(after, "b"), [id_col, "h", "nth"], "full")
    kept = F.col("a").isNotNull() & F.col("b").isNotNull()

    def left(side: str) -> DataFrame:
        order = Window.partitionBy(id_col).orderBy(side)
        own = rows.filter(F.col(side).isNotNull()).withColumn("gap", F.sum(kept.cast("int")).over(order)).filter(~kept)
        return own.select(id_col, "gap", F.row_number().over(Window.partitionBy(id_col, "gap").orderBy(side)).alias("k"), F.lit(True).alias(side))

    moved = left("a").join(left("b"), [id_col, "gap", "k"], "full")
    status = F.when(F.col("a") & F.col("b"), "rewritten").when(F.col("a"), "removed").otherwise("added")
    every = moved.select(id_col, status.alias("status")).unionByName(rows.filter(kept).select(id_col, F.lit("kept").alias("status")))
    return every.groupBy(id_col, "status").agg(F.count(F.lit(1)).alias("n"))


DIFF = "pos int, status string, before string, after string"


def _patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of kept paragraphs, rising in both: those that stand once in each
    text, by the longest rising run of their places, then the same between two of
    them; equal heads and tails of what is left over."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        once_a, once_b = Counter(a[i:n]), Counter(b[j:m])
        place = {x: k for k, x in enumerate(b[j:m], j)}
        pairs = [(k, place[x]) for k, x in enumerate(a[i:n], i) if once_a[x] == 1 and once_b.get(x) == 1]
        ends, last, back = [], [], []
        for k, (_, y) in enumerate(pairs):
            at = bisect_left(ends, y)
            ends[at:], last[at:] = [y, *ends[at + 1 :]], [k, *last[at + 1 :]]
            back.append(last[at - 1] if at else None)
        k, run = (last[-1] if last else None), []
        while k is not None:
            run.append(pairs[k])
            k = back[k]
        if run:
            low_i, low_j = i, j
            for x, y in [*reversed(run), (n, m)]:
                todo.append((low_i, x, low_j, y))
                low_i, low_j = x + 1, y + 1
            out += run
    return sorted(out)


def sequence_diff(before: DataFrame, after: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, status, before, after: paragraphs kept, rewritten, removed and
    added, in order. A paragraph that moved is removed in one place and added in
    the other. Between kept ones the paragraphs of both sides are rewritten in
    turn, the rest removed or added. A text that is missing or null has no
    paragraphs. Two texts of an id are one row of an Arrow batch."""
    from pyspark.sql import types as T

    a = before.select(F.col(id_col).alias("__i"), F.split(text_col, "\n", -1).alias("__a"))
    b = after.select(F.col(id_col).alias("__j"), F.split(text_col, "\n", -1).alias("__b"))
    rows = a.join(b, F.col("__i") == F.col("__j"), "full").select(F.coalesce("__i", "__j").alias(id_col), "__a", "__b")
    schema = T.StructType([rows.schema[id_col], *T.StructType.fromDDL(DIFF).fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ident, a, b in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a, b, found, i, j = a or [], b or [], [], 0, 0
                for x, y in [*_patience(a, b), (len(a), len(b))]:
                    for k in range(max(x - i, y - j)):
                        old, new = (a[i + k] if i + k < x else None), (b[j + k] if j + k < y else None)
                        found.append(("rewritten" if old is not None and new is not None else "removed" if new is None else "added", old, new))
                    if x < len(a):
                        found.append(("kept", a[x], b[y]))
                    i, j = x + 1, y + 1
                if found:
                    columns = [pa.array([ident.as_py()] * len(found), ident.type), pa.array(range(len(found)), pa.int32()), *[pa.array([f[k] for f in found], pa.string()) for k in range(3)]]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def contained_in(a: DataFrame, b: DataFrame, id_col: str, text_col: str, least: int = 60, low: float = 0.7, high: float = 1.4, digits: int = 5) -> DataFrame:
    """id, ok, first_missing, numbers_missing: whether every paragraph of `least`
    characters of a stands in b, the lengths agree, and b has every number of
    `digits` and more digits that a has."""
    rows = a.select(id_col, F.col(text_col).alias("ta")).join(b.select(id_col, F.col(text_col).alias("tb")), id_col)
    long = F.filter(F.split("ta", "\n", -1), lambda p: F.length(p) >= least)
    missing = F.filter(long, lambda p: ~F.contains(F.col("tb"), p))
    ratio = F.length("tb") / F.nullif(F.length("ta"), F.lit(0))
    numbers = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(rf"[0-9]{{{digits},}}"), F.lit(0)))
    lost = F.size(F.array_except(numbers("ta"), numbers("tb")))
    return rows.select(id_col, ((F.size(missing) == 0) & ratio.between(low, high) & (lost == 0)).alias("ok"), F.left(F.try_element_at(missing, F.lit(1)), F.lit(40)).alias("first_missing"), lost.cast("long").alias("numbers_missing"))


def agree(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 0.02) -> DataFrame:
    """key, agrees: relative difference within tolerance; zero agrees with zero alone."""
    rows = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    return rows.select(key, F.when(F.col("y") == 0, F.col("x") == 0).otherwise(F.abs(F.col("x") - F.col("y")) / F.abs("y") <= tolerance).alias("agrees"))


def last_known_good(log: DataFrame, key: str, ts: str, ok: Column) -> DataFrame:
    """key, last_try, last_success, stale: failures move the try alone."""
    rows = log.groupBy(key).agg(F.max(ts).alias("last_try"), F.max(F.when(ok, F.col(ts))).alias("last_success"))
    return rows.withColumn("stale", F.coalesce(F.col("last_try") > F.col("last_success"), F.lit(True)))


def effective_state(journal: DataFrame, key: str, mode: str, order: str) -> DataFrame:
    """The last entry of each key."""
    return journal.groupBy(key).agg(F.max_by(mode, order).alias(mode))


def approval_state(docs: DataFrame, journal: DataFrame, key: str) -> DataFrame:
    """docs: key, sha; journal: key, sha, ord, ready. State of the current
    revision: approved, revoked, rejected, other_revision or none."""
    rows = docs.select(key, "sha").join(journal.select(key, F.col("sha").alias("jsha"), "ord", "ready"), key, "left")
    own = F.col("jsha") == F.col("sha")
    rows = rows.groupBy(key).agg(F.max_by("ready", F.when(own, F.col("ord"))).alias("last"), F.bool_or(own & F.col("ready")).alias("ever"), F.bool_or(~own & F.col("ready")).alias("other"), F.bool_or(own).alias("any"))
    last = F.when(F.col("any"), F.col("last"))
    return rows.select(key, F.when(last, "approved").when(F.col("any") & F.col("ever"), "revoked").when(F.col("any"), "rejected").when(F.col("other"), "other_revision").otherwise("none").alias("state"))


def package_check(slots: DataFrame, items: DataFrame, group: str, slot: str) -> DataFrame:
    """group, slot, status: missing, extra or ok, of groups without duplicate
    slots; those with duplicates are one row, duplicate."""
    twice = slots.groupBy(group, slot).agg(F.count(F.lit(1)).alias("c")).groupBy(group).agg(F.max("c").alias("c")).filter("c > 1").select(group)
    rows = slots.select(group, slot).distinct().withColumn("s", F.lit(True)).join(items.select(group, slot).distinct().withColumn("i", F.lit(True)), [group, slot], "full").join(twice, group, "left_anti")
    status = F.when(F.col("i").isNull(), "missing").when(F.col("s").isNull(), "extra").otherwise("ok")
    return rows.select(group, slot, status.alias("status")).unionByName(twice.select(group, F.lit(None).cast(dict(slots.dtypes)[slot]).alias(slot), F.lit("duplicate").alias("status")))
