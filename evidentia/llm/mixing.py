"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import checkpoint, stage

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: source, source_size. Adds weight (weights in turn, by source in
    code point order, null last) and target: the shares by weight of share
    times all sizes, where none exceeds most times its source's size and the
    excess goes to the others by weight until none is above.

    That is filling to one level: sources in order of cap by weight are full
    until the level of what is left reaches none of the rest."""
    everywhere = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(everywhere) - 1) % len(weights)) + 1))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", left / rest).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level")))).over(whole)["level"]
    return rows.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", packets: int = 1000, bin_rows: int = 200_000) -> DataFrame:
    """docs with size, source_size, target, start, finish, taken.

    Weighted fair queueing. Each source sends its documents, shuffled by a hash
    of seed and id, and then the same once more, up to `most` times. A document
    goes in packets of at most a `packets`-th of its source's target (a word at
    least), so that a long document in service at the end doesn't carry a source
    past its target. A packet's virtual finish time is the source's words up to
    its end divided by the source's target. All packets of all sources are put
    in the order of finish time, ties by source and place, and the order is
    truncated at the total budget, share (or most, if less) times all words;
    of the packet at the cut the part up to the budget is taken. taken is the
    number of words of a document's packets before the cut. start and finish
    are those of the first copy; in_order gives the mix in its order.

    size is the number of runs outside x20 and x09-x0D; null text has 0 and is
    never taken. Null sources are one source, last in order. Null ids are
    allowed; rows that repeat in id and text are interchangeable. Extra columns
    pass through; such as are named like the new ones are replaced. An empty
    table gives an empty table.

    The order is range-partitioned by slices of virtual time: as virtual time
    passes at a constant number of words, slices are even. Slices before the one
    where the budget ends are taken whole, so only that one is sorted, and what
    the cut leaves of each source is one number. A source's running sum is split
    over bins of the shuffle hash, both by the number of rows (about bin_rows
    each), so a source with a third of all rows is many tasks. One row a source
    and a bin, and one a slice, is all that is gathered."""
    text = F.col(text_col).cast("string")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))).cast("binary"))
    rows = docs.withColumn("size", words(text)).withColumn("__order", key)
    rows = rows.withColumn("__s", F.coalesce(F.col(source_col).cast("string"), F.lit(""))).withColumn("__null", F.col(source_col).isNull())
    small = stage(rows.select("__s", "__null", "__order", "size"), "sizes")
    n, total = small.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    digits = max(2, math.ceil(math.log(max(1, n) / bin_rows, 16)))
    bin_ = F.substring("__order", 1, digits)

    bins = checkpoint(small.groupBy("__s", "__null", bin_.alias("__bin")).agg(F.sum("size").alias("__words")))
    sums = bins.groupBy("__s", "__null").agg(F.sum("__words").alias("source_size"))
    targets = source_targets(sums.select(F.when(~F.col("__null"), F.col("__s")).alias("source"), "source_size"), weights, share, most)
    targets = checkpoint(targets.select(F.coalesce("source", F.lit("")).alias("__s"), F.col("source").isNull().alias("__null"), "source_size", "target"))
    earlier = Window.partitionBy("__s", "__null").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpoint(bins.join(targets, ["__s", "__null"]).select("__s", "__null", "__bin", "source_size", "target", F.coalesce(F.sum("__words").over(earlier), F.lit(0)).alias("__offset")))

    def in_place(df: DataFrame, *ties: str) -> DataFrame:
        """df with __end: the words of its source up to a document's end."""
        inside = Window.partitionBy("__s", "__null", "__bin").orderBy("__order", *ties, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn("__bin", bin_).join(offsets, ["__s", "__null", "__bin"]).withColumn("__end", F.col("__offset") + F.sum("size").over(inside))

    copies = int(-(-most // 1))
    budget = math.floor(min(share, most) * total)
    served = _served(stage(in_place(small).filter("size > 0 and target > 0").select("__s", "__null", "__end", "size", "source_size", "target"), "places"), copies, packets, budget, 1 + copies * n // bin_rows)
    out = in_place(rows.drop("source_size", "target", "start", "finish", "taken"), id_col).join(served, ["__s", "__null"], "left")

    def part(copy: int) -> Column:
        begin = F.col("__end") - F.col("size") + F.col("source_size") * copy
        return F.greatest(F.lit(0), F.least(F.col("size"), F.coalesce("__served", F.lit(0)) - begin))

    def at(end: Column) -> Column:
        return F.when(F.col("target") > 0, end / F.col("target")).otherwise(F.lit(0.0))

    out = out.withColumns({"start": at(F.col("__end") - F.col("size")), "finish": at(F.col("__end")), "taken": sum((part(c) for c in range(1, copies)), part(0)).cast("long")})
    return out.drop("__s", "__null", "__bin", "__order", "__offset", "__end", "__served")


def _served(places: DataFrame, copies: int, packets: int, budget: int, slices: int) -> DataFrame:
    """__s, __null, __served: the words of each source before the cut."""
    quantum = F.greatest(F.lit(1), F.floor(F.col("target") / packets)).cast("long")
    each = F.ceil(F.col("size") / F.col("q")).cast("long")
    sent = places.withColumn("q", quantum).select("*", F.explode(F.sequence(F.lit(0).cast("long"), each * copies - 1)).alias("i"), each.alias("m"))
    begin = F.col("__end") - F.col("size") + F.floor(F.col("i") / F.col("m")) * F.col("source_size")
    sent = sent.select("__s", "__null", "target", (begin + F.pmod("i", "m") * F.col("q")).alias("low"), F.least(begin + (F.pmod("i", "m") + 1) * F.col("q"), begin + F.col("size")).alias("high"))
    sent = sent.withColumn("finish", F.col("high") / F.col("target"))
    # nothing but words of sources with less than one word as target is taken after time 2
    sent = sent.withColumn("slice", F.least(F.floor(F.col("finish") * slices), F.lit(2 * slices)))
    in_slices = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_slice = checkpoint(sent.groupBy("slice").agg(F.sum(F.col("high") - F.col("low")).alias("words")))
    found = per_slice.withColumn("upto", F.sum("words").over(in_slices)).filter(F.col("upto") >= budget).orderBy("slice").first() if budget else None
    nothing = places.sparkSession.createDataFrame([], "__s string, __null boolean, __served long")
    if found is None:
        return nothing
    before = found["upto"] - found["words"]
    order = ["finish", "__null", "__s", "high"]
    in_order = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = sent.filter(F.col("slice") == found["slice"]).withColumn("upto", before + F.sum(F.col("high") - F.col("low")).over(in_order))
    cut = last.filter(F.col("upto") >= budget).orderBy(*order).first()
    at = F.struct(*[F.col(c) for c in order])
    kinds = dict(sent.dtypes)
    cut_at = F.struct(*[F.lit(cut[c]).cast(kinds[c]).alias(c) for c in order])
    here = cut["high"] - (cut["upto"] - budget)
    reached = F.when(at < cut_at, F.col("high")).when(at == cut_at, F.lit(here).cast("long"))
    return checkpoint(sent.filter(F.col("slice") <= found["slice"]).groupBy("__s", "__null").agg(F.max(reached).alias("__served")).filter("__served is not null"))


def in_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the mix takes, sorted over all sources by finish time (a range
    partitioning), ties by id."""
    return mixed.filter("taken > 0").orderBy("finish", id_col)


ORACLE = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as k
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (
  select *, [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 as int) + 1] as weight, source_size * 2.0::double as cap
  from s),
l as (
  select *, cap / weight as lv,
         (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
         / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level
  from w),
t as (
  select source, source_size,
         case when cap <= level * weight then cap
              else (select arg_min(level, lv) from l where cap > level * weight) * weight end as target
  from l),
c as (
  select d.doc_id, d.source, d.size, t.source_size, t.target,
         cast(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and current row) as bigint) as e
  from d join t on d.source is not distinct from t.source),
q as (select *, cast(greatest(1, floor(target / 1000)) as bigint) as quantum from c where size > 0 and target > 0),
i as (select *, (size + quantum - 1) // quantum as m, unnest(range(2 * ((size + quantum - 1) // quantum))) as i from q),
p as (
  select source, target, e - size + (i // m) * source_size + (i % m) * quantum as low,
         e - size + (i // m) * source_size + least((i % m + 1) * quantum, size) as high
  from i),
o as (select *, sum(high - low) over (order by high / target, source is null, source, high rows between unbounded preceding and current row) as upto from p),
v as (
  select source, sum(greatest(0, least(high - low, (select floor(1.5 * sum(size)) from d) - (upto - (high - low))))) as served
  from o group by source)
select c.doc_id, c.size, c.source_size, c.target,
       cast(greatest(0, least(size, coalesce(served, 0) - (e - size))) + greatest(0, least(size, coalesce(served, 0) - source_size - (e - size))) as bigint) as taken
from c left join v on c.source is not distinct from v.source
"""
