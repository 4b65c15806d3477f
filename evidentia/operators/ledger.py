"""Usage ledgers over event logs: attribution, cuts, limits, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.sources.shared import cut

COUNTERS = ("tokens_in", "tokens_out", "cache_write", "cache_read")


def sticky_step(df: DataFrame, stream: str = "stream", order: str = "line", signal: str = "signal") -> DataFrame:
    """df with step: the last signal at or before a row of its stream; 0 before
    any. Take it before duplicates are dropped: they can carry signals."""
    w = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("step", F.coalesce(F.last(signal, True).over(w), F.lit(0)))


def dedup_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, as an aggregate, so tasks keep one row a key."""
    names = df.columns
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in names]), F.col(order)).alias("__x"))
    return last.select(*[F.col(f"__x.`{c}`").alias(c) for c in names])


def usage_cuts(df: DataFrame, cuts: tuple[str, ...] = ("step", "stream", "model")) -> DataFrame:
    """cut, key, counters, calls: each cut and the grand total in one pass."""
    sums = [F.sum(c).alias(c) for c in COUNTERS]
    sets = [[], *[[F.col(c)] for c in cuts]]
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in cuts], *COUNTERS)
    out = rows.groupingSets(sets, *[F.col(c) for c in cuts]).agg(*sums, F.count(F.lit(1)).alias("calls"), *[F.grouping(c).alias(f"g_{c}") for c in cuts])
    name = F.lit("total")
    for c in cuts:
        name = F.when(F.col(f"g_{c}") == 0, c).otherwise(name)
    return out.select(name.alias("cut"), F.coalesce(*cuts, F.lit("")).alias("key"), *COUNTERS, "calls")


def price_usage(df: DataFrame, prices: DataFrame) -> DataFrame:
    """model, calls, cost: usage at the model's rates (per million); a model
    not listed is priced at the dearest and reported as unknown."""
    top = prices.agg(F.max("price_in").alias("top_in"), F.max("price_out").alias("top_out"))  # one row
    rows = df.join(prices, "model", "left").crossJoin(F.broadcast(top))
    cost = (F.col("tokens_in") * F.coalesce("price_in", "top_in") + F.col("tokens_out") * F.coalesce("price_out", "top_out")) / 1e6
    key = F.when(F.col("price_in").isNull(), "unknown").otherwise(F.col("model"))
    return rows.groupBy(key.alias("model")).agg(F.count(F.lit(1)).alias("calls"), F.sum(cost).alias("cost"))


def merge_reports(df: DataFrame, key: str) -> DataFrame:
    """Partial reports (key, total, peak, floor) merged: sum, max, least positive."""
    return df.groupBy(key).agg(F.sum("total").alias("total"), F.max("peak").alias("peak"), F.min(F.nullif(F.col("floor"), F.lit(0))).alias("floor"))


def family_total(df: DataFrame, stream: str, root: str, counter: str) -> DataFrame:
    """Cumulative counters: the most of each stream, summed over its family."""
    most = df.groupBy(root, stream).agg(F.max(counter).alias("most"))
    return most.groupBy(root).agg(F.sum("most").alias("total"), F.count(F.lit(1)).alias("streams"))


def preamble(df: DataFrame, context: Column) -> DataFrame:
    """stream, floor, calls, repeated: the least context of a stream is sent
    again with every call; all but the first are repeats."""
    rows = df.select("stream", context.alias("ctx")).groupBy("stream").agg(F.min("ctx").alias("floor"), F.count(F.lit(1)).alias("calls"))
    return rows.withColumn("repeated", F.col("floor") * (F.col("calls") - 1))


def preamble_bill(df: DataFrame, context: Column, prices: DataFrame) -> DataFrame:
    """stream, floor, calls, tokens, cost: the least context of a stream is
    delivered with every call; the first call pays the write price of its model
    (per million), the others the read price of theirs. prices: model, write,
    read. Calls are counted by stream and model first, so no stream is sorted."""
    rows = df.groupBy("stream", "model").agg(F.min(context).alias("floor"), F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    rows = rows.join(prices, "model")
    rows = rows.groupBy("stream").agg(F.min("floor").alias("floor"), F.sum("n").alias("calls"), F.sum(F.col("n") * F.col("read")).alias("reads"), F.min_by(F.col("write") - F.col("read"), "line").alias("more"))
    return rows.select("stream", "floor", "calls", (F.col("floor") * F.col("calls")).alias("tokens"), F.round(F.col("floor") * (F.col("reads") + F.col("more")) / 1e6, 9).alias("cost"))


def over_limit(df: DataFrame, key: str, value: str, limit: int) -> DataFrame:
    return df.groupBy(key).agg(F.max(value).alias("peak"), F.count(F.lit(1)).alias("calls"), F.count_if(F.col(value) > limit).alias("over"))


def budget_verdict(totals: DataFrame, budgets: DataFrame, key: str) -> DataFrame:
    """key, verdict: no_data where nothing was measured, no_budget, over, within."""
    rows = totals.join(budgets, key, "full")
    verdict = F.when(F.coalesce("total", F.lit(0)) == 0, "no_data").when(F.col("budget").isNull(), "no_budget").when(F.col("total") > F.col("budget"), "over").otherwise("within")
    return rows.select(key, verdict.alias("verdict"))


def blended_rate(df: DataFrame, key: str, order: str, amount: str, units: str, newest: int = 20, least: int = 3, default: float = 1.0) -> DataFrame:
    """key, rate, rough: median amount a unit of the newest rows; with fewer
    than `least`, the default, marked rough."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    rows = df.filter(F.col(units) > 0).withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= newest)
    rows = rows.groupBy(key).agg(F.median(F.col(amount) / F.col(units)).alias("m"), F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.when(F.col("n") >= least, F.col("m")).otherwise(F.lit(default)).alias("rate"), (F.col("n") < least).alias("rough"))


def can_start(rates: DataFrame, key: str, limit: float, spent: str, units: float) -> DataFrame:
    """key, can_start: limit - spent covers rate * units."""
    return rates.select(key, (F.lit(limit) - F.col(spent) >= F.col("rate") * units).alias("can_start"))


def diagnose(usage: DataFrame, key: str = "step", other: str = "0", main: str | None = None, cache_read: float = 90.0, output: float = 3.0, dominant: float = 35.0, unassigned: float = 5.0) -> DataFrame:
    """rule, part, share (percent of all counters): where usage went. cache_read
    and output: that counter's share is over its bound; dominant: the greatest
    part of key but `main` and `other` is; unassigned: the part `other` is;
    no_data: nothing was counted. No row means no finding."""
    every = sum((F.coalesce(F.sum(c), F.lit(0)) for c in COUNTERS), F.lit(0))
    parts = usage.groupBy(F.col(key).cast("string").alias("part")).agg(every.alias("v"), F.sum("cache_read").alias("cr"), F.sum("tokens_out").alias("out"))
    named = F.col("part").isin(other, main) if main else F.col("part") == other
    top = F.max(F.when(~named, F.struct("v", F.expr("part"))))
    all_ = parts.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("all"), F.sum("cr").alias("cr"), F.sum("out").alias("out"), top.alias("top"), F.sum(F.when(F.col("part") == other, F.col("v"))).alias("other"))
    share = lambda x: F.round(F.lit(100.0) * x / F.col("all"), 4)

    def finding(rule: str, part: Column, x: Column, bound: float) -> Column:
        return F.when((F.col("all") > 0) & (share(x) > bound), F.struct(F.lit(rule).alias("rule"), part.alias("part"), share(x).alias("share")))

    none = F.when(F.col("all") == 0, F.struct(F.lit("no_data").alias("rule"), F.lit("").alias("part"), F.lit(0.0).alias("share")))
    found = F.array(none, finding("cache_read", F.lit(""), F.col("cr"), cache_read), finding("output", F.lit(""), F.col("out"), output), finding("dominant", F.col("top.part"), F.col("top.v"), dominant), finding("unassigned", F.lit(other), F.col("other"), unassigned))
    return all_.select(F.inline(F.filter(found, lambda x: x.isNotNull())))


def _running(df: DataFrame, keys: list[str], order: list[str], value: Column, slices: Column | None) -> DataFrame:
    """df with __run: the running sum of value in each key by order. slices, a
    column that grows with the order (an hour, thousands of line numbers), deals
    a key's rows: sums of slices come first, then sums inside each, so a key
    with most of the rows is many tasks."""
    rows = df.withColumn("__v", value)
    if slices is None:
        return rows.withColumn("__run", F.sum("__v").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__v")
    rows = rows.withColumn("__slice", slices)
    sums = rows.groupBy(*keys, "__slice").agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__slice", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, [*keys, "__slice"]).withColumn("__run", F.col("__before") + F.sum("__v").over(inside))
    return rows.drop("__v", "__slice", "__before")


def repeat_no(df: DataFrame, sig: str, order: list[str], slices: Column | None = None, warning: int = 3, critical: int = 10) -> DataFrame:
    """df with repeat, the count of its signature so far in the order, and its
    severity: info, warning from the third and critical from the tenth. slices:
    see _running."""
    rows = _running(df, [sig], order, F.lit(1), slices).withColumnRenamed("__run", "repeat")
    return rows.withColumn("severity", F.when(F.col("repeat") >= critical, "critical").when(F.col("repeat") >= warning, "warning").otherwise("info"))


def step_alerts(df: DataFrame, key: str, order: str, value: str, step: int, slices: Column | None = None) -> DataFrame:
    """Rows where the running sum passes a multiple of step. slices: see _running."""
    rows = _running(df, [key], [order], F.col(value), slices).withColumnRenamed("__run", "running")
    rows = rows.withColumn("level", F.floor(F.col("running") / step).cast("long"))
    return rows.filter(F.col("level") > F.floor((F.col("running") - F.col(value)) / step))


def coverage(declared: DataFrame, taken: DataFrame, key: str, cap: int, least: int) -> DataFrame:
    """key, declared, taken, cause: thin parts, because of the cap or short."""
    rows = declared.join(taken, key, "left").select(key, "declared", F.coalesce("taken", F.lit(0)).alias("taken"))
    cause = F.when(F.col("taken") == 0, "skipped").when(F.col("taken") >= cap, "cap").when((F.col("taken") < F.col("declared")) & (F.col("taken") < least), "short").otherwise("ok")
    return rows.withColumn("cause", cause)


def coverage_verdict(parts: DataFrame, ok_percent: float = 80.0) -> DataFrame:
    """declared, taken, percent, verdict of a coverage: complete from ok_percent
    on; under it capped where a part hit the source's cap, else incomplete."""
    all_ = parts.agg(F.sum("declared").alias("declared"), F.sum("taken").alias("taken"), F.bool_or(F.col("cause") == "cap").alias("cap"))
    percent = F.round(F.lit(100.0) * F.col("taken") / F.nullif("declared", F.lit(0)), 4)
    return all_.select("declared", "taken", percent.alias("percent"), F.when(percent >= ok_percent, "complete").when(F.col("cap"), "capped").otherwise("incomplete").alias("verdict"))


def page_states(files: DataFrame, pages: DataFrame, group: str, most_pages: int, least_chars: int = 10) -> DataFrame:
    """files: group, total; pages: group, number, layer (has a text layer),
    chars (recognised). Each of a file's pages is text, beyond (over most_pages
    and without a layer), missing (no such row), empty (under least_chars) or
    recognised. group, total, missing, beyond, empty, complete, needs_human."""
    every = files.select(group, "total", F.explode(F.sequence(F.lit(1), F.col("total").cast("int"))).alias("number"))
    rows = every.join(pages.select(group, F.col("number").cast("int").alias("number"), "layer", "chars"), [group, "number"], "left")
    state = F.when(F.col("layer"), "text").when(F.col("number") > most_pages, "beyond").when(F.col("chars").isNull(), "missing").when(F.col("chars") < least_chars, "empty").otherwise("recognised")
    n = {s: F.count_if(state == s) for s in ("missing", "beyond", "empty")}
    rows = rows.groupBy(group, "total").agg(*[c.alias(s) for s, c in n.items()])
    return rows.select(group, "total", "missing", "beyond", "empty", ((F.col("missing") == 0) & (F.col("beyond") == 0)).alias("complete"), (F.col("empty") > 0).alias("needs_human"))


def page_manifest(pages: DataFrame, group: str, number: str, state: Column) -> DataFrame:
    """group, total, missing numbers, empty numbers, complete."""
    rows = pages.groupBy(group).agg(F.max(number).alias("total"), F.array_sort(F.collect_set(number)).alias("have"), F.array_sort(F.collect_set(F.when(state, F.col(number)))).alias("empty"))
    gaps = F.array_sort(F.array_except(F.sequence(F.lit(1), F.col("total")), F.col("have")))
    return rows.select(group, "total", F.size(gaps).alias("missing"), F.size("empty").alias("empty"), ((F.size(gaps) == 0) & (F.size("empty") == 0)).alias("complete"))


def extraction_coverage(files: DataFrame, pages: DataFrame, group: str, gate: float = 0.1) -> DataFrame:
    """group, filled, total, share, state: a file without pages counts as 0 of 1."""
    rows = files.join(pages, group, "left").select(group, F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce("total", F.lit(1)).alias("total"))
    return rows.withColumn("share", F.col("filled") / F.col("total")).withColumn("state", F.when(F.col("share") < gate, "poor").otherwise("ok"))


def doc_bad_pages(pages: DataFrame, group: str, bad: Column, least: int = 2, share: float = 0.25) -> DataFrame:
    """Pages with doc_bad: whether so many of the document's are bad that all are."""
    w = Window.partitionBy(group)
    return pages.withColumn("doc_bad", F.count_if(bad).over(w) >= F.greatest(F.lit(float(least)), F.count(F.lit(1)).over(w) * share))


def attempt_state(log: DataFrame, key: str, ts: str, ok: Column) -> DataFrame:
    """key, state, failures, retry_s: failures since the last success and the
    wait, 60 s doubling up to a day."""
    rows = log.groupBy(key).agg(F.max(F.when(ok, F.col(ts))).alias("good"), F.max_by(ok, F.col(ts)).alias("ok"))
    fails = log.filter(~ok).join(rows.select(key, "good"), key).filter("good is null or ts > good").groupBy(key).agg(F.count(F.lit(1)).alias("failures"))
    out = rows.join(fails, key, "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    wait = F.least(F.lit(86400), (60 * F.pow(F.lit(2.0), F.least(F.col("failures") - 1, F.lit(10)))).cast("long"))
    return out.select(key, F.when(F.col("ok"), "ok").otherwise("failed").alias("state"), "failures", F.when(F.col("failures") > 0, wait).alias("retry_s"))


def assignment_state(log: DataFrame, key: str, opened: Column, closed: Column, ts: str, now, silent_s: int = 1200) -> DataFrame:
    """key, state: returned, running or silent, by the last opening and closing."""
    rows = log.groupBy(key).agg(F.max(F.when(opened, F.col(ts))).alias("o"), F.max(F.when(closed, F.col(ts))).alias("c")).filter("o is not null")
    age = F.unix_timestamp(now) - F.unix_timestamp("o")
    return rows.select(key, F.when(F.col("c") >= F.col("o"), "returned").when(age <= silent_s, "running").otherwise("silent").alias("state"))


def roots(edges: DataFrame, child: str, parent: str, depth: int = 20) -> DataFrame:
    """child, root: the top of each child's chain of parents, by doubling, so a
    chain of 2 ** r takes r joins. Each round is checkpointed and reads the last
    one's table alone. root is NULL where no top is reached: on a cycle, or on a
    chain longer than depth."""
    up = cut(edges.select(F.col(child).alias("n"), F.col(parent).alias("r")))
    has_parent = up.select(F.col("n").alias("m")).distinct().withColumn("below", F.lit(True))
    steps = 1
    while steps < depth:
        nxt = up.select(F.col("n").alias("m"), F.col("r").alias("r2"))
        up = cut(up.join(nxt, up["r"] == nxt["m"], "left").select("n", F.coalesce("r2", "r").alias("r")))
        steps *= 2
    up = up.join(has_parent, up["r"] == has_parent["m"], "left")
    return up.select(F.col("n").alias(child), F.when(F.col("below").isNull(), F.col("r")).alias("root"))


def latest_family(nodes: DataFrame, edges: DataFrame, depth: int = 20) -> DataFrame:
    """grp, root, id: the newest root of each group and all that descend from it.
    nodes: id, grp, ts; edges: child, parent. A node without a parent is a root
    and a member of its own family; equal times go to the greater id; a node on a
    cycle belongs to no family."""
    found = roots(edges, "child", "parent", depth).select(F.col("child").alias("id"), "root")
    tops = nodes.join(edges.select(F.col("child").alias("id")), "id", "left_anti")
    newest = tops.groupBy("grp").agg(F.max(F.struct("ts", "id")).alias("x")).select("grp", F.col("x.id").alias("root"))
    family = found.filter("root is not null").union(tops.select("id", F.col("id").alias("root"))).distinct()
    return family.join(newest, "root").select("grp", "root", "id")


def fingerprint(df: DataFrame, parts: list[str]) -> DataFrame:
    """rows, print: independent of order, and no list of rows is gathered: two
    hashes of each row are summed as decimals."""
    h = F.xxhash64(*parts).cast("decimal(38,0)")
    g = F.xxhash64(F.lit(1), *parts).cast("decimal(38,0)")
    sums = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).alias("h"), F.sum(g).alias("g"))
    return sums.select("rows", F.sha2(F.concat_ws(":", "rows", "h", "g"), 256).alias("print"))


def fingerprint_exact(df: DataFrame, parts: list[str]) -> DataFrame:
    """rows, print: SHA-256 of the sorted list; for small sets."""
    row = F.concat_ws(":", *parts)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ","), 256).alias("print"))
