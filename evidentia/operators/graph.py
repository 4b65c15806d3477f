"""Facts as nodes and edges: build, dedup, defects, neighbours, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.sources.shared import discard, stage


def star_graph(df: DataFrame, nodes: dict[str, str], edges: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of rows. nodes: kind -> column with its key; edges:
    (source kind, relation, target kind), only between values of one row."""

    def name(kind: str):
        return F.concat_ws(":", F.lit(kind), F.col(nodes[kind]).cast("string"))

    kinds = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("kind"), name(k).alias("id"))) for k, c in nodes.items()])
    n = df.select(F.inline(F.filter(kinds, lambda x: x.isNotNull()))).distinct()
    links = F.array(*[F.when(F.col(nodes[a]).isNotNull() & F.col(nodes[b]).isNotNull(), F.struct(name(a).alias("source"), F.lit(r).alias("relation"), name(b).alias("target"))) for a, r, b in edges])
    e = df.select(F.inline(F.filter(links, lambda x: x.isNotNull()))).distinct()
    return n, e


def dedup_edges(edges: DataFrame, order: str) -> DataFrame:
    """The last edge of each source, target and relation."""
    names = edges.columns
    last = edges.groupBy("source", "target", "relation").agg(F.max_by(F.struct(*names), F.col(order)).alias("x"))
    return last.select(*[F.col(f"x.`{c}`") for c in names])


def defects(nodes: DataFrame, edges: DataFrame, needs: dict[str, str]) -> DataFrame:
    """id, kind, defect: nodes of a kind without an edge of the relation it
    needs. A relation that no edge has is not measurable: one row with a null id."""
    out = None
    for kind, relation in needs.items():
        own = edges.filter(F.col("relation") == relation)
        bad = nodes.filter(F.col("kind") == kind).join(own.select(F.col("source").alias("id")), "id", "left_anti").select("id", "kind", F.lit(f"no_{relation}").alias("defect"))
        any_ = own.agg(F.count(F.lit(1)).alias("c"))
        bad = bad.crossJoin(F.broadcast(any_)).filter("c > 0").drop("c").unionByName(any_.filter("c = 0").select(F.lit(None).cast("string").alias("id"), F.lit(kind).alias("kind"), F.lit("not_measurable").alias("defect")))
        out = bad if out is None else out.unionByName(bad)
    return out


def prune(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = keep.select("id").distinct()
    e = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes.join(ids, "id", "left_semi"), e


def neighbours(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """id, neighbours: sorted distinct ids on either side of a hit's edges."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("o")).union(edges.select(F.col("target").alias("id"), F.col("source").alias("o")))
    return hits.select("id").distinct().join(both, "id").groupBy("id").agg(F.array_sort(F.collect_set("o")).alias("neighbours"))


#: Rows of one join key that go to one task at most; keys with more are broadcast.
HEAVY = 100_000
#: Rows of edges in one partition, about.
PART = 500_000


def _beside_least(edges: DataFrame, n: int, made: list[str]) -> DataFrame:
    """edges (u, v) with m, the least v of each u. A hub's edges are not brought
    together: hubs are few (one for HEAVY edges at most) and their minima are
    broadcast; the other edges go to n partitions by u."""
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")), "least", made)
    hubs = F.broadcast(least.filter(F.col("k") > HEAVY).select("u", "m"))
    rest = edges.join(hubs, "u", "left_anti").repartition(n, "u").join(least.filter(F.col("k") <= HEAVY).select("u", "m").repartition(n, "u").hint("merge"), "u")
    return edges.join(hubs, "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def _distinct(edges: DataFrame, n: int) -> DataFrame:
    return edges.repartition(n, "u", "v").distinct()


def _large_star(edges: DataFrame, n: int, made: list[str]) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _beside_least(both, 2 * n, made).withColumn("m", F.least("u", "m"))
    return _distinct(near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"), n)


def _small_star(edges: DataFrame, n: int, made: list[str]) -> DataFrame:
    down = _beside_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), n, made)
    # An edge to the least itself stays; another goes from its end to the least.
    return _distinct(down.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")), n)


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges: u, v of one type with an order. Returns node, component (the
    least node), one row for each node that is not itself the least of its
    component.

    Alternating star joins: each round keeps only minima of neighbourhoods, so
    hubs are never collected; rounds grow with the logarithm of the longest
    path. Each round is written to the shared folder, and what led to it deleted
    there, so disk does not grow with the rounds. Self-loops and nulls
    are ignored; an empty table gives an empty table. Raises where most_rounds
    don't suffice."""
    spark, made = edges.sparkSession, []
    edges = stage(edges.filter("u <> v").select("u", "v").distinct(), "edges", made)
    n = max(1, -(-edges.count() // PART))
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003))
    seen = edges.agg(mark).first()[0]
    for _ in range(most_rounds):
        if not seen[0]:
            break
        edges = stage(_small_star(stage(_large_star(edges, n, made), "stars", made), n, made), "edges", made)
        discard(spark, made[:-1])
        made = made[-1:]
        now = edges.agg(mark).first()[0]
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """id, component: the least id reachable over edges (source, target), a row
    for each id of an edge."""
    pairs = edges.select(F.col("source").alias("u"), F.col("target").alias("v"))
    found = connected_components(pairs)
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).filter("id is not null").distinct()
    found = ids.join(found.withColumnRenamed("node", "id").hint("merge"), "id", "left")
    return stage(found.select("id", F.coalesce("component", "id").alias("component")), "components")


def cohesion(edges: DataFrame, label: DataFrame) -> DataFrame:
    """component, nodes, edges, cohesion: edges inside by possible pairs."""
    s = edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    inside = s.join(label.withColumnsRenamed({"id": "source", "component": "a"}).hint("merge"), "source").join(label.withColumnsRenamed({"id": "target", "component": "b"}).hint("merge"), "target").filter("a = b")
    e = inside.groupBy(F.col("a").alias("component")).agg(F.count(F.lit(1)).alias("edges"))
    n = label.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    return n.join(e, "component", "left").select("component", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.when(F.col("nodes") > 1, F.coalesce("edges", F.lit(0)) / (F.col("nodes") * (F.col("nodes") - 1) / 2)).otherwise(1.0).alias("cohesion"))
