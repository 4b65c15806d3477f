"""URL filter: host rules, then trust and distrust spread over a host graph.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import checkpoint, stage

#: Fixed values: (verdict, rule). A rule is host/path-prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Rounds of a walk between two cuts of the lineage.
CUT = 6
#: Rows of the host graph for each partition of a walk.
PART_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def _fits(host: Column, path: Column, rule: str) -> Column:
    h, _, p = rule.partition("/")
    return ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls without one. For
    rule lists that fit into one expression (some hundreds)."""
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: -len(x[1])):
        fit = _fits(host, path, r)
        rule = F.when(fit, r) if rule is None else rule.when(fit, r)
        verdict = F.when(fit, v) if verdict is None else verdict.when(fit, v)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def host_graph(pages: DataFrame, html_col: str) -> DataFrame:
    """src, dst, weight: one unit for each link from a page of src to another
    host, and for each host one to and from the domain it is a part of (its
    name without the first label, down to two labels)."""
    links = pages.filter(F.contains(html_col, F.lit("//"))).select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    names = pages.select("host").union(links.select("dst")).distinct()
    labels = F.split("host", r"\.")
    chain = names.select(F.explode(F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("a"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("b"))))).alias("x")).select("x.a", "x.b").distinct()
    ties = chain.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(chain.select(F.col("b").alias("src"), F.col("a").alias("dst"))).withColumn("weight", F.lit(1.0))
    edges = links.unionByName(ties).filter("src <> dst and src <> '' and dst <> ''")
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, most_rounds: int = 200) -> DataFrame:
    """Personalised PageRank. edges: kind, src, dst, weight; seeds: kind, host,
    mass. Returns kind, host, mass, where each kind's masses add up to 1. Kinds
    are separate walks carried in one join a round. A walk that comes to a host
    without edges out goes on from the seeds.

    Each round moves what arrived in the round before, damped, along the edges.
    Rounds go on until what is left to move is under tolerance of a kind's
    mass; raises if most_rounds don't suffice. What walks lose at hosts without
    edges would go out from the seeds again in the same proportions, so dividing
    by the sum in the end gives the same."""
    total = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    steps = edges.join(total, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("total") * damping).alias("share"))
    sums = seeds.groupBy("kind").agg(F.sum("mass").alias("all"))  # a row for each kind
    first = seeds.join(F.broadcast(sums), "kind").groupBy("kind", "host").agg(F.sum(F.col("mass") / F.col("all")).alias("mass"))
    state = checkpoint(first.select("kind", "host", F.col("mass").alias("new"), "mass"))
    # Each host has a step to itself, without a share, that carries its mass on.
    own = state.select("kind", "host").union(edges.select("kind", "src")).union(edges.select("kind", "dst")).distinct()
    steps = checkpoint(steps.union(own.select("kind", "host", F.col("host").alias("dst"), F.lit(None).cast("double").alias("share"))))
    parts = 1 + steps.count() // PART_ROWS  # a small graph in many partitions would be little but files
    steps, rounds = steps.coalesce(parts), 0
    while True:
        left = state.groupBy("kind").agg(F.sum("new").alias("m")).agg(F.max("m")).first()[0] or 0.0
        if left / (1 - damping) <= tolerance:
            break
        if rounds >= most_rounds:
            raise RuntimeError(f"the walks did not settle in {most_rounds} rounds")
        for _ in range(CUT):
            moved = F.col("new") * F.col("share")
            state = state.join(steps, ["kind", "host"]).select("kind", F.col("dst").alias("host"), F.coalesce(moved, F.lit(0.0)).alias("new"), F.coalesce(moved, "mass").alias("mass"))
            state = state.groupBy("kind", "host").agg(F.sum("new").alias("new"), F.sum("mass").alias("mass")).coalesce(parts)
            rounds += 1
        state = checkpoint(state)
    sums = state.groupBy("kind").agg(F.sum("mass").alias("all"))
    return state.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("mass") / F.col("all")).alias("mass"))


def filter_urls(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules=RULES, damping: float = 0.85, tolerance: float = 1e-3, ratio: float = 1.0, default: str = "allow") -> DataFrame:
    """pages with host, path, rule, verdict, trust and distrust.

    The longest rule that fits a url judges it. Other urls are judged by host:
    trust walks along links from hosts with allowed pages, distrust walks
    against links from hosts with blocked pages, each seeded in proportion to
    their numbers of such pages and adding up to 1 over all hosts, and a host
    is blocked where distrust exceeds ratio times trust. A host that neither
    walk reaches gets the default.

    Links are a elements with an absolute address (with or without a scheme);
    a relative one stays on its host and gives no edge. A null url, or one
    without ://, has empty host and path and the default. Null html has no
    links. Repeated rows count as pages each; columns named like the new ones
    are replaced. An empty table gives an empty table.

    Only host pairs, added up before the shuffle, and one row a host and walk
    enter the rounds; pages are joined to their host's verdict without html."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("__ruled", verdict)
    seeds = rows.filter("__ruled is not null and host <> ''").groupBy(F.col("__ruled").alias("kind"), "host").agg(F.count(F.lit(1)).cast("double").alias("mass"))
    edges = checkpoint(host_graph(rows, html_col))
    walks = edges.select(F.lit("allow").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    mass = spread(walks, checkpoint(seeds), damping, tolerance)
    hosts = mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == "allow", F.col("mass"))).alias("trust"), F.sum(F.when(F.col("kind") == "block", F.col("mass"))).alias("distrust"))
    hosts = stage(hosts.select(F.col("host").alias("__host"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "hosts")
    out = rows.drop("trust", "distrust", "verdict").join(hosts, F.col("host") == F.col("__host"), "left").drop("__host")
    judged = F.when(F.col("distrust") > ratio * F.col("trust"), "block").when(F.col("distrust").isNotNull(), "allow").otherwise(default)
    return out.withColumn("verdict", F.coalesce("__ruled", judged)).drop("__ruled")
