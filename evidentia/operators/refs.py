"""References: citations resolved to sections, conflicts, licences, journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import norm_words
from evidentia.operators.entities import LONG
from evidentia.operators.near import near_rows, shuffled
from evidentia.sources.shared import stage


def resolve_citations(queries: DataFrame, sections: DataFrame, aliases: DataFrame) -> DataFrame:
    """queries: qid, text like `alias 12`; aliases: alias, code; sections: code,
    num, repealed. qid, status: unknown_code, no_number, not_exported (a code
    without sections), missing, repealed or found. Numbers match as a whole."""
    parts = queries.select("qid", norm_words(F.regexp_extract("text", r"^(.*?)\s*[0-9.]*$", 1)).alias("alias"), F.nullif(F.regexp_extract("text", r"([0-9]+(?:\.[0-9]+)*)$", 1), F.lit("")).alias("num"))
    rows = parts.join(aliases.select(norm_words("alias").alias("alias"), "code"), "alias", "left")
    codes = sections.select("code").distinct().withColumn("exported", F.lit(True))
    rows = rows.join(codes, "code", "left").join(sections.select("code", "num", "repealed").distinct(), ["code", "num"], "left")
    status = F.when(F.col("code").isNull(), "unknown_code").when(F.col("num").isNull(), "no_number").when(F.col("exported").isNull(), "not_exported").when(F.col("repealed").isNull(), "missing").when(F.col("repealed"), "repealed").otherwise("found")
    return rows.select("qid", "code", "num", status.alias("status"))


def reference_edges(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """mentions: source, key (as written); nodes: id, key. Edges to other nodes
    by equal keys; mentions of no node give none."""
    return mentions.join(nodes, "key").filter("source <> id").select("source", F.col("id").alias("target")).distinct()


def conflict_check(queries: DataFrame, parties: DataFrame) -> DataFrame:
    """queries: qid, name; parties: pid, name, role. qid, hits, unknown: parties
    within 2 edits where both names have 6 letters, else 1, found among different
    names and counted by them; rows with blank names are counted as unknown, so
    nothing is called free of conflict on their account."""
    form = F.coalesce(norm_words("name"), F.lit(""))
    asked = queries.select("qid", form.alias("form"))
    known = parties.select("pid", form.alias("form"))
    # A party with several rows of one name, or of several near names, is one hit.
    owned = known.filter("form <> ''").distinct()
    single = owned.groupBy("pid").agg(F.min("form").alias("form"), F.count("*").alias("names"))
    counts = stage(single.filter("names = 1").groupBy(F.col("form").alias("b")).agg(F.count("*").alias("n")), "check-names")
    several = owned.join(shuffled(single.filter("names > 1").select("pid")), "pid", "left_semi").select(F.col("form").alias("b"), "pid")
    forms = stage(asked.select(F.col("form").alias("a")).filter("a <> ''").distinct(), "check-asked")
    by_one = near_rows(forms, counts, LONG, None).groupBy("a").agg(F.sum("n").alias("n"))
    by_several = near_rows(forms, stage(several, "check-several"), LONG, None).groupBy("a").agg(F.countDistinct("pid").alias("n"))
    hits = by_one.union(by_several).groupBy(F.col("a").alias("form")).agg(F.sum("n").alias("hits"))
    blank = known.agg(F.count_if(F.col("form") == "").alias("unknown"))
    return asked.join(shuffled(hits), "form", "left").crossJoin(F.broadcast(blank)).select("qid", F.coalesce("hits", F.lit(0)).alias("hits"), "unknown")


def license_gate(items: DataFrame, exceptions: DataFrame) -> DataFrame:
    """items: item, license; exceptions: item. copyleft blocks unless excepted,
    unknown blocks."""
    rows = items.join(exceptions.select("item", F.lit(True).alias("ex")).distinct(), "item", "left")
    verdict = F.when(F.col("license") == "unknown", "blocked").when((F.col("license") == "copyleft") & F.col("ex").isNull(), "blocked").when(F.col("ex"), "excepted").otherwise("ok")
    return rows.select("item", "license", verdict.alias("verdict"))


def license_drift(declared: DataFrame, used: DataFrame) -> DataFrame:
    """item, status: undeclared (used alone), unused (declared alone) or
    relicensed (another license)."""
    rows = declared.select("item", F.col("license").alias("d"), F.lit(True).alias("in_d")).join(used.select("item", F.col("license").alias("u"), F.lit(True).alias("in_u")), "item", "full")
    status = F.when(F.col("in_d").isNull(), "undeclared").when(F.col("in_u").isNull(), "unused").when(~F.col("d").eqNullSafe(F.col("u")), "relicensed")
    return rows.select("item", status.alias("status")).filter("status is not null")


def edited(df: DataFrame, baseline: DataFrame, key: str, value: str, when: Column, days: int = 8) -> DataFrame:
    """Rows that differ from their baseline and were modified within days of
    `when`; without a baseline a row isn't listed."""
    rows = df.join(baseline.select(key, F.col(value).alias("__b")), key)
    return rows.filter((F.col(value) != F.col("__b")) & (F.datediff(when, "modified").between(0, days))).drop("__b")


def collect_pages(df: DataFrame, page: str, key: str, most: int = 50, empty: int = 2) -> DataFrame:
    """Pages up to the point where `empty` pages in a row bring no new key, at
    most `most`: page, new_keys. One row a page enters the window."""
    first = df.groupBy(key).agg(F.min(page).alias(page)).groupBy(page).agg(F.count(F.lit(1)).alias("new_keys"))
    rows = df.select(page).distinct().join(first, page, "left").withColumn("new_keys", F.coalesce("new_keys", F.lit(0))).filter(F.col(page) <= most)
    w = Window.orderBy(page)
    dry = F.sum(F.when(F.col("new_keys") == 0, 1).otherwise(0)).over(w.rowsBetween(-(empty - 1), 0)) == empty
    rows = rows.withColumn("stops", dry.cast("int"))
    done = F.coalesce(F.sum("stops").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__d", done).filter("__d = 0").select(page, "new_keys")


def verify_anchors(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """nodes: id, doc_id, line_no, label, sha; lines: doc_id, line_no, line, sha.
    id, state: stale where the source changed, ok where the label stands in its
    line, else bad."""
    rows = nodes.join(lines.select("doc_id", "line_no", "line", F.col("sha").alias("now")), ["doc_id", "line_no"], "left")
    ok = F.contains(norm_words("line"), norm_words("label"))
    return rows.select("id", F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("sha"), "stale").when(ok, "ok").otherwise("bad").alias("state"))


def review_nodes(nodes: DataFrame, manifest: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """nodes: id, source, sha; manifest: source, sha, checked. id, needs_review."""
    rows = nodes.join(manifest.select("source", F.col("sha").alias("m"), "checked"), "source", "left")
    age = F.datediff(now, "checked")
    return rows.select("id", F.coalesce((F.col("m") != F.col("sha")) | (age > days) | (age < 0), F.lit(True)).alias("needs_review"))


def find_blocks(df: DataFrame, id_col: str, json_col: str, kind: str = "tool_use", depth: int = 5) -> DataFrame:
    """id, path, name, block (JSON): objects of a kind that have a name, anywhere
    in a record down to depth levels. Records that aren't JSON have none."""
    spark = df.sparkSession
    level = df.select(id_col, F.try_parse_json(json_col).alias("v"), F.lit("$").alias("path"))
    found = None
    for i in range(depth + 1):
        name = F.try_variant_get("v", "$.name", "string")
        here = level.filter((F.try_variant_get("v", "$.type", "string") == kind) & name.isNotNull()).select(id_col, "path", name.alias("name"), F.to_json("v").alias("block"))
        found = here if found is None else found.unionByName(here)
        if i < depth:
            inner = spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "inner")
            level = level.lateralJoin(inner).select(id_col, F.col("inner").alias("v"), F.concat("path", F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))).alias("path"))
    return found
