"""Names as entities: normal forms, near names, classes, conflicts.

Two names are near within two edits where both have six letters, else within
one, or where one of six letters and more begins the other (inflected forms).
Only distinct normal forms are compared, so a name that very many rows bear is
one form (near.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import norm_words, translit
from evidentia.operators.graph import connected_components
from evidentia.operators.near import is_near, near_rows, shuffled
from evidentia.sources.shared import stage

#: Letters from which a name is long.
LONG = 6


def edited_forms(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b: pairs of forms (column form, distinct and not empty) of two tables
    within two edits where both are long, else within one; equal ones too."""
    return near_rows(left.select(F.col("form").alias("a")), right.select(F.col("form").alias("b")), LONG, None)


def near_forms(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b: pairs of forms (column form, distinct and not empty) of two tables
    that are near or equal."""
    return near_rows(left.select(F.col("form").alias("a")), right.select(F.col("form").alias("b")), LONG, LONG)


def form_of(name: Column) -> Column:
    """Normal form over alphabets: words in lower case, transliterated."""
    return norm_words(translit(F.lower(name)))


def normalise_entities(names: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """id, form, entity, same, size: the normal form of each name, the class of
    near forms it is in (by its least form), how many rows have the form, and how
    many forms the class has. Blank names have no form and no class; nothing is
    said about whom they name."""
    rows = names.select(id_col, F.nullif(F.coalesce(form_of(F.col(name_col)), F.lit("")), F.lit("")).alias("form"))
    forms = rows.filter("form is not null").groupBy("form").agg(F.count("*").alias("same"))
    edges = near_forms(forms, forms).filter("a < b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    classes = forms.join(connected_components(edges).withColumnRenamed("node", "form"), "form", "left").withColumn("entity", F.coalesce("component", "form")).drop("component")
    sizes = classes.groupBy("entity").agg(F.count("*").alias("size"))
    return rows.join(classes.join(sizes, "entity"), "form", "left").select(id_col, "form", "entity", "same", "size")


def conflicts(queries: DataFrame, parties: DataFrame, relations: DataFrame) -> DataFrame:
    """qid, client, opponent, links, unknown, verdict for each query (qid, name).

    parties: name, role (client or opponent); relations: a, b (names), each a
    link once, whichever side is met. client and opponent count the parties that
    are near the query's name, from counts by form; unknown is the number of
    opponents without a name. verdict: conflict, client, link, no_data (nothing
    met, but opponents are unknown, or the query has no name), none."""
    q = queries.select("qid", F.coalesce(form_of(F.col("name")), F.lit("")).alias("form"))
    p = parties.select(F.coalesce(form_of(F.col("name")), F.lit("")).alias("form"), "role")
    counts = p.filter("form <> ''").groupBy(F.col("form").alias("b")).agg(F.count_if(F.col("role") == "client").alias("client"), F.count_if(F.col("role") == "opponent").alias("opponent"))
    counts = stage(counts, "conflict-parties")
    links = stage(relations.select(form_of(F.col("a")).alias("fa"), form_of(F.col("b")).alias("fb")).groupBy("fa", "fb").agg(F.count("*").alias("n")), "conflict-links")
    asked = stage(q.filter("form <> ''").select(F.col("form").alias("a")).distinct(), "conflict-asked")
    met = near_rows(asked, counts, LONG, LONG).groupBy("a").agg(F.sum("client").alias("client"), F.sum("opponent").alias("opponent"))
    one = near_rows(asked, links.filter("fa <> ''").select(F.col("fa").alias("b"), F.col("fb").alias("other"), "n"), LONG, LONG).select("a", "n")
    # A link both of whose sides are near is found from its first.
    two = near_rows(asked, links.filter("fb <> ''").select(F.col("fb").alias("b"), F.col("fa").alias("other"), "n"), LONG, LONG)
    linked = one.union(two.filter(~is_near("a", "other", LONG, LONG)).select("a", "n")).groupBy("a").agg(F.sum("n").alias("links"))
    unknown = p.filter("form = '' and role = 'opponent'").agg(F.count("*").alias("unknown"))
    rows = q.join(shuffled(met), q["form"] == met["a"], "left").drop("a").join(shuffled(linked), F.col("form") == F.col("a"), "left").drop("a").crossJoin(F.broadcast(unknown))
    rows = rows.select("qid", "form", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("client", "opponent", "links")], "unknown")
    verdict = F.when(F.col("opponent") > 0, "conflict").when(F.col("client") > 0, "client").when(F.col("links") > 0, "link").when((F.col("unknown") > 0) | (F.col("form") == ""), "no_data").otherwise("none")
    return rows.select("qid", "client", "opponent", "links", "unknown", verdict.alias("verdict"))
