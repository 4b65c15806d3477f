"""Queries of citations, over texts that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import citations as C
from evidentia.sources.tables import table

QUERIES, SQL = {}, {}


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Codes of orders: c0 to c6 have sections, c7 none; c8 is no alias.
CODES = {f"Кодекс-{i}": f"c{i}" for i in range(8)}


@q("""with s as (select distinct 'c' || (o_custkey % 7) as code, cast(o_orderkey as varchar) as number, cast(o_orderkey % 50 as varchar) as chapter, o_orderstatus = 'F' as repealed from orders),
acts as (select 'act' || n_nationkey as code, n_nationkey % 20 as d, cast(n_nationkey as varchar) as no from nation),
qs as (select l_orderkey * 10 + l_linenumber as qid, l_linenumber % 4 as form, l_partkey % 9 as k, l_orderkey as o, l_suppkey % 23 as day, l_partkey % 30 as no, l_quantity % 12 as point from lineitem),
r as (select qid, case when form = 3 then 'point' when form = 2 then 'chapter' else 'article' end as kind, form, k, o, day, no, point,
  case when form = 3 then cast(cast(point as bigint) as varchar) when form = 2 then cast(o % 60 as varchar) else cast(o as varchar) end as number, case when form = 1 then cast(o % 51 as varchar) end as chapter from qs),
a as (select r.*, (select count(*) from acts where d = r.day) as n_acts, case when form <> 3 then 'c' || k when o % 2 = 0 then (select min(code) from acts where d = r.day and acts.no = cast(r.no as varchar)) else (select case when count(*) = 1 then min(code) end from acts where d = r.day) end as code from r)
select qid, case when form <> 3 and k = 8 then null else a.kind end as kind, case when form <> 3 and k = 8 then null else a.number end as number, case when form <> 3 and k = 8 then null else a.chapter end as chapter, case when form <> 3 and k = 8 then null else a.code end as code,
case when form = 3 then case when o % 2 = 1 and n_acts > 1 then 'ambiguous_date' when a.code is null then 'unknown_act' when point >= 10 or point = 0 then 'missing' when point = 9 then 'repealed' else 'found' end
  when k = 8 then 'unparsed' when k = 7 then 'not_exported'
  when form = 2 then case when o % 60 >= 50 then 'missing' when o % 60 % 5 = 0 then 'heading_only' else 'found' end
  when o % 11 = 0 then 'known_missing' when s.code is null or (form = 1 and s.chapter <> a.chapter) then 'missing' when s.repealed then 'repealed' else 'found' end as status
from a left join s on form in (0, 1) and s.code = a.code and s.number = a.number""")
def j07_citation_states(spark, d):
    """Citations in four forms, one for each line: article, article of a chapter,
    chapter, point of an act with and without its number."""
    o, line, n = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "nation")
    codes = spark.range(7).select(F.concat(F.lit("c"), "id").alias("code"))
    articles = o.select(F.concat(F.lit("c"), F.col("o_custkey") % 7).alias("code"), F.lit("article").alias("kind"), F.col("o_orderkey").cast("string").alias("number"), (F.col("o_orderkey") % 50).cast("string").alias("chapter"), (F.col("o_orderstatus") == "F").alias("repealed"), F.lit(900).alias("body_chars")).distinct()
    chapters = codes.crossJoin(F.broadcast(spark.range(50))).select("code", F.lit("chapter").alias("kind"), F.col("id").cast("string").alias("number"), F.lit(None).cast("string").alias("chapter"), F.lit(False).alias("repealed"), F.when(F.col("id") % 5 == 0, 30).otherwise(300).alias("body_chars"))
    acts = n.select(F.concat(F.lit("act"), "n_nationkey").alias("code"), F.date_add(F.lit("2010-01-01").cast("date"), (F.col("n_nationkey") % 20).cast("int")).alias("day"), F.col("n_nationkey").alias("act_number"))
    points = acts.select("code", F.lit("point").alias("kind"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("p")).select("code", "kind", F.col("p").cast("string").alias("number"), F.lit(None).cast("string").alias("chapter"), (F.col("p") == 9).alias("repealed"), F.lit(90).alias("body_chars"))
    gaps = articles.filter(F.col("number").cast("long") % 11 == 0).select("code", "number").union(line.filter("l_orderkey % 11 = 0").select(F.concat(F.lit("c"), F.col("l_partkey") % 9), F.col("l_orderkey").cast("string")))
    alias, number = F.concat(F.lit(" Кодекс-"), F.col("l_partkey") % 9), F.col("l_orderkey").cast("string")
    day = F.date_format(F.date_add(F.lit("2010-01-01").cast("date"), (F.col("l_suppkey") % 23).cast("int")), "dd.MM.yyyy")
    point = F.concat(F.lit("п. "), (F.col("l_quantity") % 12).cast("long").cast("string"), F.lit(" Пленума ВС РФ от "), day, F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit(" № "), F.col("l_partkey") % 30)).otherwise(""))
    form = F.col("l_linenumber") % 4
    text = F.when(form == 3, point).when(form == 2, F.concat(F.lit("Глава "), F.col("l_orderkey") % 60, alias)).when(form == 1, F.concat(F.lit("статью "), number, F.lit(" главы "), F.col("l_orderkey") % 51, alias, F.lit(" РФ"))).otherwise(F.concat(F.lit("ст. "), number, alias))
    asked = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("qid"), text.alias("text"))
    return C.resolve(asked, "text", CODES, articles.unionByName(chapters).unionByName(points), acts, gaps).drop("text")


@q("""with n as (select o_orderkey as source, o_custkey % 7 as own, row_number() over (order by o_orderkey) as rn from orders), l as (select l_orderkey, l_linenumber, l_partkey from lineitem),
m as (select source, own, l_partkey as number, case when l_linenumber % 3 = 0 then own else (source % 7) end as code from n join l on l_orderkey = source
  union all select source, own, 1 + source % 5 + i, own from n, (select unnest([0, 1, 2]) as i)),
t as (select p_partkey as target, p_partkey % 7 as code, p_partkey as number from part)
select distinct source, target from m join t using (code, number) where source <> target""")
def j08_text_edges(spark, d):
    """Edges of a text for each order: a list with a code, a list with `this
    code`, and a range with `the same code`."""
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey")))), ", ").alias("coded"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey")))), " и ").alias("own"))
    o = table(spark, d, "orders").join(lists, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    first = 1 + F.col("o_orderkey") % 5
    text = F.concat_ws(
        "; ",
        F.when(F.coalesce("coded", F.lit("")) != "", F.concat(F.lit("в силу статей "), "coded", F.lit(" Кодекс-"), F.col("o_orderkey") % 7, F.lit(" РФ"))),
        F.when(F.coalesce("own", F.lit("")) != "", F.concat(F.lit("ст. "), "own", F.lit(" настоящего Кодекса"))),
        F.concat(F.lit("глава 1 Кодекс-"), F.col("o_custkey") % 7, F.lit(", статьи "), first, F.lit("–"), first + 2, F.lit(" того же кодекса")),
    )
    nodes = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey") % 7).alias("code"), text.alias("text"))
    targets = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("c"), F.col("p_partkey") % 7).alias("code"), F.lit("article").alias("kind"), F.col("p_partkey").cast("string").alias("number"))
    return C.reference_edges(nodes, "text", CODES, targets).select("source", "target")
