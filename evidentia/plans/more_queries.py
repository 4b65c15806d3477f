"""Queries of personal data, references, streams and jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidentia.functions import checks as C
from evidentia.functions import text as T
from evidentia.operators import ledger as L
from evidentia.operators import pii as P
from evidentia.operators import refs as A
from evidentia.operators import text as X
from evidentia.plans.text_queries import LINES, NORM, docs
from evidentia.sources.shared import shared_dir
from evidentia.sources.tables import USAGE, table
from evidentia.streaming import events as V

QUERIES, SQL = {}, {}


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def folder(spark) -> str:
    return f"{shared_dir(spark)}/evidentia/stream-{uuid.uuid4().hex}"


ANY = "|".join(f"(?:{p})" for p in P.CATEGORIES.values())


def _starts(category: str, pattern: str, source: str) -> str:
    """SQL: doc_id, cat, s, e of a pattern's matches; what stands between them,
    and the matches, add up."""
    return f"""select doc_id, '{category}' as cat, cast(s as int) as s, cast(s + length(m) as int) as e from (select doc_id, m, sum(length(g)) over w + coalesce(sum(length(m)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as s
from (select doc_id, unnest(regexp_split_to_array(text, '{pattern}')) as g, unnest(regexp_extract_all(text, '{pattern}')) as m, generate_subscripts(regexp_split_to_array(text, '{pattern}'), 1) as i from {source}) window w as (partition by doc_id order by i)) where m is not null"""


def _left(pattern: str, source: str) -> str:
    """SQL: texts with each match of a pattern blanked, their lengths kept."""
    blanked = f"array_to_string(list_transform(list_zip(regexp_split_to_array(text, '{pattern}'), regexp_extract_all(text, '{pattern}')), lambda z: z[1] || repeat('{P.TAKEN}', length(coalesce(z[2], '')))), '')"
    return f"select doc_id, case when regexp_matches(text, '{pattern}') then {blanked} else text end as text from {source}"


#: Matches of each category in what those before it have left.
_LEFT = ", ".join(f"t{i} as materialized ({_left(p, 'documents' if i == 1 else f't{i - 1}')})" for i, p in enumerate(P.CATEGORIES.values(), 1))
_SPANS = " union all ".join(_starts(k, p, f"t{i}" if i else "documents") for i, (k, p) in enumerate(P.CATEGORIES.items()))


@q(f"""with {_LEFT}, f as ({_SPANS}) select doc_id, cat, s, e from f""")
def p02_pii_spans(spark, d):
    return docs(spark, d).select("doc_id", F.inline(P.resolve_spans(P.find_spans(F.col("text"))))).select("doc_id", "cat", "s", "e")


@q(f"select doc_id, len(regexp_extract_all(text, '{P.CATEGORIES['EMAIL']}')) as emails, len(regexp_extract_all(text, '{P.CATEGORIES['PHONE']}')) as phones from documents")
def p02_pii_counts(spark, d):
    found = P.resolve_spans(P.find_spans(F.col("text")))

    def count(cat):
        return F.size(F.filter(found, lambda m: m["cat"] == cat)).cast("long")

    return docs(spark, d).select("doc_id", count("EMAIL").alias("emails"), count("PHONE").alias("phones"))


@q(f"select doc_id, text as back, true as changed from documents where regexp_matches(text, '{ANY}')")
def p05_unmask(spark, d):
    rows = P.mask(docs(spark, d).select("doc_id", "text"), "text").filter("masked is not null")
    return rows.select("doc_id", P.unmask(F.col("masked"), F.col("mapping")).alias("back"), (F.col("masked") != F.col("text")).alias("changed"))


#: Texts with each category's matches replaced in turn, as matches of different categories stand apart.
MASKED = "text"
for _k, _p in P.CATEGORIES.items():
    MASKED = f"regexp_replace({MASKED}, '{_p}', '[{_k}]', 'g')"


@q(f"select doc_id, case when regexp_matches(text, '{ANY}') then {MASKED} end as masked, len(regexp_extract_all(text, '{ANY}')) as spans from documents")
def p04_mask(spark, d):
    """Numbers of tokens are taken out to compare; p05_unmask has them."""
    rows = P.mask(docs(spark, d).select("doc_id", "text"), "text")
    return rows.select("doc_id", F.regexp_replace("masked", rf"\[({'|'.join(P.CATEGORIES)})_[0-9]+\]", r"[$1]").alias("masked"), F.size("spans").cast("long").alias("spans"))


@q(f"""with m as (select doc_id, case when regexp_matches(text, '{ANY}') then {MASKED} end as m from documents)
select doc_id, m is not null and not ({" or ".join(f"regexp_matches(m, '{p}')" for p in (P.CATEGORIES | P.LOOSE).values())}) as released,
       coalesce(concat_ws(',', {", ".join(f"case when regexp_matches(m, '{p}') then '{k}' end" for k, p in (P.CATEGORIES | P.LOOSE).items())}), '') as categories from m""")
def p06_residual_gate(spark, d):
    rows = P.mask(docs(spark, d).select("doc_id", "text"), "text")
    return rows.select("doc_id", P.residual_gate(F.col("masked")).alias("g")).select("doc_id", "g.released", F.array_join("g.categories", ",").alias("categories"))


@q()
def p02_case_file_spans(spark, d):
    """Spans of all categories of case files, one row each."""
    spans = P.resolve_spans(P.case_file_spans(F.col("text")))
    # A generated row first: a filter that Spark infers for it would run the patterns again.
    rows = docs(spark, d).select("doc_id", F.inline(F.array(F.struct(spans.alias("spans")))))
    return rows.select("doc_id", F.inline("spans")).select("doc_id", F.col("s").alias("start"), F.col("e").alias("end"), F.col("cat").alias("category"))


@q()
def p08_fold_confusables(spark, d):
    return docs(spark, d).select("doc_id", P.fold_confusables(F.col("text")).alias("folded"))


@q(f"""select conv_id, turn, left(regexp_replace(regexp_replace(regexp_replace(text, '{P.CATEGORIES['EMAIL']}', '[EMAIL]', 'g'), '[0-9]{{12,}}', '[DIGITS]', 'g'), '(?:/[A-Za-z0-9._-]+){{2,}}', '[PATH]', 'g'), 180) as sample from conversations""")
def f26_scrub(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", P.scrub(F.col("text")).alias("sample"))


@q("""with s as (select distinct 'c' || (o_custkey % 7) as code, cast(o_orderkey as varchar) as num, o_orderstatus = 'F' as repealed from orders), qs as (select l_orderkey * 10 + l_linenumber as qid, 'c' || (l_partkey % 9) as code, cast(l_orderkey as varchar) as num from lineitem)
select qid, case when qs.code = 'c8' then null else qs.code end as code, num, case when qs.code = 'c8' then 'unknown_code' when qs.code not in (select code from s) then 'not_exported' when s.repealed is null then 'missing' when s.repealed then 'repealed' else 'found' end as status from qs left join s using (code, num)""")
def j07_resolve_citations(spark, d):
    sections = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 7).alias("code"), F.col("o_orderkey").cast("string").alias("num"), (F.col("o_orderstatus") == "F").alias("repealed"))
    aliases = spark.range(8).select(F.concat(F.lit("Code-"), "id").alias("alias"), F.concat(F.lit("c"), "id").alias("code"))
    qs = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("qid"), F.concat(F.lit("code "), F.col("l_partkey") % 9, F.lit(" "), F.col("l_orderkey")).alias("text"))
    return A.resolve_citations(qs, sections, aliases)


@q("select distinct l_orderkey as source, p_partkey as target from lineitem join part on l_suppkey = p_partkey where l_orderkey <> p_partkey")
def j08_reference_edges(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").cast("string").alias("key"))
    return A.reference_edges(m, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("key")))


@q(f"""with a as (select s_suppkey as qid, {NORM.format("replace(s_name, 'Supplier', 'Customer')")} as n from supplier), b as (select c_custkey as pid, {NORM.format('c_name')} as m from customer)
select qid, (select count(distinct pid) from b where levenshtein(n, m) <= case when length(n) >= 6 and length(m) >= 6 then 2 else 1 end) as hits, 0::bigint as unknown from a""")
def j10_conflict_check(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"))
    return A.conflict_check(s, table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_name").alias("name")))


LIC = """with t as (select doc_id, source, upper(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) as t from documents), l as (select doc_id as item, source, case when regexp_matches(t, 'AGPL|AFFERO') then 'copyleft' when regexp_matches(t, 'LGPL|LESSER GENERAL PUBLIC') then 'weak'
when regexp_matches(t, 'MPL|MOZILLA PUBLIC') then 'weak' when regexp_matches(t, 'GPL|GENERAL PUBLIC LICENSE') then 'copyleft' when regexp_matches(t, 'MIT LICENSE|APACHE|BSD|ISC LICENSE|UNLICENSE|PUBLIC DOMAIN|CC0') then 'permissive' else 'unknown' end as license from t)"""


@q(LIC + " select item, license, case when license = 'unknown' then 'blocked' when license = 'copyleft' and item % 2 = 1 then 'blocked' when item % 2 = 0 then 'excepted' else 'ok' end as verdict from l")
def j29_license_gate(spark, d):
    items = docs(spark, d).select(F.col("doc_id").alias("item"), T.license_class("text").alias("license"))
    return A.license_gate(items, items.filter("item % 2 = 0"))


@q(LIC + " select item, case when item % 10 = 0 then 'undeclared' when item % 10 = 1 then 'unused' else 'relicensed' end as status from l where item % 10 < 2 or (item % 10 = 2 and license <> 'copyleft')")
def j29_license_drift(spark, d):
    items = docs(spark, d).select(F.col("doc_id").alias("item"), T.license_class("text").alias("license"))
    declared = items.filter("item % 10 <> 0").withColumn("license", F.when(F.col("item") % 10 == 2, "copyleft").otherwise(F.col("license")))
    return A.license_drift(declared, items.filter("item % 10 <> 1"))


@q("""select doc_id, md5(text) as h, date '2024-01-01' + cast(doc_id % 30 as int) as modified from documents where doc_id % 4 = 0 and doc_id % 30 between 22 and 30""")
def j25_edited(spark, d):
    x = docs(spark, d).select("doc_id", F.md5("text").alias("h"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("modified"))
    base = docs(spark, d).select("doc_id", F.md5(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("h"))
    return A.edited(x, base, "doc_id", "h", F.lit("2024-01-31").cast("date"))


@q("""with f as (select url_host as k, min(p) as p from (select page_id // 5 as p, regexp_extract(url, '://([^/]*)', 1) as url_host from pages) group by 1), n as (select p, count(*) as n from f group by 1), r as (select distinct page_id // 5 as p from pages where page_id // 5 <= 50),
w as (select r.p as page, coalesce(n, 0) as new_keys, sum(cast(coalesce(n, 0) = 0 as int)) over (order by r.p rows between 1 preceding and current row) = 2 as dry from r left join n using (p)), z as (select *, coalesce(sum(cast(dry as int)) over (order by page rows between unbounded preceding and 1 preceding), 0) as done from w)
select page, new_keys from z where done = 0""")
def k08_collect_pages(spark, d):
    p = table(spark, d, "pages").select(F.floor(F.col("page_id") / 5).cast("long").alias("page"), F.regexp_extract("url", "://([^/]*)", 1).alias("host"))
    return A.collect_pages(p, "page", "host")


@q(f"""select doc_id * 100000 + line_no as id, case when doc_id % 9 = 0 then 'stale' when {NORM.format('line')} like '%' || {NORM.format('left(line, 12)')} || '%' then 'ok' else 'bad' end as state from {LINES} where length(line) > 20""")
def w13_verify_anchors(spark, d):
    rows = X.text_lines(docs(spark, d), "doc_id", "text").filter("length(line) > 20")
    nodes = rows.select((F.col("doc_id") * 100000 + F.col("line_no")).alias("id"), "doc_id", "line_no", F.left("line", F.lit(12)).alias("label"), F.lit("v1").alias("sha"))
    return A.verify_anchors(nodes, rows.select("doc_id", "line_no", "line", F.when(F.col("doc_id") % 9 == 0, "v2").otherwise("v1").alias("sha")))


@q("""select doc_id as id, (doc_id % 5 = 0 or date_diff('day', date '2024-01-01' + cast(doc_id % 30 as int), date '2024-01-20') > 7 or date_diff('day', date '2024-01-01' + cast(doc_id % 30 as int), date '2024-01-20') < 0) as needs_review from documents""")
def g09_node_review(spark, d):
    n = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("source"), F.md5("text").alias("sha"))
    m = docs(spark, d).select(F.col("doc_id").alias("source"), F.md5(F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text"))).alias("sha"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("checked"))
    return A.review_nodes(n, m, F.lit("2024-01-20").cast("date"))


@q(f"""with h as (select doc_id, line_no, line, regexp_matches(line, '^[A-Z][a-z]+\\.$') as head, row_number() over (partition by doc_id, line order by line_no) as nth from {LINES})
select 'document' as kind, 'd' || doc_id as id, cast(null as varchar) as parent from documents union all select 'heading', 'd' || doc_id || ':' || line, 'd' || doc_id from h where head and nth = 1""")
def g01_structure(spark, d):
    rows = X.text_lines(docs(spark, d), "doc_id", "text").filter(F.col("line").rlike(r"^[A-Z][a-z]+\.$"))
    heads = rows.groupBy("doc_id", "line").agg(F.min("line_no").alias("line_no"))
    top = docs(spark, d).select(F.lit("document").alias("kind"), F.concat(F.lit("d"), "doc_id").alias("id"), F.lit(None).cast("string").alias("parent"))
    return top.unionByName(heads.select(F.lit("heading").alias("kind"), F.concat_ws(":", F.concat(F.lit("d"), "doc_id"), "line").alias("id"), F.concat(F.lit("d"), "doc_id").alias("parent")))


@q("""with m as (select source, 'email' as category, unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+')) as v from documents) select source, count(*) as hits from m where v not in (select v from m where source = 'src0') group by 1""")
def a21_history_audit(spark, d):
    m = docs(spark, d).select("source", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+"), F.lit(0))).alias("v"))
    return m.join(m.filter("source = 'src0'").select("v").distinct(), "v", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("hits"))


@q(f"""with {"u as (" + USAGE + ")"} select model, case when model in ('signup') then 'unnamed' when lim is null then 'no_limit' when sum(tokens_in) > lim then 'over' else 'ok' end as warning from u left join (values ('click', 10), ('view', 100000000)) l(model, lim) using (model) group by model, lim""")
def a07_role_warnings(spark, d):
    from evidentia.sources.tables import usage_events

    t = usage_events(table(spark, d, "events")).groupBy("model").agg(F.sum("tokens_in").alias("total"))
    limits = spark.createDataFrame([("click", 10), ("view", 100000000)], "model string, lim long")
    rows = t.join(limits, "model", "left")
    return rows.select("model", F.when(F.col("model") == "signup", "unnamed").when(F.col("lim").isNull(), "no_limit").when(F.col("total") > F.col("lim"), "over").otherwise("ok").alias("warning"))


@q("""with r as (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders), m as (select o_custkey, case when count(*) >= 3 then median(cast(o_orderkey as double)) else 1.0 end as rate from r where rn <= 20 group by 1)
select o_custkey, 1e7::double - c_acctbal >= rate * 100 as can_start from m join customer on c_custkey = o_custkey""")
def a09_can_start(spark, d):
    o = table(spark, d, "orders").withColumn("amount", F.col("o_orderkey").cast("double")).withColumn("one", F.lit(1))
    r = L.blended_rate(o, "o_custkey", "o_orderkey", "amount", "one").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return L.can_start(r, "o_custkey", 1e7, "c_acctbal", 100.0)


@q("""with c as (select conv_id, count(*) filter (role = 'user') as asked, count(*) filter (role = 'assistant') as answered, count(*) filter (role = 'system') as system from conversations group by 1) select conv_id, asked, answered, case when system > 1 then 'many_systems' when asked > answered then 'unanswered' else 'ok' end as finding from c""")
def a12_contract_findings(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(*[F.count_if(F.col("role") == r).alias(n) for r, n in (("user", "asked"), ("assistant", "answered"), ("system", "system"))])
    return c.select("conv_id", "asked", "answered", F.when(F.col("system") > 1, "many_systems").when(F.col("asked") > F.col("answered"), "unanswered").otherwise("ok").alias("finding"))


@q("""select lang, count(*) as n, count(*) filter (source is null) as no_source, count(*) - count(distinct left(text, 40)) as repeated_heads from documents group by 1""")
def a20_audit_index(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source").isNull()).alias("no_source"), (F.count(F.lit(1)) - F.countDistinct(F.left("text", F.lit(40)))).alias("repeated_heads"))


@q("""with r as (select conv_id, max(turn) as top from conversations group by 1), g as (select conv_id % 10 as grp, max_by(conv_id, top * 100000 + conv_id) as root from r group by 1) select grp, conv_id, turn from g join conversations on conv_id = root""")
def k06_latest_family(spark, d):
    c = table(spark, d, "conversations")
    r = c.groupBy("conv_id").agg(F.max("turn").alias("top"))
    g = r.groupBy((F.col("conv_id") % 10).alias("grp")).agg(F.max_by("conv_id", F.col("top") * 100000 + F.col("conv_id")).alias("root"))
    return c.join(g, F.col("conv_id") == F.col("root")).select("grp", "conv_id", "turn")


@q("""select o_orderkey, case when o_totalprice > 200000 and has_r then 'disputed' when has_r then 'returned' when o_orderstatus = 'F' then 'closed' else 'open' end as stage from orders left join (select l_orderkey, bool_or(l_returnflag = 'R') as has_r from lineitem group by 1) on l_orderkey = o_orderkey""")
def p29_stage(spark, d):
    flags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("has_r"))
    rows = table(spark, d, "orders").join(flags, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", F.when((F.col("o_totalprice") > 200000) & F.col("has_r"), "disputed").when(F.col("has_r"), "returned").when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("stage"))


@q("""select o_orderkey, case when l is null then 'unconfirmed' when abs(l - o_totalprice) <= 0.5 * o_totalprice then 'confirmed' else 'mismatch' end as status from orders left join (select l_orderkey, round(sum(l_extendedprice), 2) as l from lineitem group by 1) on l_orderkey = o_orderkey""")
def p26_claim_status(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("l"))
    rows = table(spark, d, "orders").join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", F.when(F.col("l").isNull(), "unconfirmed").when(F.abs(F.col("l") - F.col("o_totalprice")) <= 0.5 * F.col("o_totalprice"), "confirmed").otherwise("mismatch").alias("status"))


@q("""select distinct a.doc_id, b.source as named from documents a join (select distinct source from documents) b on a.source <> b.source and contains(a.text, b.source)""")
def j23_perimeter_leaks(spark, d):
    x = docs(spark, d)
    words = x.select("doc_id", "source", F.explode(F.array_distinct(F.split(T.norm_words("text"), " "))).alias("w"))
    return words.join(x.select(F.col("source").alias("named")).distinct(), F.col("w") == F.col("named")).filter("source <> named").select("doc_id", "named").distinct()


@q("""select p_partkey, case when regexp_matches(p_name, '^[a-z]+ ') then regexp_extract(p_name, '^([a-z]+) ', 1) else p_name end as court, regexp_extract(p_type, '([A-Z]+)$', 1) as category from part""")
def f23_parse_court(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.when(n.rlike("^[a-z]+ "), F.regexp_extract(n, "^([a-z]+) ", 1)).otherwise(n).alias("court"), F.regexp_extract("p_type", "([A-Z]+)$", 1).alias("category"))


@q("""select event_id, '$.message.content[' || i || ']' as path, event_type as name from events, (values (0), (2)) t(i) where i = 0 or event_id % 2 = 0
union all select event_id, '$.last', 'end' from events where event_id % 5 = 0""")
def f27_find_blocks(spark, d):
    """Calls nested in the content of a record, and one beside it."""
    call = F.struct(F.lit("tool_use").alias("type"), F.col("event_type").alias("name"), F.struct("user_id").alias("input"))
    other = F.struct(F.lit("text").alias("type"), F.lit("no call").alias("name"), F.struct("user_id").alias("input"))
    content = F.array(call, other, F.when(F.col("event_id") % 2 == 0, call))
    last = F.when(F.col("event_id") % 5 == 0, F.struct(F.lit("tool_use").alias("type"), F.lit("end").alias("name")))
    rows = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.struct(content.alias("content")).alias("message"), last.alias("last"))).alias("line"))
    return A.find_blocks(rows, "event_id", "line").select("event_id", "path", "name")


@q("select page_id, case when url like '%.html' then 'static' when url like '%?%' then 'query' else 'plain' end as parser, case when url like '%.html' then length(html) else length(url) end as size from pages")
def x03_parse_by_kind(spark, d):
    u = F.col("url")
    kind = F.when(u.endswith(".html"), "static").when(F.contains(u, F.lit("?")), "query").otherwise("plain")
    return table(spark, d, "pages").select("page_id", kind.alias("parser"), F.when(kind == "static", F.length("html")).otherwise(F.length(u)).cast("long").alias("size"))


@q("""select 'inn' as kind, count(*) as n, count(*) filter (cast(right(k, 1) as int) = (2*cast(k[1] as int)+4*cast(k[2] as int)+10*cast(k[3] as int)+3*cast(k[4] as int)+5*cast(k[5] as int)+9*cast(k[6] as int)+4*cast(k[7] as int)+6*cast(k[8] as int)+8*cast(k[9] as int)) % 11 % 10) as valid from (select lpad(cast(o_orderkey as varchar), 10, '0') as k from orders)""")
def f01_inn_pass_rate(spark, d):
    ok = C.inn_valid(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid")).select(F.lit("inn").alias("kind"), "n", "valid")


# --------------------------------------------------------------------- streams
KIND = "case when json_extract_string(props, '$.k') is null then 'torn' when cast(json_extract_string(props, '$.k') as bigint) % 3 = 0 then 'timeout' when cast(json_extract_string(props, '$.k') as bigint) % 3 = 1 then 'refused' else 'other' end"


@q(f"select event_id, user_id, {KIND} as kind from events where event_type = 'error'")
def r02_error_events(spark, d):
    return V.streamed(spark, f"{d}/events.parquet", V.error_events, folder(spark)).select("event_id", "user_id", "kind")


@q(f"select cast(epoch(date_trunc('hour', ts)) as bigint) as hour_s, {KIND} as kind, count(*) as n from events where event_type = 'error' group by 1, 2")
def r02_error_counts(spark, d):
    out = V.streamed(spark, f"{d}/events.parquet", V.error_counts, folder(spark), "complete")
    return out.select(F.unix_timestamp("window_start").alias("hour_s"), "kind", "n")


@q("select event_type, user_id, count(*) as n, count(*) // 10 as alerts from events group by 1, 2")
def r03_running_counts(spark, d):
    return V.streamed(spark, f"{d}/events.parquet", V.running_counts, folder(spark), "complete")


@q("""with m as (select user_id, max_by(event_type, event_id) as t, max(ts) as ts from events where event_type in ('error', 'view') group by 1) select user_id, case when 1706572800 - floor(epoch(ts)) > (case t when 'error' then 3600 else 900 end) then 'unknown' when t = 'error' then 'dead' else 'alive' end as state from m""")
def r04_channel_state(spark, d):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    return V.streamed(spark, f"{d}/events.parquet", lambda e: V.channel_state(e, now), folder(spark), "complete")


# ------------------------------------------------------------------------ jobs
def _spelled(n: str) -> str:
    """SQL of a whole number under a billion in words: nominative, masculine."""
    from evidentia.functions.words import FORMS

    def pick(names, at: str) -> str:
        return f"(['', {', '.join(repr(FORMS[x][0]) for x in names)}])[1 + {at}]"

    def triple(g: str, gender: str) -> str:
        units = pick([f"1{gender}", f"2{gender}", *map(str, range(3, 20))], f"(case when {g} % 100 < 20 then {g} % 100 else {g} % 10 end)")
        return f"concat_ws(' ', nullif({pick([str(x) for x in range(100, 1000, 100)], f'{g} // 100')}, ''), nullif(case when {g} % 100 < 20 then '' else {pick([str(x) for x in range(10, 100, 10)], f'({g} % 100) // 10')} end, ''), nullif({units}, ''))"

    def scale(g: str, name: str) -> str:
        one, many = FORMS[name], FORMS[f"{name}s"]
        return f"case when {g} % 100 between 11 and 14 then '{many[1]}' when {g} % 10 = 1 then '{one[0]}' when {g} % 10 between 2 and 4 then '{one[1]}' else '{many[1]}' end"

    parts = [f"case when {g} > 0 then {triple(g, gender)} || ' ' || {scale(g, name)} end" for g, gender, name in ((f"({n} // 1000000)", "m", "million"), (f"({n} // 1000 % 1000)", "f", "thousand"))]
    return f"case when {n} = 0 then '{FORMS['0'][0]}' else concat_ws(' ', {', '.join(parts)}, nullif({triple(f'({n} % 1000)', 'm')}, '')) end"


@q(f"select o_orderkey, {_spelled('n')} as words from (select o_orderkey, cast(floor(o_totalprice) as bigint) as n from orders)")
def f14_spell_number(spark, d):
    from evidentia.functions.words import spell_number

    return table(spark, d, "orders").select("o_orderkey", spell_number(F.floor("o_totalprice")).alias("words"))


@q("select o_orderkey, cast(o_totalprice as decimal(18, 2)) as amount, cast(o_orderdate as date) as day from orders")
def f12_f18_money_and_dates(spark, d):
    written = F.concat(F.lit("of "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" by order"))
    amount = T.money_parse(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", amount.alias("amount"), T.parse_dates(written)[0].alias("day"))


@q("""select cast(user_id as varchar) as file, case when bool_or(event_type = 'error') then 'corrupt' else 'ok' end as status, case when not bool_or(event_type = 'error') then cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) end as total from events group by user_id, event_type <> 'error' and event_type <> 'view'""".replace("group by user_id, event_type <> 'error' and event_type <> 'view'", "group by user_id"))
def s03_strict_totals(spark, d):
    from evidentia.sources.files import strict_totals

    torn = F.when(F.col("event_type") == "error", F.col("props"))
    return strict_totals(table(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), torn.alias("_corrupt"), F.get_json_object("props", "$.k").cast("long").alias("k")), "k")
