"""Queries of identifiers, dates, feeds and rules, over values and texts that
Spark derives from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidentia.functions import checks as C
from evidentia.functions import text as T
from evidentia.functions.words import check_amount_words, spell_number
from evidentia.operators import html as H
from evidentia.operators import ids as I
from evidentia.operators import rates as R
from evidentia.sources import files
from evidentia.sources.shared import shared_dir
from evidentia.sources.tables import table

QUERIES, SQL = {}, {}


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def weighted(text: str, weights) -> str:
    """SQL of the weighted sum of the first digits of a text."""
    return "(" + " + ".join(f"{w} * cast({text}[{i}] as int)" for i, w in enumerate(weights, 1)) + ")"


def orders(spark, d, *columns):
    return table(spark, d, "orders").select("o_orderkey", *columns)


def number(expr: str, size: int):
    return F.lpad(F.expr(expr).cast("string"), size, "0")


# ------------------------------------------------------------- check digits
@q(f"""with v as (select o_orderkey, lpad(cast(o_orderkey * 7919 % 1000000000 as varchar), 9, '0') as n, o_custkey % 101 as c from orders), s as (select *, {weighted('n', range(9, 0, -1))} % 101 as t, right('0' || cast(c as varchar), 2) as k from v)
select o_orderkey, n || right(k, 2) as value, case when length(n || right(k, 2)) <> 11 or regexp_matches(n || right(k, 2), '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') then false when cast(n as bigint) <= 1001998 then cast(n as bigint) > 0 else (case when t = 100 then 0 else t end) = cast(right(k, 2) as int) end as valid from s""")
def f03_snils(spark, d):
    n = number("o_orderkey * 7919 % 1000000000", 9)
    rows = orders(spark, d, n.alias("n"), F.concat(n, F.right(number("o_custkey % 101", 3), F.lit(2))).alias("value"))
    return rows.select("o_orderkey", "value", C.snils_valid("value").alias("valid"))


@q("select o_orderkey, v as value, regexp_matches(v, '^[0-9]{4}[0-9A-Z]{2}[0-9]{3}$') and substr(v, 5, 2) <> '00' as valid from (select o_orderkey, left(lpad(cast(o_orderkey * 31 as varchar), 6, '0'), 4) || upper(left(o_orderpriority, 1)) || o_orderstatus || right('00' || cast(o_custkey as varchar), 3) as v from orders)")
def f04_kpp(spark, d):
    v = F.concat(F.left(number("o_orderkey * 31", 6), F.lit(4)), F.upper(F.left("o_orderpriority", F.lit(1))), "o_orderstatus", F.right(F.concat(F.lit("00"), F.col("o_custkey").cast("string")), F.lit(3)))
    return orders(spark, d, v.alias("value")).select("o_orderkey", "value", C.kpp_valid("value").alias("valid"))


BIK = "lpad(cast((o_custkey % 30) * 10000000 + o_orderkey % 1000 as varchar), 9, '0')"


@q(f"select o_orderkey, v as value, regexp_matches(v, '^[0-9]{{9}}$') and not regexp_matches(v, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') and left(v, 2) in ('00', '01', '04', '10', '20') as valid from (select o_orderkey, {BIK} as v from orders)")
def f05_bik(spark, d):
    return orders(spark, d, F.expr(BIK.replace("varchar", "string")).alias("value")).select("o_orderkey", "value", C.bik_valid("value").alias("valid"))


ACCOUNT = "(case when o_orderkey % 5 = 0 then '301' else '408' end) || lpad(cast(o_orderkey * 7919 as varchar), 17, '0')"


@q(f"""with v as (select o_orderkey, {ACCOUNT} as a, {BIK} as b from orders), s as (select *, case when a like '301%' then '0' || substr(b, 5, 2) else right(b, 3) end || a as k from v)
select o_orderkey, a as account, b as bik, {weighted('k', [(7, 1, 3)[i % 3] for i in range(23)])} % 10 = 0 as valid from s""")
def f06_account(spark, d):
    rows = orders(spark, d, F.expr(ACCOUNT.replace("varchar", "string")).alias("account"), F.expr(BIK.replace("varchar", "string")).alias("bik"))
    return rows.select("o_orderkey", "account", "bik", C.account_valid("account", "bik").alias("valid"))


def luhn(text: str, size: int) -> str:
    """SQL of the Luhn sum of a text of size digits."""
    parts = []
    for i in range(1, size + 1):
        x = f"cast({text}[{i}] as int)"
        parts.append(x if (size - i) % 2 == 0 else f"(case when {x} > 4 then {x} * 2 - 9 else {x} * 2 end)")
    return "(" + " + ".join(parts) + ")"


@q(f"""with v as (select p_partkey, (['US', 'RU', 'DE'])[p_partkey % 3 + 1] as c, lpad(cast(p_partkey * 7919 as varchar), 10, '0') as n from part), s as (select *, (case c when 'US' then '3028' when 'RU' then '2730' else '1314' end) || n as k from v)
select p_partkey, c || n as value, {luhn('k', 14)} % 10 = 0 as valid from s""")
def f07_isin(spark, d):
    v = F.concat(F.element_at(F.array(F.lit("US"), F.lit("RU"), F.lit("DE")), (F.col("p_partkey") % 3 + 1).cast("int")), number("p_partkey * 7919", 10))
    return table(spark, d, "part").select("p_partkey", v.alias("value")).select("p_partkey", "value", C.isin_valid("value").alias("valid"))


@q("select o_orderkey, v as value, case when length(v) >= 19 then cast(v as hugeint) % 97 = 1 else false end as valid from (select o_orderkey, cast(o_orderkey as varchar) || lpad(cast(o_custkey * 104729 as varchar), 17, '7') as v from orders)")
def f08_mod97(spark, d):
    v = F.concat(F.col("o_orderkey").cast("string"), F.lpad(F.expr("o_custkey * 104729").cast("string"), 17, "7"))
    return orders(spark, d, v.alias("value")).select("o_orderkey", "value", C.mod97_valid("value").alias("valid"))


CADASTRE = "lpad(cast(o_orderkey % 100 as varchar), 2, '0') || ':' || lpad(cast(o_custkey % 100 as varchar), 2, '0') || ':' || lpad(cast(o_orderkey as varchar), 7, '0') || ':' || cast(o_custkey % 7 as varchar)"


@q(f"select o_orderkey, v as value, case when not regexp_matches(v, '^[0-9]{{2}}:[0-9]{{2}}:[0-9]{{6,7}}:[0-9]+$') then 'shape' when cast(left(v, 2) as int) not between 1 and 91 then 'district' when regexp_matches(v, ':0+$') then 'parcel' end as reason from (select o_orderkey, {CADASTRE} as v from orders)")
def f09_cadastre(spark, d):
    return orders(spark, d, F.expr(CADASTRE.replace("varchar", "string")).alias("value")).select("o_orderkey", "value", C.cadastre_check("value").alias("reason"))


@q(f"""select o_orderkey, k as value from (select o_orderkey, lpad(cast(o_custkey * 7919 as varchar), 10, '0') as k from orders where o_orderkey % 3 <> 0) where length(k) = 10 and cast(k[10] as int) <> {weighted('k', C.INN10)} % 11 % 10""")
def f10_labelled_ids(spark, d):
    label = F.when(F.col("o_orderkey") % 3 == 0, "order ").otherwise("ИНН: ")
    rows = orders(spark, d, F.concat(F.lit("by "), label, number("o_custkey * 7919", 10), F.lit(" of the buyer")).alias("t"))
    return I.report_ids(rows, "o_orderkey", "t", "ИНН|INN", "[0-9]{10}", C.inn_valid)


@q(f"""with v as (select o_orderkey % 500 as doc_id, {ACCOUNT} as a, {BIK} as b from orders), k as (select distinct doc_id, b from v where regexp_matches(b, '^[0-9]{{9}}$') and not regexp_matches(b, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') and left(b, 2) in ('00', '01', '04', '10', '20')),
s as (select distinct v.doc_id, v.a, case when a like '301%' then '0' || substr(k.b, 5, 2) else right(k.b, 3) end || a as k from v join k using (doc_id))
select doc_id, a as account from s group by 1, 2 having not bool_or({weighted('k', [(7, 1, 3)[i % 3] for i in range(23)])} % 10 = 0)""")
def j15_accounts_unkeyed(spark, d):
    rows = orders(spark, d, F.expr(ACCOUNT.replace("varchar", "string")).alias("a"), F.expr(BIK.replace("varchar", "string")).alias("b")).withColumn("doc_id", F.expr("o_orderkey % 500"))
    return I.accounts_unkeyed(rows.select("doc_id", F.inline(F.array(F.struct(F.lit("account").alias("kind"), F.col("a").alias("value")), F.struct(F.lit("bik").alias("kind"), F.col("b").alias("value"))))))


# ----------------------------------------------------------- dates and words
@q("select o_orderkey, case when o_orderkey % 4 <> 0 then cast(o_orderdate as date) end as near from orders")
def f19_date_near(spark, d):
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    t = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("№ 77 от "), day)).otherwise(F.concat(F.lit("от 01.02.1990 и от "), day, F.lit(" № 77")))
    return I.date_near(orders(spark, d, t.alias("t")), "o_orderkey", "t", F.lit("№ 77"))


TRANSLIT = "lower(p_name)"
for _a, _b in (("shch", "щ"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"), ("ya", "я"), ("yo", "ё")):
    TRANSLIT = f"replace({TRANSLIT}, '{_a}', '{_b}')"


@q(f"select p_partkey, translate({TRANSLIT}, 'abvgdeziyklmnoprstufhc', 'абвгдезийклмнопрстуфхк') as name from part")
def f21_translit(spark, d):
    return table(spark, d, "part").select("p_partkey", T.translit("p_name").alias("name"))


@q("select o_orderkey, cast(floor(o_totalprice) as bigint) + o_orderkey % 2 as amount, o_orderkey % 2 = 0 as ok from orders")
def f15_amount_words(spark, d):
    n = F.floor("o_totalprice").cast("long")
    spelled = F.when(F.col("o_orderkey") % 3 == 0, spell_number(n, "m", "gen")).otherwise(spell_number(n))
    text = F.concat(F.lit("сумма "), (n + F.col("o_orderkey") % 2).cast("string"), F.lit(" ("), spelled, F.lit(" рублей)"))
    return check_amount_words(orders(spark, d, text.alias("t")), "o_orderkey", "t").select("o_orderkey", "amount", "ok")


@q("""with s as (select distinct cast(o_orderdate as date) as key from orders), c as (select key, cast(key - interval 30 day as date) as older, date_part('month', key) % 2 = 0 as marked from s)
select c.key, c.older from c join s on c.older = s.key where not marked""")
def w11_unmarked_supersedes(spark, d):
    key = F.col("o_orderdate").cast("date")
    older = F.date_sub("key", 30)
    s = table(spark, d, "orders").select(key.alias("key")).distinct()
    return I.unmarked_supersedes(s.select("key", F.concat(F.lit("this supersedes the rule of "), older.cast("string")).alias("body"), F.when(F.month("key") % 2 == 0, F.array(older)).otherwise(F.array().cast("array<date>")).alias("marked")))


# ------------------------------------------------------------ feeds and files
@q("select distinct cast(o_orderdate as date) as dt, cast(round(date_part('day', o_orderdate) / 4, 2) as decimal(9, 4)) as rate from orders")
def s04_parse_rates(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("dt")).distinct()
    rate = F.replace(F.round(F.day("dt") / 4, 2).cast("string"), F.lit("."), F.lit(","))
    return R.parse_rates(x.select(F.concat(F.lit("<KR><DT>"), F.col("dt").cast("string"), F.lit("T00:00:00</DT><Rate>"), rate, F.lit("</Rate></KR>")).alias("xml")), "xml")


@q("""with y as (select distinct cast(date_part('year', o_orderdate) as int) as y from orders), x as (select y, unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), interval 1 day)) as d from y)
select cast(d as date) as d, date_part('doy', d) % 5 not in (1, 4) as is_working from x where y % 2 = 0""")
def s05_calendar_from_mask(spark, d):
    y = table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    size = F.when(F.col("year") % 2 == 0, F.dayofyear(F.make_date("year", F.lit(12), F.lit(31)))).otherwise(100)
    return R.calendar_from_mask(y.select("year", F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: (i % 5).cast("string")), "").alias("mask")))


@q("""with m as (select distinct cast(date_part('year', o_orderdate) as int) as y, cast(date_part('month', o_orderdate) as int) as m from orders) select make_date(y, m, k) as d from m, (values (1), (9), (20)) t(k)""")
def s06_calendar_from_json(spark, d):
    m = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    months = m.groupBy("year").agg(F.collect_list(F.struct("month", F.lit("1,3*,9+,20").alias("days"))).alias("months"))
    return R.calendar_from_json(months.select(F.to_json(F.struct("year", "months")).alias("json")))


@q("""select cast(o_custkey as bigint) as o_custkey, cast(row_number() over (partition by o_custkey order by o_orderkey) as bigint) as op, cast(o_orderdate as date) as day, cast(o_totalprice as decimal(18, 2)) as amount from orders""")
def s07_statement(spark, d):
    lines = table(spark, d, "orders").select("o_custkey", F.posexplode(F.array(F.concat(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" +"), F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")), F.lit(" transfer")), F.lit("Page 1 of 2"), F.concat(F.lit("by order "), F.col("o_orderkey").cast("string")))).alias("k", "line"), (F.col("o_orderkey") * 3).alias("p"))
    ops = files.parse_statement(lines.select("o_custkey", (F.col("p") + F.col("k")).alias("pos"), "line"), "o_custkey", "pos", "line")
    return ops.select(F.col("o_custkey").cast("long").alias("o_custkey"), F.col("op").cast("long").alias("op"), "day", "amount")


@q("""select doc_id, field, cast(ord as int) as ord, value from (select doc_id, 'lang' as field, 0 as ord, lang as value from documents where doc_id % 3 <> 0 union all select doc_id, 'tags', 0, source from documents where doc_id % 3 <> 0 union all select doc_id, 'tags', 1, cast(n_chars as varchar) from documents where doc_id % 3 <> 0)""")
def s10_front_matter(spark, d):
    block = F.concat(F.lit("\ntags:\n  - \""), "source", F.lit("\"\n  - "), F.col("n_chars").cast("string"), F.lit("\n---\n"))
    inline = F.concat(F.lit("\ntags: ["), "source", F.lit(", '"), F.col("n_chars").cast("string"), F.lit("']\n---\n"))
    head = F.concat(F.lit("---\nlang: '"), "lang", F.lit("'"), F.when(F.col("doc_id") % 2 == 0, block).otherwise(inline))
    x = table(spark, d, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "").otherwise(head), "text").alias("text"))
    return H.front_matter(x, "doc_id", "text").select("doc_id", "field", F.col("ord").cast("int").alias("ord"), F.nullif("value", F.lit("")).alias("value"))


@q("select lang, count(*) as n_files from (select distinct lang from documents) group by 1")
def s01_scan_files(spark, d):
    """Texts written as files by language, scanned; counted are languages with a
    hashed file of text."""
    path = f"{shared_dir(spark)}/evidentia/files-{uuid.uuid4().hex}"
    table(spark, d, "documents").select("lang", F.regexp_replace("text", "\n", " ").alias("value")).write.partitionBy("lang").text(path)
    found = files.scan_files(spark, path).filter("route = 'other' and ext = 'txt' and length(sha16) = 16 and size > 0")
    return found.select(F.regexp_extract("path", r"lang=([^/]*)/", 1).alias("lang")).distinct().select("lang", F.lit(1).cast("long").alias("n_files"))


@q("select source, count(*) as n from documents group by 1")
def s12_publish_snapshot(spark, d):
    """Counts by source published once, not again with the same fingerprint, and
    read through the pointer."""
    path = f"{shared_dir(spark)}/evidentia/snapshot-{uuid.uuid4().hex}"
    counts = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if not files.publish_snapshot(counts, path, "a") or files.publish_snapshot(counts, path, "a"):
        raise RuntimeError("a snapshot is published once for each fingerprint")
    return files.read_snapshot(spark, path)


# ------------------------------------------------------------------- journals
@q("""with e as (select user_id as provider, event_type as limit_id, ts, event_id as ord, ts + interval 3 day as reset_at, value is null as corrupt from events), n as (select timestamp '2024-01-31 00:00:00' as now),
r as (select *, row_number() over (partition by provider, limit_id order by ts desc, ord desc) as rn from e), l as (select * from r where rn = 1), b as (select r.provider, r.limit_id, max_by(r.reset_at, (r.ts, r.ord)) as old from r where rn > 1 and not corrupt group by 1, 2)
select cast(l.provider as varchar) as provider, l.limit_id, case when corrupt or date_diff('day', cast(ts as date), cast(now as date)) > 7 or ts > now or reset_at <= now then 'unknown' when old <= now and old < reset_at then 'reset' else 'running' end as state from l left join b using (provider, limit_id), n""")
def r06_quota_resets(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    log = e.select(F.col("user_id").cast("string").alias("provider"), F.col("event_type").alias("limit_id"), "ts", F.col("event_id").alias("ord"), (F.col("ts") + F.expr("interval 3 days")).alias("reset_at"), F.col("value").isNull().alias("corrupt"))
    return I.quota_resets(log, F.lit("2024-01-31 00:00:00").cast("timestamp"))


@q("""select p_partkey % 1000 as k, case when p_partkey % 11 = 0 then 'unreadable' when p_partkey % 7 = 0 then 'unknown kind' when p_partkey % 5 = 0 then 'no terms' when c > 1 then 'duplicate id' end as problem, count(*) as n
from (select p_partkey, case when p_partkey % 11 <> 0 then count(case when p_partkey % 11 <> 0 then 1 end) over (partition by p_partkey % 1000) end as c from part) group by 1, 2""".replace("p_partkey % 1000 as k, case", "case when p_partkey % 11 <> 0 then 'r' || (p_partkey % 1000) end as rule_id, case"))
def x01_load_rules(spark, d):
    key = F.col("p_partkey")
    rule = F.struct(F.concat(F.lit("r"), key % 1000).alias("rule_id"), F.when(key % 7 == 0, "maybe").otherwise("absent").alias("expect"), F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name")).alias("terms"))
    lines = table(spark, d, "part").select(F.when(key % 11 == 0, "{torn").otherwise(F.to_json(rule)).alias("value"))
    return I.load_rules(lines).groupBy("rule_id", "problem").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ validation
def _numbered(spark, d):
    text = F.concat(F.lit("INN "), number("o_custkey * 7919", 10), F.lit(", OGRN "), number("o_orderkey * 104729", 13), F.lit("; card "), number("o_orderkey * 7919", 16), F.lit("."))
    return I.judged_ids(orders(spark, d, F.col("o_orderstatus").alias("source"), text.alias("t")), ["o_orderkey", "source"], "t")


JUDGED = f"""with v as (select o_orderkey, o_orderstatus as source, lpad(cast(o_custkey * 7919 as varchar), 10, '0') as i, lpad(cast(o_orderkey * 104729 as varchar), 13, '0') as o, lpad(cast(o_orderkey * 7919 as varchar), 16, '0') as c from orders),
j as (select o_orderkey, source, 'inn' as kind, i as value, cast(i[10] as int) = {weighted('i', C.INN10)} % 11 % 10 as valid from v union all select o_orderkey, source, 'ogrn', o, cast(left(o, 12) as bigint) % 11 % 10 = cast(right(o, 1) as int) from v union all select o_orderkey, source, 'card', c, {luhn('c', 16)} % 10 = 0 from v)"""


@q(f"{JUDGED} select o_orderkey, source, kind, value from j where not valid")
def id_findings(spark, d):
    return _numbered(spark, d).filter("not valid").select("o_orderkey", "source", "kind", "value")


@q(f"{JUDGED} select source, kind, count(*) as n, count(*) filter (valid) as valid_n from j group by 1, 2")
def id_rates(spark, d):
    return I.id_rates(_numbered(spark, d), "source")


@q("""with k as (select l_orderkey, max(l_linenumber) as n, list_sort(list(distinct cast(l_linenumber as int)) filter (l_linenumber <> 2)) as d from lineitem group by 1)
select l_orderkey, array_to_string(list_filter(range(1, list_max(d) + 1), lambda x: not list_contains(d, x)), ',') as gaps, array_to_string(list_filter(d, lambda x: x <> 1 and not (x >= 3 and x <= n - 1 and n >= 4) and x <> 5), ',') as unmentioned from k where len(d) > 0""")
def w10_attachments(spark, d):
    """Numbers declared without 2; the text names 1, the range from 3 to the last but one, and 5."""
    n = F.max("l_linenumber")
    k = table(spark, d, "lineitem").groupBy("l_orderkey").agg(n.alias("n"), F.array_sort(F.collect_list(F.when(F.col("l_linenumber") != 2, F.col("l_linenumber").cast("int")))).alias("d")).filter("size(d) > 0")
    text = F.concat(F.lit("см. приложение № 1; Приложения 3 — "), (F.col("n") - 1).cast("string"), F.lit(", 5 к договору"))
    found = I.numbering_check(k.select("l_orderkey", "d", text.alias("t")), "l_orderkey", "d", "t")
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("l_orderkey", join("gaps").alias("gaps"), join("unmentioned").alias("unmentioned"))
