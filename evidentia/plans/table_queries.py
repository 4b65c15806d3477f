"""Queries over the star schema and the event log, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import graph as G
from evidentia.operators import ledger as L
from evidentia.operators import rates as R
from evidentia.operators import recon as K
from evidentia.operators import search as S
from evidentia.operators import text as X
from evidentia.plans.text_queries import NORM, NUMBERS_SQL, docs
from evidentia.sources.tables import USAGE, table, usage_events

QUERIES, SQL = {}, {}


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def n_rows(alias="n"):
    return F.count(F.lit(1)).alias(alias)


# ------------------------------------------------------------- reconciliation
def numbers(spark, d, even: bool):
    rows = docs(spark, d).filter(f"doc_id % 2 = {0 if even else 1}").select((F.col("doc_id") / 2).cast("long").alias("pair"), "text")
    return X.number_tokens(rows, "pair", "text")


@q(f"""with a as (select doc_id // 2 as pair, token, n from {NUMBERS_SQL} where doc_id % 2 = 0), b as (select doc_id // 2 as pair, token, n from {NUMBERS_SQL} where doc_id % 2 = 1)
select coalesce(a.pair, b.pair) as pair, coalesce(a.token, b.token) as token, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) as only_a, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) as only_b, least(coalesce(a.n, 0), coalesce(b.n, 0)) as common
from a full join b on a.pair = b.pair and a.token = b.token""")
def j05_crosscheck(spark, d):
    return K.crosscheck(numbers(spark, d, True), numbers(spark, d, False), ["pair", "token"])


@q(f"""with t as (select source, token from {NUMBERS_SQL} join documents using (doc_id) where length(regexp_replace(token, '[^0-9]', '', 'g')) >= 4)
select token, case when token in (select token from t where source = 'src3') then 'low_trust' else 'missing' end as class from (select distinct token from t where source in ('src1', 'src2') and token not in (select token from t where source not in ('src1', 'src2', 'src3')))""")
def j06_orphan_numbers(spark, d):
    t = X.number_tokens(docs(spark, d), "doc_id", "text", 4).join(docs(spark, d).select("doc_id", "source"), "doc_id")
    return K.orphans(t.filter("source in ('src1', 'src2')"), t.filter("source not in ('src1', 'src2', 'src3')"), t.filter("source = 'src3'"), "token")


@q("""select coalesce(i.k, x.k, r.k) as key, case when i.k is null then 'ghost' when x.k is null and r.k is null then 'missing_in_both' when x.k is null then 'missing_in_index' when r.k is null then 'missing_in_register' else 'ok' end as status
from (select distinct o_custkey as k from orders) i full join (select c_custkey as k from customer where c_custkey % 5 <> 0) x on i.k = x.k full join (select c_custkey as k from customer where c_custkey % 3 <> 0) r on r.k = coalesce(i.k, x.k)""")
def j11_reconcile(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return K.reconcile(c.filter("key % 5 <> 0"), c.filter("key % 3 <> 0"), table(spark, d, "orders").select(F.col("o_custkey").alias("key")), "key")


VERSIONS = "old as (select doc_id, md5(text) as h from documents where doc_id % 7 <> 0), new as (select doc_id, md5(case when doc_id % 5 = 0 then text || '!' else text end) as h from documents where doc_id % 11 <> 0)"


def versions(spark, d):
    x = docs(spark, d)
    old = x.filter("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("h"))
    new = x.filter("doc_id % 11 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return old, new


@q(f"""with {VERSIONS} select coalesce(old.doc_id, new.doc_id) as doc_id, case when old.doc_id is null then 'added' when new.doc_id is null then 'removed' when old.h is distinct from new.h then 'changed' else 'same' end as status from old full join new on old.doc_id = new.doc_id""")
def j12_manifest_drift(spark, d):
    return K.drift(*versions(spark, d), "doc_id", "h")


@q(f"""with {VERSIONS}, b as (select coalesce(old.doc_id, new.doc_id) as doc_id, old.h as o, new.h as n from old full join new on old.doc_id = new.doc_id)
select doc_id, o as value, cast(null as date) as opened, cast(null as date) as closed from b where o = n union all select doc_id, o, null, date '2024-06-01' from b where o is not null and o is distinct from n
union all select doc_id, n, date '2024-06-01', null from b where n is not null and o is distinct from n""")
def s14_scd2(spark, d):
    return K.scd2(*versions(spark, d), "doc_id", "h", "2024-06-01")


@q(f"with {VERSIONS} select new.* from new anti join old on old.doc_id = new.doc_id and old.h = new.h")
def s13_new_or_changed(spark, d):
    old, new = versions(spark, d)
    return K.new_or_changed(new, old, ["doc_id", "h"])


@q(f"with {VERSIONS} select doc_id, case when old.doc_id is null then 'unreachable' when new.h = old.h then 'unchanged' else 'changed' end as status from new left join old using (doc_id)")
def j28_edition_status(spark, d):
    old, new = versions(spark, d)
    rows = new.join(old.withColumnRenamed("h", "o"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("o").isNull(), "unreachable").when(F.col("o") == F.col("h"), "unchanged").otherwise("changed").alias("status"))


@q("""with t as (select source, doc_id, unnest(regexp_extract_all(text, '[0-9]{4,}')) as tok from documents), i as (select distinct tok from t where source in ('src1', 'src2', 'src3', 'src4', 'src5'))
select distinct tok from t anti join i using (tok)""")
def j13_not_indexed(spark, d):
    t = docs(spark, d).select("source", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{4,}"), F.lit(0))).alias("tok"))
    return K.new_or_changed(t.select("tok").distinct(), t.filter("source in ('src1', 'src2', 'src3', 'src4', 'src5')"), ["tok"])


@q("""with t as (select distinct source, doc_id, unnest(regexp_extract_all(text, '[0-9]{4,}')) as tok from documents), own as (select distinct source, tok from t where doc_id % 20 = 0)
select distinct source, tok from t anti join own using (source, tok)""")
def j14_exclude_own(spark, d):
    t = docs(spark, d).select("source", "doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{4,}"), F.lit(0))).alias("tok"))
    return K.new_or_changed(t.select("source", "tok").distinct(), t.filter("doc_id % 20 = 0"), ["source", "tok"])


@q("""with p as (select doc_id // 2 as pair, doc_id % 2 as side, unnest(string_split(text, chr(10))) as p, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
h as (select pair, side, pos, md5(p) as h, row_number() over (partition by pair, side, md5(p) order by pos) as nth from p),
k as (select x.*, y.h is not null as kept from h x left join h y on x.pair = y.pair and x.h = y.h and x.nth = y.nth and x.side <> y.side), g as (select *, sum(cast(kept as int)) over (partition by pair, side order by pos) as gap from k),
m as (select pair, side, gap, row_number() over (partition by pair, side, gap order by pos) as i from g where not kept)
select pair, status, count(*) as n from (select pair, case when a.side is not null and b.side is not null then 'rewritten' when a.side is not null then 'removed' else 'added' end as status from (select * from m where side = 0) a full join (select * from m where side = 1) b using (pair, gap, i) union all select pair, 'kept' from k where kept and side = 0) group by 1, 2""")
def j20_paragraph_diff(spark, d):
    x = docs(spark, d).select((F.col("doc_id") / 2).cast("long").alias("pair"), "doc_id", "text")
    return K.paragraph_diff(x.filter("doc_id % 2 = 0"), x.filter("doc_id % 2 = 1"), "pair", "text")


@q("""with l as (select doc_id, text, string_split(text, chr(10)) as p from documents), m as (select doc_id, p, len(p) as n from l where len(list_distinct(p)) = len(p) and len(p) >= 2)
select doc_id, 'kept' as status, n - 1 as n from m union all select doc_id, 'removed', 1 from m union all select doc_id, 'added', 1 from m""")
def j20_moved_paragraph(spark, d):
    """Texts of different paragraphs whose first one is moved to their end."""
    x = docs(spark, d).select("doc_id", "text", F.split("text", "\n", -1).alias("p")).filter((F.size(F.array_distinct("p")) == F.size("p")) & (F.size("p") >= 2))
    moved = F.array_join(F.concat(F.slice("p", 2, F.size("p") - 1), F.slice("p", 1, 1)), "\n")
    found = K.sequence_diff(x, x.select("doc_id", moved.alias("text")), "doc_id", "text")
    return found.groupBy("doc_id", "status").agg(F.count(F.lit(1)).alias("n"))


@q("""with t as (select doc_id, text, lag(text) over (order by doc_id) as b from documents where doc_id % 2 >= 0), m as (select doc_id, text, b, list_filter(string_split(text, chr(10)), lambda p: length(p) >= 60 and not contains(b, p)) as miss from t where b is not null)
select doc_id, len(miss) = 0 and length(b) / nullif(length(text), 0) between 0.7 and 1.4 and lost = 0 as ok, left(miss[1], 40) as first_missing, lost as numbers_missing
from (select *, len(list_filter(list_distinct(regexp_extract_all(text, '[0-9]{5,}')), lambda x: not list_contains(regexp_extract_all(b, '[0-9]{5,}'), x))) as lost from m) where doc_id - 1 in (select doc_id from documents)""")
def j19_derived_ok(spark, d):
    x = docs(spark, d).select("doc_id", "text")
    return K.contained_in(x, x.select((F.col("doc_id") + 1).alias("doc_id"), "text"), "doc_id", "text")


@q("""with j as (select doc_id, md5(case when quality = 1 then text else '' end) as sha, toxic as ord, quality = 1 as ready from labels join documents using (doc_id)),
s as (select d.doc_id, max_by(ready, ord) filter (j.sha = md5(text)) as last, bool_or(j.sha = md5(text) and ready) as ever, bool_or(j.sha <> md5(text) and ready) as other, bool_or(j.sha = md5(text)) as own from documents d left join j using (doc_id) group by d.doc_id)
select doc_id, case when own and last then 'approved' when own and ever then 'revoked' when own then 'rejected' when other then 'other_revision' else 'none' end as state from s""")
def j21_approval_state(spark, d):
    x = docs(spark, d).select("doc_id", "text", F.md5("text").alias("sha"))
    j = table(spark, d, "labels").join(x.select("doc_id", "text"), "doc_id")
    j = j.select("doc_id", F.md5(F.when(F.col("quality") == 1, F.col("text")).otherwise("")).alias("sha"), F.col("toxic").alias("ord"), (F.col("quality") == 1).alias("ready"))
    return K.approval_state(x.select("doc_id", "sha"), j, "doc_id")


@q("""with a as (select user_id, count(*) as v from events group by 1), b as (select user_id, count(*) filter (event_type <> 'error') as v from events group by 1)
select user_id, case when b.v = 0 then a.v = 0 else abs(a.v - b.v) / abs(b.v) <= 0.25 end as agrees from a join b using (user_id)""")
def j22_agree(spark, d):
    e = table(spark, d, "events")
    return K.agree(e.groupBy("user_id").agg(n_rows("v")), e.groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("v")), "user_id", "v", 0.25)


@q("""select user_id, max(ts) as last_try, max(ts) filter (event_type <> 'error') as last_success, coalesce(max(ts) > max(ts) filter (event_type <> 'error'), true) as stale from events group by 1""")
def j27_last_known_good(spark, d):
    return K.last_known_good(table(spark, d, "events"), "user_id", "ts", F.col("event_type") != "error")


@q("select user_id, max_by(event_type, event_id) as event_type from events group by 1")
def w15_effective_state(spark, d):
    return K.effective_state(table(spark, d, "events"), "user_id", "event_type", "event_id")


@q("""with s as (select l_orderkey, l_linenumber, l_partkey % 7 as slot from lineitem), i as (select distinct l_orderkey, l_suppkey % 7 as slot from lineitem), t as (select l_orderkey from s group by l_orderkey, slot having count(*) > 1), u as (select distinct l_orderkey, slot from s)
select l_orderkey, slot, case when i.slot is null then 'missing' when u.slot is null then 'extra' else 'ok' end as status from u full join i using (l_orderkey, slot) where l_orderkey not in (select l_orderkey from t)
union all select distinct l_orderkey, cast(null as bigint), 'duplicate' from t""".replace("i.slot is null then 'missing' when u.slot is null", "i.one is null then 'missing' when u.one is null").replace("i as (select distinct l_orderkey, l_suppkey % 7 as slot", "i as (select distinct l_orderkey, l_suppkey % 7 as slot, 1 as one").replace("u as (select distinct l_orderkey, slot from s)", "u as (select distinct l_orderkey, slot, 1 as one from s)"))
def j26_package_check(spark, d):
    x = table(spark, d, "lineitem")
    return K.package_check(x.select("l_orderkey", (F.col("l_partkey") % 7).alias("slot")), x.select("l_orderkey", (F.col("l_suppkey") % 7).alias("slot")), "l_orderkey", "slot")


@q(f"select token, max(n) as n from (select source, token, sum(n)::bigint as n from {NUMBERS_SQL} join documents using (doc_id) group by all) group by token")
def u02_bag_union(spark, d):
    t = X.number_tokens(docs(spark, d), "doc_id", "text").join(docs(spark, d).select("doc_id", "source"), "doc_id")
    return K.bag_union(t.groupBy("source", "token").agg(F.sum("n").alias("n")), "token")


@q("select w from (select unnest(string_split(text, ' ')) as w from documents where source = 'src1' except all select unnest(string_split(text, ' ')) from documents where source = 'src2')")
def u01_bag_diff(spark, d):
    w = docs(spark, d).select("source", F.explode(F.split("text", " ", -1)).alias("w"))
    return K.bag_diff(w.filter("source = 'src1'").select("w"), w.filter("source = 'src2'").select("w"))


@q("""select url, page_id from pages where page_id % 3 <> 0 union all select url, page_id from pages where page_id % 3 = 0 and url not in (select url from pages where page_id % 3 <> 0)""")
def u03_supplement(spark, d):
    p = table(spark, d, "pages").select("url", "page_id")
    # Several pages may share a url, each with its own page_id.
    return K.supplement(p.filter("page_id % 3 <> 0"), p.filter("page_id % 3 = 0"), "url", "page_id")


@q("""select 'page_id' as column_name, cast(page_id as varchar) as value, count(*) as n from pages group by page_id having count(*) > 1 union all select 'url', url, count(*) from pages group by url having count(*) > 1 union all select 'html', html, count(*) from pages group by html having count(*) > 1""")
def u04_registry_union(spark, d):
    return K.uniqueness_violations(table(spark, d, "pages"), ["page_id", "url", "html"])


@q("""select coalesce(a.k, b.k) as key, case when a.k is not null then 'a' else 'b' end as side from (select c_custkey as k from customer where c_custkey % 2 = 0) a full join (select distinct o_custkey as k from orders) b on a.k = b.k where a.k is null or b.k is null""")
def u05_symdiff(spark, d):
    return K.symdiff(table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key")), table(spark, d, "orders").select(F.col("o_custkey").alias("key")), "key")


# -------------------------------------------------------------- money and time
RATES = [("1995-01-01", 10.0), ("1996-03-15", 12.5), ("1997-07-01", 9.0), ("1998-11-20", 21.0), ("2000-02-29", 7.25)]
RATE_ROWS = ", ".join(f"(date '{a}', {b}::double)" for a, b in RATES)
IV = f"iv as (select dt as since, lead(dt) over (order by dt) as until, rate from (values {RATE_ROWS}) r(dt, rate))"


def rates(spark):
    return spark.createDataFrame(RATES, "dt string, rate double").withColumn("dt", F.to_date("dt"))


@q(f"with {IV} select o_orderkey, cast(o_orderdate as date) as d, rate from orders asof join iv on cast(o_orderdate as date) >= since")
def j01_asof_rate(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return R.asof_rate(o, "d", rates(spark))


@q(f"""with {IV}, deb as (select o_orderkey as id, o_totalprice as amount, cast(o_orderdate as date) as since, cast(o_orderdate as date) + 400 as until from orders),
o as (select id, amount, greatest(deb.since, iv.since) as a, least(deb.until, coalesce(iv.until - 1, deb.until)) as b, rate from deb join iv on deb.until >= iv.since and (iv.until is null or deb.since < iv.until)),
y as (select *, unnest(range(year(a), year(b) + 1)) as y from o), z as (select *, greatest(a, make_date(cast(y as int), 1, 1)) as from_d, least(b, make_date(cast(y as int), 12, 31)) as to_d from y)
select id, from_d, to_d, cast(to_d - from_d + 1 as int) as days, rate, amount * rate / 100 * (to_d - from_d + 1) / dayofyear(make_date(cast(y as int), 12, 31)) as interest from z""")
def j02_accrue(spark, d):
    day = F.to_date("o_orderdate")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), day.alias("since"), F.date_add(day, 400).alias("until"))
    return R.accrue(o, rates(spark), F.dayofyear(F.make_date("y", F.lit(12), F.lit(31))))


TIERS = [(100000.0, 4000.0, 0.0, 0.0, None), (300000.0, 4000.0, 0.03, 100000.0, None), (None, 10000.0, 0.005, 300000.0, 12000.0)]


@q("""with p as (select o_orderkey, cast(o_totalprice as decimal(18, 2)) as p from orders),
v as (select o_orderkey, cast(1000000 * case when p <= 0 then null when p <= 100000 then 4000.0 when p <= 300000 then 4000.0 + (p - 100000.0) * 0.03 else least(10000.0 + (p - 300000.0) * 0.005, 12000.0) end as bigint) as v from p)
select o_orderkey, cast((v // 10000 + case when v % 10000 > 5000 or (v % 10000 = 5000 and (v // 10000) % 2 = 1) then 1 else 0 end) / 100 as decimal(18, 2)) as duty from v""")
def j03_tiered_duty(spark, d):
    tiers = spark.createDataFrame(TIERS, "upto double, base double, pct double, over double, cap double")
    return R.tiered_duty(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", tiers).select("o_orderkey", "duty")


FEES = [("1-URGENT", "O", 3000), ("1-URGENT", "F", 15000), ("2-HIGH", "O", 5000), ("5-LOW", "F", 150)]


@q(f"""select o_orderkey, fee, case when fee is null then 'rate missing' else 'ok' end as status from orders left join (values {', '.join(f"('{a}', '{b}', {c}::bigint)" for a, b, c in FEES)}) f(o_orderpriority, o_orderstatus, fee) using (o_orderpriority, o_orderstatus)""")
def j04_flat_duty(spark, d):
    fees = spark.createDataFrame(FEES, "o_orderpriority string, o_orderstatus string, fee long")
    return R.flat_duty(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), fees, ["o_orderpriority", "o_orderstatus"]).select("o_orderkey", "fee", "status")


@q(f"""with {IV}, x as (select unnest(generate_series((select min(cast(o_orderdate as date)) from orders), (select max(cast(o_orderdate as date)) from orders), interval 1 day))::date as dt)
select dt, rate, (select count(*) from orders where cast(o_orderdate as date) = dt) as orders_n from x asof join iv on dt >= since""")
def w01_fill_daily(spark, d):
    per_day = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("dt")).agg(n_rows("orders_n"))
    ends = per_day.agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("dt"))
    filled = R.asof_rate(days, "dt", rates(spark))
    return filled.join(per_day, "dt", "left").select("dt", "rate", F.coalesce("orders_n", F.lit(0)).alias("orders_n"))


@q("""with f as (select *, case when event_type is not distinct from lag(event_type) over w and row_number() over w > 1 then 0 else 1 end as new from events window w as (partition by user_id order by event_id)),
i as (select *, cast(sum(new) over (partition by user_id order by event_id) as bigint) as island from f)
select user_id, island, event_type, min(event_id) as first, max(event_id) as last, count(*) as n from i group by 1, 2, 3""")
def w02_islands(spark, d):
    return R.islands(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


HOLIDAYS = ["01-01", "01-02", "05-01", "12-25"]
CAL = f"cal as (select d, not (dayofweek(d) in (0, 6) or strftime(d, '%m-%d') in ({', '.join(repr(h) for h in HOLIDAYS)})) as is_working from (select unnest(generate_series(date '1994-12-01', date '2002-12-31', interval 1 day))::date as d))"


def calendar(spark):
    return R.calendar_fallback(spark, "1994-12-01", "2002-12-31", HOLIDAYS)


@q(f"with {CAL}, g as (select year(d) as y, is_working, count(*) as n from cal group by 1, 2) select y, is_working, n, (select count(*) from orders where year(o_orderdate) = y) as orders_n from g")
def s15_calendar(spark, d):
    per_year = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(n_rows("orders_n"))
    c = calendar(spark).groupBy(F.year("d").cast("long").alias("y"), "is_working").agg(n_rows())
    return c.join(per_year, "y", "left").select("y", "is_working", "n", F.coalesce("orders_n", F.lit(0)).alias("orders_n"))


@q(f"""with {CAL}, w as (select *, sum(cast(is_working as int)) over (order by d) as s from cal) select o_orderkey, e.d as deadline from orders join w on w.d = cast(o_orderdate as date) left join (select * from w where is_working) e on e.s = w.s + 5""")
def w09_deadline(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("s"))
    return R.working_deadline(o, "s", 5, calendar(spark)).select("o_orderkey", "deadline")


@q(f"""with {CAL} select o_orderkey, cast(cast(o_orderdate as date) + interval 1 month as date) as raw_end, (select min(d) from cal where is_working and d >= cast(cast(o_orderdate as date) + interval 1 month as date)) as deadline from orders""".replace("select o_orderkey, cast", "select o_orderkey, cast", 1))
def term_table(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), 1).alias("raw_end"))
    return R.moved_deadline(o, "raw_end", calendar(spark))


@q(f"""with {CAL}, b as (select d, dayofweek(d) <> 0 as is_working from cal) select cal.d as d, cal.is_working and b.is_working as is_working, cal.is_working <> b.is_working as conflict, (select count(*) from orders where cast(o_orderdate as date) = cal.d) as orders_n from cal join b using (d)""")
def a25_merge_calendars(spark, d):
    a = calendar(spark)
    per_day = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(n_rows("orders_n"))
    return R.merge_calendars(a, a.select("d", (F.dayofweek("d") != 1).alias("is_working"))).join(per_day, "d", "left").select("d", "is_working", "conflict", F.coalesce("orders_n", F.lit(0)).alias("orders_n"))


# ---------------------------------------------------------------------- ledger
U = f"u as ({USAGE}), st as (select *, coalesce(last_value(signal ignore nulls) over (partition by stream order by line rows unbounded preceding), 0) as step from u)"


def usage(spark, d):
    return L.sticky_step(usage_events(table(spark, d, "events")))


@q(f"with {U} select stream, line, step from st")
def w04_sticky_step(spark, d):
    return usage(spark, d).select("stream", "line", "step")


@q("select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1")
def w03_dedup_last(spark, d):
    return L.dedup_last(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


SUMS = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in L.COUNTERS)


@q(f"with {U} select 'step' as cut, cast(step as varchar) as key, {SUMS}, count(*) as calls from st group by step union all select 'stream', cast(stream as varchar), {SUMS}, count(*) from st group by stream union all select 'model', model, {SUMS}, count(*) from st group by model union all select 'total', '', {SUMS}, count(*) from st")
def a01_usage_cuts(spark, d):
    return L.usage_cuts(usage(spark, d))


PRICES = [("click", 3.0, 15.0), ("view", 1.0, 5.0), ("purchase", 15.0, 75.0)]


@q(f"""with {U}, p as (select * from (values {', '.join(f"('{a}', {b}::double, {c}::double)" for a, b, c in PRICES)}) p(model, pi, po))
select case when pi is null then 'unknown' else model end as model, count(*) as calls, round(sum((tokens_in * coalesce(pi, 15.0) + tokens_out * coalesce(po, 75.0)) / 1e6), 6) as cost from u left join p using (model) group by 1""")
def j24_price_usage(spark, d):
    return L.price_usage(usage_events(table(spark, d, "events")), spark.createDataFrame(PRICES, "model string, price_in double, price_out double")).withColumn("cost", F.round("cost", 6))


@q(f"with {U}, r as (select model as key, cast(ts as date) as day, sum(tokens_in) as total, max(tokens_out) as peak, min(tokens_out) as floor from u group by 1, 2) select key, cast(sum(total) as bigint) as total, max(peak) as peak, min(nullif(floor, 0)) as floor from r group by 1")
def a02_merge_reports(spark, d):
    u = usage_events(table(spark, d, "events")).groupBy(F.col("model").alias("key"), F.to_date("ts").alias("day")).agg(F.sum("tokens_in").alias("total"), F.max("tokens_out").alias("peak"), F.min("tokens_out").alias("floor"))
    return L.merge_reports(u, "key")


@q(f"with {U}, c as (select stream, stream % 10 as root, sum(tokens_in) over (partition by stream order by line) as run from u), m as (select root, stream, max(run) as most from c group by 1, 2) select root, cast(sum(most) as bigint) as total, count(*) as streams from m group by 1")
def a03_family_total(spark, d):
    from pyspark.sql import Window

    u = usage_events(table(spark, d, "events")).withColumn("run", F.sum("tokens_in").over(Window.partitionBy("stream").orderBy("line"))).withColumn("root", F.col("stream") % 10)
    return L.family_total(u, "stream", "root", "run")


@q(f"with {U} select stream, min(tokens_in + cache_read) as floor, count(*) as calls, min(tokens_in + cache_read) * (count(*) - 1) as repeated from u group by 1")
def a04_preamble(spark, d):
    return L.preamble(usage_events(table(spark, d, "events")), F.col("tokens_in") + F.col("cache_read"))


@q(f"""with {U}, p(model, write, read) as (values ('click', 3.75::double, 0.3::double), ('view', 1.25::double, 0.1::double), ('purchase', 18.75::double, 1.5::double), ('signup', 1.0::double, 0.08::double), ('error', 2.0::double, 0.2::double)), r as (select *, row_number() over (partition by stream order by line) as rn, min(tokens_in + cache_read) over (partition by stream) as f from u join p using (model))
select stream, min(f) as floor, count(*) as calls, min(f) * count(*) as tokens, round(sum(f * case when rn = 1 then write else read end) / 1e6, 9) as cost from r group by 1""")
def a04_preamble_bill(spark, d):
    prices = spark.createDataFrame([("click", 3.75, 0.3), ("view", 1.25, 0.1), ("purchase", 18.75, 1.5), ("signup", 1.0, 0.08), ("error", 2.0, 0.2)], "model string, write double, read double")
    return L.preamble_bill(usage_events(table(spark, d, "events")), F.col("tokens_in") + F.col("cache_read"), prices)


@q(f"with {U} select step, max(cache_read) as peak, count(*) as calls, count(*) filter (cache_read > 300) as over from st group by 1")
def a05_over_limit(spark, d):
    return L.over_limit(usage(spark, d), "step", "cache_read", 300)


BUDGETS = [("click", 100), ("view", 10_000_000), ("nothing", 5)]


@q(f"""with {U}, t as (select model, sum(tokens_in) as total from u group by 1) select model, case when coalesce(total, 0) = 0 then 'no_data' when budget is null then 'no_budget' when total > budget then 'over' else 'within' end as verdict from t full join (values {', '.join(f"('{a}', {b})" for a, b in BUDGETS)}) b(model, budget) using (model)""")
def a06_budget_verdict(spark, d):
    t = usage_events(table(spark, d, "events")).groupBy("model").agg(F.sum("tokens_in").alias("total"))
    return L.budget_verdict(t, spark.createDataFrame(BUDGETS, "model string, budget long"), "model")


@q("""with r as (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders where o_totalprice > 0), m as (select o_custkey, median(o_totalprice / o_totalprice * o_orderkey) as m, count(*) as n from r where rn <= 20 group by 1)
select o_custkey, case when n >= 3 then m else 1.0 end as rate, n < 3 as rough from m""")
def a08_blended_rate(spark, d):
    o = table(spark, d, "orders").withColumn("amount", F.col("o_totalprice") / F.col("o_totalprice") * F.col("o_orderkey")).withColumn("one", F.when(F.col("o_totalprice") > 0, 1))
    return L.blended_rate(o, "o_custkey", "o_orderkey", "amount", "one")


ALL = "+".join(L.COUNTERS)


@q(f"""with {U}, p as (select cast(step as varchar) as part, cast(sum({ALL}) as double) as v, cast(sum(cache_read) as double) as cr, cast(sum(tokens_out) as double) as o from st group by 1), t as (select sum(v) as a, sum(cr) as cr, sum(o) as o, sum(v) filter (part = '0') as z from p), d as (select part, v from p where part <> '0' order by v desc, part desc limit 1)
select 'cache_read' as rule, '' as part, round(100::double * cr / a, 4) as share from t where 100 * cr / a > 40 union all select 'output', '', round(100::double * o / a, 4) from t where 100 * o / a > 3
union all select 'dominant', part, round(100::double * v / a, 4) from d, t where 100 * v / a > 35 union all select 'unassigned', '0', round(100::double * z / a, 4) from t where 100 * z / a > 5""")
def a10_diagnose(spark, d):
    return L.diagnose(usage(spark, d), cache_read=40.0)


@q("with r as (select event_id, event_type, row_number() over (partition by event_type, props order by ts, event_id) as repeat from events) select *, case when repeat >= 10 then 'critical' when repeat >= 3 then 'warning' else 'info' end as severity from r")
def w07_repeat_no(spark, d):
    e = table(spark, d, "events").withColumn("sig", F.concat_ws("|", "event_type", "props"))
    rows = L.repeat_no(e, "sig", ["ts", "event_id"], F.date_trunc("hour", "ts"))
    return rows.select("event_id", "event_type", F.col("repeat").cast("long").alias("repeat"), "severity")


@q(f"with {U}, r as (select model, line, cast(sum(tokens_in) over (partition by model order by line) as bigint) as running from u), l as (select *, running // 500 as level, coalesce(lag(running // 500) over (partition by model order by line), 0) as before from r) select model, line, running, level from l where level > before")
def w08_step_alerts(spark, d):
    return L.step_alerts(usage_events(table(spark, d, "events")), "model", "line", "tokens_in", 500, F.floor(F.col("line") / 10_000)).select("model", "line", "running", "level")


@q("""with de as (select c_nationkey as k, count(*) as declared from customer group by 1), ta as (select c_nationkey as k, count(distinct o_custkey) as taken from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P' group by 1)
select k as nation, declared, coalesce(taken, 0) as taken, case when coalesce(taken, 0) = 0 then 'skipped' when taken >= 20 then 'cap' when taken < declared and taken < 10 then 'short' else 'ok' end as cause from de left join ta using (k)""")
def a13_coverage(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    taken = table(spark, d, "orders").filter("o_orderstatus = 'P'").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("nation").agg(F.countDistinct("o_custkey").alias("taken"))
    return L.coverage(c.groupBy("nation").agg(n_rows("declared")), taken, "nation", 20, 10)


@q("""with de as (select c_nationkey as k, count(*) as declared from customer group by 1), ta as (select c_nationkey as k, count(distinct o_custkey) as taken from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P' group by 1),
p as (select declared, coalesce(taken, 0) as taken from de left join ta using (k)), t as (select cast(sum(declared) as bigint) as declared, cast(sum(taken) as bigint) as taken, bool_or(taken >= 20) as cap from p)
select declared, taken, round(100::double * taken / declared, 4) as percent, case when 100::double * taken / declared >= 80 then 'complete' when cap then 'capped' else 'incomplete' end as verdict from t""")
def a13_coverage_verdict(spark, d):
    return L.coverage_verdict(a13_coverage(spark, d))


@q("""with f as (select o_orderkey, o_orderkey % 3 + max(l_linenumber) as total from orders join lineitem on l_orderkey = o_orderkey group by 1), e as (select o_orderkey, total, unnest(generate_series(1, total)) as n from f),
s as (select e.*, case when l_returnflag = 'N' then 'text' when n > 6 then 'beyond' when l_orderkey is null then 'missing' when l_quantity < 10 then 'empty' else 'recognised' end as st from e left join lineitem on l_orderkey = o_orderkey and l_linenumber = n)
select o_orderkey, total, count(*) filter (st = 'missing') as missing, count(*) filter (st = 'beyond') as beyond, count(*) filter (st = 'empty') as empty, count(*) filter (st in ('missing', 'beyond')) = 0 as complete, count(*) filter (st = 'empty') > 0 as needs_human from s group by 1, 2""")
def a14_page_states(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("number"), (F.col("l_returnflag") == "N").alias("layer"), F.col("l_quantity").alias("chars"))
    f = x.groupBy("o_orderkey").agg(F.max("number").alias("m")).select("o_orderkey", (F.col("o_orderkey") % 3 + F.col("m")).cast("long").alias("total"))
    return L.page_states(f, x, "o_orderkey", 6)


@q("""select l_orderkey, max(l_linenumber) as total, cast(max(l_linenumber) - count(distinct l_linenumber) as int) as missing, cast(count(distinct l_linenumber) filter (l_returnflag = 'R') as int) as empty, max(l_linenumber) = count(distinct l_linenumber) and count(*) filter (l_returnflag = 'R') = 0 as complete from lineitem group by 1""")
def a14_page_manifest(spark, d):
    return L.page_manifest(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R")


@q("""with p as (select l_orderkey as o_orderkey, count(*) filter (l_returnflag <> 'R') as filled, count(*) as total from lineitem group by 1)
select o_orderkey, coalesce(filled, 0) as filled, coalesce(total, 1) as total, coalesce(filled, 0) / coalesce(total, 1) as share, case when coalesce(filled, 0) / coalesce(total, 1) < 0.1 then 'poor' else 'ok' end as state from orders left join p using (o_orderkey)""")
def a15_extraction_coverage(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") != "R").alias("filled"), n_rows("total"))
    return L.extraction_coverage(table(spark, d, "orders").select("o_orderkey"), p, "o_orderkey")


@q("select count(*) as rows, sha256(array_to_string(list_sort(list(n_nationkey || ':' || n_name)), ',')) as print, (select count(*) from orders) as orders_n from nation")
def a16_fingerprint(spark, d):
    n = table(spark, d, "nation")
    return L.fingerprint_exact(n, [F.col("n_nationkey").cast("string"), "n_name"]).crossJoin(F.broadcast(table(spark, d, "orders").agg(n_rows("orders_n"))))


@q()
def a16_fingerprint_rows(spark, d):
    return L.fingerprint(docs(spark, d), ["doc_id", "text"])


@q("select l_orderkey, l_linenumber, count(*) filter (l_returnflag = 'R') over (partition by l_orderkey) >= greatest(2, count(*) over (partition by l_orderkey) * 0.25) as doc_bad from lineitem")
def a17_doc_bad_pages(spark, d):
    return L.doc_bad_pages(table(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "doc_bad")


@q("""with m as (select source, doc_id, text, unnest(regexp_extract_all(text, '[A-Za-z]*[Ll]icense[a-z]*')) as key from documents),
k as (select key, count(*) as mentions, count(distinct source) as groups, min(doc_id) as first_doc, arg_min(substr(text, greatest(strpos(text, key) - 20, 1), 40), doc_id) as context from m group by 1 having count(distinct source) >= 2)
select *, cast(row_number() over (order by groups desc, mentions desc, key) as int) as rank from k""")
def a18_harvest(spark, d):
    return X.harvest(docs(spark, d), "doc_id", "source", "text", "[A-Za-z]*[Ll]icense[a-z]*").withColumnRenamed("first_id", "first_doc")


@q("""with r as (select user_id, max(ts) filter (event_type <> 'error') as good, max_by(event_type <> 'error', ts) as ok from events group by 1), f as (select e.user_id, count(*) as failures from events e join r using (user_id) where event_type = 'error' and (good is null or ts > good) group by 1)
select user_id, case when ok then 'ok' else 'failed' end as state, coalesce(failures, 0) as failures, case when failures > 0 then least(86400, cast(60 * pow(2.0, least(failures - 1, 10)) as bigint)) end as retry_s from r left join f using (user_id)""")
def a19_attempt_state(spark, d):
    return L.attempt_state(table(spark, d, "events"), "user_id", "ts", F.col("event_type") != "error")


@q("""with r as (select user_id, max(ts) filter (event_type = 'click') as o, max(ts) filter (event_type = 'purchase') as c from events group by 1) select user_id, case when c >= o then 'returned' when epoch(timestamp '2024-01-30 00:00:00') - floor(epoch(o)) <= 1200 then 'running' else 'silent' end as state from r where o is not null""")
def a24_assignment_state(spark, d):
    return L.assignment_state(table(spark, d, "events"), "user_id", F.col("event_type") == "click", F.col("event_type") == "purchase", "ts", F.lit("2024-01-30 00:00:00").cast("timestamp"))


@q("""select c_nationkey, cast(round(sum(case when c_acctbal > 0 then c_acctbal else 0 end), 2) as decimal(18, 2)) as income, cast(round(sum(case when c_acctbal < 0 then -c_acctbal else 0 end), 2) as decimal(18, 2)) as expense, count(*) as n from customer group by 1""")
def a22_statement_totals(spark, d):
    b = F.col("c_acctbal").cast("decimal(18,2)")
    t = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sum(F.when(b > 0, b).otherwise(0)).alias("income"), F.sum(F.when(b < 0, -b).otherwise(0)).alias("expense"), n_rows())
    return t.select("c_nationkey", F.col("income").cast("decimal(18,2)").alias("income"), F.col("expense").cast("decimal(18,2)").alias("expense"), "n")


@q("select c_name, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1")
def a23_group_counts(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(n_rows())
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_name").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


@q("""with recursive e as (select conv_id * 1000 + turn as c, conv_id * 1000 + turn - 1 as p from conversations where turn > 0), r as (select c, p as root from e union all select r.c, e.p from r join e on e.c = r.root) select c as child, min(root) as root from r group by c""")
def j17_roots(spark, d):
    node = F.col("conv_id") * 1000 + F.col("turn")
    e = table(spark, d, "conversations").filter("turn > 0").select(node.alias("child"), (node - 1).alias("parent"))
    return L.roots(e, "child", "parent", 32)


@q("select o_orderkey, cast(o_orderdate as date) as d from orders where cast(o_orderdate as date) >= date '1998-01-01' order by d, o_orderkey limit 20")
def k03_upcoming(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return o.filter("d >= '1998-01-01'").orderBy("d", "o_orderkey").limit(20)


@q("select event_id, event_type, user_id from events where event_type = 'error' and ts <= timestamp '2024-01-20' order by user_id, ts, event_id limit 50")
def k05_backlog(spark, d):
    return table(spark, d, "events").filter("event_type = 'error' and ts <= timestamp'2024-01-20'").orderBy("user_id", "ts", "event_id").limit(50).select("event_id", "event_type", "user_id")


@q("select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by event_id) <= 3")
def k04_cap_per_key(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("user_id", "event_type", "event_id")


@q(f"select term, id, count(*) as tf from (select doc_id as id, unnest(string_split({NORM.format('text')}, ' ')) as term from documents) where term <> '' group by 1, 2")
def k02_postings(spark, d):
    return S.build_postings(docs(spark, d), "doc_id", "text").select("term", "id", "tf")


@q(f"""with q as (select item_id as qid, {NORM.format('text')} as norm from benchmark), qt as (select qid, norm, list_distinct(string_split(norm, ' ')) as every from q where norm <> ''),
d as (select doc_id as id, lang as kind, {NORM.format("split_part(text, chr(10), 1)")} as label, {NORM.format('text')} as body from documents),
t as (select *, list_filter(string_split(coalesce(label, '') || ' ' || coalesce(body, ''), ' '), lambda x: x <> '') as toks from d), tot as (select count(*) as n, avg(len(toks)) as a from t),
p as (select id, term, count(*) as tf from (select id, unnest(toks) as term from t) group by 1, 2), f as (select term, count(*) as df from p group by 1), w as (select qid, norm, every, unnest(list_filter(every, lambda x: x not in ('ст', 'п'))) as term from qt),
s as (select qid, id, count(*) as have, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(toks) / a))), 6) as bm25 from w join p using (term) join f using (term) join t using (id), tot group by 1, 2),
c as (select s.*, qt.norm, qt.every, t.label, t.body, t.kind from s join qt using (qid) join t using (id) where have = len(list_filter(every, lambda x: x not in ('ст', 'п'))) qualify row_number() over (partition by qid order by bm25 desc, id) <= 200)
select qid, id, cast(row_number() over (partition by qid order by score desc, id) as int) as rank, score from (select qid, id, cast(len(every) * 10 + case when contains(label, norm) then 20 when contains(body, norm) then 10 else 0 end + case when kind in ('article', 'point') then 5 else 0 end as int) as score from c) qualify rank <= 10""")
def k01_search(spark, d):
    qs = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    nodes = docs(spark, d).select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("label"), "text", F.col("lang").alias("kind"))
    return S.search(nodes, qs, 10)


@q(f"""with n as (select c_custkey as id, case when c_custkey % 50 = 0 then '' else {NORM.format('c_name')} end as name from customer) select a.id as a, b.id as b from n a join n b on a.id < b.id and a.name <> '' and b.name <> '' and (levenshtein(a.name, b.name) <= 1 or starts_with(a.name, b.name) or starts_with(b.name, a.name)) where not (a.id % 7 = 0 and b.id = a.id + 1)
union all select id, null from n where name = ''""")
def j09_near_twins(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 50 == 0, F.lit("-")).otherwise(F.col("c_name")).alias("c_name"))
    cleared = c.filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return S.near_twins(c, "c_custkey", "c_name", cleared)


STAR = ({"order": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey"}, [("order", "holds", "part"), ("part", "made_by", "supplier")])


def star(spark, d):
    x = table(spark, d, "lineitem").withColumn("l_suppkey", F.when(F.col("l_returnflag") == "N", F.col("l_suppkey")))
    return G.star_graph(x, *STAR)


E = "e as (select distinct 'order:' || l_orderkey as source, 'holds' as relation, 'part:' || l_partkey as target from lineitem union all select distinct 'part:' || l_partkey, 'made_by', 'supplier:' || l_suppkey from lineitem where l_returnflag = 'N')"
N = "n as (select distinct 'order' as kind, 'order:' || l_orderkey as id from lineitem union all select distinct 'part', 'part:' || l_partkey from lineitem union all select distinct 'supplier', 'supplier:' || l_suppkey from lineitem where l_returnflag = 'N')"


@q(f"with {E} select * from e")
def g02_star_edges(spark, d):
    return star(spark, d)[1]


@q(f"with {N} select * from n")
def g02_star_nodes(spark, d):
    return star(spark, d)[0]


@q(f"with {E}, {N} select id, kind, 'no_made_by' as defect from n where kind = 'part' and id not in (select source from e where relation = 'made_by') union all select null, 'order', 'not_measurable'")
def g04_defects(spark, d):
    return G.defects(*star(spark, d), {"part": "made_by", "order": "proved_by"})


@q(f"with {E}, {N}, b as (select source as id, target as o from e union all select target, source from e) select id, array_to_string(list_sort(list(distinct o)), ',') as neighbours from b where id like 'supplier:%' group by id")
def j18_neighbours(spark, d):
    nodes, edges = star(spark, d)
    return G.neighbours(nodes.filter("kind = 'supplier'"), edges).select("id", F.array_join("neighbours", ",").alias("neighbours"))


@q(f"with {E}, {N} select e.* from e where source in (select id from n where kind <> 'supplier') and target in (select id from n where kind <> 'supplier')")
def g06_prune(spark, d):
    nodes, edges = star(spark, d)
    return G.prune(nodes, edges, nodes.filter("kind <> 'supplier'"))[1].select("source", "relation", "target")


@q("select o_custkey as source, o_orderpriority as target, 'placed' as relation, max(o_orderkey) as ord from orders group by 1, 2")
def g03_dedup_edges(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("target"), F.lit("placed").alias("relation"), F.col("o_orderkey").alias("ord"))
    return G.dedup_edges(e, "ord")


def pairs(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("source"), (F.col("l_partkey") * 2 + 1).alias("target"))


#: Least labels passed over edges for 24 rounds, far more than the longest way between two nodes here.
COMPONENTS = """recursive e as (select distinct l_orderkey * 2 as s, l_partkey * 2 + 1 as t from lineitem), b as (select s, t from e union all select t, s from e),
l(r, id, c) as (select 0, s, s from (select distinct s from b) union all select r + 1, id, min(c) from (select r, id, c from l union all select l.r, b.s, l.c from l join b on l.id = b.t) where r < 24 group by r, id),
f as (select id, c as component from l where r = 24)"""


@q(f"with {COMPONENTS} select id, component from f")
def g07_communities(spark, d):
    return G.components(pairs(spark, d))


@q(f"""with {COMPONENTS}, n as (select component, count(*) as nodes from f group by 1), k as (select component, count(*) as edges from e join f on s = id group by 1)
select n.component, nodes, coalesce(edges, 0) as edges, case when nodes > 1 then coalesce(edges, 0) / (nodes * (nodes - 1) / 2) else 1.0 end as cohesion from n left join k using (component)""")
def g07_cohesion(spark, d):
    e = pairs(spark, d)
    return G.cohesion(e, G.components(e))


@q(f"with {E}, {N} select (select count(*) from n) as nodes, (select count(*) from e) as edges, count(distinct kind) as kinds, bool_or(kind = 'part') as needs_review from n")
def g08_graph_report(spark, d):
    nodes, edges = star(spark, d)
    counts = nodes.agg(n_rows("nodes"), F.countDistinct("kind").alias("kinds"), F.bool_or(F.col("kind") == "part").alias("needs_review"))
    return counts.crossJoin(F.broadcast(edges.agg(n_rows("edges")))).select("nodes", "edges", "kinds", "needs_review")


@q("""select l_orderkey, l_linenumber, rn from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) as rn from lineitem) where rn <> l_linenumber""")
def w10_numbering_check(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("rn")).filter("rn <> l_linenumber")


@q("select conv_id, coalesce(max(case when role = 'assistant' then turn end), 0) + 1 as next_round from conversations group by 1")
def w12_next_round(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg((F.coalesce(F.max(F.when(F.col("role") == "assistant", F.col("turn"))), F.lit(0)) + 1).alias("next_round"))


@q("select role, regexp_extract(lower(text), '^([a-z]+)', 1) as opener, count(*) as n from conversations where regexp_matches(text, '(?i)\\b(the|and|of)\\b') group by 1, 2")
def a11_substitutions(spark, d):
    c = table(spark, d, "conversations").filter(F.col("text").rlike(r"(?i)\b(the|and|of)\b"))
    return c.groupBy("role", F.regexp_extract(F.lower("text"), "^([a-z]+)", 1).alias("opener")).agg(n_rows())


@q("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, try_cast(props as json) is null as torn from events")
def s02_read_json(spark, d):
    x = F.from_json("props", "struct<k:bigint,_bad:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return table(spark, d, "events").select("event_id", x.alias("x")).select("event_id", "x.k", F.col("x._bad").isNotNull().alias("torn"))
