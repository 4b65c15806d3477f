"""Queries of money, names and families, over what Spark derives from the given
tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions.words import spell_number
from evidentia.operators import entities as E
from evidentia.operators import ledger as L
from evidentia.operators import money as M
from evidentia.plans.text_queries import NORM
from evidentia.sources.tables import table

QUERIES, SQL = {}, {}


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Sums of orders in seven forms, by the order's key.
FORMS = """with o as (select o_orderkey as id, o_orderpriority as source, cast(floor(o_totalprice) as bigint) as n, o_orderkey % 7 as form from orders),
s as (select id, source, form, cast(case when form = 4 then n // 1000 * 1000 when form = 5 then n // 1000 * 1500 else n end as decimal(20, 2)) as amount from o where form <> 5 or n >= 1000)"""


def sums(spark, d):
    n = F.floor("o_totalprice").cast("long")
    k = F.floor(n / 1000).cast("long")
    form = F.col("o_orderkey") % 7
    text = (
        F.when(form == 0, F.concat(F.lit("взыскать "), n, F.lit(" ("), spell_number(n, "m", "gen"), F.lit(") рублей")))
        .when(form == 1, F.concat(F.lit("сумма "), n, F.lit(" ("), spell_number(n + 1), F.lit(" рублей)")))
        .when(form == 2, F.concat(n, F.lit(" руб. по заказу")))
        .when(form == 3, F.concat(F.lit("суд указал: «уплатить "), n, F.lit(" евро»")))
        .when(form == 4, F.concat(k, F.lit(" тыс. руб.")))
        .when((form == 5) & (k > 0), F.concat(spell_number(k * 1500), F.lit(" ("), k * 1500, F.lit(") долларов")))
        .when(form == 6, F.concat(F.lit("итого "), n, F.lit(" (столько-то) рублей")))
    )
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), text.alias("text"))
    return rows, M.audit_money(rows, "id", "text")


@q(f"""{FORMS} select id, amount, case when form = 3 then 'евро' when form = 5 then 'доллар' else 'рубль' end as currency, ['ok', 'mismatch', 'no_words', 'quoted', 'abbreviated', 'ok', 'unreadable'][1 + form] as status from s""")
def f15_audit_money(spark, d):
    return sums(spark, d)[1].select("id", "amount", "currency", "status")


@q(f"""{FORMS} select source, case when form = 3 then 'евро' when form = 5 then 'доллар' else 'рубль' end as currency, count(*) as sums, sum(amount) as total, count(*) filter (form in (1, 6)) as faults from s group by 1, 2""")
def audit_money(spark, d):
    rows, audit = sums(spark, d)
    return M.money_totals(audit.join(rows.select("id", "source"), "id"), "source")


#: Short names in two alphabets, several rows each, and blank ones.
_LETTERS = "lower(split_part(p_name, ' ', 1))"
for _a, _b in (("shch", "щ"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"), ("ya", "я"), ("yo", "ё")):
    _LETTERS = f"replace({_LETTERS}, '{_a}', '{_b}')"
NAMES = f"with n as (select p_partkey as id, case when p_partkey % 50 = 0 then '' else {NORM.format(f"translate({_LETTERS}, 'abvgdeziyklmnoprstufhc', 'абвгдезийклмнопрстуфхк')")} end as form from part)"


@q(f"""with recursive {NAMES.removeprefix("with ")}, f as (select form, count(*) as same, translate(form, 'абвгдежзийклмнопрстуфхцчшщъыьэюя', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ012345') as coded from n where form <> '' group by 1),
e as (select a.form as u, b.form as v from f a join f b on a.form <> b.form and (levenshtein(a.coded, b.coded) <= case when length(a.form) >= 6 and length(b.form) >= 6 then 2 else 1 end or (length(a.form) >= 6 and length(b.form) >= 6 and (starts_with(a.form, b.form) or starts_with(b.form, a.form))))),
l(form, entity) as (select form, form from f union select e.v, l.entity from l join e on e.u = l.form), c as (select form, min(entity) as entity from l group by 1), z as (select entity, count(*) as size from c group by 1)
select id, n.form, z.entity, f.same, z.size from n join f using (form) join c using (form) join z using (entity) union all select id, null, null, null, null from n where form = ''""")
def normalise_entities(spark, d):
    """First words of part names as names."""
    name = F.when(F.col("p_partkey") % 50 == 0, " - ").otherwise(F.split("p_name", " ")[0])
    return E.normalise_entities(table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name")), "id", "name")


@q("""with p as (select c_name as name, case when c_custkey % 3 = 0 then 'opponent' else 'client' end as role from customer where c_custkey % 41 <> 0), b as (select count(*) as unknown from customer where c_custkey % 41 = 0 and c_custkey % 3 = 0),
r as (select c_custkey as rid, c_name as a, 'Customer#' || lpad(cast(c_custkey + 1 as varchar), 9, '0') as b from customer where c_custkey % 10 = 0), k as (select s_suppkey as qid, replace(s_name, 'Supplier', 'Customer') as name from supplier),
m as (select qid, (select count(*) from p where role = 'client' and levenshtein(p.name, k.name) <= 2) as client, (select count(*) from p where role = 'opponent' and levenshtein(p.name, k.name) <= 2) as opponent,
(select count(*) from r where levenshtein(r.a, k.name) <= 2 or levenshtein(r.b, k.name) <= 2) as links from k)
select qid, client, opponent, links, unknown, case when opponent > 0 then 'conflict' when client > 0 then 'client' when links > 0 then 'link' when unknown > 0 then 'no_data' else 'none' end as verdict from m, b""")
def j10_conflicts(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    parties = c.select(F.when(key % 41 != 0, F.col("c_name")).alias("name"), F.when(key % 3 == 0, "opponent").otherwise("client").alias("role"))
    other = F.concat(F.lit("Customer#"), F.lpad((key + 1).cast("string"), 9, "0"))
    relations = c.filter(key % 10 == 0).select(F.col("c_name").alias("a"), other.alias("b"))
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"))
    return E.conflicts(asked, parties, relations)


@q("""with n as (select conv_id, turn, conv_id * 1000 + turn as id, conv_id % 10 as grp from conversations), t as (select grp, max_by(conv_id, (conv_id * 7 % 101) * 1000000 + conv_id) as conv from n where turn = 0 group by 1)
select t.grp, conv * 1000 as root, id from t join n on conv_id = conv""")
def k06_newest_family(spark, d):
    """Turns as a chain below the first turn of their conversation."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") % 10).alias("grp"), (F.col("conv_id") * 7 % 101).alias("ts"), "turn")
    edges = c.filter("turn > 0").select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    return L.latest_family(c.select("id", "grp", "ts"), edges, 1024)
