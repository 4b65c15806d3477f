"""Rates, calendars, tariffs and terms: as-of, interval and band joins.

Facts meet rates on equality of the year first, and only then on the range;
calendars and fees are joined on equality, and Spark picks the side to
broadcast by size. Brackets of a tariff, a handful, travel in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_intervals(rates: DataFrame) -> DataFrame:
    """rates: dt, rate -> since, until (exclusive, null for the last), rate."""
    return rates.select(F.col("dt").alias("since"), F.lead("dt").over(Window.orderBy("dt")).alias("until"), "rate")


def _by_year(rates: DataFrame) -> DataFrame:
    """rate_intervals with a row for each year (__y) that a rate is in force in;
    the last one to the year 9999."""
    last = F.coalesce(F.year(F.date_sub("until", 1)), F.lit(9999))
    return rate_intervals(rates).withColumn("__y", F.explode(F.sequence(F.year("since"), F.greatest(last, F.year("since")))))


def asof_rate(facts: DataFrame, date_col: str, rates: DataFrame) -> DataFrame:
    """facts with the rate in force; days before the first rate drop out."""
    rows = facts.join(_by_year(rates), F.year(date_col) == F.col("__y"))
    return rows.filter((F.col(date_col) >= F.col("since")) & (F.col("until").isNull() | (F.col(date_col) < F.col("until")))).drop("since", "until", "__y")


def fill_daily(rates: DataFrame, since: str, until: str) -> DataFrame:
    """dt, rate for each day, carried forward, also from before the range."""
    days = rates.sparkSession.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.lit(until).cast("date"))).alias("dt"))
    return asof_rate(days, "dt", rates)


def islands(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Runs of equal values: key, island, value, first, last, n."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("new", (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    rows = rows.withColumn("new", F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("new"))).withColumn("island", F.sum("new").over(w))
    return rows.groupBy(key, "island", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def accrue(debts: DataFrame, rates: DataFrame, days_in_year: Column) -> DataFrame:
    """debts: id, amount (decimal), since, until (inclusive). One row for each
    overlap of a debt with a rate and a calendar year: from_d, to_d, days, rate,
    amount = debt * rate / 100 * days / days of that year."""
    r = _by_year(rates).withColumnsRenamed({"since": "r1", "until": "r2"})
    years = debts.withColumn("y", F.explode(F.sequence(F.year("since"), F.year("until"))))
    years = years.withColumn("a", F.greatest("since", F.make_date("y", F.lit(1), F.lit(1)))).withColumn("b", F.least("until", F.make_date("y", F.lit(12), F.lit(31))))
    rows = years.join(r, F.col("y") == F.col("__y")).filter((F.col("b") >= F.col("r1")) & (F.col("r2").isNull() | (F.col("a") < F.col("r2"))))
    rows = rows.withColumn("from_d", F.greatest("a", "r1")).withColumn("to_d", F.least("b", F.coalesce(F.date_sub("r2", 1), F.col("b"))))
    rows = rows.withColumn("days", F.datediff("to_d", "from_d") + 1)
    interest = F.col("amount").cast("double") * F.col("rate").cast("double") / 100 * F.col("days") / days_in_year
    return rows.select("id", "from_d", "to_d", "days", "rate", interest.alias("interest"))


def tiered_duty(claims: DataFrame, price_col: str, tiers: DataFrame) -> DataFrame:
    """tiers: upto (null: open), base, pct, over, cap. The first tier whose upto
    is not under the price: base + (price - over) * pct, capped, as DECIMAL(18,2), half to even.
    Prices that are not positive are rejected (null)."""
    money = {c: F.col(c).cast("decimal(18,2)") for c in ("upto", "base", "over", "cap")}
    tiers = tiers.withColumns(money | {"pct": F.col("pct").cast("decimal(9,6)")})
    row = F.struct(F.col("upto").isNull().alias("open"), "upto", "base", "pct", "over", "cap")
    t = tiers.agg(F.array_sort(F.collect_list(row)).alias("__tiers"))  # one row
    price = F.col(price_col).cast("decimal(18,2)")
    fits = F.filter("__tiers", lambda x: x["open"] | (price <= x["upto"]))
    rows = claims.crossJoin(F.broadcast(t)).withColumn("__t", F.when(price > 0, F.get(fits, F.lit(0))))
    duty = F.least(F.col("__t.base") + F.greatest(price - F.col("__t.over"), F.lit(0)) * F.col("__t.pct"), F.coalesce("__t.cap", F.lit(10**15).cast("decimal(18,2)")))
    return rows.withColumn("duty", F.when(F.col("__t.base").isNotNull(), F.bround(duty, 2).cast("decimal(18,2)"))).drop("__t", "__tiers")


def flat_duty(claims: DataFrame, fees: DataFrame, keys: list[str]) -> DataFrame:
    """claims with fee and status; `rate missing` where no fee is listed."""
    rows = claims.join(fees, keys, "left")
    return rows.withColumn("status", F.when(F.col("fee").isNull(), "rate missing").otherwise("ok"))


def calendar_fallback(spark, since: str, until: str, holidays: list[str]) -> DataFrame:
    """d, is_working: weekends and a list of month-day holidays are off."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.lit(until).cast("date"))).alias("d"))
    return days.withColumn("is_working", ~(F.dayofweek("d").isin(1, 7) | F.date_format("d", "MM-dd").isin(*holidays)))


def calendar_from_mask(df: DataFrame) -> DataFrame:
    """year, mask -> d, is_working. Codes 1 and 4 are off; a mask of another
    length than the year's is rejected."""
    rows = df.filter(F.length("mask") == F.dayofyear(F.make_date("year", F.lit(12), F.lit(31))))
    rows = rows.select("year", F.posexplode(F.split("mask", "")).alias("pos", "code"))
    return rows.select(F.date_add(F.make_date("year", F.lit(1), F.lit(1)), F.col("pos")).alias("d"), (~F.col("code").isin("1", "4")).alias("is_working"))


def calendar_from_json(df: DataFrame) -> DataFrame:
    """json of {year, months: [{month, days: "1,2*,9+"}]} -> d: days off. A day
    with * is a short working day, one with + is off."""
    x = F.from_json("json", "struct<year:int,months:array<struct<month:int,days:string>>>")
    rows = df.select(x.alias("x")).select("x.year", F.inline("x.months"))
    rows = rows.select("year", "month", F.explode(F.split("days", ",")).alias("day")).filter(~F.col("day").endswith("*"))
    return rows.select(F.make_date("year", "month", F.regexp_replace("day", r"\+", "").cast("int")).alias("d"))


def merge_calendars(a: DataFrame, b: DataFrame) -> DataFrame:
    """d, is_working, conflict: disputed days count as off."""
    rows = a.select("d", F.col("is_working").alias("wa")).join(b.select("d", F.col("is_working").alias("wb")), "d", "full")
    return rows.select("d", (F.coalesce("wa", F.lit(True)) & F.coalesce("wb", F.lit(True))).alias("is_working"), (F.col("wa") != F.col("wb")).alias("conflict"))


def numbered_calendar(calendar: DataFrame) -> DataFrame:
    """Adds wd_seq, the running count of working days, and next_wd, the first
    working day not before d. A calendar has some hundred rows a year."""
    w = Window.orderBy("d")
    rows = calendar.withColumn("wd_seq", F.sum(F.col("is_working").cast("int")).over(w))
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("next_wd", F.min(F.when(F.col("is_working"), F.col("d"))).over(after))


def working_deadline(df: DataFrame, start: str, days: int, calendar: DataFrame) -> DataFrame:
    """df with deadline: the days-th working day after start."""
    c = numbered_calendar(calendar)
    first = c.select(F.col("d").alias("__d"), F.col("wd_seq").alias("__s"))
    ends = c.filter("is_working").select(F.col("wd_seq").alias("__e"), F.col("d").alias("deadline"))
    rows = df.join(first, F.col(start) == F.col("__d"))
    return rows.join(ends, F.col("__s") + days == F.col("__e"), "left").drop("__d", "__s", "__e")


def moved_deadline(df: DataFrame, raw_end: str, calendar: DataFrame) -> DataFrame:
    """df with deadline: raw_end, or the next working day."""
    c = numbered_calendar(calendar).select(F.col("d").alias("__d"), F.col("next_wd").alias("deadline"))
    return df.join(c, F.col(raw_end) == F.col("__d"), "left").drop("__d")


def parse_rates(df: DataFrame, xml_col: str) -> DataFrame:
    """dt, rate from <KR><DT>..</DT><Rate>..</Rate></KR>, decimal commas too."""
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(xml_col), F.lit("<DT>([0-9-]{10})[^<]*</DT>"), F.lit(1)).alias("dt"), F.regexp_extract_all(F.col(xml_col), F.lit("<Rate>([^<]*)</Rate>"), F.lit(1)).alias("rate"))
    return df.select(F.explode(pairs).alias("x")).select(F.to_date("x.dt").alias("dt"), F.replace(F.col("x.rate"), F.lit(","), F.lit(".")).cast("decimal(9,4)").alias("rate"))
