"""Identifiers found in documents, judged together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import checks as C


def accounts_unkeyed(ids: DataFrame, doc: str = "doc_id") -> DataFrame:
    """ids: doc, kind (bik or account), value. doc, account of accounts that no
    valid bank code of their document keys, where it has one at all."""
    codes = ids.filter((F.col("kind") == "bik") & C.bik_valid("value")).select(doc, F.col("value").alias("bik")).distinct()
    accounts = ids.filter("kind = 'account'").select(doc, F.col("value").alias("account")).distinct()
    judged = accounts.join(codes, doc).groupBy(doc, "account").agg(F.bool_or(C.account_valid("account", "bik")).alias("keyed"))
    return judged.filter("not keyed").select(doc, "account")


#: Kind -> pattern (group 1) and test of its value.
KINDS = {
    "inn": (r"(?:^|[^0-9])([0-9]{10}|[0-9]{12})(?![0-9])", C.inn_valid),
    "ogrn": (r"(?:^|[^0-9])([0-9]{13}|[0-9]{15})(?![0-9])", C.ogrn_valid),
    "snils": (r"(?:^|[^0-9])([0-9]{3}-[0-9]{3}-[0-9]{3} [0-9]{2})(?![0-9])", C.snils_valid),
    "bik": (r"(?:^|[^0-9])(04[0-9]{7})(?![0-9])", C.bik_valid),
    "kpp": (r"(?iuU)КПП\D{0,3}([0-9]{4}[0-9A-Z]{2}[0-9]{3})(?![0-9])", C.kpp_valid),
    "card": (r"(?:^|[^0-9])([0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4})(?![0-9])", lambda v: C.luhn_valid(F.regexp_replace(v, "[ -]", ""))),
    "isin": (r"(?:^|[^0-9A-Za-z])([A-Z]{2}[A-Z0-9]{9}[0-9])(?![0-9A-Za-z])", C.isin_valid),
    "cadastre": (r"(?:^|[^0-9:])([0-9]{2}:[0-9]{2}:[0-9]{6,7}:[0-9]+)(?![0-9:])", lambda v: C.cadastre_check(v).isNull()),
}


def judged_ids(df: DataFrame, keep: list[str], text_col: str, kinds=KINDS) -> DataFrame:
    """keep, kind, value, valid: each identifier of every text with the result
    of its own test, repeated ones as often as they stand there."""
    found = [F.transform(F.regexp_extract_all(F.col(text_col), F.lit(p), F.lit(1)), _judged(k, test)) for k, (p, test) in kinds.items()]
    return df.select(*keep, F.inline(F.concat(*found)))


def _judged(kind: str, test):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), test(v).alias("valid"))


def id_rates(judged: DataFrame, source: str) -> DataFrame:
    """source, kind, n, valid_n of judged_ids, per source and kind."""
    return judged.groupBy(source, "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("valid_n"))


#: A list of attachments in a text, and its ranges (fixed values).
MENTION = r"(?iu)приложени[ияюе]\s*№?\s*([0-9\s,;—–-]{1,40})"
RANGE = r"([0-9]{1,2})\s*[-—–]\s*([0-9]{1,2})"


def mentioned_numbers(text: Column) -> Column:
    """Sorted numbers of the attachments that a text names, single, in lists and
    in ranges of under 50."""
    parts = F.regexp_extract_all(text, F.lit(MENTION), F.lit(1))

    def of(part: Column) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(part, F.lit(RANGE), F.lit(1)).alias("a"), F.regexp_extract_all(part, F.lit(RANGE), F.lit(2)).alias("b"))
        spans = F.flatten(F.transform(pairs, lambda p: F.when((p["a"].cast("int") <= p["b"].cast("int")) & (p["b"].cast("int") - p["a"].cast("int") < 50), F.sequence(p["a"].cast("int"), p["b"].cast("int"))).otherwise(F.array().cast("array<int>"))))
        single = F.transform(F.regexp_extract_all(F.regexp_replace(part, RANGE, " "), F.lit("([0-9]{1,2})"), F.lit(1)), lambda x: x.cast("int"))
        return F.concat(spans, single)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, of))))


def numbering_check(df: DataFrame, id_col: str, declared: str, text_col: str) -> DataFrame:
    """id, gaps, unmentioned: numbers of 1..n that aren't declared (an array of
    int), and declared ones that the text doesn't name."""
    numbers = F.col(declared)
    gaps = F.array_except(F.sequence(F.lit(1), F.array_max(numbers)), numbers)
    return df.select(id_col, F.array_sort(gaps).alias("gaps"), F.array_sort(F.array_except(numbers, mentioned_numbers(F.col(text_col)))).alias("unmentioned"))


def report_ids(df: DataFrame, id_col: str, text_col: str, label: str, number: str, valid) -> DataFrame:
    """id, value: invalid numbers that carry their label somewhere in the text;
    bare invalid numbers are no findings."""
    text = F.col(text_col)
    labelled = F.regexp_extract_all(text, F.lit(rf"(?iuU)(?:{label})\D{{0,3}}({number})"), F.lit(1))
    rows = df.select(id_col, F.explode(F.array_distinct(labelled)).alias("value"))
    return rows.filter(~valid(F.col("value")))


def date_near(df: DataFrame, id_col: str, text_col: str, key: Column, reach: int = 200) -> DataFrame:
    """id, near: the last dd.mm.yyyy within `reach` characters before the first
    mention of key; NULL without one."""
    text = F.col(text_col)
    at = F.call_function("locate", key, text)
    left = F.substring(text, F.greatest(at - reach, F.lit(1)), F.least(at - 1, F.lit(reach)))
    dates = F.regexp_extract_all(left, F.lit(r"([0-9]{2}\.[0-9]{2}\.[0-9]{4})"), F.lit(1))
    return df.select(id_col, F.when(at > 0, F.try_to_date(F.try_element_at(dates, F.lit(-1)), "dd.MM.yyyy")).alias("near"))


def unmarked_supersedes(sections: DataFrame, cue: str = r"(?:supersedes|replaces|отменяет|заменяет)") -> DataFrame:
    """sections: key (a date), body, marked (dates it marks as superseded). key,
    older: dates of older sections within 60 characters after a cue word that
    aren't marked."""
    found = F.regexp_extract_all("body", F.lit(rf"(?iuU){cue}.{{0,60}}?([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})"), F.lit(1))
    cues = sections.select("key", "marked", F.explode(F.array_distinct(found)).alias("d")).withColumn("older", F.try_to_date("d"))
    known = sections.select(F.col("key").alias("older")).distinct()
    return cues.join(known, "older", "left_semi").filter((F.col("older") < F.col("key")) & ~F.array_contains("marked", F.col("older"))).select("key", "older")


def quota_resets(log: DataFrame, now: Column, fresh_days: int = 7) -> DataFrame:
    """log: provider, limit_id, ts, ord, reset_at, corrupt. provider, limit_id,
    state: unknown where the newest row is corrupt, stale, from the future or
    past its boundary; reset where the valid row before it had a boundary that
    has passed and is older; else running."""
    from pyspark.sql import Window

    w = Window.partitionBy("provider", "limit_id").orderBy(F.desc("ts"), F.desc("ord"))
    rows = log.withColumn("rn", F.row_number().over(w))
    # the boundary of the valid row before
    before = F.max(F.when(~F.col("corrupt"), F.struct("ts", "ord", "reset_at"))).over(Window.partitionBy("provider", "limit_id").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("old", before["reset_at"]).filter("rn = 1")
    age = F.datediff(now, "ts")
    unknown = F.col("corrupt") | (age > fresh_days) | (F.col("ts") > now) | F.col("reset_at").isNull() | (F.col("reset_at") <= now)
    return rows.select("provider", "limit_id", F.when(unknown, "unknown").when((F.col("old") <= now) & (F.col("old") < F.col("reset_at")), "reset").otherwise("running").alias("state"))


RULE_KINDS = ("present", "absent")


def load_rules(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON rules, one a line: rule_id, expect, terms, reason, problem. problem
    is NULL for a rule that can be applied: readable, of a known kind, with
    terms, and the only one of its id."""
    from pyspark.sql import Window

    x = F.from_json(col, "struct<rule_id:string,expect:string,terms:array<string>,reason:string>")
    rows = lines.select(x.alias("x")).select("x.*")
    n = F.count("rule_id").over(Window.partitionBy("rule_id"))
    problem = F.when(F.col("rule_id").isNull(), "unreadable").when(~F.coalesce(F.col("expect").isin(*RULE_KINDS), F.lit(False)), "unknown kind").when(F.coalesce(F.size("terms"), F.lit(0)) < 1, "no terms").when(n > 1, "duplicate id")
    return rows.withColumn("problem", problem)
