"""Citations: a small grammar over texts, targets, and the state of each.

A mention names articles (one, a list, a range; of a chapter or not) of a code,
a chapter of a code, or a point of an act by its date and number. `this code` is
the document's own, `the same code` the last one that was named before.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.arrays import as_row, bound, match_groups, running_sums, scan
from evidentia.sources.shared import broadcast_if_small

#: Words of the grammar.
ARTICLE = r"ст\.\s*ст\.|стать(?:я|и|е|ю|ей|ёй|ям|ями|ях)|статей|ст\.|ст(?=\s*\d)"
CHAPTER = r"глав(?:а|ы|е|у|ой)|гл\."
POINT = r"пункт(?:а|у|ом|е|ы|ов)?|п\."
THIS = r"настоящ(?:его|ему|ем|им)\s+кодекс\p{L}*"
SAME = r"т(?:ого|ому|ом|ем)\s+же\s+кодекс\p{L}*"
NUMBER = r"\d+(?:\.\d+)*(?:-\d+)?(?![\d])"
LIST = rf"{NUMBER}(?:\s*(?:,|;|\bи\b|\bили\b|–|—|\s-\s)\s*{NUMBER})*"
ACT = r"(?:постановлени\p{L}*\s+)?пленума\s+(?:вс|вас)\s+рф\s+от\s+(\d{2}\.\d{2}\.\d{4})(?:\s*(?:№|N)\s*(\d+))?"
FLAGS = "(?iuU)"
LEFT = r"(?<![\p{L}\p{N}.])"
MATCHES = "array<struct<at:int,kind:string,list:string,chapter:string,named:string,day:string,act_number:string>>"
MENTIONS = "array<struct<ord:int,kind:string,number:string,chapter:string,code:string,day:date,act_number:string>>"
#: Numbers in a range at most; a longer one is a slip and gives its two ends.
MOST_RANGE = 1000


def _plain(alias: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(alias), r"(?U)\s*рф$", ""), r"(?U)[\s.]+", "")


def numbers_of(text: Column) -> Column:
    """Numbers of a list, ranges of whole numbers expanded, in order."""
    pieces = F.regexp_extract_all(text, F.lit(rf"{FLAGS}{NUMBER}(?:\s*(?:–|—|\s-\s)\s*{NUMBER})?"), F.lit(0))

    def expand(x: Column) -> Column:
        ends = F.regexp_extract_all(x, F.lit(rf"{FLAGS}{NUMBER}"), F.lit(0))
        a, b = F.get(ends, F.lit(0)).try_cast("int"), F.get(ends, F.lit(1)).try_cast("int")
        return F.when((b >= a) & (b - a < MOST_RANGE), F.transform(F.sequence(a, b), lambda i: i.cast("string"))).otherwise(ends)

    return F.array_distinct(F.flatten(F.transform(pieces, expand)))


def _named(kind: str, z: Column) -> tuple[Column, ...]:
    """A match's fields (groups list, second, third) by kind: they mean a chapter
    and a code, or a day and a number."""
    point = F.lit(kind == "point")
    return (
        F.lit(kind).alias("kind"), z[1].alias("list"),
        F.when(~point, F.nullif(z[2], F.lit(""))).alias("chapter"), F.when(~point, z[3]).alias("named"),
        F.when(point, z[2]).alias("day"), F.when(point, F.nullif(z[3], F.lit(""))).alias("act_number"),
    )


def _placed(kind: str):
    """Matches with their places, of what match_groups gives."""

    def of(pieces: Column) -> Column:
        def at_places(at: Column) -> Column:
            return F.transform(F.slice(F.arrays_zip(pieces.alias("z"), at.alias("at")), 2, F.size(pieces)), lambda x: F.struct(x["at"].alias("at"), *_named(kind, x["z"])))

        # A match begins where the match before it and the text between them end.
        before = running_sums(F.transform(pieces, lambda z: F.length(F.element_at(z, -1)) + F.when(F.size(z) > 1, F.length(z[0])).otherwise(0)))
        return F.when(F.size(pieces) > 1, bound(before, at_places)).otherwise(F.array().cast(MATCHES))

    return of


def mentions(df: DataFrame, text_col: str, codes: Mapping[str, str], own: str | None = None) -> DataFrame:
    """df with a row for each target named in a text: ord, kind (article,
    chapter, point), number, chapter, code, day and act_number of a point's act.

    codes: alias -> code; an alias is met with or without `РФ`, in any case. own
    is the column of the document's code, for `this code`. A number without a
    code or act is no mention. Null texts name nothing."""
    rows = df.select("*", as_row(mentioned(F.col(text_col), codes, None if own is None else F.col(own)), "__m"))
    return rows.select(*df.columns, F.inline("__m"))


def mentioned(t: Column, codes: Mapping[str, str], this: Column | None = None) -> Column:
    """The mentions of a text (see mentions) as an array of structs."""
    this = F.lit(None).cast("string") if this is None else this
    known = "|".join(sorted((rf"{a}(?:\s*рф)?" for a in codes), key=len, reverse=True))
    table = F.create_map(*[F.lit(x) for a, c in codes.items() for x in (a.lower().replace(" ", "").replace(".", ""), c)])
    tail = rf"\s+({known}|{THIS}|{SAME})(?!\p{{L}})"
    patterns = {
        "article": rf"{FLAGS}{LEFT}(?:{ARTICLE})\s*({LIST})(?:\s+(?:{CHAPTER})\s*({NUMBER}))?{tail}",
        "chapter": rf"{FLAGS}{LEFT}(?<!\d\s)(?:{CHAPTER})\s*({LIST})(){tail}",
        "point": rf"{FLAGS}{LEFT}(?:{POINT})\s*({LIST})\s+{ACT}",
    }
    arrays = [bound(match_groups(t, p, 3), _placed(kind)) for kind, p in patterns.items()]
    found = F.array_sort(F.concat(*arrays))

    def code_of(at: Column, x: Column) -> Column:
        name = x["named"]
        return F.when(name.rlike(rf"{FLAGS}^{THIS}$"), this).when(name.rlike(rf"{FLAGS}^{SAME}$"), at).otherwise(F.try_element_at(table, _plain(name)))

    def codes_of(xs: Column) -> Column:
        return scan(xs, F.lit(None).cast("string"), code_of, lambda at, x: F.coalesce(code_of(at, x), at), "string")

    def each(z: Column, i: Column) -> Column:
        x, day = z["x"], F.try_to_date(z["x"]["day"], "dd.MM.yyyy")
        one = lambda n: F.struct((i + 1).alias("ord"), x["kind"].alias("kind"), n.alias("number"), x["chapter"].alias("chapter"), z["code"].alias("code"), day.alias("day"), x["act_number"].alias("act_number"))
        return F.when(z["code"].isNotNull() | day.isNotNull(), F.transform(numbers_of(x["list"]), one)).otherwise(F.array().cast(MENTIONS))

    def all_of(xs: Column) -> Column:
        return F.when(F.size(xs) > 0, F.flatten(F.transform(F.arrays_zip(xs.alias("x"), codes_of(xs).alias("code")), each)))

    return F.when(t.isNotNull(), bound(found, all_of))


def resolve(queries: DataFrame, text_col: str, codes: Mapping[str, str], sections: DataFrame, acts: DataFrame, gaps: DataFrame) -> DataFrame:
    """queries with kind, number, chapter, code, status: the first mention of a
    text, points before chapters before articles.

    sections: code, kind, number, chapter, repealed, body_chars; acts: code (that
    their points are sections of), day, act_number; gaps: code, number (articles
    known to be missing from the sections). status: unparsed; unknown_act;
    ambiguous_date (several acts of the day, no number given); not_exported (a
    code without sections); known_missing; missing; repealed; heading_only (a
    chapter with a body under 40 characters); found. Numbers match as a whole.
    An alias that codes lack isn't recognised: unparsed."""
    def ranked(m: Column) -> Column:
        rank = F.when(m["kind"] == "point", 1).when(m["kind"] == "chapter", 2).otherwise(3)
        return F.struct(rank.alias("r"), m["ord"].alias("ord"), F.struct(*[m[c].alias(c) for c in ("kind", "number", "chapter", "code", "day", "act_number")]).alias("m"))

    least = F.array_min(F.transform(mentioned(F.col(text_col), codes), ranked))["m"]
    first = queries.select(F.struct(*queries.columns).alias("__q"), as_row(least, "m")).select("__q", "m.*")
    days = acts.groupBy("day").agg(F.count("*").alias("n_acts"), F.min("code").alias("only"))
    exact = acts.groupBy("day", F.col("act_number").cast("string").alias("act_number")).agg(F.min("code").alias("exact"))
    rows = first.join(broadcast_if_small(days, 1_000_000), "day", "left").join(broadcast_if_small(exact, 1_000_000), ["day", "act_number"], "left")
    point = F.col("kind") == "point"
    act = F.when(F.col("act_number").isNotNull(), F.col("exact")).when(F.col("n_acts") == 1, F.col("only"))
    rows = rows.withColumn("code", F.when(point, act).otherwise(F.col("code")))
    exported = sections.select("code").distinct().withColumn("exported", F.lit(True))
    own = sections.select("code", "kind", "number", F.col("chapter").cast("string").alias("in_chapter"), "repealed", "body_chars", F.lit(True).alias("there"))
    lost = gaps.select("code", "number").distinct().withColumn("lost", F.lit(True))
    rows = rows.join(exported, "code", "left").join(own, ["code", "kind", "number"], "left").join(lost, ["code", "number"], "left")
    there = F.coalesce(F.col("there"), F.lit(False)) & (F.col("chapter").isNull() | F.col("chapter").eqNullSafe(F.col("in_chapter")))
    status = (
        F.when(F.col("kind").isNull(), "unparsed").when(point & F.col("act_number").isNull() & (F.col("n_acts") > 1), "ambiguous_date").when(point & F.col("code").isNull(), "unknown_act").when(F.col("exported").isNull(), "not_exported")
        .when((F.col("kind") == "article") & F.col("lost"), "known_missing").when(~there, "missing").when(F.col("repealed"), "repealed").when((F.col("kind") == "chapter") & (F.col("body_chars") < 40), "heading_only").otherwise("found")
    )
    rows = rows.select("__q", "kind", "number", "chapter", "code", status.alias("status"))
    return rows.select("__q.*", "kind", "number", "chapter", "code", "status")


def reference_edges(nodes: DataFrame, text_col: str, codes: Mapping[str, str], targets: DataFrame) -> DataFrame:
    """source, target, relation: from nodes (id, code, a text) to the nodes that
    they name; targets: id, code, kind, number. Lists and ranges give an edge a
    number; `this code` is the node's own; edges to oneself, to nothing and
    repeated ones are left out."""
    found = mentions(nodes.select(F.col("id").alias("source"), F.col("code").alias("own"), text_col), text_col, codes, "own").filter("code is not null")
    hits = found.join(targets.select("code", "kind", "number", F.col("id").alias("target")), ["code", "kind", "number"])
    return hits.filter("source <> target").select("source", "target", F.lit("references").alias("relation")).distinct()
