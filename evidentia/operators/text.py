"""Operators over texts: lines, sections, tables, typed values, findings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions.arrays import as_row, bound, replace_matches
from evidentia.sources.shared import broadcast_if_small

#: Patterns of typed values: kind -> expression; group 1 is the value where there is one.
TYPED = {
    "email": r"([A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9])",
    "ipv4": r"\b([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\b",
    "card": r"\b([0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4})\b",
    "phone": r"(\+[0-9]{1,2} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|\([0-9]{3}\) [0-9]{3}-[0-9]{4})",
}


def extract_typed(df: DataFrame, id_col: str, text_col: str, patterns: Mapping[str, str] = TYPED, most: int = 50) -> DataFrame:
    """id, kind, value, ord: distinct values of each kind in order of first
    sight, white space squeezed, at most `most` a kind."""
    found = []
    for kind, pattern in patterns.items():
        values = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1)), lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")))
        kept = F.slice(F.array_distinct(values), 1, most)
        found.append(F.transform(kept, _numbered(kind)))
    return df.select(id_col, F.inline(F.concat(*found)))


def _numbered(kind: str):
    return lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), (i + 1).cast("int").alias("ord"))


def text_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no (from 1), line."""
    return df.select(id_col, F.posexplode(T.lines(text_col)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def grep_lines(df: DataFrame, id_col: str, text_col: str, pattern: str, cap: int = 400) -> DataFrame:
    """Matching lines with their numbers, the first `cap` of each text, and the
    true number of hits."""
    hits = text_lines(df, id_col, text_col).filter(F.col("line").rlike("(?i)" + pattern))
    own = Window.partitionBy(id_col)
    hits = hits.withColumn("hits", F.count(F.lit(1)).over(own)).withColumn("rn", F.row_number().over(own.orderBy("line_no")))
    return hits.filter(F.col("rn") <= cap).drop("rn")


def line_findings(df: DataFrame, id_col: str, text_col: str, patterns: Mapping[str, str], blank: str | None = None) -> DataFrame:
    """id, line_no, category, n for lines that match; the value is not shown.
    `blank` matches are overwritten first (digests, say)."""
    text = F.regexp_replace(F.col(text_col), blank, "#") if blank else F.col(text_col)
    rows = text_lines(df.select(id_col, text.alias("t")), id_col, "t")
    counts = F.array(*[F.struct(F.lit(k).alias("category"), F.regexp_count("line", F.lit(p)).alias("n")) for k, p in patterns.items()])
    return rows.select(id_col, "line_no", F.inline(counts)).filter("n > 0")


def number_tokens(df: DataFrame, id_col: str, text_col: str, min_digits: int = 2) -> DataFrame:
    """id, token, n: numbers in canonical form (group spaces removed, decimal
    comma as a dot) with at least min_digits digits. Numbers after a number
    sign are taken whole first."""
    labelled = r"(?:№|No\.?) ?([0-9]+(?:[-/][0-9]+)*)"
    own = F.regexp_extract_all(F.col(text_col), F.lit(labelled), F.lit(1))
    rest = F.regexp_replace(F.col(text_col), labelled, " # ")
    general = F.regexp_extract_all(rest, F.lit(r"([0-9]{1,3}(?:[ \x{A0}\x{202F}][0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?)"), F.lit(1))
    tokens = F.transform(F.concat(own, general), lambda t: F.translate(F.regexp_replace(t, r"[ \x{A0}\x{202F}]", ""), ",", "."))
    rows = df.select(id_col, F.explode(F.filter(tokens, lambda t: F.length(F.regexp_replace(t, "[^0-9]", "")) >= min_digits)).alias("token"))
    return rows.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"))


def apply_rules(df: DataFrame, id_col: str, text_col: str, rules: DataFrame, most_rules: int = 10_000) -> DataFrame:
    """rules: rule_id, expect (present or absent), terms array. One finding for
    each text and rule that is broken: an expected term of none is there, or a
    forbidden one is. rules are written by hand (most_rules at most, else an
    error), so they travel as one array and each text is judged in one pass."""
    if rules.limit(most_rules + 1).count() > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    one = rules.agg(F.collect_list(F.struct("rule_id", "expect", "terms")).alias("__rules"))
    low = F.lower(F.col(text_col))

    def broken(r: Column) -> Column:
        there = F.exists(r["terms"], lambda t: F.contains(F.col("low"), F.lower(t)))
        return ((r["expect"] == "present") & ~there) | ((r["expect"] == "absent") & there)

    rows = df.select(id_col, low.alias("low")).crossJoin(F.broadcast(one)).select(id_col, F.inline(F.filter("__rules", broken)))  # one row
    return rows.select(id_col, "rule_id", "expect", T.finding_id("rule_id", F.col(id_col).cast("string")).alias("finding_id"))


def suppress(findings: DataFrame, suppressions: DataFrame, kept_kind: str) -> DataFrame:
    """findings: finding_id, kind, ...; suppressions: finding_id, reason. A
    suppressed finding goes, except of kept_kind: it stays and a second row of
    kind suppressed_<kind> is added."""
    rows = findings.join(suppressions.select("finding_id", F.lit(True).alias("hit")).distinct(), "finding_id", "left")
    kinds = F.when(F.col("hit").isNull(), F.array("kind")).when(F.col("kind") == kept_kind, F.array("kind", F.concat(F.lit("suppressed_"), "kind")))
    return rows.withColumn("kind", F.explode(kinds)).drop("hit")


def has_marker(df: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """id, marked: whether a line of its own outside code fences is the marker,
    not quoted, struck or negated."""
    rows = text_lines(df, id_col, text_col)
    order = Window.partitionBy(id_col).orderBy("line_no")
    rows = rows.withColumn("fences", F.sum(F.col("line").startswith("```").cast("int")).over(order))
    hit = (F.col("fences") % 2 == 0) & F.col("line").rlike(pattern) & ~F.col("line").rlike(r"^\s*(>|~~|<!--)") & ~F.col("line").rlike(r"(?i)\b(not|no)\b")
    return rows.groupBy(id_col).agg(F.bool_or(hit).alias("marked"))


def placeholders(df: DataFrame, id_col: str, text_col: str, vocabulary: list[str]) -> DataFrame:
    """id, slot: bracketed one to six words, all of the vocabulary."""
    slots = F.regexp_extract_all(F.col(text_col), F.lit(r"[\[(]([^\[\]()]+)[\])]"), F.lit(1))
    known = F.array(*[F.lit(w) for w in vocabulary])

    def empty(s: Column) -> Column:
        w = T.words(F.lower(s))
        return F.size(w).between(1, 6) & ~s.rlike("[0-9:]") & F.forall(w, lambda x: F.array_contains(known, x))

    return df.select(id_col, F.explode(F.array_distinct(F.filter(slots, empty))).alias("slot"))


def subject_label(df: DataFrame, id_col: str, text_col: str, hints: Mapping[str, tuple[str, int]]) -> DataFrame:
    """id, label, n: the label whose stem occurs most, where it reaches its
    least number; the first named wins ties."""
    low = F.lower(F.col(text_col))
    items = [F.struct(F.regexp_count(low, F.lit(stem)).alias("n"), F.lit(-i).alias("rank"), F.lit(label).alias("label"), F.lit(least).alias("least")) for i, (label, (stem, least)) in enumerate(hints.items())]
    best = F.array_max(F.filter(F.array(*items), lambda x: x["n"] >= x["least"]))
    return df.select(id_col, best["label"].alias("label"), best["n"].alias("n"))


def dictionary_hits(df: DataFrame, id_col: str, text_col: str, names: DataFrame, name_col: str, least: int = 5) -> DataFrame:
    """id, name, n: names of `least` and more characters found as whole runs of
    words, with -, _ and spaces alike. Names and texts are cut into word runs of
    the names' lengths and joined on equality."""
    norm = names.select(F.col(name_col).alias("name"), T.norm_words(name_col).alias("key")).filter(F.length("key") >= least).distinct()
    sizes = [r[0] for r in norm.select(F.size(F.split("key", " ")).alias("w")).distinct().orderBy("w").collect()]  # a handful of word counts
    tokens = df.select(id_col, F.split(T.norm_words(text_col), " ").alias("tw"))

    def runs(w: int) -> Column:
        return F.when(F.size("tw") >= w, F.transform(F.sequence(F.lit(1), F.size("tw") - (w - 1)), lambda i: F.array_join(F.slice(F.col("tw"), i, w), " "))).otherwise(F.array().cast("array<string>"))

    keys = F.concat(*[runs(w) for w in sizes]) if sizes else F.array().cast("array<string>")
    rows = tokens.select(id_col, as_row(keys, "keys")).select(id_col, F.explode("keys").alias("key"))
    # Runs that are no name go before runs are counted, so they are not shuffled.
    rows = rows.join(broadcast_if_small(norm.select("key").distinct(), 1_000_000), "key", "left_semi")
    counts = rows.groupBy(id_col, "key").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(norm, "key").select(id_col, "name", "n")


def harvest(df: DataFrame, id_col: str, group_col: str, text_col: str, pattern: str, least_groups: int = 2, around: int = 20) -> DataFrame:
    """key, mentions, groups, first_id, context, rank: matches of a pattern that
    at least least_groups groups have, most groups first, then most mentions,
    then by key. context is what stands around the first place in the text of
    the least id. The rank is over keys, in one task, after they are counted."""
    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("g"), text.alias("t"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("key"))
    rows = rows.withColumn("c", F.substring("t", F.greatest(F.instr("t", F.col("key")) - around, F.lit(1)), F.lit(2 * around)))
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("g").alias("groups"), F.min("id").alias("first_id"), F.min_by("c", "id").alias("context")).filter(F.col("groups") >= least_groups)
    return keys.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("groups"), F.desc("mentions"), "key")))


def sections(df: DataFrame, id_col: str, text_col: str, heading: str) -> DataFrame:
    """id, section, head, n_lines, first_line: text cut at heading lines; what
    stands before the first one is section 0 and kept."""
    rows = text_lines(df, id_col, text_col)
    order = Window.partitionBy(id_col).orderBy("line_no")
    rows = rows.withColumn("section", F.sum(F.col("line").rlike(heading).cast("int")).over(order))
    return rows.groupBy(id_col, "section").agg(F.min_by("line", "line_no").alias("head"), F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))


def nested_sections(df: DataFrame, id_col: str, text_col: str, marks: str = r"^(#{1,6}) ") -> DataFrame:
    """id, first_line, level, head, last_line: a section for each heading, whose
    level is the length of group 1 of marks (six at most). It ends before the
    next heading of the same or a higher level, so deeper ones lie inside. What
    stands before the first heading is a section of level 0."""
    rows = text_lines(df, id_col, text_col)
    level = F.length(F.regexp_extract("line", marks, 1))
    rows = rows.withColumn("level", F.when(level > 0, level))
    order = Window.partitionBy(id_col).orderBy("line_no")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    last = F.max("line_no").over(Window.partitionBy(id_col))
    ends = F.coalesce(*[F.when(F.col("level") == v, F.min(F.when(F.col("level") <= v, F.col("line_no"))).over(after)) for v in range(1, 7)])
    first = F.min(F.when(F.col("level").isNotNull(), F.col("line_no"))).over(after)
    rows = rows.withColumn("last_line", F.coalesce(F.when(F.col("level").isNull(), first).otherwise(ends) - 1, last))
    rows = rows.filter((F.col("level").isNotNull()) | (F.col("line_no") == 1))
    return rows.select(id_col, F.col("line_no").alias("first_line"), F.coalesce("level", F.lit(0)).alias("level"), F.when(F.col("level").isNotNull(), F.regexp_replace("line", marks, "")).alias("head"), "last_line")


def governing_heading(df: DataFrame, id_col: str, text_col: str, heading: str) -> DataFrame:
    """Each non-heading line with the last heading above it in its text."""
    rows = text_lines(df, id_col, text_col)
    order = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.when(F.col("line").rlike(heading), F.col("line"))
    return rows.withColumn("is_head", F.col("line").rlike(heading)).withColumn("head", F.last(head, True).over(order)).filter("not is_head").drop("is_head")


def scope_rows(df: DataFrame, id_col: str, text_col: str, heading: str, wanted: str) -> DataFrame:
    """Lines between a wanted heading and the next heading."""
    return governing_heading(df, id_col, text_col, heading).filter(F.col("head").rlike(wanted))


def pipe_tables(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no, headers, cells of each row of a pipe table: a run of lines
    with pipes, whose first line is the header; rules are skipped."""
    rows = text_lines(df, id_col, text_col)
    order = Window.partitionBy(id_col).orderBy("line_no")
    piped = F.contains("line", F.lit("|"))
    rows = rows.withColumn("island", F.sum((~piped).cast("int")).over(order)).filter(piped & ~F.col("line").rlike(r"^[\s|:-]+$"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|", -1), lambda c: F.trim(c))
    rows = rows.withColumn("cells", cells)
    run = Window.partitionBy(id_col, "island").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("headers", F.first("cells").over(run)).withColumn("rn", F.row_number().over(Window.partitionBy(id_col, "island").orderBy("line_no")))
    return rows.filter("rn > 1").select(id_col, "line_no", "headers", "cells")


def doc_meta(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, title, number, edition: from the page title; ? without an edition."""
    title = F.regexp_extract(F.col(html_col), r"<title>([^<]*)</title>", 1)
    number = F.nullif(F.regexp_extract(title, r"(?:№|No\.?) ?([0-9A-Za-z-]+)", 1), F.lit(""))
    edition = F.coalesce(F.nullif(F.regexp_extract(title, r"([0-9]{2}\.[0-9]{2}\.[0-9]{4})", 1), F.lit("")), F.lit("?"))
    return df.select(id_col, title.alias("title"), number.alias("number"), edition.alias("edition"))


#: Stock phrases of injected instructions: category -> expression.
INJECTION = {
    "override": r"(?i)(ignore|disregard|forget) (all |any )?(previous|prior|above) (instructions|rules|messages)",
    "role": r"(?i)you are now|act as (an?|the) |pretend to be",
    "leak": r"(?i)(reveal|print|show) (your|the) (system )?(prompt|instructions)",
    "insult": r"(?i)\b(idiot|moron|worthless|scum)\b",
}
#: The same in Russian, and a role called to and told what to do (fixed values).
ROLES = "ассистент|нейросеть|модель|бот|клод|assistant|system|model"
COMMANDS = "выполни|игнорируй|забудь|перепиши|раскрой|отправь|удали|составь|выдай|покажи|сделай|напиши|измени|скачай|delete|remove|send|ignore|forget|reveal|write|run|execute"
INJECTION_RU = {
    "override": r"(?iuU)\b(?:игнорируй(?:те)?|забудь(?:те)?|отмени(?:те)?|не\s+учитывай(?:те)?)[\s,—-]+(?:[а-яё]+\s+){0,3}(?:инструкц|указан|правил|сообщени|протокол|предписан|ограничен)\w*",
    "role": r"(?iuU)\bс\s+этого\s+момента\s+ты\b|\bтвоя\s+новая\s+роль\b",
    "vocative": rf"(?iumU)(?:^|[.!?:;,]\s*)(?:уважаем(?:ый|ая)\s+)?(?:{ROLES})\b\s*[,!:—-]+\s*(?:пожалуйста[,\s]+)?(?:{COMMANDS})\b",
    "command": rf"(?ius)(?:^|[.!?:;]\s*)(?:{COMMANDS})(?![\p{{L}}]).{{0,120}}?[,!:—-]+\s*(?:{ROLES})(?![\p{{L}}])",
    "header": r"(?imu)^\s*(?:system\s*(?:prompt\s*)?:|новые\s+инструкции\s*[:—-]|important\s+for\s+ai\s*:)",
}


def unfold(text: Column) -> Column:
    """A text as a reader takes it, for pattern_flags: mojibake of UTF-8 read as
    Latin-1 mended where that gives more Cyrillic letters, texts of alt and title
    attributes kept and tags dropped, invisible characters dropped, words that
    are broken over lines joined, marks of lists and headings dropped, and
    words spelt with dots or spaces (three letters and more) joined."""
    def mended(x: Column) -> Column:
        again = F.decode(F.encode(x, "ISO-8859-1"), "UTF-8")
        torn = x.rlike("[ÐÑÂ]") & ~x.rlike(r"[^\x{00}-\x{FF}]") & (F.regexp_count(again, F.lit("[А-Яа-яЁё]")) > F.regexp_count(x, F.lit("[А-Яа-яЁё]")))
        return F.when(torn, again).otherwise(x)

    t = bound(text, mended)
    t = F.regexp_replace(t, r"""(?is)\b(?:alt|title|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)')""", "> $1$2 <")
    t = F.regexp_replace(F.regexp_replace(t, "<!--|-->", " "), r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"[\p{Cf}]", "")
    t = F.regexp_replace(t, r"(\p{L})[-‐‑‒–—]\s*\n\s*(\p{L})", "$1$2")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(?:[-*+>]+[ \t]+|#{1,6}[ \t]+)+", "")
    t = replace_matches(t, r"(?<!\p{L})(?:\p{L}\.){3,}", lambda m: F.replace(m, F.lit("."), F.lit("")))
    return replace_matches(t, r"(?<!\p{L})(?:\p{L}\s+){3,}\p{L}(?!\p{L})", lambda m: F.regexp_replace(m, r"\s+", ""))


def pattern_flags(text: Column, patterns: Mapping[str, str]) -> Column:
    """Names of the patterns that match, in order of the table."""

    def of(t: Column) -> Column:
        return F.filter(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())

    return bound(text, of)  # however the text is computed, it is so once


def speaker_of(df: DataFrame, id_col: str, text_col: str, names: list[str]) -> DataFrame:
    """id, speaker: a leading [Name], else the longest known name in the text."""
    ranked = sorted(names, key=lambda n: (-len(n), n))
    known = F.coalesce(*[F.when(F.contains(F.lower(F.col(text_col)), F.lit(n.lower())), F.lit(n)) for n in ranked])
    return df.select(*([id_col] if isinstance(id_col, str) else id_col), F.coalesce(F.nullif(F.regexp_extract(F.col(text_col), r"^\[([^\]]+)\]", 1), F.lit("")), known).alias("speaker"))
