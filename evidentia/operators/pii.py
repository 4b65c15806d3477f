"""Personal data: spans, masking with a way back, and a gate on what is left."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import pii_patterns as R
from evidentia.functions.arrays import bound, placed, replace_matches, scan

#: Category -> pattern, in order of priority.
CATEGORIES = {
    "EMAIL": r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]",
    "PHONE": r"\+[0-9]{1,2} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|\([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "CARD": r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}",
    "IP": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
}
#: Matches that are no finding: amounts of money, and mask tokens themselves.
VETO = r"^0+$"
#: What stands for a found value while others are looked for; in no pattern.
TAKEN = "|"
#: Looser patterns of the last gate.
LOOSE = {"AT": r"[^\s@]+@[^\s@]+\.[a-z]{2,}", "DIGITS": r"[0-9]{12,}"}
SPANS = "array<struct<s:int,e:int,cat:string>>"


def find_spans(text: Column, categories: dict[str, str] = CATEGORIES) -> Column:
    """All matches (s, e, cat), code points, vetoed ones left out. Categories go
    in order of priority, each over what the ones before have left, so that a
    match which begins inside an earlier one's doesn't hide what stands behind."""
    none = F.array().cast(SPANS)

    def blank(m: Column) -> Column:
        return F.when(m.rlike(VETO), m).otherwise(F.repeat(F.lit(TAKEN), F.length(m)))

    def of(at: Column, cat: str, pattern: str) -> Column:
        t = at["t"]
        found = F.filter(placed(t, pattern, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))), lambda m: ~m["t"].rlike(VETO))
        spans = F.transform(found, lambda m: F.struct(m["s"].cast("int").alias("s"), m["e"].cast("int").alias("e"), F.lit(cat).alias("cat")))
        more = F.struct(replace_matches(t, pattern, blank).alias("t"), F.concat(at["spans"], F.coalesce(spans, none)).alias("spans"))
        return F.when(t.rlike(pattern), more).otherwise(at)

    def after(out: Column, cat: str, pattern: str) -> Column:
        return bound(out, lambda at: of(at, cat, pattern))

    out = F.struct(text.alias("t"), none.alias("spans"))
    for k, p in categories.items():
        out = after(out, k, p)
    return out["spans"]


#: A masked value, of either kind of mask.
TOKEN = r"\{\{PII:[А-ЯЁA-Z]+:[0-9]+\}\}"


def case_file_spans(text: Column) -> Column:
    """All matches (s, e, cat) of the categories of case files, in order of
    priority, without impersonal words for parties, parts of institutions'
    names, amounts of money that look like a passport, and anything inside a
    mask token. Patterns that need a Cyrillic letter, or what NEEDS says, are
    tried only on texts that have it."""
    none = F.array().cast(SPANS)
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    parts = F.arrays_zip(F.split(text, TOKEN, -1).alias("g"), tokens.alias("m"))
    plain = F.when(F.size(tokens) > 0, F.array_join(F.transform(parts, lambda x: F.concat(x["g"], F.coalesce(F.repeat(F.lit(" "), F.length(x["m"])), F.lit("")))), "")).otherwise(text)

    def of(t: Column, cyrillic: Column, cat: str, nth: int, pattern: str) -> Column:
        grouped = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), pattern.replace(r"\G", ""))).groups > 0
        pattern = "(?U)" + pattern  # \\w, \\b and \\s as of all alphabets
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        spans = placed(t, pattern, found)
        if grouped:
            values = F.when(t.rlike(pattern), F.regexp_extract_all(t, F.lit(pattern), F.lit(1)))
            shift = lambda x: F.instr(x["m"]["t"], x["v"]) - 1
            spans = F.transform(F.arrays_zip(spans.alias("m"), values.alias("v")), lambda x: F.struct(x["v"].alias("t"), (x["m"]["s"] + shift(x)).alias("s"), (x["m"]["s"] + shift(x) + F.length(x["v"])).alias("e")))
        tail = lambda m, n: F.substring(t, m["e"] + 1, F.lit(n))
        if cat == "ФИО":
            spans = F.filter(spans, lambda m: ~F.lower(m["t"]).isin(*sorted(R.IMPERSONAL)) & ~tail(m, 60).rlike(R.INSTITUTION_TAIL))
            if nth == 2:
                spans = F.filter(spans, lambda m: ~F.lower(F.regexp_extract(m["t"], r"^\S+", 0)).isin(*sorted(R.COURT_WORDS)))
        if cat == "ПАСПОРТ":
            spans = F.filter(spans, lambda m: ~(m["t"].rlike("[ \\x{A0}\\x{202F}]") & tail(m, 16).rlike(R.MONEY_TAIL)))
        need = R.NEEDS.get((cat, nth))
        if (cat, nth) not in R.NEEDS:
            spans = F.when(cyrillic, spans)
        elif need:
            spans = F.when(t.rlike(f"(?U){need}"), spans)
        return F.coalesce(F.transform(spans, lambda m: F.struct(m["s"].cast("int").alias("s"), m["e"].cast("int").alias("e"), F.lit(cat).alias("cat"))), none)

    def every(t: Column) -> Column:
        return bound(t.rlike(r"\p{IsCyrillic}"), lambda c: F.concat(*[of(t, c, k, i, p) for k, patterns in R.CATEGORIES.items() for i, p in enumerate(patterns)]))

    return bound(F.coalesce(plain, F.lit("")), every)


def resolve_spans(spans: Column) -> Column:
    """By start, the longest first, of equal ones the first found; each span
    that overlaps none kept before."""
    return bound(spans, _resolved)


def _resolved(spans: Column) -> Column:
    ordered = F.transform(F.array_sort(F.transform(spans, lambda m, i: F.struct(m["s"], (-m["e"]).alias("x"), i, m["e"], m["cat"]))), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["cat"].alias("cat")))
    kept = scan(ordered, F.lit(0), lambda at, m: F.when(m["s"] >= at, m), lambda at, m: F.when(m["s"] >= at, m["e"]).otherwise(at), "struct<s:int,e:int,cat:string>")
    return F.when(F.size(spans) > 0, F.filter(kept, lambda m: m.isNotNull())).otherwise(F.array().cast(SPANS))


def mask(df: DataFrame, text_col: str, find=find_spans, token_form: str = "[{}_{}]") -> DataFrame:
    """df with spans, masked and mapping (token -> original). Without a finding
    masked is NULL, not the text: nothing was proved about it. find gives the
    spans of a text, of the names of categories (find_spans or case_file_spans)."""
    text = F.col(text_col)
    names = R.CATEGORIES if find is case_file_spans else CATEGORIES
    before, between, after = token_form.split("{}")

    def numbered(spans: Column, cat: str) -> Column:
        return F.transform(F.filter(spans, lambda m: m["cat"] == cat), lambda m, i: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.concat(F.lit(f"{before}{cat}{between}"), (i + 1).cast("string"), F.lit(after)).alias("token"), F.substring(text, m["s"] + 1, m["e"] - m["s"]).alias("original")))

    def replaced(spans: Column, tokens: Column) -> Column:
        at = F.concat(F.array(F.lit(0)), F.transform(tokens, lambda m: m["e"]))
        pieces = F.transform(F.arrays_zip(at.alias("at"), tokens.alias("t")), lambda z: F.concat(F.substring(text, z["at"] + 1, F.coalesce(z["t"]["s"], F.length(text)) - z["at"]), F.coalesce(z["t"]["token"], F.lit(""))))
        mapping = F.transform(tokens, lambda m: F.struct(m["token"].alias("token"), m["original"].alias("original")))
        return F.struct(spans.alias("spans"), F.when(F.size(spans) > 0, F.array_join(pieces, "")).alias("masked"), mapping.alias("mapping"))

    def build(spans: Column) -> Column:
        return bound(F.array_sort(F.concat(*[numbered(spans, c) for c in names])), lambda t: replaced(spans, t))

    # A generated row, so that whatever uses these columns, patterns run once.
    return df.drop("spans", "masked", "mapping").select("*", F.inline(F.array(bound(resolve_spans(find(text)), build))))


def unmask(masked: Column, mapping: Column) -> Column:
    return F.aggregate(mapping, masked, lambda t, m: F.replace(t, m["token"], m["original"]))


def residual_gate(masked: Column) -> Column:
    """(released, categories): any hit of the full or the looser patterns in a
    masked text blocks it; a NULL text is not released."""
    hits = F.filter(F.array(*[F.when(masked.rlike(p), F.lit(k)) for k, p in (CATEGORIES | LOOSE).items()]), lambda x: x.isNotNull())
    return F.struct((masked.isNotNull() & (F.size(hits) == 0)).alias("released"), hits.alias("categories"))


def scrub(col: Column, size: int = 180) -> Column:
    """Log sample: mail addresses, numbers of 12+ digits and paths blanked, cut."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(col, CATEGORIES["EMAIL"], "[EMAIL]"), "[0-9]{12,}", "[DIGITS]"), r"(?:/[A-Za-z0-9._-]+){2,}", "[PATH]")
    return F.left(t, F.lit(size))


def fold_confusables(texts: Column) -> Column:
    """NFKC, format characters dropped, and Cyrillic look-alikes in words with
    Latin letters folded to Latin (Spark has no normal forms, so Arrow batches)."""
    def run(s: pd.Series) -> pd.Series:
        import re
        import unicodedata

        fold = str.maketrans("АВЕКМНОРСТХаеорсух", "ABEKMHOPCTXaeopcyx")
        word = re.compile(r"\w*[A-Za-z]\w*")

        def one(t):
            if t is None:
                return None
            t = "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Cf")
            return word.sub(lambda m: m[0].translate(fold), t)

        return s.map(one)

    return F.pandas_udf(run, "string")(texts)
