"""Text and links of HTML by column functions: tags as tokens, a stack over them.

Subtrees end where they end: a nested nav does not end the outer one, and an
unclosed one ends with the element that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.arrays import bound, replace_matches, scan

#: Elements without text of the page, elements that are kept on the
#: stack, and those whose start and end part paragraphs.
RAW = "script|style|template|noscript|textarea|title"
SKIPPED = ["nav", "footer", "aside", "header", "form", "button", "select", "dialog", "menu", "iframe", "svg", "object"]
BLOCKS = ["p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "blockquote", "pre", "figure", "figcaption", "address", "hr", "details", "summary", "center", "body", "html", "head"]
CELLS = ["td", "th"]
FRAMED = [*SKIPPED, *BLOCKS, *CELLS]
#: Named character references.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&", "laquo": "«", "raquo": "»", "ndash": "–", "mdash": "—", "hellip": "…", "copy": "©", "reg": "®", "sect": "§", "deg": "°", "middot": "·", "bull": "•", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bdquo": "„", "times": "×", "euro": "€", "shy": "­"}
ATTRIBUTES = r"""(?:[^'"<>]++|"[^"]*+"|'[^']*+')*+"""
TAG = rf"</?[A-Za-z]{ATTRIBUTES}>"
TOKEN = rf"{TAG}|</?[A-Za-z][^<>]*+>|<[!?][^>]*+>|[^<]++|<"


def decoded(text: Column) -> Column:
    """Character references as characters, each once; unknown ones stay."""

    def of(ref: Column) -> Column:
        body = F.lower(F.regexp_extract(ref, r"^&#?([0-9A-Za-z]+);?$", 1))
        number = F.when(body.rlike("^x[0-9a-f]{1,6}$"), F.conv(F.substring(body, 2, 6), 16, 10)).when(body.rlike("^[0-9]{1,7}$"), body).cast("int")
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        code = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, F.lit("0").cast("string"))), "UTF-32"))
        named = F.lit(None).cast("string")
        for name, value in NAMED.items():
            named = F.when(F.regexp_extract(ref, r"^&([A-Za-z]+);$", 1) == name, F.lit(value)).otherwise(named)
        return F.coalesce(F.when(ref.startswith("&#"), code).otherwise(named), ref)

    return F.when(F.contains(text, F.lit("&")), replace_matches(text, r"&#?[0-9A-Za-z]{1,31};", of)).otherwise(text)


def _tokens(html: Column) -> Column:
    """Tags and stretches of text; comments and raw elements are dropped, to the
    end of the page where they are not closed."""
    t = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    t = F.regexp_replace(t, rf"(?is)<({RAW})\b[^>]*>.*?(?:</\1\s*>|\z)", "")
    return F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))


def html_text(html: Column) -> Column:
    """Text of HTML without boilerplate subtrees (SKIPPED) and raw elements.

    Blocks begin and end lines, br ends one, cells end with a tab; blanks are
    squeezed, lines without text dropped, references decoded. An end tag closes
    what is open inside its element, and means nothing where that isn't open; a
    paragraph or list item that begins closes one that is open above it. Null
    gives null, a page without text an empty text."""

    def parts(x: Column) -> Column:
        name = F.lower(F.regexp_extract(x, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
        end, alone = x.startswith("</"), x.endswith("/>")
        return F.struct(x.alias("x"), F.when(name.isin(*FRAMED, "br"), name).otherwise("").alias("name"), end.alias("end"), alone.alias("alone"))

    def move(at: Column, t: Column) -> Column:
        stack, skip, name = at["stack"], at["skip"], t["name"]
        # Of a repeated name the last one: counted from the end of the stack.
        back = F.array_position(F.reverse(stack), name)
        popped = F.slice(stack, 1, F.when(back > 0, F.size(stack) - back.cast("int")).otherwise(F.size(stack)))
        implied = name.isin("p", "li") & F.coalesce(F.try_element_at(stack, F.lit(-1)) == name, F.lit(False))
        opened = F.concat(F.when(implied, F.slice(stack, 1, F.size(stack) - 1)).otherwise(stack), F.array(name))
        void = name.isin("", "br", "hr") | (t["alone"] & ~t["end"])
        new = F.when(void, stack).when(t["end"], popped).otherwise(opened)
        return bound(new, lambda s: F.struct(s.alias("stack"), F.when((skip > 0) & (F.size(s) >= skip), skip).when(~void & ~t["end"] & name.isin(*SKIPPED), F.size(s)).otherwise(0).alias("skip")))

    def emit(at: Column, t: Column) -> Column:
        name = t["name"]
        tag = F.when(name == "", F.when(t["x"].rlike(r"^<[/A-Za-z!?]"), "").otherwise(F.regexp_replace(t["x"], r"[\n\r\t\f ]+", " ")))
        tag = tag.when(name.isin(*CELLS), F.when(t["end"], "\t").otherwise("")).otherwise("\n")
        return F.when(at["skip"] > 0, "").otherwise(tag)

    first = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(0).alias("skip"))
    text = F.array_join(scan(F.transform(_tokens(html), parts), first, emit, move, "string"), "")
    text = F.regexp_replace(F.regexp_replace(decoded(text), r"[\x{A0} ]+", " "), r" ?\t ?", "\t")
    text = F.regexp_replace(F.regexp_replace(text, r" ?\t[ \t]*(?=\n|$)", ""), r" ?\n[ \n]*", "\n")
    return F.when(html.isNotNull(), F.btrim(text, F.lit(" \n\t")))


def html_links(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, ord, href, label of links, the first of each href: attributes in any
    order and quotes or none, tags inside the label dropped, references decoded,
    blanks squeezed. Anchors without an href are no links; an unclosed anchor
    ends where the next begins. ord counts the links of the page from 1."""
    t = F.regexp_replace(F.col(html_col), r"(?s)<!--.*?(?:-->|\z)", "")
    t = F.regexp_replace(t, r"(?is)<(script|style|template|textarea)\b[^>]*>.*?(?:</\1\s*>|\z)", "")
    anchors = F.regexp_extract_all(t, F.lit(rf"(?is)<a\s{ATTRIBUTES}>.*?(?=</a\s*>|<a\s|\z)"), F.lit(0))

    def link(a: Column) -> Column:
        tag = F.regexp_extract(a, rf"(?is)^<a(\s{ATTRIBUTES})>", 1)
        one = F.lit(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]+))?""")
        place = F.array_position(F.transform(F.regexp_extract_all(tag, one, F.lit(1)), F.lower), "href")
        value = F.get(F.regexp_extract_all(tag, one, F.lit(2)), (place - 1).cast("int"))
        has, href = place > 0, F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")
        label = F.regexp_replace(F.regexp_replace(a, rf"(?is)^<a\s{ATTRIBUTES}>", ""), rf"{TAG}|<[!?][^>]*+>", "")
        return F.struct(has.alias("has"), F.trim(decoded(href)).alias("href"), F.trim(F.regexp_replace(decoded(label), r"[\s\x{A0}]+", " ")).alias("label"))

    found = F.filter(F.transform(anchors, link), lambda x: x["has"])
    rows = df.select(id_col, F.posexplode(found).alias("ord", "x")).select(id_col, (F.col("ord") + 1).alias("ord"), "x.href", "x.label")
    return rows.groupBy(id_col, "href").agg(F.min("ord").alias("ord"), F.min_by("label", "ord").alias("label"))


def front_matter(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, field, ord, value of the fields between leading --- lines: a scalar,
    a list in brackets, or a list of indented `- item` lines. Quotes around a
    value are dropped; a field with nothing has an empty value."""
    head = F.regexp_extract(F.regexp_replace(F.col(text_col), "\r\n?", "\n"), r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    field = r"(?m)^([\p{L}_][\p{L}\p{N}_-]*):[ \t]*([^\n]*)((?:\n[ \t]+-(?:[ \t][^\n]*)?(?=\n|\z))*)"
    groups = [F.regexp_extract_all(head, F.lit(field), F.lit(i)).alias(n) for i, n in ((1, "field"), (2, "value"), (3, "items"))]
    rows = df.select(id_col, F.inline(F.arrays_zip(*groups)))

    def bare(v: Column) -> Column:
        return F.regexp_replace(F.trim(v), r"""(?s)^(["'])(.*)\1$""", "$2")

    value = F.trim("value")
    items = F.regexp_extract_all("items", F.lit(r"\n[ \t]+-[ \t]?([^\n]*)"), F.lit(1))
    inside = F.regexp_extract_all(F.regexp_replace(value, r"^\[|\]$", ""), F.lit(r"""\s*(?:"[^"]*"|'[^']*'|[^\s,"'][^,]*)"""), F.lit(0))
    values = F.when((value == "") & (F.size(items) > 0), items).when(value.rlike(r"^\[.*\]$"), inside).otherwise(F.array(value))
    return rows.select(id_col, "field", F.posexplode(F.transform(values, bare)).alias("ord", "value"))
