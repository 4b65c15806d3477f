"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged into one tree of style nodes (a node is a
path of tags, classes and names). A node's importance is the entropy of how it
looks (its children's tags) and of what it holds (its text) over the host's
pages, times its weight. Branches of low importance are cut from each page.

A tree needs many pages with the same template, and boilerplate whose words
change from page to page looks important to it. So what a node says about
itself weighs its importance: tags, roles, classes and ids that name menus,
headers, footers, adverts, comments and so on weigh little, and what stands in
an article or main element weighs more. With the weights below a node that names
itself is always cut, as importance is one at most; a node without such a name
is judged by its entropies. Pages with equal texts count once, so that copies
don't make a text look unimportant.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import slices, stage
from evidentia.llm.url_filter import host_of

# Tags and names.
#: Elements that hold no text of the page: markup, media, and forms.
NO_TEXT = set("script style noscript template svg iframe object canvas audio video map form button select option textarea input fieldset title".split())
BAD_TAGS = set("nav aside footer dialog menu".split())
BLOCK_TAGS = set("html head body p div section article main header footer nav aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address form fieldset hr details summary center title dialog menu".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends open elements of these tags above the nearest holder.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
HOLDERS = set("ul ol dl table div section article main body html nav aside footer header td th blockquote".split())
BAD_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar tablist form".split())
BAD_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsors sponsored promo promos promotion promotions promoted cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups popover modal modals overlay "
    "menu menus nav navbar navigation navigations breadcrumb breadcrumbs sidebar sidebars aside rail footer footers header headers masthead topbar toolbar share sharing social related recommended recommendations newsletter subscribe subscription signup login "
    "comment comments commentlist reply replies disqus respond pagination pager widget widgets search skip copyright".split()
)
#: Of these, words that also name the head of an article.
HEAD_WORDS = set("header headers masthead banner".split())
#: Words that name no kind of content, so a name of them and bad words is bad.
NEUTRAL_WORDS = set("site page global top bottom left right upper lower fixed sticky main primary secondary outer inner wrap wrapper box bar block blocks container area region section sections zone slot unit list lists item items link links button buttons icons group grid row col column columns content body post posts article articles stories news feed form text title count thread the of js is has id class policy message messages media".split())
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Weights of importance: a name of boilerplate, and a place in an article or main element.
BAD_WEIGHT, MAIN_WEIGHT = 0.1, 4.0
SALTS = 64


def _says_bad(tag: str, attrs: dict, in_main: bool) -> bool:
    """Whether an element names itself as boilerplate. A class or id does where
    it has a bad word and all its others are bad or neutral: share-buttons is
    bad, social-history isn't. In an article words of HEAD_WORDS aren't bad."""
    if tag in BAD_TAGS or (tag == "header" and not in_main) or (attrs.get("role") or "").lower() in BAD_ROLES:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = NAME.findall(CAMEL.sub(" ", name).lower())
        bad = [w for w in words if w in BAD_WORDS and not (in_main and w in HEAD_WORDS)]
        if bad and words[0] not in ("no", "has", "with", "without") and all(w in BAD_WORDS or w in NEUTRAL_WORDS for w in words):
            return True
    return False


def _shown(tag: str, attrs: dict) -> bool:
    return not (tag in NO_TEXT or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or ""))


def _stable(text: str) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh64(text.encode("utf-8", "surrogatepass")).digest(), "big", signed=True)


class PageParser(HTMLParser):
    """Collects blocks (numbers of the style nodes of the open elements, the
    least weight of them, text) and for each style node its weight, its
    children's tags and its text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = []  # (tag, style node, least weight, in main, shown)
        self.blocks, self.text = [], []
        self.weight, self.shape, self.held = {}, {}, {}

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            chain = tuple(dict.fromkeys(x[1] for x in self.open))
            for node in chain:
                self.held.setdefault(node, []).append(text)
            self.blocks.append((chain, self.open[-1][2] if self.open else 1.0, text))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()
            for i in range(len(self.open) - 1, -1, -1):
                name = self.open[i][0]
                if name == "p" or name in ENDS.get(tag, ()):
                    del self.open[i:]
                    if name == "p":
                        break
                elif name in HOLDERS:
                    break
        if tag == "br":
            self.text.append(" ")
        if tag in VOID_TAGS:
            return
        attrs = dict(attrs)
        style = re.sub(r"\d+", "", f"{attrs.get('class') or ''}#{attrs.get('id') or ''}#{attrs.get('role') or ''}").lower()
        _, up, least, in_main, shown = self.open[-1] if self.open else ("", 0, MAIN_WEIGHT, False, True)
        in_main = in_main or tag in ("article", "main") or (attrs.get("role") or "").lower() == "main"
        weight = BAD_WEIGHT if _says_bad(tag, attrs, in_main) else MAIN_WEIGHT if in_main else 1.0
        node = _stable(f"{up}/{tag}.{style}~{weight}")
        self.weight[node] = weight
        self.shape.setdefault(up, []).append(tag)
        self.open.append((tag, node, min(least, weight), in_main, shown and _shown(tag, attrs)))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID_TAGS:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag not in BLOCK_TAGS and any(x[0] in BLOCK_TAGS for x in self.open[i + 1 :]):
                    return  # an inline end tag doesn't end blocks
                del self.open[i:]
                return

    def parse_marked_section(self, i, report=1):
        """<![CDATA[ with its end as in html.parser; any other <![ goes up to
        the next >, as a bogus comment (html.parser raises on unknown words)."""
        if self.rawdata[i : i + 9].upper() == "<![CDATA[":
            return super().parse_marked_section(i, report)
        return self.parse_bogus_comment(i, report)

    def handle_data(self, data):
        if not self.open or self.open[-1][4]:
            self.text.append(data)


def parse_page(html: str | None) -> PageParser:
    page = PageParser()
    page.feed(html or "")
    page.close()
    page.flush()
    return page


NODES = "array<struct<path:bigint,weight:double,shape:bigint,held:bigint>>"
BLOCKS = "array<struct<chain:array<bigint>,text:string>>"
_NODE = pa.list_(pa.struct([("path", pa.int64()), ("weight", pa.float64()), ("shape", pa.int64()), ("held", pa.int64())]))
_BLOCK = pa.list_(pa.struct([("chain", pa.list_(pa.int64())), ("text", pa.string())]))


def _trees(batches):
    for b in batches:
        for part in slices([b], b.num_columns - 1, 1_000_000):
            nodes, blocks, texts = [], [], []
            for html in part.column(part.num_columns - 1).to_pylist():
                page = parse_page(html)
                best = max((x[1] for x in page.blocks), default=0)
                texts.append(_stable("\n".join(x[2] for x in page.blocks if x[1] == best)))
                blocks.append([{"chain": chain, "text": text} for chain, _, text in page.blocks])
                nodes.append([{"path": p, "weight": page.weight[p], "shape": _stable(" ".join(page.shape.get(p, ()))), "held": _stable("\n".join(t))} for p, t in page.held.items()])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(nodes, _NODE), pa.array(blocks, _BLOCK), pa.array(texts, pa.int64())], [*part.schema.names[:-1], "__nodes", "__blocks", "__text"])


def style_tree(nodes: DataFrame, look: float = 0.1, doubt: float = 0.5) -> DataFrame:
    """nodes: host, path, weight, shape, held, a row for each page and style
    node. Returns host, path, pages, importance: look * entropy of shape + (1 -
    look) * entropy of held, each over its greatest value, log(pages), times the
    node's weight. Few pages say little, so the entropies count as if `doubt`
    more pages had the value 1."""

    def entropy(column: str) -> DataFrame:
        n = nodes.groupBy("host", "path", column).agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("weight"))
        total = n.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"), F.min("weight").alias("weight"))
        return total.select("host", "path", "pages", "weight", F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).otherwise(1.0).alias(f"e_{column}"))

    both = entropy("shape").join(entropy("held").drop("pages", "weight"), ["host", "path"])
    own = look * F.col("e_shape") + (1 - look) * F.col("e_held")
    return both.select("host", "path", "pages", (F.col("weight") * (F.col("pages") * own + doubt) / (F.col("pages") + doubt)).alias("importance"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_importance: float = 0.2, broadcast_nodes: int = 1_000_000) -> DataFrame:
    """pages with text: the main text, blocks in page order joined by a line
    feed, white space inside a block as one space, character references decoded.

    Style nodes of a host with an importance under least_importance are cut,
    with all below. Pages of a host with equal main text (that of the blocks
    with the greatest weight) count as one there, unless the node differs.
    Scripts, styles, forms, titles and hidden elements are no text. Null or
    empty html gives an empty text, and so does a page of boilerplate alone. A
    null url, or one without a host, is a page of host ''. Equal rows get equal
    texts. Pages are parsed whole, once, into a table of blocks in the shared
    folder. Extra columns pass through; a column text is replaced. An empty
    table gives an empty table.

    Nodes are counted by host, node and value with sums per task first, so a
    host with a third of the pages is many tasks. The nodes to cut, a list for
    each host, are broadcast if they are counted to be few, and else joined by
    host and salt."""
    key = F.xxhash64(*[F.col(c).cast("string") for c in (id_col, url_col, html_col)])
    plain = [c for c in pages.columns if c not in ("text", html_col)]
    source = pages.select(*[F.col(f"`{c}`") for c in plain], key.alias("__k"), host_of(F.col(url_col)).alias("__host"), F.col(html_col).cast("string").alias("__html"))
    schema = T.StructType([*source.schema.fields[:-1], *T.StructType.fromDDL(f"__nodes {NODES}, __blocks {BLOCKS}, __text bigint").fields])
    trees = stage(source.mapInArrow(_trees, schema), "trees")
    seen = trees.select("__text", F.col("__host").alias("host"), F.inline("__nodes")).distinct()
    low = style_tree(seen).filter(F.col("importance") < least_importance)
    low = stage(low.groupBy(F.col("host").alias("__host")).agg(F.collect_list("path").alias("__cut")), "cut")
    few = (low.agg(F.sum(F.size("__cut"))).first()[0] or 0) <= broadcast_nodes
    if few:
        rows = trees.join(F.broadcast(low), "__host", "left")
    else:  # a host's pages are dealt over SALTS tasks
        low = low.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = trees.withColumn("__salt", F.pmod("__k", F.lit(SALTS)).cast("int")).join(low, ["__host", "__salt"], "left")
    kept = F.when(F.col("__cut").isNull(), F.col("__blocks")).otherwise(F.filter("__blocks", lambda x: ~F.arrays_overlap(x["chain"], F.col("__cut"))))
    return rows.select(*[F.col(f"`{c}`") for c in plain], F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("text"))
