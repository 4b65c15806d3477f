"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Two lines within one edit share a variant: a line with at most one character
deleted. Emitting every variant of every line would cost a row per character of
the corpus, so the variants are taken in two steps that lose nothing. One edit
falls into one of SEGMENTS stretches of the line; a coarse key is the hash of
all but one stretch. Only where two different lines share a coarse key are the
variants of the stretch left out emitted as hashed keys and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import broadcast_if_small, checkpoint, stage

SEGMENTS = 4
#: Lengths are rounded down to this for the bounds of stretches, so that lines
#: whose lengths differ by one mostly share them.
ROUND = 8


def _bound(q: Column, j: int) -> Column:
    return F.floor(q * j / SEGMENTS).cast("int")


def _pieces(q: Column) -> Column:
    """Hashes of a line's stretches for rounded length q: all but the last
    counted from the left end, then all but the first from the right end."""
    line, extra = F.col("line"), F.length("line") - q

    def piece(j: int, shift) -> Column:
        return F.xxhash64(F.substring(line, _bound(q, j) + shift + 1, _bound(q, j + 1) - _bound(q, j)))

    return F.array(*[piece(j, 0) for j in range(SEGMENTS - 1)], *[piece(j, extra) for j in range(1, SEGMENTS)])


def _with_keys(lines: DataFrame) -> DataFrame:
    """Adds key, q, j: the hash of all stretches but the j-th, for the rounded
    length q of the line and, where rounding parts it from those one shorter,
    of theirs."""
    size = F.length("line")
    rows = lines.withColumn("q1", size - size % ROUND).withColumn("q2", (size - 1) - (size - 1) % ROUND)
    rows = rows.withColumn("p1", _pieces(F.col("q1"))).withColumn("p2", F.when(F.col("q1") != F.col("q2"), _pieces(F.col("q2"))))

    def keys(q: str, p: str) -> Column:
        def key(j: int) -> Column:
            return F.xxhash64(F.col(q), F.lit(j), *[F.col(p)[i] for i in range(j)], *[F.col(p)[SEGMENTS - 2 + i] for i in range(j + 1, SEGMENTS)])

        return F.array(*[F.struct(key(j).alias("key"), F.col(q).alias("q"), F.lit(j).alias("j")) for j in range(SEGMENTS)])

    both = F.when(F.col("p2").isNull(), keys("q1", "p1")).otherwise(F.concat(keys("q1", "p1"), keys("q2", "p2")))
    return rows.select(*lines.columns, F.inline(both))


def _stretch() -> Column:
    """The stretch that (q, j) leaves out."""
    low, high = F.floor(F.col("q") * F.col("j") / SEGMENTS).cast("int"), F.floor(F.col("q") * (F.col("j") + 1) / SEGMENTS).cast("int")
    return F.substring(F.col("line"), low + 1, F.length("line") - low - (F.col("q") - high))


def _variants(seg: Column) -> Column:
    """Array of (v, p): hash of the stretch whole (p = 0) and without its
    character p."""
    less = F.transform(F.sequence(F.lit(1), F.length(seg)), lambda p: F.struct(F.xxhash64(F.concat(F.substring(seg, F.lit(1), p - 1), F.substring(seg, p + 1, F.length(seg)))).alias("v"), p.alias("p")))
    deleted = F.when(F.length(seg) > 0, less).otherwise(F.array())
    return F.concat(F.array(F.struct(F.xxhash64(seg).alias("v"), F.lit(0).alias("p"))), deleted)


def _lines(source: DataFrame) -> DataFrame:
    lines = source.select("i", "d", F.posexplode(F.split("t", "\n", -1)).alias("pos", "raw"))
    lines = lines.select("i", "d", "pos", F.btrim("raw", F.lit(" \t\r\x0b\x0c")).alias("line")).filter("line <> ''")
    return lines.select("i", "d", "pos", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = 20, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs with text_col stripped of lines that repeat an earlier line, and
    two more columns, lines_in and lines_out (long).

    A line is what stands between line feeds, compared without outer ASCII white
    space. It goes if the same line, or for lines of min_chars and more one within
    max_edits (0 or 1) insertions, deletions or substitutions of a character,
    comes earlier in the corpus. Earlier is by id (null last), then text hash,
    then place in the text. Blank lines always stay. A line counts as earlier
    even where it goes itself.

    A null text stays null, with 0 lines. Repeated rows (same id and text) are
    one document and get the same result. Other columns pass through, also such
    as are named like columns here. An empty table gives an empty table. Very
    long lines are compared whole; work on variants grows with the square of a
    stretch of a line, and only for lines that share three stretches with
    another.

    Equal lines are reduced before the shuffle to their first place, so common
    lines don't fill a task. The documents are shuffled once, at the end."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    source = docs.select(ident.alias("i"), F.xxhash64(F.col(text_col)).alias("d"), F.col(text_col).cast("string").alias("t"))
    lines = _lines(source)
    place = F.struct("i", "d", "pos")
    exact = stage(lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "lines")
    repeated = exact.filter("n > 1").select("h", "g", "first", F.lit(False).alias("gone"))
    if max_edits:
        near = _near_lines(lines.filter(F.length("line") >= min_chars), exact, broadcast_rows)
        repeated = repeated.unionByName(near).groupBy("h", "g").agg(F.min("first").alias("first"), F.max("gone").alias("gone"))
    repeated = checkpoint(repeated)
    hits = lines.select("i", "d", "pos", "h", "g").join(repeated, ["h", "g"]).filter(F.col("gone") | (place != F.col("first")))
    cut = hits.groupBy("i", "d").agg(F.collect_set("pos").alias("cut"))

    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), ident.alias("i"), F.xxhash64(F.col(text_col)).alias("d"))
    text, parts = F.col(f"row.`{text_col}`"), F.col("parts")
    count = F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("cut"))
    joined = F.array_join(F.transform(kept, lambda p: F.element_at(parts, p + 1)), "\n")
    out = whole.join(cut, ["i", "d"], "left").withColumn("parts", F.split(text, "\n", -1))
    new = F.when(F.col("cut").isNull(), text).otherwise(joined)
    columns = [new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names]
    return out.select(*columns, count.alias("lines_in"), (count - F.coalesce(F.size("cut"), F.lit(0))).cast("long").alias("lines_out"))


def _near_lines(lines: DataFrame, exact: DataFrame, broadcast_rows: int) -> DataFrame:
    """h, g, first, gone (true) of lines that have an earlier line within one
    edit, but not equal."""
    keyed = _with_keys(lines.select("h", "g", "line"))
    shared = checkpoint(keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("key"))
    segs = keyed.join(broadcast_if_small(shared, broadcast_rows), "key").select("key", "h", "g", _stretch().alias("seg"))
    segs = segs.groupBy("key", "h", "g").agg(F.first("seg").alias("seg"))
    segs = segs.join(exact.select("h", "g", "first"), ["h", "g"])
    made = segs.select("*", F.inline(_variants(F.col("seg")))).repartition("key", "v")
    # Lines of one key, variant and deleted place differ in that one character,
    # so such a group holds each line once and no more lines than characters exist.
    own, all_ = Window.partitionBy("key", "v", "p"), Window.partitionBy("key", "v")
    item = F.struct("first", "seg")
    made = made.select(
        "h", "g", "first", "seg", "p",
        F.min(item).over(own).alias("same"),
        F.min(F.when(F.col("p") == 0, item)).over(all_).alias("shorter"),
        F.min(F.when(F.col("p") > 0, item)).over(all_).alias("longer"),
    )

    def earlier(x: str) -> Column:
        return F.coalesce((F.col(f"{x}.first") < F.col("first")) & F.levenshtein(F.col("seg"), F.col(f"{x}.seg"), 1).isin(0, 1), F.lit(False))

    gone = made.filter(F.when(F.col("p") == 0, earlier("longer")).otherwise(earlier("same") | earlier("shorter")))
    return gone.select("h", "g", "first", F.lit(True).alias("gone")).distinct()
