"""Benchmark decontamination by template canonicalisation.

DataFrame functions only. Words are lower-cased and stripped of punctuation;
numbers, number words, units after numbers and names become typed placeholders.
A name is any word with a capital and a small letter first, also at the start of
a sentence; as names are found by case, each text also has a second template
whose names stay words, so that case can't hide a copy. Windows of
such templates are joined by hash, and a hit counts if the values in its slots
map one to one, so a question with other numbers or names is still caught.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.arrays import bound
from evidentia.llm.common import broadcast_if_small, checkpoint, stage

NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
#: Units that follow a number.
UNITS = "mm cm dm m km mg g kg t ml cl l s ms min h hz khz mhz w kw v a j kj n pa kpa k c f mph kmh usd eur gbp dollar dollars euro euros cent cents pound pounds mile miles inch inches feet foot ft yard yards ounce ounces oz lb lbs meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres gram grams kilogram kilograms ton tons liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years degree degrees percent".split()
#: Number words; those that are often something else (un, ein, once) aren't.
ONES = "one two three four five six seven eight nine".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBERS = [
    *ONES, *TENS, *[t + o for t in TENS for o in ONES],
    *"zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion dozen".split(),
    *"zwei drei vier fünf sechs sieben acht neun zehn elf zwölf".split(),
    *"deux trois quatre cinq sept huit neuf dix".split(),
    *"dos tres cuatro cinco seis siete ocho nueve diez".split(),
]


#: Punctuation, but for a point or comma inside a number and a sign before one.
PUNCTUATION = r"[^\p{L}\p{N}\s](?<!\p{N}[.,](?=\p{N}))(?<![^\p{L}\p{N}]-(?=\p{N}))(?<!^-(?=\p{N}))"


def _bare(text: Column) -> Column:
    """Without punctuation; points and commas inside numbers and a sign before
    one stay."""
    return F.regexp_replace(text, PUNCTUATION, "")


def _split(text: Column) -> Column:
    """Words of a text; none for a blank one."""
    t = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(t) > 0, F.split(t, r"\s+")).otherwise(F.array().cast("array<string>"))


def plain_words(text: Column) -> Column:
    """Lower-cased words without punctuation; as many as template_words has."""
    return _split(F.lower(_bare(text)))


def with_templates(df: DataFrame, text: str = "t", hashed: bool = False) -> DataFrame:
    """Adds tw, the template, and cw, the template whose names are words: arrays
    of words in lower case, of equal length. Digits and units after them are
    typed in the text, number words and units after those word by word. With
    hashed the words are given by their hashes."""
    out = (lambda x: F.xxhash64(x)) if hashed else (lambda x: x)
    digits = F.regexp_replace(_bare(F.col(text)), r"-?\p{N}+(?:[.,]\p{N}+)*", NUMBER)
    digits = F.regexp_replace(digits, rf"{NUMBER}(\s*)(?i:{'|'.join(UNITS)})(?!\S)", f"{NUMBER}$1{UNIT}")
    # Names are marked and keep their letters, so one split gives both templates.
    marked = F.regexp_replace(digits, r"\p{Lu}(?<!\S.)\p{Ll}\p{L}*", f"{NAME}$0")
    rows = df.withColumn("__words", _split(F.lower(marked)))
    numbers = [*NUMBERS, *[NAME + x for x in NUMBERS]]

    def typed(w: Column, i: Column) -> Column:
        unit = w.isin(*UNITS) & F.coalesce(F.get("__words", i - 1).isin(*numbers), F.lit(False))
        word = F.when(w.startswith(NAME), F.substring(w, 2, 2**31 - 1)).otherwise(w)
        return out(F.when(w.isin(*numbers, *UNITS), F.when(w.isin(*numbers), NUMBER).when(unit, UNIT).otherwise(word)).otherwise(word))

    rows = rows.withColumn("cw", F.transform("__words", typed))
    named = F.zip_with("__words", "cw", lambda w, c: F.when(w.startswith(NAME) & (c != out(F.lit(NUMBER))), out(F.lit(NAME))).otherwise(c))
    return rows.withColumn("tw", named).drop("__words")


def _windows(hashes: Column, sizes: list[int]) -> Column:
    """Array of (w, hs): the hashes of the windows of each size, in order, from
    the hashes of the words. They
    are made by doubling: of two neighbours, of two pairs, of two fours."""

    def joined(a: Column, b: Column, k: int) -> Column:
        """Hashes of a[i] and b[i + k]; the last k mean nothing."""
        return F.zip_with(a, F.slice(b, k + 1, F.greatest(F.size(b) - k, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    def of(levels: dict[int, Column], w: int) -> Column:
        out, done = None, 0
        for power in sorted(levels, reverse=True):
            if w & power:
                out = levels[power] if out is None else joined(out, levels[power], done)
                done += power
        n = F.size(levels[1])
        return F.when(n >= w, F.slice(out, 1, n - (w - 1))).otherwise(F.array().cast("array<bigint>"))

    def build(levels: dict[int, Column]) -> Column:
        top = max(levels)
        if 2 * top > max(sizes):
            return F.array(*[F.struct(F.lit(w).alias("w"), of(levels, w).alias("hs")) for w in sizes])
        return bound(joined(levels[top], levels[top], top), lambda x: build(levels | {2 * top: x}))

    return bound(hashes, lambda x: build({1: x}))


def _exploded(df: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """keep, h, w, at (from 1): a row for each window of tw and cw (hashes)."""
    rows = df.select(*keep, F.inline(F.concat(_windows(F.col("cw"), sizes), _windows(F.col("tw"), sizes))))
    return rows.select(*keep, "w", F.posexplode("hs").alias("at", "h")).withColumn("at", F.col("at") + 1)


def _slots(template: Column, plain: Column, at: Column, w: Column) -> Column:
    """Array of (slot, value) of the slots in a window, slots counted from 0."""
    each = F.transform(F.sequence(F.lit(0), w - 1), lambda k: F.struct(F.element_at(template, at + k).rlike(f"[{NAME}-{UNIT}]").alias("is_slot"), k.alias("slot"), F.element_at(plain, at + k).alias("value")))
    return F.transform(F.filter(each, lambda y: y["is_slot"]), lambda y: F.struct(y["slot"].alias("slot"), y["value"].alias("value")))


def _shared_slots(slots: Column, w: Column) -> Column:
    """The first slots of a window, one more than may differ: in windows that can
    match, one of them has the same value."""
    return F.slice(slots, 1, F.floor(w / 2).cast("int") + 1)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, cover: float = 0.5, broadcast_rows: int = 1_000_000, by_text: bool = False) -> DataFrame:
    """One row for each document and benchmark item it holds: id_col, item_col,
    windows (number of windows of the item found), covered (words of the item
    in them), item_words, exact (no slot has another value); by_text also tells
    texts of one id apart by text_hash (xxhash64 of the text).

    An item is held if windows of `window` template words agree with the
    document's and cover a share `cover` of the item's words. Slots with another value than the item's may be half of a window's
    words at most. Over one stretch of the document the values have to map one
    to one: of pairs that contradict each other the one in most slots holds (an
    equal value always does, of equally many none), and windows with another
    one don't count. exact looks at all slots of the stretch. Items shorter than the window are matched whole.

    Null and blank texts hold nothing and are held by nothing. A null id is
    returned as null where its text holds an item. Repeated rows of documents
    give one row; texts are used whole. Extra columns are ignored, whatever
    their names. Either table empty gives an empty table.

    Windows of the documents are exploded and looked up among the hashes of
    those of the benchmark, which are broadcast if they are counted to be few and
    else shuffled; so a document's window gives one row at most. Windows in which
    more than half of the words are slots share a template with any others, a
    table of numbers with all of a numeric item: of those, only pairs are joined
    that have the same value in one of their first slots (of one slot more than
    may differ), which loses none that can count. The texts of documents with
    hits are read again for their values. What is gathered for a stretch is at
    most two hits for each window of the item."""
    items = benchmark.select(F.col(item_col).alias("item"), F.xxhash64(item_col, item_text_col).alias("ih"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("t"))
    items = checkpoint(with_templates(items).select("item", "ih", "tw", "cw", plain_words(F.col("t")).alias("pw")).filter(F.size("tw") > 0).dropDuplicates(["ih"]))
    sizes = sorted(r[0] for r in items.select(F.least(F.size("tw"), F.lit(window)).alias("w")).distinct().collect()) or [window]  # at most `window` numbers
    word = lambda t: F.xxhash64(t)
    keys = items.select("item", "ih", F.col("tw").alias("named"), "pw", F.size("tw").alias("item_words"), F.transform("tw", word).alias("tw"), F.transform("cw", word).alias("cw"))
    keys = _exploded(keys, sizes, "item", "ih", "named", "pw", "item_words").filter(F.col("w") == F.least(F.col("item_words"), F.lit(window))).dropDuplicates(["ih", "h", "at", "w"])
    keys = keys.select("h", "w", "item", "ih", F.col("at").alias("item_at"), "item_words", _slots(F.col("named"), F.col("pw"), F.col("at"), F.col("w")).alias("slots"))
    # Of a window whose names are words only the others are slots.
    keys = checkpoint(keys.withColumn("heavy", F.size("slots") * 2 > F.col("w")))
    known = checkpoint(keys.groupBy("h", "w").agg(F.bool_or("heavy").alias("any_heavy"), F.bool_and("heavy").alias("all_heavy")))
    source = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    found = stage(_exploded(with_templates(source, hashed=True), sizes, "i", "d").join(broadcast_if_small(known, broadcast_rows), ["h", "w"]), "windows")
    held = checkpoint(found.select(F.col("i").alias("hi"), F.col("d").alias("hd")).distinct())
    again = source.join(broadcast_if_small(held, broadcast_rows), F.col("i").eqNullSafe(F.col("hi")) & (F.col("d") == F.col("hd")), "left_semi").dropDuplicates(["i", "d"])
    again = stage(with_templates(again).select("i", "d", F.col("tw").alias("dt"), plain_words(F.col("t")).alias("dp")), "held")
    texts = again.withColumnsRenamed({"i": "i2", "d": "d2"})
    same_text = F.col("i").eqNullSafe(F.col("i2")) & (F.col("d") == F.col("d2"))
    hit = ["i", "d", "item", "ih", "at", "item_at", "w", "item_words"]
    light = found.filter("not all_heavy").join(broadcast_if_small(keys.filter("not heavy").drop("slots", "heavy"), broadcast_rows), ["h", "w"]).select(*hit)
    slots = found.filter("any_heavy").join(texts, same_text).select("i", "d", "h", "at", "w", F.explode(_shared_slots(_slots(F.col("dt"), F.col("dp"), F.col("at"), F.col("w")), F.col("w"))).alias("x")).select("i", "d", "h", "at", "w", "x.*")
    heavy = keys.filter("heavy").select("h", "w", "item", "ih", "item_at", "item_words", F.explode(_shared_slots(F.col("slots"), F.col("w"))).alias("x")).select("h", "w", "item", "ih", "item_at", "item_words", "x.*")
    heavy = slots.join(broadcast_if_small(checkpoint(heavy), broadcast_rows), ["h", "w", "slot", "value"]).select(*hit)
    hits = light.unionByName(heavy).distinct()
    stretch = (F.col("at") - F.col("item_at")).alias("stretch")
    hits = checkpoint(hits.groupBy("i", "d", "item", "ih", stretch).agg(F.min("item_words").alias("item_words"), F.collect_list(F.struct("at", "item_at", "w")).alias("hits")))
    both = hits.join(texts, same_text).join(items.select("ih", "pw"), "ih")

    def pairs(x: Column) -> Column:
        """(place, value in the item, value in the document) of a hit's slots."""
        each = F.transform(F.sequence(F.lit(0), x["w"] - 1), lambda k: F.struct(F.element_at("dt", x["at"] + k).rlike(f"[{NAME}-{UNIT}]").alias("slot"), (x["item_at"] + k).alias("k"), F.element_at("pw", x["item_at"] + k).alias("a"), F.element_at("dp", x["at"] + k).alias("b")))
        return F.filter(each, lambda y: y["slot"])

    both = both.withColumn("hits", F.transform("hits", lambda x: F.struct(x["item_at"].alias("item_at"), x["w"].alias("w"), pairs(x).alias("p"))))
    # Stored, as what follows looks at the hits over and over.
    both = stage(both.select("i", "d", "item", "ih", "item_words", "hits"), "slots")
    both = both.withColumn("slots", F.array_distinct(F.flatten(F.transform("hits", lambda x: F.transform(x["p"], lambda y: F.struct(y["k"], y["a"], y["b"]))))))
    pair = F.array_distinct(F.transform("slots", lambda y: F.struct(y["a"].alias("a"), y["b"].alias("b"))))
    both = both.withColumn("pairs", pair).withColumn("pairs", F.transform("pairs", lambda y: F.struct(y["a"].alias("a"), y["b"].alias("b"), F.size(F.filter("slots", lambda z: (z["a"] == y["a"]) & (z["b"] == y["b"]))).alias("n"))))
    wrong = F.filter("pairs", lambda y: (y["a"] != y["b"]) & F.exists("pairs", lambda z: ((z["a"] == y["a"]) != (z["b"] == y["b"])) & ((z["n"] >= y["n"]) | (z["a"] == z["b"]))))
    wrong = F.transform(wrong, lambda y: F.struct(y["a"].alias("a"), y["b"].alias("b")))
    fit = bound(wrong, lambda bad: F.filter("hits", lambda x: (F.size(F.filter(x["p"], lambda y: y["a"] != y["b"])) * 2 <= x["w"]) & ~F.exists(x["p"], lambda y: F.array_contains(bad, F.struct(y["a"].alias("a"), y["b"].alias("b"))))))
    both = both.withColumn("hits", fit)
    words = F.flatten(F.transform("hits", lambda x: F.sequence(x["item_at"], x["item_at"] + x["w"] - 1)))
    # Stretches without a fitting window add no words and no judgement.
    both = both.select("i", "d", "item", "ih", "item_words", F.size("hits").alias("windows"), F.array_distinct(words).alias("words"), F.when(F.size("hits") > 0, F.forall("slots", lambda y: y["a"] == y["b"])).alias("exact"))
    both = both.groupBy("i", "d", "item", "ih").agg(F.max("item_words").alias("item_words"), F.sum("windows").cast("int").alias("windows"), F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("covered"), F.min("exact").alias("exact"))
    both = both.filter(F.col("covered") >= F.ceil(F.col("item_words") * cover))
    keys = [F.col("i").alias(id_col), F.col("item").alias(item_col), *([F.col("d").alias("text_hash")] if by_text else [])]
    return both.groupBy(*keys).agg(F.max("windows").alias("windows"), F.max("covered").alias("covered"), F.max("item_words").alias("item_words"), F.max("exact").alias("exact"))
