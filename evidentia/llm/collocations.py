"""Collocations of up to four words from a suffix tree that is partitioned
vertically.

The tree holds the suffixes of all pieces of text, truncated at four words. Its
top is cut into groups of word prefixes that fit a memory budget: prefixes are
dealt into bins by hash, bins are packed into groups of at most the budget, and
a bin above it is extended by one word and packed anew. Each group's suffixes
then go to one task, which builds its subtrees on its own and reads the count of
a node from the totals of its leaves. Equal suffixes are counted together before
they are sent, so a passage that stands in very many texts is one row a batch.
Words go by 64-bit hashes; a second hash, and the words of all results, show
whether two of them share one, and then all is counted anew with other hashes.
Counts, parts and scores are DataFrame joins over the nodes that are frequent.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import give_back, mix64, slices, stage

#: Words in a phrase at most.
DEPTH = 4
#: Bytes that part words, and those that part pieces too.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
#: Bits of the filter of frequent words (16 MB, whatever the corpus).
FILTER_BITS = 27
#: Bytes of text that are taken apart at once, and words of a batch of suffixes.
SLICE, BATCH = 1_000_000, 1_000_000
_U = np.uint64
STEP = _U(0x9E3779B97F4A7C15)
ODD = _U(0xC2B2AE3D27D4EB4F)


class Collision(Exception):
    """Two words or phrases have one hash."""


# ------------------------------------------------------------------ words
def words_of(texts: list[str | None], langs: list[str], seed: int, second: bool = False):
    """Bytes, start, length and 64-bit hash of each word (its language and the
    seed are part of it), whether it ends a piece, the index of its text, and
    another hash if asked for."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw).lower() + b"\n" + bytes(8)
    n = len(data) - 8
    b = np.frombuffer(data, np.uint8)
    kind = KIND[b[:n]]
    blank = kind > 0
    start = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    stop = np.flatnonzero(~blank & np.concatenate((blank[1:], [True]))) + 1
    size = stop - start
    breaks = np.cumsum(kind == 2, dtype=np.int32)
    ends = np.ones(len(start), bool)
    if len(start):
        ends[:-1] = breaks[start[1:]] != breaks[stop[:-1] - 1]
    text = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="right")
    eight = np.ndarray((n,), np.dtype("<u8"), data, 0, (1,))

    def hashes(seed: int) -> np.ndarray:
        salt = np.fromiter((int.from_bytes(hashlib.blake2b(f"{seed} {x}".encode(), digest_size=8).digest(), "little") for x in langs), np.uint64, len(langs))
        h = salt[text] + size.astype(np.uint64) * STEP if len(start) else np.zeros(0, np.uint64)
        todo = np.flatnonzero(size <= 64)
        for at in range(0, 64, 8):
            todo = todo[size[todo] > at]
            if not len(todo):
                break
            left = np.minimum(size[todo] - at, 8).astype(np.uint64)
            chunk = eight[start[todo] + at] & (_U(2**64 - 1) >> ((_U(8) - left) * _U(8)))
            h[todo] = mix64((h[todo] ^ chunk) * ODD + STEP)
        for i in np.flatnonzero(size > 64):
            whole = hashlib.blake2b(data[start[i] : stop[i]], digest_size=8, salt=int(h[i]).to_bytes(8, "little")).digest()
            h[i] = int.from_bytes(whole, "little")
        h[h == 0] = 1
        return h

    return data, start, size, hashes(seed), ends, text, hashes(~seed) if second else None


def word_counter(seed: int, held: int = 400_000):
    """Task function: key, language, the least and the greatest second hash and
    the count of the words of a stretch of rows."""

    def merged(parts):
        key, low, high, n, lang = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        return key[order][edge], np.minimum.reduceat(low[order], edge), np.maximum.reduceat(high[order], edge), np.add.reduceat(n[order], edge), lang[order][edge]

    def count(batches):
        import pyarrow as pa

        codes: dict[str, int] = {}

        def out(part):
            key, low, high, n, lang = part
            names = pa.array(list(codes), pa.string()).take(pa.array(lang))
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), names, pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array(n)], ["key", "lang", "low", "high", "n"])

        parts, rows = [], 0
        for b in slices(batches, 0, SLICE):
            langs = b.column(1).to_pylist()
            _, _, _, h, _, text, second = words_of(b.column(0).to_pylist(), langs, seed, second=True)
            if not len(h):
                continue
            lang = np.fromiter((codes.setdefault(x, len(codes)) for x in langs), np.int64, len(langs))[text]
            parts.append(merged([(h, second, second, np.ones(len(h), np.int64), lang)]))
            rows += len(parts[-1][0])
            if rows > held:
                parts = [merged(parts)]
                rows = len(parts[0][0])
                if rows > held:
                    yield out(parts[0])
                    parts, rows = [], 0
        if parts:
            yield out(merged(parts))
        give_back()

    return count


def word_reader(seed: int, bits, needed, shift: int):
    """Task function: short key and word for frequent words that are needed."""

    def read(batches):
        import pyarrow as pa

        table, wanted, seen = np.frombuffer(bits.value, np.uint8), np.frombuffer(needed.value, np.uint8), {}
        for b in slices(batches, 0, SLICE):
            data, start, size, h, _, _, _ = words_of(b.column(0).to_pylist(), b.column(1).to_pylist(), seed)
            use = np.flatnonzero(has_bit(table, h) & has_bit(wanted, h >> _U(shift)))
            here, first = np.unique(h[use] >> _U(shift), return_index=True)
            at = use[first]
            new = [(int(k), data[s : s + n].decode("utf-8", "surrogatepass")) for k, s, n in zip(here.view(np.int64), start[at], size[at], strict=True) if int(k) not in seen]
            seen.update(new)
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in new], pa.int64()), pa.array([x[1] for x in new], pa.string())], ["key", "word"])
        give_back()

    return read


def has_bit(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = h & _U(2**FILTER_BITS - 1)
    return (table[low >> _U(3)] >> (low & _U(7)).astype(np.uint8)) & 1 == 1


def frequent_filter(keys: DataFrame) -> bytes:
    """A bit for each frequent word's hash: of a fixed size, so that it may go to
    all tasks. A rare word that shares a bit only costs a suffix more."""
    bit = F.col("key").bitwiseAND(2**FILTER_BITS - 1)
    rows = keys.groupBy(F.shiftright(bit, 15).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(bit.bitwiseAND(2**15 - 1)).alias("bits")).collect()
    out = np.zeros(2**FILTER_BITS // 8, np.uint8)
    for r in rows:
        out[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


# --------------------------------------------------------------- suffixes
def suffixes(batches, seed: int, bits: bytes, most_words: int = BATCH):
    """Of stretches of about most_words words: the sorted hashes of its frequent
    words, and four columns of indexes into them (from 1; 0: the suffix is over)
    for each suffix of two words or more."""
    table = np.frombuffer(bits, np.uint8)
    held_h, held_ends, rows = [], [], 0

    def made():
        h, ends = np.concatenate(held_h), np.concatenate(held_ends)
        known = has_bit(table, h)
        words, place = np.unique(h[known], return_inverse=True)
        at = np.zeros(len(h) + DEPTH, np.int32)
        at[:-DEPTH][known] = place + 1
        on = np.concatenate((~ends, np.zeros(DEPTH, bool)))  # the next word is of the same piece
        columns = [at[: len(h)]]
        alive = at[: len(h)] > 0
        for k in range(1, DEPTH):
            alive = alive & on[k - 1 : k - 1 + len(h)]
            nxt = np.where(alive, at[k : k + len(h)], 0)
            alive = nxt > 0
            columns.append(nxt)
        use = columns[1] > 0
        return words, [c[use] for c in columns]

    for b in slices(batches, 0, SLICE):
        _, _, _, h, ends, _, _ = words_of(b.column(0).to_pylist(), b.column(1).to_pylist(), seed)
        held_h.append(h)
        held_ends.append(ends)
        rows += len(h)
        if rows >= most_words:
            yield made()
            held_h, held_ends, rows = [], [], 0
    if rows:
        yield made()
    held_h, held_ends = [], []
    give_back()


def distinct(columns: list[np.ndarray], n_words: int):
    """Distinct suffixes and their counts."""
    base = n_words + 1
    a = columns[0].astype(np.int64) * base + columns[1]
    b = columns[2].astype(np.int64) * base + columns[3]
    if base**4 >= 2**63:
        a, b = (np.unique(x, return_inverse=True)[1] for x in (a, b))
        key = a << 32 | b
    else:
        key = a * base**2 + b
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return [c[first] for c in columns], n


def bin_of(level: int, hashes: np.ndarray, columns, before, bins: int):
    """Bins of prefixes of level words, by the prefix hashes of a word less."""
    here = hashes[columns[level - 1]]
    p = here if before is None else mix64(before * ODD + here)
    return p, (p & _U(bins - 1)).astype(np.int64)


def level_counter(seed: int, bits, routes, bins: int):
    """Task function: suffixes in each bin of the level after those of routes."""

    def count(batches):
        import pyarrow as pa

        level = len(routes.value) + 1
        total = np.zeros(bins, np.int64)
        for words, columns in suffixes(batches, seed, bits.value):
            hashes, p = np.concatenate(([_U(0)], words)), None
            for k in range(1, level + 1):
                p, b = bin_of(k, hashes, columns, p, bins)
                if k < level:
                    go = routes.value[k - 1][b] < 0
                    columns, p = [c[go] for c in columns], p[go]
            total += np.bincount(b, minlength=bins)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bin", "n"])

    return count


def router(seed: int, bits, routes, bins: int, last: int, width: int):
    """Task function: suffixes by group, packed with the short hashes (width
    bytes) of their words. What no level holds within the budget goes by the
    whole suffix."""

    def deal(batches):
        import pyarrow as pa

        for words, columns in suffixes(batches, seed, bits.value):
            columns, n = distinct(columns, len(words))
            if not len(n):
                continue
            hashes, p = np.concatenate(([_U(0)], words)), None
            group, level = np.full(len(n), -1, np.int64), np.full(len(n), DEPTH, np.int64)
            for k in range(1, DEPTH):
                p, b = bin_of(k, hashes, columns, p, bins)
                if k <= len(routes.value):
                    here = (group < 0) & (routes.value[k - 1][b] >= 0)
                    group[here], level[here] = routes.value[k - 1][b[here]], k
            rest = group < 0
            p, _ = bin_of(DEPTH, hashes, columns, p, bins)
            group[rest] = (p[rest] % _U(last)).astype(np.int64)
            code = level << 40 | group
            order = np.argsort(code, kind="stable")
            edges = np.flatnonzero(np.diff(code[order])) + 1
            out = []
            for part in np.split(order, edges):
                ids = np.stack([c[part] for c in columns])
                used = np.zeros(len(words) + 1, bool)
                used[ids] = True
                used[0] = True
                renumber = np.cumsum(used) - 1
                wide = renumber[-1] > 65_535
                times = n[part]
                short = (words[used[1:]] >> _U(64 - 8 * width)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
                packed = renumber[ids].astype("<u4" if wide else "<u2").tobytes()
                out.append((int(code[part[0]]), short, pa.compress(packed, "zstd", asbytes=True), bool(wide), b"" if times.max() == 1 else times.astype("<i8").tobytes(), len(part)))
            names = ["code", "words", "ids", "wide", "times", "rows"]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    return deal


def subtree_builder(least: int, width: int):
    """Group function: nodes of two words and more that are frequent. A node
    above the prefixes of its group has only a part of its leaves here and is
    kept whatever its count; the parts are added up afterwards."""

    def build(table):
        import pyarrow as pa

        level = table.column("code")[0].as_py() >> 40
        own = []
        for x in table.column("words").to_pylist():
            whole = np.zeros((len(x) // width, 8), np.uint8)
            whole[:, :width] = np.frombuffer(x, np.uint8).reshape(-1, width)
            own.append(whole.view("<u8").ravel())
        words = np.unique(np.concatenate(own))
        ids, times = [], []
        for w, packed, wide, t, n in zip(own, *[table.column(c).to_pylist() for c in ("ids", "wide", "times", "rows")], strict=True):
            packed = pa.decompress(packed, n * DEPTH * (4 if wide else 2), "zstd", asbytes=True)
            place = np.concatenate(([0], np.searchsorted(words, w) + 1)).astype(np.int32)
            found = place[np.frombuffer(packed, "<u4" if wide else "<u2").reshape(DEPTH, -1)]
            ids.append(found)
            times.append(np.frombuffer(t, "<i8") if t else np.ones(found.shape[1], np.int64))
        ids, times = np.concatenate(ids, axis=1), np.concatenate(times)
        node, out = ids[0].astype(np.int64), []
        for d in range(2, DEPTH + 1):
            go = ids[d - 1] > 0
            ids, times, node = ids[:, go], times[go], node[go]
            _, first, inverse = np.unique(node << 32 | ids[d - 1], return_index=True, return_inverse=True)
            leaves = np.zeros(len(first), np.int64)
            np.add.at(leaves, inverse, times)
            keep = leaves >= least if level <= d else np.ones(len(first), bool)
            phrase = np.zeros((DEPTH, int(keep.sum())), np.uint64)
            phrase[:d] = words[ids[:d, first[keep]] - 1]
            out.append((phrase, leaves[keep]))
            go = keep[inverse]
            ids, times, node = ids[:, go], times[go], inverse[go]
        phrase = np.concatenate([x[0] for x in out], axis=1).view(np.int64)
        found = pa.table({**{f"w{i + 1}": phrase[i] for i in range(DEPTH)}, "n": np.concatenate([x[1] for x in out])})
        del own, ids, times, node, first, inverse, leaves
        give_back()
        return found

    return build


def packed_bins(totals: DataFrame, bins: int, most: int, first: int) -> tuple[np.ndarray, int]:
    """Group of each bin, consecutive ones together up to most + one bin of at
    most that; -1 for a bin above it. As many bins as groups, times a constant."""
    found = totals.toPandas()
    n = np.zeros(bins, np.int64)
    n[found["bin"].to_numpy()] = found["n"].to_numpy()
    held = np.where(n > most, 0, n)
    before = np.cumsum(held) - held
    return np.where(n > most, -1, first + before // most).astype(np.int64), int(n[n > most].sum())


def key_of(words: list[Column]) -> Column:
    return words[0] if len(words) == 1 else F.xxhash64(*words)


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))


def short_width(words: DataFrame, frequent: DataFrame) -> int:
    """Bytes of the hash that tell all words apart which pass the filter: the
    fewest, as the words of the packed suffixes are most of what is sent."""
    bit = F.col("key").bitwiseAND(2**FILTER_BITS - 1).alias("bit")
    passing = stage(words.select("key", bit).join(frequent.select(bit).distinct(), "bit", "left_semi").select("key"), "phrase-passing")
    n = passing.count()
    for width in range(4, 8):
        short = F.shiftrightunsigned("key", 64 - 8 * width).alias("short")
        if passing.select(short).filter("short <> 0").distinct().count() == n:
            return width
    return 8


def phrase_counts(docs: DataFrame, least: int, budget: int, seed: int):
    """Words (lang, n and short: what their suffixes know them by; all words),
    nodes (w1 to w4, length, n) of two to four words with at least `least`
    occurrences, the filter of frequent words, and the shift of short hashes."""
    spark, rows = docs.sparkSession, plain(docs)
    counted = rows.mapInArrow(word_counter(seed), "key long, lang string, low long, high long, n long")
    words = stage(counted.groupBy("key", "lang").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")), "phrase-words")
    if not words.filter("low <> high").isEmpty():
        raise Collision
    frequent = words.filter(F.col("n") >= least)
    most, total = budget // 2, frequent.agg(F.sum("n")).first()[0] or 0
    bins = 1 << max(10, (16 * total // budget).bit_length())
    bits = spark.sparkContext.broadcast(frequent_filter(frequent))
    totals = frequent.groupBy(F.col("key").bitwiseAND(bins - 1).alias("bin")).agg(F.sum("n").alias("n"))
    found, above = packed_bins(totals, bins, most, 0)
    routes = [found]
    while above and len(routes) < DEPTH - 1:
        counter = level_counter(seed, bits, spark.sparkContext.broadcast(routes), bins)
        totals = rows.mapInArrow(counter, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
        found, above = packed_bins(totals, bins, most, 0)
        routes.append(found)
    width = short_width(words, frequent)
    words = words.select("lang", "n", F.shiftrightunsigned("key", 64 - 8 * width).alias("short"))
    dealt = rows.mapInArrow(router(seed, bits, spark.sparkContext.broadcast(routes), bins, above // most + 1, width), "code long, words binary, ids binary, wide boolean, times binary, rows long")
    parts = dealt.groupBy("code").applyInArrow(subtree_builder(least, width), "w1 long, w2 long, w3 long, w4 long, n long")
    names = [f"w{i + 1}" for i in range(DEPTH)]
    nodes = parts.groupBy(*names).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    length = sum((F.col(x) != 0).cast("int") for x in names)
    return words, stage(nodes.withColumn("length", length), "phrase-nodes"), bits, 64 - 8 * width


def by_length(use) -> Column:
    """use(d) where the phrase has d words."""
    out = F.lit(None)
    for d in range(2, DEPTH + 1):
        out = F.when(F.col("length") == d, use(d)).otherwise(out)
    return out


def scored(words: DataFrame, nodes: DataFrame, least: int, cover: int) -> DataFrame:
    """Candidates with the parts and score of their lowest cut, without those
    that lie in a longer one which has cover percent of their occurrences."""
    w = [F.col(f"w{i + 1}") for i in range(DEPTH)]
    nodes = stage(nodes.withColumn("key", by_length(lambda d: F.xxhash64(*w[:d]))), "phrase-keys")
    counts = words.filter(F.col("n") >= least).select(F.col("short").alias("key"), F.col("n").alias("part_n")).unionByName(nodes.select("key", F.col("n").alias("part_n")))
    if not counts.groupBy("key").count().filter("count > 1").isEmpty():
        raise Collision
    inner = by_length(lambda d: F.array(*[F.xxhash64(*w[i : i + k]) for k in range(2, d) for i in range(d - k + 1)]) if d > 2 else F.array().cast("array<bigint>"))
    longer = nodes.select(F.explode(inner).alias("key"), "n").groupBy("key").agg(F.max("n").alias("longer"))
    covered = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("n").cast("decimal(20,0)") * cover
    kept = nodes.join(longer, "key", "left").filter(~F.coalesce(covered, F.lit(False)))
    cut = by_length(lambda d: F.array(*[F.struct(F.lit(k).alias("k"), key_of(w[:k]).alias("head"), key_of(w[k:d]).alias("rest")) for k in range(1, d)]))
    cuts = kept.select("key", "n", F.explode(cut).alias("c")).select("key", "n", "c.*")
    heads, rests = counts.select(F.col("key").alias("head"), F.col("part_n").alias("l")), counts.select(F.col("key").alias("rest"), F.col("part_n").alias("r"))
    cuts = cuts.join(heads, "head").join(rests, "rest")
    score = F.expr("(cast(n as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)")
    best = cuts.withColumn("score", score).groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return kept.join(best, "key").select("key", *[f"w{i + 1}" for i in range(DEPTH)], F.col("n").alias("a"), "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, cover: int = 80, budget: int = 1 << 20, seed: int = 0, tries: int = 4) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of two to four
    words of each language; docs: text, lang (further columns are ignored).

    Null texts are empty, a null lang is `und`. Repeated rows count as often as
    they stand there. Languages without a candidate have no row. Equal scores
    and counts go by the phrase's bytes. budget is the number of suffixes that
    one task builds its subtrees from."""
    for attempt in range(tries):
        try:
            words, nodes, bits, shift = phrase_counts(docs, least, budget, seed + attempt)
            found = stage(scored(words, nodes, least, cover), "phrase-scores")
        except Collision:
            continue
        per_lang = words.groupBy("lang").agg(F.sum("n").alias("n"))
        first = words.filter(F.col("n") >= least).select(F.col("short").alias("w1"), "lang")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        top = stage(found.join(first, "w1").withColumn("place", F.rank().over(order)).filter(F.col("place") <= most), "phrase-top")
        needed = top.select(F.explode(F.array(*[f"w{i + 1}" for i in range(DEPTH)])).alias("key")).filter("key <> 0").distinct()
        needed = docs.sparkSession.sparkContext.broadcast(frequent_filter(needed))
        named = plain(docs).mapInArrow(word_reader(seed + attempt, bits, needed, shift), "key long, word string").groupBy("key").agg(F.min("word").alias("word"), F.max("word").alias("other"))
        named = stage(named, "phrase-words-read")
        if not named.filter("word <> other").isEmpty():
            continue
        for i in range(1, DEPTH + 1):
            top = top.join(named.select(F.col("key").alias(f"w{i}"), F.col("word").alias(f"t{i}")), f"w{i}", "left")
        top = top.withColumn("phrase", F.concat_ws(" ", *[f"t{i + 1}" for i in range(DEPTH)]))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        top = top.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
        return top.join(per_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    raise RuntimeError(f"hashes collide under {tries} seeds")


ORACLE = """
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p),
s as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
g as (select lang, ws[i:i + k - 1] as ph, k from s, (select unnest([1, 2, 3, 4]) as k) where i + k - 1 <= len(ws)),
f as (select lang, ph, k, count(*) as a from g group by lang, ph, k),
c as (select * from f where k >= 2 and a >= 30),
inner_ph as (select lang, a, k as long_k, ph[i:i + m - 1] as ph
  from c, (select unnest([2, 3]) as m), (select unnest([1, 2, 3]) as i) where m < k and i + m - 1 <= k),
covered as (select lang, ph, max(a) as longer from inner_ph group by lang, ph),
kept as (select c.* from c left join covered v using (lang, ph) where not coalesce(100 * v.longer >= 80 * c.a, false)),
cut as (select kept.lang, kept.ph, kept.a, m as cut_at, h.a as l, r.a as r, (2000000 * cast(kept.a as hugeint)) // (h.a + r.a) as score
  from kept, (select unnest([1, 2, 3]) as m), f h, f r
  where m < kept.k and h.lang = kept.lang and h.ph = kept.ph[1:m] and r.lang = kept.lang and r.ph = kept.ph[m + 1:]),
best as (select * from cut qualify row_number() over (partition by lang, ph order by score, cut_at) = 1),
total as (select lang, sum(a) as n from f where k = 1 group by lang),
ranked as (select lang, array_to_string(ph, ' ') as phrase, a, l, r, score,
  row_number() over (partition by lang order by score desc, a desc, array_to_string(ph, ' ')) as rank from best)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked join total using (lang) where rank <= 2000
"""
