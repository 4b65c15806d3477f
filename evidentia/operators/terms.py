"""Very many literal terms in texts: an index by beginnings instead of a try each."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import norm_words
from evidentia.sources.shared import broadcast_if_small, cut, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

#: Lengths of keys: a term's is the greatest that it has (fixed values).
KEY_SIZES = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32)
#: Characters of texts that are looked up at once.
PIECE = 1_000_000
#: Terms that are sent to all tasks, at most; beyond, likely substrings are shuffled.
BROADCAST_TERMS = 300_000
#: Bits of the filter for each key, and the probes of a key.
KEY_BITS, PROBES = 32, 3

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes spread over 64 bits (uint64, wraps)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size characters."""
    h = np.full(len(points) - size + 1, size, _U)
    for i in range(size):
        h = (h ^ points[i : len(points) - size + 1 + i]) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return _mixed(h)


def _held(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indices of hashes that may be those of keys."""
    at, shift = np.arange(len(h)), _U(64 - (8 * len(bits)).bit_length() + 1)
    for i in range(PROBES):
        spot = _mixed(h[at] + _U(i)) >> shift
        at = at[(bits[spot >> _U(3)] >> (spot & _U(7)).astype(np.uint8)) & 1 == 1]
    return at


def _key_filter(keys: DataFrame):
    """A filter of keys (a Bloom filter), broadcast: KEY_BITS bits for each."""

    def hashed(batches):
        for b in batches:
            h = [_hashes(_characters(k), len(k))[0] for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, _U).view(np.int64))], ["h"])

    h = keys.mapInArrow(hashed, "h long").toArrow()["h"].to_numpy().astype(np.int64).view(_U)
    bits = np.zeros(max(128, (1 << (KEY_BITS * len(h)).bit_length()) // 8), np.uint8)
    shift = _U(64 - (8 * len(bits)).bit_length() + 1)
    for i in range(PROBES):
        spot = _mixed(h + _U(i)) >> shift
        np.bitwise_or.at(bits, spot >> _U(3), np.left_shift(1, spot & _U(7)).astype(np.uint8))
    return keys.sparkSession.sparkContext.broadcast(bits)


def _likely(sizes: list[int], bits):
    """id, key: the different substrings of a text, of the sizes, that the filter
    holds; texts go in overlapping pieces."""

    def out(b, rows, keys):
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.string())], ["__id", "key"])

    def run(batches):
        for b in batches:
            rows, keys = [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                if len(keys) > 100_000:
                    yield out(b, rows, keys)
                    rows, keys = [], []
                found, points = set(), _characters(text)
                for k in sizes:
                    for low in range(0, len(points) - k + 1, PIECE):
                        at = _held(_hashes(points[low : low + PIECE + k - 1], k), bits.value)
                        found.update(text[low + i : low + i + k] for i in at.tolist())
                rows += [row] * len(found)
                keys += found
            yield out(b, rows, keys)

    return run


def term_hits(df: DataFrame, id_col: str, text_col: str, terms: DataFrame, term_col: str) -> DataFrame:
    """id, term: the terms that a text contains anywhere, upper and lower case
    alike. ids are unique; null texts and empty or null terms give nothing.

    Terms are keyed by a beginning nearly as long as they are, so a key's terms
    are few. Substrings of texts are looked up in a filter of all keys, 4 bytes
    for each, and only those that it holds (one in a thousand besides the keys)
    are joined to the keys, so substrings are not shuffled however many keys
    there are. Terms that are their own key are hits at once; only the others
    are looked for in the text."""
    size = F.greatest(*[F.when(F.length("term") >= k, k) for k in KEY_SIZES])
    t = terms.select(F.lower(F.col(term_col)).alias("term")).filter("term <> ''").distinct().withColumn("size", size).withColumn("key", F.expr("left(term, size)"))
    t = stage(t.select("term", "size", "key", (F.col("key") == F.col("term")).alias("whole")), "terms")
    sizes = sorted(r[0] for r in t.select("size").distinct().collect())  # as many as KEY_SIZES at most
    texts = df.select(F.col(id_col).alias("__id"), F.lower(F.col(text_col)).alias("__low")).filter("__low <> ''")
    bits = _key_filter(t.select("key").distinct())
    found = texts.mapInArrow(_likely(sizes, bits), f"__id {texts.schema['__id'].dataType.simpleString()}, key string")
    known = t.select("key", "term", "whole")
    known = F.broadcast(known) if t.count() <= BROADCAST_TERMS else known.hint("merge")
    pairs = found.join(known, "key")
    sure = pairs.filter("whole").select("__id", "term")
    if t.filter("not whole").isEmpty():
        return sure.select(F.col("__id").alias(id_col), "term")
    rest = pairs.filter("not whole").join(texts, "__id").filter(F.contains("__low", F.col("term"))).select("__id", "term")
    return sure.union(rest).select(F.col("__id").alias(id_col), "term")


def name_hits(df: DataFrame, id_col: str, text_col: str, names: DataFrame, name_col: str, least: int = 5) -> DataFrame:
    """id, name, size, n: names found as whole runs of words, separators alike.
    size is the length of the match; the name itself is for joins, not for
    reports. A name of one word does not count where the next words make it a
    longer name of the list. Names under `least` characters are left out.

    Places are not compared: where a longer name stands, so do those that it
    begins with. A longer name that begins with no other longer name thus takes
    one off its first word, and hits are summed before they are shuffled."""
    norm = names.select(norm_words(name_col).alias("name")).filter(F.length("name") >= least).distinct()
    norm = cut(norm.withColumn("w", F.size(F.split("name", " "))))
    sizes = sorted(r[0] for r in norm.select("w").distinct().collect())  # a handful of word counts
    starts = norm.filter("w > 2").select("name", F.explode(F.expr("transform(sequence(2, w - 1), k -> substring_index(name, ' ', k))")).alias("start"))
    begun = starts.join(norm.select(F.col("name").alias("start")), "start", "left_semi").select("name")
    off = norm.filter("w > 1").join(begun, "name", "left_anti").select(F.col("name").alias("run"), F.substring_index("name", " ", 1).alias("name"), F.lit(-1).alias("d"))
    off = off.join(norm.filter("w = 1").select("name"), "name", "left_semi").select("run", "name", "d")
    effect = cut(norm.select(F.col("name").alias("run"), "name", F.lit(1).alias("d")).union(off))
    words = df.select(F.col(id_col).alias("__id"), F.split(norm_words(text_col), " ").alias("tw"))

    def runs(k: int):
        if k == 1:
            return F.col("tw")
        each = F.transform(F.sequence(F.lit(1), F.size("tw") - (k - 1)), lambda i: F.array_join(F.slice("tw", i, k), " "))
        return F.when(F.size("tw") >= k, each).otherwise(F.array().cast("array<string>"))

    every = F.concat(*[runs(k) for k in sizes]) if sizes else F.array().cast("array<string>")
    rows = words.select("__id", F.explode(every).alias("run")).join(broadcast_if_small(effect, 1_000_000), "run")
    found = rows.groupBy(F.col("__id").alias(id_col), "name").agg(F.sum("d").alias("n")).filter("n > 0")
    return found.withColumn("size", F.length("name"))
