"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from evidentia.sources.shared import broadcast_if_small, shared_dir, stage
from evidentia.sources.shared import cut as checkpoint

__all__ = ["broadcast_if_small", "checkpoint", "chunks", "give_back", "mix64", "shared_dir", "shingle_sets", "slices", "stage", "table", "word_hashes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the system, at the end of a task that made large
    arrays; else a worker keeps the most that any of its tasks has used."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# --------------------------------------------------------------------- hashes
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 bits (uint64, wraps)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: One random 64-bit value for each byte.
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[str | None], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Words are runs of characters outside x20 and x09-x0D, A-Z lower-cased
    unless fold is off.
    Returns the index of the text and a 64-bit hash of each word, in order."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    whole = b" ".join(raw) + b" "
    data = np.frombuffer(whole.lower() if fold else whole, np.uint8)
    blank = SPACE[data]
    first = ~blank
    first[1:] &= blank[:-1]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = np.cumsum(first) - 1
    at = np.arange(len(data)) - start[np.maximum(word, 0)]
    at[blank] = 0
    power = np.full(int(at.max()) + 1, 0x100000001B3, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    value = BYTE[data] * power[at]
    value[blank] = 0
    sums = np.add.reduceat(value, start)
    length = np.add.reduceat((~blank).astype(np.uint64), start)
    doc = np.searchsorted(np.cumsum(size), start, side="right")
    return doc, mix64(sums + length * _U(0xD6E8FEB86659FD93))


def slices(batches, column: int, most_chars: int = 3_000_000):
    """Arrow batches cut so that each has about most_chars bytes in a text
    column, whatever the lengths of its texts; a text is never cut."""
    import pyarrow.compute as pc

    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < b.num_rows:
            before = size[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(size, before + most_chars, side="right")))
            yield b.slice(low, high - low)
            low = high


def chunks(texts: list[str | None], most_chars: int = 1_500_000):
    """Index ranges of texts that hold about most_chars characters each."""
    low, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= most_chars:
            yield low, i + 1
            low, held = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles of each text, sorted by text, then hash.
    A text with fewer words than width has its whole sequence as one shingle;
    a text without words has none. Returns text index and hash."""
    docs, hashes = [], []
    for low, high in chunks(texts):
        doc, word = word_hashes(texts[low:high])
        if not len(doc):
            continue
        n = np.bincount(doc, minlength=high - low)
        found_d, found_h = [], []
        for k in range(1, width + 1):
            if len(word) < k:
                break
            h = np.full(len(word) - k + 1, k, np.uint64)
            for j in range(k):
                h = mix64(h * _U(0x9E3779B97F4A7C15) + word[j : len(word) - k + 1 + j]) if j + 1 == k else h * _U(0xC2B2AE3D27D4EB4F) + word[j : len(word) - k + 1 + j]
            d = doc[: len(h)]
            same = d == doc[k - 1 :]
            keep = same if k == width else same & (n[d] == k)
            found_d.append(d[keep])
            found_h.append(h[keep])
        d, h = np.concatenate(found_d), np.concatenate(found_h)
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        docs.append(d[new] + low)
        hashes.append(h[new])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(hashes)
