"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes
log-count ratios, trained on labelled text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import checkpoint, chunks, slices, stage

_U = np.uint64
BITS = 20


def _ngrams(texts, low_n, high_n):
    """Text index and bucket (BITS bits) of every n-gram of lower-cased code
    points, of low_n to high_n. Yields a pair for each n and stretch of texts."""
    for low, high in chunks(texts, 500_000):
        part = [" " + (t or "").lower() + " " for t in texts[low:high]]
        size = np.fromiter(map(len, part), np.int64, len(part))
        code = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        code[code < 33] = 32
        doc = np.repeat(np.arange(low, high), size)
        h = np.zeros(len(code), np.uint64)
        for k in range(high_n):
            if len(code) <= k:
                break
            h = h[: len(code) - k] * _U(0x9E3779B97F4A7C15) + code[k:] + _U(1)
            if k + 1 >= low_n:
                inside = doc[: len(h)] == doc[k:]
                yield doc[: len(h)][inside], (((h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)) >> _U(64 - BITS))[inside].astype(np.int64)


def _bucket_counts(low_n, high_n):
    def run(batches):
        counts = np.zeros((2, 1 << BITS), np.int64)
        for b in slices(batches, 0):
            texts, label = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for d, g in _ngrams(texts, low_n, high_n):  # a text is whole within a stretch
                every = np.unique((d << BITS) | g)
                side = label[every >> BITS]
                for c in (0, 1):
                    counts[c] += np.bincount(every[side == c] & ((1 << BITS) - 1), minlength=1 << BITS)
        held = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[0, held]), pa.array(counts[1, held])], ["g", "clean", "toxic"])

    return run


def _chosen_ids(low_n, high_n, chosen):
    """Sorted distinct features of each text, as text index and feature."""

    def of(texts):
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        found = [np.zeros(0, np.int64)]
        for d, g in _ngrams(texts, low_n, high_n):
            f = place[g]
            hit = f >= 0
            found.append((d[hit] << 32) | f[hit])
        every = np.unique(np.concatenate(found))
        return every >> 32, every & 0xFFFFFFFF

    return of


def _features(low_n, high_n, chosen):
    def run(batches):
        of = _chosen_ids(low_n, high_n, chosen.value)
        for b in slices(batches, 0):
            d, f = of(b.column(0).to_pylist())
            lists = np.split(f.astype(np.uint16), np.cumsum(np.bincount(d, minlength=b.num_rows))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in lists], pa.binary()), b.column(1)], ["f", "label"])

    return run


def _scores(low_n, high_n, model, last):
    def run(batches):
        chosen, weight, bias = model.value
        of = _chosen_ids(low_n, high_n, chosen)
        for b in slices(batches, last):
            d, f = of(b.column(last).to_pylist())
            z = bias + np.bincount(d, weights=weight[f], minlength=b.num_rows)
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], [*b.schema.names[:-1], "score"])

    return run


def _fit(at, feature, label, scale, penalty, steps):
    """Logistic regression on scaled presence features with an L2 penalty, by
    L-BFGS from zero; the same result for the same rows."""
    n, k = len(label), len(scale)

    def cost(x):
        loss, grad, w = 0.0, np.zeros(k + 1), scale * x[:k]
        for low in range(0, n, 2000):  # some rows at a time, for memory
            high = min(low + 2000, n)
            f = feature[at[low] : at[high]]
            owner = np.repeat(np.arange(high - low), np.diff(at[low : high + 1]))
            z = x[k] + np.bincount(owner, weights=w[f], minlength=high - low)
            off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label[low:high]
            loss += np.sum(np.logaddexp(0, z) - label[low:high] * z)
            grad[:k] += np.bincount(f, weights=off[owner], minlength=k)
            grad[k] += off.sum()
        grad[:k] = grad[:k] * scale + n * penalty * x[:k]
        return loss / n + penalty / 2 * (x[:k] @ x[:k]), grad / n

    x = np.append(np.zeros(k), np.log((label.sum() + 1) / (n - label.sum() + 1)))
    loss, grad = cost(x)
    moves = []  # the last ten steps and changes of the gradient
    for _ in range(steps):
        way, kept = grad.copy(), []
        for s, y in reversed(moves):
            a = (s @ way) / (s @ y)
            way -= a * y
            kept.append(a)
        if moves:
            s, y = moves[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(moves, reversed(kept), strict=True):
            way += s * (a - (y @ way) / (s @ y))
        length, slope = 1.0 if moves else 1 / max(1.0, float(np.linalg.norm(grad))), grad @ way
        while True:
            new_loss, new_grad = cost(x - length * way)
            if new_loss <= loss - 1e-4 * length * slope or length < 1e-8:
                break
            length /= 2
        s, y = -length * way, new_grad - grad
        x, done, loss, grad = x + s, loss - new_loss < 1e-9, new_loss, new_grad
        if s @ y > 1e-12:
            moves = [*moves[-9:], (s, y)]
        if done:
            break
    return x[:k], x[k]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", low_n: int = 3, high_n: int = 6, most_rows: int = 30_000, features: int = 4096, least_seen: int = 5, smoothing: float = 1.0, penalty: float = 1e-4, steps: int = 100):
    """Fit on the rows of labels that docs has, at most `most_rows` of them,
    those with the smallest hash of the id. Ids with several labels count as 1
    if any is 1; ids labelled null are left out; equal texts are one row.

    Presence of character n-grams (low_n to high_n, hashed to 2 ** BITS
    buckets) is counted by class. The log-count ratio r of each bucket scales
    its feature; the `features` buckets whose ratio is the most standard errors
    from zero are kept, of those in least_seen rows and more. Returns (buckets, weights with the ratio in them, bias),
    some ten thousand numbers.

    With no rows, or rows of one class only, no bucket is kept and the bias
    gives the share of that class, smoothed."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("label")).filter("i is not null and label is not null").groupBy("i").agg(F.max("label").alias("label"))
    known = checkpoint(known.orderBy(F.xxhash64("i"), "i").limit(most_rows))  # bounded, so it may be broadcast
    text = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    sample = text.join(F.broadcast(known), "i").groupBy(F.xxhash64("t").alias("h")).agg(F.first("t").alias("t"), F.max("label").alias("label")).select("t", "label")
    sample = stage(sample, "labelled")
    by_class = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = by_class.get(0, 0), by_class.get(1, 0)
    if not clean or not toxic:
        return np.zeros(0, np.int64), np.zeros(0), float(np.log((toxic + 0.5) / (clean + 0.5)))
    counts = sample.mapInArrow(_bucket_counts(low_n, high_n), "g long, clean long, toxic long").groupBy("g").agg(F.sum("clean").alias("c0"), F.sum("toxic").alias("c1"))
    p = (F.col("c1") + smoothing) / F.lit(toxic + 2 * smoothing)
    q = (F.col("c0") + smoothing) / F.lit(clean + 2 * smoothing)
    error = F.sqrt(1 / (F.col("c1") + smoothing) + 1 / (F.col("c0") + smoothing))
    ratio = counts.filter(F.col("c0") + F.col("c1") >= least_seen).select("g", F.log(p / q).alias("r"), F.abs(F.log(p / q) / error).alias("z"))
    top = ratio.orderBy(F.desc("z"), "g").limit(features).toArrow().sort_by("g")  # at most `features` rows
    chosen, scale = top["g"].to_numpy().astype(np.int64), top["r"].to_numpy().astype(np.float64)
    if features > 1 << 16:
        raise ValueError("features is at most 65536")
    rows = sample.mapInArrow(_features(low_n, high_n, spark.sparkContext.broadcast(chosen)), "f binary, label int").toArrow()  # at most most_rows short lists
    lists = rows["f"].to_pylist()
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)) // 2)])
    feature, label = np.frombuffer(b"".join(lists), np.uint16), rows["label"].to_numpy().astype(np.float64)
    del rows, lists
    weight, bias = _fit(at, feature, label, scale, penalty, steps)
    return chosen, weight * scale, bias


def score(docs: DataFrame, model, text_col: str = "text", low_n: int = 3, high_n: int = 6) -> DataFrame:
    """docs with score (0 to 1, higher: toxic is likelier) in place of a column
    of that name. Null and empty texts get the score of a text without any
    feature. Each row is judged by itself and whole; no shuffle."""
    from pyspark.sql import types as T

    kept = [c for c in docs.columns if c != "score"]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_scores(low_n, high_n, docs.sparkSession.sparkContext.broadcast(model), len(kept)), schema)
