"""Quality rules: fixed limits, then robust multivariate outliers.

Each document becomes a vector of transformed statistics. For each language and
source, location and scatter come from the minimum covariance determinant: the
share of vectors whose covariance has the least determinant, found by
concentration steps from two starts. A step reads all vectors once: distances
fall into narrow bins, sums of each bin are exact integers, and the bins that
hold the nearest share give the next estimate. So no group is gathered, however
large, and reruns agree to the last bit. Documents far away in Mahalanobis
distance are rejected.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import SPACE, broadcast_if_small, checkpoint, give_back, mix64, slices, stage, word_hashes

#: Fixed values of the base rules.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*b"#*$%&|<>"]] = True
WINDOW = 5
#: Statistics of the vector and the least standard deviation that each is held to
#: have: a statistic that is nought in most documents (symbols, repeats) has no
#: spread of its own, and a deviation in it should still be one that is seen.
FLOORS = {"x_words": 0.5, "x_length": 0.04, "x_symbols": 0.045, "x_lines": 0.15, "x_repeats": 0.15, "x_capitals": 0.05}
NAMES = list(FLOORS)
P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Vectors are whole numbers of this part of one.
UNIT = 512
#: Bins of distances in each doubling.
FINE = 32
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def statistics_of(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Counts of each text; see quality_rules for their meaning."""
    n = len(texts)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    text = np.repeat(np.arange(n), [len(r) + 1 for r in raw])
    inside = ~SPACE[b]

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(text[mask], minlength=n).astype(np.int64)

    doc, word = word_hashes(texts, fold=False)
    out = {"n_words": np.bincount(doc, minlength=n).astype(np.int64), "word_chars": count(inside & (b & 0xC0 != 0x80)), "n_symbols": count(SYMBOLS[b]), "n_capitals": count((b >= 65) & (b <= 90))}
    repeats = np.zeros(n, np.int64)
    if len(word) >= WINDOW:
        h = np.zeros(len(word) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + word[k : len(h) + k])
        at = np.flatnonzero(doc[: len(h)] == doc[WINDOW - 1 :])
        order = at[np.lexsort((h[at], doc[at]))]
        same = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        again = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        edge = np.zeros(len(word) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + WINDOW, -1)
        repeats = np.bincount(doc[np.cumsum(edge)[:-1] > 0], minlength=n).astype(np.int64)
    out["n_repeat_words"] = repeats
    lines = [[x for x in (t or "").split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")] for t in texts]
    out["n_lines"] = np.fromiter(map(len, lines), np.int64, n)
    out["n_dup_lines"] = out["n_lines"] - np.fromiter((len(set(x)) for x in lines), np.int64, n)
    return out


def add_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and the counts of text, which is left out."""
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, 0, 500_000):
            found = statistics_of(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *[pa.array(found[c]) for c in COUNTS]], [*keep, *COUNTS])
        give_back()

    return docs.select("text", *keep).mapInArrow(run, schema)


def vector() -> list[Column]:
    """Transformed statistics. Shares are smoothed by a constant, as those of a
    short text vary widely, and their roots taken, as those are."""
    words, chars, lines = (F.col(c) for c in ("n_words", "word_chars", "n_lines"))
    raw = {
        "x_words": F.log1p(words),
        "x_length": F.log((chars + 100) / (words + 20)),
        "x_symbols": F.sqrt(F.col("n_symbols") / (chars + 20)),
        "x_lines": F.sqrt(F.col("n_dup_lines") / (lines + 8)),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / (words + 20)),
        "x_capitals": F.sqrt((F.col("n_capitals") + 3) / (chars + 100)),
    }
    return [F.round(raw[c] * UNIT).cast("long").alias(c) for c in NAMES]


def distance() -> Column:
    """Squared Mahalanobis distance under m_*, q_* (inverse scatter)."""
    out = F.lit(0.0)
    for i, j in PAIRS:
        d = (F.col(NAMES[i]) / UNIT - F.col(f"m_{i}")) * (F.col(NAMES[j]) / UNIT - F.col(f"m_{j}")) * F.col(f"q_{i}_{j}")
        out = out + (d if i == j else 2 * d)
    return F.greatest(out, F.lit(0.0))


ESTIMATE = "grp string, start string, n long, logdet double, " + ", ".join([f"m_{i} double" for i in range(P)] + [f"q_{i}_{j} double" for i, j in PAIRS])


def sums() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(NAMES)], *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s_{i}_{j}") for i, j in PAIRS]]


def estimates(sums: DataFrame) -> DataFrame:
    """Location, inverse scatter and its log determinant, from sums of a group
    and start. The floors are added to the scatter, so it always has an inverse."""
    floor = np.diag(np.array(list(FLOORS.values())) ** 2)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n = b.column("n").to_numpy().astype(float)
            mean = np.stack([b.column(f"s_{i}").to_numpy() for i in range(P)], 1) / UNIT / n[:, None]
            scatter = np.zeros((len(n), P, P))
            for i, j in PAIRS:
                scatter[:, i, j] = scatter[:, j, i] = b.column(f"s_{i}_{j}").to_numpy() / UNIT**2 / n - mean[:, i] * mean[:, j]
            scatter += floor
            inverse = np.linalg.inv(scatter)
            columns = [b.column("grp"), b.column("start"), b.column("n"), pa.array(np.linalg.slogdet(scatter)[1])]
            columns += [pa.array(mean[:, i]) for i in range(P)] + [pa.array(inverse[:, i, j]) for i, j in PAIRS]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ESTIMATE.split(", ")])

    return sums.mapInArrow(run, ESTIMATE)


def starts(vectors: DataFrame) -> DataFrame:
    """Two starts a group: all of its vectors, and coordinatewise medians with
    median absolute deviations. Coordinates are whole numbers of a narrow range,
    so exact medians hold a bounded table."""
    medians = checkpoint(vectors.groupBy("grp").agg(*[F.median(c).alias(f"m_{i}") for i, c in enumerate(NAMES)]))
    both = vectors.join(broadcast_if_small(medians, 100_000), "grp")
    spread = both.groupBy("grp").agg(F.count("*").alias("n"), *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(P)], *[F.median(F.abs(F.col(c) - F.col(f"m_{i}"))).alias(f"d_{i}") for i, c in enumerate(NAMES)])
    rows = [F.lit("median").alias("start"), "n", F.lit(float("inf")).alias("logdet"), *[(F.col(f"m_{i}") / UNIT).alias(f"m_{i}") for i in range(P)]]
    for i, j in PAIRS:
        scale = F.greatest(F.col(f"d_{i}") / UNIT * 1.4826, F.lit(FLOORS[NAMES[i]]))
        rows.append((1 / (scale * scale) if i == j else F.lit(0.0)).alias(f"q_{i}_{j}"))
    plain = estimates(vectors.groupBy("grp").agg(*sums()).withColumn("start", F.lit("all")))
    return checkpoint(plain.unionByName(spread.select("grp", *rows)))


def binned(vectors: DataFrame, now: DataFrame, found: list[Column]) -> DataFrame:
    rows = vectors.join(broadcast_if_small(now.drop("n", "logdet"), 100_000), "grp")
    place = F.floor(F.log2(distance() + 2**-20) * FINE).cast("int")
    return rows.withColumn("bin", place).groupBy("grp", "start", "bin").agg(*found)


def nearest(bins: DataFrame, share: float) -> DataFrame:
    """The bins that hold at least share of a group's vectors, nearest first."""
    each = Window.partitionBy("grp", "start")
    before = F.sum("n").over(each.orderBy("bin")) - F.col("n")
    return bins.withColumn("before", before).withColumn("all", F.sum("n").over(each)).filter(F.col("before") < F.col("all") * share)


def least_determinant(vectors: DataFrame, share: float, steps: int) -> DataFrame:
    """Estimate of each group: concentration steps until no determinant falls,
    then the better start; with scale, by which distances are divided so that
    their median is not above that of a normal sample."""
    now = starts(vectors)
    for _ in range(steps):
        kept = nearest(binned(vectors, now, sums()), share).groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in ["n", *[f"s_{i}" for i in range(P)], *[f"s_{i}_{j}" for i, j in PAIRS]]])
        new = checkpoint(estimates(kept))
        moved = new.join(now.select("grp", "start", F.col("logdet").alias("old")), ["grp", "start"]).filter(F.abs(F.col("logdet") - F.col("old")) > 1e-6)
        done = moved.isEmpty()
        now = new
        if done:
            break
    best = Window.partitionBy("grp").orderBy("logdet", "start")
    now = checkpoint(now.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place"))
    middle = nearest(binned(vectors, now, [F.count("*").alias("n")]), 0.5).groupBy("grp").agg(F.max("bin").alias("bin"))
    scale = F.greatest(F.pow(F.lit(2.0), (F.col("bin") + 1) / FINE) / chi_square(0.5), F.lit(1.0))
    return checkpoint(now.join(middle.select("grp", scale.alias("scale")), "grp"))


def chi_square(tail: float) -> float:
    """The value that a chi-square variable of P (even) degrees exceeds with
    probability tail."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 4
        above = math.exp(-x) * sum(x**k / math.factorial(k) for k in range(P // 2))
        low, high = ((low + high) / 2, high) if above > tail else (low, (low + high) / 2)
    return (low + high) / 2


def groups_of(vectors: DataFrame, fewest: int) -> DataFrame:
    """lang, source -> grp. Sources with fewer vectors are judged together within
    their language, such languages together; what is left without enough has no
    group and no verdict against it."""
    each = checkpoint(vectors.groupBy("lang", "source").agg(F.count("*").alias("n")))
    small = F.col("n") < fewest
    lang = Window.partitionBy("lang", "small")
    rows = each.withColumn("small", small).withColumn("of_lang", F.sum("n").over(lang))
    rest = rows.withColumn("rest", F.col("small") & (F.col("of_lang") < fewest))
    total = rest.filter("rest").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("of_rest"))
    name = F.when(~F.col("small"), F.to_json(F.struct("lang", "source"))).when(~F.col("rest"), F.to_json(F.struct("lang"))).when(F.col("of_rest") >= fewest, "rest")
    return checkpoint(rest.crossJoin(F.broadcast(total)).select("lang", "source", name.alias("grp")))


def judge(docs: DataFrame, keep: list[str], share: float = 0.75, fewest: int = 60, tail: float = 1e-6, steps: int = 15) -> DataFrame:
    """keep columns, counts of the text, base_failed, distance (null: not
    judged) and kept; docs: text, lang, source and the keep columns.

    n_words: words `[^\\x20\\x09-\\x0D]+`; word_chars: their code points;
    n_symbols; n_dup_lines: lines with a word that equal an earlier one;
    n_repeat_words: words in windows of five that stand twice or more in the
    text. base_failed: under ten words, or over a fifth of them repeated.

    A document's distance is squared and on the scale of a chi-square variable;
    it is rejected where that has a tail under `tail`. Estimates are made from
    the different vectors of documents that pass the base rules: copies count
    once, or a group of copies would be the norm of its source. Null texts have no words;
    null languages and sources are values as others. Repeated rows are judged
    alike. An empty table gives no rows."""
    keep = list(dict.fromkeys([*keep, "lang", "source"]))
    rows = add_statistics(docs, keep)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = stage(rows.select("*", failed.alias("base_failed"), *vector()), "quality-statistics")
    vectors = stage(rows.filter("not base_failed").select("lang", "source", *NAMES).distinct(), "quality-vectors")
    groups = groups_of(vectors, fewest)

    def with_group(df: DataFrame) -> DataFrame:
        g = broadcast_if_small(groups.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), "grp"), 1_000_000)
        return df.join(g, F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s")), "left").drop("__l", "__s")

    placed = stage(with_group(vectors).filter("grp is not null").drop("lang", "source"), "quality-groups")
    found = least_determinant(placed, share, steps)
    judged = with_group(rows).join(broadcast_if_small(found.drop("n", "logdet", "start"), 100_000), "grp", "left")
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), distance() / F.col("scale")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square(tail), F.lit(True))
    return judged.select(*keep, *COUNTS, "base_failed", "distance", kept.alias("kept"))
