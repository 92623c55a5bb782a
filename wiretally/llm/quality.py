"""Quality rules and robust multivariate outliers (minimum covariance determinant) by language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import batches, text_bytes, tokens, window_hashes, word_hashes, written

SYMBOLS = b"#*$%&|<>"  # fixed values of the rule
MARKS = b".,;:!?"
FEATURES = ("log_words", "word_length", "symbol_rate", "line_copies", "repeats", "capitals", "marks")
P = len(FEATURES)
#: Share of a group's rows that the estimate is made of, and rounds of concentration.
KEPT_SHARE = 0.75
ROUNDS = 6
#: Groups with fewer rows are judged with all small groups together.
LEAST_ROWS = 50
#: A row is rejected beyond this multiple of the chi-square quantile at 0.999.
SLACK = 4.0
#: Least standard deviation of a feature, so that a feature that is constant in a group doesn't make distances infinite.
FLOORS = (1.5, 0.5, 0.6, 0.1, 0.15, 0.06, 0.07)
BINS = 24

STATS = ("doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "n_capitals long, n_marks long")
_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_MARK = np.zeros(256, np.int64)
_MARK[list(MARKS)] = 1
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1


def text_stats(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_marks."""
    words = tokens(text)
    seen, copies = set(), 0
    for line in text.split(b"\n"):
        if line.split(None, 1):
            copies += line in seen
            seen.add(line)
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    chars = int(counts[:128].sum() + counts[192:].sum()) - int(counts[[32, 9, 10, 11, 12, 13]].sum())  # code points, no blanks
    windows, covered = window_hashes(word_hashes(words), 5), 0
    if len(windows) > 1:
        _, inverse, often = np.unique(windows, return_inverse=True, return_counts=True)
        at = np.flatnonzero(often[inverse] > 1)
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + 5, -1)
        covered = int((np.cumsum(marks)[:-1] > 0).sum())
    return (len(words), chars, int((counts * _SYMBOL).sum()), copies, covered, int((counts * _CAPITAL).sum()), int((counts * _MARK).sum()))


def statistics(docs: DataFrame) -> DataFrame:
    """Counts of every whole text; null counts as empty. ``n_repeat_words``: words in 5-word windows found twice or more."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 512):
            found = list(zip(*map(text_stats, text_bytes(batch)), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(c, pa.int64()) for c in found)],
                                             [x.split()[0] for x in STATS.split(", ")])

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, STATS)


def chi_square(share: float, df: int) -> float:
    """Quantile by Wilson and Hilferty's cube."""
    from statistics import NormalDist
    return df * (1 - 2 / (9 * df) + NormalDist().inv_cdf(share) * (2 / (9 * df)) ** 0.5) ** 3


def _vectors(stats: DataFrame) -> DataFrame:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return stats.withColumns({
        "log_words": F.log(words + 1.0), "word_length": F.col("word_chars") / words, "symbol_rate": F.log1p(100.0 * F.col("n_symbols") / words),
        "line_copies": F.sqrt(F.col("n_dup_lines") / words), "repeats": F.sqrt(F.col("n_repeat_words") / words),
        "capitals": F.sqrt(F.col("n_capitals") / chars), "marks": F.sqrt(F.col("n_marks") / chars)})


def _nearest_moments(rows: DataFrame) -> DataFrame:
    """Per group n, sums and products of the KEPT_SHARE of its rows with the least ``distance``, up to the end of a bin. Rows are
    combined by (group, bin) before the only shuffle they take part in; a group has a few hundred bins whatever its size."""
    x = [F.col(c) for c in FEATURES]
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    parts = {f"s{i}": F.sum(x[i]) for i in range(P)} | {f"p{i}_{j}": F.sum(x[i] * x[j]) for i, j in pairs}
    bins = rows.groupBy("grp", _bin().alias("bin")).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in parts.items()])
    by = Window.partitionBy("grp")
    near = bins.withColumns({"before": F.sum("n").over(by.orderBy("bin")) - F.col("n"), "all": F.sum("n").over(by)}).where(
        F.col("before") < F.col("all") * KEPT_SHARE)
    return near.groupBy("grp").agg(F.sum("n").alias("n"), F.array(*[F.sum(f"s{i}") for i in range(P)]).alias("sums"),
                                   F.array(*[F.sum(f"p{i}_{j}") for i, j in pairs]).alias("products"))


def _ellipsoids(moments: DataFrame) -> DataFrame:
    """(grp, centre, precision): mean and inverse covariance of each group's row of sums."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            centres, inverses = [], []
            for r in batch.to_pylist():
                mean = np.array(r["sums"]) / r["n"]
                cov = np.zeros((P, P))
                cov[np.tril_indices(P)] = np.array(r["products"]) / r["n"]
                cov = cov + np.tril(cov, -1).T - np.outer(mean, mean)
                cov += np.diag(np.maximum(np.array(FLOORS) ** 2 - np.diag(cov), 1e-6))
                centres.append(mean.tolist())
                inverses.append(np.linalg.inv(cov).ravel().tolist())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array(centres, kind), pa.array(inverses, kind)], ["grp", "centre", "precision"])

    return moments.mapInArrow(run, "grp string, centre array<double>, precision array<double>")


def _distances(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    d = [F.col(c) - F.col("centre")[i] for i, c in enumerate(FEATURES)]
    total = sum(((2 if j < i else 1) * F.col("precision")[i * P + j] * d[i] * d[j] for i in range(P) for j in range(i + 1)), F.lit(0.0))
    return rows.join(shapes, "grp").withColumn("distance", F.greatest(total, F.lit(0.0))).drop("centre", "precision")


def _cut(rows: DataFrame, share: float) -> DataFrame:
    """(grp, cut): the bin of log distance that holds the wanted rank of each group. Counts of bins are combined
    before the shuffle; a group has a few hundred bins whatever its size."""
    bins = rows.groupBy("grp", _bin().alias("bin")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("grp")
    ranked = bins.withColumns({"upto": F.sum("n").over(by.orderBy("bin")), "all": F.sum("n").over(by)})
    return ranked.where(F.col("upto") >= F.col("all") * share).groupBy("grp").agg(F.min("bin").alias("cut"))


def _bin():
    return F.floor(F.log2(F.col("distance") + 1e-6) * BINS)


def robust_distances(stats: DataFrame) -> DataFrame:
    """``stats`` with ``distance``: squared Mahalanobis distance to the group's minimum-covariance-determinant estimate.

    Groups are language and source; those with fewer than LEAST_ROWS rows are judged together. The estimate starts from
    medians and absolute deviations and is concentrated ROUNDS times on the KEPT_SHARE of rows nearest to it; each round is
    one aggregation over all rows. Distances are scaled so that their median is that of the chi-square distribution."""
    rows = _vectors(stats).withColumn("own", F.to_json(F.struct("lang", "source")))
    small = rows.groupBy("own").agg((F.count("*") < LEAST_ROWS).alias("small"))
    rows = written(rows.join(small, "own").withColumn("grp", F.when(F.col("small"), "").otherwise(F.col("own"))).drop("own", "small"), "vectors")
    middle = rows.groupBy("grp").agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"m_{c}") for c in FEATURES])
    spread = rows.join(middle, "grp").groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{c}")), 0.5, 1000).alias(f"s_{c}") for c in FEATURES])
    scale = [F.greatest(1.4826 * F.col(f"s_{c}"), F.lit(f)) for c, f in zip(FEATURES, FLOORS, strict=True)]
    shapes = written(middle.join(spread, "grp").select(
        "grp", F.array(*[F.col(f"m_{c}").cast("double") for c in FEATURES]).alias("centre"),
        F.array(*[1 / (scale[i] * scale[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)]).alias("precision")), "shapes")
    for _ in range(ROUNDS):
        shapes = written(_ellipsoids(_nearest_moments(_distances(rows, shapes))), "shapes")
    now = _distances(rows, shapes)
    median = _cut(now, 0.5).select("grp", F.pow(F.lit(2.0), (F.col("cut") + 0.5) / BINS).alias("median"))
    return now.join(median, "grp").withColumn("distance", F.col("distance") * chi_square(0.5, P) / F.greatest("median", F.lit(1e-3)))


def judge_quality(docs: DataFrame) -> DataFrame:
    """Per document row its counts, ``base_failed`` (under 10 words, or over a fifth of the words in repeated windows),
    ``distance`` and ``kept``. Rows that fail the base rule are not part of the estimates and have no distance. Null texts
    have no words; null languages and sources are groups of their own; an empty table gives no rows."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = written(statistics(docs).withColumn("base_failed", failed), "stats")
    judged = robust_distances(stats.where("not base_failed"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    limit = SLACK * chi_square(0.999, P)
    return judged.select(*columns, (F.col("distance") <= limit).alias("kept"), "distance").union(
        stats.where("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")))
