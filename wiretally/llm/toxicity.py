"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import batches, text_bytes, written

#: Bounds of the fit, in labelled rows and lexicon entries; scoring covers every row.
MOST_LABELLED = 30_000
MOST_ENTRIES = 4_000
STEM = 5
#: An entry is found in so many toxic documents at least, and its log odds are at least so high.
LEAST_TOXIC = 5
STRONG, WEAK = 3.0, 1.2
# Second-person words of the corpus' languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos "
                          "usted ustedes tú ti tuyo os vosotros".split())
FEATURES = ("strong_rate", "strong_count", "weak_rate", "best_odds", "sum_odds", "near_second_person", "capitals", "exclamations",
            "marks", "symbols_in_words", "digits_in_words", "stretched", "spaced_letters", "log_words", "stem_odds")
_WORD = re.compile(r"[^\W\d_]+(?:['*@$!0-9.\-_]+[^\W\d_]+)*", re.UNICODE)
_STRETCH = re.compile(r"(.)\1\1", re.UNICODE)
_SPACED = re.compile(r"\b(?:[^\W\d_][ .*_-]){3,}[^\W\d_]\b", re.UNICODE)
# The same for texts of ASCII characters only, which read faster.
_WORD_ASCII = re.compile(r"[A-Za-z]+(?:['*@$!0-9.\-_]+[A-Za-z]+)*", re.ASCII)
_SPACED_ASCII = re.compile(r"\b(?:[A-Za-z][ .*_-]){3,}[A-Za-z]\b", re.ASCII)
_LOOKALIKE = str.maketrans("@$013457", "asoieast")  # fixed values: signs that stand for letters


@lru_cache(maxsize=200_000)
def plain(word: str) -> str:
    """A word as the lexicon holds it: lower case, disguising signs undone or removed, stretched letters shortened."""
    word = re.sub(r"[^\w]|_", "", word.lower().translate(_LOOKALIKE))
    return re.sub(r"(.)\1{2,}", r"\1", word)


def written_words(text: str) -> tuple[list[str], list[str]]:
    """The words of a text, and the words that it spells with a sign between letters."""
    word, spaced = (_WORD_ASCII, _SPACED_ASCII) if text.isascii() else (_WORD, _SPACED)
    return word.findall(text), spaced.findall(text)


def words_of(text: str) -> list[str]:
    raw, spaced = written_words(text)
    return [plain(w) for w in raw + spaced]


def entries(words: list[str]) -> set[str]:
    """What of a text can enter the lexicon: its words, and stems of longer ones (marked with ^)."""
    return set(words) | {"^" + w[:STEM] for w in words if len(w) > STEM}


class WordFacts(dict):
    """Row of a written word in ``facts``: its odds, its stem's odds, and whether it is second person, holds one of *@$!, holds a
    digit, is stretched. Words seen before cost a lookup; ``trim`` forgets all once there are more than ``limit``."""

    limit = 400_000

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds, self.facts = odds, np.zeros((1024, 6))

    def __missing__(self, written: str) -> int:
        lower, at = written.lower(), len(self)
        if at == len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        if lower.isascii() and lower.isalpha() and not _STRETCH.search(lower):  # most words: nothing to undo
            word = lower
        else:
            word = plain(written)
            self.facts[at, 3:] = any(c in "*@$!" for c in written), any(map(str.isdigit, written)), _STRETCH.search(written) is not None
        if word in self.odds:
            self.facts[at, 0] = self.odds[word]
        if len(word) > STEM and (stem := "^" + word[:STEM]) in self.odds:
            self.facts[at, 1] = self.odds[stem]
        if word in SECOND_PERSON:
            self.facts[at, 2] = 1.0
        self[written] = at
        return at

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.facts[:] = 0.0


def _characters(text: str) -> tuple[int, int, int]:
    """How many capitals, exclamation marks and other marks a text has."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.bincount(codes[codes < 128], minlength=128)
    high, times = np.unique(codes[codes >= 128], return_counts=True)
    capitals = int(low[65:91].sum()) + sum(int(k) for c, k in zip(high.tolist(), times, strict=True) if chr(c).isupper())
    return capitals, int(low[ord("!")]), sum(int(low[ord(c)]) for c in ".,;:?")


def dense(text: str, known: WordFacts) -> list[float]:
    known.trim()
    raw, spaced = written_words(text)
    words = raw + spaced
    n, chars = max(1, len(words)), max(1, len(text))
    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    facts = known.facts[at]
    stem, written = facts[:, 1], facts[:len(raw), 3:].sum(0) / n
    both = facts[:, :2].max(1) if words else np.zeros(1)
    strong, second = np.flatnonzero(both >= STRONG), np.flatnonzero(facts[:, 2])
    near = float(1 / (1 + np.abs(strong[:, None] - second[np.clip(np.searchsorted(second, strong)[:, None] + [-1, 0], 0, len(second) - 1)]).min())) \
        if len(strong) and len(second) else 0.0
    capitals, exclamations, marks = _characters(text)
    return [100.0 * len(strong) / n, float(len(strong)), 100.0 * float((both >= WEAK).sum()) / n, float(both.max()),
            float(np.sort(both)[-3:].sum()), near, capitals / chars, 100.0 * exclamations / n, marks / chars, *map(float, written),
            float(len(spaced)), float(np.log(n)), float(stem.max(initial=0.0))]


def _strings(batch: pa.RecordBatch) -> list[str]:
    return [x.decode("utf-8", "replace") for x in text_bytes(batch)]


def lexicon(labelled: DataFrame) -> dict[str, float]:
    """Log odds of an entry in toxic texts against others (columns text, toxic); at most MOST_ENTRIES reach the driver."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 256):
            found, marks = [], []
            for x, y in zip(_strings(batch), batch.column("toxic").to_pylist(), strict=True):
                own = entries(words_of(x))
                found.extend(own)
                marks.extend([y] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(marks, pa.int64())], ["entry", "toxic"])

    total = labelled.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    bad, good = total[0] or 0, total[1] or 0
    seen = labelled.select("text", "toxic").mapInArrow(run, "entry string, toxic long").groupBy("entry").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log(((F.col("a") + 0.5) / (bad + 1.0)) / ((F.col("b") + 0.5) / (good + 1.0)))
    top = seen.where(F.col("a") >= LEAST_TOXIC).withColumn("odds", odds).where(F.col("odds") >= WEAK).orderBy(
        F.desc(F.col("odds") * F.sqrt("a")), "entry").limit(MOST_ENTRIES)
    return {r.entry: r.odds for r in top.collect()}


def with_features(docs: DataFrame, odds: dict[str, float], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and a row of dense features for each text (null: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(odds)  # MOST_ENTRIES entries at most
    schema = docs.select(*keep).schema
    for c in FEATURES:
        schema = schema.add(c, "double")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFacts(shared.value)
        for batch in batches(rows, 512):
            made = np.array([dense(x, known) for x in _strings(batch)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(made[:, k]) for k in range(len(FEATURES)))], [*keep, *FEATURES])

    return docs.select(*keep, *[c for c in ["text"] if c not in keep]).mapInArrow(run, schema)


class Toxicity:
    """Lexicon, trees and calibration, fitted on the documents that ``labels`` (doc_id, toxic) marks where ``allowed`` holds; a
    document labelled twice counts as its higher label.

    About MOST_LABELLED rows are used, chosen by hash; half of them give the lexicon, three tenths the trees, two tenths
    the calibration, so that no part judges rows it has learned from. Without both labels every score is the share of
    toxic rows (0 without rows)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, allowed: Column, most: int = MOST_LABELLED):
        marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & allowed).groupBy("doc_id").agg(
            F.max("toxic").cast("long").alias("toxic"))
        # Chosen by hash on both sides, so that only the texts that are learned from are shuffled.
        chosen = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < 1_000_000 * min(1.0, most / max(marks.count(), 1))
        sample = written(docs.select("doc_id", "text").where(chosen).join(marks.where(chosen), "doc_id").withColumn(
            "part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10))), "labelled")
        self.rate = float(sample.agg(F.avg("toxic")).first()[0] or 0.0)
        self.odds, self.trees = {}, None
        if not 0 < self.rate < 1:
            return
        self.odds = lexicon(sample.where("part < 5"))
        self.assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        rows = written(with_features(sample.where("part >= 5"), self.odds, ["doc_id", "toxic", "part"]), "features")
        fit, held = (self.assembler.transform(rows.where(c)).coalesce(4) for c in ("part < 8", "part >= 8"))
        if fit.select("toxic").distinct().count() < 2 or held.isEmpty():
            return
        self.trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=20, maxDepth=4, stepSize=0.2, seed=7, cacheNodeIds=False).fit(fit)
        margins = self.trees.transform(held).select(vector_to_array("rawPrediction")[1].alias("margin"), F.col("toxic").cast("double").alias("toxic"))
        self.steps = IsotonicRegression(featuresCol="margin", labelCol="toxic").fit(margins)

    def score(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """The columns ``keep`` and ``score`` from 0 to 1 for every row; null texts count as empty."""
        if self.trees is None:
            return docs.select(*keep).withColumn("score", F.lit(self.rate))
        raw = self.trees.transform(self.assembler.transform(with_features(docs, self.odds, keep)))
        margins = raw.select(*keep, vector_to_array("rawPrediction")[1].alias("margin"))
        return self.steps.transform(margins).select(*keep, F.col("prediction").alias("score"))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def judge_toxicity(docs: DataFrame, labels: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """Per document row held_out, score and predicted; labels are learned only from rows that are not held out."""
    model = Toxicity(docs, labels, ~held_out())
    keep = kept or ["doc_id"]
    return model.score(docs, keep).select(*keep, F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                                          (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, all_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns; learned from the labelled rows of ``all_docs``."""
    model = Toxicity(all_docs, labels, ~held_out())
    inner = {c: f"_{k}" for k, c in enumerate(docs.columns) if c != "text"}  # so that no column clashes with a feature
    scored = model.score(docs.select("text", *[F.col(f"`{c}`").alias(x) for c, x in inner.items()]), ["text", *inner.values()])
    return scored.where("score < 0.5").select(*[F.col(inner.get(c, c)).alias(c) for c in docs.columns])
