"""The two-channel detector: character n-grams and request shape, fused late and calibrated."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wiretally.functions import shape, text as X
from wiretally.operators.quantiles import budget_thresholds
from wiretally.plans.boosting import BoostedTrees, Growth, fit_boosted
from wiretally.plans.vectors import TfIdf, TfIdfModel
from wiretally.session import spread_out

BUDGETS = (0.01, 0.05)
PRIMARY = 0.01


@dataclass(frozen=True)
class Settings:
    """Declared, not tuned."""
    terms_a: int = 200_000
    terms_b: int = 50_000
    min_df: int = 2
    text_iterations: int = 2000
    boosting_rounds: int = 300
    boosting_rate: float = 0.1
    boosting_leaves: int = 31
    boosting_bins: int = 255
    boosting_l2: float = 1.0
    text_weight: float = 0.5
    shape_weight: float = 0.5


def _positive(probability: str = "probability") -> Column:
    return vector_to_array(probability)[1]


def _balanced(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Class weights ``n / (classes * n_class)`` as ``_weight``; they add up to the row count."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = reduce(lambda w, c: w.when(F.col(label) == c, n / (len(counts) * counts[c])),
                    counts, F.when(F.lit(False), 0.0))
    return df.withColumn("_weight", weight), n


@dataclass
class TextModel:
    """Linear model over the n-grams of one or two decoded fields."""
    spaces: list[TfIdfModel]
    linear: PipelineModel

    def features(self, df: DataFrame, decoded: bool = False) -> DataFrame:
        """Add the sparse vectors of the fields (and the fields, unless ``decoded`` says they are there)."""
        out = df if decoded else X.with_detector_fields(df)
        for space in self.spaces:
            out = space.transform(out)
        return out

    def terms(self, df: DataFrame) -> DataFrame:
        """Combined vector of a row as ``terms`` and ``weights`` (unit length per field)."""
        v = self.linear.stages[0].transform(self.features(df))
        return TfIdfModel.weights(v, "features")

    def score(self, df: DataFrame, output: str = "p_text", decoded: bool = False) -> DataFrame:
        scored = self.linear.transform(self.features(df, decoded))
        extra = [c for c in ("raw_target", "field_a", "field_b", "encoding_depth") if c not in df.columns]
        return scored.withColumn(output, _positive()).drop(
            *[s.output for s in self.spaces], "features", "rawPrediction", "probability", "prediction", *extra)

    def score_raw(self, payloads: DataFrame, payload: str, output: str = "p_text") -> DataFrame:
        """Score payloads as they are: no decoding and nothing in the header field."""
        bare = payloads.withColumns({"field_a": F.col(payload), "field_b": F.lit("")})
        return self.score(bare, output, decoded=True).drop("field_a", "field_b")

    def save(self, path: str) -> None:
        for i, space in enumerate(self.spaces):
            space.save(os.path.join(path, f"space{i}"))
        self.linear.write().overwrite().save(os.path.join(path, "linear"))

    @classmethod
    def load(cls, path: str) -> TextModel:
        linear = PipelineModel.load(os.path.join(path, "linear"))
        n = len(linear.stages[0].getInputCols())
        return cls([TfIdfModel.load(os.path.join(path, f"space{i}")) for i in range(n)], linear)


def _fit_spaces(df: DataFrame, settings: Settings, fields: tuple[str, ...]) -> list[TfIdfModel]:
    sizes = {"field_a": settings.terms_a, "field_b": settings.terms_b}
    fitted = [TfIdf(f, f"v_{f}", sizes[f], settings.min_df).fit(df) for f in fields]
    return [m for m in fitted if m is not None]


def _fit_linear(df: DataFrame, spaces: list[TfIdfModel], label: str, settings: Settings,
                family: str = "auto") -> PipelineModel:
    """L2 with C = 1 in terms of the weighted sum of losses, classes balanced."""
    vectors = df
    for space in spaces:
        vectors = space.transform(vectors)
    gather = VectorAssembler(inputCols=[s.output for s in spaces], outputCol="features")
    weighted, n = _balanced(gather.transform(vectors).select("features", label), label)
    train = weighted.persist()
    try:
        fit = LogisticRegression(
            labelCol=label, weightCol="_weight", maxIter=settings.text_iterations, regParam=1.0 / n, tol=1e-6,
            elasticNetParam=0.0, standardization=False, family=family).fit(train)
    finally:
        train.unpersist()
    return PipelineModel([gather, fit])


_REQUEST = ("url_path_raw", "url_query", "request_body", "headers")


def _training_rows(df: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What is ``made`` of the training rows, in even partitions, at most one per core and at most twenty thousand rows
    each: a fit passes over them many times, so one shuffle pays for itself. Requests are dealt out before anything is made of
    them: that costs far more per row than the shuffle, and small files come in few partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    first = df.persist()
    n = first.count()
    spread = made(first.repartition(max(1, min(cores, n // 500 + 1), n // 20_000))).persist()
    spread.count()
    first.unpersist()
    return spread


def fit_text(df: DataFrame, settings: Settings = Settings(), label: str = "y") -> TextModel:
    """Fit on request rows with a 0/1 label."""
    fields = _training_rows(df.select(*_REQUEST, F.col(label).cast("double").alias(label)),
                            lambda rows: X.with_detector_fields(rows).select("field_a", "field_b", label))
    try:
        spaces = _fit_spaces(fields, settings, ("field_a", "field_b"))
        return TextModel(spaces, _fit_linear(fields, spaces, label, settings))
    finally:
        fields.unpersist()


@dataclass
class ShapeModel:
    """Boosted trees over the numeric features of a request."""
    trees: BoostedTrees

    def score(self, df: DataFrame, output: str = "p_numeric") -> DataFrame:
        return self.trees.score(shape.with_shape_features(df), output).select(*df.columns, output)


def fit_shape(df: DataFrame, settings: Settings = Settings(), label: str = "y") -> ShapeModel:
    rows = _training_rows(df.select(*_REQUEST, F.col(label).cast("double").alias("_label")),
                          lambda rows: shape.with_shape_features(rows).select(*shape.FEATURE_NAMES, "_label"))
    try:
        return ShapeModel(fit_boosted(rows, shape.FEATURE_NAMES, "_label", Growth(
            settings.boosting_rounds, settings.boosting_rate, settings.boosting_leaves, settings.boosting_bins, settings.boosting_l2)))
    finally:
        rows.unpersist()


def fused_logit(settings: Settings, text: str = "p_text", numeric: str = "p_numeric") -> Column:
    return (settings.text_weight * shape.logit(F.col(text)) + settings.shape_weight * shape.logit(F.col(numeric)))


_CHANNELS = ("p_text", "p_numeric", "p_content")


@dataclass
class Detector:
    """Both channels, the calibration of their fusion and the thresholds per channel and budget."""
    text: TextModel
    shape: ShapeModel
    platt: Transformer
    settings: Settings = field(default_factory=Settings)
    thresholds: dict[str, dict[float, float]] = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``p_text``, ``p_numeric`` and ``p_content``."""
        both = self.shape.score(self.text.score(df))
        gather = VectorAssembler(inputCols=["_z"], outputCol="_zv")
        fused = self.platt.transform(gather.transform(both.withColumn("_z", fused_logit(self.settings))))
        return fused.select(*both.columns, _positive("_pp").alias("p_content"))

    def threshold(self, channel: str = "p_content", budget: float = PRIMARY) -> float:
        return self.thresholds[channel][budget]

    def save(self, path: str) -> None:
        self.text.save(os.path.join(path, "text"))
        self.shape.trees.save(os.path.join(path, "shape"))
        PipelineModel([self.platt]).write().overwrite().save(os.path.join(path, "platt"))
        rows = [(c, b, t) for c, per in self.thresholds.items() for b, t in per.items()]
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(rows, "channel string, budget double, threshold double").write.mode(
            "overwrite").parquet(os.path.join(path, "thresholds"))

    @classmethod
    def load(cls, path: str, settings: Settings = Settings()) -> Detector:
        spark = SparkSession.getActiveSession()
        thresholds: dict[str, dict[float, float]] = {}
        for r in spark.read.parquet(os.path.join(path, "thresholds")).collect():
            thresholds.setdefault(r.channel, {})[r.budget] = r.threshold
        return cls(TextModel.load(os.path.join(path, "text")), ShapeModel(BoostedTrees.load(os.path.join(path, "shape"))),
                   PipelineModel.load(os.path.join(path, "platt")).stages[0], settings, thresholds)


def fit_platt(df: DataFrame, fused: str, label: str = "y") -> Transformer:
    """One-dimensional logistic calibration with next to no penalty."""
    gather = VectorAssembler(inputCols=[fused], outputCol="_zv")
    rows = gather.transform(df).select("_zv", F.col(label).cast("double").alias(label))
    n = rows.count()
    return LogisticRegression(featuresCol="_zv", labelCol=label, probabilityCol="_pp", rawPredictionCol="_pr",
                              predictionCol="_pd", regParam=1.0 / (1e6 * max(n, 1)), maxIter=1000,
                              standardization=False).fit(rows)


def fit_detector(train: DataFrame, calib: DataFrame, settings: Settings = Settings(), label: str = "y") -> Detector:
    """Channels on ``train``; calibration and thresholds (from its benign rows) on ``calib``."""
    text, numeric = fit_text(train, settings, label), fit_shape(train, settings, label)
    scored = numeric.score(text.score(spread_out(calib))).withColumn("_z", fused_logit(settings)).select(
        label, "p_text", "p_numeric", "_z").persist()
    try:
        detector = Detector(text, numeric, fit_platt(scored, "_z", label), settings)
        gather = VectorAssembler(inputCols=["_z"], outputCol="_zv")
        final = detector.platt.transform(gather.transform(scored)).withColumn("p_content", _positive("_pp"))
        benign = final.where(F.col(label) == 0).select(*_CHANNELS).persist()
        detector.thresholds = {c: budget_thresholds(benign, c, BUDGETS) for c in _CHANNELS}
        benign.unpersist()
    finally:
        scored.unpersist()
    return detector


def text_thresholds(model: TextModel, calib_benign: DataFrame) -> dict[float, float]:
    """A text model's own operating points on its domain's calibration slice."""
    scored = model.score(spread_out(calib_benign)).select("p_text").persist()  # read once per step of the search
    try:
        return budget_thresholds(scored, "p_text", BUDGETS)
    finally:
        scored.unpersist()


@dataclass
class FamilyHead:
    """Multinomial model over ``field_a``: which attack family is it?"""
    space: TfIdfModel
    linear: PipelineModel
    labels: list[str]

    def predict(self, df: DataFrame, text: Column | None = None, output: str = "pred_family") -> DataFrame:
        """``text`` replaces the decoded request as input where given."""
        staged = X.with_detector_fields(df) if text is None else df.withColumn("field_a", text)
        scored = self.linear.transform(self.space.transform(staged))
        names = F.array(*map(F.lit, self.labels))
        return scored.select(*df.columns, F.element_at(names, F.col("prediction").cast("int") + 1).alias(output))

    def save(self, path: str) -> None:
        self.space.save(os.path.join(path, "space"))
        self.linear.write().overwrite().save(os.path.join(path, "linear"))
        SparkSession.getActiveSession().createDataFrame(
            [(i, x) for i, x in enumerate(self.labels)], "position int, label string").write.mode(
            "overwrite").parquet(os.path.join(path, "labels"))

    @classmethod
    def load(cls, path: str) -> FamilyHead:
        rows = SparkSession.getActiveSession().read.parquet(os.path.join(path, "labels")).orderBy("position").collect()
        return cls(TfIdfModel.load(os.path.join(path, "space")), PipelineModel.load(os.path.join(path, "linear")),
                   [r.label for r in rows])


def fit_family(attacks: DataFrame, settings: Settings = Settings(), family: str = "attack_family") -> FamilyHead:
    labels = [r[0] for r in attacks.select(family).distinct().orderBy(family).collect()]
    index = reduce(lambda w, i: w.when(F.col(family) == labels[i], float(i)), range(len(labels)), F.when(F.lit(False), 0.0))
    rows = _training_rows(attacks.select(*_REQUEST, index.alias("_y")), lambda rows: X.with_detector_fields(rows).select("field_a", "_y"))
    try:
        space = TfIdf("field_a", "v_field_a", settings.terms_a, settings.min_df).fit(rows)
        linear = _fit_linear(rows, [space], "_y", settings, "multinomial")
    finally:
        rows.unpersist()
    return FamilyHead(space, linear, labels)
