"""Calibration: features with availability flags, logistic scores, reliability, thresholds, evaluation."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.music import sigmoid

#: Classes for which no model is ever trained.
REFUSED = ("LYRICS", "EXCERPT_WORK")


def feature_means(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: the mean of each feature over the rows that have it, 0 where none has."""
    return df.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in features))


def design(df: DataFrame, features: list[str], means: DataFrame) -> DataFrame:
    """Each feature with missing values at the mean, and a flag ``has_<feature>``: NULL is not 0."""
    m = means.select(*(F.col(c).alias(f"_m_{c}") for c in features)).limit(1)
    out = df.crossJoin(F.broadcast(m))
    for c in features:
        out = out.withColumn(f"has_{c}", F.col(c).isNotNull().cast("double")).withColumn(c, F.coalesce(F.col(c), F.col(f"_m_{c}")))
    return out.drop(*(f"_m_{c}" for c in features))


def linear_score(weights: dict[str, float], bias: float) -> Column:
    z = F.lit(bias)
    for c, w in weights.items():
        z = z + F.col(c) * F.lit(w)
    return sigmoid(z)


def fit(df: DataFrame, features: list[str], label: str, cls: str, c: float = 1.0):
    """L2 logistic regression with inverse strength ``c``; refused for some classes and for a single label. A pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    if cls in REFUSED:
        raise ValueError(f"no model is trained for {cls}")
    n, ones = df.agg(F.count("*"), F.sum(F.col(label).cast("long"))).first()
    if not n or ones in (None, 0, n):
        raise ValueError("labels of one kind only")
    assembler = VectorAssembler(inputCols=features, outputCol="_x")
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=1 / (c * n), standardization=False, maxIter=1000)
    return Pipeline(stages=[assembler, model]).fit(df)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


#: Features of a calibrated score, as columns of the measurement table (fixed values).
FEATURES = ("peak", "qmax", "coverage", "run", "jaccard", "semantic", "mean_idf")


@dataclass(frozen=True)
class Model:
    """A calibrated score of one class as numbers: it is applied as a column expression, wherever the columns are."""

    verdict_class: str
    features: tuple[str, ...]
    means: tuple[float, ...]
    weights: tuple[float, ...]
    flags: tuple[float, ...]
    bias: float
    trained_on: int

    def score(self) -> Column:
        """Missing features count as their mean, and their absence by its own weight."""
        z = F.lit(self.bias)
        for c, mean, w, flag in zip(self.features, self.means, self.weights, self.flags, strict=True):
            x = F.col(c).cast("double")
            known = x.isNotNull() & ~F.isnan(x)
            z = z + F.when(known, x).otherwise(F.lit(mean)) * F.lit(w) + F.when(known, F.lit(flag)).otherwise(F.lit(0.0))
        return sigmoid(z)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        kept = json.loads(spark.read.text(path).first()["value"])
        return Model(**{k: tuple(v) if isinstance(v, list) else v for k, v in kept.items()})


def train(df: DataFrame, label: str, cls: str, features: tuple[str, ...] = FEATURES, c: float = 1.0) -> Model:
    """The model of a class from measurements and a 0/1 label; refusals as in ``fit``."""
    means = feature_means(df, list(features))
    n = df.count()
    flags = [f"has_{f}" for f in features]
    fitted = fit(design(df, list(features), means), [*features, *flags], label, cls, c).stages[-1]
    weights = [float(x) for x in fitted.coefficients]
    return Model(cls, tuple(features), tuple(float(x) for x in means.first()), tuple(weights[: len(features)]), tuple(weights[len(features) :]), float(fitted.intercept), n)


def calibrated(verdicts: DataFrame, models: dict[str, Model]) -> DataFrame:
    """Verdicts with ``probability_status``; where their class has a model, its score replaces the raw probability.

    Models of classes that are never calibrated are ignored.
    """
    usable = {k: m for k, m in models.items() if k not in REFUSED}
    p, known = F.col("probability"), F.lit(False)
    for k, m in usable.items():
        p, known = F.when(F.col("verdict_class") == k, m.score()).otherwise(p), known | (F.col("verdict_class") == k)
    columns = {"_p": p.cast("double"), "probability_status": F.when(known, "calibrated").otherwise("uncalibrated")}
    for c in {f for m in usable.values() for f in m.features} - set(verdicts.columns):
        verdicts = verdicts.withColumn(c, F.lit(None).cast("double"))
    return verdicts.withColumns(columns).drop("probability").withColumnRenamed("_p", "probability")


def model_status(cls: Column, has_model: Column) -> Column:
    return F.when(has_model & ~cls.isin(*REFUSED), "calibrated").otherwise("raw")


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """``bin, n, predicted, observed``; the last bin is closed, empty bins are left out."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"))


def calibration_error(curve: DataFrame) -> DataFrame:
    return curve.agg((F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted"))) / F.sum("n")).alias("ece"))


def precision_at(df: DataFrame, p: str, y: str, at: float) -> DataFrame:
    """Precision of the alarms at a threshold, NULL without alarms."""
    return df.agg(F.avg(F.when(F.col(p) >= at, F.col(y))).alias("precision"), F.count(F.when(F.col(p) >= at, 1)).alias("alarms"))


def operating_threshold(df: DataFrame, p: str, y: str, precision: float = 0.95, bins: int = 10_000) -> DataFrame:
    """The smallest score from which on alarms are precise enough, within [1e-6, 1 - 1e-6].

    The sweep is a running mean by falling score. Labels are first summed by score, so the window runs over
    distinct scores; these are dealt by score ranges whose totals are carried over, so no task has them all.
    """
    by = df.groupBy(F.col(p).alias("p")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    by = by.withColumn("_b", F.floor(F.col("p") * bins))
    totals = by.groupBy("_b").agg(F.sum("n").alias("bn"), F.sum("s").alias("bs"))  # bins + 1 rows at most
    before = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_b", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("on"), F.coalesce(F.sum("bs").over(before), F.lit(0.0)).alias("os"))
    w = Window.partitionBy("_b").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    swept = by.join(F.broadcast(totals), "_b").withColumn("precision", (F.col("os") + F.sum("s").over(w)) / (F.col("on") + F.sum("n").over(w)))
    return swept.filter(F.col("precision") >= precision).agg(F.least(F.greatest(F.min("p"), F.lit(1e-6)), F.lit(1 - 1e-6)).alias("threshold"))


def auc(df: DataFrame, p: str, y: str, bins: int = 10_000) -> DataFrame:
    """Area under the curve by ranks, ties at their average; 0.5 and ``auc_defined`` false for one class."""
    by = df.groupBy(F.col(p).alias("p")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("s")).withColumn("_b", F.floor(F.col("p") * bins))
    totals = by.groupBy("_b").agg(F.sum("n").alias("bn"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_b", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("on"))
    w = Window.partitionBy("_b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.join(F.broadcast(totals), "_b").withColumn("rank", F.col("on") + F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("s")).alias("r"), F.sum("s").alias("n1"), F.sum(F.col("n") - F.col("s")).alias("n0"))
    defined = (F.col("n1") > 0) & (F.col("n0") > 0)
    area = (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))
    return sums.select(F.when(defined, area).otherwise(0.5).alias("auc"), F.coalesce(defined, F.lit(False)).alias("auc_defined"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def recall_at(ranked: DataFrame, query: str, rank: str, hit: str, k: int) -> DataFrame:
    """Share of queries with the right answer first, and among the first ``k``."""
    best = ranked.groupBy(query).agg(F.min(F.when(F.col(hit), F.col(rank))).alias("_r"))
    return best.agg(F.avg((F.coalesce("_r", F.lit(10**9)) == 1).cast("double")).alias("top1"), F.avg((F.coalesce("_r", F.lit(10**9)) <= k).cast("double")).alias("recall_at_k"), F.count("*").alias("queries"))


def highest(df: DataFrame, status: str, x: str) -> Column:
    return F.max(F.when(F.col(status) == "ok", F.col(x)))
