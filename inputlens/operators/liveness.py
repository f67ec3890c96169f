"""Person or automation: labelled features, a random forest, its report, scores and flags by day."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inputlens.functions.times import day_key
from inputlens.operators.features import FEATURES
from inputlens.schema import TABLES

#: Rows that training needs at least; share held out, in ten-thousandths.
LEAST_ROWS, HELD_OUT = 30, 2500


class TooFewRows(ValueError):
    """Not enough labelled windows to train on, or of one label only."""


def labeled_dataset(human: DataFrame, automation: DataFrame, exclude: DataFrame | None, tz: str) -> DataFrame:
    """Window features of people (label 0) and of automation (1). ``exclude`` (user, day; null day: all days) takes
    demonstrations out of the human class only."""
    people = human
    if exclude is not None:
        days = people.withColumn("__day", day_key(F.col("window_start"), tz))
        out = exclude.select(F.col("user").alias("__user"), F.col("day").alias("__out"))
        match = (F.col("user") == F.col("__user")) & (F.col("__out").isNull() | (F.col("__day") == F.col("__out")))
        people = days.join(out, match, "left_anti").drop("__day")
    return people.withColumn("label", F.lit(0.0)).unionByName(automation.select(human.columns).withColumn("label", F.lit(1.0)))


def class_balance(labeled: DataFrame) -> DataFrame:
    return labeled.groupBy("label").count()


def split(labeled: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows: three quarters and a quarter of either label, by a hash of the row's key, so that
    a row falls on the same side in every run."""
    place = F.pmod(F.xxhash64("label", "user", F.unix_micros("window_start"), F.lit(seed)), F.lit(10_000))
    return labeled.filter(place >= HELD_OUT), labeled.filter(place < HELD_OUT)


def weighted(labeled: DataFrame) -> DataFrame:
    """Balanced weights: rows / (labels * rows of the label). The two counts are one broadcast row each."""
    balance = class_balance(labeled).withColumnRenamed("count", "__n")
    totals = balance.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    shares = balance.join(totals, F.lit(True)).select("label", (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return labeled.join(F.broadcast(shares), "label")  # one row for each label


def train(labeled: DataFrame, trees: int = 300, depth: int = 15, seed: int = 42) -> PipelineModel:
    sizes = [r["count"] for r in class_balance(labeled).collect()]  # one row for each label
    if len(sizes) < 2 or sum(sizes) < LEAST_ROWS:
        raise TooFewRows(f"training needs {LEAST_ROWS} labelled windows, of people and of automation")
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=2, featureSubsetStrategy="2", maxBins=256, weightCol="weight", seed=seed
    )
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(weighted(labeled))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def saved(path: str) -> PipelineModel | None:
    """The model saved at ``path``, None if there is none."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        return load(path)
    except (PySparkException, Py4JJavaError):
        return None


def score_windows(features: DataFrame, model: PipelineModel | None) -> DataFrame:
    """user, window_start, probability of automation; no rows without a model."""
    if model is None:
        return features.select("user", "window_start", F.lit(0.0).alias("probability")).limit(0)
    return model.transform(features).select("user", "window_start", vector_to_array("probability")[1].alias("probability"))


def score_days(scored: DataFrame, tz: str, threshold: float = 0.8, min_windows: int = 2) -> DataFrame:
    """user, day, score (highest probability), nonhuman (enough windows at or over the threshold)."""
    day = day_key(F.col("window_start"), tz).alias("day")
    flagged = F.count_if(F.col("probability") >= threshold) >= min_windows
    return scored.groupBy("user", day).agg(F.max("probability").alias("score"), flagged.alias("nonhuman"))


def suspicious(scored: DataFrame, limit: int = 20) -> DataFrame:
    return scored.orderBy(F.desc("probability"), "user", "window_start").limit(limit)


def metrics(predicted: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 (0 where undefined) of rows (label, prediction): one row."""
    hit = lambda y, p: F.count_if((F.col("label") == y) & (F.col("prediction") == p))
    tp, fp, fn = hit(1, 1), hit(0, 1), hit(1, 0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return predicted.agg(
        ratio(tp + hit(0, 0), F.count(F.lit(1))).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """Features by falling importance."""
    pairs = zip(FEATURES, model.stages[-1].featureImportances.toArray().tolist(), strict=True)
    return sorted(pairs, key=lambda p: (-p[1], p[0]))


def evaluate(labeled: DataFrame, trees: int = 300, depth: int = 15, seed: int = 42) -> DataFrame:
    """Report row of a model fitted on three quarters and judged on the rest; roc_auc is null with one class."""
    fitted, held = split(labeled, seed)
    model = train(fitted, trees, depth, seed)
    predicted = model.transform(held)
    counts = labeled.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    sizes = held.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    auc = BinaryClassificationEvaluator(numBins=0).evaluate(predicted) if sizes[1] == 2 else None
    row = metrics(predicted).first()
    n = counts[0] + counts[1]
    data = [(*row, auc, n - sizes[0], sizes[0], counts[0], counts[1], importances(model))]
    return labeled.sparkSession.createDataFrame(data, TABLES["model_report"])


def ranked_importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    return spark.createDataFrame(importances(model), "feature string, importance double").orderBy(F.desc("importance"), "feature")
