"""Models on Spark ML and scoring: classification, regression, word vectors, pluggable batch scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import vectors as V


def text_features(text: str, size: int = 4096) -> list:
    return [RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"\s+"), HashingTF(inputCol="__words", outputCol="features", numFeatures=size)]


def fit_text_classifier(df: DataFrame, text: str, label: str, weights: DataFrame | None = None, iterations: int = 30) -> PipelineModel:
    """Multinomial regression on hashed words; ``weights(label, weight)`` balances classes."""
    lr = LogisticRegression(labelCol=label, maxIter=iterations, regParam=0.01)
    if weights is not None:
        df = df.join(F.broadcast(weights.select(F.col("label").alias(label), "weight")), label)  # a row per class
        lr = lr.setWeightCol("weight")
    return Pipeline(stages=[*text_features(text), lr]).fit(df)


def classify(model: PipelineModel, df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``df`` with ``label`` (of the first largest probability) and ``probability``."""
    p = vector_to_array(F.col("probability"))
    out = model.transform(df).withColumn("__p", p)
    best = V.argmax(F.col("__p")).cast("int")
    return out.select(*df.columns, F.element_at(F.array(*map(F.lit, labels)), best + 1).alias("label"), F.array_max("__p").alias("probability"))


def fit_multilabel(df: DataFrame, text: str, labels: Sequence[str]) -> dict[str, PipelineModel]:
    """One binary model per 0/1 column."""
    return {x: fit_text_classifier(df, text, x) for x in labels}


def classify_multilabel(models: dict[str, PipelineModel], df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``df`` with the list of labels whose probability is above the threshold."""
    out, names = df, []
    for x, m in models.items():
        p = vector_to_array(F.col("probability"))[1]
        out = m.transform(out).withColumn(f"p_{x}", p).drop("__words", "features", "rawPrediction", "probability", "prediction")
        names.append(F.when(F.col(f"p_{x}") > threshold, x))
    return out.withColumn("labels", F.array_compact(F.array(*names)))


def fit_text_regression(df: DataFrame, text: str, value: str) -> tuple[PipelineModel, float, float]:
    """Linear regression on the standardised value; returns the model, mean and deviation to undo it."""
    mean, scale = df.agg(F.avg(value), F.stddev_pop(value)).first()
    work = df.withColumn("__y", (F.col(value) - mean) / (scale or 1.0))
    model = Pipeline(stages=[*text_features(text, 1024), LinearRegression(labelCol="__y", maxIter=20, regParam=0.1)]).fit(work)
    return model, float(mean), float(scale or 1.0)


def predict_value(model: tuple[PipelineModel, float, float], df: DataFrame) -> DataFrame:
    return model[0].transform(df).select(*df.columns, (F.col("prediction") * model[2] + model[1]).alias("value"))


def pooled_vectors(tokens: DataFrame, vectors: DataFrame, by: str, size: int, weights: DataFrame | None = None) -> DataFrame:
    """Mean vector of the tokens of each ``by`` that have one; with ``weights(token, weight)`` a weighted sum over their number."""
    work = tokens.join(vectors.select("token", "v"), "token")
    if weights is not None:
        work = work.join(weights.select("token", "weight"), "token").withColumn("v", F.transform("v", lambda x: x * F.col("weight")))
    sums = work.groupBy(by).agg(*[F.avg(F.get("v", F.lit(i))).alias(f"d{i}") for i in range(size)])
    return sums.select(by, F.array(*[F.col(f"d{i}") for i in range(size)]).alias("v"))


def mean_max_pool(df: DataFrame, by: str, vector: str) -> DataFrame:
    """``(by, dim, mean, top)``: the mean and the maximum of each dimension of a group's vectors."""
    flat = df.select(by, F.posexplode(vector).alias("dim", "x"))
    return flat.groupBy(by, "dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.max("x"), 6).alias("top"))


def _less(v: Column, axis: Column, by: Column) -> Column:
    return F.zip_with(v, axis, lambda x, a: x - a * by)


def without_mean_and_components(df: DataFrame, key: str, vector: str, components: int) -> DataFrame:
    """Vectors less their mean and their projections on the first components, scaled by (l_i - l_last) / l_i."""
    size = df.select(F.size(vector)).first()[0]
    mean = np.array(df.agg(*V.mean_of(vector, size)).first())
    centred = df.select(key, F.zip_with(vector, F.array(*map(F.lit, map(float, mean))), lambda x, m: x - m).alias("__c"))
    pca = PCA(k=components, inputCol="__f", outputCol="__p").fit(centred.withColumn("__f", array_to_vector("__c")))
    axes, share = pca.pc.toArray(), pca.explainedVariance.toArray()
    out = F.col("__c")
    for i in range(components):
        axis = F.array(*map(F.lit, map(float, axes[:, i])))
        factor = float((share[i] - share[-1]) / share[i]) if share[i] else 0.0
        out = _less(out, axis, V.dot(F.col("__c"), axis) * factor)
    return centred.select(key, out.alias(vector))


def without_dominant_direction(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors less their projections on the first right singular vector of the whole table, not centred.

    Each task sums its products of dimensions; their totals, one number a pair of dimensions, come to the driver.  An empty
    table stays empty; null vectors stay null and vectors are of one length.
    """

    def products(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in it:
            if len(b):
                m = np.stack(b["__v"].to_numpy()).astype(float)
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": total.ravel()})

    work = df.select(F.col(vector).alias("__v")).where(F.col("__v").isNotNull())
    rows = work.mapInPandas(products, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    if rows.empty:
        return df.select(key, vector)
    size = int(rows["i"].max()) + 1
    gram = np.zeros((size, size))
    gram[rows["i"], rows["j"]] = rows["x"]
    axis = F.array(*map(F.lit, map(float, np.linalg.eigh(gram)[1][:, -1])))
    return df.select(key, _less(F.col(vector), axis, V.dot(F.col(vector), axis)).alias(vector))


def cluster_vectors(vectors: DataFrame, k: int, weight: str | None = None, seed: int = 42) -> DataFrame:
    """Adds ``cluster`` by k-means."""
    means = KMeans(k=k, seed=seed, featuresCol="__f", predictionCol="cluster")
    work = vectors.withColumn("__f", array_to_vector("v"))
    return (means.setWeightCol(weight) if weight else means).fit(work).transform(work).drop("__f")


def cluster_pooling(tokens: DataFrame, clustered: DataFrame, centroids: DataFrame, by: str, size: int, k: int) -> DataFrame:
    """Sentence vectors from weighted tokens: their mean, and the covariance of their cluster sums.

    ``clustered(token, v, cluster, weight)``, ``centroids(cluster, centroid)``.  The distinct tokens of a sentence count once.  The
    covariance's upper triangle, off-diagonal values times sqrt 2, is normalised and appended.  The matrix work is per sentence.
    """
    rows = tokens.select(by, "token").distinct().join(clustered, "token").join(F.broadcast(centroids), "cluster")  # k rows
    moved = rows.select(by, "cluster", F.transform("v", lambda x: x * F.col("weight")).alias("wv"), "centroid")
    parts = moved.groupBy(by, "cluster").agg(
        F.count("*").alias("__n"),
        F.array(*[F.sum(F.get("wv", F.lit(i))) for i in range(size)]).alias("__s"),
        F.array(*[F.sum(F.get("wv", F.lit(i)) - F.get("centroid", F.lit(i))) for i in range(size)]).alias("__r"),
    )
    sentences = parts.groupBy(by).agg(F.sum("__n").alias("__n"), F.collect_list(F.struct("cluster", F.col("__s").alias("s"), F.col("__r").alias("r"))).alias("__p"))
    upper = np.triu_indices(size if size < k else k)

    def pooled(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in it:
            out = []
            for n, p in zip(g["__n"], g["__p"], strict=True):
                m = np.zeros((k, size))
                for x in p:
                    m[x["cluster"]] = x["r"]
                mean = np.sum([x["s"] for x in p], axis=0) / n
                m = m if k <= size else m.T
                c = np.cov(m)[upper] * np.where(upper[0] == upper[1], 1.0, np.sqrt(2))
                norm = np.linalg.norm(c)
                out.append(np.concatenate([mean, c / norm if norm else c]).tolist())
            yield pd.DataFrame({by: g[by], "v": out})

    kind = sentences.schema[by].dataType.simpleString()
    return sentences.mapInPandas(pooled, f"{by} {kind}, v array<double>")


def score_batches(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, setup: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]] | None = None) -> DataFrame:
    """A user's scorer on Arrow batches; ``setup`` makes one per task, to load a model once."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = setup() if setup else scorer
        for b in it:
            yield work(b)

    return df.mapInPandas(batches, schema)


def stop_early(scores: DataFrame, step: str, score: str, patience: int, least_gain: float = 0.0) -> DataFrame:
    """Adds ``best`` so far and ``stop``: ``patience`` evaluations without a gain.  One row per evaluation of one run."""
    order = Window.orderBy(step)
    before = F.max(score).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gained = F.when(before.isNull() | (F.col(score) > before + least_gain), F.col(step))
    last = F.max(gained).over(order)
    work = scores.withColumn("best", F.max(score).over(order)).withColumn("__g", last).withColumn("__r", F.row_number().over(order))
    since = F.col("__r") - F.max(F.when(F.col(step) == F.col("__g"), F.col("__r"))).over(order)
    return work.withColumn("stop", since >= patience).drop("__g", "__r")


def probability_of(odds: Column) -> Column:
    return V.sigmoid(odds)
