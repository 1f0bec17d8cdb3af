"""Cross-validation that ends in scores: parameter grids, models per fold, out-of-fold predictions in one table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import vectors as V


def parameter_grid(choices: Mapping[str, Sequence], excluded: Sequence[Mapping[str, object]] = ()) -> list[dict]:
    """All combinations in the order of ``choices``, but those that hold all pairs of an excluded one."""
    every = [dict(zip(choices, values, strict=True)) for values in product(*choices.values())]
    return [p for p in every if not any(all(p.get(k) == v for k, v in x.items()) for x in excluded)]


def with_grid(df: DataFrame, choices: Mapping[str, Sequence], excluded: Sequence[Mapping[str, object]] = ()) -> DataFrame:
    """Each row once per combination of a grid, less the exclusions, which may name columns of ``df`` as well.

    Combinations are exploded from literals, so there is no join and no shuffle.
    """
    out = df
    for name, values in choices.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    for x in excluded:
        hit = F.lit(True)
        for name, value in x.items():
            hit = hit & F.col(name).eqNullSafe(F.lit(value))
        out = out.where(~hit)
    return out


def cross_validate(
    df: DataFrame, key: str, fold: str, folds: int, fit: Callable[..., object], predict: Callable[[object, DataFrame], DataFrame], grid: Sequence[Mapping] = ({},), parallel: int = 4
) -> DataFrame:
    """Out-of-fold predictions: every row once per combination of the grid, by a model that did not see its fold.

    ``fit(train, **params)`` gives a model, ``predict(model, rows)`` the rows with their predictions.  Up to ``parallel`` fits run side by side, as
    jobs of one session.  The result has the columns of ``predict``, ``fold`` and ``grid``, the number of the combination.  Rows whose fold
    is null are scored by no model and teach none.
    """
    jobs = [(g, params, k) for g, params in enumerate(grid) for k in range(folds)]

    def run(job: tuple[int, Mapping, int]) -> DataFrame:
        g, params, k = job
        model = fit(df.where(F.col(fold) != k), **params)
        return predict(model, df.where(F.col(fold) == k)).withColumns({"grid": F.lit(g), fold: F.lit(k)})

    with ThreadPool(max(1, min(parallel, len(jobs)))) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(run), jobs)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fold_moments(df: DataFrame, fold: str, features: Sequence[str], target: str) -> dict[int, np.ndarray]:
    """For each fold the sums of products of (1, features, target), from one pass; (d + 2)^2 numbers a fold come to the driver.

    Rows with a null among them are left out.
    """
    size = len(features) + 2
    columns = [F.col(fold).cast("int").alias("fold"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in (*features, target)]).alias("x")]
    rows = df.select(*columns).where(F.col("fold").isNotNull() & ~F.exists("x", lambda x: x.isNull()))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in it:
            folds, x = b.column("fold").to_numpy(), b.column("x").flatten().to_numpy().reshape(-1, size)
            for k in np.unique(folds).tolist():
                own = x[folds == k]
                sums[k] = sums.get(k, 0) + own.T @ own
        for k, m in sums.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, k, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(m.ravel())], ["fold", "i", "j", "x"])

    found = rows.mapInArrow(batches, "fold int, i int, j int, x double").groupBy("fold", "i", "j").agg(F.sum("x").alias("x")).toArrow()
    out: dict[int, np.ndarray] = {}
    for k, i, j, x in zip(*(found.column(c).to_pylist() for c in ("fold", "i", "j", "x")), strict=True):
        out.setdefault(k, np.zeros((size, size)))[i, j] = x
    return out


def ridge(moments: np.ndarray, penalty: float) -> np.ndarray:
    """Intercept and weights of the least squares with a penalty on the weights alone, from sums of products."""
    n = moments[0, 0]
    if not n:
        return np.zeros(len(moments) - 1)
    means = moments[0, 1:-1] / n
    y = moments[0, -1] / n
    cov = moments[1:-1, 1:-1] - n * np.outer(means, means) + penalty * np.eye(len(means))
    w = np.linalg.lstsq(cov, moments[1:-1, -1] - n * means * y, rcond=None)[0]
    return np.concatenate([[y - means @ w], w])


def ridge_out_of_fold(df: DataFrame, keys: Sequence[str], fold: str, folds: int, features: Sequence[str], target: str, penalties: Sequence[float]) -> DataFrame:
    """Linear predictions of every row for every penalty by the model of the other folds: ``keys, fold, penalty, prediction``.

    All folds and penalties come from one pass of sums: a model's moments are the total's less its own fold's.
    """
    by_fold = fold_moments(df, fold, features, target)
    total = sum(by_fold.values()) if by_fold else np.zeros((len(features) + 2,) * 2)
    models = [[ridge(total - by_fold.get(k, 0), p) for p in penalties] for k in range(folds)]
    flat = lambda w: F.array(*map(F.lit, map(float, w)))
    table = F.array(*[F.array(*[F.struct(F.lit(float(p)).alias("penalty"), flat(w).alias("w")) for p, w in zip(penalties, ws, strict=True)]) for ws in models])
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    rows = df.where(F.col(fold).isNotNull()).select(*keys, fold, x.alias("__x"), F.explode(F.get(table, F.col(fold))).alias("__m"))
    return rows.select(*keys, fold, F.col("__m.penalty").alias("penalty"), V.dot(F.col("__x"), F.col("__m.w")).alias("prediction"))


def fold_scores(scored: DataFrame, by: Sequence[str], prediction: str, target: str) -> DataFrame:
    """Root mean squared error and rows per ``by``, to choose among a grid by out-of-fold predictions."""
    error = (F.col(prediction) - F.col(target)) ** 2
    return scored.groupBy(*by).agg(F.sqrt(F.avg(error)).alias("rmse"), F.count(error).alias("n"))


def chosen(scores: DataFrame, score: str, smallest: bool = True) -> Column:
    """The row of a small table of scores with the best one, as an aggregate."""
    return (F.min_by if smallest else F.max_by)(F.struct(*scores.columns), F.col(score))
