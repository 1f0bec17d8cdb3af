"""Calibration of scores by optimisation: a temperature for logits, by Newton's method on summed derivatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import vectors as V

STEPS = 12


def derivatives(logits: Column, label: Column, beta: float) -> tuple[Column, Column, Column]:
    """Of a row, for the inverse temperature beta: negative log likelihood, its first and second derivative."""
    p = V.softmax(F.transform(logits, lambda z: z * F.lit(beta)))
    mean, square = V.dot(p, logits), V.total(F.zip_with(p, logits, lambda a, z: a * z * z))
    own = F.get(logits, label)
    return -F.log(F.get(p, label)), mean - own, square - mean * mean


def fit_temperature(df: DataFrame, logits: str, label: str, steps: int = STEPS) -> float:
    """The temperature under which softmax(logits / t) gives the labels (numbers of classes) the highest likelihood.

    The likelihood is convex in 1 / t; a step changes it fourfold at most.  A step is one native aggregation, of which two sums come
    to the driver.  Rows without logits or a label are left out; without any row, or where all logits of each row agree, it is 1.
    """
    rows = df.where(F.col(logits).isNotNull() & F.col(label).isNotNull()).select(F.col(logits).alias("z"), F.col(label).cast("int").alias("y"))
    beta = 1.0
    for _ in range(steps):
        held = rows.select(F.array(F.struct("z", "y")).alias("r"))
        one = F.get(F.transform("r", lambda r: F.struct(*[c.alias(n) for c, n in zip(derivatives(r["z"], r["y"], beta)[1:], ("g", "h"), strict=True)])), 0)
        g, h = held.select(one.alias("d")).agg(F.sum("d.g"), F.sum("d.h")).first()
        if not h:
            break
        after = min(max(beta - g / h, beta / 4), beta * 4)
        done, beta = abs(after - beta) < 1e-12 * beta, after
        if done:
            break
    return 1 / beta


def calibrated(df: DataFrame, logits: str, temperature: float, name: str = "probabilities") -> DataFrame:
    return df.withColumn(name, V.softmax(V.temperature_scale(F.col(logits), temperature)))


def expected_calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """The mean over rows of the distance between a bin's mean confidence and its accuracy: ``(ece, n)``."""
    bin_ = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    each = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(F.col(correct).cast("double")) - F.avg(confidence)).alias("gap"))
    return each.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
