"""Functions for Spark SQL: table functions and an aggregate, callable by name after :func:`register`.

``passages(text, size, stride)`` is used with a lateral join; ``runs(TABLE(t) PARTITION BY k ORDER BY (x, y))`` reads a partition's rows as a
stream and holds the open run only; ``entropy(n)`` aggregates counts, which are best summed per value first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_WORD = re.compile(r"\S+", re.ASCII)


@F.udtf(returnType="passage int, start_t int, end_t int, start_ch int, end_ch int, passage_text string")
class Passages:
    """Windows of ``size`` white-space tokens every ``stride`` of a text; none of a null or blank one."""

    def eval(self, text: str, size: int, stride: int) -> Iterator[tuple]:
        if not 0 < stride <= size:
            raise ValueError("the stride has to be positive and at most the passage size")
        spans = [m.span() for m in _WORD.finditer(text or "")]
        for k, at in enumerate(range(0, max(len(spans) - size, 0) + stride, stride)):
            if spans:
                end = min(at + size, len(spans))
                first, last = spans[at][0], spans[end - 1][1]
                yield k, at, end, first, last, text[first:last]
                if end == len(spans):
                    return


@F.udtf(returnType="part string, value string, first string, last string, n long")
class Runs:
    """Runs of one value in the order of a partition: rows of (part, value, place); nulls are a value of their own."""

    def __init__(self) -> None:
        self.open: list | None = None

    def eval(self, row: Row) -> Iterator[tuple]:
        part, value, place = row[0], row[1], row[2]
        if self.open is not None and self.open[1] == value:
            self.open[3] = str(place)
            self.open[4] += 1
            return
        if self.open is not None:
            yield tuple(self.open)
        self.open = [None if part is None else str(part), value, str(place), str(place), 1]

    def terminate(self) -> Iterator[tuple]:
        if self.open is not None:
            yield tuple(self.open)


@F.pandas_udf(DoubleType())
def entropy(n: pd.Series) -> float:
    """The entropy in bits of a distribution given by counts; 0 without any."""
    counts = n.dropna().to_numpy(float)
    counts = counts[counts > 0]
    if not len(counts):
        return 0.0
    p = counts / counts.sum()
    return float(-(p * np.log2(p)).sum())


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    spark.udtf.register("passages", Passages)
    spark.udtf.register("runs", Runs)
    spark.udf.register("entropy", entropy)
