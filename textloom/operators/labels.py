"""Label statistics: lengths, counts, class weights, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_stats(lengths: DataFrame, length: str, limit: int) -> DataFrame:
    """Average and largest length, and the share of sequences that fill the limit."""
    cut = F.least(F.col(length), F.lit(limit))
    return lengths.agg(
        F.count("*").alias("n"),
        F.round(F.avg(cut), 6).alias("avg_len"),
        F.max(cut).alias("max_len"),
        F.round(F.avg((F.col(length) >= limit).cast("int")), 6).alias("clipped"),
    )


def split_counts(df: DataFrame, split: str) -> DataFrame:
    """Rows of each split and of all together (null)."""
    return df.rollup(split).agg(F.count("*").alias("n"))


def class_weights(df: DataFrame, label: str, labels: Sequence[int | str]) -> DataFrame:
    """Balanced weights (N + K) / (K (c + 1)): each of the K labels counts once more than it was seen."""
    spark = df.sparkSession
    given = spark.createDataFrame([(x,) for x in labels], f"label {df.schema[label].dataType.simpleString()}")
    counts = df.where(F.col(label).isin(*labels)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("c"))
    full = given.join(counts, "label", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    total = full.agg(F.sum("c").alias("n"))
    k = len(labels)
    out = full.crossJoin(F.broadcast(total))  # one row
    return out.select("label", F.round((F.col("n") + k) / (k * (F.col("c") + 1)), 6).alias("weight"))


def fit_scaling(df: DataFrame, value: str) -> DataFrame:
    """Mean and population deviation, one row."""
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("scale"))


def scaled(value: Column) -> Column:
    return (value - F.col("mean")) / F.col("scale")


def unscaled(value: Column) -> Column:
    return value * F.col("scale") + F.col("mean")


def pair_length_stats(df: DataFrame, query_length: str, passage_lengths: str, limit: int) -> DataFrame:
    """Lengths of queries and of their passages (an array column); a passage's average is over all passages of all rows."""
    q = F.least(F.col(query_length), F.lit(limit))
    cut = F.transform(passage_lengths, lambda n: F.least(n, F.lit(limit)))
    total = F.aggregate(cut, F.lit(0).cast("long"), lambda a, n: a + n)
    passages = F.sum(F.size(passage_lengths))
    return df.agg(
        F.count("*").alias("n"),
        F.round(F.avg(q), 6).alias("avg_query"),
        F.max(q).alias("max_query"),
        passages.alias("n_passages"),
        F.round(F.when(passages > 0, F.sum(total) / passages), 6).alias("avg_passage"),
        F.max(F.array_max(cut)).alias("max_passage"),
    )
