"""Reproducible splits and folds in the order of md5(key || seed)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators.ranks import hash_key, hash_rank, running_total


def random_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Add ``split``: exactly ceil(share * n) rows are dev."""
    ranked = hash_rank(df, key, seed, name="__rn", total="__n")
    return ranked.select(*df.columns, F.when(F.col("__rn") <= F.ceil(F.col("__n") * share), "dev").otherwise("train").alias("split"))


def stratified_split(df: DataFrame, key: str, stratum: str, share: float, seed: int) -> DataFrame:
    """Add ``split``: ceil(share * n) rows of every stratum are dev."""
    ranked = hash_rank(df, key, seed, [stratum], name="__rn", total="__n")
    return ranked.select(*df.columns, F.when(F.col("__rn") <= F.ceil(F.col("__n") * share), "dev").otherwise("train").alias("split"))


def custom_split(df: DataFrame, splitter: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The parts that a user's function gives, marked."""
    train, dev = splitter(df)
    return train.withColumn("split", F.lit("train")).unionByName(dev.withColumn("split", F.lit("dev")))


def k_fold(df: DataFrame, key: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """Add a fold from 0; sizes differ by one at most, larger folds first (as ``ntile``)."""
    ranked = hash_rank(df, key, seed, name="__rn", total="__n")
    small, large = F.floor(F.col("__n") / k), F.col("__n") % k
    edge = large * (small + 1)
    first = F.floor((F.col("__rn") - 1) / (small + 1))
    rest = large + F.floor((F.col("__rn") - 1 - edge) / F.greatest(small, F.lit(1)))
    return ranked.select(*df.columns, F.when(F.col("__rn") <= edge, first).otherwise(rest).cast("int").alias(name))


def stratified_k_fold(df: DataFrame, key: str, stratum: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    ranked = hash_rank(df, key, seed, [stratum], name="__rn", total="__n")
    return ranked.select(*df.columns, ((F.col("__rn") - 1) % k).cast("int").alias(name))


def nested_folds(df: DataFrame, key: str, outer: int, inner: int, seed: int) -> DataFrame:
    """Each row once per (outer, inner) pair with its part: test, dev or train."""
    folds = k_fold(k_fold(df, key, outer, seed, "__o"), key, inner, seed + 1, "__i")
    grid = folds.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))).withColumn("inner", F.explode(F.sequence(F.lit(0), F.lit(inner - 1))))
    part = F.when(F.col("__o") == F.col("outer"), "test").when(F.col("__i") == F.col("inner"), "dev").otherwise("train")
    return grid.select(*df.columns, "outer", "inner", part.alias("part"))


def repeated_holdout(df: DataFrame, key: str, repeats: int, share: float, seed: int) -> DataFrame:
    """Each row once per repeat, with its part."""
    parts = [random_split(df, key, share, seed + r).withColumn("repeat", F.lit(r)) for r in range(repeats)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def document_folds(counts: DataFrame, key: str, n: str, k: int) -> DataFrame:
    """Folds of whole documents with about the same sum of ``n``, cut along an integer key.

    A document belongs to the fold in which its running sum falls; cut points are multiples of total div k, the last fold takes
    what is left.
    """
    run = running_total(counts, key, n)
    cut = F.floor(F.col("total") / k)
    return run.select(*counts.columns, F.least(F.lit(k - 1), F.floor((F.col("running") - 1) / cut)).cast("int").alias("fold"))


def keep_negatives(df: DataFrame, key: str, group: Sequence[str], positive: str, keep: float, seed: int) -> DataFrame:
    """All positives, negatives with probability ``keep`` by hash, and one row at least of each group."""
    unit = F.conv(F.substring(hash_key(F.col(key), seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    work = df.withColumn("__keep", F.expr(positive) | (unit < keep)).withColumn("__h", hash_key(F.col(key), seed))
    most = Window.partitionBy(*group)
    work = work.withColumn("__any", F.max("__keep").over(most)).withColumn("__first", F.min(F.struct("__h", key)).over(most))
    return work.where(F.col("__keep") | (~F.col("__any") & (F.col("__first") == F.struct("__h", key)))).select(*df.columns)


def cap_negatives(df: DataFrame, key: str, group: Sequence[str], positive: str, most: int, seed: int) -> DataFrame:
    """All positives and at most ``most`` negatives of each group, by hash."""
    positive_ = F.expr(positive)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(hash_key(F.col(key), seed), key))
    negatives = df.where(~positive_).withColumn("__r", rank).where(F.col("__r") <= most).select(*df.columns)
    return df.where(positive_).unionByName(negatives)


def worker_rows(df: DataFrame, number: str, n: int, worker: int, workers: int) -> DataFrame:
    """A worker's rows: of chunks of ``n`` by the row's number, every ``workers``-th one from its own on."""
    if not 0 <= worker < workers:
        raise ValueError("a worker is numbered from 0")
    return df.where(F.pmod(F.floor(F.col(number) / n), F.lit(workers)) == worker)


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same each time."""
    return df.orderBy(hash_key(F.col(key), seed), key).limit(n)


def chunk_split(df: DataFrame, chunk: str, share: float) -> DataFrame:
    """Add ``split``: whole chunks (an integer column) in order, train while the rows so far are at most n - floor(share * n), then dev.

    The share is met as near as chunks allow; a side without rows raises ``ValueError``.
    """
    counts = df.groupBy(chunk).agg(F.count("*").alias("__n"))
    run = running_total(counts, chunk, "__n")
    parts = run.select(F.col(chunk).alias("__chunk"), F.when(F.col("running") <= F.col("total") - F.floor(F.col("total") * share), "train").otherwise("dev").alias("split"))
    sides = {r[0] for r in parts.select("split").distinct().collect()}
    if sides != {"train", "dev"}:
        raise ValueError("a side of the split has no chunk")
    return df.join(parts, F.col(chunk) == F.col("__chunk")).drop("__chunk")


def assert_disjoint(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    """Raise ``ValueError`` if a key stands in both."""
    shared = a.select(*keys).join(b.select(*keys), list(keys), "left_semi").limit(1).collect()
    if shared:
        raise ValueError(f"in both parts: {shared[0].asDict()}")


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest keys: a document limit that is the same on every run."""
    return df.orderBy(key).limit(n)
