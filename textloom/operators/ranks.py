"""Row numbers and running sums over whole tables without a single-partition window.

``ORDER BY md5(key || seed)`` is the library's reproducible shuffle.  The first three hex digits of the hash deal the rows to
4,096 blocks in order; each block is ranked by itself and the (few) block counts give its offset.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 3


def hash_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def hash_rank(df: DataFrame, key: str, seed: int, by: Sequence[str] = (), name: str = "rn", total: str = "n_rows") -> DataFrame:
    """Add ``rn``, the rank (from 1) by hash within ``by``, and ``n_rows``, the rows of the group."""
    work = df.withColumn("__h", hash_key(F.col(key), seed)).withColumn("__b", F.substring("__h", 1, DIGITS))
    blocks = work.groupBy(*by, "__b").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).withColumn(total, F.sum("__c").over(every))
    right = blocks.drop("__c")
    for c in by:
        right = right.withColumnRenamed(c, f"__by_{c}")
    on = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    right = right.withColumnRenamed("__b", "__block")
    joined = work.join(right, [*on, F.col("__b") == F.col("__block")])
    within = Window.partitionBy(*by, "__b").orderBy("__h", key)
    out = joined.withColumn(name, F.row_number().over(within) + F.col("__before"))
    return out.select(*df.columns, F.col(name).cast("long").alias(name), F.col(total).cast("long").alias(total))


def running_total(df: DataFrame, order: str, value: str, width: int = 1000, name: str = "running") -> DataFrame:
    """Add the sum of ``value`` up to each row in the order of an integer column, in blocks of ``width`` of it."""
    work = df.withColumn("__b", F.floor(F.col(order) / width))
    blocks = work.groupBy("__b").agg(F.sum(value).alias("__s"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"), F.sum("__s").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("__b").orderBy(order)
    out = work.join(blocks, "__b").withColumn(name, F.sum(value).over(within) + F.col("__before"))
    return out.select(*df.columns, name, "total")


def running_sums(df: DataFrame, order: str, sums: Mapping[str, str], blocks: int = 64) -> DataFrame:
    """Add, for each ``name: column``, the sum of the column over the rows up to each row by ``order``, a number that differs in every row.

    Rows are dealt to ``blocks`` ranges between approximate quantiles of ``order`` (which come to the driver) and summed within
    them; a window over the few sums of blocks gives where each begins.
    """
    at = [i / blocks for i in range(1, blocks)]
    cuts = sorted(set(df.select(F.percentile_approx(F.col(order).cast("double"), at, 10 * blocks)).first()[0] or []))
    block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    work = df.withColumn("__b", block)
    own = {name: f"__s{i}" for i, name in enumerate(sums)}
    starts = work.groupBy("__b").agg(*[F.sum(sums[name]).alias(s) for name, s in own.items()])
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    starts = starts.select("__b", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(s) for s in own.values()])
    within = Window.partitionBy("__b").orderBy(order)
    out = work.join(F.broadcast(starts), "__b")  # a row per block
    return out.select(*df.columns, *[(F.sum(sums[name]).over(within) + F.col(s)).alias(name) for name, s in own.items()])
