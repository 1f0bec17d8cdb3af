"""Vocabularies: counts, ids, trimming, token weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")


def token_counts(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def top_vocabulary(counts: DataFrame, size: int, least: int = 1, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """``(token, n, id)``: the ``size - len(specials)`` most frequent tokens, ties by token, ids after the specials.

    Only the chosen tokens, ``size`` at most, are numbered in one task.
    """
    chosen = counts.where((F.col("n") >= least) & ~F.col("token").isin(*specials)).orderBy(F.desc("n"), "token").limit(size - len(specials))
    order = Window.orderBy(F.desc("n"), "token")
    return chosen.withColumn("id", F.row_number().over(order) + F.lit(len(specials) - 1))


def encode(tokens: DataFrame, vocabulary: DataFrame, unknown: int = 1) -> DataFrame:
    """Add ``id`` to rows with a ``token``.  The vocabulary's size is bounded by ``top_vocabulary``, so it may be broadcast."""
    return tokens.join(F.broadcast(vocabulary.select("token", "id")), "token", "left").withColumn("id", F.coalesce("id", F.lit(unknown)))


def encode_rows(tokens: Column, vocabulary: DataFrame, unknown: int = 1) -> Column:
    """An array of ids for an array of tokens; null tokens are unknown.

    The vocabulary, whose size ``top_vocabulary`` bounds, is collected and looked up batch by batch, so tokens never leave their row.
    """
    rows = vocabulary.select("token", F.col("id").cast("int").alias("id")).toArrow().combine_chunks()
    names, ids = (rows.column(c).combine_chunks() if rows.num_rows else pa.array([], t) for c, t in (("token", pa.string()), ("id", pa.int32())))

    @F.arrow_udf("array<int>")
    def looked_up(tokens: pa.Array) -> pa.Array:
        found = pc.fill_null(pc.take(ids, pc.index_in(tokens.flatten(), value_set=names)), unknown).cast(pa.int32())
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), found)

    return looked_up(tokens)


def trim(counts: DataFrame, least: int) -> DataFrame:
    """Tokens of ``least`` occurrences or more, numbered densely in the order of their hash-free sort key."""
    blocks = counts.where(F.col("n") >= least).withColumn("__b", F.substring("token", 1, 1))
    starts = blocks.groupBy("__b").agg(F.count("*").alias("__c"))
    starts = starts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("__b").orderBy("token")
    return blocks.join(starts, "__b").select("token", "n", (F.row_number().over(within) + F.col("__before") - 1).cast("long").alias("id"))


def inverse_frequency_weights(counts: DataFrame, a: float = 1e-3) -> DataFrame:
    """w = a / (a + share of the token)."""
    total = counts.agg(F.sum("n").alias("all"))
    out = counts.crossJoin(F.broadcast(total))  # one row
    return out.select("token", "n", F.round(F.lit(a) / (F.lit(a) + F.col("n") / F.col("all")), 8).alias("weight"))
