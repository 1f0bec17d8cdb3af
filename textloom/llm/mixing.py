"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document has an expected number of copies, ``target / size`` of its source.  Documents of a source stand in a fixed
order; the running sum of expected copies, plus one random offset per source, emits a document once for each integer
boundary that it crosses.  The order goes by size class first, so that the sample takes small and large documents alike and
the words taken stay near the target.

Scale: the running sum is split into blocks (source, size class, hash class).  Each block is a window of its own, so a
source with a third of all rows is spread over thousands of tasks; only block counts are summed along a source, and their
number is bounded by 16 classes per power of two of the size, times ``HASH_CLASSES``.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; repeated rows are documents of
their own; a source of size 0 gets target 0 and takes nothing; an empty table gives an empty result.  Extra columns pass
through unless they clash with an output column, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import free_names, n_words

HASH_CLASSES = 16


def _size_class(size: Column) -> Column:
    """A number that grows with size: its bit length and its four bits after the first."""
    bits = F.length(F.bin(size))
    fine = F.when(bits > 5, F.expr("shiftright(size, length(bin(size)) - 5)").bitwiseAND(F.lit(15).cast("long"))).otherwise(F.lit(0))
    return F.when(bits > 5, bits * 32 + fine).otherwise(size).cast("int")


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_copies: int = 3) -> DataFrame:
    """Add ``target`` to ``sizes(source, source_size)``, one row per source.

    Sources by code point, null last, take ``weights`` in turn and share the sum of all sizes.  A target stops at
    ``max_copies`` times its source's size; the excess goes to the others by weight until none is above.
    The windows without a key run over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    table = sizes.withColumn(
        "w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    )
    every = Window.partitionBy()
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    table = (
        table.withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("all_w", F.sum("w").over(every))
        .withColumn("cap_before", F.coalesce(F.sum(F.col("source_size") * max_copies).over(before), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    )
    # in the order of the caps, the first source that stays below its cap fixes the level for itself and all after it
    rest, weight = F.col("all_size") - F.col("cap_before"), F.col("all_w") - F.col("w_before")
    table = table.withColumn("open", (F.col("source_size") * max_copies * weight >= F.col("w") * rest) & (F.col("source_size") > 0))
    table = table.withColumn("open_rest", F.first(F.when(F.col("open"), rest), True).over(by_cap.rowsBetween(Window.unboundedPreceding, 0)))
    table = table.withColumn("open_w", F.first(F.when(F.col("open"), weight), True).over(by_cap.rowsBetween(Window.unboundedPreceding, 0)))
    share = (F.col("w") * F.col("open_rest")).cast("double") / F.col("open_w").cast("double")
    return table.select("source", "source_size", F.when(F.col("open_rest").isNull(), F.col("source_size") * float(max_copies)).otherwise(share).alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_copies: int = 3,
    seed: int = 8,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """``docs`` plus ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words that the mix takes)."""
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    src, hashed, kind, words, rows, offset_, before, rank = free_names(docs, "src", "hash", "class", "words", "rows", "offset", "before", "rank")
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    sized = docs.select(
        "*",
        n_words(F.col(text)).alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias(src),  # a null source is "n", as no other is
        (_hex(F.concat(key, F.lit(f"/{seed}")), 2) % HASH_CLASSES).cast("int").alias(hashed),
    ).withColumn(kind, _size_class(F.col("size")))
    block = [src, kind, hashed]
    blocks = sized.groupBy(*block).agg(F.sum("size").alias(words), F.count("*").alias(rows))
    sizes = blocks.groupBy(src).agg(F.sum(words).alias("source_size"))
    sizes = sizes.select(F.when(F.col(src) != "n", F.substring(src, 2, 1 << 30)).alias("source"), "source_size")
    offset = _hex(F.concat(F.col(src), F.lit(f"/{seed}")), 8) / F.lit(4294967296.0)
    targets = source_targets(sizes, weights, max_copies)
    targets = targets.withColumn(src, F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    targets = targets.select(src, "source_size", "target", offset.alias(offset_))
    along = Window.partitionBy(src).orderBy(kind, hashed).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*block, F.coalesce(F.sum(rows).over(along), F.lit(0)).alias(before)).join(targets, src)
    within = Window.partitionBy(*block).orderBy(F.col(doc_id).asc_nulls_first(), "size")
    ranked = sized.withColumn(rank, F.row_number().over(within))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    end = F.col(before) + F.col(rank)
    copies = F.floor(end * rate + F.col(offset_)) - F.floor((end - 1) * rate + F.col(offset_))
    out = ranked.join(starts, block).withColumn("copies", copies.cast("long"))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*docs.columns, "size", "source_size", "target", "copies", "taken")
