"""Sliding passages over documents, answers in passages, and positions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType
from pyspark.sql.window import Window

from textloom.functions import batches as B

TOKEN = re.compile(r"\S+", re.ASCII)


def with_offsets(df: DataFrame, text: str = "text", most: int | None = None) -> DataFrame:
    """``df`` with ``tokens`` and ``starts``: the white-space tokens of each text, or the ``most`` first ones, and their first characters.

    One Arrow pass in time linear in the text, in slices of bounded size, with no shuffle; a null text has none.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in it for part in B.slices(whole)):
            found = [[(m.group(), m.start()) for m in islice(TOKEN.finditer(t or ""), most)] for t in b.column(text).to_pylist()]
            tokens = pa.array([[w for w, _ in f] for f in found], pa.list_(pa.string()))
            starts = pa.array([[i for _, i in f] for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, tokens, starts], [*b.schema.names, "tokens", "starts"])

    schema = StructType(list(df.schema.fields)).add("tokens", ArrayType(StringType())).add("starts", ArrayType(LongType()))
    return df.mapInArrow(batches, schema)


def sentence_tokens(lines: Column) -> Column:
    """An array of texts as an array of structs of white-space ``tokens``, their ``offsets`` and ``initial``, 1 for each."""

    @F.arrow_udf("array<struct<tokens: array<string>, offsets: array<bigint>, initial: array<int>>>")
    def cut(rows: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("tokens", pa.list_(pa.string())), ("offsets", pa.list_(pa.int64())), ("initial", pa.list_(pa.int32()))]))
        out = []
        for row in rows.to_pylist():
            found = [list(TOKEN.finditer(t or "")) for t in row or ()]
            out.append([{"tokens": [m.group() for m in f], "offsets": [m.start() for m in f], "initial": [1] * len(f)} for f in found])
        return pa.array(out, kind)

    return cut(lines)


def token_at(starts: Column, ch: Column) -> Column:
    """The last token that starts at or before a character; null before the first one."""
    n = F.size(F.filter(starts, lambda s: s <= ch))
    return F.when(n > 0, n - 1)


def passage_windows(docs: DataFrame, n_tokens: Column, size: int, stride: int) -> DataFrame:
    """``docs`` with ``passage``, ``start_t`` and ``end_t`` (exclusive): windows of ``size`` tokens every ``stride``.

    The last window is the first one that reaches the end of the document; an empty document has one empty window.
    """
    if not 0 < stride <= size:
        raise ValueError("the stride has to be positive and at most the passage size")
    last = F.greatest(F.lit(0), F.ceil((n_tokens - size) / stride)).cast("int")
    out = docs.withColumn("__n", n_tokens).withColumn("passage", F.explode(F.sequence(F.lit(0), last)))
    return out.withColumn("start_t", F.col("passage") * stride).withColumn("end_t", F.least(F.col("passage") * stride + size, F.col("__n"))).drop("__n")


def passage_spans(docs: DataFrame, size: int, stride: int, key: str = "doc_id") -> DataFrame:
    """Token and character spans of the passages of ``docs(key, tokens, starts)``, looked up within the row; none of an empty text."""
    if not 0 < stride <= size:
        raise ValueError("the stride has to be positive and at most the passage size")
    n = F.size("tokens")

    def window(k: Column) -> Column:
        start, end = k * stride, F.least(k * stride + size, n)
        last = F.get("starts", end - 1) + F.length(F.get("tokens", end - 1))
        return F.struct(k.alias("passage"), start.alias("start_t"), end.alias("end_t"), F.get("starts", start).alias("start_ch"), last.alias("end_ch"))

    count = F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int")
    return docs.where(n > 0).select(key, F.inline(F.transform(F.sequence(F.lit(0), count), window)))


def as_of_tokens(points: DataFrame, offsets: DataFrame) -> DataFrame:
    """Adds ``token_pos`` to ``points(doc_id, ch)``: the last token that starts at or before the character.

    One window over both tables by document, not a join of all pairs.
    """
    tokens = offsets.select("doc_id", F.col("start").alias("ch"), F.lit(0).alias("is_point"), F.col("pos").alias("p"))
    asked = points.select("doc_id", F.col("ch").cast("bigint"), F.lit(1).alias("is_point"), F.lit(None).cast("int").alias("p"))
    order = Window.partitionBy("doc_id").orderBy("ch", "is_point").rowsBetween(Window.unboundedPreceding, 0)
    both = tokens.unionByName(asked).withColumn("token_pos", F.last("p", True).over(order))
    return both.where("is_point = 1").select("doc_id", "ch", "token_pos")


def answers_in_passages(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """Answers ``(doc_id, a_start, a_end)`` with each passage of the document that holds them; positions within the passage."""
    inside = (F.col("start_t") <= F.col("a_start")) & (F.col("a_end") <= F.col("end_t"))
    joined = answers.join(passages, "doc_id").where(inside)
    return joined.withColumn("start_in", F.col("a_start") - F.col("start_t")).withColumn("end_in", F.col("a_end") - F.col("start_t"))


def label_slots(spans: Column, slots: int) -> Column:
    """``slots`` pairs of positions, free ones (-1, -1)."""
    free = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    return F.slice(F.concat(spans, F.array_repeat(free, slots)), 1, slots)


def context_window(text: Column, start: Column, end: Column, size: int) -> tuple[Column, Column]:
    """Start and end of ``size`` characters around an answer, moved into the text; longer answers stand alone."""
    n, room = F.length(text), F.greatest(F.lit(0), size - (end - start))
    left = F.greatest(F.lit(0), F.least(start - F.floor(room / 2), n - size))
    first = F.when(end - start >= size, start).otherwise(left)
    return first, F.when(end - start >= size, end).otherwise(F.least(n, first + size))


def to_document(index: Column, offset: Column) -> Column:
    """A position within a passage as one of the document; 0 (no answer) becomes -1."""
    return F.when(index == 0, F.lit(-1)).otherwise(index + offset)
