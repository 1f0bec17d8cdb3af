"""Sequence tags: IOB rewriting, entities and their score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.functions import vectors as V


def _kind(tag: Column) -> Column:
    return F.substring_index(tag, "-", -1)


def iob1_to_iob2(tags: DataFrame, seq: str, pos: str, tag: str = "tag") -> DataFrame:
    """An I that opens an entity (after O, another type, or at the start) becomes B."""
    before = F.lag(tag).over(Window.partitionBy(seq).orderBy(pos))
    opens = F.col(tag).startswith("I-") & (before.isNull() | (before == "O") | (_kind(before) != _kind(F.col(tag))))
    return tags.withColumn(tag, F.when(opens, F.concat(F.lit("B-"), _kind(F.col(tag)))).otherwise(F.col(tag)))


def entities(tags: DataFrame, seq: str, pos: str, tag: str = "tag", probability: str | None = None) -> DataFrame:
    """``(seq, kind, start, end)`` of IOB2 entities, with the mean probability where given.

    B opens, a matching I extends, anything else closes; an I that follows no open entity of its type belongs to none.
    """
    order = Window.partitionBy(seq).orderBy(pos)
    keep = [seq, pos, tag] + ([probability] if probability else [])
    work = tags.select(*keep, F.lag(tag).over(order).alias("__before"))
    kind = F.when(F.col(tag) != "O", _kind(F.col(tag)))
    chained = F.col(tag).startswith("I-") & F.col("__before").isNotNull() & (F.col("__before") != "O") & (_kind(F.col("__before")) == kind)
    work = work.withColumn("__kind", kind).withColumn("__run", F.sum((~chained).cast("int")).over(order))
    groups = work.where("__kind IS NOT NULL").groupBy(seq, "__run", F.col("__kind").alias("kind"))
    out = groups.agg(
        F.min(F.struct(pos, tag)).alias("first"),
        F.max(pos).alias("end"),
        *([F.round(F.avg(probability), 6).alias("probability")] if probability else []),
    )
    out = out.where(F.col("first")[tag].startswith("B-"))
    return out.select(seq, "kind", F.col("first")[pos].alias("start"), "end", *(["probability"] if probability else []))


def entity_f1(preds: DataFrame, golds: DataFrame, seq: str) -> DataFrame:
    """Micro precision, recall and F1 over (sequence, type, start, end)."""
    key = [seq, "kind", "start", "end"]
    both = preds.select(*key, F.lit(1).alias("p")).join(golds.select(*key, F.lit(1).alias("g")), key, "full").na.fill(0, ["p", "g"])
    s = both.agg(F.sum(F.col("p") * F.col("g")).alias("tp"), F.sum("p").alias("np"), F.sum("g").alias("ng"))
    part = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return s.select(part(F.col("tp"), F.col("np")).alias("precision"), part(F.col("tp"), F.col("ng")).alias("recall"), part(2 * F.col("tp"), F.col("np") + F.col("ng")).alias("f1"))


def word_starts(word_ids: DataFrame, seq: str, pos: str, word: str) -> DataFrame:
    """1 at the first token of each word, else 0."""
    before = F.lag(word).over(Window.partitionBy(seq).orderBy(pos))
    return word_ids.withColumn("initial", F.when(before.isNull() | (before != F.col(word)), 1).otherwise(0))


def tag_predictions(df: DataFrame, logits: str, initial: str, labels: Sequence[str]) -> DataFrame:
    """``df`` with ``preds`` and ``probabilities`` of each word: those of its first piece.

    ``logits`` is an array of a row of scores per piece, ``initial`` 1 at first pieces; ties go to the earlier label.
    """
    names = F.array(*map(F.lit, labels))
    kept = T.initial_only(F.col(logits), F.col(initial))
    best = F.transform(kept, lambda v: F.get(names, V.argmax(v).cast("int")))
    return df.withColumn("preds", best).withColumn("probabilities", F.transform(kept, lambda v: F.array_max(V.softmax(v))))


def next_sentence_predictions(df: DataFrame, logits: str) -> DataFrame:
    """``df`` with ``is_next`` and its ``probability``, from the scores of (B follows A, B is another text); a tie follows."""
    return df.withColumn("is_next", V.argmax(F.col(logits)) == 0).withColumn("probability", F.array_max(V.softmax(F.col(logits))))
