"""A training corpus from ``documents`` in five stages; each takes all that the one before it kept.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``.  All but the last return the columns of ``documents``.

1. quality classifier: documents that the co-trained classifier rejects go;
2. line dedup: lines with an earlier match go, and documents of which no word is left;
3. n-gram Jaccard join: of each group of linked documents the smallest doc_id stays, and one row of repeated rows (rows of one
   id with different texts stay or go together);
4. mixing: each document stands as often as the mix takes it, so repeated rows are copies;
5. BPE: the number of tokens and the digests of ids and decoded text.

Rows without an id pass the stages on pairs of documents unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, cotraining, line_dedup, mixing, shingle_join
from textloom.llm.common import collect_garbage, has_words, materialise, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return cotraining.classify(docs, read(spark, sf_dir, "labels"), tuple(COLUMNS)).where("kept").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    out = out.where((F.col("n_removed") == 0) | has_words(F.col("text")))
    size = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))
    return out.withColumn("n_chars", size.cast("long")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    first = shingle_join.components(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id").dropDuplicates(["doc_id", "text"]).select(*COLUMNS).unionByName(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The classifier is fitted, so the rows can't be had by SQL; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        collect_garbage(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
