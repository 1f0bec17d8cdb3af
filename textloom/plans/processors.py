"""Processors: from raw rows to model-ready rows, each a function DataFrame -> DataFrame that also runs on a stream.

Rows that can't be made ready (labels that are not in the list) are set aside by :func:`quarantine`; where one part of a record
fails, the record fails.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import models as M
from textloom.operators import passages as PS
from textloom.operators.labels import class_weights
from textloom.plans.common import read
from textloom.sources.writers import load_settings, save_settings

QUERIES: dict = {}
SQL: dict[str, str] = {}

Processor = Callable[[DataFrame], DataFrame]
_PROCESSORS: dict[str, Callable[..., Processor]] = {}


def register_processor(name: str, make: Callable[..., Processor]) -> None:
    """Users add their own; ``make(**options)`` gives the function."""
    _PROCESSORS[name] = make


def processor(name: str, **options: object) -> Processor:
    return _PROCESSORS[name](**options)


def save_processor(spark: SparkSession, name: str, options: dict, path: str) -> None:
    """A processor's name and options (values that JSON can hold, the vocabulary among them) as a file."""
    if name not in _PROCESSORS:
        raise KeyError(name)
    json.dumps(options)  # raises what can't be kept
    save_settings(spark, {"processor": name, "options": options}, path)


def load_processor(spark: SparkSession, path: str, **changes: object) -> Processor:
    """The processor saved at ``path``, with some options changed."""
    kept = load_settings(spark, path)
    return processor(kept["processor"], **{**kept["options"], **changes})


def _ready(first: Column, second: Column | None, size: int) -> list[Column]:
    """Tokens with special ones, padding mask and segments, all of length ``size``."""
    if second is None:
        a, b = F.slice(first, 1, size - 2), None
    else:
        na, nb = T.pair_lengths(F.size(first), F.size(second), size - 3)
        a, b = F.slice(first, F.lit(1), na), F.slice(second, F.lit(1), nb)
    tokens = T.with_specials(a, b)
    return [
        T.pad(tokens, size, F.lit("[PAD]")).alias("tokens"),
        T.pad(F.transform(tokens, lambda _: F.lit(1)), size, F.lit(0)).alias("padding_mask"),
        T.pad(T.segment_ids(a, b), size, F.lit(0)).alias("segment_ids"),
    ]


def text_classification(labels: Sequence[str], text: str = "text", label: str = "label", size: int = 128, multilabel: bool = False) -> Processor:
    def run(df: DataFrame) -> DataFrame:
        ids = T.multi_hot(F.col(label), labels) if multilabel else T.label_index(F.col(label), labels)
        out = df.select("*", *_ready(T.space_tokens(F.coalesce(F.col(text), F.lit(""))), None, size), ids.alias("label_ids"))
        return out if multilabel else out.where("label_ids IS NOT NULL")

    return run


def pair_classification(labels: Sequence[str], label: str = "label", size: int = 128) -> Processor:
    def run(df: DataFrame) -> DataFrame:
        sides = [T.space_tokens(F.coalesce(F.col(c), F.lit(""))) for c in ("text", "text_b")]
        out = df.select("*", *_ready(*sides, size), T.label_index(F.col(label), labels).alias("label_ids"))
        return out.where("label_ids IS NOT NULL")

    return run


def regression(mean: float, scale: float, text: str = "text", label: str = "label", size: int = 128, text_b: str | None = None) -> Processor:
    """The label standardised by the training data's mean and deviation."""

    def run(df: DataFrame) -> DataFrame:
        second = None if text_b is None else T.space_tokens(F.coalesce(F.col(text_b), F.lit("")))
        value = ((F.col(label) - mean) / scale).cast("double")
        return df.select("*", *_ready(T.space_tokens(F.coalesce(F.col(text), F.lit(""))), second, size), value.alias("regression_label"))

    return run


def inference(text: str = "text", size: int = 128) -> Processor:
    return lambda df: df.select("*", *_ready(T.space_tokens(F.coalesce(F.col(text), F.lit(""))), None, size))


def token_tags(labels: Sequence[str], piece: int = 6, size: int = 128) -> Processor:
    """``tokens`` and ``tags`` arrays to pieces of at most ``piece`` characters; only a word's first piece has its label, others X.

    Records with a tag outside the list are left out; words beyond ``size`` - 2 pieces are cut and counted.
    """

    def run(df: DataFrame) -> DataFrame:
        starts = lambda w: F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1)), F.lit(piece))
        pieces = F.flatten(F.transform("tokens", lambda w: F.transform(starts(w), lambda i: w.substr(i, F.lit(piece)))))
        initial = F.flatten(F.transform("tokens", lambda w: F.transform(starts(w), lambda i: (i == 1).cast("int"))))
        known = F.forall("tags", lambda t: t.isin(*labels))
        work = df.where(known).withColumn("pieces", pieces).withColumn("initial_mask", initial)
        work = work.withColumn("label_names", T.expand_labels(F.col("tags"), F.col("initial_mask")))
        cut = F.greatest(F.lit(0), F.size("pieces") - (size - 2))
        return work.select(*df.columns, *[F.slice(c, 1, size - 2).alias(c) for c in ("pieces", "initial_mask", "label_names")], cut.alias("n_cut"))

    return run


def question_answering(size: int = 64, stride: int = 32, slots: int = 6) -> Processor:
    """``(doc_id, text, a_start, a_end)`` (token positions, -1 for none) to passages with answer slots in passage positions."""

    def run(df: DataFrame) -> DataFrame:
        windows = PS.passage_windows(df.withColumn("t", T.space_tokens(F.col("text"))), F.size("t"), size, stride)
        inside = (F.col("a_start") >= F.col("start_t")) & (F.col("a_end") <= F.col("end_t")) & (F.col("a_start") >= 0)
        span = F.struct((F.col("a_start") - F.col("start_t")).cast("int").alias("start"), (F.col("a_end") - F.col("start_t") - 1).cast("int").alias("end"))
        none = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
        first = F.array(F.when(inside, span).otherwise(none))
        return windows.select("doc_id", "passage", "start_t", F.slice("t", F.col("start_t") + 1, size).alias("tokens"), PS.label_slots(first, slots).alias("labels"))

    return run


def natural_questions(radius: int = 200) -> Processor:
    """Crops long documents to ``radius`` words around their answers and unites short answers.

    ``(words, long_start, long_end, short array<struct<start, end>>, yes_no)``: positions of words, -1 for none.  The answer is the
    union of the short answers, else the long one; ``answer_type`` is yes, no, span or no_answer.
    """

    def run(df: DataFrame) -> DataFrame:
        start = F.coalesce(F.array_min(F.transform("short", lambda s: s["start"])), F.when(F.col("long_start") >= 0, F.col("long_start")))
        end = F.coalesce(F.array_max(F.transform("short", lambda s: s["end"])), F.when(F.col("long_end") >= 0, F.col("long_end")))
        kind = F.when(F.col("yes_no").isin("yes", "no"), F.col("yes_no")).when(F.col("a_start").isNotNull(), "span").otherwise("no_answer")
        work = df.withColumn("a_start", start).withColumn("a_end", end).withColumn("answer_type", kind)
        low = F.greatest(F.lit(0), F.coalesce(F.col("a_start"), F.lit(0)) - radius)
        high = F.least(F.size("words"), F.coalesce(F.col("a_end"), F.lit(0)) + radius)
        return work.select(
            *df.columns, "answer_type", F.slice("words", low + 1, F.greatest(F.lit(0), high - low)).alias("cropped"), low.alias("shift"),
            (F.col("a_start") - low).alias("crop_start"), (F.col("a_end") - low).alias("crop_end"),
        )

    return run


def text_similarity(positives: int = 1, negatives: int = 1, size: int = 64) -> Processor:
    """``(query, passages)`` of the retrieval reader to token rows with labels; missing passages are empty ones."""

    def run(df: DataFrame) -> DataFrame:
        empty = F.struct(F.lit("").alias("title"), F.lit("").alias("text"), F.lit("padding").alias("label"), F.lit("").alias("external_id"))
        pos = F.slice(F.filter("passages", lambda p: p["label"] == "positive"), 1, positives)
        neg = F.slice(F.filter("passages", lambda p: p["label"] == "hard_negative"), 1, negatives)
        both = F.slice(F.concat(pos, neg, F.array_repeat(empty, positives + negatives)), 1, positives + negatives)
        words = F.transform(both, lambda p: F.slice(T.space_tokens(F.concat_ws(" ", p["title"], p["text"])), 1, size))
        marks = F.transform(both, lambda p: (p["label"] == "positive").cast("int"))
        return df.select("*", F.slice(T.space_tokens(F.col("query")), 1, size).alias("query_tokens"), words.alias("passage_tokens"), marks.alias("label_ids"))

    return run


def quarantine(df: DataFrame, ready: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` of which no ready row was made."""
    return df.join(ready.select(key).distinct(), key, "left_anti")


for _n, _f in {
    "text_classification": text_classification, "pair_classification": pair_classification, "regression": regression, "inference": inference,
    "token_tags": token_tags, "question_answering": question_answering, "natural_questions": natural_questions, "text_similarity": text_similarity,
}.items():
    register_processor(_n, _f)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    r"""WITH t AS (SELECT doc_id, list_position(['de', 'en'], lang) - 1 AS label_ids, regexp_extract_all(text, '\S+')[1:30] AS a FROM documents WHERE lang IN ('de', 'en'))
    SELECT doc_id, label_ids, array_to_string(list_resize(list_concat(['[CLS]'], a, ['[SEP]']), 32, '[PAD]'), ' ') AS tokens, len(a) + 2 AS n_mask FROM t"""
)
def process_text_classification(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    out = processor("text_classification", labels=["de", "en"], size=32)(docs)
    return out.select("doc_id", "label_ids", F.array_join("tokens", " ").alias("tokens"), F.aggregate("padding_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n_mask"))


@query(
    r"""SELECT doc_id, k::INT AS passage, (k * 32)::INT AS start_t, CASE WHEN 40 >= k * 32 AND 45 <= least(k * 32 + 64, len(t)) THEN 40 - k * 32 ELSE 0 END::INT AS label_start
    FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS t FROM documents), range(0, greatest(0, ceil((len(t) - 64) / 32.0))::BIGINT + 1) r(k)"""
)
def process_question_answering(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text", F.lit(40).alias("a_start"), F.lit(45).alias("a_end"))
    out = processor("question_answering")(docs)
    return out.select("doc_id", "passage", "start_t", F.col("labels")[0]["start"].alias("label_start"))


@query("SELECT doc_id, lang AS label FROM documents WHERE lang NOT IN ('de', 'en')")
def process_quarantine(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    return quarantine(docs, processor("text_classification", labels=["de", "en"])(docs), "doc_id").select("doc_id", "label")


@query()
def model_text_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("doc_id", "text", "quality")
    model = M.fit_text_classifier(docs, "text", "quality", class_weights(docs, "quality", [0, 1]), 10)
    return M.classify(model, docs.drop("quality"), ["low", "high"]).select("doc_id", "label", F.round("probability", 4).alias("probability"))


@query()
def model_text_regression(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text", F.log1p("n_chars").alias("y"))
    return M.predict_value(M.fit_text_regression(docs, "text", "y"), docs).select("doc_id", F.round("value", 4).alias("value"))


@query()
def embedding_whitening(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = M.without_mean_and_components(v, "vec_id", "v", 4)
    return out.select("vec_id", F.round(M.V.norm(F.col("v")), 4).alias("norm"))


@query()
def embedding_clusters(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return M.cluster_vectors(v, 8).select("vec_id", "cluster")


@query("SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents")
def batch_scorer(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.concat_ws(" ", T.space_tokens(F.col("text"))).alias("text"))
    return M.score_batches(docs, lambda b: b.assign(n=b["text"].str.count(" ") + (b["text"] != "").astype(int))[["doc_id", "n"]], "doc_id long, n long")
