"""Queries of processors to tokens, answers and requests, early stopping, multilabel models, word and sentence vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import models
from textloom.operators import qa as Q
from textloom.plans.common import read, shared_folder
from textloom.plans.processors import processor
from textloom.sources import readers as R
from textloom.sources import writers as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# processors to tokens

WORDS = r"regexp_extract_all(text, '\S+')"


def _joined(c: str) -> Column:
    return F.md5(F.array_join(F.col(c).cast("array<string>"), " ")).alias(c)


def _padded(tokens: str, size: int, filler: str) -> str:
    return f"md5(array_to_string(list_concat({tokens}, list_transform(range(0, {size} - len({tokens})), lambda i: {filler})), ' '))"


@query(
    f"""WITH a AS (SELECT doc_id, lang, [lang, source] AS x, {WORDS} AS y FROM documents WHERE lang IN ('de', 'en', 'fr') AND source IS NOT NULL),
    b AS (SELECT *, CASE WHEN len(x) + len(y) <= 29 THEN len(x) WHEN len(y) <= 15 THEN greatest(0, 29 - len(y)) WHEN len(x) <= 14 THEN len(x) ELSE 14 END AS na FROM a),
    c AS (SELECT *, list_concat(['[CLS]'], x[1:na], ['[SEP]'], y[1:29 - na], ['[SEP]']) AS t, list_concat(list_transform(range(0, na + 2), lambda i: 0), list_transform(range(0, least(len(y), 29 - na) + 1), lambda i: 1)) AS s FROM b)
    SELECT doc_id, {_padded("t", 32, "'[PAD]'")} AS tokens, {_padded("list_transform(s, lambda v: v::VARCHAR)", 32, "'0'")} AS segment_ids, list_position(['de', 'en', 'fr'], lang) - 1 AS label_ids FROM c"""
)
def process_pair_classification(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("source IS NOT NULL").select("doc_id", F.concat_ws(" ", "lang", "source").alias("text"), F.col("text").alias("text_b"), F.col("lang").alias("label"))
    out = processor("pair_classification", labels=["de", "en", "fr"], size=32)(docs)
    return out.select("doc_id", _joined("tokens"), _joined("segment_ids"), "label_ids")


@query(
    f"""WITH a AS (SELECT doc_id, n_chars, list_concat(['[CLS]'], {WORDS}[1:14], ['[SEP]']) AS t FROM documents)
    SELECT doc_id, {_padded("t", 16, "'[PAD]'")} AS tokens, len(t)::BIGINT AS n_mask, round((n_chars - 1000) / 250.0::DOUBLE, 6) AS regression_label FROM a"""
)
def process_regression(spark: SparkSession, d: str) -> DataFrame:
    out = processor("regression", mean=1000.0, scale=250.0, label="n_chars", size=16)(read(spark, d, "documents"))
    return out.select("doc_id", _joined("tokens"), F.size(F.array_remove("padding_mask", 0)).cast("long").alias("n_mask"), F.round("regression_label", 6).alias("regression_label"))


@query(
    f"""WITH a AS (SELECT doc_id, list_concat(['[CLS]'], {WORDS}[1:22], ['[SEP]']) AS t FROM documents)
    SELECT doc_id, {_padded("t", 24, "'[PAD]'")} AS tokens, len(t)::BIGINT AS n_mask FROM a"""
)
def process_inference(spark: SparkSession, d: str) -> DataFrame:
    out = processor("inference", size=24)(read(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", _joined("tokens"), F.size(F.array_remove("padding_mask", 0)).cast("long").alias("n_mask"))


# answers and requests


@query(
    """SELECT conv_id AS doc, turn AS passage, CASE WHEN conv_id % 4 = 0 THEN 'no_answer' WHEN turn % 3 = 0 THEN 'yes' WHEN turn % 3 = 1 THEN 'span' ELSE 'no' END AS answer_type,
    md5(CASE WHEN conv_id % 4 = 0 OR turn % 3 = 1 THEN text WHEN turn % 3 = 0 THEN 'yes' ELSE 'no' END) AS answer FROM conversations"""
)
def answers_with_passage_class(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations")
    spans = turns.select(F.col("conv_id").alias("doc"), F.col("turn").alias("passage"), F.col("text").alias("answer"))
    kind = F.when(F.col("turn") % 3 == 0, "yes").when(F.col("turn") % 3 == 1, "span").otherwise("no")
    types = turns.where("conv_id % 4 <> 0").select(F.col("conv_id").alias("doc"), F.col("turn").alias("passage"), kind.alias("answer_type"))
    return Q.with_answer_type(spans, types).select("doc", "passage", "answer_type", F.md5("answer").alias("answer"))


@query("SELECT item_id, 'q' || item_id AS query, p.passage AS passage, p.label FROM benchmark, LATERAL (SELECT md5(text) AS passage, 1::INT AS label UNION ALL SELECT md5('not ' || item_id), 0::INT) p")
def triples_to_pairs(spark: SparkSession, d: str) -> DataFrame:
    item = F.col("item_id")
    triples = read(spark, d, "benchmark").select(F.concat(F.lit("q"), item).alias("query"), F.col("text").alias("positive"), F.concat(F.lit("not "), item).alias("negative"))
    pairs = W.labelled_pairs(triples)
    return pairs.select(F.expr("bigint(substring(query, 2))").alias("item_id"), "query", F.md5("passage").alias("passage"), "label")


@query("SELECT vec_id, round(CASE WHEN label % 2 = 1 THEN (vec_id % 97) / 97.0::DOUBLE ELSE 1 - (vec_id % 97) / 97.0::DOUBLE END, 6) AS score FROM embeddings")
def relevance_probabilities(spark: SparkSession, d: str) -> DataFrame:
    predictions = read(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).cast("string").alias("label"), ((F.col("vec_id") % 97) / 97.0).alias("probability"))
    return W.relevance_scores(predictions).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id // 100 AS part, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def parts_by_number(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "files")
    W.write_parts(read(spark, d, "documents").select("doc_id", "n_chars", "lang"), path, "doc_id", 100)
    return spark.read.schema("doc_id long, n_chars long, lang string, part long").json(path).groupBy("part").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    """SELECT conv_id::VARCHAR AS id, count(*) AS n, md5(arg_min(text, turn)) AS first_answer, max(turn)::BIGINT AS last_rank FROM conversations GROUP BY conv_id"""
)
def answers_as_json(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    ranked = read(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("id"), F.lit("which").alias("question"), turn.alias("rank"), F.col("text").alias("answer"), (turn / 10).alias("score"), turn.alias("start"), (turn + 5).alias("end")
    )
    path = shared_folder(spark, "files")
    W.answers_json(ranked).write.text(path)
    found = R.read_jsonl(spark, path, "task string, id string, question string, answers array<struct<rank: long, answer: string, score: double, offset_answer_start: long, offset_answer_end: long>>")
    return found.select("id", F.size("answers").cast("long").alias("n"), F.md5(F.col("answers")[0]["answer"]).alias("first_answer"), F.element_at("answers", -1)["rank"].alias("last_rank"))


@query("SELECT item_id, n::INT AS question_no, 'Is ' || item_id || ' ' || n || '?' AS question, md5(text) AS context FROM benchmark, range(2) r(n)")
def normalised_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests in two shapes, by the parity of the item."""
    item = F.col("item_id")
    ask = lambda n: F.concat(F.lit("Is "), item, F.lit(f" {n}?"))
    odd = item % 2 == 1
    qas = F.when(odd, F.array(*[F.struct(ask(n).alias("question")) for n in range(2)]))
    requests = read(spark, d, "benchmark").select(
        F.when(odd, F.col("text")).alias("context"), qas.alias("qas"), F.when(~odd, F.col("text")).alias("text"), F.when(~odd, F.array(ask(0), ask(1))).alias("questions")
    )
    out = R.normalize_qa(requests)
    return out.select(F.regexp_extract("question", r"Is (\d+)", 1).cast("long").alias("item_id"), "question_no", "question", F.md5("context").alias("context"))


# early stopping


@query(
    """WITH s AS (SELECT doc_id % 50 AS step, round(sum((doc_id * 7919) % 1000)::DOUBLE / count(*), 6) AS score FROM labels GROUP BY ALL),
    w AS (SELECT *, max(score) OVER (ORDER BY step) AS best, max(score) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (ORDER BY step) AS r FROM s),
    g AS (SELECT *, max(CASE WHEN before IS NULL OR score > before THEN r END) OVER (ORDER BY step) AS last FROM w)
    SELECT step, score, best, r - last >= 5 AS stop FROM g"""
)
def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    """Fifty evaluations, of which a table of labels gives the scores."""
    score = F.round(F.sum((F.col("doc_id") * 7919) % 1000) / F.count("*"), 6)
    scores = read(spark, d, "labels").groupBy((F.col("doc_id") % 50).alias("step")).agg(score.alias("score"))
    return models.stop_early(scores, "step", "score", 5)


# several labels, word and sentence vectors


@query()
def model_multilabel(spark: SparkSession, d: str) -> DataFrame:
    """How many documents a model of two labels gives each list of labels, against the given ones."""
    labels = read(spark, d, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    docs = read(spark, d, "documents").select("doc_id", "text").join(labels, "doc_id")
    fitted = models.fit_multilabel(docs, "text", ["quality", "toxic"])
    out = models.classify_multilabel(fitted, docs)
    given = F.array_compact(F.array(*[F.when(F.col(c) == 1, c) for c in ("quality", "toxic")]))
    return out.groupBy(F.array_join("labels", ",").alias("labels"), F.array_join(given, ",").alias("given")).agg(F.count("*").alias("n"))


def _token_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The words of benchmark items as tokens by their length, and embeddings as the lengths' vectors."""
    tokens = read(spark, d, "benchmark").select("item_id", F.explode(T.space_tokens(F.col("text"))).alias("w")).select("item_id", F.concat(F.lit("w"), F.length("w")).alias("token"))
    vectors = read(spark, d, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), V.doubles(F.col("embedding")).alias("v"))
    return tokens, vectors


POOL = r"""WITH t AS (SELECT item_id, length(w) AS l FROM (SELECT item_id, unnest(regexp_extract_all(text, '\S+')) AS w FROM benchmark)),
    v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"""


@query(f"{POOL} SELECT item_id, round(avg(list_sum(v)), 4) AS total, round(avg(v[1]), 5) AS first, round(avg(v[64]), 5) AS last FROM t JOIN v ON l = vec_id GROUP BY item_id")
def mean_token_vectors(spark: SparkSession, d: str) -> DataFrame:
    tokens, vectors = _token_vectors(spark, d)
    out = models.pooled_vectors(tokens, vectors.withColumnRenamed("word", "token"), "item_id", 64)
    return out.select("item_id", F.round(V.total(F.col("v")), 4).alias("total"), F.round(F.col("v")[0], 5).alias("first"), F.round(F.col("v")[63], 5).alias("last"))


@query(f"{POOL}, w AS (SELECT DISTINCT l FROM t) SELECT 'w' || l AS token, (l * 3)::INT AS id, v IS NOT NULL AS known, round(coalesce(list_sum(v), 0), 4) AS total FROM w LEFT JOIN v ON l = vec_id")
def vectors_of_a_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    tokens, vectors = _token_vectors(spark, d)
    vocabulary = tokens.select("token").distinct().withColumn("id", F.expr("int(substring(token, 2)) * 3"))
    out = R.vectors_for(vocabulary, vectors, 64)
    return out.select("token", "id", F.exists("v", lambda x: x != 0).alias("known"), F.round(V.total(F.col("v")), 4).alias("total"))


@query()
def sentence_vectors_by_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Sentence vectors of benchmark items from weighted token vectors and the covariance of their cluster sums."""
    tokens, vectors = _token_vectors(spark, d)
    clustered = models.cluster_vectors(vectors.withColumnRenamed("word", "token"), 3).withColumn("weight", F.lit(0.5))
    centroids = clustered.groupBy("cluster").agg(*V.mean_of("v", 64)).select("cluster", F.array(*[f"d{i}" for i in range(64)]).alias("centroid"))
    out = models.cluster_pooling(tokens, clustered.select("token", "v", "cluster", "weight"), centroids, "item_id", 64, 3)
    return out.select("item_id", F.size("v").alias("size"), F.round(V.norm(F.slice("v", 65, 100)), 4).alias("norm"))
