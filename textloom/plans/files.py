"""Queries that write a table as task files and read them back through the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import metrics as M
from textloom.operators import pairs as PR
from textloom.operators import passages as PS
from textloom.plans.common import read, shared_folder
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


def _folder(spark: SparkSession) -> str:
    return shared_folder(spark, "files")


def _write(lines: DataFrame, path: str) -> str:
    """One column of strings, a line (or several) each."""
    lines.write.text(path)
    return path


def _digest(words: Column, sep: str = " ") -> Column:
    return F.md5(F.array_join(words, sep))


# delimited text, JSON lines


@query("SELECT doc_id, lang AS language, coalesce(source, '') AS origin FROM documents")
def file_table(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    W.write_tsv(read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), path)
    out = R.read_table(spark, path, ["doc_id", "lang", "source"], {"lang": "language", "source": "origin"}, quote='"')
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


@query("SELECT lang AS text, source AS text_b, quality::VARCHAR AS label FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL AND source IS NOT NULL")
def file_pairs(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").where("lang IS NOT NULL AND source IS NOT NULL")
    W.write_tsv(rows.select(F.col("lang").alias("text"), F.col("source").alias("text_b"), F.col("quality").alias("label")), path)
    return R.read_pairs(spark, path, "label")


@query("SELECT item_id, md5(text) AS text FROM benchmark")
def file_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    read(spark, d, "benchmark").write.json(path)
    return R.read_jsonl(spark, path, "item_id long, text string").select("item_id", F.md5("text").alias("text"))


# files in groups of lines


@query(
    r"""SELECT md5(array_to_string(w, ' ')) AS tokens, md5(array_to_string(list_transform(w, lambda x: 'T' || length(x) % 3), ' ')) AS tags, count(*) AS n
    FROM (SELECT list_filter(regexp_extract_all(text, '\S+'), lambda x: x NOT LIKE '#%') AS w FROM conversations) WHERE len(w) > 0 GROUP BY w"""
)
def file_tagged(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(T.space_tokens(F.col("text")), lambda w: ~w.startswith("#"))
    lines = F.transform(words, lambda w: F.concat(w, F.lit(" T"), F.length(w) % 3))
    turns = read(spark, d, "conversations").select(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value"))
    found = R.read_tagged(spark, _write(turns, _folder(spark)))
    return found.groupBy(_digest(F.col("tokens")).alias("tokens"), _digest(F.col("tags")).alias("tags")).agg(F.count("*").alias("n"))


@query(
    r"""SELECT md5(array_to_string(s, chr(10))) AS sentences, len(s)::INT AS n_sentences, count(*) AS n
    FROM (SELECT list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) WHERE len(s) > 0 GROUP BY s"""
)
def file_documents(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    docs = read(spark, d, "documents").select(F.concat(F.array_join(kept, "\n"), F.lit("\n")).alias("value"))
    found = R.read_documents(spark, _write(docs, _folder(spark)))
    return found.groupBy(_digest(F.col("sentences"), "\n").alias("sentences"), F.size("sentences").alias("n_sentences")).agg(F.count("*").alias("n"))


@query(
    r"""SELECT (sum(n) - count(*))::BIGINT AS samples, count(*) AS docs
    FROM (SELECT len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents) WHERE n > 0"""
)
def file_sample_estimate(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    docs = read(spark, d, "documents").select(F.array_join(kept, "\n").alias("value")).where("value <> ''")
    path = _write(docs.select(F.concat("value", F.lit("\n")).alias("value")), _folder(spark))
    return PR.estimated_pairs(spark.read.text(path), closed=True)


# questions and retrieval


@query("SELECT item_id::VARCHAR AS id, 'Which of ' || item_id || '?' AS question, md5(text) AS context, item_id % 3 = 0 AS is_impossible, substr(text, 1, 12) AS answer FROM benchmark")
def file_questions(spark: SparkSession, d: str) -> DataFrame:
    item = F.col("item_id")
    answer = F.struct(F.substring("text", 1, 12).alias("text"), F.lit(0).alias("answer_start"))
    qa = F.struct(item.cast("string").alias("id"), F.concat(F.lit("Which of "), item, F.lit("?")).alias("question"), (item % 3 == 0).alias("is_impossible"), F.array(answer).alias("answers"))
    paragraph = F.struct(F.col("text").alias("context"), F.array(qa).alias("qas"))
    files = read(spark, d, "benchmark").groupBy(F.expr("item_id div 10").alias("part")).agg(F.collect_list(paragraph).alias("paragraphs"))  # ten items a file
    files = files.select("part", F.to_json(F.struct(F.array(F.struct(F.col("part").cast("string").alias("title"), "paragraphs")).alias("data"))).alias("value"))
    path = _folder(spark)
    files.write.partitionBy("part").text(path)
    return R.read_qa(spark, path).select("id", "question", F.md5("context").alias("context"), "is_impossible", F.col("answers")[0]["text"].alias("answer"))


@query(
    """SELECT item_id, 'What is ' || item_id AS query, md5(text) AS positive, md5(coalesce(lead(text) OVER (ORDER BY item_id), '')) AS negative, lead(text) OVER (ORDER BY item_id) IS NOT NULL AS has_negative FROM benchmark"""
)
def file_retrieval(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "benchmark").select("item_id", "text")
    following = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id", "left")
    passage = lambda c, n: F.struct(F.lit("").alias("title"), F.col(c).alias("text"), F.concat(F.col("item_id"), F.lit(n)).alias("passage_id"))
    none = F.array().cast("array<struct<title: string, text: string, passage_id: string>>")
    records = following.select(
        F.concat(F.lit("What is "), "item_id", F.lit("?")).alias("question"), F.array(passage("text", "p")).alias("positive_contexts"),
        F.when(F.col("other").isNotNull(), F.array(passage("other", "n"))).otherwise(none).alias("hard_negative_ctxs"),
    )
    path = _folder(spark)
    records.write.json(path)
    found = R.read_retrieval(spark, path)
    text = lambda label: F.get(F.transform(F.filter("passages", lambda p: p["label"] == label), lambda p: p["text"]), F.lit(0))
    return found.select(
        F.regexp_extract("query", r"(\d+)$", 1).cast("long").alias("item_id"), "query", F.md5(text("positive")).alias("positive"),
        F.md5(F.coalesce(text("hard_negative"), F.lit(""))).alias("negative"), text("hard_negative").isNotNull().alias("has_negative"),
    )


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)
    SELECT 'e' || doc_id AS example_id, 'who ' || doc_id AS question, len(w)::INT AS n_words, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE -1 END::INT AS long_start, (doc_id % 4)::INT AS n_short, CASE WHEN doc_id % 5 = 0 THEN 'yes' ELSE 'none' END AS yes_no FROM w"""
)
def file_natural_questions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    short = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(i.alias("start_token"), (i + 1).alias("end_token")))
    span = F.struct(F.when(k % 2 == 0, 3).otherwise(-1).alias("start_token"), F.when(k % 2 == 0, 9).otherwise(-1).alias("end_token"), F.lit(0).alias("candidate_index"))
    one = F.struct(F.when(k % 5 == 0, "YES").otherwise("NONE").alias("yes_no_answer"), span.alias("long_answer"), F.slice(short, F.lit(1), (k % 4).cast("int")).alias("short_answers"))
    words = T.space_tokens(F.col("text"))
    records = read(spark, d, "documents").select(F.concat(F.lit("e"), k).alias("example_id"), F.concat(F.lit("who "), k).alias("question_text"), F.array_join(words, " ").alias("document_text"), F.array(one).alias("annotations"))
    path = _folder(spark)
    records.write.json(path)
    found = R.read_natural_questions(spark, path)
    return found.select("example_id", "question", F.size("words").alias("n_words"), "long_start", F.size("short").alias("n_short"), "yes_no")


@query("SELECT qid, pid, rank FROM (SELECT label AS qid, vec_id AS pid, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 37) % 101 DESC, vec_id)::INT AS rank FROM embeddings) WHERE rank <= 10")
def file_run(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    W.write_run(read(spark, d, "embeddings").select(F.col("label").alias("qid"), F.col("vec_id").alias("pid"), ((F.col("vec_id") * 37) % 101).alias("score")), path)
    return R.read_triples(spark, path, "qid int, pid long, rank int")


# vectors, vocabularies, files side by side


@query("SELECT 'w' || vec_id AS word, len(embedding)::INT AS size, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def file_vectors(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    W.write_vectors(read(spark, d, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("v")), path)
    return R.read_vectors(spark, path, 64).select("word", F.size("v").alias("size"), F.round(V.total(F.col("v")), 4).alias("total"))


@query("SELECT 't' || lpad(item_id::VARCHAR, 6, '0') AS token, (row_number() OVER (ORDER BY item_id) - 1)::BIGINT AS id FROM benchmark")
def file_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    tokens = read(spark, d, "benchmark").select(F.concat(F.lit("t"), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("value"))
    path = _folder(spark)
    tokens.orderBy("value").coalesce(1).write.text(path)
    return R.read_vocabulary(spark, path)


@query("SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS n, 'd' || doc_id AS \"left\", CASE WHEN doc_id < (SELECT max(doc_id) FROM labels) AND doc_id IN (SELECT doc_id FROM labels) THEN 'known' ELSE 'new' END AS \"right\" FROM documents")
def file_zip(spark: SparkSession, d: str) -> DataFrame:
    """Two folders of files whose lines belong together by their places, whatever the files they are in."""
    labels = read(spark, d, "labels").select("doc_id", F.lit("known").alias("mark")).dropDuplicates(["doc_id"])
    last = labels.agg(F.max("doc_id").alias("last"))
    docs = read(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").join(F.broadcast(last))  # one row
    left, right = _folder(spark), _folder(spark)
    docs.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").select(F.concat(F.lit("d"), "doc_id").alias("value")).write.text(left)
    marks = docs.repartitionByRange(2, "doc_id").sortWithinPartitions("doc_id")
    marks.select(F.when(F.col("mark").isNotNull() & (F.col("doc_id") < F.col("last")), "known").otherwise("new").alias("value")).write.text(right)
    return R.zip_files(spark, left, right)


# arrays of tokens and vectors


@query(
    """SELECT vec_id, round(list_avg(list_transform([1, 2, 3], lambda i: v[i])), 5) AS mean_first, round(list_max(list_transform([1, 2, 3], lambda i: v[i])), 5) AS top_first, round(v[1], 5) AS cls_first, round(v[4], 5) AS turned
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"""
)
def vector_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Three stand-in tokens of one text, whose vectors are pieces of an embedding, and a padded one."""
    v = F.col("embedding").cast("array<double>")
    of = lambda i: F.array(F.get(v, F.lit(i)), F.get(v, F.lit(i + 3)))
    rows = read(spark, d, "embeddings").select("vec_id", F.array(of(0), of(1), of(2), of(9)).alias("tokens"), F.array(*map(F.lit, (1, 1, 1, 0))).alias("mask"))
    pick = lambda s: F.round(F.get(V.extracted(F.col("tokens"), s, F.col("mask")), F.lit(0)), 5)
    turned = F.get(F.get(T.transposed(V.extracted(F.col("tokens"), "per_token", F.col("mask"))), F.lit(1)), F.lit(0))
    return rows.select("vec_id", pick("reduce_mean").alias("mean_first"), pick("reduce_max").alias("top_first"), pick("cls_token").alias("cls_first"), F.round(turned, 5).alias("turned"))


@query(
    """SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: v[i] * ((i - 1) % 3 - 1))) + 1, 4) AS y0, round(list_sum(list_transform(range(1, 65), lambda i: v[i] * ((i - 1) % 5))) - 2, 4) AS y1, round(list_max(e) / list_sum(e), 6) AS top_share
    FROM (SELECT vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))"""
)
def linear_and_softmax(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    y = V.linear(v, [[i % 3 - 1 for i in range(64)], [i % 5 for i in range(64)]], [1.0, -2.0])
    rows = read(spark, d, "embeddings").select("vec_id", y.alias("y"), V.softmax(v).alias("p"))
    return rows.select("vec_id", F.round(F.col("y")[0], 4).alias("y0"), F.round(F.col("y")[1], 4).alias("y1"), F.round(F.array_max("p"), 6).alias("top_share"))


@query(
    r"""WITH s AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')), lambda x: regexp_extract_all(x, '\s*\S+')) AS s FROM documents),
    o AS (SELECT doc_id, i, s[i] AS p FROM s, range(1, len(s) + 1) r(i)),
    f AS (SELECT doc_id, i, len(p) AS n, list_sum(list_transform(p, lambda x: length(x))) - length(regexp_extract(p[len(p)], '\S+')) AS last, length(p[1]) - length(regexp_extract(p[1], '\S+')) AS first FROM o),
    g AS (SELECT *, coalesce(sum(last + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM f)
    SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_tokens, coalesce(arg_max(shift + last, i), -1)::BIGINT AS last_offset FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id"""
)
def joined_sentences(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))
    docs = read(spark, d, "documents").select("doc_id", T.joined_sentences(PS.sentence_tokens(lines)).alias("j"))
    return docs.select("doc_id", F.size("j.tokens").cast("long").alias("n_tokens"), F.coalesce(F.try_element_at("j.offsets", F.lit(-1)), F.lit(-1)).cast("long").alias("last_offset"))


@query("SELECT round(avg(hit), 6) AS top_n_accuracy FROM (SELECT conv_id, max((turn < 3 AND turn % 4 = 2)::INT) AS hit FROM conversations GROUP BY conv_id)")
def top_n_accuracy_ranked(spark: SparkSession, d: str) -> DataFrame:
    scored = read(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("rank"), F.when(F.col("turn") % 4 == 2, 0.5).otherwise(0.0).alias("f1"))
    return M.top_n_accuracy(scored, "conv_id", "f1", "rank", 3)
