"""Queries of text preprocessing, vocabularies and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators import labels as L
from textloom.operators import vocab as V
from textloom.operators.passages import with_offsets
from textloom.plans.common import read

QUERIES: dict = {}
SQL: dict[str, str] = {}
TOK = r"regexp_extract_all(text, '\S+')"
PUNCT_TOK = r"regexp_extract_all(lower(text), '[\p{P}$+<=>^`|~]|[^\s\p{P}$+<=>^`|~]+')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT count(*) AS n, round(avg(least(n, 256)), 6) AS avg_len, max(least(n, 256)) AS max_len, round(avg((n >= 256)::INT), 6) AS clipped FROM (SELECT len({TOK}) AS n FROM documents)")
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.size(T.space_tokens(F.col("text"))).alias("n_tokens"))
    return L.length_stats(docs, "n_tokens", 256)


@query("SELECT doc_id, coalesce(text, '') AS content, lang AS language FROM documents WHERE lang <> 'es'")
def scan_project_rename(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("lang <> 'es'").select("doc_id", F.coalesce("text", F.lit("")).alias("content"), F.col("lang").alias("language"))


@query("SELECT doc_id, (i - 1)::INT AS line, l[i] AS sentence FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), range(1, len(l) + 1) r(i) WHERE l[i] <> ''")
def explode_sentences(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "sentence"))
    return lines.where("sentence <> ''")


@query(
    "SELECT doc_id, array_to_string(t, ' ') AS normalized, len(t) AS n FROM (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(lower(text), "
    r"'[!-/:-@\[-`{-~]', '', 'g'), '\S+'), lambda x: x NOT IN ('a', 'an', 'the')) AS t FROM documents)"
)
def normalize_answer_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", T.answer_tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.array_join("t", " ").alias("normalized"), F.size("t").cast("long").alias("n"))


def token_offsets(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, token, start)`` of ``docs(doc_id, text)``: tokens with their character offsets."""
    found = with_offsets(docs.select("doc_id", "text"))
    return found.select("doc_id", F.posexplode(F.arrays_zip("tokens", "starts")).alias("pos", "x")).select("doc_id", "pos", F.col("x.tokens").alias("token"), F.col("x.starts").alias("start"))


OFFSETS = rf"""
SELECT doc_id, (i - 1)::INT AS pos, regexp_extract(p[i], '\S+') AS token,
       sum(length(p[i])) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT - length(regexp_extract(p[i], '\S+')) AS start
FROM (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS p FROM documents), range(1, len(p) + 1) r(i)"""


@query(OFFSETS)
def whitespace_tokens_offsets(spark: SparkSession, d: str) -> DataFrame:
    return token_offsets(read(spark, d, "documents"))


@query(f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, {PUNCT_TOK} AS t FROM documents)")
def punct_split_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", T.punctuation_tokens(F.lower("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("h"))


VOCAB = f"""tok AS (SELECT doc_id, unnest({PUNCT_TOK}) AS token FROM documents),
counts AS (SELECT token, count(*) AS n FROM tok GROUP BY token),
vocab AS (SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) + 4)::INT AS id FROM counts ORDER BY n DESC, token LIMIT 995)"""


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.explode(T.punctuation_tokens(F.lower("text"))).alias("token"))


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    return V.top_vocabulary(_tokens(spark, d).groupBy("token").agg(F.count("*").alias("n")), 1000)


@query(f"WITH {VOCAB} SELECT token, n, id FROM vocab")
def vocab_topn(spark: SparkSession, d: str) -> DataFrame:
    return _vocab(spark, d)


@query(f"WITH {VOCAB} SELECT doc_id, count(*) AS n, sum((v.id IS NULL)::INT)::BIGINT AS n_unknown, sum(coalesce(v.id, 1))::BIGINT AS id_sum FROM tok LEFT JOIN vocab v USING (token) GROUP BY doc_id")
def vocab_encode_unk(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", T.punctuation_tokens(F.lower("text")).alias("t")).where("size(t) > 0")
    ids = docs.select("doc_id", V.encode_rows(F.col("t"), _vocab(spark, d)).alias("ids"))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.size(F.filter("ids", lambda x: x == 1)).cast("long").alias("n_unknown"), total.alias("id_sum"))


@query(f"WITH {VOCAB} SELECT token, n, (row_number() OVER (ORDER BY token) - 1)::BIGINT AS id FROM counts WHERE n >= 3")
def trim_vocab(spark: SparkSession, d: str) -> DataFrame:
    return V.trim(_tokens(spark, d).groupBy("token").agg(F.count("*").alias("n")), 3)


@query(f"WITH {VOCAB} SELECT token, n, round(0.001::DOUBLE / (0.001::DOUBLE + n::DOUBLE / (SELECT sum(n) FROM counts)), 8) AS weight FROM counts")
def sif_weights(spark: SparkSession, d: str) -> DataFrame:
    return V.inverse_frequency_weights(_tokens(spark, d).groupBy("token").agg(F.count("*").alias("n")))


@query(
    f"SELECT doc_id, array_to_string(t, ' ') AS tokens, len(a) + 2 AS n_used FROM (SELECT doc_id, a, list_concat(['[CLS]'], a, ['[SEP]'], list_resize([]::VARCHAR[], greatest(0, 62 - len(a)), '[PAD]')) AS t "
    f"FROM (SELECT doc_id, {TOK}[1:62] AS a FROM documents))"
)
def pad_truncate_special(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.slice(T.space_tokens(F.col("text")), 1, 62).alias("a"))
    full = T.pad(T.with_specials(F.col("a"), None), 64, F.lit("[PAD]"))
    return docs.select("doc_id", F.array_join(full, " ").alias("tokens"), (F.size("a") + 2).cast("long").alias("n_used"))


@query(
    r"""WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS a,
       len(regexp_extract_all(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '\S+')) AS b FROM conversations),
    c AS (SELECT *, CASE WHEN a + b <= 32 THEN a WHEN b <= 16 THEN 32 - b WHEN a <= 16 THEN a ELSE 16 END AS ka FROM t)
    SELECT conv_id, turn, ka::INT AS first_len, least(b, CASE WHEN a + b <= 32 THEN b ELSE 32 - ka END)::INT AS second_len FROM c"""
)
def truncate_pair_longest_first(spark: SparkSession, d: str) -> DataFrame:
    follow = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    size = lambda c: F.size(T.space_tokens(F.coalesce(c, F.lit(""))))
    turns = read(spark, d, "conversations").select("conv_id", "turn", size(F.col("text")).alias("a"), size(follow).alias("b"))
    a, b = T.pair_lengths(F.col("a"), F.col("b"), 32)
    return turns.select("conv_id", "turn", a.alias("first_len"), b.alias("second_len"))


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'plain' ELSE 'labelled' END AS part, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ROLLUP (1)")
def split_counts_rollup(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "labels").select("doc_id", F.lit("labelled").alias("l"))
    docs = read(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").withColumn("part", F.coalesce("l", F.lit("plain")))
    return L.split_counts(docs, "part")


@query("SELECT label, round(((SELECT count(*) FROM labels WHERE quality IN (0, 1)) + 2)::DOUBLE / (2 * ((SELECT count(*) FROM labels WHERE quality = label) + 1)), 6) AS weight FROM (VALUES (0), (1)) v(label)")
def class_weights_balanced(spark: SparkSession, d: str) -> DataFrame:
    return L.class_weights(read(spark, d, "labels"), "quality", [0, 1])


@query("SELECT doc_id, list_position(['de', 'en', 'fr'], lang) - 1 AS label_id FROM documents WHERE lang IN ('de', 'en', 'fr')")
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", T.label_index(F.col("lang"), ["de", "en", "fr"]).alias("label_id"))
    return docs.where("label_id IS NOT NULL")  # labels that are not in the list are set aside


@query("SELECT doc_id FROM documents WHERE lang NOT IN ('de', 'en', 'fr')")
def label_quarantine(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return docs.where(T.label_index(F.col("lang"), ["de", "en", "fr"]).isNull()).select("doc_id")


@query("SELECT doc_id, [(quality = 1)::INT, (toxic = 1)::INT, (quality = 1 AND toxic = 1)::INT] AS hot FROM labels")
def multilabel_onehot(spark: SparkSession, d: str) -> DataFrame:
    names = F.concat_ws(",", F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "both"))
    return read(spark, d, "labels").select("doc_id", T.multi_hot(names, ["good", "toxic", "both"]).alias("hot"))


@query("SELECT doc_id, round((n_chars - (SELECT avg(n_chars) FROM documents)) / (SELECT stddev_pop(n_chars) FROM documents), 6) AS z, n_chars::DOUBLE AS back FROM documents")
def regression_scale_fit_apply(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    out = docs.crossJoin(F.broadcast(L.fit_scaling(docs, "n_chars"))).withColumn("z", L.scaled(F.col("n_chars")))  # one row
    return out.select("doc_id", F.round("z", 6).alias("z"), F.round(L.unscaled(F.col("z")), 3).alias("back"))


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents),
    s AS (SELECT doc_id, i, j, w[i] AS word FROM w, range(1, len(w) + 1) a(i), range(0, 1 + (length(w[i]) > 6)::INT) b(j))
    SELECT doc_id, array_to_string(list(CASE WHEN j = 0 THEN CASE WHEN regexp_matches(word, '^[A-ZÀ-Þ]') THEN 'B' ELSE 'O' END ELSE 'X' END ORDER BY i, j), ' ') AS labels FROM s GROUP BY doc_id"""
)
def expand_labels_subtokens(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", T.space_tokens(F.col("text")).alias("w"))
    labels = F.transform("w", lambda x: F.when(x.rlike("^[A-ZÀ-Þ]"), "B").otherwise("O"))
    initial = F.flatten(F.transform("w", lambda x: F.when(F.length(x) > 6, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1)))))
    docs = docs.where(F.size("w") > 0).select("doc_id", labels.alias("l"), initial.alias("m"))
    return docs.select("doc_id", F.array_join(T.expand_labels(F.col("l"), F.col("m")), " ").alias("labels"))


@query(
    r"""WITH l AS (SELECT list_transform(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\S+'))) AS l FROM documents WHERE text IS NOT NULL),
    p AS (SELECT l[1] AS q, l[2:] AS p FROM l)
    SELECT count(*) AS n, round(avg(least(q, 16)), 6) AS avg_query, max(least(q, 16))::INT AS max_query, sum(len(p))::BIGINT AS n_passages,
           round(sum(coalesce(list_sum(list_transform(p, lambda x: least(x, 16))), 0)) / sum(len(p)), 6) AS avg_passage, max(list_max(list_transform(p, lambda x: least(x, 16))))::INT AS max_passage FROM p"""
)
def biencoder_length_stats(spark: SparkSession, d: str) -> DataFrame:
    lengths = F.transform(F.split("text", "\n"), lambda x: F.size(T.space_tokens(x)))
    docs = read(spark, d, "documents").where("text IS NOT NULL").select(lengths.alias("l"))
    pairs = docs.select(F.get("l", F.lit(0)).alias("q"), F.slice("l", 2, F.size("l")).alias("p"))
    return L.pair_length_stats(pairs, "q", "p", 16)


@query(
    r"""SELECT doc_id, (len(a) + 2)::BIGINT AS second_at FROM (SELECT doc_id, regexp_extract_all(string_split(text, chr(10))[1], '\S+') AS a FROM documents WHERE text IS NOT NULL)"""
)
def second_sequence_start(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    a, b = T.space_tokens(F.get(lines, F.lit(0))), T.space_tokens(F.coalesce(F.get(lines, F.lit(1)), F.lit("")))
    docs = read(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", T.second_start(T.with_specials(a, b)).alias("second_at"))
