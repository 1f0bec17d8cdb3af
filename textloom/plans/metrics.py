"""Queries of metrics, tags, ranking, vectors and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import metrics as M
from textloom.operators import models, validation
from textloom.operators import qa as Q
from textloom.operators import ranking as R
from textloom.operators import tags as G
from textloom.plans.common import read
from textloom.plans.splits import find_passages
from textloom.sources.writers import top_answers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# predictions by rule, so that both engines have the same
PREDS = "p AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS pred, quality AS label FROM labels)"
MULTI = "p AS (SELECT doc_id, (quality + 2 * toxic + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) % 4 AS pred, quality + 2 * toxic AS label FROM labels)"
NUMERIC = "p AS (SELECT length(regexp_replace(text, '[^e]', '', 'g'))::DOUBLE AS pred, n_chars::DOUBLE AS label FROM documents)"


def _preds(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("quality")
    return read(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 5 == 0, 1 - q).otherwise(q).alias("pred"), q.alias("label"))


def _multi(spark: SparkSession, d: str) -> DataFrame:
    label = F.col("quality") + 2 * F.col("toxic")
    return read(spark, d, "labels").select(((label + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)) % 4).alias("pred"), label.alias("label"))


def _numeric(spark: SparkSession, d: str) -> DataFrame:
    e = F.length(F.regexp_replace("text", "[^e]", ""))
    return read(spark, d, "documents").select(e.cast("double").alias("pred"), F.col("n_chars").cast("double").alias("label"))


@query(f"WITH {PREDS} SELECT round(avg((pred = label)::INT), 6) AS acc FROM p")
def metric_acc(spark: SparkSession, d: str) -> DataFrame:
    return M.compute_metrics("acc", _preds(spark, d))


@query(
    f"""WITH {PREDS}, s AS (SELECT avg((pred = label)::INT) AS acc, 2.0::DOUBLE * sum((pred = 1 AND label = 1)::INT) / (sum((pred = 1)::INT) + sum((label = 1)::INT)) AS f1 FROM p)
    SELECT round(acc, 6) AS acc, round(f1, 6) AS f1, round((acc + f1) / 2, 6) AS acc_and_f1 FROM s"""
)
def metric_acc_f1(spark: SparkSession, d: str) -> DataFrame:
    return M.compute_metrics("acc_f1", _preds(spark, d))


REPORT = f"""WITH {MULTI}, k AS (SELECT pred AS cls FROM p UNION SELECT label FROM p),
r AS (SELECT cls, (SELECT count(*) FROM p WHERE pred = cls) AS np, (SELECT count(*) FROM p WHERE label = cls) AS ny, (SELECT count(*) FROM p WHERE pred = cls AND label = cls) AS tp FROM k),
c AS (SELECT cls, CASE WHEN np > 0 THEN round(tp::DOUBLE / np, 6) ELSE 0 END AS precision, CASE WHEN ny > 0 THEN round(tp::DOUBLE / ny, 6) ELSE 0 END AS recall, round(2.0::DOUBLE * tp / (np + ny), 6) AS f1, ny AS support FROM r)"""


@query(f"{REPORT} SELECT * FROM c")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return M.class_report(_multi(spark, d))


@query(f"{REPORT} SELECT round(avg(f1), 5) AS f1_macro FROM c")
def metric_f1_macro(spark: SparkSession, d: str) -> DataFrame:
    return M.compute_metrics("f1_macro", _multi(spark, d))


@query(
    f"""WITH {MULTI}, k AS (SELECT pred AS cls FROM p UNION SELECT label FROM p),
    r AS (SELECT (SELECT count(*) FROM p WHERE pred = cls)::DOUBLE AS np, (SELECT count(*) FROM p WHERE label = cls)::DOUBLE AS ny, (SELECT count(*) FROM p WHERE pred = cls AND label = cls)::DOUBLE AS tp FROM k)
    SELECT round((sum(tp) * sum(ny) - sum(np * ny)) / sqrt((sum(ny) ** 2 - sum(np ** 2)) * (sum(ny) ** 2 - sum(ny ** 2))), 6) AS mcc FROM r"""
)
def metric_mcc(spark: SparkSession, d: str) -> DataFrame:
    return M.compute_metrics("mcc", _multi(spark, d))


@query(
    f"""WITH {NUMERIC}, r AS (SELECT pred, label, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0::DOUBLE AS rp, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2.0::DOUBLE AS ry FROM p)
    SELECT round(corr(pred, label), 6) AS pearson, round(corr(rp, ry), 6) AS spearman, round((corr(pred, label) + corr(rp, ry)) / 2, 6) AS corr FROM r"""
)
def metric_pearson_spearman(spark: SparkSession, d: str) -> DataFrame:
    return M.compute_metrics("pear_spear", _numeric(spark, d))


@query(f"WITH {NUMERIC} SELECT round(avg((pred - label) ** 2), 4) AS mse, round(1 - sum((pred - label) ** 2) / (var_pop(label) * count(*)), 6) AS r2 FROM p")
def metric_mse_r2(spark: SparkSession, d: str) -> DataFrame:
    return M.compute_metrics(["mse", "r2"], _numeric(spark, d))


def share_of_late(df: DataFrame) -> DataFrame:
    """A user's metric: the share of wrong rows among even ids."""
    return df.where("doc_id % 2 = 0").agg(F.round(F.avg((F.col("pred") != F.col("label")).cast("int")), 6).alias("wrong_even"))


@query(f"WITH {PREDS} SELECT round(avg((pred <> label)::INT), 6) AS wrong_even FROM p WHERE doc_id % 2 = 0")
def udf_custom_metric(spark: SparkSession, d: str) -> DataFrame:
    M.register_metric("wrong_even", share_of_late)
    return M.compute_metrics("wrong_even", _preds(spark, d))


# tags by rule from the words of conversations
TAGS = r"""t AS (SELECT conv_id * 1000 + turn AS seq, i::INT AS pos, CASE WHEN length(w[i]) % 4 = 0 THEN 'O' WHEN length(w[i]) % 4 = 1 THEN 'I-PER' WHEN length(w[i]) % 4 = 2 THEN 'I-LOC' ELSE CASE WHEN i % 2 = 0 THEN 'I-PER' ELSE 'I-LOC' END END AS tag
  FROM (SELECT conv_id, turn, regexp_extract_all(text, '\S+') AS w FROM conversations), range(1, len(w) + 1) r(i)),
b AS (SELECT seq, pos, CASE WHEN tag <> 'O' AND (lag(tag) OVER (PARTITION BY seq ORDER BY pos) IS NULL OR lag(tag) OVER (PARTITION BY seq ORDER BY pos) <> tag) THEN 'B-' || substr(tag, 3) ELSE tag END AS tag FROM t)"""
ENTITIES = """e AS (SELECT seq, substr(any_value(tag), 3) AS kind, min(pos) AS start, max(pos) AS "end" FROM (
  SELECT seq, pos, tag, sum((tag LIKE 'B-%' OR tag = 'O')::INT) OVER (PARTITION BY seq ORDER BY pos) AS run FROM b) WHERE tag <> 'O' GROUP BY seq, run)"""


def _tags(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.posexplode(T.space_tokens(F.col("text"))).alias("p", "w"))
    n, pos = F.length("w") % 4, F.col("p") + 1
    tag = F.when(n == 0, "O").when(n == 1, "I-PER").when(n == 2, "I-LOC").otherwise(F.when(pos % 2 == 0, "I-PER").otherwise("I-LOC"))
    return words.select("seq", pos.alias("pos"), tag.alias("tag"))


@query(f"WITH {TAGS} SELECT * FROM b")
def iob1_to_iob2(spark: SparkSession, d: str) -> DataFrame:
    return G.iob1_to_iob2(_tags(spark, d), "seq", "pos")


@query(f"WITH {TAGS}, {ENTITIES} SELECT * FROM e")
def iob_entity_merge(spark: SparkSession, d: str) -> DataFrame:
    return G.entities(G.iob1_to_iob2(_tags(spark, d), "seq", "pos"), "seq", "pos")


@query(
    f"""WITH {TAGS}, {ENTITIES}, g AS (SELECT seq, CASE WHEN start % 9 = 0 THEN 'ORG' ELSE kind END AS kind, start, "end" FROM e WHERE start % 11 <> 0),
    s AS (SELECT (SELECT count(*) FROM e JOIN g USING (seq, kind, start, "end"))::DOUBLE AS tp, (SELECT count(*) FROM e) AS np, (SELECT count(*) FROM g) AS ng)
    SELECT round(tp / np, 6) AS precision, round(tp / ng, 6) AS recall, round(2 * tp / (np + ng), 6) AS f1 FROM s"""
)
def entity_f1(spark: SparkSession, d: str) -> DataFrame:
    e = G.entities(G.iob1_to_iob2(_tags(spark, d), "seq", "pos"), "seq", "pos")
    gold = e.where("start % 11 <> 0").withColumn("kind", F.when(F.col("start") % 9 == 0, "ORG").otherwise(F.col("kind")))
    return G.entity_f1(e, gold, "seq")


@query(r"SELECT doc_id, (sum((length(w) > 6)::INT) + count(*))::BIGINT AS tokens, count(*) AS initial FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS w FROM documents) GROUP BY doc_id")
def start_of_word_flags(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "documents").select("doc_id", F.posexplode(T.space_tokens(F.col("text"))).alias("word", "w"))
    parts = words.select("doc_id", "word", F.explode(F.sequence(F.lit(0), (F.length("w") > 6).cast("int"))).alias("part"))
    flags = G.word_starts(parts.withColumn("pos", F.col("word") * 2 + F.col("part")), "doc_id", "pos", "word")
    return flags.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum("initial").cast("long").alias("initial"))


# spans by rule
SPANS = """q AS (SELECT doc_id AS qid, (doc_id % 40)::INT AS gs, (doc_id % 40 + doc_id % 7)::INT AS ge, CASE WHEN doc_id % 3 = 0 THEN doc_id % 40 ELSE doc_id % 40 + 2 END::INT AS ps FROM labels),
s AS (SELECT qid, CASE WHEN qid % 4 = 0 THEN -1 ELSE gs + 1 END AS g_start, CASE WHEN qid % 4 = 0 THEN -1 ELSE ge + 1 END AS g_end, CASE WHEN qid % 8 = 0 THEN -1 ELSE ps + 1 END AS p_start, CASE WHEN qid % 8 = 0 THEN -1 ELSE ps + 3 END AS p_end FROM q),
f AS (SELECT qid, (p_start = g_start AND p_end = g_end)::INT AS em, (p_start = g_start)::INT AS em_start, CASE WHEN p_start + p_end <= 0 OR g_start + g_end <= 0 THEN (p_start = g_start AND p_end = g_end)::INT::DOUBLE
  ELSE 2.0::DOUBLE * greatest(0, least(p_end, g_end) - greatest(p_start, g_start) + 1) / (p_end - p_start + g_end - g_start + 2) END AS f1, (g_start >= 0)::INT AS has_answer FROM s)"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("doc_id")
    df = read(spark, d, "labels").select(q.alias("qid"), (q % 40).alias("gs"), (q % 40 + q % 7).alias("ge"), F.when(q % 3 == 0, q % 40).otherwise(q % 40 + 2).alias("ps"))
    none = lambda m, c: F.when(F.col("qid") % m == 0, -1).otherwise(c)
    df = df.select("qid", none(4, F.col("gs") + 1).alias("g_start"), none(4, F.col("ge") + 1).alias("g_end"), none(8, F.col("ps") + 1).alias("p_start"), none(8, F.col("ps") + 3).alias("p_end"))
    return M.span_scores(df)


@query(f"WITH {SPANS} SELECT qid, em, em_start, round(f1, 6) AS f1 FROM f")
def squad_em_f1(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("qid", "em", "em_start", F.round("f1", 6).alias("f1"))


@query(f"WITH {SPANS} SELECT has_answer, count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1 FROM f GROUP BY GROUPING SETS ((), (has_answer))")
def squad_breakdown_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return M.span_breakdown(_spans(spark, d))


@query(f"WITH {SPANS} SELECT round(avg((f1 > 0)::INT), 6) AS top_n_accuracy FROM f")
def top_n_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return M.top_n_accuracy(_spans(spark, d), "qid", "f1")


NORM = r"list_filter(regexp_extract_all(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\S+'), lambda x: x NOT IN ('a', 'an', 'the'))"


@query(
    f"""WITH c AS (SELECT conv_id, turn, {NORM.format('text')} AS g, {NORM.format("coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS p FROM conversations),
    k AS (SELECT *, list_sum([least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))) FOR t IN list_distinct(list_intersect(p, g))]) AS c FROM c)
    SELECT conv_id, turn, (p = g)::INT AS em, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN (len(p) = len(g))::INT::DOUBLE ELSE 2.0::DOUBLE * coalesce(c, 0) / (len(p) + len(g)) END, 6) AS f1 FROM k"""
)
def token_overlap_f1(spark: SparkSession, d: str) -> DataFrame:
    follow = F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    df = read(spark, d, "conversations").select("conv_id", "turn", T.answer_tokens(F.col("text")).alias("gold"), T.answer_tokens(follow).alias("pred"))
    return M.token_overlap(df).select("conv_id", "turn", "em", F.round("f1", 6).alias("f1"))


SCORED = "x AS (SELECT doc_id, ((doc_id * 7919) % 1000) / 1000.0::DOUBLE AS na, CASE WHEN quality = 1 AND doc_id % 3 > 0 THEN 1.0 WHEN quality = 0 THEN 0 ELSE 0.25 END::DOUBLE AS score, quality AS has_answer FROM labels)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    score = F.when((F.col("quality") == 1) & (F.col("doc_id") % 3 > 0), 1.0).when(F.col("quality") == 0, 0.0).otherwise(0.25)
    return read(spark, d, "labels").select("doc_id", (((F.col("doc_id") * 7919) % 1000) / 1000.0).alias("na"), score.alias("score"), F.col("quality").alias("has_answer"))


@query(
    f"""WITH {SCORED}, p AS (SELECT na, sum(has_answer) AS h, count(*) AS c FROM x GROUP BY na), r AS (SELECT na, sum(h) OVER (ORDER BY na) AS tp, sum(c) OVER (ORDER BY na) AS rk, sum(h) OVER () AS tot FROM p),
    v AS (SELECT na, tp / rk AS pr, tp / tot AS rc, coalesce(lag(tp) OVER (ORDER BY na), 0) / tot AS prev FROM r)
    SELECT round(sum((rc - prev) * pr), 6) AS avg_precision FROM v"""
)
def pr_curve_avg_precision(spark: SparkSession, d: str) -> DataFrame:
    return M.average_precision(M.precision_recall(_scored(spark, d), "na", "has_answer"))


@query(
    f"""WITH {SCORED}, p AS (SELECT na, sum(CASE WHEN has_answer = 1 THEN score ELSE -1 END) AS g FROM x GROUP BY na), r AS (SELECT na, sum(g) OVER (ORDER BY na) AS run FROM p),
    m AS (SELECT run, na FROM r ORDER BY run DESC, na LIMIT 1), z AS (SELECT sum((has_answer = 0)::INT) AS start, count(*) AS n FROM x)
    SELECT round(100 * (start + greatest(run, 0)) / n, 6) AS best_score, round(CASE WHEN run > 0 THEN na ELSE 0 END, 6) AS threshold FROM m, z"""
)
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return M.best_threshold(_scored(spark, d), "na", "score", "has_answer")


@query(f"WITH {SCORED} SELECT doc_id, CASE WHEN na > 0.5 THEN (has_answer = 0)::INT::DOUBLE ELSE score END AS score FROM x")
def no_answer_threshold(spark: SparkSession, d: str) -> DataFrame:
    return M.with_no_answer(_scored(spark, d), "na", "score", "has_answer", 0.5).select("doc_id", "score")


@query(
    f"""WITH {SCORED}, b AS (SELECT floor(least(na, 0.9999) * 10)::INT AS bin, count(*) AS n, round(avg(has_answer), 6) AS em, round(avg(na), 6) AS confidence FROM x GROUP BY 1)
    SELECT r.bin::INT AS bin, coalesce(n, 0) AS n, em, confidence FROM range(10) r(bin) LEFT JOIN b ON b.bin = r.bin"""
)
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return M.calibration_bins(_scored(spark, d), "na", "has_answer")


@query(f"WITH {SCORED} SELECT bin, round(c / sum(c) OVER (), 6) AS share FROM (SELECT least(floor(na * 20), 19)::INT AS bin, count(*)::DOUBLE AS c FROM x GROUP BY 1)")
def noans_histogram(spark: SparkSession, d: str) -> DataFrame:
    return M.histogram(_scored(spark, d), "na")


# candidates by rule: question = conversation, passage = turn
CAND = """c AS (SELECT conv_id AS doc, 0 AS question, turn AS passage, ((conv_id + turn * k) % 9 + 1)::INT AS start, ((conv_id + turn * k) % 9 + 1 + k)::INT AS "end", round(((conv_id * 31 + turn * 17 + k * 7) % 101) / 10.0::DOUBLE, 6) AS score FROM conversations, range(3) r(k)),
na AS (SELECT conv_id AS doc, 0 AS question, turn AS passage, round(((conv_id * 13 + turn * 29) % 89) / 10.0::DOUBLE, 6) AS score FROM conversations)"""


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, d, "conversations").select("conv_id", "turn")
    k = c.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    start = (F.col("conv_id") + F.col("turn") * F.col("k")) % 9 + 1
    score = ((F.col("conv_id") * 31 + F.col("turn") * 17 + F.col("k") * 7) % 101) / 10.0
    cand = k.select(F.col("conv_id").alias("doc"), F.lit(0).alias("question"), F.col("turn").alias("passage"), start.cast("int").alias("start"), (start + F.col("k")).cast("int").alias("end"), F.round(score, 6).alias("score"))
    none = c.select(F.col("conv_id").alias("doc"), F.lit(0).alias("question"), F.col("turn").alias("passage"), F.round(((F.col("conv_id") * 13 + F.col("turn") * 29) % 89) / 10.0, 6).alias("score"))
    return cand, none


@query(
    f"""WITH {CAND}, best AS (SELECT doc, question, passage, max(score) AS best FROM c GROUP BY ALL),
    gap AS (SELECT doc, question, -min(na.score - best) AS gap, max(best) AS top FROM na JOIN best USING (doc, question, passage) GROUP BY ALL),
    s AS (SELECT doc, question, start, "end", max(score) AS score FROM c GROUP BY ALL UNION ALL SELECT doc, question, -1, -1, top - gap FROM gap),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc, question ORDER BY round(score, 6) DESC, start, "end") AS rank FROM s)
    SELECT doc, question, start, "end", round(score, 6) AS score, rank::INT AS rank, round(gap, 6) AS gap FROM r JOIN gap USING (doc, question) WHERE rank <= 3"""
)
def qa_candidate_dedup_nbest(spark: SparkSession, d: str) -> DataFrame:
    cand, none = _candidates(spark, d)
    out = Q.document_answers(cand, none, 3)
    return out.select("doc", "question", "start", "end", F.round("score", 6).alias("score"), "rank", F.round("gap", 6).alias("gap"))


@query(
    f"""WITH {CAND}, l AS (SELECT doc, question, CASE WHEN passage % 2 = 0 THEN start ELSE -1 END AS start, CASE WHEN passage % 2 = 0 THEN "end" ELSE -1 END AS "end" FROM c),
    p AS (SELECT DISTINCT * FROM l WHERE start >= 0)
    SELECT * FROM p UNION ALL SELECT DISTINCT doc, question, -1, -1 FROM l WHERE (doc, question) NOT IN (SELECT (doc, question) FROM p)"""
)
def reduce_labels(spark: SparkSession, d: str) -> DataFrame:
    cand, _ = _candidates(spark, d)
    odd = lambda c: F.when(F.col("passage") % 2 == 0, F.col(c)).otherwise(-1).alias(c)
    return Q.reduce_labels(cand.select("doc", "question", odd("start"), odd("end")))


LOGITS = """l AS (SELECT conv_id AS sample, turn AS pos, round(((conv_id * 37 + turn * 53) % 97) / 10.0::DOUBLE, 6) AS start, round(((conv_id * 41 + turn * 59) % 83) / 10.0::DOUBLE, 6) AS "end" FROM conversations)"""


def _logits(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    a = F.round(((F.col("conv_id") * 37 + F.col("turn") * 53) % 97) / 10.0, 6)
    b = F.round(((F.col("conv_id") * 41 + F.col("turn") * 59) % 83) / 10.0, 6)
    return c.select(F.col("conv_id").alias("sample"), F.col("turn").cast("int").alias("pos"), a.alias("start"), b.alias("end"))


@query(
    f"""WITH {LOGITS}, s AS (SELECT a.sample, a.pos::INT AS s, b.pos::INT AS e, round(a.start + b."end", 6) AS score FROM l a JOIN l b ON a.sample = b.sample AND ((a.pos = 0 AND b.pos = 0) OR (a.pos > 0 AND b.pos >= a.pos AND b.pos < a.pos + 4))),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, s, e)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 10"""
)
def span_topk(spark: SparkSession, d: str) -> DataFrame:
    return Q.span_candidates(_logits(spark, d), 10, 4)


# the greedy fold: a step takes the next span of a sample and keeps it if it is clear of those kept before
@query(
    f"""WITH RECURSIVE {LOGITS}, s AS (SELECT a.sample, a.pos::INT AS s, b.pos::INT AS e, round(a.start + b."end", 6) AS score FROM l a JOIN l b ON a.sample = b.sample AND ((a.pos = 0 AND b.pos = 0) OR (a.pos > 0 AND b.pos >= a.pos AND b.pos < a.pos + 4))),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, s, e) AS rank FROM s),
    c AS (SELECT sample, s, e, score, row_number() OVER (PARTITION BY sample ORDER BY rank) AS i FROM r WHERE rank <= 20 AND s > 0),
    f AS (SELECT sample, 0::BIGINT AS i, [] ::STRUCT(s INT, e INT, score DOUBLE)[] AS kept FROM (SELECT DISTINCT sample FROM c)
      UNION ALL
      SELECT f.sample, c.i, CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda k: abs(k.s - c.s) <= 1 OR abs(k.e - c.e) <= 1)) = 0 THEN list_append(kept, struct_pack(s := c.s, e := c.e, score := c.score)) ELSE kept END
      FROM f JOIN c ON c.sample = f.sample AND c.i = f.i + 1),
    z AS (SELECT sample, arg_max(kept, i) AS kept FROM f GROUP BY sample)
    SELECT sample, (i - 1)::INT AS place, kept[i].s AS s, kept[i].e AS e, kept[i].score AS score FROM z, range(1, len(kept) + 1) x(i)"""
)
def span_topk_fold(spark: SparkSession, d: str) -> DataFrame:
    return Q.distinct_spans(Q.span_candidates(_logits(spark, d), 20, 4), 3, 1)


# vectors
VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


@query(f"WITH {VEC} SELECT label, i::INT AS dim, round(avg(v[i + 1]), 6) AS mean, round(max(v[i + 1]), 6) AS top FROM v, range(64) r(i) GROUP BY label, i")
def embedding_mean_max_pool(spark: SparkSession, d: str) -> DataFrame:
    return models.mean_max_pool(_vectors(spark, d), "label", "v")


@query(
    f"""WITH {VEC}, e AS (SELECT vec_id, v, list_transform(v[1:4], lambda x: exp(x / 0.5::DOUBLE - list_max(v[1:4]) / 0.5::DOUBLE)) AS e FROM v),
    p AS (SELECT vec_id, v, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
    SELECT vec_id, (list_position(p, list_max(p)) - 1)::BIGINT AS pred, round(list_max(p), 6) AS confidence, len(list_filter(v, lambda x: 1 / (1 + exp(-x)) > 0.5))::INT AS n_on FROM p"""
)
def class_probabilities(spark: SparkSession, d: str) -> DataFrame:
    p = V.softmax(V.temperature_scale(F.slice("v", 1, 4), 0.5))
    on = F.size(F.filter("v", lambda x: V.sigmoid(x) > 0.5))
    out = _vectors(spark, d).select("vec_id", p.alias("p"), on.alias("n_on"))
    return out.select("vec_id", V.argmax(F.col("p")).alias("pred"), F.round(F.array_max("p"), 6).alias("confidence"), "n_on")


@query(
    f"""WITH {VEC}, s AS (SELECT a.vec_id // 8 AS question, a.vec_id % 8 + 1 AS rank, list_cosine_similarity(a.v, b.v) AS s
      FROM v a LEFT JOIN v b ON a.vec_id // 8 = b.vec_id // 8 AND b.vec_id % 8 >= 3 WHERE a.vec_id % 8 < 3)
    SELECT question, round(max(s) FILTER (rank = 1), 6) AS top_1, round(max(s), 6) AS top_n FROM s GROUP BY question"""
)
def semantic_answer_similarity(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select(F.expr("vec_id div 8").alias("question"), (F.col("vec_id") % 8 + 1).alias("rank"), "v")
    out = Q.answer_similarity(v.where("rank <= 3"), v.where("rank > 3"))
    return out.select("question", F.round("top_1", 6).alias("top_1"), F.round("top_n", 6).alias("top_n"))


def _similar_sql(measure: str) -> str:
    f = {"dot": "list_inner_product(a.v, b.v)", "cosine": "list_cosine_similarity(a.v, b.v)"}[measure]
    return f"""WITH {VEC}, s AS (SELECT a.vec_id AS qid, b.vec_id AS id, round({f}, 4) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 5"""


def _similar(spark: SparkSession, d: str, measure: str) -> DataFrame:
    v = _vectors(spark, d)
    return R.similar(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("q")), v.select(F.col("vec_id").alias("id"), "v"), 5, measure)


@query(_similar_sql("dot"))
def dot_product_topk(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, "dot")


@query(_similar_sql("cosine"))
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, "cosine")


INBATCH = f"{VEC}, s AS (SELECT a.vec_id AS qid, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v) AS x FROM v a JOIN v b ON a.vec_id // 8 = b.vec_id // 8)"


def _in_batch(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).withColumn("batch", F.expr("vec_id div 8"))
    other = v.select("batch", F.col("vec_id").alias("id"), F.col("label").alias("l2"), F.col("v").alias("w"))
    return v.join(other, "batch").select(F.col("vec_id").alias("qid"), "id", (F.col("label") == F.col("l2")).alias("same"), V.dot(F.col("v"), F.col("w")).alias("x"))


@query(f"WITH {INBATCH} SELECT qid, id, round(x - ln(sum(exp(x)) OVER (PARTITION BY qid)), 5) AS log_p FROM s")
def inbatch_log_softmax(spark: SparkSession, d: str) -> DataFrame:
    return R.log_softmax(_in_batch(spark, d), "qid", "x").select("qid", "id", F.round("log_p", 5).alias("log_p"))


@query(
    f"""WITH {INBATCH}, o AS (SELECT qid, id, same, round(x, 4) AS x FROM s WHERE qid <> id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x DESC, id) - 1 AS r FROM o),
    m AS (SELECT qid, min(r) AS r FROM r WHERE same GROUP BY qid) SELECT round(avg(r), 6) AS avg_rank, count(*) AS queries FROM m"""
)
def avg_rank_positive(spark: SparkSession, d: str) -> DataFrame:
    return R.positive_ranks(_in_batch(spark, d).where("qid <> id").withColumn("x", F.round("x", 4)), "qid", "id", "x", "same")


RUN = f"""{VEC}, s AS (SELECT a.vec_id AS qid, b.vec_id AS pid, round(list_inner_product(a.v, b.v), 4) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
run AS (SELECT * FROM (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM s) WHERE rank <= 10),
rel AS (SELECT a.vec_id AS qid, b.vec_id AS pid FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND a.label = b.label AND b.vec_id % 3 = 0)"""


@query(f"WITH {RUN}, f AS (SELECT qid, min(rank) AS r FROM run JOIN rel USING (qid, pid) GROUP BY qid) SELECT round(sum(1.0::DOUBLE / r) / (SELECT count(DISTINCT qid) FROM rel), 6) AS mrr, count(*) AS found, (SELECT count(DISTINCT qid) FROM rel) AS queries FROM f")
def mrr_at_10(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("q"), "label")
    run = R.similar(q.select("qid", "q"), v.select(F.col("vec_id").alias("id"), "v"), 10).withColumnRenamed("id", "pid")
    rel = q.select("qid", "label").join(v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("pid"), "label"), "label").where("qid <> pid").select("qid", "pid")
    return R.mean_reciprocal_rank(run, rel)


@query("SELECT label AS qid, (vec_id % 50) AS pid, count(*) AS times FROM embeddings GROUP BY ALL HAVING count(*) > 1")
def ranking_quality_check(spark: SparkSession, d: str) -> DataFrame:
    return R.repeated_items(read(spark, d, "embeddings").select(F.col("label").alias("qid"), (F.col("vec_id") % 50).alias("pid")))


@query(
    """SELECT o_custkey AS qid, l_partkey AS pid, c_name AS query, p_name AS passage, (o_orderpriority = '1-URGENT')::INT AS label FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45) c
    JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey CROSS JOIN (SELECT 0) LEFT JOIN (SELECT DISTINCT o_custkey, l_partkey, '1-URGENT' AS o_orderpriority FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT') u USING (o_custkey, l_partkey)"""
)
def candidates_4way_join(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = lines.where("l_quantity > 45").select(F.col("o_custkey").alias("qid"), F.col("l_partkey").alias("pid")).distinct()
    relevant = lines.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("qid"), F.col("l_partkey").alias("pid")).distinct()
    queries = read(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.col("c_name").alias("query"))
    passages = read(spark, d, "part").select(F.col("p_partkey").alias("pid"), F.col("p_name").alias("passage"))
    return R.labelled_candidates(pairs, queries, passages, relevant)


SQL["candidates_4way_join"] = """
WITH j AS (SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey), c AS (SELECT DISTINCT o_custkey AS qid, l_partkey AS pid FROM j WHERE l_quantity > 45),
u AS (SELECT DISTINCT o_custkey AS qid, l_partkey AS pid, 1 AS label FROM j WHERE o_orderpriority = '1-URGENT')
SELECT c.qid, c.pid, c_name AS query, p_name AS passage, coalesce(label, 0) AS label FROM c JOIN customer ON c_custkey = c.qid JOIN part ON p_partkey = c.pid LEFT JOIN u ON u.qid = c.qid AND u.pid = c.pid"""


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def qrels_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").select("doc_id", "quality").join(read(spark, d, "documents").where("lang = 'de'"), "doc_id", "left_semi")


@query("SELECT doc_id, '' AS prediction FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_predictions_anti(spark: SparkSession, d: str) -> DataFrame:
    predictions = read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("given").alias("answer"), F.col("quality").alias("score"))
    filled = top_answers(predictions, read(spark, d, "documents").select(F.col("doc_id").alias("id")))
    return filled.where("answer = ''").select(F.col("id").alias("doc_id"), F.col("answer").alias("prediction"))


@query("SELECT r_name, lr, batch FROM region, (VALUES (1e-5), (3e-5)) a(lr), (VALUES (16), (32), (64)) b(batch)")
def param_grid_crossjoin(spark: SparkSession, d: str) -> DataFrame:
    return validation.with_grid(read(spark, d, "region").select("r_name"), {"lr": [1e-5, 3e-5], "batch": [16, 32, 64]})


SQL["param_grid_crossjoin"] = "SELECT r_name, lr::DOUBLE AS lr, batch FROM region, (VALUES (1e-5), (3e-5)) a(lr), (VALUES (16), (32), (64)) b(batch)"


@query(
    """SELECT 'seen' AS kind, count(*) AS n FROM (SELECT DISTINCT lang FROM documents) UNION ALL SELECT 'unknown', count(*) FROM (SELECT lang FROM documents EXCEPT SELECT unnest(['de', 'en']))
    UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'bag', count(*) FROM (SELECT lang FROM documents INTERSECT ALL SELECT lang FROM documents WHERE doc_id % 2 = 0)
    UNION ALL SELECT 'rest', count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)"""
)
def set_ops_labels(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels").select("doc_id")
    given = spark.createDataFrame([("de",), ("en",)], "lang string")
    parts = {
        "seen": docs.select("lang").distinct(),
        "unknown": docs.select("lang").subtract(given),
        "both": docs.select("doc_id").intersect(labels),
        "bag": docs.select("lang").intersectAll(docs.where("doc_id % 2 = 0").select("lang")),
        "rest": docs.select("doc_id").exceptAll(labels),
    }
    out = None
    for kind, p in parts.items():
        one = p.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT d.doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text) AND len(regexp_extract_all(b.text, '\\S+')) >= 8")
def udtf_passages(spark: SparkSession, d: str) -> DataFrame:
    return find_passages(read(spark, d, "documents"), read(spark, d, "benchmark")).select("doc_id", "item_id")
