"""Queries of trained and scored models: tags, heads, retrieval, validation, calibration, tokenizer families, SQL functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import tables
from textloom.functions import text as T
from textloom.functions import tokenizers as K
from textloom.operators import calibration, heads, models, ranking, retrieval, splits, tagging, validation
from textloom.operators import tags as G
from textloom.plans.common import kept, read
from textloom.plans.splits import SQL as SPLIT_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# tags by Viterbi from whole-number scores of the words of conversations

LABELS = ["O", "B-X", "I-X"]
STEPS = np.array([[(3 * i + 5 * j) % 4 for j in range(3)] for i in range(4)], float) + tagging.iob_transitions(LABELS)


def _best(j: int) -> str:
    ways = ", ".join(f"s[{i + 1}] + {int(STEPS[i][j])}" for i in range(3))
    return f"[{ways}]"


@query(
    rf"""WITH RECURSIVE w AS (SELECT conv_id * 1000 + turn AS seq, regexp_extract_all(text, '\S+') AS w FROM conversations),
    e AS (SELECT seq, i, [n % 5, (n * 3 + i) % 7, (n * 5 + 2 * i) % 7]::BIGINT[] AS e FROM (SELECT seq, i, length(w[i]) AS n FROM w, range(1, len(w) + 1) r(i))),
    v AS (SELECT seq, i, [{", ".join(f"e[{j + 1}] + {int(STEPS[3][j])}" for j in range(3))}]::BIGINT[] AS s, ['O', 'B', 'I'] AS p FROM e WHERE i = 1
      UNION ALL
      SELECT seq, i, [{", ".join(f"list_max(b[{j + 1}]) + e[{j + 1}]" for j in range(3))}]::BIGINT[], [{", ".join(f"p[list_position(b[{j + 1}], list_max(b[{j + 1}]))] || '{x}'" for j, x in enumerate("OBI"))}]
      FROM (SELECT e.seq, e.i, p, e.e, [{", ".join(map(_best, range(3)))}] AS b FROM v JOIN e ON e.seq = v.seq AND e.i = v.i + 1))
    SELECT v.seq, p[list_position(s, list_max(s))] AS tags FROM v JOIN (SELECT seq, len(w) AS n FROM w) x ON x.seq = v.seq AND x.n = v.i"""
)
def viterbi_tags(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), T.space_tokens(F.col("text")).alias("w")).where("size(w) > 0")
    n = F.length
    scores = F.transform("w", lambda w, i: F.transform(F.array(n(w) % 5, (n(w) * 3 + i + 1) % 7, (n(w) * 5 + 2 * (i + 1)) % 7), lambda x: x.cast("double")))
    out = tagging.decode_scores(words.select("seq", scores.alias("scores")), "scores", LABELS, STEPS)
    return out.select("seq", F.array_join(F.transform("preds", lambda t: F.substring(t, 1, 1)), "").alias("tags"))


def tagged_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns with tags by a rule on words: capitals within a sentence open an entity, which goes on while words have no vowel pair."""
    turns = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), T.space_tokens(F.col("text")).alias("tokens"))
    kind = lambda w: F.when(w.rlike("^[A-Z]"), "B-NAME").when(w.rlike("(th|an)$"), "B-END").otherwise("O")
    tags = F.transform("tokens", lambda w, i: F.when((kind(w) == "B-END") & (i > 0) & (kind(F.get("tokens", i - 1)) == "B-END"), "I-END").otherwise(kind(w)))
    return turns.withColumn("tags", tags)


@query()
def sequence_tagger(spark: SparkSession, d: str) -> DataFrame:
    """Entity precision, recall and F1 of a tagger on the turns of conversations that it has not seen."""
    turns = tagged_turns(spark, d)
    held = F.expr("(seq div 1000) % 4 = 0")
    model = tagging.fit_tagger(turns.where(~held), "seq", ["O", "B-NAME", "B-END", "I-END"])
    asked = turns.where(held)
    flat = lambda df, c: df.select("seq", F.posexplode(c).alias("pos", "tag"))
    preds = flat(tagging.tag(model, asked.select("seq", "tokens")), "preds")
    return G.entity_f1(G.entities(preds, "seq", "pos"), G.entities(flat(asked, "tags"), "seq", "pos"), "seq")


# two heads on one encoding

CLASSES = np.array([[(7 * c + 3 * i) % 5 - 2 for i in range(64)] for c in range(10)], float)
VALUE = np.array([i % 3 - 1 for i in range(64)], float)


def _numbers(v: np.ndarray) -> str:
    return "[" + ", ".join(f"{int(x)}" for x in v) + "]::DOUBLE[]"


@query(
    f"""WITH e AS (SELECT vec_id, label, vec_id % 7 AS y, embedding::DOUBLE[] AS v FROM embeddings),
    z AS (SELECT vec_id, label, y, [{", ".join(f"list_inner_product(v, {_numbers(w)})" for w in CLASSES)}] AS z, list_inner_product(v, {_numbers(VALUE)}) + 0.5 AS r FROM e),
    p AS (SELECT *, ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) + list_max(z) AS total FROM z)
    SELECT vec_id, (list_position(z, list_max(z)) - 1)::INT AS topic, round(exp(list_max(z) - total), 5) AS probability, round(r * 3 + 2, 5) AS value,
        round(total - z[label + 1] + 0.5::DOUBLE * (r - (y - 2) / 3.0::DOUBLE) ** 2, 4) AS loss FROM p"""
)
def two_heads(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label"), (F.col("vec_id") % 7).cast("double").alias("y"))
    made = [heads.make_head("classification", "topic", CLASSES, np.zeros(10)), heads.make_head("regression", "length", VALUE, 0.5, share=0.5)]
    tasks = {"topic": heads.Task([str(i) for i in range(10)], "label", "acc"), "length": heads.Task((2.0, 3.0), "y", "mse")}
    out = heads.score(df, ["vec_id"], ["embedding"], heads.vector_encoder("embedding"), heads.bind(made, tasks))
    rounded = F.round("topic.probability", 5).alias("probability"), F.round("length.value", 5).alias("value"), F.round("loss", 4).alias("loss")
    return out.select("vec_id", F.col("topic.label").cast("int").alias("topic"), *rounded)


@query()
def fitted_heads(spark: SparkSession, d: str) -> DataFrame:
    """A classifier and a regression fitted on the same vectors: share of right labels and mean squared error on all rows."""
    df = read(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("y"))
    tasks = {"topic": heads.Task([str(i) for i in range(10)], "label", "acc"), "total": heads.Task((0.0, 1.0), "y", "mse")}
    made = heads.fit_heads(df, "embedding", {"topic": ("classification", tasks["topic"]), "total": ("regression", tasks["total"])})
    out = heads.score(df, ["vec_id", "label", "y"], ["embedding"], heads.vector_encoder("embedding"), heads.bind(made, tasks))
    right = F.avg((F.col("topic.label") == F.col("label")).cast("double"))
    return out.agg(F.round(right, 3).alias("acc"), F.round(F.avg((F.col("total.value") - F.col("y")) ** 2), 3).alias("mse"))


# retrieval


@query()
def two_tower_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The mean reciprocal rank, within ten, of a document's second line for its first: towers as they start and fitted.

    The queries are the documents whose id is divisible by 20; the towers learn from the others.
    """
    lines = read(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("l")).where("size(l) > 1")
    pairs = lines.select("doc_id", F.col("l")[0].alias("q"), F.col("l")[1].alias("p"))
    asked = F.col("doc_id") % 20 == 0
    fitted = retrieval.fit_towers(pairs.where(~asked), "doc_id", "q", "p", width=1 << 12, size=16, rounds=4)
    relevant = pairs.where(asked).select(F.col("doc_id").alias("qid"), F.col("doc_id").alias("pid"))
    known = pairs.where(asked).count(), pairs.count(), 16  # every line has a vector
    out = None
    for name, model in (("start", retrieval.TwoTowers.start(1 << 12, 16)), ("fitted", fitted)):
        queries = retrieval.embed(model, pairs.where(asked).select(F.col("doc_id").alias("qid"), "q"), "q", "query", "e").select(F.concat(F.lit("q"), "qid").alias("qid"), F.col("e").alias("q"))
        items = retrieval.embed(model, pairs.select(F.col("doc_id").alias("id"), "p"), "p", "passage").select(F.col("id").cast("string").alias("id"), "v")
        run = ranking.similar(queries, items, 10, "cosine", known=known).select(F.expr("bigint(substring(qid, 2))").alias("qid"), F.col("id").cast("bigint").alias("pid"), "rank")
        one = ranking.mean_reciprocal_rank(run, relevant).select(F.lit(name).alias("towers"), "mrr", "found", "queries")
        out = one if out is None else out.unionByName(one)
    return out


# validation


@query(
    r"""WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '\S+'))::DOUBLE AS x, n_chars::DOUBLE AS y, (ntile(5) OVER (ORDER BY md5(doc_id::VARCHAR || '-3'), doc_id) - 1)::INT AS fold FROM documents),
    s AS (SELECT fold, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy FROM d GROUP BY fold),
    o AS (SELECT a.fold, sum(b.n) AS n, sum(b.x) AS x, sum(b.y) AS y, sum(b.xx) AS xx, sum(b.xy) AS xy FROM s a JOIN s b ON a.fold <> b.fold GROUP BY a.fold),
    m AS (SELECT fold, penalty, x / n AS mx, y / n AS my, (xy - x * y / n) / (xx - x * x / n + penalty) AS w FROM o, (VALUES (0::DOUBLE), (1e6::DOUBLE)) p(penalty))
    SELECT doc_id, fold, penalty, round(my + w * (x - mx), 2) AS prediction FROM d JOIN m USING (fold)"""
)
def cv_ridge_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.size(T.space_tokens(F.col("text"))).alias("x"), F.col("n_chars").alias("y"))
    out = validation.ridge_out_of_fold(splits.k_fold(docs, "doc_id", 5, 3), ["doc_id"], "fold", 5, ["x"], "y", [0.0, 1e6])
    return out.withColumn("prediction", F.round("prediction", 2))


@query()
def cv_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of out-of-fold predictions of document quality, for each of a grid of settings."""
    docs = read(spark, d, "documents").join(read(spark, d, "labels").where("quality IS NOT NULL"), "doc_id").select("doc_id", "text", "quality")
    # every fit and prediction reads the folds, so they are joined and dealt once
    folds = kept(spark, splits.stratified_k_fold(docs, "doc_id", "quality", 3, 7), "folds")
    grid = validation.parameter_grid({"iterations": [2, 10], "size": [256, 1024]}, [{"iterations": 2, "size": 1024}])

    def fit(train: DataFrame, iterations: int, size: int) -> object:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression

        return Pipeline(stages=[*models.text_features("text", size), LogisticRegression(labelCol="quality", maxIter=iterations, regParam=0.01)]).fit(train)

    def predict(model: object, rows: DataFrame) -> DataFrame:
        return model.transform(rows).select("doc_id", "quality", F.col("prediction").cast("int").alias("prediction"))

    scored = validation.cross_validate(folds, "doc_id", "fold", 3, fit, predict, grid)
    return scored.groupBy("grid").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.round(F.avg((F.col("prediction") == F.col("quality")).cast("double")), 2).alias("acc"))


@query("SELECT r_name, lr, batch FROM region, (VALUES (1e-5), (3e-5)) a(lr), (VALUES (16), (32), (64)) b(batch) WHERE NOT (lr = 3e-5 AND batch = 64) AND NOT (r_name = 'ASIA' AND batch = 16)")
def param_grid_excluded(spark: SparkSession, d: str) -> DataFrame:
    grid = {"lr": [1e-5, 3e-5], "batch": [16, 32, 64]}
    return validation.with_grid(read(spark, d, "region").select("r_name"), grid, [{"lr": 3e-5, "batch": 64}, {"r_name": "ASIA", "batch": 16}])


# calibration


def _newton(k: int) -> str:
    p = f"(SELECT y, z, list_transform(z, lambda x: exp(x * b - list_max(z) * b)) AS e, b FROM z, b{k})"
    q = f"(SELECT y, z, b, list_inner_product(e, z) / list_sum(e) AS m, list_inner_product(e, list_transform(z, lambda x: x * x)) / list_sum(e) AS s FROM {p})"
    return f"b{k + 1} AS (SELECT least(greatest(b - g / h, b / 4), b * 4) AS b FROM (SELECT any_value(b) AS b, sum(m - z[y + 1]) AS g, sum(s - m * m) AS h FROM {q}))"


@query(
    f"""WITH z AS (SELECT vec_id, z, CASE WHEN vec_id % 10 < 7 THEN list_position(z, list_max(z)) - 1 ELSE vec_id % 4 END AS y
      FROM (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE * 20) AS z FROM embeddings)),
    b0 AS (SELECT 1.0::DOUBLE AS b), {", ".join(map(_newton, range(calibration.STEPS)))}
    SELECT round(1 / b, 4) AS temperature FROM b{calibration.STEPS}"""
)
def temperature_fit(spark: SparkSession, d: str) -> DataFrame:
    """The temperature for four components of a vector as logits; stand-in data, as the tables have no logits."""
    z = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 20)
    rows = read(spark, d, "embeddings").select("vec_id", z.alias("z"))
    rows = rows.withColumn("y", F.when(F.col("vec_id") % 10 < 7, F.array_position("z", F.array_max("z")) - 1).otherwise(F.col("vec_id") % 4).cast("int"))
    return spark.range(1).select(F.round(F.lit(calibration.fit_temperature(rows, "z", "y")), 4).alias("temperature"))


# tokenizer families, over vocabularies by rule

_VOWELS, _CONSONANTS = "aeiou", "bcdhlnrstw"
#: Unigram pieces with whole-number scores: the unknown one, the word mark, letters, pairs, pairs after the word mark.
UNIGRAM = [("<unk>", -30.0), (K.SPACE, -4.0), *((chr(97 + i), -6.0 - i % 4) for i in range(26))]
UNIGRAM += [(a + b, -7.0 - (i + j) % 5) for i, a in enumerate(_CONSONANTS) for j, b in enumerate(_VOWELS)]
UNIGRAM += [(K.SPACE + a + b, -8.0 - (i * 3 + j) % 4) for i, a in enumerate("toiahw") for j, b in enumerate("hnafe")]
_PIECES = "MAP {" + ", ".join(f"'{p}': [{i}, {int(s)}]" for i, (p, s) in enumerate(UNIGRAM)) + "}"


@query(
    rf"""WITH RECURSIVE v AS (SELECT {_PIECES} AS v),
    w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS w FROM documents),
    t AS (SELECT DISTINCT w, '{K.SPACE}' || w AS t FROM w),
    c AS (SELECT w, t, 0 AS i, [0]::BIGINT[] AS s, [0]::BIGINT[] AS n, [0]::BIGINT[] AS ids, [0]::BIGINT[] AS u FROM t
      UNION ALL
      SELECT w, t, i + 1, list_append(s, x.s), list_append(n, n[i + 2 - x.l] + 1), list_append(ids, ids[i + 2 - x.l] + x.id), list_append(u, u[i + 2 - x.l] + (x.id = 0)::INT)
      FROM (SELECT w, t, i, s, n, ids, u, ways[list_position(list_transform(ways, lambda y: y.s), list_max(list_transform(ways, lambda y: y.s)))] AS x
        FROM (SELECT *, list_filter(list_transform([3, 2, 1], lambda l: CASE WHEN l <= i + 1 THEN struct_pack(l := l,
              s := s[i + 2 - l] + coalesce(v[substr(t, i + 2 - l, l)][2], CASE WHEN l = 1 THEN {int(min(s for _, s in UNIGRAM) - 10)} END), id := coalesce(v[substr(t, i + 2 - l, l)][1], 0)) END), lambda y: y.s IS NOT NULL) AS ways
          FROM c, v WHERE i < length(t)))),
    f AS (SELECT w, n[i + 1] AS n, ids[i + 1] AS ids, u[i + 1] AS u FROM c WHERE i = length(t))
    SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_pieces, coalesce(sum(ids), 0)::BIGINT AS sum_ids, coalesce(sum(u), 0)::BIGINT AS n_unknown
    FROM documents d LEFT JOIN w USING (doc_id) LEFT JOIN f ON f.w = w.w GROUP BY d.doc_id"""
)
def unigram_pieces(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", K.unigram_pieces(T.space_tokens(F.col("text")), UNIGRAM, fuse_unknown=False).alias("ids"))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), total.alias("sum_ids"), F.size(F.filter("ids", lambda x: x == 0)).cast("long").alias("n_unknown"))


MERGES = [(a, b) for a in "taeiohrsn" for b in "hnrstoe" if a != b][:48]
MERGES += [("th", "e"), ("in", "g"), ("an", "d"), ("th", "at"), ("i", "on"), ("t", "ion"), ("the", "re"), ("en", "t")]
_LETTERS = K.byte_letters()
BYTES = [_LETTERS[b] for b in range(256)] + [a + b for a, b in MERGES]


def _merge_sql(word: str) -> str:
    for a, b in MERGES:
        x, y = (p.encode().hex() for p in (a, b))
        word = f"replace({word}, '|{x}||{y}|', '|{x}{y}|')"
    return word


_IDS = "MAP {" + ", ".join(f"'{(a + b).encode().hex()}': {256 + i}" for i, (a, b) in enumerate(MERGES)) + "}"


@query(
    rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS w FROM documents),
    t AS (SELECT w, {_merge_sql("regexp_replace(lower(hex(encode(w))), '(..)', '|\\1|', 'g')")} AS t FROM (SELECT DISTINCT w FROM w)),
    p AS (SELECT w, string_split(trim(t, '|'), '||') AS p, {_IDS} AS m FROM t),
    f AS (SELECT w, len(p) AS n, list_sum(list_transform(p, lambda x: CASE WHEN length(x) = 2 THEN ('0x' || x)::INT ELSE m[x] END)) AS ids FROM p)
    SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_pieces, coalesce(sum(ids), 0)::BIGINT AS sum_ids FROM documents d LEFT JOIN w USING (doc_id) LEFT JOIN f ON f.w = w.w GROUP BY d.doc_id"""
)
def byte_pair_pieces(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", K.byte_pair_pieces(T.space_tokens(F.col("text")), BYTES, MERGES).alias("ids"))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_ids"))


# functions called by name from Spark SQL


@query(SPLIT_SQL["passage_char_spans"])
def udtf_document_passages(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark)
    sql = "SELECT d.doc_id, p.passage, bigint(p.start_ch) AS start_ch, bigint(p.end_ch) AS end_ch FROM {docs} d, LATERAL passages(d.text, 64, 32) p"
    return spark.sql(sql, docs=read(spark, d, "documents"))


@query(
    """WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER w - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_type, arg_min(event_id, event_id) AS first_event, arg_max(event_id, event_id) AS last_event, count(*) AS n FROM e GROUP BY user_id, event_type, k"""
)
def udtf_event_runs(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark)
    events = read(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    sql = "SELECT bigint(part) AS user_id, value AS event_type, bigint(first) AS first_event, bigint(last) AS last_event, n FROM runs(TABLE({events}) PARTITION BY user_id ORDER BY (ts, event_id))"
    return spark.sql(sql, events=events)


@query(
    r"""WITH w AS (SELECT lang, length(unnest(regexp_extract_all(text, '\S+'))) AS l FROM documents), c AS (SELECT lang, l, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT lang, sum(n) AS t FROM c GROUP BY lang)
    SELECT c.lang, round(-sum(n / t::DOUBLE * log2(n / t::DOUBLE)), 6) AS bits FROM c JOIN t ON c.lang IS NOT DISTINCT FROM t.lang GROUP BY c.lang"""
)
def udaf_word_length_entropy(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark)
    words = read(spark, d, "documents").select("lang", F.explode(T.space_tokens(F.col("text"))).alias("w"))
    counts = words.groupBy("lang", F.length("w").alias("l")).agg(F.count("*").alias("n"))  # a row per length, so a group is small
    return spark.sql("SELECT lang, round(entropy(n), 6) AS bits FROM {counts} GROUP BY lang", counts=counts)
