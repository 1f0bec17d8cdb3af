"""Queries of splits, folds, passages and pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import pairs as PR
from textloom.operators import passages as PS
from textloom.operators import splits as S
from textloom.plans.common import read
from textloom.plans.text import OFFSETS, TOK, token_offsets

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _h(key: str, seed: int) -> str:
    return f"md5({key}::VARCHAR || '-{seed}')"




@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_h('doc_id', 1)}, doc_id) <= ceil((SELECT count(*) FROM labels) * 0.1::DOUBLE) THEN 'dev' ELSE 'train' END AS split FROM labels")
def dev_split_random(spark: SparkSession, d: str) -> DataFrame:
    return S.random_split(read(spark, d, "labels").select("doc_id"), "doc_id", 0.1, 1)


@query(
    f"SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {_h('doc_id', 2)}, doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * 0.1::DOUBLE) THEN 'dev' ELSE 'train' END AS split FROM labels"
)
def dev_split_stratified(spark: SparkSession, d: str) -> DataFrame:
    return S.stratified_split(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.1, 2)


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'dev' ELSE 'train' END AS split FROM labels")
def dev_split_custom(spark: SparkSession, d: str) -> DataFrame:
    return S.custom_split(read(spark, d, "labels").select("doc_id"), lambda x: (x.where("doc_id % 7 <> 0"), x.where("doc_id % 7 = 0")))


@query(f"SELECT doc_id, (ntile(5) OVER (ORDER BY {_h('doc_id', 3)}, doc_id) - 1)::INT AS fold FROM labels")
def kfold(spark: SparkSession, d: str) -> DataFrame:
    return S.k_fold(read(spark, d, "labels").select("doc_id"), "doc_id", 5, 3)


@query(f"SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY {_h('doc_id', 4)}, doc_id) - 1) % 5)::INT AS fold FROM labels")
def stratified_kfold(spark: SparkSession, d: str) -> DataFrame:
    return S.stratified_k_fold(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 5, 4)


@query(
    f"""WITH f AS (SELECT doc_id, ntile(3) OVER (ORDER BY {_h('doc_id', 5)}, doc_id) - 1 AS o, ntile(2) OVER (ORDER BY {_h('doc_id', 6)}, doc_id) - 1 AS i FROM labels)
    SELECT doc_id, a::INT AS "outer", b::INT AS "inner", CASE WHEN o = a THEN 'test' WHEN i = b THEN 'dev' ELSE 'train' END AS part FROM f, range(3) x(a), range(2) y(b)"""
)
def nested_cv(spark: SparkSession, d: str) -> DataFrame:
    return S.nested_folds(read(spark, d, "labels").select("doc_id"), "doc_id", 3, 2, 5)


@query(
    " UNION ALL ".join(
        f"SELECT doc_id, {r} AS repeat, CASE WHEN row_number() OVER (ORDER BY {_h('doc_id', 10 + r)}, doc_id) <= ceil((SELECT count(*) FROM labels) * 0.2::DOUBLE) THEN 'dev' ELSE 'train' END AS split FROM labels"
        for r in range(3)
    )
)
def repeated_holdout(spark: SparkSession, d: str) -> DataFrame:
    return S.repeated_holdout(read(spark, d, "labels").select("doc_id"), "doc_id", 3, 0.2, 10)


@query(
    """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
    r AS (SELECT conv_id, n, sum(n) OVER (ORDER BY conv_id) AS running, sum(n) OVER () AS total FROM c)
    SELECT conv_id, n, least(4, (running - 1) // (total // 5))::INT AS fold FROM r"""
)
def qa_cv_balanced_docs(spark: SparkSession, d: str) -> DataFrame:
    counts = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return S.document_folds(counts, "conv_id", "n", 5)


@query(
    f"""WITH b AS (SELECT doc_id, quality, doc_id % 13 AS g, {_h('doc_id', 7)} AS h FROM labels),
    k AS (SELECT *, quality = 0 OR ('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1 AS keep FROM b),
    w AS (SELECT *, bool_or(keep) OVER (PARTITION BY g) AS any_kept, row_number() OVER (PARTITION BY g ORDER BY h, doc_id) AS r FROM k)
    SELECT doc_id, quality, g FROM w WHERE keep OR (NOT any_kept AND r = 1)"""
)
def downsample_negatives(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "labels").select("doc_id", "quality", (F.col("doc_id") % 13).alias("g"))
    return S.keep_negatives(df, "doc_id", ["g"], "quality = 0", 0.1, 7)


@query(
    f"""SELECT doc_id, quality, g FROM (SELECT doc_id, quality, doc_id % 13 AS g, row_number() OVER (PARTITION BY doc_id % 13, quality = 0 ORDER BY {_h('doc_id', 8)}, doc_id) AS r FROM labels)
    WHERE quality = 0 OR r <= 5"""
)
def neg_cap_per_group(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "labels").select("doc_id", "quality", (F.col("doc_id") % 13).alias("g"))
    return S.cap_negatives(df, "doc_id", ["g"], "quality = 0", 5, 8)


@query(f"SELECT doc_id FROM documents ORDER BY {_h('doc_id', 9)}, doc_id LIMIT 100")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_rows(read(spark, d, "documents").select("doc_id"), "doc_id", 100, 9)


@query(
    """WITH c AS (SELECT doc_id // 50 AS chunk, count(*) AS n FROM labels GROUP BY 1), r AS (SELECT chunk, sum(n) OVER (ORDER BY chunk) AS running, sum(n) OVER () AS total FROM c)
    SELECT doc_id, chunk, CASE WHEN running <= total - floor(total * 0.2::DOUBLE) THEN 'train' ELSE 'dev' END AS split FROM labels JOIN r ON chunk = doc_id // 50"""
)
def chunk_aligned_split(spark: SparkSession, d: str) -> DataFrame:
    return S.chunk_split(read(spark, d, "labels").select("doc_id", F.expr("doc_id div 50").alias("chunk")), "chunk", 0.2)


WINDOWS = f"""
SELECT doc_id, k::INT AS passage, (k * 32)::INT AS start_t, least(k * 32 + 64, len(t))::INT AS end_t, array_to_string(t[k * 32 + 1:k * 32 + 64], ' ') AS content
FROM (SELECT doc_id, {TOK} AS t FROM documents), range(0, greatest(0, ceil((len(t) - 64) / 32.0))::BIGINT + 1) r(k)"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", T.space_tokens(F.col("text")).alias("t"))
    return PS.passage_windows(docs, F.size("t"), 64, 32)


@query(WINDOWS)
def passage_windows(spark: SparkSession, d: str) -> DataFrame:
    content = F.array_join(F.slice("t", F.col("start_t") + 1, 64), " ")
    return _windows(spark, d).select("doc_id", "passage", "start_t", "end_t", content.alias("content"))


@query(
    r"""SELECT doc_id, k::INT AS passage, (list_sum(l[1:k * 32 + 1]) - length(regexp_extract(p[k * 32 + 1], '\S+')))::BIGINT AS start_ch, list_sum(l[1:k * 32 + 64])::BIGINT AS end_ch
    FROM (SELECT doc_id, p, list_transform(p, lambda x: length(x)) AS l FROM (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS p FROM documents)),
         range(0, greatest(0, ceil((len(p) - 64) / 32.0))::BIGINT + 1) r(k) WHERE len(p) > 0"""
)
def passage_char_spans(spark: SparkSession, d: str) -> DataFrame:
    docs = PS.with_offsets(read(spark, d, "documents").select("doc_id", "text"))
    return PS.passage_spans(docs, 64, 32).select("doc_id", "passage", "start_ch", "end_ch")


@query(f"SELECT doc_id, passage, (CASE WHEN passage % 3 = 0 THEN -1 ELSE passage % 3 + start_t END)::INT AS at FROM ({WINDOWS})")
def passage_to_document_index(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).select("doc_id", "passage", PS.to_document(F.col("passage") % 3, F.col("start_t")).alias("at"))


@query(f"""WITH o AS ({OFFSETS}) SELECT d.doc_id, (n_chars // 2) AS ch, (SELECT max(pos) FROM o WHERE o.doc_id = d.doc_id AND o.start <= n_chars // 2) AS token_pos FROM documents d""")
def char_to_token_asof(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return PS.as_of_tokens(docs.select("doc_id", F.expr("n_chars div 2").alias("ch")), token_offsets(docs))


ANSWERS = r"""
SELECT d.doc_id, b.item_id, instr(d.text, b.text) - 1 AS start_ch, instr(d.text, b.text) - 1 + length(b.text) AS end_ch, d.text AS text
FROM documents d, benchmark b WHERE contains(d.text, b.text) AND len(regexp_extract_all(b.text, '\S+')) >= 8"""


def find_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Verbatim finds of ``items(item_id, text)`` in documents: an equi-join on hashes of six inner words, then a comparison.

    An item may begin and end within a word, so only its inner words are sure to be words of the document; items of fewer than eight
    words are not searched.
    """
    words = T.space_tokens(F.col("text"))
    keyed = items.select("item_id", F.col("text").alias("item"), words.alias("w")).where(F.size("w") >= 8)
    keyed = keyed.select("item_id", "item", F.xxhash64(F.slice("w", 2, 6)).alias("key"))
    grams = docs.select("doc_id", T.space_tokens(F.col("text")).alias("t")).where(F.size("t") >= 6)
    grams = grams.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 5), lambda i: F.xxhash64(F.slice("t", i, 6)))).alias("key"))
    found = grams.join(keyed, "key").select("doc_id", "item_id", "item").distinct()
    out = found.join(docs.select("doc_id", "text"), "doc_id").withColumn("at", F.expr("instr(text, item)")).where("at > 0")
    return out.select("doc_id", "item_id", (F.col("at") - 1).alias("start_ch"), (F.col("at") - 1 + F.length("item")).alias("end_ch"), "text")


@query(f"SELECT doc_id, item_id, start_ch::BIGINT AS start_ch, end_ch::BIGINT AS end_ch FROM ({ANSWERS})")
def verbatim_answers(spark: SparkSession, d: str) -> DataFrame:
    found = find_passages(read(spark, d, "documents"), read(spark, d, "benchmark"))
    return found.select("doc_id", "item_id", F.col("start_ch").cast("long"), F.col("end_ch").cast("long"))


@query(
    f"""WITH a AS ({ANSWERS}), o AS ({OFFSETS}), w AS ({WINDOWS}),
    s AS (SELECT a.doc_id, item_id, (SELECT max(pos) FROM o WHERE o.doc_id = a.doc_id AND o.start <= a.start_ch) AS a_start,
                 (SELECT max(pos) FROM o WHERE o.doc_id = a.doc_id AND o.start <= a.end_ch - 1) + 1 AS a_end FROM a)
    SELECT s.doc_id, item_id, passage, a_start - start_t AS start_in, a_end - start_t AS end_in FROM s JOIN w ON w.doc_id = s.doc_id AND start_t <= a_start AND a_end <= end_t"""
)
def answer_in_passage_range_join(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    found = PS.with_offsets(find_passages(docs, read(spark, d, "benchmark")))
    a_end = PS.token_at(F.col("starts"), F.col("end_ch") - 1) + 1
    answers = found.select("doc_id", "item_id", PS.token_at(F.col("starts"), F.col("start_ch")).alias("a_start"), a_end.alias("a_end"))
    return PS.answers_in_passages(answers, _windows(spark, d).drop("t")).select("doc_id", "item_id", "passage", "start_in", "end_in")


@query(
    f"""SELECT doc_id, item_id, s::BIGINT AS ctx_start, (CASE WHEN end_ch - start_ch >= 100 THEN end_ch ELSE least(length(text), s + 100) END)::BIGINT AS ctx_end FROM (
      SELECT *, CASE WHEN end_ch - start_ch >= 100 THEN start_ch ELSE greatest(0, least(start_ch - (greatest(0, 100 - (end_ch - start_ch)) // 2), length(text) - 100)) END AS s FROM ({ANSWERS}))"""
)
def answer_context_window(spark: SparkSession, d: str) -> DataFrame:
    found = find_passages(read(spark, d, "documents"), read(spark, d, "benchmark"))
    a, b = PS.context_window(F.col("text"), F.col("start_ch"), F.col("end_ch"), 100)
    return found.select("doc_id", "item_id", a.cast("long").alias("ctx_start"), b.cast("long").alias("ctx_end"))


LINES = "SELECT doc_id, (i - 1)::INT AS line, l[i] AS sentence FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), range(1, len(l) + 1) r(i) WHERE l[i] <> ''"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "sentence")).where("sentence <> ''")


@query(f"SELECT * FROM (SELECT doc_id, line, sentence AS text, lead(sentence) OVER (PARTITION BY doc_id ORDER BY line) AS text_b FROM ({LINES})) WHERE text_b IS NOT NULL")
def sentence_pairs_next(spark: SparkSession, d: str) -> DataFrame:
    return PR.next_sentences(_lines(spark, d))


@query(
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_h('doc_id', 20)}, doc_id) AS rn, count(*) OVER () AS n FROM documents),
    w AS (SELECT doc_id, (rn - 1 + 1 + ('0x' || substr({_h('doc_id', 21)}, 1, 7))::BIGINT % (n - 1)) % n + 1 AS want FROM r)
    SELECT w.doc_id, r.doc_id AS partner FROM w JOIN r ON r.rn = w.want"""
)
def nsp_pairs_random_partner(spark: SparkSession, d: str) -> DataFrame:
    return PR.random_partners(read(spark, d, "documents"), "doc_id", 20)


def _draw(at: int, n: int = 7) -> str:
    return f"('0x' || substr(h, {at}, {n}))::BIGINT"


# pairs of at most 125 tokens: d has a document's pieces and their places, s walks its pairs, met finds the other documents' segments
PAIRS = rf"""WITH RECURSIVE l AS (SELECT doc_id, list(len(regexp_extract_all(sentence, '\S+')) ORDER BY line) AS n FROM ({LINES}) GROUP BY doc_id),
p AS (SELECT doc_id, flatten(list_transform(n, lambda x: list_concat(list_transform(range(x // 125), lambda i: 125), CASE WHEN x % 125 > 0 THEN [x % 125] ELSE [] END))) AS p FROM l),
d AS (SELECT doc_id, p, list_transform(range(0, len(p) + 1), lambda i: coalesce(list_sum(p[1:i]), 0)::BIGINT) AS c,
      row_number() OVER (ORDER BY {_h('doc_id', 1)}, doc_id) AS rn, count(*) OVER () AS n FROM p WHERE len(p) > 0),
s AS (SELECT doc_id, -1 AS pair, 0::BIGINT AS i, 0::BIGINT AS a_from, 0::BIGINT AS a_to, 0::BIGINT AS last, true AS is_next, '' AS h FROM d
  UNION ALL
  SELECT doc_id, pair + 1, CASE WHEN is_next OR j = i + 1 THEN j ELSE after END, c[i + 1], stop, c[j + 1], is_next, h
  FROM (SELECT *, CASE WHEN j = i + 1 THEN c[i + 1] + greatest(1, (c[j + 1] - c[i + 1]) // 2) ELSE c[after + 1] END AS stop,
               CASE WHEN j = i + 1 THEN c[j + 1] - c[i + 1] > 1 ELSE {_draw(8, 1)} % 2 = 0 END AS is_next
    FROM (SELECT *, CASE WHEN j > i + 1 THEN i + 1 + {_draw(1)} % (j - i - 1) END AS after
      FROM (SELECT s.doc_id, s.pair, s.i, c, s.i + len(list_filter(c[s.i + 2:], lambda x: x - c[s.i + 1] <= 125)) AS j, md5(s.doc_id || '-' || s.i || '-1') AS h
            FROM s JOIN d ON d.doc_id = s.doc_id WHERE s.i < len(d.p))))),
o AS (SELECT s.*, (d.rn + {_draw(9)} % greatest(d.n - 1, 1)) % d.n + 1 AS want, {_draw(16)} AS start, 125 - (a_to - a_from) AS room FROM s JOIN d USING (doc_id) WHERE pair >= 0),
met AS (SELECT o.doc_id, pair, a_from, a_to, is_next, d.doc_id AS other, d.c, d.p, room, (start % len(d.p))::BIGINT AS k FROM o JOIN d ON o.want = d.rn WHERE NOT is_next),
b AS (SELECT *, list_max(list_filter(c[k + 1:], lambda x: x - c[k + 1] <= room)) AS stop FROM met)
SELECT doc_id, pair, a_from, a_to, doc_id AS b_key, a_to AS b_from, last AS b_to, is_next FROM o WHERE is_next
UNION ALL
SELECT doc_id, pair, a_from, a_to, other, c[k + 1], CASE WHEN stop > c[k + 1] THEN stop ELSE c[k + 1] + least(p[k + 1], room) END, is_next FROM b"""


@query(PAIRS)
def bert_style_packing(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    docs = read(spark, d, "documents").select("doc_id", F.transform(lines, lambda x: F.size(T.space_tokens(x))).alias("sizes"))
    return PR.segment_pairs(docs, "doc_id", "sizes", 128, 1)


@query()
def mlm_whole_word_mask(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", T.space_tokens(F.col("text")).alias("words"))
    parts = lambda w: F.when(F.length(w) > 6, F.array(F.substring(w, 1, 6), F.substring(w, F.lit(7), F.length(w)))).otherwise(F.array(w))
    return PR.mask_documents(docs, parts, 2, 30000, 126, seed=3)


@query("SELECT DISTINCT part, count(*) OVER (PARTITION BY part) AS n FROM (SELECT floor((doc_id // 10)::DOUBLE)::BIGINT % 4 AS part FROM documents)")
def worker_slices(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id")
    parts = [S.worker_rows(docs, "doc_id", 10, w, 4).withColumn("part", F.lit(w).cast("long")) for w in range(4)]
    return reduce(DataFrame.unionByName, parts).groupBy("part").agg(F.count("*").alias("n"))


