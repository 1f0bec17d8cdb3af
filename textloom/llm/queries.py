"""The queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, cotraining, fim, fingerprints, fm_index, line_dedup, mixing, pivot_index, ppm, repair, risk_rules, shingle_join, warc
from textloom.llm.common import grown, new_path, read


def op1_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk_rules.apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_RATIOS = {
    "symbols": "n_symbols::DOUBLE / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines::DOUBLE / greatest(n_lines, 1)",
    "repeats": "n_repeat_words::DOUBLE / greatest(n_words, 1)",
    "upper": "n_upper::DOUBLE / greatest(n_words, 1)",
}
_GRID = ", ".join(f"('{r}', {j}, {c}::DOUBLE)" for r, (_, cuts) in risk_rules.RULES.items() for j, c in enumerate(cuts))
_VALUES = " UNION ALL ".join(f"SELECT doc_id, lang, '{r}' AS rule, {x} AS v FROM counts" for r, x in _RATIOS.items())

OP1_SQL = rf"""
WITH w AS (SELECT doc_id, i, v[i] AS w FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS v FROM documents), range(1, len(v) + 1) r(i)),
t AS (SELECT doc_id, i, w, w || ' ' || lead(w) OVER d || ' ' || lead(w, 2) OVER d AS t FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM t WHERE t IS NOT NULL), range(3) x(k) WHERE c > 1 GROUP BY doc_id),
ws AS (SELECT doc_id, count(*) AS n, sum((regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]'))::INT) AS up FROM w GROUP BY doc_id),
l AS (SELECT doc_id, l[i] AS line, row_number() OVER (PARTITION BY doc_id, l[i] ORDER BY i) AS r FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), range(1, len(l) + 1) r(i)),
ls AS (SELECT doc_id, count(*) AS n, sum((r > 1)::INT) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, lang, coalesce(ws.n, 0)::BIGINT AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(ls.n, 0)::BIGINT AS n_lines, coalesce(up, 0)::BIGINT AS n_upper
  FROM documents d LEFT JOIN ws USING (doc_id) LEFT JOIN ls USING (doc_id) LEFT JOIN rep USING (doc_id)),
vals AS ({_VALUES}),
grid(rule, j, cut) AS (VALUES {_GRID}),
known AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT x.lang, rule, v, q > 0 AS good FROM (SELECT DISTINCT * FROM vals) x JOIN known USING (doc_id)),
tests AS (
  SELECT lang, rule, j, cut, count(*) FILTER (good) AS n, count(*) FILTER (good AND v > cut) AS lost, count(*) FILTER (NOT good AND v > cut) AS won
  FROM held JOIN grid USING (rule) GROUP BY ALL),
p AS (
  SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.0125) + (n - i) * ln(1 - 0.0125))) FROM range(lost + 1) r(i)) AS p,
         0.05 / (4 * (SELECT count(DISTINCT coalesce('x' || lang, '')) FROM held)) AS level FROM tests WHERE n > 0),
ok AS (SELECT *, bool_and(p <= level AND lost < n) OVER (PARTITION BY lang, rule ORDER BY j) AS ok FROM p),
best AS (SELECT lang, rule, arg_max(cut, (won - 5 * lost, -j)) AS cut FROM ok WHERE ok AND won - 5 * lost > 0 GROUP BY lang, rule),
bad AS (SELECT DISTINCT doc_id FROM vals JOIN best ON vals.lang IS NOT DISTINCT FROM best.lang AND vals.rule = best.rule AND v > cut),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_pages(read(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path).where("kind = 'record'")
    return found.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT *, translate(array_to_string([to_base(('0x' || substr(h, i, 5))::BIGINT, 32, 4) FOR i IN [1, 6, 11, 16, 21, 26, 31, 36]], ''),
                      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
         min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d
"""


def op3_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pivot_index.top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return out.withColumn("score", F.col("score").cast("long"))


OP3_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
  FROM e q JOIN e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op4_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.dedup_substrings(read(spark, sf_dir, "documents")).drop("kept_text")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^ 	-
]+'), []) AS v FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(v[i:i + 12], ' ')) AS g FROM w, range(1, len(v) - 11) r(i)),
m AS (SELECT g, min(doc_id) AS first FROM p GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM p JOIN m USING (g), range(13) x(k) WHERE first < doc_id),
words AS (SELECT doc_id, i, v[i] AS word FROM w, range(1, len(v) + 1) r(i)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(v)::BIGINT AS n_words, (len(v) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def op5_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.components(read(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS v FROM documents),
s AS (
  SELECT doc_id, CASE WHEN v IS NULL OR len(v) = 0 THEN [] WHEN len(v) < 5 THEN [array_to_string(v, ' ')]
    ELSE list_distinct(list_transform(range(1, len(v) - 3), lambda i: array_to_string(v[i:i + 4], ' '))) END AS v FROM w),
e AS (SELECT doc_id, len(v) AS n, unnest(v) AS x FROM s),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS c
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * c >= 80 * (an + bn - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, len(v)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = s.doc_id) AS component_id FROM s
"""


def op7_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_texts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(read(spark, sf_dir, "documents"), contexts="text")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id AS d, i, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), range(1, len(l) + 1) r(i)),
firsts AS (SELECT line, min((d, i)) AS f FROM lines GROUP BY line),
sets AS (
  SELECT line, f, v, len(v) AS n FROM (SELECT line, f, list_distinct(regexp_extract_all(line, '[^ 	-
]+')) AS v FROM firsts) WHERE len(v) >= 1),
words AS (SELECT f, n, unnest(v) AS w FROM sets),
common AS (
  SELECT x.f, x.n AS xn, y.n AS yn, count(*) AS c
  FROM words x JOIN words y ON x.w = y.w AND y.f < x.f AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.f, y.f, x.n, y.n),
near AS (SELECT DISTINCT f FROM common WHERE 100 * c >= 80 * (xn + yn - c)),
marked AS (
  SELECT l.d, l.i, l.line, s.f IS NOT NULL AND (s.f < (l.d, l.i) OR s.f IN (SELECT f FROM near)) AS gone
  FROM lines l LEFT JOIN sets s ON l.line = s.line),
kept AS (
  SELECT d, count(*)::INT AS n_lines, count(*) FILTER (gone)::INT AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY d)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept ON doc_id = d
"""


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/8'), 1, 2))::BIGINT % 16 AS h
  FROM documents),
classed AS (
  SELECT *, CASE WHEN size >= 32 THEN length(bin(size)) * 32 + ((size >> (length(bin(size)) - 5)::BIGINT) & 15) ELSE size END AS c FROM sized),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM classed GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w FROM sizes),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, source IS NULL, source) AS k FROM weighted),
levels AS (
  SELECT a.source, a.source_size, a.w, a.k,
         (SELECT sum(source_size) FROM ranked) - coalesce(sum(b.source_size) FILTER (b.k < a.k), 0) * 3 AS rest,
         (SELECT sum(w) FROM ranked) - coalesce(sum(b.w) FILTER (b.k < a.k), 0) AS weight
  FROM ranked a CROSS JOIN ranked b GROUP BY ALL),
level AS (
  SELECT arg_min(rest, k) AS rest, arg_min(weight, k) AS weight, min(k) AS k FROM levels
  WHERE source_size > 0 AND source_size * 3 * weight >= w * rest),
targets AS (
  SELECT s.source, s.source_size,
         CASE WHEN l.k IS NULL OR s.k < l.k THEN s.source_size * 3.0::DOUBLE ELSE (s.w * l.rest)::DOUBLE / l.weight::DOUBLE END AS target,
         ('0x' || substr(md5(coalesce('s' || s.source, 'n') || '/8'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM ranked s CROSS JOIN level l),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END::DOUBLE AS r,
         row_number() OVER (PARTITION BY d.source ORDER BY d.c, d.h, d.doc_id NULLS FIRST, d.size) AS n
  FROM classed d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(n * r + u) - floor((n - 1) * r + u))::BIGINT * size AS taken FROM placed
"""


def op11_bloom_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_with_next(read(spark, sf_dir, "documents")).drop("edited_cells", "next_cells")


def _place(j: int) -> str:
    """A digest's place in a table of the sketch (j < 3), or its check."""
    a, b, c = fingerprints.MIX[j]
    x = f"((key >> 32) * {a}::UBIGINT + (key & 4294967295::UBIGINT) * {b}::UBIGINT)"
    mixed = f"((xor({x} >> 32, {x} & 4294967295::UBIGINT) * {c}::UBIGINT) >> 16)"
    return f"({mixed} & 4294967295::UBIGINT)" if j == 3 else f"({mixed} & {fingerprints.SIZE - 1}::UBIGINT)::BIGINT + {j * fingerprints.SIZE}"


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n FROM documents),
x AS (
  SELECT *, coalesce(lead(t) OVER o, first_value(t) OVER o) AS nt, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id
  FROM d WINDOW o AS (ORDER BY doc_id DESC)),
e AS (SELECT *, substr(t, 1, n - n // 2) || substr(nt, 1, n // 2) AS et FROM x),
v AS (SELECT doc_id, 0 AS k, t FROM e UNION ALL SELECT doc_id, 1, et FROM e),
s AS (SELECT doc_id, k, unnest(regexp_extract_all(t, '[^\n.!?]*[\n.!?]+|[^\n.!?]+')) AS p FROM v),
w AS (SELECT doc_id, k, regexp_extract_all(p, '[^\x20\x09-\x0D]+') AS w FROM s),
c AS (SELECT doc_id, k, array_to_string(w[i + 1:i + {fingerprints.LONGEST}], ' ') AS p FROM w, range(0, len(w), {fingerprints.LONGEST}) r(i)),
o AS (SELECT doc_id, k, ('0x' || substr(md5(row_number() OVER (PARTITION BY doc_id, k, p) || ':' || p), 1, 16))::UBIGINT AS key FROM c),
cells AS (
  SELECT doc_id, k, key, {_place(3)} AS chk, unnest([{_place(0)}, {_place(1)}, {_place(2)}]) AS cell FROM o),
sums AS (
  SELECT doc_id, k, cell, count(*) AS n, (sum(key::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT AS key, (sum(chk::HUGEINT) % 4294967296::HUGEINT)::UBIGINT AS chk
  FROM cells GROUP BY ALL),
fp AS (
  SELECT v.doc_id, v.k, string_agg(format('{{:08x}}{{:016x}}{{:08x}}', coalesce(sums.n, 0), coalesce(key, 0::UBIGINT), coalesce(chk, 0::UBIGINT)), '' ORDER BY r.cell) AS f
  FROM v CROSS JOIN range({3 * fingerprints.SIZE}) r(cell) LEFT JOIN sums ON v.doc_id = sums.doc_id AND v.k = sums.k AND r.cell = sums.cell GROUP BY ALL),
m AS (SELECT doc_id, k, count(*) AS m FROM o GROUP BY ALL),
pairs AS (SELECT doc_id, doc_id AS other, 1 AS k FROM x UNION ALL SELECT doc_id, next_id, 0 FROM x),
shared AS (
  SELECT p.doc_id, p.k, count(*) AS c FROM pairs p JOIN o a ON a.doc_id = p.doc_id AND a.k = 0 JOIN o b ON b.doc_id = p.other AND b.k = p.k AND a.key = b.key GROUP BY ALL),
near AS (
  SELECT p.doc_id, p.k, CASE WHEN a.m IS NULL AND b.m IS NULL THEN 1 ELSE coalesce(c, 0)::DOUBLE / (coalesce(a.m, 0) + coalesce(b.m, 0) - coalesce(c, 0)) END AS near
  FROM pairs p LEFT JOIN m a ON a.doc_id = p.doc_id AND a.k = 0 LEFT JOIN m b ON b.doc_id = p.other AND b.k = p.k LEFT JOIN shared s ON s.doc_id = p.doc_id AND s.k = p.k)
SELECT e.doc_id, n AS n_chars, sha256(et) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint, y.near AS near_edited, z.near AS near_next
FROM e JOIN fp a ON a.doc_id = e.doc_id AND a.k = 0 JOIN fp b ON b.doc_id = e.doc_id AND b.k = 1
JOIN near y ON y.doc_id = e.doc_id AND y.k = 1 JOIN near z ON z.doc_id = e.doc_id AND z.k = 0
"""


def op12_dial_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    found = repair.report(repair.damage(rows)).withColumnRenamed("conv_id", "c")
    out = rows.select("conv_id").distinct().join(grown(found), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zeros = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _edit(letter: str, cost: str, state: str, line: str) -> str:
    """A state's best (cost in ten digits, audit, separator, lines) with one more edit."""
    return f"printf('%010d', substr({state}, 1, 10)::BIGINT + {cost}) || replace(substr({state}, 11), chr(1), '{letter}' || chr(1)) || {line}"


def _inserted(best: str, line: str) -> str:
    return _edit("I", "5", best, f"chr(10) || '{line}:'")


def _step(*ways: str) -> str:
    return f"least({', '.join(ways)})"


_STAY = "CASE WHEN fault = 0 THEN 0 WHEN fault = 1 THEN 5 ELSE 1000000000 END"
_KEEP = lambda initial, state: _edit("K", f"(CASE WHEN i0 = '{initial}' THEN {_STAY} ELSE 1000000000 END)", state, "chr(10) || line")
_ROLE = lambda name, state: _edit("R", f"(1 + {_STAY})", state, f"chr(10) || '{name}:' || text")
_GONE = lambda state: _edit("D", "2", state, "''")

# the cheapest edits up to each row, by the last role: n(one), s(ystem), u(ser), a(ssistant); iu and ia with insertions before the row
OP12_SQL = rf"""
WITH RECURSIVE damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text, c
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s,
               xor(list_reduce(list_transform(range(1, 1 + length(s)), lambda i: ascii(substr(s, i, 1))::BIGINT),
                 lambda crc, b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, b)), 4294967295), 4294967295) % 20 AS fate
        FROM conversations), range(2) r(c)
  WHERE fate <> 0 AND (c = 0 OR fate = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(role, 1, 16), substr(text, 1, 64), md5(role || ':' || text)) AS i, substr(role, 1, 1) AS i0, role || ':' || text AS line FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3
                 WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 0 ELSE 1 END AS fault,
         lag(i0) OVER (PARTITION BY conv_id ORDER BY i) || i0 AS pair
  FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate,
         count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows
  FROM faulty GROUP BY conv_id),
best AS (
  SELECT DISTINCT conv_id, 0 AS i, '0000000000' || chr(1) AS n, '1000000000' || chr(1) AS s, '1000000000' || chr(1) AS u, '1000000000' || chr(1) AS a FROM faulty
  UNION ALL
  SELECT conv_id, i, {_GONE('n')}, {_step(_GONE('s'), _KEEP('s', 'n'))},
         {_step(_GONE('iu'), *(f(x, st) for f, x in ((_KEEP, 'u'), (_ROLE, 'user')) for st in ('n', 's', 'ia')))},
         {_step(_GONE('ia'), _KEEP('a', 'iu'), _ROLE('assistant', 'iu'))}
  FROM (
    SELECT f.conv_id, f.i, n, s, iu, {_step('a', _inserted('iu', 'assistant'))} AS ia, i0, fault, line, text
    FROM (SELECT *, {_step('u', *(_inserted(x, 'user') for x in 'nsa'))} AS iu FROM best) b JOIN faulty f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = b.i + 1)),
ends AS (
  SELECT conv_id, i, {_step('n', 'a', _inserted('iu', 'assistant'))} AS e FROM (SELECT *, {_step('u', *(_inserted(x, 'user') for x in 'nsa'))} AS iu FROM best)),
found AS (SELECT f.*, e FROM facts f JOIN ends ON f.conv_id IS NOT DISTINCT FROM ends.conv_id AND f.rows = ends.i)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(substr(e, 1, 10)::BIGINT, 0) AS cost, coalesce(substr(e, 11, position(chr(1) IN e) - 11), '') AS audit,
       sha256(coalesce(substr(e, position(chr(1) IN e) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN found ON c.conv_id IS NOT DISTINCT FROM found.conv_id
"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(read(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(x, i, 8))::BIGINT) AS h FROM d),
c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, '<P>' || substr(t, 1, a) AS p, '<S>' || substr(t, b + 1) AS s, '<M>' || substr(t, a + 1, b - a) AS m FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_risk_rules": op1_risk_rules,
    "op2_warc": op2_warc,
    "op3_pivot_top_k": op3_pivot_top_k,
    "op4_fm_index": op4_fm_index,
    "op5_cotraining": op5_cotraining,
    "op6_shingle_join": op6_shingle_join,
    "op7_tree_bpe": op7_tree_bpe,
    "op8_systematic_mix": op8_systematic_mix,
    "op9_ppm": op9_ppm,
    "op10_line_dedup": op10_line_dedup,
    "op11_bloom_sketch": op11_bloom_sketch,
    "op12_dial_repair": op12_dial_repair,
    "op13_fill_middle": op13_fill_middle,
}

SQL: dict[str, str] = {
    "op1_risk_rules": OP1_SQL, "op2_warc": OP2_SQL, "op3_pivot_top_k": OP3_SQL, "op4_fm_index": OP4_SQL, "op6_shingle_join": OP6_SQL, "op8_systematic_mix": OP8_SQL, "op10_line_dedup": OP10_SQL,
    "op11_bloom_sketch": OP11_SQL, "op12_dial_repair": OP12_SQL, "op13_fill_middle": OP13_SQL}
