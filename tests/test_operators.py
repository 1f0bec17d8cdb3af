"""Golden values and edge cases of operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import catalog
from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import fitting, labels, metrics, models, pairs, passages, qa, splits, tags
from textloom.operators.ranks import running_sums
from textloom.plans.processors import processor


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("a, b, n", [(10, 3, 8), (3, 10, 8), (5, 5, 7), (2, 2, 9), (0, 9, 4), (9, 0, 4), (6, 7, 0)])
def test_longest_first(spark, a, b, n):
    x, y = a, b
    while x + y > n:
        x, y = (x - 1, y) if x > y else (x, y - 1)
    ka, kb = T.pair_lengths(F.lit(a), F.lit(b), n)
    got = (one(spark, ka), one(spark, kb))
    assert sum(got) == x + y and abs(got[0] - x) <= 1


def test_truncation_strategies(spark):
    for name, want in (("only_first", (3, 5)), ("only_second", (6, 2))):
        a, b = T.pair_lengths(F.lit(6), F.lit(5), 8, name)
        assert (one(spark, a), one(spark, b)) == want
    with pytest.raises(ValueError):
        T.pair_lengths(F.lit(1), F.lit(1), 1, "none")


def test_answers_normalised(spark):
    assert one(spark, T.normalize_answer(F.lit("The  Eiffel-Tower, a landmark!"))) == "eiffeltower landmark"
    assert one(spark, T.normalize_answer(F.lit("  "))) == ""


def test_padding_specials_labels(spark):
    assert one(spark, T.pad(F.array(F.lit(1)), 3, F.lit(0), left=True)) == [0, 0, 1]
    assert one(spark, T.with_specials(F.array(F.lit("a")), F.array(F.lit("b")))) == ["[CLS]", "a", "[SEP]", "b", "[SEP]"]
    assert one(spark, T.expand_labels(F.array(F.lit("B"), F.lit("O")), F.array(*map(F.lit, [1, 0, 1])))) == ["B", "X", "O"]
    assert one(spark, T.initial_only(F.array(*map(F.lit, ["B", "X", "O"])), F.array(*map(F.lit, [1, 0, 1])))) == ["B", "O"]
    assert one(spark, T.label_index(F.lit("z"), ["a"])) is None
    assert one(spark, T.second_start(F.array(*map(F.lit, ["[CLS]", "a", "[SEP]", "b"])))) == 3


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.norm(a)) == 5 and one(spark, V.cosine(a, b)) is None and one(spark, V.cosine(a, a)) == 1
    assert one(spark, V.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))) == [0.5, 0.5]
    assert one(spark, V.argmax(F.array(F.lit(1.0), F.lit(1.0)))) == 0
    assert one(spark, V.linear(a, [[1, 0], [0, 2]], [1, 0])) == [4.0, 8.0]


def test_class_weights_smoothed(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "y string")
    got = {r["label"]: r["weight"] for r in labels.class_weights(df, "y", ["a", "b", "c"]).collect()}
    assert got == {"a": pytest.approx(7 / 12, abs=1e-6), "b": pytest.approx(7 / 6, abs=1e-6), "c": pytest.approx(7 / 3, abs=1e-6)}


def test_windows_cover(spark):
    for n in (0, 1, 64, 65, 96, 97, 200):
        w = sorted((r["start_t"], r["end_t"]) for r in passages.passage_windows(spark.range(1), F.lit(n), 64, 32).collect())
        assert w[0][0] == 0 and w[-1][1] == n and all(b[0] == a[0] + 32 for a, b in zip(w, w[1:], strict=False)) and all(e < n for _, e in w[:-1])
    with pytest.raises(ValueError):
        passages.passage_windows(spark.range(1), F.lit(1), 4, 0)


def test_metrics_on_empty_and_unknown(spark):
    empty = spark.createDataFrame([], "pred int, label int")
    assert metrics.accuracy(empty).first()["acc"] is None
    with pytest.raises(KeyError):
        metrics.compute_metrics("nope", empty)


def test_orphan_tags(spark):
    rows = [(1, i, t) for i, t in enumerate(["I-PER", "O", "B-LOC", "I-PER", "I-PER", "B-PER", "I-PER", "B-PER"])]
    df = spark.createDataFrame(rows, "seq long, pos int, tag string")
    assert sorted((r["kind"], r["start"], r["end"]) for r in tags.entities(df, "seq", "pos").collect()) == [("LOC", 2, 2), ("PER", 5, 6), ("PER", 7, 7)]


def test_spans(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 5.0, 0.0), (1, 2, 0.0, 6.0), (1, 3, 4.0, 5.0), (1, 9, 1.0, 4.0)], "sample long, pos int, start double, end double")
    best = qa.span_candidates(df, 10, 3)
    assert [(r["s"], r["e"]) for r in best.orderBy("rank").limit(2).collect()] == [(1, 2), (1, 3)]
    assert [(r["s"], r["e"]) for r in qa.distinct_spans(best, 2, 0).orderBy("place").collect()] == [(1, 2), (3, 3)]


def test_folds_are_disjoint_and_cover(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    folds = splits.k_fold(df, "k", 5, 1).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [20, 20, 21, 21, 21]
    nested = splits.nested_folds(df, "k", 3, 2, 1).groupBy("outer", "inner").count().collect()
    assert len(nested) == 6 and all(r["count"] == 103 for r in nested)


def test_stop_early(spark):
    rows = [(i, s) for i, s in enumerate([0.1, 0.5, 0.4, 0.45, 0.6])]
    got = [r["stop"] for r in models.stop_early(spark.createDataFrame(rows, "step int, score double"), "step", "score", 2).orderBy("step").collect()]
    assert got == [False, False, False, True, False]


def test_processors(spark):
    ner = spark.createDataFrame([(["Washington", "is"], ["B-LOC", "O"]), (["x"], ["B-ODD"])], "tokens array<string>, tags array<string>")
    got = processor("token_tags", labels=["B-LOC", "O"])(ner).collect()
    assert len(got) == 1 and got[0]["pieces"] == ["Washin", "gton", "is"] and got[0]["label_names"] == ["B-LOC", "X", "O"]
    pairs = spark.createDataFrame([("a b", "c", "yes"), ("a", "b", "odd")], "text string, text_b string, label string")
    row = processor("pair_classification", labels=["no", "yes"], size=8)(pairs).first()
    assert row["tokens"] == ["[CLS]", "a", "b", "[SEP]", "c", "[SEP]", "[PAD]", "[PAD]"] and row["segment_ids"] == [0, 0, 0, 0, 1, 1, 0, 0] and row["label_ids"] == 1
    nq = spark.createDataFrame([([f"w{i}" for i in range(50)], 20, 40, [(22, 24), (30, 31)], "none"), (["a"], -1, -1, [], "yes")], "words array<string>, long_start int, long_end int, short array<struct<start: int, end: int>>, yes_no string")
    got = processor("natural_questions", radius=5)(nq).collect()
    assert (got[0]["answer_type"], got[0]["shift"], got[0]["crop_start"], got[0]["crop_end"], len(got[0]["cropped"])) == ("span", 17, 5, 14, 19)
    assert got[1]["answer_type"] == "yes"
    dpr = spark.createDataFrame([("q", [("T", "p", "positive", "1")])], "query string, passages array<struct<title: string, text: string, label: string, external_id: string>>")
    row = processor("text_similarity", negatives=2)(dpr).first()
    assert row["label_ids"] == [1, 0, 0] and row["passage_tokens"] == [["T", "p"], [], []]


def test_expand_labels_edges_and_long_text(spark):
    ones = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")
    tags_ = F.array(F.lit("B"), F.lit("O"))
    assert one(spark, T.expand_labels(tags_, ones())) == []
    assert one(spark, T.expand_labels(tags_, ones(0, 0))) == ["X", "X"]
    assert one(spark, T.expand_labels(tags_, ones(0, 1, 0, 0, 1, 1, 0))) == ["X", "B", "X", "X", "O", "X", "X"]
    n = 200_000
    words = F.array_repeat(F.lit("B"), n)
    initial = F.flatten(F.array_repeat(F.array(F.lit(1), F.lit(0)), n))
    got = spark.range(1).select(words.alias("w"), initial.alias("m")).select(T.expand_labels(F.col("w"), F.col("m")).alias("x")).first()["x"]
    assert got == ["B", "X"] * n


def test_segment_pairs(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([0, 1, 3, 9, 30, 60]) for _ in range(rnd.randrange(12))]) for i in range(40)] + [(99, [300, 1, 125]), (1000001, [20] * 9), (2000001, [20] * 9)]
    tokens = {k: [f"{k}:{j}" for j in range(sum(n))] for k, n in rows}
    df = spark.createDataFrame([(k, n, tokens[k]) for k, n in rows], "k long, n array<int>, t array<string>")
    got = pairs.segment_pairs(df, "k", "n", 60, 1, ("t",)).collect()
    read, bare = {k: [] for k in tokens}, pairs.segment_pairs(df, "k", "n", 60, 1).collect()
    for r in sorted(got, key=lambda r: (r["k"], r["pair"])):
        assert r["a_t"] == tokens[r["k"]][r["a_from"] : r["a_to"]] and r["b_t"] == tokens[r["b_key"]][r["b_from"] : r["b_to"]]
        assert r["a_t"] and r["b_t"] and len(r["a_t"]) + len(r["b_t"]) <= 57
        assert r["is_next"] == (r["b_key"] == r["k"]) and (not r["is_next"] or r["b_from"] == r["a_to"])
        read[r["k"]] += r["a_t"] + (r["b_t"] if r["is_next"] else [])
    assert read == tokens
    assert sorted(tuple(r) for r in bare) == sorted(tuple(r)[:8] for r in got)
    assert 0.25 < sum(r["is_next"] for r in got) / len(got) < 0.9
    cuts = lambda k: [r["a_to"] for r in sorted(got, key=lambda r: r["pair"]) if r["k"] == k]
    assert cuts(1000001) != cuts(2000001)
    alone = pairs.segment_pairs(df.where("k = 99"), "k", "n", 60, 1).collect()
    assert {r["b_key"] for r in alone} == {99} and pairs.segment_pairs(df.limit(0), "k", "n", 60, 1).count() == 0


def test_all_passages_are_masked(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300)))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["mlm_whole_word_mask"](spark, str(tmp_path)).collect()
    assert {r["word"] for r in got} == set(range(300))
    masked = [sum(r["action"] != "keep" and r["passage"] == p for r in got) for p in range(3)]
    assert masked == [19, 19, 7]


def test_masks_within_rows(spark, tmp_path):
    rnd = random.Random(3)
    text = lambda n: " ".join("x" * rnd.choice([1, 3, 6, 7, 9]) + "é" * (rnd.random() < 0.2) + str(i) for i in range(n))
    rows = [(i, text(n)) for i, n in enumerate([0, 1, 2, 7, 125, 126, 127, 400, 260])] + [(50, None), (51, "  "), (None, text(40)), (None, "a b")]
    for more in ([], [(7, text(130)), (7, "one longerword"), (2, text(3))]):
        path = f"{tmp_path}/{len(more)}"
        spark.createDataFrame(rows + more, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        words = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("word", "w"))
        split = F.when(F.length("w") > 6, F.array(F.substring("w", 1, 6), F.expr("substring(w, 7)"))).otherwise(F.array("w"))
        tokens = words.withColumn("passage", F.floor(F.col("word") / 126).cast("int")).select("doc_id", "passage", "word", F.posexplode(split).alias("part", "token"))
        tokens = tokens.withColumn("pos", F.col("word") * 2 + F.col("part")).drop("part")
        want = pairs.mask_words(tokens, 30000, seed=3, sample=("doc_id", "passage"))
        got = catalog.QUERIES["mlm_whole_word_mask"](spark, path)
        assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        if not more:
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_running_sums_of_many_values(spark):
    rnd = random.Random(6)
    rows = [(rnd.gauss(0, 1), rnd.randint(0, 3)) for _ in range(3000)] + [(float("-inf"), 1), (float("inf"), 2)]
    df = spark.createDataFrame(rows, "x double, n long").repartition(5)
    total, want = 0, {}
    for x, n in sorted(rows):
        total += n
        want[x] = total
    assert {r["x"]: r["run"] for r in running_sums(df, "x", {"run": "n"}).collect()} == want
    assert running_sums(df.limit(0), "x", {"run": "n"}).collect() == []


def test_ranks_of_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double")
    assert {r["__v"]: r["r"] for r in metrics.average_ranks(df, "v", "r").collect()} == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


def test_softmax_and_temperature(spark):
    v = F.array(F.lit(1.0), F.lit(3.0))
    assert one(spark, V.temperature_scale(v, 2)) == [0.5, 1.5]
    assert one(spark, V.softmax(F.lit(None).cast("array<double>"))) is None
    with pytest.raises(ValueError):
        V.temperature_scale(v, 0)


def test_offsets_within_the_row(spark):
    df = spark.createDataFrame([(1, " a\u00a0b  c\n", 7), (2, None, 8), (3, "", 9)], "doc_id int, text string, tokens_before int")
    got = {r.doc_id: (r.tokens, r.starts, r.tokens_before) for r in passages.with_offsets(df).collect()}
    assert got == {1: (["a\u00a0b", "c"], [1, 6], 7), 2: ([], [], 8), 3: ([], [], 9)}
    spans = passages.passage_spans(passages.with_offsets(df), 1, 1).collect()
    assert sorted(tuple(r) for r in spans) == [(1, 0, 0, 1, 1, 4), (1, 1, 1, 2, 6, 7)]
    starts = F.array(F.lit(1), F.lit(6))
    assert [one(spark, passages.token_at(starts, F.lit(x))) for x in (0, 1, 5, 6)] == [None, 0, 0, 1]


def test_chunks_disjointness_limit(spark):
    df = spark.createDataFrame([(i, i // 4) for i in range(10)], "id int, chunk int")
    got = splits.chunk_split(df, "chunk", 0.3)
    assert {(r.chunk, r.split) for r in got.collect()} == {(0, "train"), (1, "dev"), (2, "dev")}
    with pytest.raises(ValueError):
        splits.chunk_split(df, "chunk", 0.0)
    splits.assert_disjoint(df.where("id < 5"), df.where("id >= 5"), ["id"])
    with pytest.raises(ValueError):
        splits.assert_disjoint(df, df.where("id = 3"), ["id", "chunk"])
    assert [r.id for r in splits.first_rows(df, "id", 2).collect()] == [0, 1]


def test_dominant_direction(spark):
    m = np.random.default_rng(5).normal(size=(40, 6)) + 2
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id int, v array<double>")
    axis = np.linalg.svd(m)[2][0]
    got = {r.id: r.v for r in models.without_dominant_direction(df, "id", "v").collect()}
    assert np.allclose([got[i] for i in range(40)], m - np.outer(m @ axis, axis))
    assert models.without_dominant_direction(df.limit(0), "id", "v").collect() == []


def test_reports(spark):
    df = spark.createDataFrame([(1, 1), (0, 1)], "pred int, label int")
    metrics.register_report("errors", lambda x: x.where("pred <> label"))
    assert metrics.compute_report("errors", df).count() == 1 and metrics.compute_report("classification", df).count() == 2
    with pytest.raises(KeyError):
        metrics.compute_report("unknown", df)


def test_extraction_strategies(spark):
    df = spark.createDataFrame([(1, [[1.0, 5.0], [3.0, 1.0], [9.0, 9.0]], [1, 1, 0]), (2, [], []), (3, None, None), (4, [[2.0, 2.0]], [0])], "k long, t array<array<double>>, m array<int>")
    want = {"per_token": {1: [[1.0, 5.0], [3.0, 1.0]], 2: [], 3: None, 4: []}, "cls_token": {1: [1.0, 5.0]}, "reduce_mean": {1: [2.0, 3.0]}, "reduce_max": {1: [3.0, 5.0]}}
    for name, rows in want.items():
        got = {r["k"]: r["v"] for r in df.select("k", V.extracted(F.col("t"), name, F.col("m")).alias("v")).collect()}
        assert got == {k: rows.get(k) for k in range(1, 5)}
    with pytest.raises(ValueError):
        V.extracted(F.col("t"), "s3e")


def test_names_paths_json(spark):
    assert [one(spark, T.model_language(F.lit(x))) for x in ("bert-base-german-cased", "umberto-x", "camembert", "xlm-multilingual-german", "roberta")] == ["german", "italian", "french", "german", "english"]
    assert tuple(one(spark, T.store_path(F.lit("s3://b/k/x.txt")))) == ("b", "k/x.txt") and one(spark, T.store_path(F.lit("s3://b"))) is None
    assert [one(spark, T.file_extension(F.lit(x))) for x in ("a/b.c/d.tar.gz", "x.json", "a.b/c")] == ["tar.gz", "json", ""]
    assert [one(spark, T.is_json(F.lit(x))) for x in ('{"a": [1]}', "{a", "3")] == [True, False, True]
    assert one(spark, T.transposed(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))))) == [[1, 3], [2, 4]]
    a = F.struct(F.array(F.lit("ab"), F.lit("c")).alias("tokens"), F.array(F.lit(0).cast("long"), F.lit(3).cast("long")).alias("offsets"), F.array(F.lit(1), F.lit(1)).alias("initial"))
    joined = one(spark, T.joined_sentences(F.array(a, a)))
    assert joined["tokens"] == ["ab", "c", "ab", "c"] and joined["offsets"] == [0, 3, 5, 8] and joined["initial"] == [1] * 4


def test_workers_runs_and_estimates(spark):
    rows = spark.range(103)
    parts = [{r["id"] for r in splits.worker_rows(rows, "id", 5, w, 3).collect()} for w in range(3)]
    assert set().union(*parts) == set(range(103)) and sum(map(len, parts)) == 103 and parts[1] >= {5, 9, 20}
    names = spark.createDataFrame([("epoch_1_step_900",), ("epoch_2_step_10",), ("epoch_2_step_9",), ("other",)], "name string")
    assert [r["name"] for r in fitting.latest_runs(names, "name", 2).collect()] == ["epoch_2_step_10", "epoch_2_step_9"]
    lines = spark.createDataFrame([(x,) for x in ["a", "b", "c", "", "d", " ", "e", "f"]], "value string")
    assert tuple(pairs.estimated_pairs(lines).first()) == (3, 3)
    scored = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.4), (2, 1, 0.0), (2, 3, 1.0)], "q long, rank int, f1 double")
    assert [metrics.top_n_accuracy(scored, "q", "f1", "rank", n).first()[0] for n in (1, 2, 3)] == [0.0, 0.5, 1.0]


def test_zip_of_files(spark, tmp_path):
    from textloom.sources import readers

    (tmp_path / "a.txt").write_text("\n".join(f"a{i}" for i in range(500)))
    (tmp_path / "b.txt").write_text("head\n" + "\n".join(f"b{i}" for i in range(503)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = sorted(tuple(r) for r in readers.zip_files(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt"), skip_right=1).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == [(i, f"a{i}" if i < 500 else None, f"b{i}") for i in range(503)]


@pytest.mark.parametrize("measure", ["dot", "cosine"])
def test_similar_in_blocks(spark, measure):
    from textloom.operators import ranking

    rnd = np.random.default_rng(3)
    v = rnd.integers(-3, 4, (130, 3)).astype(float)  # many ties
    v[7], v[20:60] = 0, v[20]
    rows = [(i, v[i].tolist()) for i in range(130)] + [(500, None)]
    items = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    queries = items.where("id % 10 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    got = ranking.similar(queries, items, 6, measure, query_rows=5, item_rows=17).collect()
    for q in range(0, 130, 10):
        s = v @ v[q]
        if measure == "cosine":
            size = np.linalg.norm(v, axis=1) * np.linalg.norm(v[q])
            s = np.where(size > 0, s / np.where(size > 0, size, 1), -np.inf)
        want = sorted((i for i in range(130) if i != q), key=lambda i: (-round(s[i], 4), i))[:6]
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == q] == want
    assert len(got) == 13 * 6 and ranking.similar(queries, items.limit(0), 6).count() == 0


def test_encode_rows(spark):
    from textloom.operators import vocab

    known = spark.createDataFrame([("a", 5), ("b", 6)], "token string, id int")
    df = spark.createDataFrame([(1, ["b", "x", None, "a", "a"]), (2, []), (3, None)], "k long, t array<string>")
    assert {r["k"]: r["ids"] for r in df.select("k", vocab.encode_rows(F.col("t"), known).alias("ids")).collect()} == {1: [6, 1, 1, 5, 5], 2: [], 3: []}
    assert df.select(vocab.encode_rows(F.col("t"), known.limit(0)).alias("ids")).first()["ids"] == [1] * 5


def test_no_answer_ties_with_a_span_to_six_digits(spark):
    # 9.6 - 7.0 is 2.5999999999999996, which ties with 2.6
    cand = spark.createDataFrame([("d", 0, 0, 1, 2, 9.6), ("d", 0, 1, 3, 4, 2.6), ("d", 0, 1, None, None, 2.6)], "doc string, question int, passage int, start int, end int, score double")
    none = spark.createDataFrame([("d", 0, 0, 2.6)], "doc string, question int, passage int, score double")
    assert 9.6 - 7.0 != 2.6
    out = {r["rank"]: r["start"] for r in qa.document_answers(cand, none, 4).collect()}
    assert out == {1: 1, 2: -1, 3: 3, 4: None}


def test_similar_by_slices_of_a_block(spark, monkeypatch):
    from textloom.operators import ranking

    rnd = np.random.default_rng(3)
    v = rnd.integers(-3, 4, (40, 4)).astype(float).tolist()
    items = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>")
    queries = items.where("id % 3 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    rows = lambda: sorted(tuple(r) for r in ranking.similar(queries, items, 5, "cosine").select("qid", "id", "rank").collect())
    whole = rows()
    monkeypatch.setattr(ranking, "SLICE", 3)
    assert rows() == whole and len(whole) == 14 * 5 and all(q != i for q, i, _ in whole)


@pytest.mark.parametrize("kind", ["plain", "ties", "large", "zeros"])
def test_likely_pairs_hold_the_best(monkeypatch, kind):
    from textloom.operators import ranking

    monkeypatch.setattr(ranking, "PIECE", 16)
    rnd = np.random.default_rng(8)
    x, y = rnd.normal(size=(9, 5)), rnd.normal(size=(150, 5))
    if kind == "ties":
        x, y = np.round(x), np.round(y)
    if kind == "large":
        x, y = x * 1e18, y * 1e20
    if kind == "zeros":
        y[10:60] = 0
    for n in (1, 4, 20):
        left_out, unused = [(2, [0, 17, 149]), (5, [3])], np.array([4, 5, 120])
        row, col = ranking._likely(x, y, n, left_out, unused)
        for r in range(9):
            own = [i for i in range(150) if i not in unused and i not in dict(left_out).get(r, [])]
            s = {i: float(x[r] @ y[i]) for i in own}
            least = sorted(s.values())[-n]
            got = set(col[row == r].tolist())
            assert {i for i in own if s[i] >= least - 1e-4} <= got <= set(own)
            assert kind != "plain" or len(got) <= n + 2
    monkeypatch.setattr(ranking, "PAIRS", 10)
    assert ranking._likely(x, y, 4, [], np.zeros(0, int)) is None
