"""Trained models and scores: taggers, heads, towers, validation, calibration, tokenizer families, SQL functions."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import subwords, tables
from textloom.functions import tokenizers as K
from textloom.operators import calibration, fitting, heads, models, ranking, retrieval, splits, tagging, tags, validation

LABELS = ["O", "B-PER", "I-PER", "B-LOC", "I-LOC"]


def test_viterbi_is_the_best_path():
    rnd = np.random.default_rng(1)
    allowed = tagging.iob_transitions(LABELS)
    for n in range(1, 6):
        e, t = rnd.integers(-5, 6, (n, 5)).astype(float), rnd.integers(-3, 4, (6, 5)) + allowed
        total = lambda p: t[-1, p[0]] + sum(t[a, b] for a, b in itertools.pairwise(p)) + sum(e[i, k] for i, k in enumerate(p))  # noqa: B023, E731
        best = max(map(total, itertools.product(range(5), repeat=n)))
        path = tagging.viterbi(e, t)
        assert total(path) == best and best > -1e6
    assert tagging.viterbi(np.zeros((0, 5)), allowed) == []
    assert allowed[LABELS.index("O"), 2] == allowed[-1, 4] == allowed[1, 4] == tagging.FORBIDDEN and allowed[1, 2] == allowed[2, 2] == 0


def sentences(n, seed):
    """Names follow a title and places follow ``in``; the words themselves tell little."""
    rnd = random.Random(seed)
    plain = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        tokens, tags_ = [], []
        for _ in range(rnd.randrange(1, 4)):
            for _ in range(rnd.randrange(4)):
                tokens.append(rnd.choice(plain))
                tags_.append("O")
            kind, cue = rnd.choice([("PER", "mr"), ("LOC", "in")])
            size = rnd.randrange(1, 4)
            tokens += [cue, *[f"Z{rnd.randrange(500)}" for _ in range(size)], "."]
            tags_ += ["O", f"B-{kind}", *[f"I-{kind}"] * (size - 1), "O"]
        rows.append((i, tokens, tags_))
    return rows


def test_tagger_learns_structure(spark, tmp_path):
    schema = "id long, tokens array<string>, tags array<string>"
    train = spark.createDataFrame([*sentences(400, 1), (-1, None, None), (-2, ["a"], None), (-3, [], []), (-4, ["a", "b"], ["O"])], schema).repartition(3)
    held = spark.createDataFrame(sentences(120, 2), schema)
    model = tagging.fit_tagger(train, "id", LABELS, width=1 << 12, rounds=4, shards=3)
    scored = tagging.tag(model, held)
    flat = lambda df, c: df.select("id", F.posexplode(c).alias("pos", "tag"))
    gold = tags.entities(flat(scored, "tags"), "id", "pos")
    f1 = tags.entity_f1(tags.entities(flat(scored, "preds"), "id", "pos"), gold, "id").first()["f1"]
    # the most frequent tag of each word of the training rows
    words = flat(train, F.arrays_zip("tokens", "tags")).select(F.col("tag.tokens").alias("w"), F.col("tag.tags").alias("t")).where("t IS NOT NULL")
    common = words.groupBy("w").agg(F.mode("t").alias("t"))
    base = held.select("id", F.posexplode("tokens").alias("pos", "w")).join(common, "w", "left").select("id", "pos", F.coalesce("t", F.lit("O")).alias("tag"))
    f1_base = tags.entity_f1(tags.entities(base, "id", "pos"), gold, "id").first()["f1"]
    assert f1 > 0.95 and f1 > f1_base + 0.2
    again = tagging.fit_tagger(train.repartition(7), "id", LABELS, width=1 << 12, rounds=4, shards=3)
    assert np.allclose(again.words, model.words)
    model.save(spark, f"{tmp_path}/tagger")
    kept = tagging.Tagger.load(spark, f"{tmp_path}/tagger")
    assert kept.labels == LABELS and np.allclose(kept.words, model.words) and np.allclose(kept.steps, model.steps)
    odd = tagging.tag(model, spark.createDataFrame([(1, [None, "mr", "Z1"], "x"), (2, [], "x"), (3, None, "x")], "id long, tokens array<string>, tags string"))
    assert {r["id"]: r["preds"] for r in odd.collect()} == {1: ["O", "O", "B-PER"], 2: [], 3: None}
    with pytest.raises(Exception, match="B-ORG"):
        tagging.fit_tagger(spark.createDataFrame([(1, ["a"], ["B-ORG"])], schema), "id", LABELS, rounds=1)


def test_empty_fits(spark):
    none = spark.createDataFrame([], "id long, tokens array<string>, tags array<string>, q string, p string")
    assert not tagging.fit_tagger(none, "id", LABELS, width=64).words.any()
    assert retrieval.fit_towers(none, "id", "q", "p", width=64, size=4).query.shape == (64, 4)


def test_mean_change_weighs_shards(spark):
    rows = fitting.dealt(spark.range(100), "id", 3)

    def work(it, params):
        n = sum(b.num_rows for b in it)
        return {"x": np.full(300, float(n)), "mean_x": np.eye(1, 300)[0]}, float(n)

    change, total = fitting.mean_change(rows, {"x": np.zeros(300)}, work)
    sizes = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert total == 100 and np.allclose(change["x"], sum(n * n for n in sizes) / 100) and np.allclose(change["mean_x"], np.eye(1, 300)[0])


# heads


def _table(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)], [[rnd.gauss(0, 1) for _ in range(4)] for _ in range(i % 4)], rnd.choice(["a", "b", None, "zz"]), float(i), [rnd.choice("xy")] * (i % 4)) for i in range(60)]
    return spark.createDataFrame([*rows, (60, None, None, None, None, None)], "id long, v array<double>, t array<array<double>>, label string, y double, marks array<string>"), rows


def _encoder(b):
    vectors = [r or [0.0] * 4 for r in b.column("v").to_pylist()]
    return {"per_sequence": np.array(vectors).reshape(-1, 4), "per_token": [np.array(t or []).reshape(-1, 4) for t in b.column("t").to_pylist()]}


def test_heads_share_a_pass(spark):
    df, rows = _table(spark)
    w = np.arange(8.0).reshape(2, 4) / 8
    made = [heads.make_head("classification", "kind", w, [0.1, 0]), heads.make_head("regression", "size", w[:1], 1.0, share=2.0), heads.make_head("token_classification", "marks", w, [0, 0]), heads.make_head("multilabel", "many", w, [0, 0])]
    tasks = {"kind": heads.Task(["a", "b"], "label"), "size": heads.Task((5.0, 2.0), "y"), "marks": heads.Task(["x", "y"], "marks"), "many": heads.Task(["m", "n"], "marks")}
    out = heads.score(df, ["id"], ["v", "t"], _encoder, heads.bind(made, tasks))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    got = {r["id"]: r for r in out.collect()}
    for i, v, t, label, y, marks in rows:
        r = got[i]
        z = w @ v + [0.1, 0]
        assert r["kind"]["label"] == "ab"[int(z.argmax())]
        lse = math.log(sum(math.exp(x) for x in z))
        loss = lse - z["ab".index(label)] if label in ("a", "b") else None
        assert r["kind"]["loss"] == (None if loss is None else pytest.approx(loss))
        value = w[0] @ v + 1
        assert r["size"]["value"] == pytest.approx(value * 2 + 5) and r["size"]["loss"] == pytest.approx((value - (y - 5) / 2) ** 2)
        assert r["marks"]["label"] == ["xy"[int((w @ x).argmax())] for x in t] and len(r["marks"]["probability"]) == len(marks)
        parts = [(r[n]["loss"], s) for n, s in (("kind", 1), ("size", 2), ("marks", 1), ("many", 1)) if r[n]["loss"] is not None]
        assert r["loss"] == pytest.approx(sum(a * b for a, b in parts))
    assert got[60]["kind"]["loss"] is None and got[60]["size"]["loss"] is None
    most = heads.score(df, ["id"], ["v", "t"], _encoder, heads.bind(made[:2], tasks), aggregate=lambda losses, shares: max(losses.values()))
    assert all(r["loss"] == max(x for x in (r["kind"]["loss"], r["size"]["loss"]) if x is not None) for r in most.where("id < 60").collect())


def test_binding_fails_early():
    head = heads.make_head("classification", "kind", np.zeros((2, 4)), [0, 0])
    task = heads.Task(["a", "b"], "label")
    assert heads.bind([head], {"kind": task})[0].labels == ["a", "b"]
    for bad, tasks in (
        ([head, head], {"kind": task}), ([head], {"other": task}), ([head], {"kind": heads.Task([])}), ([head], {"kind": heads.Task(["a"])}),
        ([heads.make_head("classification", "kind", np.zeros((2, 4)), [0, 0], output="per_page")], {"kind": task}),
    ):
        with pytest.raises(ValueError):
            heads.bind(bad, tasks)
    with pytest.raises(ValueError):
        heads.make_head("poetry", "kind", [[0.0]], [0])
    both = heads.bind([head, heads.make_head("classification", "next", np.zeros((2, 4)), [0, 0])], {"kind": task}, optional=["next"])
    assert [h.task for h in both] == ["kind"]
    assert heads.bind([head], {"kind": heads.Task([])}, require_labels=False)


def test_own_head_and_fit(spark):
    class Sign(heads.Head):
        result = "label string, loss double"

        def rows(self, x, labels):
            return [{"label": "+" if v > 0 else "-", "loss": None} for v in self.logits(x)[:, 0]]

    heads.register_head("sign", Sign)
    df, rows = _table(spark)
    own = heads.bind([heads.make_head("sign", "s", np.eye(4)[:1], [0])], {"s": heads.Task(["+"])})
    got = {r["id"]: r["s"]["label"] for r in heads.score(df, ["id"], ["v", "t"], _encoder, own).collect()}
    assert all(got[r[0]] == ("+" if r[1][0] > 0 else "-") for r in rows)
    df = df.where("v IS NOT NULL").withColumn("label", F.when(F.col("v")[0] + F.col("v")[1] > 0, "p").otherwise("n")).withColumn("y", 3 * F.col("v")[2] + 7)
    tasks = {"sign": heads.Task(["n", "p"], "label"), "y": heads.Task((7.0, 2.0), "y")}
    fitted = heads.fit_heads(df, "v", {"sign": ("classification", tasks["sign"]), "y": ("regression", tasks["y"])}, reg=0.001)
    out = heads.score(df.withColumn("y0", F.col("y")), ["id", "label", "y0"], ["v"], heads.vector_encoder("v"), heads.bind(fitted, tasks))
    r = out.agg(F.avg((F.col("sign.label") == F.col("label")).cast("double")).alias("acc"), F.max(F.abs(F.col("y.value") - F.col("y0"))).alias("err")).first()
    assert r["acc"] > 0.95 and r["err"] < 0.5


# retrieval


def test_in_batch_gradient():
    rnd = np.random.default_rng(0)
    q, p = rnd.normal(size=(3, 4)), rnd.normal(size=(5, 4))
    loss, dq, dp = retrieval.in_batch_loss(q, p)
    for x, g in ((q, dq), (p, dp)):
        for at in np.ndindex(x.shape):
            x[at] += 1e-6
            assert (retrieval.in_batch_loss(q, p)[0] - loss) / 1e-6 == pytest.approx(g[at], abs=1e-4)
            x[at] -= 1e-6


def test_towers_beat_raw_cosine(spark, tmp_path):
    rnd = random.Random(9)
    pairs = []
    for i in range(600):
        topics = rnd.sample(range(30), 3)
        passage = [f"p{t}" for t in topics] + [f"x{rnd.randrange(200)}" for _ in range(3)]
        pairs.append((i, " ".join(f"q{t}" for t in topics), " ".join(rnd.sample(passage, 6)), " ".join(f"x{rnd.randrange(200)}" for _ in range(4)) if i % 2 else None))
    schema = "id long, q string, p string, h string"
    train = spark.createDataFrame([*pairs[:500], (-1, None, "a", None), (-2, "a", None, None), (-3, "", "", "")], schema).repartition(5)
    held = spark.createDataFrame(pairs[500:], schema)
    start = retrieval.TwoTowers.start(1 << 11, 16)
    fitted = retrieval.fit_towers(train, "id", "q", "p", "h", width=1 << 11, size=16, rounds=6, shards=2)

    def mrr(model):
        queries = retrieval.embed(model, held.select("id", "q"), "q", "query", "e").select(F.concat(F.lit("q"), "id").alias("qid"), F.col("e").alias("q"))
        items = retrieval.embed(model, held.select("id", "p"), "p", "passage").select(F.col("id").cast("string").alias("id"), "v")
        run = ranking.similar(queries, items, 10, "cosine").select(F.expr("bigint(substring(qid, 2))").alias("qid"), F.col("id").cast("bigint").alias("pid"), "rank")
        return ranking.mean_reciprocal_rank(run, held.select(F.col("id").alias("qid"), F.col("id").alias("pid"))).first()["mrr"]

    before, after = mrr(start), mrr(fitted)
    assert before < 0.2 and after > before + 0.3
    fitted.save(spark, f"{tmp_path}/towers")
    assert np.allclose(retrieval.TwoTowers.load(spark, f"{tmp_path}/towers").passage, fitted.passage)
    with pytest.raises(ValueError):
        retrieval.embed(fitted, held, "q", "tower")
    odd = retrieval.embed(fitted, spark.createDataFrame([(1, None), (2, ""), (3, "!")], "id long, q string"), "q", "query").collect()
    assert len({tuple(r["v"]) for r in odd}) == 1


# validation


def test_grid(spark):
    grid = validation.parameter_grid({"a": [1, 2], "b": ["x", "y"]}, [{"a": 2, "b": "y"}])
    assert grid == [{"a": 1, "b": "x"}, {"a": 1, "b": "y"}, {"a": 2, "b": "x"}]
    df = validation.with_grid(spark.createDataFrame([("r",), ("s",)], "n string"), {"a": [1, 2], "b": ["x", "y"]}, [{"n": "r", "a": 1}, {"b": "y", "a": 2}])
    assert sorted(map(tuple, df.collect())) == [("r", 2, "x"), ("s", 1, "x"), ("s", 1, "y"), ("s", 2, "x")]
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_cross_validate_never_scores_what_it_saw(spark):
    df = splits.k_fold(spark.range(90).withColumn("y", F.col("id") % 7), "id", 4, 1).union(spark.createDataFrame([(1000, 1, None)], "id long, y long, fold int"))

    def fit(train, add):
        return {r["id"] for r in train.select("id").collect()}, train.agg(F.avg("y")).first()[0] + add

    def predict(model, rows):
        seen, value = model
        return rows.select("id", F.col("id").isin(*seen).alias("seen"), F.lit(value).alias("value"))

    out = validation.cross_validate(df, "id", "fold", 4, fit, predict, [{"add": 0.0}, {"add": 10.0}]).collect()
    assert not any(r["seen"] for r in out)
    assert sorted((r["grid"], r["id"]) for r in out) == [(g, i) for g in range(2) for i in range(90)]
    assert all((r["value"] > 9) == (r["grid"] == 1) for r in out)


def test_ridge_out_of_fold(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(5, 2), i % 3) for i in range(200)]
    rows = [(i, a, b, 3 * a - 2 * b + 1 + rnd.gauss(0, 0.1), k) for i, a, b, k in rows] + [(900, None, 1.0, 2.0, 1), (901, 1.0, 1.0, None, 1), (902, 1.0, 1.0, 9.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, fold int").repartition(4)
    out = validation.ridge_out_of_fold(df, ["id", "y"], "fold", 3, ["a", "b"], "y", [0.0, 50.0])
    got = {(r["id"], r["penalty"]): r["prediction"] for r in out.collect()}
    for k in range(3):
        x = np.array([(1, r[1], r[2]) for r in rows[:200] if r[4] != k])
        y = np.array([r[3] for r in rows[:200] if r[4] != k])
        w = np.linalg.lstsq(x, y, rcond=None)[0]
        for r in rows[:200]:
            if r[4] == k:
                assert got[r[0], 0.0] == pytest.approx(w @ [1, r[1], r[2]])
    assert got[900, 0.0] is None and got[901, 0.0] is not None and (902, 0.0) not in got
    scores = validation.fold_scores(out, ["penalty"], "prediction", "y")
    assert scores.agg(validation.chosen(scores, "rmse").alias("b")).first()["b"]["penalty"] == 0.0
    assert validation.ridge_out_of_fold(df.limit(0), ["id"], "fold", 3, ["a"], "y", [1.0]).count() == 0


# calibration


def test_temperature_lowers_the_calibration_error(spark):
    rnd = np.random.default_rng(5)
    z = rnd.normal(0, 1.5, (3000, 3))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = [int(rnd.choice(3, p=q)) for q in p]
    rows = [(i, (4 * v).tolist(), k) for i, (v, k) in enumerate(zip(z, y, strict=True))]
    df = spark.createDataFrame([*rows, (-1, None, 1), (-2, [1.0, 2.0, 3.0], None)], "id long, z array<double>, y int").repartition(4)
    t = calibration.fit_temperature(df, "z", "y")
    assert 3.5 < t < 4.6

    def ece(temperature):
        out = calibration.calibrated(df.where("y IS NOT NULL AND z IS NOT NULL"), "z", temperature)
        out = out.select(F.array_max("probabilities").alias("c"), (F.array_position("probabilities", F.array_max("probabilities")) - 1 == F.col("y")).alias("right"))
        return calibration.expected_calibration_error(out, "c", "right").first()["ece"]

    assert ece(t) < 0.03 < ece(1.0)
    likelihood = lambda x: df.where("y IS NOT NULL AND z IS NOT NULL").select(calibration.derivatives(F.col("z"), F.col("y"), 1 / x)[0].alias("l")).agg(F.sum("l")).first()[0]
    assert likelihood(t) < min(likelihood(t * 1.02), likelihood(t / 1.02))
    assert calibration.fit_temperature(df.limit(0), "z", "y") == 1.0
    assert calibration.fit_temperature(spark.createDataFrame([(1, [2.0, 2.0], 0)], "id long, z array<double>, y int"), "z", "y") == 1.0


# tokenizers


def test_unigram_is_the_best_cut(spark):
    rnd = random.Random(6)
    vocabulary = [("<unk>", -20.0), ("▁", -2.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0), ("ba", -5.5), ("aba", -6.0), ("▁a", -3.5), ("bb", -9.0)]
    scores = dict(vocabulary)

    def best(word):
        if not word:
            return 0.0
        ways = [best(word[n:]) + (scores[word[:n]] if word[:n] in scores else -30.0) for n in range(1, min(3, len(word)) + 1) if n == 1 or word[:n] in scores]
        return max(ways)

    words = ["".join(rnd.choice("aabbc") for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    for w in words:
        cut = K.unigram_cut(w, scores, 3, -30.0)
        assert sum(-30.0 if p is None else scores[p] for p in cut) == best(w)
        assert sum(1 if p is None else len(p) for p in cut) == len(w)
    df = spark.createDataFrame([(1, ["ab", None, "xxab", ""]), (2, None), (3, [])], "id long, w array<string>")
    got = {r["id"]: r["p"] for r in df.select("id", K.unigram_pieces(F.col("w"), vocabulary).alias("p")).collect()}
    assert got == {1: [1, 4, 1, 0, 4, 1], 2: None, 3: []}
    loose = df.select("id", K.unigram_pieces(F.col("w"), vocabulary, fuse_unknown=False).alias("p")).collect()
    assert {r["id"]: r["p"] for r in loose}[1] == [1, 4, 1, 0, 0, 4, 1]


def test_byte_pairs_against_a_library(spark):
    from tokenizers import Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    merges = [("t", "h"), ("Ġ", "t"), ("th", "e"), ("Ġt", "h"), ("Ġth", "e"), ("Ã", "©"), ("a", "a"), ("aa", "a"), ("i", "n"), ("in", "g"), ("Ġ", "Ġ")]
    letters = K.byte_letters()
    assert len(set(letters.values())) == 256 and letters[32] == "Ġ" and letters[10] == "Ċ"
    vocabulary = [letters[b] for b in range(256)] + [a + b for a, b in merges]
    theirs = Tokenizer(BPE({p: i for i, p in enumerate(vocabulary)}, merges))
    theirs.pre_tokenizer = ByteLevel(add_prefix_space=False)
    texts = ["the thing", "  the  café aaaaa\n\n then", "", "it's 12,5 héhé 日本 \t x", "We'll see—the end ", None, "a" * 500 + " the" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r["id"]: r["p"] for r in df.select("id", K.byte_pair_pieces(K.byte_words(F.col("text")), vocabulary, merges).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else theirs.encode(t).ids)
        if t is not None:
            assert K.byte_pair_text(got[i], vocabulary) == t


def test_word_pieces_with_null_words_and_accents(spark):
    vocabulary = [subwords.PAD, subwords.UNK, "cafe", "##s", "un", "##aff", "##able"]
    df = spark.createDataFrame([(1, ["cafes", None, "unaffable", "zz"]), (2, None)], "id long, w array<string>")
    got = {r["id"]: r["p"]["ids"] for r in df.select("id", subwords.word_pieces(F.col("w"), vocabulary).alias("p")).collect()}
    assert got == {1: [2, 3, 4, 5, 6, 1], 2: []}
    assert [r[0] for r in spark.createDataFrame([("Café",), (None,), ("日本",)], "t string").select(K.without_accents(F.col("t"))).collect()] == ["Cafe", None, "日本"]


# functions of SQL


def test_sql_functions(spark):
    tables.register(spark)
    docs = spark.createDataFrame([(1, " a b  c d e f g"), (2, ""), (3, None), (4, "x")], "id long, text string")
    got = spark.sql("SELECT d.id, p.* FROM {docs} d, LATERAL passages(d.text, 4, 3) p ORDER BY id, passage", docs=docs).collect()
    assert [(r["id"], r["passage"], r["start_t"], r["end_t"], r["passage_text"]) for r in got] == [(1, 0, 0, 4, "a b  c d"), (1, 1, 3, 7, "d e f g"), (4, 0, 0, 1, "x")]
    rows = [(1, "a", 1), (1, "a", 2), (1, "b", 3), (1, "a", 4), (2, "a", 1), (None, None, 5), (None, None, 6)]
    t = spark.createDataFrame(rows, "k long, v string, at long")
    got = {tuple(r) for r in spark.sql("SELECT * FROM runs(TABLE({t}) PARTITION BY k ORDER BY at)", t=t).collect()}
    assert got == {("1", "a", "1", "2", 2), ("1", "b", "3", "3", 1), ("1", "a", "4", "4", 1), ("2", "a", "1", "1", 1), (None, None, "5", "6", 2)}
    counts = spark.createDataFrame([("x", 1), ("x", 1), ("y", 5), ("z", None)], "g string, n long")
    assert {r[0]: r[1] for r in spark.sql("SELECT g, entropy(n) FROM {c} GROUP BY g", c=counts).collect()} == {"x": 1.0, "y": 0.0, "z": 0.0}


# vectors of sentences, several labels


def test_cluster_pooling_against_numpy(spark):
    rnd = np.random.default_rng(4)
    size, k = 3, 4
    v = {f"t{i}": rnd.normal(size=size) for i in range(20)}
    cluster = {t: int(rnd.integers(k)) for t in v}
    weight = {t: float(rnd.random()) for t in v}
    centroid = rnd.normal(size=(k, size))
    sentences = {s: [f"t{rnd.integers(22)}" for _ in range(rnd.integers(1, 12))] for s in range(8)}  # two tokens have no vector
    tokens = spark.createDataFrame([(s, t) for s, ts in sentences.items() for t in ts], "s long, token string")
    clustered = spark.createDataFrame([(t, x.tolist(), cluster[t], weight[t]) for t, x in v.items()], "token string, v array<double>, cluster int, weight double")
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroid)], "cluster int, centroid array<double>")
    got = {r["s"]: r["v"] for r in models.cluster_pooling(tokens, clustered, centroids, "s", size, k).collect()}
    for s, ts in sentences.items():
        own = {t for t in ts if t in v}
        if not own:
            assert s not in got
            continue
        m = np.zeros((k, size))
        for t in own:
            m[cluster[t]] += weight[t] * v[t] - centroid[cluster[t]]
        c = np.cov(m.T)
        flat = np.array([c[i, j] * (1 if i == j else math.sqrt(2)) for i in range(size) for j in range(i, size)])
        mean = sum(weight[t] * v[t] for t in own) / len(own)
        assert np.allclose(got[s], np.concatenate([mean, flat / np.linalg.norm(flat)]))


def test_multilabel(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(80):
        a, b = i % 2, i // 2 % 2
        rows.append((i, " ".join([*["red"] * (3 * a), *["blue"] * (3 * b), *[f"w{rnd.randrange(9)}" for _ in range(4)]]), a, b))
    df = spark.createDataFrame(rows, "id long, text string, a int, b int")
    out = models.classify_multilabel(models.fit_multilabel(df, "text", ["a", "b"]), df)
    assert all(r["labels"] == [x for x in ("a", "b") if r[x]] for r in out.collect())


def test_kept_rows_are_not_worked_out_again(spark):
    from textloom.operators import splits
    from textloom.plans.common import kept

    rows = spark.createDataFrame([(i, i % 2) for i in range(20)], "k long, y long")
    folds = splits.stratified_k_fold(rows, "k", "y", 3, 7)
    out = kept(spark, folds, "folds")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, folds.collect()))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_cv_classifier_deals_its_folds_once(spark, monkeypatch):
    from textloom.operators import splits, validation
    from textloom.plans import learning

    seen = []
    monkeypatch.setattr(validation, "cross_validate", lambda df, *a, **k: seen.append(df) or df.selectExpr("0 AS grid", "doc_id", "quality", "quality AS prediction"))
    learning.cv_classifier(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_sequences_side_by_side_are_tagged_as_one_by_one():
    rng = np.random.RandomState(4)
    allowed = tagging.iob_transitions(LABELS)
    for _ in range(30):
        sizes = rng.randint(0, 9, rng.randint(0, 12))
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        e, t = rng.randint(0, 3, (bounds[-1], len(LABELS))) / 3, rng.randint(0, 3, (len(LABELS) + 1, len(LABELS))) / 3 + allowed
        each = [tagging.viterbi(e[i:j], t) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        assert tagging.viterbi_many(e, bounds, t).tolist() == [x for path in each for x in path]
        lists = [tagging._viterbi_lists(e[i:j].tolist(), t[-1].tolist(), t[:-1].T.tolist()) for i, j in zip(bounds[:-1], bounds[1:], strict=True) if i < j]
        assert lists == [x for x in each if x]


def test_a_round_of_the_tagger_is_the_plain_perceptron(monkeypatch):
    rng = np.random.RandomState(5)
    labels, width = ["O", "B-A", "I-A"], 64
    allowed = tagging.iob_transitions(labels)
    rows = []
    for _ in range(300):
        words = [f"w{rng.randint(9)}" for _ in range(rng.randint(1, 7))]
        rows.append((words, [1 if w == "w1" or (w == "w2" and rng.rand() < 0.05) else 0 for w in words]))
    start = {"words": rng.randint(-2, 3, (width, 3)) / 3, "steps": rng.randint(-2, 3, (4, 3)) / 3}
    words, steps = start["words"].copy(), start["steps"].copy()
    for row, gold in rows:
        f = tagging.word_features(row, width)
        guess, before = tagging.viterbi(words[f].sum(1), steps + allowed), (3, 3)
        for x, g, p in zip(f, gold, guess, strict=True):
            for tag, last, sign in ((g, before[0], 1.0), (p, before[1], -1.0)):
                if g != p:
                    np.add.at(words, (x, tag), sign)
                if g != p or before[0] != before[1]:
                    steps[last, tag] += sign
            before = g, p
    numbers = pa.array([tagging.word_features(row, width).ravel().tolist() for row, _ in rows], pa.list_(pa.int16()))
    batch = pa.RecordBatch.from_arrays([numbers, pa.array([g for _, g in rows], pa.list_(pa.int32()))], ["features", "gold"])
    for streak in (0, 2, 1000):
        monkeypatch.setattr(tagging, "STREAK", streak)
        change, n = tagging._learn(labels, allowed)(iter([batch.slice(0, 7), batch.slice(7)]), {k: v.copy() for k, v in start.items()})
        assert n == 300 and (change["words"] == words - start["words"]).all() and (change["steps"] == steps - start["steps"]).all()


def test_words_of_a_tagger_are_numbered_before_the_rounds(spark):
    df = spark.createDataFrame([(1, ["a", "B"], ["O", "B-ORG"]), (2, None, ["O"]), (3, ["a"], None), (4, ["a"], ["O", "O"]), (5, [None], ["O"])], "id long, tokens array<string>, tags array<string>")
    got = {r.id: (r.features, r.gold) for r in tagging._numbered(df, "id", ["O", "B-ORG"], "tokens", "tags", 128).collect()}
    assert got == {1: (tagging.word_features(["a", "B"], 128).ravel().tolist(), [0, 1]), 5: (tagging.word_features([""], 128).ravel().tolist(), [0])}
