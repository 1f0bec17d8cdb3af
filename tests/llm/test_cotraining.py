"""Co-training against plain numpy on a small table."""

import math
import random
import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import cotraining

SCHEMA = "doc_id long, text string, lang string, source string, text_features string"


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        mine = [f"{'junk' if bad else 'fine'}{rnd.randrange(30)}" if rnd.random() < 0.4 else f"w{rnd.randrange(60)}" for _ in range(40)]
        if i % 7 == 0:
            mine[3] = "nasty"
        rows.append((i, ("\n" if bad else " ").join(mine), "en", f"s{i % 4}", "clash"))
        if i % 2 == 0:
            labels.append((i, int(not bad), int(i % 7 == 0)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "new", "x"), (1001, "", "en", "new", "x"), (None, "fine1 w2", None, "a", "x"), (1001, "other", "en", "b", "x")]
    labels += [(None, 1, 1), (3, None, 0), (999, 1, 0), (2, 1, None), (1, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rounds(tables, monkeypatch):
    docs, labels = tables
    features, names = cotraining.extract(docs, ("doc_id", "text_features"))
    features = features.cache()
    calls, fits = [], []
    count, fit = cotraining.count_features, cotraining._fit
    monkeypatch.setattr(cotraining, "count_features", lambda *a: calls.append((a[2], count(*a))) or calls[-1][1])
    monkeypatch.setattr(cotraining, "_fit", lambda *a: fits.append((a, fit(*a))) or fits[-1][1])
    model = cotraining.train(features, names, labels, rounds=2)
    rows = features.collect()
    part = {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)).alias("p")).collect()}
    truth = {i: float(i % 3 > 0) for i in range(0, 240, 2)}
    x = {v: [dict(zip(r[names[v]], r[names["values"]] if v == "text" else [1.0] * 99, strict=False)) for r in rows] for v in ("text", "meta")}

    def odds(v, i, views):
        w, b = views[v]
        return b + sum(w[f] * value for f, value in x[v][i].items())

    def tally(v, classes):
        n, all_ = np.zeros((2, cotraining.WIDTH[v])), np.zeros(2)
        for i, c in enumerate(classes):
            if c is not None:
                all_[c] += 1
                for f in x[v][i]:
                    n[c, f] += 1
        return n, all_

    def same(got, want):
        return (got[0] == want[0]).all() and (got[1] == want[1]).all()

    labelled = [int(truth[r["doc_id"]]) if r["doc_id"] in truth and part[r["doc_id"]] > 1 else None for r in rows]
    assert len(calls) == 3 and calls[0][0] is None and len(fits) == 7
    for v in x:
        assert same(calls[0][1][v], tally(v, labelled))
    for views, counts in calls[1:]:
        for v, other in (("text", "meta"), ("meta", "text")):
            sure = []
            for i, r in enumerate(rows):
                p = 0.5 if r["doc_id"] in truth else 1 / (1 + math.exp(-odds(other, i, views)))
                sure.append(1 if p >= cotraining.SURE else 0 if p <= 1 - cotraining.SURE else None)
            assert same(counts[v], tally(v, sure)) and counts[v][1].sum() > 20
    # the last fits take the ratios of labels and of what the last round taught
    (n, all_), (m, more) = calls[0][1]["text"], calls[2][1]["text"]
    weight = np.minimum(1, all_ / np.maximum(more, 1))
    share = (n + weight[:, None] * m + 0.5) / (all_ + weight * more + 1)[:, None]
    assert np.allclose(fits[-2][0][4], np.log(share[1] / share[0]))
    assert model.views == {"text": fits[-2][1], "meta": fits[-1][1]}
    batch = features.toArrow().combine_chunks().to_batches()[0]
    want = [odds("text", i, model.views) for i in range(len(rows))]
    assert np.allclose(model.odds(batch, names, "text"), want)
    held = [i for i, r in enumerate(rows) if r["doc_id"] in truth and part[r["doc_id"]] == 0]
    good = (sum(truth[rows[i]["doc_id"]] for i in held) + 1) / (len(held) + 2)
    assert model.prior == pytest.approx(math.log(good / (1 - good)))


def test_taught_words_reach_the_other_view(spark):
    """Unlabelled documents have words of their own, and only the metadata view knows them; the text view has to learn the words."""
    rnd = random.Random(8)

    def text(bad, new):
        own = [f"{'n' if new else 'o'}{'bad' if bad else 'good'}{rnd.randrange(12)}" for _ in range(8)]
        return ("\n" if bad else " ").join(own + [f"w{rnd.randrange(40)}" for _ in range(30)])

    rows = [(i, text(i % 2 == 0, i >= 200), "en", "s") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    features, names = cotraining.extract(docs, ("doc_id",))
    features = features.cache()
    numbers = cotraining.Features()
    number = lambda w: numbers[w.encode()] // cotraining.SHAPES
    before, after = (cotraining.train(features, names, labels, rounds=n).views["text"] for n in (0, 2))
    fresh = [(text(bad, True), bad) for bad in [True, False] * 100]

    def wrong(view):
        w, b = view
        odds = [b + sum(w[f] * math.log1p(n) for f, n in zip(*cotraining.text_features(t.replace("\n", " "), numbers), strict=True)) for t, _ in fresh]
        return sum((z > 0) == bad for z, (_, bad) in zip(odds, fresh, strict=True)) / len(fresh)

    good, bad = ([number(f"n{kind}{i}") for i in range(12)] for kind in ("good", "bad"))
    assert not before[0][good + bad].any() and wrong(before) > 0.3
    assert (after[0][good] > 0).all() and (after[0][bad] < 0).all() and wrong(after) < 0.05


def test_verdicts_and_clashing_names(tables):
    docs, labels = tables
    out = cotraining.classify(docs, labels, ("doc_id", "text_features")).collect()
    got = {r["doc_id"]: r["kept"] for r in out}
    assert len(out) == docs.count() and {r["text_features"] for r in out} == {"clash", "x", None}
    assert sum(got[i] == (i % 3 > 0 and i % 7 > 0) for i in range(240)) > 225


def test_one_class_and_calibration(spark, tables):
    docs, _ = tables
    labels = spark.createDataFrame([(i, 1, None) for i in range(40)], "doc_id long, quality int, toxic int")
    assert all(r["kept"] and r["score"] == 1 for r in cotraining.classify(docs, labels).collect())
    rnd = np.random.default_rng(0)
    z = rnd.normal(0, 2, 4000)
    y = (rnd.random(4000) < 1 / (1 + np.exp(-(0.5 + 0.7 * z)))).astype(float)
    assert cotraining.calibrate(z, y) == pytest.approx((0.5, 0.7), abs=0.1) and cotraining.calibrate(z, y * 0) == (0.0, 1.0)


def test_a_fit_is_over_the_features_that_occur(tables, monkeypatch):
    docs, labels = tables
    features, names = cotraining.extract(docs, ("doc_id",))
    rows = features.join(labels.where("quality IS NOT NULL"), "doc_id").withColumn("quality", F.col("quality").cast("double")).repartition(9).cache()
    fitted, fit = [], cotraining.LogisticRegression.fit
    monkeypatch.setattr(cotraining.LogisticRegression, "fit", lambda self, df: fitted.append(df) or fit(self, df))
    have = {f for r in rows.collect() for f in r[names["text"]]}
    taught = np.zeros(cotraining.WIDTH["text"])
    taught[[min(set(range(99)) - have), max(have)]] = 0.5
    for points, used in (([], have), ([(1.0, 2.0, taught)], have | set(np.flatnonzero(taught).tolist()))):
        weights, _ = cotraining._fit(rows, names, "text", "quality", None, 0.001, 0.0, points)
        assert {r["x"].size for r in fitted[-1].collect()} == {len(used)} and fitted[-1].rdd.getNumPartitions() <= 4
        assert set(np.flatnonzero(weights).tolist()) <= used and len(weights) == cotraining.WIDTH["text"]
    whole = [(r["quality"], 1.0, cotraining.Vectors.sparse(len(weights), dict(zip(r[names["text"]], map(float, r[names["values"]]), strict=True)))) for r in rows.collect()]
    lr = cotraining.LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=cotraining.ITERATIONS, regParam=0.001)
    want = fit(lr, docs.sparkSession.createDataFrame(whole, ["y", "w", "x"])).coefficients.toArray()
    assert np.allclose(cotraining._fit(rows, names, "text", "quality", None, 0.001, 0.0)[0], want, atol=1e-6)
    nothing = rows.withColumn(names["text"], F.array().cast("array<int>")).withColumn(names["values"], F.array().cast("array<float>"))
    assert not cotraining._fit(nothing, names, "text", "quality", None, 0.001, 0.0)[0].any()


def test_nothing_of_a_fit_is_held_when_the_driver_collects(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} v{i % 3}", "en", "a", float(i % 2)) for i in range(40)], "doc_id long, text string, lang string, source string, quality double")
    features, names = cotraining.extract(docs, ("doc_id", "quality"))
    models, held, fit, collect = [], [], cotraining.LogisticRegression.fit, cotraining.collect_garbage

    def kept(self, df):
        model = fit(self, df)
        models.append(weakref.ref(model))
        return model

    monkeypatch.setattr(cotraining.LogisticRegression, "fit", kept)
    monkeypatch.setattr(cotraining, "collect_garbage", lambda s: (collect(s), held.append([m() is not None for m in models])))
    assert cotraining._fit(features, names, "text", "quality", None, 0.001, 0.0) is not None
    assert held == [[], [False]]
