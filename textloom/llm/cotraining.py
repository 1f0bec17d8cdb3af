"""Quality by co-training: a text view and a page-metadata view teach each other, then score all documents together.

The text view sees words and word shapes; the metadata view sees language, source, length and layout figures, and no words.
A view is a logistic regression whose features are weighted by their log count ratios between good and bad documents.  At first it
is fitted on the labelled documents alone.  In each round every other document of the table of which one view is sure is
pseudo-labelled for the other view: it counts in the ratios, and it enters the fit.  There the pseudo-labelled documents of a class stand as
the mean of their feature vectors, one weighted point a class, so a fit stays as small as the labelled sample while all of them
teach, also by words that no labelled document holds.  Per class, what is taught weighs as much as the labels at most.  Each view's log-odds are then calibrated
by itself on labelled documents kept aside, and added (less the prior that both hold), as the views are taken as independent.
Toxicity shows in words alone, so it has a text classifier of its own.  The score is P(quality) * (1 - P(toxic)); a document is
rejected below a cutoff that at most ``lost`` of the good documents of a second set kept aside fall under.

Scale: features are numbers below a fixed bound (hashes of words and shapes, steps of layout figures), so no vocabulary is
gathered and no word is left out.  One pass over all whole texts writes them; a round and the scores are passes over
that table, without a shuffle of documents: a task gives the counts of its features.  A fit takes at most ``LABELLED`` labelled
documents, by hash of the id; the ids, and the models' weights, are all that goes to the tasks.

Layout figures are cut in ``STEPS`` steps; what lies beyond the last one shares it, as a feature has to have a fixed number.

Defined cases: a null text is empty; null metadata are values of their own; a document with several labels counts with the
lowest quality and the highest toxicity, and a null label says nothing of its own kind only; labelled rows of one id with
different texts count once (by the least features); where the labels hold one class only, that model has no say; without labels
everything is kept with score 1.  Repeated rows give repeated results, and each of them teaches; an empty table gives an empty result.
Extra columns are ignored, and ``keep`` may hold any name but those of the results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from textloom.llm.common import collect_garbage, drop_table, free_names, materialise
from textloom.llm.risk_rules import text_counts

LABELLED, ROUNDS, ITERATIONS = 8000, 2, 25
#: A view teaches a document's class when it gives it this probability.
SURE = 0.99
#: The numbers of the text view's features: words, then shapes; of the metadata view's: steps of the figures, languages, sources.
WORDS, SHAPES, STEPS, LANGS, SOURCES = 61440, 4096, 32, 64, 256
#: The labelled sample is read once per step of a fit, so it lies in few files; with four, a step is one stage.
PARTS = 4
REMEMBERED = 200_000
#: So many texts are held at a time with their features.
SLICE = 500
#: layout figure -> steps per unit
FIGURES = {"words": 3, "chars": 2, "word_length": 2, "symbols": 80, "dup_lines": 20, "repeats": 20, "upper": 20, "line_words": 4, "lines": 3, "digits": 40}
WIDTH = {"text": WORDS + SHAPES, "meta": len(FIGURES) * STEPS + LANGS + SOURCES}

_CLASSES = bytes((65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else 233 if c > 127 else c) for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Features(dict):
    """word -> word feature * SHAPES + shape feature; a task's memory of some words."""

    def __missing__(self, word: bytes) -> int:
        shape = _RUNS.sub(rb"\1", word.translate(_CLASSES))
        found = zlib.crc32(word.strip(_EDGES).lower()) % WORDS * SHAPES + zlib.crc32(shape) % SHAPES
        if len(self) < REMEMBERED:
            self[word] = found
        return found


def text_features(text: str | None, known: Features) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text's words and shapes, and how often each stands there."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    a, n = np.unique(codes // SHAPES, return_counts=True)
    b, m = np.unique(codes % SHAPES, return_counts=True)
    return np.concatenate([a, b + WORDS]), np.concatenate([n, m])


def meta_features(text: str | None, lang: str | None, source: str | None) -> list[int]:
    """Steps of length and layout, language and source; no words."""
    n, chars, symbols, dups, repeats, lines, upper = text_counts(text)
    w, size = max(n, 1), max(len(text or ""), 1)
    values = [math.log1p(n), math.log1p(size), chars / w, symbols / max(chars, 1), dups / max(lines, 1), repeats / w, upper / w]
    values += [math.log1p(n / max(lines, 1)), math.log1p(lines), sum(map((text or "").count, "0123456789")) / size]
    steps = [i * STEPS + min(STEPS - 1, math.ceil(v * k)) for i, (v, k) in enumerate(zip(values, FIGURES.values(), strict=True))]
    number = lambda x, kinds: 0 if x is None else 1 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (kinds - 1)
    at = len(FIGURES) * STEPS
    return [*steps, at + number(lang, LANGS), at + LANGS + number(source, SOURCES)]


def _lists(parts: list, kind: pa.DataType) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate([np.asarray(p, float) for p in parts]) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat).cast(kind))


def extract(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` and the features of every document, and the names of the feature columns.

    ``text`` and ``meta``: numbers of the features; ``values``: of the text features, the logarithm of 1 + their count.
    """
    names = dict(zip(("text", "values", "meta"), free_names(docs, "text_features", "text_values", "meta_features"), strict=True))
    held = [f"k{i}" for i in range(len(keep))]
    slim = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, held, strict=True)], F.col("text").alias("t"), F.col("lang").alias("l"), F.col("source").alias("s"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features()
        for whole in it:
            for first in range(0, whole.num_rows, SLICE):
                b = whole.slice(first, SLICE)
                texts = b.column("t").to_pylist()
                found = [text_features(t, known) for t in texts]
                meta = [meta_features(*row) for row in zip(texts, b.column("l").to_pylist(), b.column("s").to_pylist(), strict=True)]
                cols = [_lists([f for f, _ in found], pa.int32()), _lists([np.log1p(n) for _, n in found], pa.float32()), _lists(meta, pa.int32())]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in held), *cols], [*keep, *names.values()])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    kinds = f"{kinds}, {names['text']} array<int>, {names['values']} array<float>, {names['meta']} array<int>"
    return slim.mapInArrow(batches, kinds), names


def _flat(b: pa.RecordBatch, names: dict[str, str], view: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch and a view: features, their values, and the row of each."""
    lists = b.column(names[view])
    ids = lists.flatten().to_numpy()
    values = b.column(names["values"]).flatten().to_numpy().astype(float) if view == "text" else np.ones(len(ids))
    return ids, values, np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())


Linear = tuple[np.ndarray, float]


def _odds(b: pa.RecordBatch, names: dict[str, str], view: str, model: Linear | None) -> np.ndarray:
    if model is None:
        return np.zeros(b.num_rows)
    ids, values, rows = _flat(b, names, view)
    return np.bincount(rows, model[0][ids] * values, b.num_rows) + model[1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def count_features(rows: DataFrame, names: dict[str, str], views: dict[str, Linear | None] | None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each view, documents of class 0 and 1 by feature, and how many documents of each class there are.

    Without ``views`` the class is the column ``quality``; with them, a view's documents are those of which the other view is sure.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {v: np.zeros((2, n + 1), np.int64) for v, n in WIDTH.items()}  # the last: all documents
        for b in it:
            for view, other in (("text", "meta"), ("meta", "text")):
                if views is None:
                    p = b.column("quality").to_numpy(zero_copy_only=False)
                else:
                    p = sigmoid(_odds(b, names, other, views[other]))
                ids, _, at = _flat(b, names, view)
                for c, mine in enumerate((p <= 1 - SURE, p >= SURE)):
                    found[view][c, :-1] += np.bincount(ids[mine[at]], minlength=WIDTH[view])
                    found[view][c, -1] += mine.sum()
        for view, counts in found.items():
            c, f = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([view] * len(c), pa.string()), pa.array(c, pa.int32()), pa.array(f, pa.int32()), pa.array(counts[c, f])], ["view", "class", "feature", "n"])

    need = [*names.values(), *(["quality"] if views is None else [])]
    sums = rows.select(*need).mapInArrow(batches, "view string, class int, feature int, n long").groupBy("view", "class", "feature").agg(F.sum("n").alias("n"))
    out = {v: np.zeros((2, n + 1)) for v, n in WIDTH.items()}
    found = sums.toArrow()  # at most two classes of all feature numbers
    kind, c, f, n = (found.column(x).to_numpy() for x in ("view", "class", "feature", "n"))
    for v, table in out.items():
        own = kind == v
        table[c[own], f[own]] = n[own]
    return {v: (x[:, :-1], x[:, -1]) for v, x in out.items()}


def ratios(labelled: tuple[np.ndarray, np.ndarray], taught: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The log count ratio of each feature between the classes; what is taught weighs as much as the labels at most."""
    counts, totals = labelled[0].copy(), labelled[1].copy()
    if taught is not None:
        weight = np.minimum(1, labelled[1] / np.maximum(taught[1], 1))
        counts, totals = counts + weight[:, None] * taught[0], totals + weight * taught[1]
    share = (counts + 0.5) / (totals + 1)[:, None]
    return np.log(share[1] / share[0])


def mean_points(labelled: tuple[np.ndarray, np.ndarray], taught: tuple[np.ndarray, np.ndarray], view: str) -> list[tuple[float, float, np.ndarray]]:
    """(class, weight, mean feature vector) of what each class was taught; a text feature counts as standing there once."""
    once = math.log(2) if view == "text" else 1.0
    return [(float(c), float(min(labelled[1][c], taught[1][c])), once * taught[0][c] / taught[1][c]) for c in (0, 1) if taught[1][c] and labelled[1][c]]


def _occurring(rows: DataFrame, names: dict[str, str], view: str) -> np.ndarray:
    """The features of a view that the rows have; at most ``WIDTH`` numbers."""
    return rows.select(F.explode(names[view]).alias("f")).distinct().toArrow().column("f").to_numpy()


def _fit(
    rows: DataFrame, names: dict[str, str], view: str, label: str, scale: np.ndarray | None, reg: float, l1: float, points_of_classes: list[tuple[float, float, np.ndarray]] = (),
    occurring: np.ndarray | None = None,
) -> Linear | None:
    """Weights and intercept over the features times ``scale``, or None where the labels are of one class.

    Besides the rows, each of weight 1, the weighted points take part.  The weight of a feature that neither has is 0 at every step of a
    fit, so the fit is over the others (``occurring``, those of the rows, and the points'): the driver holds dozens of vectors of that size.
    """
    rows = rows.where(F.col(label).isNotNull())
    if rows.agg(F.countDistinct(label)).first()[0] < 2:
        return None
    occurring = _occurring(rows, names, view) if occurring is None else occurring
    used = np.unique(np.concatenate([occurring, *(np.flatnonzero(v) for _, _, v in points_of_classes)])).astype(np.int64)
    used = used if len(used) else np.zeros(1, np.int64)
    place = np.zeros(WIDTH[view], np.int32)
    place[used] = np.arange(len(used))

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, values, _ = _flat(b, names, view)
            lists = b.column(names[view])
            values = pa.ListArray.from_arrays(lists.offsets, pa.array(values if scale is None else values * scale[ids]))
            ids = pa.ListArray.from_arrays(lists.offsets, pa.array(place[ids]))
            parts = [pa.array(np.zeros(b.num_rows, np.int8)), pa.array(np.full(b.num_rows, len(used), np.int32)), ids, values]
            x = pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([b.column(label), pa.array(np.ones(b.num_rows)), x], ["y", "w", "x"])

    kind = StructType([StructField("y", DoubleType()), StructField("w", DoubleType()), StructField("x", VectorUDT())])
    points = rows.select(label, *names.values()).mapInArrow(vectors, kind)
    if points_of_classes:  # two rows at most
        of = lambda v: Vectors.sparse(len(used), place[np.flatnonzero(v)].tolist(), v[np.flatnonzero(v)].tolist())
        means = [(y, w, of(v if scale is None else v * scale)) for y, w, v in points_of_classes]
        points = points.unionByName(rows.sparkSession.createDataFrame(means, kind))
    lr = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=ITERATIONS, regParam=reg, elasticNetParam=l1, standardization=scale is None)
    collect_garbage(rows.sparkSession)  # else the driver's heap grows from fit to fit by what the steps before have left
    model = lr.fit(points.coalesce(PARTS))
    weights, intercept = np.zeros(WIDTH[view]), float(model.intercept)
    weights[used] = model.coefficients.toArray()
    del model, points, lr  # while they are held, so are their plans and vectors in the driver's heap
    collect_garbage(rows.sparkSession)
    return weights if scale is None else weights * scale, intercept


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b > 0 of the log-odds a + b z, by Newton steps with a small penalty; (0, 1) where ``y`` is of one class."""
    if len(set(y.tolist())) < 2:
        return 0.0, 1.0
    x = np.stack([np.ones(len(z)), z], 1)
    w = np.array([0.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (y - p) - 1e-2 * (w - [0, 1]))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(float(w[1]), 1e-3)


class Model:
    """The fitted views, as plain numbers."""

    def __init__(self, views: dict[str, Linear | None], toxic: Linear | None) -> None:
        self.views, self.toxic = views, toxic
        self.scales = {"text": (0.0, 1.0), "meta": (0.0, 1.0)}
        self.prior, self.cutoff = 0.0, 0.0

    def odds(self, b: pa.RecordBatch, names: dict[str, str], view: str) -> np.ndarray:
        return _odds(b, names, view, self.views[view])

    def parts(self, b: pa.RecordBatch, names: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
        """P(quality) of the calibrated views, and P(toxic)."""
        own = [v for v in ("text", "meta") if self.views[v] is not None]
        calibrated = [self.scales[v][0] + self.scales[v][1] * self.odds(b, names, v) for v in own]
        quality = sigmoid(sum(calibrated) - (len(own) - 1) * self.prior) if own else np.ones(b.num_rows)
        toxic = np.zeros(b.num_rows) if self.toxic is None else sigmoid(_odds(b, names, "text", self.toxic))
        return quality, toxic


def _labelled(features: DataFrame, labels: DataFrame, names: dict[str, str]) -> DataFrame:
    """At most ``LABELLED`` documents with quality, toxic (either may be null) and role (fit, calibrate, cutoff)."""
    order = F.xxhash64("doc_id", F.lit(5))
    known = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id")
    known = known.agg(F.min("quality").cast("double").alias("quality"), F.max("toxic").cast("double").alias("toxic"))
    known = known.withColumns({c: (F.col(c) > 0).cast("double") for c in ("quality", "toxic")})
    chosen = known.join(features.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(order, "doc_id").limit(LABELLED)
    part = F.pmod(order, F.lit(5))
    chosen = chosen.withColumn("role", F.when(part == 0, "calibrate").when(part == 1, "cutoff").otherwise("fit"))
    rows = features.select("doc_id", *names.values()).join(F.broadcast(chosen), "doc_id")  # LABELLED rows at most
    one = F.min(F.struct(*names.values(), "quality", "toxic", "role"))
    return rows.groupBy("doc_id").agg(one.alias("r")).select("doc_id", "r.*").repartition(PARTS, "doc_id")


def _aside(rows: DataFrame, names: dict[str, str], role: str) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The labelled rows of a role, a part of ``LABELLED``, as one batch with their labels."""
    t = rows.where(F.col("role") == role).orderBy("doc_id").toArrow().combine_chunks()
    b = t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_pylist([], t.schema)
    return b, *(b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("quality", "toxic"))


def train(features: DataFrame, names: dict[str, str], labels: DataFrame, lost: float = 0.01, rounds: int = ROUNDS) -> Model:
    """Fit on the features of all documents."""
    rows = materialise(_labelled(features, labels, names), "cotraining-labelled")
    learn = rows.where("role = 'fit'")
    have = {v: _occurring(learn, names, v) for v in WIDTH}
    toxic = _fit(learn, names, "text", "toxic", None, 0.001, 0.5, (), have["text"])
    counted = count_features(learn.where("quality IS NOT NULL"), names, None)

    def view(v: str, taught: dict | None) -> Linear | None:
        points = mean_points(counted[v], taught[v], v) if taught else []
        return _fit(learn, names, v, "quality", ratios(counted[v], taught and taught[v]), 0.002, 0.0, points, have[v])

    views = {v: view(v, None) for v in WIDTH}
    if views["text"] is not None:
        pool = features.join(F.broadcast(rows.where("quality IS NOT NULL").select("doc_id")), "doc_id", "left_anti")  # LABELLED rows at most
        for _ in range(rounds):
            taught = count_features(pool, names, views)
            views = {v: view(v, taught) for v in WIDTH}
    model = Model(views, toxic)
    b, y, _ = _aside(rows, names, "calibrate")
    held = np.isfinite(y)
    for v in WIDTH:
        if views[v] is not None:
            model.scales[v] = calibrate(model.odds(b, names, v)[held], y[held])
    good = (y[held].sum() + 1) / (held.sum() + 2)
    model.prior = math.log(good / (1 - good))
    b, y, x = _aside(rows, names, "cutoff")
    quality, p_toxic = model.parts(b, names)
    fine = (np.nan_to_num(y, nan=1.0) > 0) & (np.nan_to_num(x) == 0) & (np.isfinite(y) | np.isfinite(x))
    scores = np.sort((quality * (1 - p_toxic))[fine])
    model.cutoff = min(0.5, float(scores[int(lost * len(scores))])) if len(scores) else 0.0
    drop_table(rows)
    return model


def score_features(features: DataFrame, names: dict[str, str], model: Model, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, p_quality, p_toxic, score and kept of every document."""
    held = [f"k{i}" for i in range(len(keep))]
    slim = features.select(*[F.col(c).alias(n) for c, n in zip(keep, held, strict=True)], *names.values())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            q, x = model.parts(b, names)
            score = q * (1 - x)
            cols = [pa.array(c) for c in (q, x, score, score >= model.cutoff)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in held), *cols], [*keep, "p_quality", "p_toxic", "score", "kept"])

    kinds = ", ".join(f"`{c}` {features.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(batches, f"{kinds}, p_quality double, p_toxic double, score double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), lost: float = 0.01, rounds: int = ROUNDS) -> DataFrame:
    """``keep`` (doc_id among them), p_quality, p_toxic, score and kept of every row of ``docs(doc_id, text, lang, source)``."""
    features, names = extract(docs, keep)
    features = materialise(features, "cotraining-features")
    collect_garbage(features.sparkSession)
    return score_features(features, names, train(features, names, labels, lost, rounds), keep)
