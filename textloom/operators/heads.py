"""Several prediction heads over one encoding of a table: registered kinds, tasks bound by name, one scoring pass.

An encoder turns a batch into what heads can read: ``per_sequence`` (a row of numbers per row) and ``per_token`` (an array of them per
row).  Every head names a task and the output that it reads.  Binding checks heads against the tasks of a processor before any job
runs; scoring then encodes each batch once for all heads and routes each task's label column to its head, for the loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

OUTPUTS = ("per_sequence", "per_token")
Encoder = Callable[[pa.RecordBatch], Mapping[str, object]]


@dataclass
class Task:
    """What a processor says of a task: its labels (for regression: mean and scale), its label column and its metric."""

    labels: Sequence = ()
    label_column: str | None = None
    metric: str | None = None


@dataclass
class Head:
    """A linear head: ``weights`` has a row per output.  Kinds say what becomes of the logits."""

    task: str
    weights: np.ndarray
    bias: np.ndarray
    output: str = "per_sequence"
    share: float = 1.0
    labels: list = field(default_factory=list)
    label_column: str | None = None

    result = "label string, probability double, loss double"

    def outputs(self) -> int:
        """How many labels the head tells apart."""
        return len(self.weights)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights.T + self.bias

    def rows(self, x: object, labels: list | None) -> list[dict]:
        raise NotImplementedError


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _number(labels: list, label: object) -> int | None:
    return labels.index(label) if label in labels else None


class Classification(Head):
    """The label of the first largest logit, its softmax probability, and the cross entropy of the given label."""

    def rows(self, x: np.ndarray, labels: list | None) -> list[dict]:
        if not len(x):
            return []
        p = log_softmax(self.logits(x))
        best = p.argmax(1)
        want = [None if labels is None else _number(self.labels, y) for y in labels or [None] * len(x)]
        return [{"label": self.labels[b], "probability": float(np.exp(r[b])), "loss": None if y is None else float(-r[y])} for r, b, y in zip(p, best.tolist(), want, strict=True)]


class Multilabel(Head):
    """Labels whose sigmoid passes a half, and the summed binary cross entropy against a list of given labels."""

    result = "label array<string>, probability array<double>, loss double"

    def rows(self, x: np.ndarray, labels: list | None) -> list[dict]:
        out = []
        for z, given in zip(self.logits(x), labels or [None] * len(x), strict=True):
            p = 1 / (1 + np.exp(-z))
            y = None if given is None else np.array([name in given for name in self.labels], float)
            loss = None if y is None else float((np.logaddexp(0, z) - y * z).sum())
            out.append({"label": [n for n, q in zip(self.labels, p, strict=True) if q > 0.5], "probability": p.tolist(), "loss": loss})
        return out


class Regression(Head):
    """A value in the labels' own unit; the loss is the squared error in the scaled one.  Labels are (mean, scale)."""

    result = "value double, loss double"

    def outputs(self) -> int:
        return 2

    def rows(self, x: np.ndarray, labels: list | None) -> list[dict]:
        mean, scale = self.labels
        z = self.logits(x)[:, 0] if len(x) else []
        want = labels or [None] * len(x)
        return [{"value": float(v * scale + mean), "loss": None if y is None else float((v - (y - mean) / scale) ** 2)} for v, y in zip(z, want, strict=True)]


class TokenClassification(Head):
    """A label per token; the loss is the mean cross entropy of the tokens that have a label."""

    result = "label array<string>, probability array<double>, loss double"

    def rows(self, x: list[np.ndarray], labels: list | None) -> list[dict]:
        out = []
        for tokens, given in zip(x, labels or [None] * len(x), strict=True):
            if not len(tokens):
                out.append({"label": [], "probability": [], "loss": None})
                continue
            p = log_softmax(self.logits(np.asarray(tokens, float)))
            best = p.argmax(1)
            costs = [-r[k] for r, y in zip(p, given or [], strict=False) if (k := _number(self.labels, y)) is not None]
            out.append({"label": [self.labels[b] for b in best], "probability": np.exp(p.max(1)).tolist(), "loss": float(np.mean(costs)) if costs else None})
        return out


_KINDS: dict[str, type[Head]] = {}


def register_head(kind: str, head: type[Head]) -> None:
    _KINDS[kind] = head


for _name, _kind in {"classification": Classification, "multilabel": Multilabel, "regression": Regression, "token_classification": TokenClassification}.items():
    register_head(_name, _kind)


def make_head(kind: str, task: str, weights: object, bias: object, share: float = 1.0, output: str | None = None) -> Head:
    if kind not in _KINDS:
        raise ValueError(f"no head {kind!r}; there are {sorted(_KINDS)}")
    weights = np.atleast_2d(np.asarray(weights, float))
    return _KINDS[kind](task, weights, np.atleast_1d(np.asarray(bias, float)), output or ("per_token" if kind == "token_classification" else "per_sequence"), share)


def bind(heads: Sequence[Head], tasks: Mapping[str, Task], require_labels: bool = True, optional: Sequence[str] = ()) -> list[Head]:
    """The heads with the labels and label columns of their tasks.

    An error, before any job: two heads of one task, a head without a task (unless its task is ``optional``: then it is left out), a task without
    labels, another number of labels than the head has outputs, or an output that no encoder gives.
    """
    bound, seen = [], set()
    for h in heads:
        if h.task in seen:
            raise ValueError(f"two heads for task {h.task!r}")
        seen.add(h.task)
        if h.task not in tasks:
            if h.task in optional:
                continue
            raise ValueError(f"no task {h.task!r}; there are {sorted(tasks)}")
        if h.output not in OUTPUTS:
            raise ValueError(f"task {h.task!r} reads {h.output!r}, which no encoder gives")
        task = tasks[h.task]
        if not task.labels and require_labels:
            raise ValueError(f"task {h.task!r} has no labels")
        if task.labels and len(task.labels) != h.outputs():
            raise ValueError(f"task {h.task!r} has {len(task.labels)} labels, its head {h.outputs()} outputs")
        bound.append(type(h)(h.task, h.weights, h.bias, h.output, h.share, list(task.labels), task.label_column))
    if not bound:
        raise ValueError("no head is left")
    return bound


def weighted_sum(losses: Mapping[str, float], shares: Mapping[str, float]) -> float:
    return sum(shares[t] * x for t, x in losses.items())


def score(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], encoder: Encoder, heads: Sequence[Head], aggregate: Callable[[Mapping[str, float], Mapping[str, float]], float] = weighted_sum) -> DataFrame:
    """``keys``, a struct per task and ``loss``, in one pass that encodes each batch once.

    ``aggregate`` makes a row's loss of the heads' losses that it has and their shares; null where no head has one.
    """
    wanted = [h.label_column for h in heads if h.label_column]
    slim = df.select(*dict.fromkeys([*keys, *inputs, *wanted]))
    kinds = ", ".join(f"`{h.task}` struct<{', '.join(part.replace(' ', ': ', 1) for part in h.result.split(', '))}>" for h in heads)
    schema = T.StructType([df.schema[k] for k in keys] + T._parse_datatype_string(f"{kinds}, loss double").fields)
    shares = {h.task: h.share for h in heads}
    arrow = to_arrow_schema(schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            read = encoder(b)
            found = {h.task: h.rows(read[h.output], b.column(h.label_column).to_pylist() if h.label_column else None) for h in heads}
            total = []
            for i in range(b.num_rows):
                own = {t: rows[i]["loss"] for t, rows in found.items() if rows[i]["loss"] is not None}
                total.append(aggregate(own, shares) if own else None)
            cols = [*(b.column(k) for k in keys), *(pa.array(found[h.task], arrow.field(h.task).type) for h in heads), pa.array(total, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, arrow.names)

    return slim.mapInArrow(batches, schema)


def vector_encoder(column: str) -> Encoder:
    """An encoder for a column of vectors, the same number of components in each row; null vectors are zeros."""

    def encode(b: pa.RecordBatch) -> dict[str, object]:
        rows = b.column(column).to_pylist()
        size = max((len(r) for r in rows if r is not None), default=0)
        return {"per_sequence": np.array([np.zeros(size) if r is None else r for r in rows], float).reshape(len(rows), size)}

    return encode


def fit_heads(df: DataFrame, features: str, tasks: Mapping[str, tuple[str, Task]], reg: float = 0.01, iterations: int = 30) -> list[Head]:
    """Linear heads fitted on one column of vectors: ``tasks`` has, by name, the kind (classification or regression) and the task."""
    work = df.withColumn("__x", array_to_vector(F.col(features).cast("array<double>")))
    out = []
    for name, (kind, task) in tasks.items():
        rows = work.where(F.col(task.label_column).isNotNull() & F.col(features).isNotNull())
        if kind == "regression":
            mean, scale = task.labels
            model = LinearRegression(featuresCol="__x", labelCol="__y", regParam=reg, maxIter=iterations).fit(rows.withColumn("__y", (F.col(task.label_column) - mean) / scale))
            out.append(make_head(kind, name, model.coefficients.toArray(), model.intercept))
        elif kind == "classification":
            number = F.array_position(F.array(*map(F.lit, task.labels)), F.col(task.label_column)) - 1
            model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=reg, maxIter=iterations, family="multinomial").fit(rows.withColumn("__y", number.cast("double")).where("__y >= 0"))
            out.append(make_head(kind, name, model.coefficientMatrix.toArray(), model.interceptVector.toArray()))
        else:
            raise ValueError(f"no fit for a head of kind {kind!r}")
    return out
