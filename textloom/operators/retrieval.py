"""Two towers for retrieval: queries and passages have an encoder each, fitted so that a query lies near its passage.

A tower is linear: a text is the mean of the vectors of its words, which are rows of a table of hashed words.  The fit sees batches of
(query, passage, hard negative): every query's own passage against all passages and hard negatives of its batch, by the softmax of
dot products, with AdaGrad steps; the shards' changes are averaged after each round (:mod:`textloom.operators.fitting`).  Each tower can
encode alone, so passages are encoded once and queries as they come; ``operators.ranking.similar`` ranks them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from textloom.operators.fitting import dealt, load_parameters, mean_change, save_parameters

_WORDS = re.compile(r"\w+")


def word_numbers(text: str | None, width: int) -> np.ndarray:
    """The hashed lower-case words of a text; the number 0 alone for a text without any."""
    found = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % (width - 1) + 1 for w in _WORDS.findall((text or "").lower())]
    return np.array(found or [0], np.int64)


def _means(table: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    sums = np.add.reduceat(table[np.concatenate(texts)], starts, axis=0)
    return sums / np.array([len(t) for t in texts])[:, None]


@dataclass
class TwoTowers:
    query: np.ndarray
    passage: np.ndarray

    @staticmethod
    def start(width: int, size: int, seed: int = 0) -> TwoTowers:
        """Both towers alike: before any fit they compare texts by their shared words."""
        table = np.random.RandomState(seed).normal(0, 1 / np.sqrt(size), (width, size))
        return TwoTowers(table, table.copy())

    def encode(self, texts: list[str | None], tower: str) -> np.ndarray:
        table = {"query": self.query, "passage": self.passage}[tower]
        return _means(table, [word_numbers(t, len(table)) for t in texts]) if texts else np.zeros((0, table.shape[1]))

    def save(self, spark: SparkSession, path: str) -> None:
        save_parameters(spark, {"query": self.query, "passage": self.passage}, {}, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TwoTowers:
        params, _ = load_parameters(spark, path)
        return TwoTowers(params["query"], params["passage"])


def in_batch_loss(q: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log softmax of the diagonal of q p^T, and its gradients; ``p`` may have more rows than ``q``."""
    z = q @ p.T
    z -= z.max(1, keepdims=True)
    e = np.exp(z)
    share = e / e.sum(1, keepdims=True)
    at = np.arange(len(q))
    loss = float(-np.log(share[at, at]).mean())
    share[at, at] -= 1
    share /= len(q)
    return loss, share @ p, share.T @ q


def _learn(batch: int, rate: float, scale: float):
    def work(it: Iterator[pa.RecordBatch], params: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], float]:
        tables = {k: params[k] for k in ("query", "passage")}
        first = {k: v.copy() for k, v in tables.items()}
        squares = {k: np.full(len(v), 1e-8) for k, v in tables.items()}
        held: list[tuple] = []
        n = 0

        def step() -> None:
            width = len(tables["query"])
            texts = {"query": [word_numbers(r[0], width) for r in held], "passage": [word_numbers(t, width) for k in (1, 2) for t in [r[k] for r in held] if k == 1 or t is not None]}
            _, *grads = in_batch_loss(*(scale * _means(tables[k], texts[k]) for k in ("query", "passage")))
            for k, g in zip(("query", "passage"), grads, strict=True):
                rows = np.concatenate(texts[k])
                sizes = [len(t) for t in texts[k]]
                per_word = np.repeat(scale * g / np.array(sizes)[:, None], sizes, axis=0)
                words, inverse = np.unique(rows, return_inverse=True)
                total = np.zeros((len(words), tables[k].shape[1]))
                np.add.at(total, inverse, per_word)
                squares[k][words] += (total**2).mean(1)
                tables[k][words] -= rate * total / np.sqrt(squares[k][words])[:, None]

        for b in it:
            for row in zip(*(b.column(c).to_pylist() for c in ("q", "p", "h")), strict=True):
                held.append(row)
                n += 1
                if len(held) == batch:
                    step()
                    held.clear()
        if len(held) > 1:
            step()
        return {k: v - first[k] for k, v in tables.items()}, float(n)

    return work


def fit_towers(
    pairs: DataFrame, key: str, query: str, passage: str, negative: str | None = None, width: int = 1 << 13, size: int = 32,
    rounds: int = 5, batch: int = 32, rate: float = 0.05, scale: float = 4.0, shards: int = 4, seed: int = 0,
) -> TwoTowers:
    """Fit on ``pairs``; rows without a query or a passage teach nothing, null negatives are left out of their batch.

    ``width`` and ``size`` bound the model; ``scale`` multiplies the vectors in the softmax.
    """
    columns = [F.col(query).alias("q"), F.col(passage).alias("p"), (F.col(negative) if negative else F.lit(None).cast("string")).alias("h")]
    rows = dealt(pairs.where(F.col(query).isNotNull() & F.col(passage).isNotNull()).select(F.col(key).alias("k"), *columns), "k", shards)
    model = TwoTowers.start(width, size, seed)
    params = {"query": model.query, "passage": model.passage}
    try:
        for _ in range(rounds):
            change, n = mean_change(rows, params, _learn(batch, rate, scale))
            params = {k: v + change.get(k, 0.0) for k, v in params.items()}
            if not n or not change:
                break
    finally:
        rows.unpersist()
    return TwoTowers(params["query"], params["passage"])


def embed(model: TwoTowers, df: DataFrame, text: str, tower: str, name: str = "v") -> DataFrame:
    """``df`` with the vectors of one tower, query or passage."""
    if tower not in ("query", "passage"):
        raise ValueError("a tower is query or passage")
    columns = df.columns

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = model.encode(part.column(text).to_pylist(), tower)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.tolist(), pa.list_(pa.float64()))], [*columns, name])

    return df.mapInArrow(batches, StructType(list(df.schema.fields)).add(name, ArrayType(DoubleType())))
