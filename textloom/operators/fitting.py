"""Fits over partitions: every task learns on its rows from the same parameters, and what the tasks changed is averaged.

The rows are dealt once to a stated number of shards by a hash of their key and sorted by it, so a fit does not depend on the cluster.
A round is one job: a task reads its shard as a stream and sends the blocks of parameters that it changed; Spark sums them, and
one number per parameter comes to the driver.  Parameters are arrays of a size that the caller states (features are hashed), so
neither the driver nor a task holds anything that grows with the rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Parameters = dict[str, np.ndarray]
#: Work of a task: batches of its rows and the parameters, to (what changed, weight of the shard).
Work = Callable[[Iterator[pa.RecordBatch], Parameters], tuple[Parameters, float]]
BLOCK = 256


def dealt(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """The rows in ``shards`` partitions, each in the order of a hash of the key; kept for the rounds of a fit."""
    order = F.xxhash64(F.col(key).cast("string"))
    return rows.repartition(shards, order).sortWithinPartitions(order, key).persist(StorageLevel.MEMORY_AND_DISK)


def mean_change(rows: DataFrame, params: Parameters, work: Work) -> tuple[Parameters, float]:
    """The shards' mean change of each array that ``work`` names, weighted, and the sum of the weights."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes, weight = work(it, {k: v.copy() for k, v in params.items()})
        names, places, parts = [""], [0], [[]]  # this row counts the shard
        for name, change in changes.items():
            flat = change.ravel()
            flat = np.pad(flat, (0, -len(flat) % BLOCK)).reshape(-1, BLOCK)
            for place in np.flatnonzero(np.abs(flat).sum(1)).tolist():
                names.append(name)
                places.append(place)
                parts.append((flat[place] * weight).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array(places, pa.int32()), pa.array([weight] * len(names), pa.float64()), pa.array(parts, pa.list_(pa.float64()))], ["name", "place", "weight", "x"]
        )

    sent = rows.mapInArrow(batches, "name string, place int, weight double, x array<double>")
    add = lambda a, x: F.when(F.size(a) == 0, x).otherwise(F.zip_with(a, x, lambda p, q: p + q))
    # a list has one entry a shard at most
    lists = sent.groupBy("name", "place").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_list("x")).alias("xs"))
    found = lists.select("name", "place", "weight", F.aggregate("xs", F.array().cast("array<double>"), add).alias("x")).toArrow().to_pylist()
    total = sum(r["weight"] for r in found if r["name"] == "")
    out: Parameters = {}
    for r in found:
        if r["name"]:
            like = params[r["name"].removeprefix("mean_")]
            flat = out.setdefault(r["name"], np.zeros(-(-like.size // BLOCK) * BLOCK))
            flat[r["place"] * BLOCK : (r["place"] + 1) * BLOCK] = np.array(r["x"]) / total
    return {k: v[: params[k.removeprefix("mean_")].size].reshape(params[k.removeprefix("mean_")].shape) for k, v in out.items()}, total


def latest_runs(names: DataFrame, name: str, keep: int = 1) -> DataFrame:
    """The ``keep`` last of checkpoints named ``epoch_<n>_step_<m>``, the last one first; other names are left out."""
    part = lambda i: F.regexp_extract(name, r"epoch_(\d+)_step_(\d+)$", i).cast("long")
    found = names.where(F.col(name).rlike(r"epoch_\d+_step_\d+$")).withColumns({"epoch": part(1), "step": part(2)})
    return found.orderBy(F.desc("epoch"), F.desc("step")).limit(keep)


def save_parameters(spark: SparkSession, params: Parameters, settings: dict, path: str) -> None:
    """Arrays and settings of a model as a small Parquet table."""
    rows = [("", 0, json.dumps(settings), [])]
    for name, x in params.items():
        flat = x.astype(float).ravel().tolist()
        rows += [(name, i, json.dumps(list(x.shape)), flat[i : i + 65536]) for i in range(0, max(len(flat), 1), 65536)]
    spark.createDataFrame(rows, "name string, at int, about string, x array<double>").coalesce(1).write.parquet(path)


def load_parameters(spark: SparkSession, path: str) -> tuple[Parameters, dict]:
    settings, parts, shapes = {}, {}, {}
    for r in sorted(spark.read.parquet(path).toArrow().to_pylist(), key=lambda r: (r["name"], r["at"])):
        if r["name"]:
            parts.setdefault(r["name"], []).append(np.array(r["x"], float))
            shapes[r["name"]] = json.loads(r["about"])
        else:
            settings = json.loads(r["about"])
    return {k: np.concatenate(v).reshape(shapes[k]) for k, v in parts.items()}, settings
