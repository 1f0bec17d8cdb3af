"""Exact top-k inner products with a pivot-distance index.

Vectors x get one more component, sqrt(M^2 - |x|^2) with M the largest norm, which turns the largest inner product into the
smallest distance (a query gets 0 there).  Each vector is keyed by its nearest pivot and its distance to it, and a pivot's
vectors are sorted by that distance and cut into rings (annuli).  For a query at distance d from a pivot, the triangle
inequality bounds the distance to any vector of a ring [a, b] from below by max(d - b, a - d, 0), and so its score from above.

The search expands from the query's own ring: that gives a first k-th score.  Then it takes, pivot by pivot, the rings whose
bound still reaches that score; the others are never read.  Inside a task the k-th scores rise further and stop more blocks.
The answer is exact for any data; the pivots only decide how much is skipped.

Scale: index rows are blocks of up to ``BLOCK`` vectors, query rows blocks of ``QUERIES``, both bounded; they meet in an
equi-join on the pivot, and only pairs of blocks that the bounds allow go on.  A task keeps the best k of the queries it sees and
gives them out merged.  To the driver go the sample for the pivots (``SAMPLE`` rows) and the extent of each ring (``PIVOTS`` x
``RINGS`` rows).  Of equal vectors only the k + 1 smallest ids can be in an answer, so a vector that a third of the rows share
leaves each task as k + 1 rows before it is shuffled.

Defined cases: vectors that are null, empty, of another length than the most frequent one, or hold null or non-finite
components take no part; rows without an id take no part; equal rows with equal ids count once; ties go to the smaller id; a
query with fewer candidates gets all of them; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import drop_table, materialise

PIVOTS, RINGS, SAMPLE = 32, 16, 4096
BLOCK, QUERIES = 1024, 256
#: A task holds the best k of so many query blocks before it gives them out.
HELD = 64
INDEX = "pivot int, ring int, n int, lo double, hi double, ids binary, data binary"
ASKED = "block long, pivot int, ring int, ids binary, taus binary, data binary"
NONE = -(2.0**62)


def clean_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float | None = 64.0) -> DataFrame:
    """``(id, v)``: the vectors that take part, as doubles; with ``scale`` each component x becomes floor(scale * x)."""
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0)).where(~odd)
    if scale is not None:
        rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    size = rows.agg(F.mode(F.size("v"), True)).first()[0]
    return rows.where(F.size("v") == (size or 0)).dropDuplicates(["id", "v"])


class Space:
    """The pivots and the bound M of the norms."""

    def __init__(self, sample: np.ndarray, norm2: float) -> None:
        self.norm2, self.dim = norm2, sample.shape[1]
        full = self.lift(sample)
        chosen = [0]
        far = ((full - full[0]) ** 2).sum(1)
        while len(chosen) < min(PIVOTS, len(full)):  # farthest first, then one step of means
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((full - full[chosen[-1]]) ** 2).sum(1))
        self.pivots = full[chosen]
        near = self.distances(full).argmin(1)
        self.pivots = np.array([full[near == p].mean(0) if (near == p).any() else self.pivots[p] for p in range(len(chosen))])
        dist = self.distances(full).min(1)
        self.edges = np.unique(np.quantile(dist, np.linspace(0, 1, RINGS + 1)[1:-1]))

    def lift(self, v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(self.norm2 - (v * v).sum(1), 0))[:, None]])

    def distances(self, full: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((full**2).sum(1)[:, None] + (self.pivots**2).sum(1)[None] - 2 * full @ self.pivots.T, 0))

    def bound(self, norms2: np.ndarray, dist: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The largest inner product that queries at ``dist`` can have in rings [lo, hi]; rounded up."""
        least = np.maximum(np.maximum(dist - hi, lo - dist), 0) * (1 - 1e-9) - 1e-6
        return (norms2 + self.norm2 - np.maximum(least, 0) ** 2) / 2 + 1e-6


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else pa.array(column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _keyed(rows: DataFrame, space: Space, own: bool) -> DataFrame:
    """Add pivot, ring and distance; ``own``: of a query, which has 0 in the added component."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            v = _matrix(b.column("v"), space.dim)
            dist = space.distances(np.hstack([v, np.zeros((len(v), 1))]) if own else space.lift(v))
            near = dist.argmin(1) if len(v) else np.zeros(0, int)
            d = dist[np.arange(len(v)), near]
            more = [pa.array(near, pa.int32()), pa.array(np.searchsorted(space.edges, d), pa.int32()), pa.array(d)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "pivot", "ring", "dist"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(batches, f"{kinds}, pivot int, ring int, dist double")


def build_index(vectors: DataFrame, space: Space, k: int, small: bool) -> DataFrame:
    """Blocks of the index (``INDEX``); every row of ``vectors(id, v)`` is in it, but for equal vectors' ids beyond k + 1."""
    dtype = np.float32 if small else np.float64
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = _keyed(vectors.withColumn("__r", rank).where(F.col("__r") <= k + 1).drop("__r"), space, own=False)
    rows = rows.repartition("pivot", "ring", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("pivot", "ring", "dist")

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(part: list) -> pa.RecordBatch:
            ids, v, d = (np.concatenate(x) for x in zip(*(p[1:] for p in part), strict=True))
            order = np.argsort(ids, kind="stable")
            row = [*part[0][0], len(ids), float(d.min()), float(d.max()), ids[order].tobytes(), v[order].astype(dtype).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, KINDS, strict=True)], NAMES)

        held: list = []
        for b in it:
            key = np.stack([b.column("pivot").to_numpy(), b.column("ring").to_numpy()], 1)
            ids, v, d = b.column("id").to_numpy(), _matrix(b.column("v"), space.dim), b.column("dist").to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(ids)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                while i < j:
                    name = (int(key[i][0]), int(key[i][1]))
                    n = sum(len(p[1]) for p in held)
                    if held and (held[0][0] != name or n >= BLOCK):
                        yield pack(held)
                        held, n = [], 0
                    take = min(j - i, BLOCK - n)
                    held.append((name, ids[i : i + take], v[i : i + take], d[i : i + take]))
                    i += take
        if held:
            yield pack(held)

    NAMES, KINDS = ["pivot", "ring", "n", "lo", "hi", "ids", "data"], [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
    return rows.mapInArrow(blocks, INDEX)


def _ask(rows: DataFrame, space: Space, small: bool, rings: list | None) -> DataFrame:
    """Query blocks (``ASKED``) from ``rows(id, v, pivot, ring, dist, tau)``.

    Without ``rings`` a block asks for the ring of its own rows, with the extents of all rings for those its bounds allow.
    """
    dtype = np.float32 if small else np.float64
    rows = rows.repartition("pivot", "ring").sortWithinPartitions("pivot", "ring", "dist", "id")

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            key = np.stack([b.column("pivot").to_numpy(), b.column("ring").to_numpy()], 1)
            ids, v, tau = b.column("id").to_numpy(), _matrix(b.column("v"), space.dim), b.column("tau").to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(ids)]
            parts = [slice(s, min(s + QUERIES, j)) for i, j in zip(cuts, cuts[1:], strict=False) for s in range(i, j, QUERIES)]
            out = []
            for s in parts:
                payload = (ids[s].tobytes(), tau[s].astype(float).tobytes(), v[s].astype(dtype).tobytes())
                block = int(ids[s][0])
                if rings is None:
                    out.append((block, int(key[s][0][0]), int(key[s][0][1]), *payload))
                    continue
                dist = space.distances(np.hstack([v[s], np.zeros((len(v[s]), 1))]))
                norms2 = (v[s] ** 2).sum(1)
                for pivot, ring, lo, hi in rings:
                    if (space.bound(norms2, dist[:, pivot], lo, hi) >= tau[s]).any():
                        out.append((block, pivot, ring, *payload))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 64], strict=True), kinds, strict=True)], ["block", "pivot", "ring", "ids", "taus", "data"])

    return rows.mapInArrow(blocks, ASKED)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller id."""
    if scores.shape[1] > 4 * k:  # all that reach the k-th score, ties included, are among the first n
        least = np.partition(scores, scores.shape[1] - k, 1)[:, scores.shape[1] - k]
        n = int((scores >= least[:, None]).sum(1).max())
        keep = np.argpartition(-scores, min(n, scores.shape[1] - 1), 1)[:, :n]
        scores, ids = np.take_along_axis(scores, keep, 1), np.take_along_axis(ids, keep, 1)
    order = np.lexsort((ids, -scores))[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _score(pairs: DataFrame, space: Space, k: int, small: bool) -> DataFrame:
    """``(query_id, vec_id, score)``: of each task, the best k of each query in the blocks that it met."""
    dtype = np.float32 if small else np.float64

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for own, best, ids, _ in held.values():
                row, col = np.nonzero(best > NONE)
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(ids[row, col]), pa.array(best[row, col])], ["query_id", "vec_id", "score"])
            held.clear()

        for b in it:
            names = ("block", "pivot", "lo", "hi", "q_ids", "q_taus", "q_data", "ids", "data")
            for block, pivot, lo, hi, q_ids, q_taus, q_data, x_ids, x in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                q = np.frombuffer(q_data, dtype).reshape(-1, space.dim).astype(float)
                if block not in held:
                    if len(held) >= HELD:
                        yield from flush()
                    held[block] = [np.frombuffer(q_ids, np.int64), np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max), np.frombuffer(q_taus, float).copy()]
                own, best, best_ids, tau = held[block]
                dist = space.distances(np.hstack([q, np.zeros((len(q), 1))]))[:, pivot]
                open_ = np.flatnonzero(space.bound((q * q).sum(1), dist, lo, hi) >= np.maximum(tau, best[:, -1]))
                if not len(open_):
                    continue
                ids = np.frombuffer(x_ids, np.int64)
                scores = q[open_] @ np.frombuffer(x, dtype).reshape(-1, space.dim).astype(float).T
                scores[own[open_][:, None] == ids[None]] = NONE
                found, found_ids = _best(scores, np.broadcast_to(ids, scores.shape), k)
                best[open_], best_ids[open_] = _best(np.hstack([best[open_], found]), np.hstack([best_ids[open_], found_ids]), k)
        yield from flush()

    return pairs.mapInArrow(batches, "query_id long, vec_id long, score double")


def _pairs(asked: DataFrame, index: DataFrame) -> DataFrame:
    a = asked.select("block", "pivot", "ring", F.col("ids").alias("q_ids"), F.col("taus").alias("q_taus"), F.col("data").alias("q_data"))
    return a.join(index, ["pivot", "ring"])


def top_k(
    table: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: float | None = 64.0,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the rows for which ``is_query`` (on column ``id``) holds, against all others."""
    vectors = clean_vectors(table, vec_id, vector, scale)
    schema = "query_id long, rank int, vec_id long, score double"
    most = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if most[0] is None:
        return table.sparkSession.createDataFrame([], schema)
    sample = vectors.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(SAMPLE).collect()
    space = Space(np.array([r["v"] for r in sample], float), float(most[0]))
    small = most[1] < 2**24 and scale is not None  # integers that a float holds exactly
    index = materialise(build_index(vectors, space, k, small), "pivot-index")
    rings = [tuple(r) for r in index.groupBy("pivot", "ring").agg(F.min("lo"), F.max("hi")).collect()]
    asked = materialise(_keyed(vectors.where(is_query), space, own=True), "pivot-queries")
    # the ring of the nearest pivot that holds vectors at about the query's distance
    near = _ask(asked.withColumn("tau", F.lit(NONE)), space, small, None)
    first = _score(_pairs(near, index), space, k, small)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("r", F.row_number().over(best)).where(f"r <= {k}").groupBy("query_id").agg(F.max("r").alias("r"), F.min("score").alias("s"))
    kth = kth.where(f"r = {k}").select(F.col("query_id").alias("id"), F.col("s").alias("tau"))
    known = asked.join(kth, "id", "left").withColumn("tau", F.coalesce("tau", F.lit(NONE)))
    found = _score(_pairs(_ask(known, space, small, rings), index), space, k, small)
    out = found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
    return out.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def forget(*tables: DataFrame) -> None:
    for t in tables:
        drop_table(t)
