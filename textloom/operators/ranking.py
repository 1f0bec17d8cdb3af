"""Ranking: candidates, runs, reciprocal ranks, similarity search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: So many queries of a block are scored at once: a block's scores are not held as a whole.
SLICE = 256
#: So many items are scored at once.
PIECE = 4096
#: Where more pairs than this stay in question (many equal scores), a slice's queries are ranked one by one.
PAIRS = 1 << 21
#: Bytes of a block of items' vectors.
ITEM_BYTES = 1 << 24


def top_ranked(scores: DataFrame, query: str, item: str, score: str, n: int) -> DataFrame:
    """The n best items of each query, ties by item; partial limits run before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), item))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n)


def labelled_candidates(candidates: DataFrame, queries: DataFrame, passages: DataFrame, relevant: DataFrame) -> DataFrame:
    """(qid, pid) with query and passage text and whether the pair is relevant; Catalyst picks each join's way by size."""
    marked = candidates.join(relevant.select("qid", "pid", F.lit(1).alias("label")), ["qid", "pid"], "left")
    out = marked.join(queries, "qid").join(passages, "pid")
    return out.withColumn("label", F.coalesce("label", F.lit(0)))


def mean_reciprocal_rank(run: DataFrame, relevant: DataFrame, most: int = 10) -> DataFrame:
    """Sum of 1 / rank of the first relevant item within ``most``, over all queries with relevant items."""
    hits = run.join(relevant, ["qid", "pid"]).where(F.col("rank") <= most).groupBy("qid").agg(F.min("rank").alias("first"))
    n = relevant.agg(F.countDistinct("qid").alias("n"))
    total = hits.agg(F.coalesce(F.sum(1 / F.col("first")), F.lit(0.0)).alias("s"), F.count("*").alias("found"))
    return total.crossJoin(n).select(F.round(F.col("s") / F.col("n"), 6).alias("mrr"), "found", F.col("n").alias("queries"))  # one row each


def repeated_items(run: DataFrame, query: str = "qid", item: str = "pid") -> DataFrame:
    """Items that a query ranks more than once."""
    return run.groupBy(query, item).agg(F.count("*").alias("times")).where("times > 1")


def _likely(x: np.ndarray, y: np.ndarray, n: int, left_out: list[tuple[int, list[int]]], unused: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(row of x, row of y) of all pairs whose product may be among the n largest of the row of x, or within 2e-4 of them; None if they are too many.

    ``left_out`` has items that take no part for a row of x, ``unused`` those that do for none.

    Items come in pieces of ``PIECE``; the n-th best of those before is what a score has to reach.  Products are of single precision where
    that bounds their error, and the bound is allowed for.
    """
    long_x, long_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    most = long_x * long_y.max()
    single = most.max() < 1e30 and max(long_x.max(), long_y.max()) < 1e30
    kind, error = (np.float32, 2.0**-23) if single else (np.float64, 2.0**-52)
    slack = (2e-4 + 4 * (x.shape[1] + 4) * error * most).astype(kind)
    some, items = x.astype(kind), y.astype(kind)
    best = np.full((len(x), n), -np.inf, kind)
    rows, cols, vals = [], [], []
    for at in range(0, len(y), PIECE):
        scores = some @ items[at : at + PIECE].T
        for r, own in left_out:
            scores[r, [i - at for i in own if at <= i < at + PIECE]] = np.nan  # reaches nothing
        scores[:, unused[(unused >= at) & (unused < at + PIECE)] - at] = np.nan
        reached = np.nan_to_num(best.min(1) - slack, nan=-np.inf, neginf=-np.inf)
        if at == 0 and scores.shape[1] > n:
            top = np.partition(np.nan_to_num(scores, nan=-np.inf) if left_out or len(unused) else scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n :]
            best = top
            reached = best.min(1) - slack
        r, c = np.nonzero(scores >= reached[:, None])
        v = scores[r, c]
        if at and len(r):
            count = np.bincount(r, minlength=len(x))
            wide = np.full((len(x), n + int(count.max())), -np.inf, kind)
            wide[:, :n] = best
            wide[r, n + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)] = v
            best = np.partition(wide, wide.shape[1] - n, axis=1)[:, wide.shape[1] - n :]
        elif not at and scores.shape[1] <= n:
            best[:, : scores.shape[1]] = np.nan_to_num(scores, nan=-np.inf)
        rows.append(r)
        cols.append(c + at)
        vals.append(v)
        if sum(map(len, vals)) > PAIRS:
            return None
    row, col, val = (np.concatenate(z) for z in (rows, cols, vals))
    kept = val >= (best.min(1) - slack)[row]
    row, col = row[kept], col[kept]
    order = np.argsort(row, kind="stable")
    return row[order], col[order]


def similar(queries: DataFrame, items: DataFrame, n: int, measure: str = "dot", query_rows: int = 8192, item_rows: int | None = None, known: tuple[int, int, int] | None = None) -> DataFrame:
    """The n most similar items ``(id, v)`` of each query ``(qid, q)`` of a stated query set, blockwise: ``(qid, id, score, rank)``.

    Queries and items are dealt evenly to blocks of about these many rows (items: 16,384, or as many as have ``ITEM_BYTES``), so the blocks follow
    the tables; each block of queries meets each block of items in one task, by matrix products of ``SLICE`` queries and ``PIECE`` items, of which the
    best n of a query go on to the final ranking.  A row is sent once for each block of the other side, so what is shuffled falls with the size of the
    blocks.  Scores are rounded to four places, ties go to smaller ids, a cosine with a vector of zeros is null and comes last.  Null vectors
    take no part; vectors are of one length.  ``known`` spares a count: the numbers of queries and of items, and the vectors' length.
    """
    asked, held = queries.where("q IS NOT NULL"), items.where("v IS NOT NULL")
    if known is None:
        count, length = held.agg(F.count("*"), F.max(F.size("v"))).first()
        known = asked.count(), count, length or 1
    item_rows = item_rows or max(16384, ITEM_BYTES // (8 * known[2]))
    groups, blocks = (max(1, -(-count // rows)) for count, rows in ((known[0], query_rows), (known[1], item_rows)))
    deal = lambda k: F.pmod(F.monotonically_increasing_id(), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asked.select("qid", F.col("q").cast("array<double>").alias("q"), deal(groups).alias("g")).withColumn("b", every(blocks))
    right = held.select("id", F.col("v").cast("array<double>").alias("v"), deal(blocks).alias("b")).withColumn("g", every(groups))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "qid"), (held, "id"))]

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        names = b.column("id").combine_chunks()
        matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        rows, cols, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if a.num_rows and b.num_rows:
            x, y = matrix(a, "q"), matrix(b, "v")
            asked_ids, ids = a.column("qid").to_pylist(), names.to_pylist()
            order, places = [], {}
            wanted = set(asked_ids)
            for i, name in enumerate(ids):
                if name in wanted:
                    places.setdefault(name, []).append(i)
            sizes = [np.linalg.norm(z, axis=1) for z in (x, y)]
            whole = lambda z, size: np.divide(z, size[:, None], out=np.zeros(z.shape), where=size[:, None] > 0)
            p, q = (whole(z, size) for z, size in zip((x, y), sizes, strict=True)) if measure == "cosine" else (x, y)
            # a vector of zeros has no cosine and comes last
            zero = np.flatnonzero(sizes[1] == 0) if measure == "cosine" else np.zeros(0, np.int64)
            plain = not (np.isfinite(x).all() and np.isfinite(y).all()) or (len(zero) and len(y) - len(zero) < n + max(map(len, places.values()), default=0))

            def scored(row: np.ndarray, col: np.ndarray) -> np.ndarray:
                score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[row[i : i + 65536]], y[col[i : i + 65536]]) for i in range(0, len(row), 65536))])
                if measure != "cosine":
                    return score
                size = sizes[0][row] * sizes[1][col]
                return np.divide(score, size, out=np.full(len(score), -np.inf), where=size > 0)

            def fewer(col: np.ndarray, score: np.ndarray) -> np.ndarray:
                """Where the items are that may be among the n best of a query, at most a few times n."""
                kept = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n] - 2e-4)  # what rounding may lift to the n-th score
                if len(kept) > 3 * n:  # many equal scores: n of each are enough
                    if not order:
                        ranks = np.empty(len(ids), np.int64)
                        ranks[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
                        order.append(ranks)
                    level = np.round(score[kept], 4)
                    by = np.lexsort((order[0][col[kept]], -level))
                    kept, level = kept[by], level[by]
                    kept = kept[np.arange(len(kept)) - np.searchsorted(-level, -level, side="left") < n]
                return kept

            def take(r: int, col: np.ndarray, score: np.ndarray) -> None:
                kept = fewer(col, score) if len(col) > n else np.arange(len(col))
                rows.append(np.full(len(kept), r))
                cols.append(col[kept])
                found.append(score[kept])

            every_one = np.arange(len(y))
            for first in range(0, len(x), SLICE):
                part = asked_ids[first : first + SLICE]
                left_out = [(r, places[name]) for r, name in enumerate(part) if name in places]
                likely = None if plain else _likely(p[first : first + SLICE], q, n, left_out, zero)
                alone = set(range(len(part))) if likely is None else set(np.flatnonzero(sizes[0][first : first + SLICE] == 0).tolist() if measure == "cosine" else ())
                for r in sorted(alone):
                    col = np.delete(every_one, places[part[r]]) if part[r] in places else every_one
                    take(r + first, col, scored(np.full(len(col), r + first), col))
                if likely is None:
                    continue
                row, col = likely
                score = scored(row + first, col)
                counts = np.bincount(row, minlength=len(part))
                ends = np.concatenate([[0], np.cumsum(counts)])
                many = [r for r in np.flatnonzero(counts > 3 * n).tolist() if r not in alone]
                for r in many:
                    take(r + first, col[ends[r] : ends[r + 1]], score[ends[r] : ends[r + 1]])
                rest = ~np.isin(row, [*alone, *many])
                rows.append(row[rest] + first)
                cols.append(col[rest])
                found.append(score[rest])
        row, col, score = (np.concatenate(z) for z in (rows, cols, found))
        return pa.table({"qid": a.column("qid").combine_chunks().take(pa.array(row)), "id": names.take(pa.array(col)), "score": pa.array(score, mask=np.isinf(score))})

    met = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(best, f"qid {kinds[0]}, id {kinds[1]}, score double")
    return top_ranked(met.withColumn("score", F.round("score", 4)), "qid", "id", "score", n)


def positive_ranks(scores: DataFrame, query: str, item: str, score: str, positive: str) -> DataFrame:
    """Mean rank (from 0) of the best positive item of each query."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), item)) - 1
    best = scores.withColumn("r", rank).where(positive).groupBy(query).agg(F.min("r").alias("r"))
    return best.agg(F.round(F.avg("r"), 6).alias("avg_rank"), F.count("*").alias("queries"))


def log_softmax(scores: DataFrame, query: str, score: str) -> DataFrame:
    """Add ``log_p``, the log of the softmax over the items of a query."""
    one = Window.partitionBy(query)
    top = F.max(score).over(one)
    return scores.withColumn("__t", top).withColumn("log_p", F.col(score) - F.col("__t") - F.log(F.sum(F.exp(F.col(score) - F.col("__t"))).over(one))).drop("__t")
