"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, subtracted between versions and peeled.

A text is cut at line breaks and after sentence marks, and what is still longer than ``LONGEST`` words in pieces of that many; these are its
paragraphs here, compared word by word.  The k-th copy of a paragraph counts as a paragraph of its own.  Each digest (64 bits) enters
one cell in each of three tables of ``size`` cells; a cell holds a count, the sum of its digests and the sum of their checks.  The
fingerprint is the cells of the smallest size as text, so equal texts have equal fingerprints.

Two sketches of one size subtract cell by cell: what both texts hold vanishes.  A cell that is left with count 1 or -1 and a fitting check
holds one digest that only one text has; it is taken out of its other cells, which frees further ones.  Peeling has failed when
cells are left or when the numbers of shared paragraphs do not agree; then both sketches are made again, four times larger,
until it succeeds.  Likeness is shared paragraphs over all paragraphs of both; 1 where neither text has one.

Scale: ``fingerprint_texts`` and ``compare_versions`` are one pass without a shuffle; all texts of a slice are peeled at once.
``edit_with_next`` needs each document beside its neighbour in descending order of ids: documents are shuffled once by ranges of
(id, hash of the text, row), so that rows of one id spread as well, and a task streams its range with one row in hand.  Only the first and
last row of a range meet through a table; the numbers of the ranges are all that comes to the driver.  Memory grows with the
largest document.

Defined cases: a null text is empty; an empty text has no paragraph; rows of one id are ordered by a hash of their texts, so repeated
rows follow one another; null ids come last; a table of one row is its own neighbour; an empty table gives an empty result.  Extra
columns are ignored, and ``keep`` may hold any name but those of the results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import grown, materialise
from textloom.llm.fim import Runs

#: Cells of each of the three tables at first, and by how much they grow when peeling fails.
SIZE, GROWTH = 4, 4
LONGEST, SLICE = 32, 256
#: Odd multipliers for the place in each table, then for the check: of the upper and lower half of a digest, then of their mixture.
MIX = ((1779033703, 1013904243, 1640531527), (1359893119, 528734635, 2024237689), (1541459225, 1203062813, 1266489917), (1367130551, 987654321, 1540483477))

_PIECES = re.compile(rb"[^\n.!?]*[\n.!?]+|[^\n.!?]+")


def paragraphs(text: bytes) -> list[bytes]:
    found = []
    for piece in _PIECES.findall(text):
        words = piece.split()
        found += [b" ".join(words[i : i + LONGEST]) for i in range(0, len(words), LONGEST)]
    return found


def digests(text: bytes) -> np.ndarray:
    """One 64-bit digest per paragraph; copies differ by their number."""
    seen: dict[bytes, int] = {}
    out = bytearray()
    for p in paragraphs(text):
        k = seen[p] = seen.get(p, 0) + 1
        out += hashlib.md5(b"%d:%b" % (k, p), usedforsecurity=False).digest()[:8]
    return np.frombuffer(bytes(out), ">u8").astype(np.uint64)


def _mixed(keys: np.ndarray, j: int) -> np.ndarray:
    a, b, c = (np.uint64(x) for x in MIX[j])
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    x = (keys >> half) * a + (keys & low) * b
    return (((x >> half) ^ (x & low)) * c) >> np.uint64(16)  # no sum of digests keeps it


def checks(keys: np.ndarray) -> np.ndarray:
    return _mixed(keys, 3) & np.uint64(0xFFFFFFFF)


class Sketches:
    """The sketches of ``n`` texts or differences of texts; sums are modulo 2^64."""

    def __init__(self, n: int, size: int) -> None:
        self.n, self.size = n, size
        self.count = np.zeros(n * 3 * size, np.int64)
        self.keys, self.checks = (np.zeros(n * 3 * size, np.uint64) for _ in range(2))

    def places(self, keys: np.ndarray, owner: np.ndarray, j: int) -> np.ndarray:
        return (owner * 3 + j) * self.size + (_mixed(keys, j) & np.uint64(self.size - 1)).astype(np.int64)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Add (sign 1) or take out (-1) digests; the cells that they stand in."""
        signed, check = (np.where(sign > 0, x, np.uint64(0) - x) for x in (keys, checks(keys)))
        at = np.concatenate([self.places(keys, owner, j) for j in range(3)])
        np.add.at(self.count, at, np.tile(sign, 3))
        np.add.at(self.keys, at, np.tile(signed, 3))
        np.add.at(self.checks, at, np.tile(check, 3))
        return at

    def text(self, i: int) -> str:
        own = slice(i * 3 * self.size, (i + 1) * 3 * self.size)
        low = self.checks[own] & np.uint64(0xFFFFFFFF)
        return "".join([f"{c:08x}{k:016x}{x:08x}" for c, k, x in zip(self.count[own].tolist(), self.keys[own].tolist(), low.tolist(), strict=True)])

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests found, whose they are, their signs, and for each of the ``n`` whether nothing is left."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cells = np.arange(len(self.count))
        for _ in range(3 * self.size):
            cells = cells[np.abs(self.count[cells]) == 1]
            sign = self.count[cells]
            keys, check = (np.where(sign > 0, x[cells], np.uint64(0) - x[cells]) for x in (self.keys, self.checks))
            owner, table = cells // (3 * self.size), cells // self.size % 3
            here = np.choose(table, [self.places(keys, owner, j) for j in range(3)]) == cells if len(cells) else np.zeros(0, bool)
            fits = here & (checks(keys) == check & np.uint64(0xFFFFFFFF))
            keys, owner, sign = keys[fits], owner[fits], sign[fits]
            order = np.lexsort((keys, owner))
            keys, owner, sign = keys[order], owner[order], sign[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            if not len(keys):
                break
            keys, owner, sign = keys[fresh], owner[fresh], sign[fresh]
            found.append((keys, owner, sign))
            cells = np.unique(self.add(keys, owner, -sign))
        left = np.zeros(self.n, bool)
        left[np.flatnonzero((self.count != 0) | (self.keys != 0) | ((self.checks & np.uint64(0xFFFFFFFF)) != 0)) // (3 * self.size)] = True
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), ~left
        return *(np.concatenate(x) for x in zip(*found, strict=True)), ~left


def sketch(parts: list[np.ndarray], size: int = SIZE) -> Sketches:
    """The sketches of texts, given by their digests."""
    out = Sketches(len(parts), size)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    keys = np.concatenate([*parts, np.zeros(0, np.uint64)])
    out.add(keys, owner, np.ones(len(keys), np.int64))
    return out


def fingerprint(text: bytes, size: int = SIZE) -> str:
    return sketch([digests(text)], size).text(0)


def subtract(a: str, b: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The digests that only the first and only the second of two fingerprints of one size holds, or None where peeling fails."""
    if len(a) != len(b):
        raise ValueError("fingerprints of different sizes")
    out = Sketches(1, len(a) // 96)
    for text, sign in ((a, 1), (b, -1)):
        for i in range(len(out.count)):
            cell = text[32 * i : 32 * i + 32]
            out.count[i] += sign * int(cell[:8], 16)
            for sums, part in ((out.keys, cell[8:24]), (out.checks, cell[24:])):
                sums[i] = (int(sums[i]) + sign * int(part, 16)) % 2**64
    keys, _, sign, done = out.peel()
    return (keys[sign > 0], keys[sign < 0]) if done[0] else None


def compare(olds: list[np.ndarray], news: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each pair of texts, given by digests: those only the old and only the new one holds, and the size that told them."""
    out: list[tuple[np.ndarray, np.ndarray, int]] = [(np.zeros(0, np.uint64),) * 2 + (SIZE,)] * len(olds)
    todo, size = list(range(len(olds))), SIZE
    while todo:
        both = sketch([olds[i] for i in todo], size)
        parts = [news[i] for i in todo]
        keys = np.concatenate([*parts, np.zeros(0, np.uint64)])
        both.add(keys, np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.full(len(keys), -1, np.int64))
        keys, owner, sign, done = both.peel()
        order = np.argsort(owner, kind="stable")
        keys, owner, sign = keys[order], owner[order], sign[order]
        bounds = np.searchsorted(owner, np.arange(len(todo) + 1))
        again = []
        for at, i in enumerate(todo):
            own = slice(bounds[at], bounds[at + 1])
            k, s = keys[own], sign[own]
            a, b = k[s > 0], k[s < 0]
            if done[at] and len(olds[i]) - len(a) == len(news[i]) - len(b):
                out[i] = a, b, size
            else:
                again.append(i)
        todo, size = again, size * GROWTH
    return out


def likeness(old: np.ndarray, new: np.ndarray, found: tuple[np.ndarray, np.ndarray, int]) -> float:
    whole = len(old) + len(found[1])
    return (len(old) - len(found[0])) / whole if whole else 1.0


def fingerprint_texts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", size: int = SIZE) -> DataFrame:
    """``keep``, n_paragraphs and the fingerprint of every row; ``size`` is a power of two."""
    held = [f"k{i}" for i in range(len(keep))]
    slim = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, held, strict=True)], F.coalesce(F.col(text), F.lit("")).alias("t"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                parts = [digests(t) for t in b.column("t").cast(pa.binary()).to_pylist()]
                made = sketch(parts, size)
                cols = [pa.array([len(p) for p in parts], pa.int64()), pa.array([made.text(i) for i in range(len(parts))], pa.string())]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in held), *cols], [*keep, "n_paragraphs", "fingerprint"])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(batches, f"{kept}{', ' if keep else ''}n_paragraphs long, fingerprint string")


def compare_versions(pairs: DataFrame, old: str, new: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, both fingerprints, the digests removed and added, likeness, and the cells of a table that told them, of every row."""
    held = [f"k{i}" for i in range(len(keep))]
    slim = pairs.select(*[F.col(c).alias(n) for c, n in zip(keep, held, strict=True)], *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((old, "a"), (new, "b"))])
    names = [*keep, "fingerprint", "new_fingerprint", "removed", "added", "likeness", "cells"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexes = lambda keys: [f"{k:016x}" for k in sorted(keys.tolist())]
        for whole in it:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                olds, news = ([digests(t) for t in b.column(c).cast(pa.binary()).to_pylist()] for c in "ab")
                found = compare(olds, news)
                x, y = sketch(olds), sketch(news)
                cols = [pa.array([s.text(i) for i in range(b.num_rows)], pa.string()) for s in (x, y)]
                cols += [pa.array([hexes(f[i]) for f in found], pa.list_(pa.string())) for i in (0, 1)]
                cols += [pa.array([likeness(*r) for r in zip(olds, news, found, strict=True)], pa.float64()), pa.array([f[2] for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in held), *cols], names)

    kept = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep)
    more = "fingerprint string, new_fingerprint string, removed array<string>, added array<string>, likeness double, cells long"
    return slim.mapInArrow(batches, f"{kept}{', ' if keep else ''}{more}")


_EDITED = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_cells", "next_cells"]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]


def _edit(texts: list[bytes], nexts: list[bytes], own: list[np.ndarray], following: list[np.ndarray]) -> list[pa.Array]:
    """The result columns of texts and their neighbours, given with their digests."""
    edited, sizes = [], []
    for t, x in zip(texts, nexts, strict=True):
        runs = Runs(t)
        sizes.append(runs.n)
        edited.append(t[: runs.offset(runs.n - runs.n // 2)] + x[: Runs(x).offset(runs.n // 2)])
    new = [digests(t) for t in edited]
    near, far = compare(own, new), compare(own, following)
    a, b, n = sketch(own), sketch(new), range(len(texts))
    cols = [sizes, [hashlib.sha256(t).hexdigest() for t in edited], [a.text(i) for i in n], [b.text(i) for i in n]]
    cols += [[likeness(own[i], new[i], near[i]) for i in n], [likeness(own[i], following[i], far[i]) for i in n], [f[2] for f in near], [f[2] for f in far]]
    return [pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)]


def edit_with_next(docs: DataFrame) -> DataFrame:
    """Every document against itself with its last half replaced from the next one, and against the next one, in descending order of ids.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the cells of a table that told each.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").alias("d"), F.coalesce("text", F.lit("")).alias("t")).withColumns({"h": F.xxhash64("t"), "r": F.monotonically_increasing_id()})
    order = [F.col("d").desc_nulls_last(), F.col("h"), F.col("r")]
    ranges = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("d", "t")
    kind = docs.schema["doc_id"].dataType.simpleString()
    results = ", ".join(f"{n} {t}" for n, t in zip(_EDITED, ["long", "string", "string", "string", "double", "double", "long", "long"], strict=True))

    # a range gives its results; the text of its first row, and its last row, whose neighbour is in another range
    def stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["d", *_EDITED, "part", "edge", "t"]
        texts: list[bytes] = []
        own: list[np.ndarray] = []
        ids: pa.Array | None = None

        def edge(d: pa.Array, name: str, text: bytes) -> pa.RecordBatch:
            t = pc.cast(pa.array([text], pa.binary()), pa.string(), safe=False)
            return pa.RecordBatch.from_arrays([d, *(pa.nulls(1, k) for k in _KINDS), pa.array([part], pa.int32()), pa.array([name], pa.string()), t], names)

        for whole in it:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                more = b.column("t").cast(pa.binary()).to_pylist()
                if ids is None:
                    yield edge(b.column("d").slice(0, 1), "first", more[0])
                ids = b.column("d") if ids is None else pa.concat_arrays([ids, b.column("d")])
                texts, own = texts + more, own + [digests(t) for t in more]
                cols, n = _edit(texts[:-1], texts[1:], own[:-1], own[1:]), len(texts) - 1
                yield pa.RecordBatch.from_arrays([ids.slice(0, n), *cols, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names)
                ids, texts, own = ids.slice(n), texts[-1:], own[-1:]
        if ids is not None:
            yield edge(ids, "last", texts[0])

    made = materialise(ranges.mapInArrow(stream, f"d {kind}, {results}, part int, edge string, t string"), "fingerprints")
    numbers = sorted(r[0] for r in made.where("edge = 'first'").select("part").collect())  # as many as ranges at most
    pairs = spark.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1], strict=True)), "part int, following int")
    last = made.where("edge = 'last'").select("d", "part", "t").join(grown(pairs), "part")
    first = made.where("edge = 'first'").select(F.col("part").alias("following"), F.col("t").alias("x"))
    meet = last.join(grown(first), "following").select("d", "t", "x")

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts, nexts = (b.column(c).cast(pa.binary()).to_pylist() for c in ("t", "x"))
            cols = _edit(texts, nexts, [digests(t) for t in texts], [digests(t) for t in nexts])
            yield pa.RecordBatch.from_arrays([b.column("d"), *cols], ["d", *_EDITED])

    out = made.where("edge IS NULL").select("d", *_EDITED).unionByName(meet.mapInArrow(finish, f"d {kind}, {results}"))
    return out.withColumnRenamed("d", "doc_id")
