"""Substring dedup with FM-indexes: matching statistics of streamed documents by backward search over wavelet trees.

A word goes if it lies in a window of ``window`` words that also starts in a document with a smaller doc_id.

Every window has an anchor, the least hash of its ``GRAM``-word pieces, so equal windows have equal anchors.  Anchors of a single
document are left out; the windows of the others are cut into segments (runs of windows with one anchor) and sent to the shard
of their anchor.  A shard holds an FM-index of its distinct segments: the Burrows-Wheeler transform of their words in a
bit-packed wavelet tree.  The segments stream through it from their last word to their first: backward search extends the
match by a word, and a match of full length is first shortened by its last word (to the parent interval).  The interval of each window
gives the smallest document that holds it.  Matches longer than the threshold are the unions of their windows, so the
statistics need not be longer; :func:`FMIndex.statistics` reports them clipped at ``window``, for sequences that the index holds.

Scale: a document meets only the shards of its shared anchors, and equal segments are one row before they are indexed (with
partial minima, so copies of a third of all rows cost a row a task).  The number of shards follows the words to be indexed,
about ``SHARD_WORDS`` each.  An anchor of more than ``HOT`` documents is spread: its windows go one by one to the shard of their own
hash.  Texts are shuffled twice, one step at a time: to find shared windows, and to take words out.

Defined cases: a null or empty text has no words and keeps the digest of the empty text; texts of fewer than ``window`` words lose
nothing; rows without an id lose nothing and remove nothing; repeated rows are one document; an empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import drop_table, materialise
from textloom.llm.shingle_join import _FACTORS, WordHashes, _mix

WINDOW, GRAM, HOT, SHARD_WORDS = 13, 5, 5000, 1_000_000


class WaveletTree:
    """Ranks in a sequence of numbers below ``sigma``, one packed bit row per binary digit."""

    def __init__(self, values: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        self.n = len(values)
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.bits.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.uint32))
            self.zeros.append(int(self.n - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        self.first = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            block, within = at >> 6, (at & 63).astype(np.uint64)
            below = (np.uint64(1) << within) - np.uint64(1)
            ones = self.counts[k][block] + np.bitwise_count(self.bits[k][block] & below)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the position ``at``."""
        return self._descend(symbol, at) - self.first[symbol]


class FMIndex:
    """Of word sequences (numbers from 1), each with a document; suffixes are ordered on more than ``window`` words."""

    def __init__(self, texts: np.ndarray, documents: np.ndarray, window: int) -> None:
        """``texts``: all sequences, each closed by a 0; ``documents``: of each position."""
        n, self.window = len(texts), window
        _, rank = np.unique(texts, return_inverse=True)
        rank, depth, at_power = rank.astype(np.int64), 1, None
        while True:
            if depth <= window - 1 < 2 * depth or (window == 1 and depth == 1):
                at_power, power = rank, depth
            if depth > window:
                break
            after = np.zeros(n, np.int64)
            after[: n - depth] = rank[depth:] + 1
            _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
            depth *= 2
        order = np.argsort(rank, kind="stable")
        sigma = int(texts.max(initial=0)) + 1
        self.start = np.concatenate([[0], np.cumsum(np.bincount(texts, minlength=sigma))])[:-1]
        self.bwt = WaveletTree(texts[order - 1], sigma)
        self.n = n

        def groups(length: int) -> tuple[np.ndarray, np.ndarray]:
            """First row and end of the interval of equal ``length``-word beginnings, by row."""
            shifted = np.zeros(n, np.int64)
            shifted[: n - (length - power)] = at_power[length - power :] + 1
            a, b = at_power[order], shifted[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            first = np.flatnonzero(new).astype(np.uint32)
            which = np.cumsum(new, dtype=np.uint32) - 1
            return first[which], np.append(first[1:], np.uint32(n))[which]

        if n:
            self.parent = groups(max(window - 1, power))
            self.starts = np.unique(groups(window)[0])  # of the intervals of whole windows
            self.least = np.minimum.reduceat(documents[order], self.starts.astype(np.int64))

    def statistics(self, queries: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the sequences ``queries[ends - sizes : ends]``, in lockstep from their last words.

        By position of ``queries``: the length of the longest match that starts there, at most ``window`` words, and for
        full length the smallest document that holds it (else the largest number).
        """
        length = np.zeros(len(queries), np.int64)
        least = np.full(len(queries), np.iinfo(np.int64).max)
        low, high, size = np.zeros(len(ends), np.int64), np.full(len(ends), self.n), np.zeros(len(ends), np.int64)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            on = np.flatnonzero(sizes >= step)
            at = ends[on] - step
            symbol, lo, hi, ln = queries[at], low[on], high[on], size[on]
            if self.window > 1:
                full = ln == self.window
                lo, hi = np.where(full, self.parent[0][lo], lo), np.where(full, self.parent[1][lo], hi)
            else:
                lo, hi, full = np.zeros_like(lo), np.full_like(hi, self.n), ln == 1
            ranks = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
            lo, hi = self.start[symbol] + ranks[: len(on)], self.start[symbol] + ranks[len(on) :]
            ln = np.where(full, self.window, ln + 1)
            low[on], high[on], size[on], length[at] = lo, hi, ln, ln
            done = ln == self.window
            least[at[done]] = self.least[np.searchsorted(self.starts, lo[done].astype(np.uint32))]
        return length, least


def anchors(words: list[bytes], hashes: WordHashes, window: int = WINDOW) -> np.ndarray:
    """The anchor of each window of a text, as int64."""
    gram = min(GRAM, window)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    m = len(h) - gram + 1
    if len(h) < window:
        return np.zeros(0, np.int64)
    total = np.zeros(m, np.uint64)
    for k in range(gram):
        total += h[k : k + m] * _FACTORS[k]
    low, span, wide = _mix(total), 1, window - gram + 1
    while span < wide:
        step = min(span, wide - span)
        low, span = np.minimum(low[:-step], low[step:]), span + step
    return low.view(np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _segments(docs: DataFrame, window: int) -> DataFrame:
    """``(d, pos, seg, route)`` from ``docs(d, text, shared, hot)``: runs of at most ``window`` windows with one shared anchor."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hashes = ["d", "pos", "seg", "route"], WordHashes()
        for b in it:
            rows: list = []
            for d, t, shared, hot in zip(*(b.column(c).to_pylist() for c in ("d", "text", "shared", "hot")), strict=True):
                words = _words(t)
                a = anchors(words, hashes, window)
                is_hot = np.isin(a, np.array(hot, np.int64))
                use = np.flatnonzero(np.isin(a, np.array(shared, np.int64)))
                if not len(use):
                    continue
                new = np.concatenate([[True], (use[1:] != use[:-1] + 1) | (a[use[1:]] != a[use[:-1]]) | is_hot[use[1:]]])
                first = np.flatnonzero(new)
                for i, j in zip(first, [*first[1:], len(use)], strict=True):
                    for s in range(i, j, window):
                        start, last = int(use[s]), int(use[min(s + window, j) - 1])
                        seg = b" ".join(words[start : last + window])
                        route = hash_of(seg) if is_hot[start] else int(a[start])
                        rows.append((d, start, seg, route))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names)

    KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    return docs.mapInArrow(batches, "d long, pos long, seg binary, route long")


def hash_of(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def index_shard(segments: list[bytes], documents: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment the smallest document that holds each of its windows."""
    number: dict[bytes, int] = {}
    parts = [s.split(b" ") for s in segments]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    texts = np.zeros(int(sizes.sum()) + len(parts), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    at = np.ones(len(texts), bool)
    at[ends] = False
    texts[at] = np.fromiter((number.setdefault(w, len(number) + 1) for p in parts for w in p), np.int64, int(sizes.sum()))
    index = FMIndex(texts, np.repeat(documents, sizes + 1), window)
    _, least = index.statistics(texts, ends, sizes)
    return [least[e - s : e - window + 1] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _search(distinct: DataFrame, shards: int, window: int) -> DataFrame:
    """``(seg, least)``: one FM-index per partition, through which the partition's segments are streamed."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in it if b.num_rows]
        if not held:
            return
        segments = [s for b in held for s in b.column("seg").to_pylist()]
        documents = np.concatenate([b.column("first").to_numpy() for b in held])
        found = index_shard(segments, documents, window)
        for i in range(0, len(segments), 50_000):
            some = found[i : i + 50_000]
            sizes = np.cumsum([0, *map(len, some)], dtype=np.int32)
            least = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(some)))
            yield pa.RecordBatch.from_arrays([pa.array(segments[i : i + 50_000], pa.binary()), least], ["seg", "least"])

    return distinct.repartition(shards, "route").mapInArrow(batches, "seg binary, least array<long>")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(d, starts)``: the windows (number of the first word) of each document of ``docs(d, text)`` that a smaller one holds too."""
    docs = docs.where("d IS NOT NULL AND text IS NOT NULL")

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in it:
            found = [np.unique(anchors(_words(t), hashes, window)) for t in b.column("text").to_pylist()]
            sizes = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.ListArray.from_arrays(pa.array(sizes), flat)], ["d", "a"])

    texts = materialise(docs.mapInArrow(each, "d long, a array<long>"), "fm-texts")  # once, for both uses below
    found = texts.select("d", F.explode("a").alias("a"))
    shared = found.groupBy("a").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    shared = materialise(shared.select("a", (F.col("n") > HOT).alias("hot")), "fm-anchors")
    own = found.join(shared, "a").groupBy("d").agg(F.collect_set("a").alias("shared"), F.collect_set(F.when(F.col("hot"), F.col("a"))).alias("hot"))
    own = materialise(own, "fm-shared")
    drop_table(texts)
    segments = materialise(_segments(docs.join(own, "d").select("d", "text", "shared", "hot"), window), "fm-segments")
    distinct = materialise(segments.groupBy("seg", "route").agg(F.min("d").alias("first")), "fm-distinct")
    size = distinct.agg(F.sum(F.octet_length("seg").cast("long"))).first()[0] or 0
    least = materialise(_search(distinct, max(1, -(-size // (6 * SHARD_WORDS))), window), "fm-least")
    starts = F.transform(F.col("least"), lambda m, i: F.when(m < F.col("d"), F.col("pos") + i))
    out = segments.select("d", "pos", "seg").join(least, "seg").select("d", F.array_compact(starts).alias("s")).where(F.size("s") > 0)
    out = materialise(out.groupBy("d").agg(F.flatten(F.collect_list("s")).alias("starts")), "fm-starts")
    for t in (shared, own, segments, distinct, least):
        drop_table(t)
    return out


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_text (kept words joined by spaces) and its sha256."""
    slim = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("text"))
    work = slim.join(repeated_windows(slim, window), "d", "left")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for t, starts in zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), strict=True):
                words = _words(t)
                gone = np.zeros(len(words) + 1, np.int64)
                if starts:
                    np.add.at(gone, np.array(starts), 1)
                    np.add.at(gone, np.array(starts) + window, -1)
                keep = np.cumsum(gone[:-1]) == 0
                kept = b" ".join([words[i] for i in np.flatnonzero(keep)]) if starts else b" ".join(words)
                rows.append((len(words), int(len(words) - keep.sum()), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)] if rows else [pa.array([], k) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column("d"), *cols], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return work.select("d", "text", "starts").mapInArrow(batches, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
