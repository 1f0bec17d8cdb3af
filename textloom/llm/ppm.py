"""Prediction by partial matching over a byte-context trie, pretrained on the corpus or adaptive within a text.

A text is its words, each closed by a space, and one end.  A symbol is predicted from the ``ORDER`` bytes before it, over the
closing space into the words before (filled up with spaces at the start of the text), else from shorter and shorter contexts.
A context that has seen n symbols of d kinds gives kind s the share n_s / (n + d) and the escape d / (n + d); kinds that a
longer context offered are excluded from the shorter ones (method C with exclusion).  Below the empty context all bytes that
are left are equally likely.  With ``contexts="word"`` contexts begin anew at each word, so the order of words has no say.

The unigram score of the same words comes from the same chunks.

Scale: documents are dealt into chunks of about ``CHUNK_BYTES``.  A chunk gives its distinct words and its distinct
(context, symbol) pairs with their training counts; windows over words and a sum over pairs make them counts of the whole
corpus; each pair gets its probability in the group of its last two context bytes, where all its shorter contexts are too but
the order 1 and 0 ones (at most 65,792 counts, which every task gets); then the chunks take back the rows that they need.
Within a chunk, symbols are made for about ``STEP`` bytes of texts at a time.
Nothing else is broadcast, no group exceeds a chunk or the pairs of two bytes, and what is gathered grows with the corpus.

Defined cases: a null text is empty; an empty text is its end alone; a null id counts as the empty text for the held-out
rule; with no training documents all counts are 0 and every symbol costs the uniform share; repeated rows count and score
as often as they stand; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import drop_table, materialise

ORDER, CHUNK_BYTES, STEP = 5, 8 << 20, 1 << 18
PAD, SPACE, END = b" " * ORDER, b" ", b"\n"


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, and its end, which is the empty word."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def pieces(words: list[bytes], contexts: str) -> list[bytes]:
    """The runs of symbols of a text, at the beginning of which contexts begin anew."""
    if contexts == "text":
        return [SPACE.join(words) + END]
    if contexts == "word":
        return [w + (SPACE if w else END) for w in words]
    raise ValueError(f"unknown contexts {contexts!r}")


def events(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The (context, symbol) of every symbol of the runs, six bytes in a number, and the number of symbols of each run."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    raw = np.frombuffer(b"".join([PAD + r for r in runs]), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER)])[:-1]
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes) + np.arange(sizes.sum())
    keys = np.zeros(max(0, len(raw) - ORDER), np.int64)  # of every place, those between runs too
    for i in range(ORDER + 1):
        keys <<= 8
        keys |= raw[i : len(keys) + i]
    return keys[first], sizes


def _steps(runs: Iterable[bytes]) -> Iterator[list[bytes]]:
    """The runs in lists of about ``STEP`` bytes."""
    held, size = [], 0
    for r in runs:
        held.append(r)
        size += len(r) + ORDER
        if size >= STEP:
            yield held
            held, size = [], 0
    if held:
        yield held


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Trie:
    """Counts of symbols after contexts of each order."""

    def __init__(self) -> None:
        self.orders: list[dict[int, dict[int, int]]] = [{} for _ in range(ORDER + 1)]

    def add(self, key: int, count: int) -> None:
        context, symbol = key >> 8, key & 255
        for k in range(ORDER + 1):
            seen = self.orders[k].setdefault(context & ((1 << 8 * k) - 1), {})
            seen[symbol] = seen.get(symbol, 0) + count

    def log10(self, key: int) -> float:
        """log10 of the probability of the symbol after the context."""
        context, symbol = key >> 8, key & 255
        excluded: set[int] = set()
        left = 0.0
        for k in range(ORDER, -1, -1):
            seen = self.orders[k].get(context & ((1 << 8 * k) - 1), {})
            fresh = {s: c for s, c in seen.items() if s not in excluded}
            if not fresh:
                continue
            n, d = sum(fresh.values()), len(fresh)
            if symbol in fresh:
                return left + math.log10(fresh[symbol] / (n + d))
            left += math.log10(d / (n + d))
            excluded |= fresh.keys()
        return left - math.log10(256 - len(excluded))


def adaptive_log10(text: str | None) -> float:
    """The code length of one text (log10 of its probability) under a trie that learns it as it goes."""
    trie, total = Trie(), 0.0
    for key in events(pieces(tokens(text), "text"))[0].tolist():
        total += trie.log10(key)
        trie.add(key, 1)
    return total


def _logs(keys: np.ndarray, counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log10 of the probability of each key; ``ones`` are the counts of symbols after each single byte.

    What a context has seen, all its shorter ones have seen, so the kinds excluded at an order are those of the context one byte
    longer, and the sums over what is left are differences.
    """
    trained = counts > 0
    zero = ones.sum(0)
    # for each order but 0: entries, their counts, contexts, and per context the counts, kinds and counts of its kinds one order below
    tables: dict[int, tuple[np.ndarray, ...]] = {}
    flat = np.flatnonzero(ones)
    for k in range(1, ORDER + 1):
        if k == 1:
            entries, n, below = flat, ones.ravel()[flat], zero[flat & 255]
        else:
            entries, place = np.unique(keys[trained] & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(place, counts[trained], len(entries)).astype(np.int64)
            shorter, m = tables[k - 1][:2]
            below = m[np.searchsorted(shorter, entries & ((1 << 8 * k) - 1))]
        contexts, place = np.unique(entries >> 8, return_inverse=True)
        sums = [np.bincount(place, w, len(contexts)).astype(np.int64) for w in (n, np.ones(len(n)), below)]
        tables[k] = entries, n, contexts, *sums

    def at(sorted_: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        """The values where ``wanted`` stands, or 0."""
        if not len(sorted_):
            return [np.zeros(len(wanted), np.int64) for _ in values]
        i = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
        hit = sorted_[i] == wanted
        return [np.where(hit, v[i], 0) for v in values]

    out, left = np.zeros(len(keys)), np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    gone_n, gone_d = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for k in range(ORDER, -1, -1):
        if k:
            entries, n, contexts, total, kinds, below = tables[k]
            (own,) = at(entries, keys & ((1 << 8 * (k + 1)) - 1), n)
            total, kinds, below = at(contexts, (keys >> 8) & ((1 << 8 * k) - 1), total, kinds, below)
        else:
            own, total, kinds, below = zero[keys & 255], zero.sum(), np.count_nonzero(zero), 0
        n, d = total - gone_n, kinds - gone_d
        found = open_ & (own > 0)
        out[found] = left[found] + np.log10(own[found] / (n + d)[found])
        open_ &= ~found
        on = open_ & (d > 0)
        left[on] += np.log10(d[on] / (n + d)[on])
        gone_n, gone_d = below, kinds
    out[open_] = left[open_] - math.log10(256 - np.count_nonzero(zero)) if open_.any() else 0.0
    return out


def _probabilities(pairs: DataFrame) -> DataFrame:
    """``(key, logp)`` of ``pairs(key, n)``, which holds every pair of the corpus with its training count, perhaps 0."""
    low = pairs.where("n > 0").groupBy((F.col("key") % 65536).alias("k")).agg(F.sum("n").alias("n")).collect()  # 65,536 rows at most
    ones = np.zeros((256, 256), np.int64)
    for r in low:
        ones[r["k"] >> 8, r["k"] & 255] = r["n"]

    def score(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        return pa.table({"key": pa.array(keys), "logp": pa.array(_logs(keys, table.column("n").to_numpy(), ones))})

    suffix = F.shiftright("key", 8) % 65536
    return pairs.withColumn("suffix", suffix).groupBy("suffix").applyInArrow(score, "key long, logp double")


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, contexts: str = "word") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; training as in the module's text.

    ``contexts`` is "text" (over the whole text) or "word" (anew at each word).

    Documents whose crc32(doc_id as text) mod 10 is 0 are held out; all others train both models.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.crc32(key) % 10 == 0).alias("held_out"))
    size = slim.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    slim = slim.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def count(table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # of the worker's task before
        words: Counter[bytes] = Counter()
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def add(held: list[bytes], weights: list[int]) -> None:
            keys, sizes = events(held)
            found.append(_summed(keys, np.repeat(np.array(weights, np.int64), sizes)))
            if len(found) > 6:
                merge()

        def merge() -> None:
            keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            found.append(_summed(keys, counts))

        def texts(held: bool) -> Iterator[bytes]:
            for c in table.filter(pc.equal(table.column("held_out"), held)).column("text").chunks:
                for t in c:
                    seen = tokens(t.as_py())
                    words.update(dict.fromkeys(seen, 0) if held else seen)
                    if contexts == "text":
                        yield pieces(seen, contexts)[0]

        for held in (False, True):
            for step in _steps(texts(held)):
                add(step, [int(not held)] * len(step))
        names, n = list(words), np.fromiter(words.values(), np.int64, len(words))
        words.clear()
        if contexts == "word":
            add(pieces(names, contexts), n)
        merge()
        pairs, times = found[0]
        number = table.column("chunk")[0].as_py()
        return pa.table(
            {
                "chunk": pa.array(np.full(len(names) + len(pairs), number)),
                "word": pa.concat_arrays([pa.array(names, pa.binary()), pa.nulls(len(pairs), pa.binary())]),
                "key": pa.concat_arrays([pa.nulls(len(names), pa.int64()), pa.array(pairs)]),
                "n": pa.array(np.concatenate([n, times])),
            }
        )

    parts = materialise(slim.groupBy("chunk").applyInArrow(count, "chunk long, word binary, key long, n long"), "ppm-counts")
    one = Window.partitionBy("word")
    words = parts.where("word IS NOT NULL").select("chunk", "word", F.sum("n").over(one).alias("n"), (F.row_number().over(one.orderBy("chunk")) == 1).alias("first"))
    words = materialise(words, "ppm-words")
    train, kinds = words.where("first").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0))).first()
    pairs = parts.where("key IS NOT NULL")
    distinct = materialise(pairs.groupBy("key").agg(F.sum("n").alias("n")), "ppm-pairs")
    logs = materialise(_probabilities(distinct), "ppm-logs")
    joined = materialise(pairs.select("chunk", "key").join(logs, "key").select("chunk", "key", "logp"), "ppm-chunk-logs")
    for t in (parts, distinct, logs):
        drop_table(t)
    own = joined.select("chunk", F.lit(None).cast("binary").alias("word"), "key", F.lit(None).cast("long").alias("n"), "logp")
    own = own.unionByName(words.select("chunk", "word", F.lit(None).cast("long").alias("key"), "n", F.lit(None).cast("double").alias("logp")))

    def score(table: pa.Table, known: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        w = known.select(["word", "n"]).filter(known.column("word").is_valid())
        p = known.select(["key", "logp"]).filter(known.column("key").is_valid())
        names, n = w.column("word").to_pylist(), w.column("n").to_numpy()
        keys, logp = p.column("key").to_numpy(), p.column("logp").to_numpy()
        order = np.argsort(keys)
        keys, logp = keys[order], logp[order]
        del known, w, p, order

        def costs(runs: list[bytes]) -> list[float]:
            found, sizes = events(runs)
            order = np.argsort(found)
            each, ends = np.empty(len(found)), np.cumsum(sizes).tolist()
            each[order] = logp[np.searchsorted(keys, found[order])]  # in order, so that neighbours are found near each other
            return [float(each[i:j].sum()) for i, j in zip([0, *ends], ends, strict=False)]

        base = np.log10((n + 0.1) / (train + 0.1 * (kinds + 1)))
        place = {x: i for i, x in enumerate(names)}
        each_word = np.array([c for step in _steps(pieces(names, contexts)) for c in costs(step)] if contexts == "word" else [])
        rows, whole = [], []

        def texts() -> Iterator[bytes]:
            for c in table.column("text").chunks:
                for t in c:
                    seen = tokens(t.as_py())
                    at = np.fromiter(map(place.__getitem__, seen), np.int64)
                    rows.append((len(at), int(np.count_nonzero(n[at])), float(base[at].sum())))
                    if contexts == "word":
                        whole.append(float(each_word[at].sum()))
                    else:
                        yield pieces(seen, contexts)[0]

        for step in _steps(texts()):
            whole.extend(costs(step))
        n_tokens, n_known, base_score = (list(x) for x in zip(*rows, strict=True))
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "held_out": table.column("held_out"),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([int(train)] * len(rows), pa.int64()),
                "base_score": base_score,
                "score": whole,
            }
        )

    kind = docs.schema[doc_id].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    return slim.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(score, out)
