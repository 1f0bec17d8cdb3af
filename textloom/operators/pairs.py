"""Sentence pairs and masked tokens for language-model training."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import batches as B
from textloom.operators.ranks import hash_key, hash_rank


ACTIONS = ("keep", "mask", "random", "same")
#: Where a pair's segments are.
PLACES = ("pair", "a_from", "a_to", "b_key", "b_from", "b_to", "is_next")


def next_sentences(lines: DataFrame, doc: str = "doc_id", pos: str = "line", text: str = "sentence") -> DataFrame:
    """Consecutive sentences of a document: ``(doc, pos, text, text_b)``."""
    follow = F.lead(text).over(Window.partitionBy(doc).orderBy(pos))
    return lines.select(doc, pos, F.col(text).alias("text"), follow.alias("text_b")).where("text_b IS NOT NULL")


def random_partners(docs: DataFrame, key: str, seed: int) -> DataFrame:
    """``(key, partner)``: another document for each, never the same, by position in hash order."""
    ranked = hash_rank(docs.select(key), key, seed)
    step = F.conv(F.substring(hash_key(F.col(key), seed + 1), 1, 7), 16, 10).cast("long")
    want = (F.col("rn") - 1 + 1 + step % F.greatest(F.col("n_rows") - 1, F.lit(1))) % F.col("n_rows") + 1
    left = ranked.where("n_rows > 1").withColumn("want", want)
    right = ranked.select(F.col("rn").alias("want"), F.col(key).alias("partner"))
    return left.join(right, "want").select(key, "partner")


def segment_pairs(docs: DataFrame, key: str, sizes: str, limit: int, seed: int, arrays: Sequence[str] = ()) -> DataFrame:
    """Pairs of segments that fill ``limit`` places with three special ones, from documents ``(key, sizes, *arrays)``.

    ``sizes`` has the tokens of each sentence; a sentence longer than limit - 3 counts as several.  Sentences are gathered while
    they fit.  A hash of the document and of the first sentence picks where segment A ends; by a further one B is the rest or, half of the
    time, a run of sentences of another document that fills what A leaves, and then the rest begins the next pair.  A single
    sentence is halved; one of a single token has B from another document.  So every token of a document is in a segment A, or in a B
    that follows its A, exactly once; what remains at the end of a document is a shorter pair.

    Gives ``key, pair, a_from, a_to, b_key, b_from, b_to, is_next``, places in the documents' tokens (ends exclusive), and for each of
    ``arrays`` (a value per token) its slices ``a_<name>`` and ``b_<name>``.  Documents without a token have no pairs; in a table of
    one document its other segments are its own.  A document's pairs are made in one pass over its row; other documents are met at
    their place in hash order (:func:`met_pairs`).
    """
    most = limit - 3
    if most < 2:
        raise ValueError("no room for two segments")
    pieces = F.flatten(F.transform(sizes, lambda n: F.concat(F.array_repeat(F.lit(most), (n / most).cast("int")), F.when(n % most > 0, F.array((n % most).cast("int"))).otherwise(F.array().cast("array<int>")))))
    work = docs.select(F.col(key).alias("key"), pieces.alias("pieces"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(arrays)]).where("size(pieces) > 0")
    kinds = [docs.schema[c].dataType.simpleString() for c in arrays]
    made = met_pairs(in_hash_order(work, seed), lambda b: (b.column("pieces").to_pylist(), [b.column(f"x{i}") for i in range(len(arrays))]), kinds, most, seed)
    return made.select(F.col("key").alias(key), *PLACES, *[F.col(f"{s}{i}").alias(f"{s}_{c}") for i, c in enumerate(arrays) for s in "ab"])


def in_hash_order(docs: DataFrame, seed: int) -> DataFrame:
    """Documents with their place ``rn`` by the hash of ``key`` and their number ``n_rows``; a null key takes part as an empty one."""
    return hash_rank(docs.withColumn("__k", F.coalesce(F.col("key").cast("string"), F.lit(""))), "__k", seed).drop("__k")


def met_pairs(
    ranked: DataFrame, read: Callable[[pa.RecordBatch], tuple[list[list[int]], list[pa.Array]]], kinds: Sequence[str], most: int, seed: int,
    finish: Callable[[pa.RecordBatch, list[str | None]], pa.RecordBatch] | None = None, finished: str = "",
) -> DataFrame:
    """The pairs of :func:`segment_pairs` of documents ``(key, rn, n_rows, ...)`` in hash order: ``key``, ``PLACES``, and ``a<i>``, ``b<i>`` of the arrays.

    ``read`` gives of a batch each document's sentences (none of more than ``most``, one at least) and its arrays, of the types ``kinds``.
    ``finish`` makes the columns ``finished`` from those of the arrays, given the keys as strings; they stand in place of the arrays.

    A document is read once and sent once, to its place in hash order, where it meets the pairs that want it; its own pairs are cut there too, and
    only the segment A of a pair with another document is sent besides.  A task holds one document and a slice of rows.
    """
    kind = ranked.schema["key"].dataType.simpleString()
    names = ["pair", "a_from", "a_to", "is_next", "b_from", "b_to", "start"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    sent_schema = f"target long, kind int, key {kind}, pieces array<int>, pair int, a_from long, a_to long, is_next boolean, b_from long, b_to long, start long" + "".join(f", x{i} {t}" for i, t in enumerate(kinds))
    counted = lambda c: pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = lambda n: np.concatenate([[0], np.cumsum(n)]).astype(np.int64)

    def parts(values: pa.Array, first: np.ndarray, n: np.ndarray, kind: pa.DataType) -> pa.Array:
        ends = before(n)
        index = np.arange(ends[-1]) + np.repeat(first - ends[:-1], n)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values.take(pa.array(index))).cast(kind)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in it for part in B.slices(whole)):
            keys, (pieces, columns) = batch.column("key"), read(batch)
            places, n_rows = batch.column("rn").to_pylist(), batch.column("n_rows").to_pylist()
            rows, at, targets = [], [], []
            for r, (k, p, rn, total) in enumerate(zip(keys.to_pylist(), pieces, places, n_rows, strict=True)):
                for pair, (a, b, follows, draw, start) in enumerate(_pairs(str(k), p, most, seed)):
                    rows.append((pair, *a, follows, *(b or (None, None)), start))
                    at.append(r)
                    targets.append(rn if follows else (rn + draw % max(total - 1, 1)) % total + 1)
            if not batch.num_rows:
                continue
            labels = ["target", "kind", "key", "pieces", *names, *(f"x{i}" for i in range(len(columns)))]
            none = lambda t: pa.nulls(len(keys), t)
            yield pa.RecordBatch.from_arrays([batch.column("rn"), pa.array(np.zeros(len(keys), np.int32)), keys, pa.array(pieces, pa.list_(pa.int32())), *map(none, types), *columns], labels)
            if rows:
                own = np.array([x[3] for x in rows])
                index = np.array(at)
                first, last = (np.array([x[i] for x in rows], np.int64) for i in (1, 2))
                cols = [pa.array(targets, pa.int64()), pa.array(np.ones(len(at), np.int32)), keys.take(pa.array(index)), pa.nulls(len(at), pa.list_(pa.int32()))]
                cols += [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                cols += [parts(c.flatten(), before(counted(c))[index] + first, np.where(own, 0, last - first), c.type) for c in columns]
                yield pa.RecordBatch.from_arrays(cols, labels)

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the key, the sentences' places and the arrays of the document that was met last
        for batch in (part for whole in it for part in B.slices(whole)):
            if not batch.num_rows:
                continue
            columns = [batch.column(f"x{i}") for i in range(len(kinds))]
            sizes, values = [counted(c) for c in columns], [c.flatten() for c in columns]
            keys = batch.column("key")
            shift = [0] * len(kinds)
            doc, at = -1, 0  # the document's row, counted with the held one as the first
            if held is not None:
                at, shift = 1, [len(x) for x in held[2]]
                keys = pa.concat_arrays([held[0], keys])
                values = [pa.concat_arrays([old, new]) for old, new in zip(held[2], values, strict=True)]
                sizes = [np.concatenate([[s], n]) for s, n in zip(shift, sizes, strict=True)]
                doc, places = 0, held[1]
            starts = [before(n) for n in sizes]
            rows, own, docs, b_from, b_to = [], [], [], [], []
            asked = zip(*(batch.column(c).to_pylist() for c in ("kind", "pieces", "a_from", "a_to", "is_next", "b_from", "b_to", "start")), strict=True)
            for r, (what, p, first, last, follows, low, high, start) in enumerate(asked, at):
                if what == 0:
                    doc, places = r, before(p).tolist()
                    continue
                if not follows:
                    room, begin = most - (last - first), start % (len(places) - 1)
                    low, end = places[begin], begin
                    while end < len(places) - 1 and places[end + 1] - low <= room:
                        end += 1
                    high = places[end] if end > begin else low + room
                rows.append(r)
                own.append(follows)
                docs.append(doc)
                b_from.append(low)
                b_to.append(high)
            if rows:
                index, docs, own = np.array(rows), np.array(docs), np.array(own)
                picked = batch.take(pa.array(index - at))
                first, last = (picked.column(c).to_numpy() for c in ("a_from", "a_to"))
                low, high = np.array(b_from, np.int64), np.array(b_to, np.int64)
                cols = [picked.column("key"), *(picked.column(c) for c in ("pair", "a_from", "a_to")), keys.take(pa.array(docs)), pa.array(low), pa.array(high), picked.column("is_next")]
                labels = ["key", *PLACES]
                for i, (v, s, c) in enumerate(zip(values, starts, columns, strict=True)):
                    cols += [parts(v, np.where(own, s[docs] + first, s[index]), last - first, c.type), parts(v, s[docs] + low, high - low, c.type)]
                    labels += [f"a{i}", f"b{i}"]
                out = pa.RecordBatch.from_arrays(cols, labels)
                yield out if finish is None else finish(out, picked.column("name").to_pylist())
            copied = lambda x, first, n: x.take(pa.array(np.arange(first, first + n)))
            held = copied(keys, doc, 1), places, [copied(v, s[doc], n[doc]) for v, s, n in zip(values, starts, sizes, strict=True)]

    sent = ranked.mapInArrow(cut, sent_schema).repartition("target").sortWithinPartitions("target", "kind")
    base = f"key {kind}, pair int, a_from long, a_to long, b_key {kind}, b_from long, b_to long, is_next boolean"
    if finish is not None:
        return sent.withColumn("name", F.col("key").cast("string")).mapInArrow(meet, f"{base}, {finished}")
    return sent.mapInArrow(meet, base + "".join(f", a{i} {t}, b{i} {t}" for i, t in enumerate(kinds)))


def estimated_pairs(lines: DataFrame, text: str = "value", closed: bool = False) -> DataFrame:
    """How many pairs of neighbouring sentences files of lines have, from counts of lines alone: ``(samples, docs)``.

    One blank line is taken to stand between two documents, and after the last one too if ``closed``.
    """
    blank = F.trim(F.col(text)) == ""
    found = lines.agg(F.count("*").alias("n"), F.count_if(blank).alias("blank"))
    docs = F.col("blank") if closed else F.col("blank") + 1
    return found.select(F.greatest(F.lit(0), F.col("n") - F.col("blank") - docs).alias("samples"), docs.alias("docs"))


def _pairs(key: str, pieces: Sequence[int], most: int, seed: int) -> Iterator[tuple]:
    """(A, B or None, whether B follows A, draw of another document, draw of its first sentence) for each pair of a document."""
    places = [0]
    for n in pieces:
        places.append(places[-1] + n)
    i = 0
    while i < len(pieces):
        end = i + 1
        while end < len(pieces) and places[end + 1] - places[i] <= most:
            end += 1
        h = hashlib.md5(f"{key}-{i}-{seed}".encode(), usedforsecurity=False).hexdigest()
        cut, coin, other, start = int(h[:7], 16), int(h[7], 16), int(h[8:15], 16), int(h[15:22], 16)
        first, last = places[i], places[end]
        if end - i == 1:
            follows, stop = last - first > 1, first + max(1, (last - first) // 2)
            i = end
        else:
            after = i + 1 + cut % (end - i - 1)
            follows, stop = coin % 2 == 0, places[after]
            i = end if follows else after
        yield (first, stop), (stop, last) if follows else None, follows, other, start


def mask_words(tokens: DataFrame, vocabulary_size: int, most: int = 20, share: float = 0.15, seed: int = 0, sample: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Whole-word masking of ``tokens(doc_id, word, pos, token)``: adds ``action`` (keep, mask, random, same) and ``target``.

    Words are taken in hash order while the budget min(most, max(1, round(share * tokens))) is not exceeded; a word that would
    exceed it is passed over.  The budget is per ``sample``, the columns that make a sample; words are numbered per document.  Of the taken ones 80 % are masked, 10 % replaced, 10 % left.
    """

    sizes = tokens.groupBy(*sample, "word").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*sample))
    key = F.concat_ws("/", "doc_id", "word")
    words = sizes.withColumn("budget", F.least(F.lit(most), F.greatest(F.lit(1), F.round(total * share))).cast("int")).withColumn("h", hash_key(key, seed))
    groups = words.groupBy(*sample, "budget").agg(F.array_sort(F.collect_list(F.struct("h", "word", "n"))).alias("ws"))
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("bigint").alias("used"), none.alias("taken"))

    def step(s, w):
        fits = s["used"] + w["n"] <= F.col("budget")
        return F.when(fits, F.struct((s["used"] + w["n"]).alias("used"), F.concat(s["taken"], F.array(w["word"].cast("bigint"))).alias("taken"))).otherwise(s)

    taken = groups.select(*sample, F.explode(F.aggregate("ws", start, step, lambda s: s["taken"])).alias("word"))
    draw = F.conv(F.substring(hash_key(F.concat_ws("/", "doc_id", "word"), seed + 1), 1, 6), 16, 10).cast("long") % 10
    taken = taken.withColumn("action", F.when(draw < 8, "mask").when(draw == 8, "random").otherwise("same"))
    out = tokens.join(taken, [*sample, "word"], "left").withColumn("action", F.coalesce("action", F.lit("keep")))
    return _replaced(out, vocabulary_size, seed)


def _replaced(out: DataFrame, vocabulary_size: int, seed: int) -> DataFrame:
    """Tokens with their ``action``: adds the replacement of the random ones and the target of all but those to keep."""
    pick = F.conv(F.substring(hash_key(F.concat_ws("/", "doc_id", "pos"), seed + 2), 1, 7), 16, 10).cast("long") % vocabulary_size
    return out.withColumn("random_id", F.when(F.col("action") == "random", pick)).withColumn("target", F.when(F.col("action") != "keep", F.col("token")))


@cache
def _budget(total: int, most: int, share: float) -> int:
    return min(most, max(1, int(Decimal(repr(total * share)).quantize(Decimal(1), ROUND_HALF_UP))))


def _word_actions(key: Column, sizes: Column, size: int, most: int, share: float, seed: int) -> Column:
    """For each word of a document its place in ``ACTIONS``, from its words' numbers of tokens; a null key keeps all."""

    @F.arrow_udf("array<tinyint>")
    def actions(keys: pa.Array, sizes: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(sizes), 0).to_numpy()
        flat, out, at = sizes.flatten().to_numpy(), np.zeros(counts.sum(), np.int8), 0
        for k, n in zip(keys.to_pylist(), counts.tolist(), strict=True):
            for first in range(0, n if k is not None else 0, size):
                own = flat[at + first : at + min(first + size, n)].tolist()
                hashes = [hashlib.md5(b"%b/%d-%d" % (k, w, seed), usedforsecurity=False).digest() for w in range(first, first + len(own))]
                left = _budget(sum(own), most, share)
                for i in sorted(range(len(own)), key=hashes.__getitem__):
                    if 0 < own[i] <= left:
                        left -= own[i]
                        draw = int(hashlib.md5(b"%b/%d-%d" % (k, first + i, seed + 1), usedforsecurity=False).hexdigest()[:6], 16) % 10
                        out[at + first + i] = 1 if draw < 8 else 2 if draw == 8 else 3
                        if not left:
                            break
            at += n
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(out))

    return actions(key.cast("string").cast("binary"), sizes)


def mask_documents(docs: DataFrame, parts: Callable[[Column], Column], width: int, vocabulary_size: int, size: int, most: int = 20, share: float = 0.15, seed: int = 0) -> DataFrame:
    """:func:`mask_words` of whole documents ``(doc_id, words)``, of which each ``size`` words are a sample.

    ``parts`` gives the tokens of a word, at most ``width``.  Gives ``doc_id, passage, word, token, pos, action, random_id, target``, where
    ``pos`` is word * width + the token's place in the word.  A document's words are drawn in one pass over its row, and no token is
    shuffled.  Rows that share an id have common samples, so they go by :func:`mask_words`; the ids are counted for that before.
    """

    def tokens(rows: DataFrame, *more: str) -> DataFrame:
        rows = rows.select("doc_id", F.floor(F.col("word") / size).cast("int").alias("passage"), "word", *more, F.posexplode(parts(F.col("w"))).alias("part", "token"))
        return rows.select("doc_id", "passage", "word", "token", (F.col("word") * width + F.col("part")).alias("pos"), *more)

    def alone(rows: DataFrame) -> DataFrame:
        sizes = F.transform("words", lambda w: F.size(parts(w)))
        rows = rows.select("doc_id", "words", _word_actions(F.col("doc_id"), sizes, size, most, share, seed).alias("actions"))
        rows = rows.select("doc_id", F.posexplode(F.arrays_zip("words", "actions")).alias("word", "x")).select("doc_id", "word", F.col("x.words").alias("w"), F.col("x.actions").alias("a"))
        name = F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("a") + 1)
        return _replaced(tokens(rows, "a").withColumn("action", name).drop("a"), vocabulary_size, seed)

    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return alone(docs)
    shared = tokens(docs.join(repeated, "doc_id", "left_semi").select("doc_id", F.posexplode("words").alias("word", "w")))
    shared = mask_words(shared, vocabulary_size, most, share, seed, ("doc_id", "passage"))
    return alone(docs.join(repeated, "doc_id", "left_anti")).unionByName(shared)
