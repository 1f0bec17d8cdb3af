"""Processors that end in model inputs: ids of subword pieces with special tokens, padding, masks and label ids.

Each is a function DataFrame -> DataFrame without a shuffle, made by ``processor(name, vocabulary=..., ...)``; ``vocabulary`` is the
list of tokens in the order of their ids and is the only thing sent to the tasks.  All arrays of one processor have the same length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import batches as B
from textloom.functions import subwords as S
from textloom.functions import text as T
from textloom.operators import pairs as PR
from textloom.operators import passages as PS
from textloom.operators import splits as SP
from textloom.plans.common import read
from textloom.plans.processors import Processor, processor, register_processor

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Answer types of :func:`natural_questions_inputs`, in the order of their ids.
ANSWER_TYPES = ("no_answer", "span", "yes", "no")


def _words(text: Column, most: int | None = None) -> Column:
    """The words of a text; the ``most`` first ones are enough where no more pieces are taken, as each word has a piece."""
    found = T.punctuation_tokens(F.coalesce(text, F.lit("")))
    return found if most is None else F.slice(found, 1, most)


def _assembled(vocabulary: Sequence[str], first: Column, second: Column | None, size: int) -> list[Column]:
    """``input_ids``, ``padding_mask`` and ``segment_ids`` of arrays of ids that fit into ``size`` with their special tokens."""
    cls, sep, pad = (vocabulary.index(t) for t in (S.CLS, S.SEP, S.PAD))
    tokens = T.with_specials(first, second, cls, sep)
    return [
        T.pad(tokens, size, F.lit(pad)).alias("input_ids"),
        T.pad(F.array_repeat(F.lit(1), F.size(tokens)), size, F.lit(0)).alias("padding_mask"),
        T.pad(T.segment_ids(first, second), size, F.lit(0)).alias("segment_ids"),
    ]


def _truncated(first: Column, second: Column | None, size: int) -> tuple[Column, Column | None]:
    if second is None:
        return F.slice(first, 1, size - 2), None
    na, nb = T.pair_lengths(F.size(first), F.size(second), size - 3)
    return F.slice(first, F.lit(1), na), F.slice(second, F.lit(1), nb)


def text_inputs(
    vocabulary: Sequence[str], labels: Sequence[str] | None = None, text: str = "text", text_b: str | None = None, label: str = "label",
    size: int = 128, multilabel: bool = False, scaling: tuple[float, float] | None = None,
) -> Processor:
    """Texts or pairs of texts for classification (``labels``), regression (``scaling`` by mean and deviation) or inference (neither).

    Rows whose label is not in the list are left out (``quarantine`` finds them); a null text is an empty one.
    """

    def run(df: DataFrame) -> DataFrame:
        names = [text] if text_b is None else [text, text_b]
        sides = [S.word_pieces(_words(F.col(c), size), vocabulary)["ids"] for c in names]
        out = df.select("*", *_assembled(vocabulary, *_truncated(sides[0], sides[1] if text_b else None, size), size))
        if scaling is not None:
            return out.withColumn("regression_label", ((F.col(label) - scaling[0]) / scaling[1]).cast("double"))
        if labels is None:
            return out
        out = out.withColumn("label_ids", T.multi_hot(F.col(label), labels) if multilabel else T.label_index(F.col(label), labels))
        return out if multilabel else out.where("label_ids IS NOT NULL")

    return run


def tag_inputs(vocabulary: Sequence[str], labels: Sequence[str], tokens: str = "tokens", tags: str | None = "tags", size: int = 128, filler: str = "X") -> Processor:
    """Words with tags: ``initial_mask`` is 1 at a word's first piece; other pieces and special tokens have the label ``filler``, padding id 0.

    ``labels`` has to hold ``filler``.  Records with a tag outside the list are left out; without ``tags`` there are no labels.
    """

    def run(df: DataFrame) -> DataFrame:
        work = df if tags is None else df.where(F.forall(tags, lambda t: t.isin(*labels)))
        cut = S.word_pieces(F.slice(F.filter(tokens, lambda w: w.isNotNull()), 1, size), vocabulary)
        first, initial = F.slice(cut["ids"], 1, size - 2), F.slice(cut["initial"], 1, size - 2)
        mask = T.pad(T.with_specials(initial, None, 0, 0), size, F.lit(0))
        out = work.select("*", *_assembled(vocabulary, first, None, size), mask.alias("initial_mask"))
        if tags is None:
            return out
        names = F.array(*map(F.lit, labels))
        used = F.aggregate("padding_mask", F.lit(0), lambda a, x: a + x)
        named = T.expand_labels(F.col(tags), F.slice(F.col("initial_mask"), F.lit(1), used), filler)
        return out.withColumn("label_ids", T.pad(F.transform(named, lambda x: (F.array_position(names, x) - 1).cast("int")), size, F.lit(0)))

    return run


def _passages(df: DataFrame, vocabulary: Sequence[str], size: int, stride: int, slots: int) -> DataFrame:
    """Passages of ``df(..., q, p, spans)``: ids of the question and the document, and answers as first and last piece.

    Positions of labels count from the start of the input.  An answer that is not whole within the passage is (0, 0), as is the first
    slot where there is none; free slots are (-1, -1).  A passage's row holds its own pieces, not the document's; every document has a piece.
    """
    room, shift = size - 3 - F.size("q"), F.size("q") + 2
    last = F.greatest(F.lit(0), F.ceil((F.size("p") - room) / stride)).cast("int")

    def window(k: Column) -> Column:
        return F.struct(k.alias("passage"), (k * stride).alias("passage_start_t"), F.slice(F.col("p"), k * stride + 1, room).alias("__held"))

    work = df.withColumn("__n", F.size("p"))
    out = work.select(*[c for c in work.columns if c != "p"], F.inline(F.transform(F.sequence(F.lit(0), last), window)))
    n, held = F.col("__n"), F.col("__held")

    def moved(a: Column) -> Column:
        first, end = a["first"] - F.col("passage_start_t"), a["last"] - F.col("passage_start_t")
        inside = (first >= 0) & (end < F.least(n - F.col("passage_start_t"), room)) & (first <= end)
        spot = lambda x, name: F.when(inside, x + shift).otherwise(0).cast("int").alias(name)
        return F.struct(spot(first, "start"), spot(end, "end"))

    none = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    answers = F.when(F.size("spans") > 0, F.transform("spans", moved)).otherwise(none)
    return out.select(
        "*", *_assembled(vocabulary, F.col("q"), held, size), shift.alias("seq_2_start_t"), PS.label_slots(answers, slots).alias("labels")
    ).drop("q", "__n", "__held", "spans")


def _check(size: int, stride: int, question_size: int) -> None:
    if not 0 < stride <= size - 3 - question_size:
        raise ValueError("the stride has to be positive and at most what the longest question leaves for a passage")


def question_inputs(vocabulary: Sequence[str], size: int = 384, stride: int = 128, question_size: int = 64, slots: int = 6) -> Processor:
    """``(question, text, answers array<struct<start, text>>)``, with characters as positions, to one row per passage.

    The input is the question (at most ``question_size`` pieces), then a passage that fills the rest, every ``stride`` pieces; an
    empty or null text has no passages.  Up to ``slots`` answers have their place in ``labels``.
    """
    _check(size, stride, question_size)
    pieces = S.pieces_of(vocabulary)
    cls, sep, pad = (vocabulary.index(t) for t in (S.CLS, S.SEP, S.PAD))
    label = "struct<start: int, end: int>"

    @F.arrow_udf(f"array<struct<passage: int, passage_start_t: int, input_ids: array<int>, __held: int, labels: array<{label}>>>")
    def passages(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        cutter = pieces()
        for words, text, q, first, last in (part for batch in it for part in B.column_slices(batch)):
            rows, ends, found, _, codes, different = cutter(words)
            asked = _places(rows, ends, found[:, 1], codes, different, text, first, last, slots)
            n, nq = np.diff(ends[rows]), pc.list_value_length(q).to_numpy().astype(np.int64)
            room = size - 3 - nq
            count = np.maximum(0, -(-(n - room) // stride)) + 1
            bounds = np.concatenate([[0], np.cumsum(count)])
            row = np.repeat(np.arange(len(n)), count)
            k = np.arange(bounds[-1]) - bounds[:-1][row]
            begin, room, shift = k * stride, room[row], nq[row] + 2
            held = np.minimum(room, n[row] - begin)
            ids = np.full((len(k), size), pad, np.int32)
            for values, first_value, m, place in ((q.flatten().to_numpy(), (np.cumsum(nq) - nq)[row], nq[row], 1), (found[:, 0], ends[rows][:-1][row] + begin, held, shift)):
                within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                ids.ravel()[np.repeat(np.arange(len(m)) * size + place, m) + within] = values[np.repeat(first_value, m) + within]
            every = np.arange(len(k))
            ids[:, 0], ids[every, shift - 1], ids[every, shift + held] = cls, sep, sep
            start, end = (x[row] - begin[:, None] for x in asked[:2])
            inside = (start >= 0) & (end < held[:, None]) & (start <= end)
            given = np.arange(slots) < np.maximum(asked[2], 1)[row][:, None]  # without an answer the first slot is (0, 0)
            spots = [pa.array(np.where(given, np.where(inside, x + shift[:, None], 0), -1).astype(np.int32).ravel()) for x in (start, end)]
            labels = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * slots), pa.StructArray.from_arrays(spots, ["start", "end"]))
            parts = [pa.array(k.astype(np.int32)), pa.array(begin.astype(np.int32)), B.lists(np.arange(len(k) + 1) * size, ids.ravel()), pa.array(held.astype(np.int32)), labels]
            made = pa.StructArray.from_arrays(parts, ["passage", "passage_start_t", "input_ids", "__held", "labels"])
            yield pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), made)

    def run(df: DataFrame) -> DataFrame:
        work = df.where(F.col("text").rlike(r"\S"))  # not of the pieces, which a pushed filter would cut twice
        work = work.withColumn("__q", F.slice(S.word_pieces(_words(F.col("question"), question_size), vocabulary)["ids"], 1, question_size))
        spans = F.transform("answers", lambda a: a["start"].cast("long")), F.transform("answers", lambda a: a["start"].cast("long") + F.length(a["text"]) - 1)
        work = work.withColumn("__made", passages(_words(F.col("text")), F.col("text"), F.col("__q"), *spans))
        out = work.select(*df.columns, (F.size("__q") + 2).alias("seq_2_start_t"), F.inline_outer("__made"))  # outer, as a filter on the passages would make them twice
        shift, held = F.col("seq_2_start_t"), F.col("__held")
        ones, zeros = (lambda n, x=x: F.array_repeat(F.lit(x), n) for x in (1, 0))
        masks = T.pad(ones(shift + held + 1), size, F.lit(0)).alias("padding_mask"), T.pad(F.concat(zeros(shift), ones(held + 1)), size, F.lit(0)).alias("segment_ids")
        return out.select(*df.columns, "passage", "passage_start_t", "input_ids", *masks, "seq_2_start_t", "labels")

    return run


def _places(rows: np.ndarray, ends: np.ndarray, offsets: np.ndarray, codes: np.ndarray, different: pa.Array, text: pa.Array, first: pa.Array, last: pa.Array, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the pieces that hold the first and last characters of its first ``slots`` answers, and how many these are.

    -1 is before the first piece.  Words are looked for in the text only as far as the answers reach.
    """
    out, given = np.full((2, len(text), slots), -1, np.int64), np.zeros(len(text), np.int64)
    known: dict[int, str] = {}
    for r, (a, b) in enumerate(zip(first.to_pylist(), last.to_pylist(), strict=True)):
        if not a:
            continue
        given[r] = min(len(a), slots)
        t = text[r].as_py()
        begin, end = int(ends[rows[r]]), int(ends[rows[r + 1]])
        wanted = sorted({c for c in (*a[:slots], *b[:slots]) if c is not None})
        at: dict[int, int] = {}
        word, place, size, seen = int(rows[r]), 0, 0, begin  # pieces before ``seen`` start at or before the character
        for c in wanted:
            if c >= len(t):
                seen, word = end, int(rows[r + 1])
            while word < rows[r + 1]:
                if not size:
                    code = int(codes[word])
                    w = known.get(code)
                    if w is None:
                        w = known[code] = different[code].as_py()
                    place, size = t.index(w, place), len(w)
                if place > c:
                    break
                stop = int(ends[word + 1])
                while seen < stop and place + offsets[seen] <= c:
                    seen += 1
                if seen < stop:
                    break
                word, place, size = word + 1, place + size, 0
            at[c] = seen - begin - 1
        for i, x in enumerate((a, b)):
            out[i, r, : given[r]] = [-1 if c is None else at[c] for c in x[:slots]]
    return out[0], out[1], given


def natural_questions_inputs(vocabulary: Sequence[str], size: int = 384, stride: int = 128, question_size: int = 64, slots: int = 6, radius: int = 200, key: str | None = None, keep_no_answer: float = 1.0, seed: int = 0) -> Processor:
    """Records of the natural-questions processor with their ``question``: the crop's passages, their slots and ``answer_type_ids``.

    With a ``key``, passages without an answer are kept with probability ``keep_no_answer`` by a hash, and one passage at least of each record.

    A passage that does not hold the answer is ``no_answer``; yes and no count where the answer's passage is, or everywhere without one.
    """
    _check(size, stride, question_size)

    def run(df: DataFrame) -> DataFrame:
        work = processor("natural_questions", radius=radius)(df).where(F.exists("cropped", lambda w: w.isNotNull()))
        work = work.withColumn("q", F.slice(S.word_pieces(_words(F.col("question"), question_size), vocabulary)["ids"], 1, question_size))
        work = work.withColumn("cut", S.word_pieces(F.col("cropped"), vocabulary))
        firsts = F.filter(F.transform("cut.initial", lambda m, i: F.when(m == 1, i)), lambda i: i.isNotNull())  # a word's first piece
        work = work.withColumn("firsts", firsts)
        first = F.get("firsts", F.col("crop_start").cast("int"))
        last = F.coalesce(F.get("firsts", F.col("crop_end").cast("int")), F.size("cut.ids")) - 1
        spans = F.when(F.col("crop_start").isNotNull(), F.array(F.struct(first.alias("first"), last.alias("last"))))
        work = work.withColumn("spans", F.coalesce(spans, F.array().cast("array<struct<first: int, last: int>>"))).withColumn("p", F.col("cut.ids")).drop("cut", "firsts")
        out = _passages(work, vocabulary, size, stride, slots)
        away = F.col("crop_start").isNotNull() & (F.col("labels")[0]["end"] == 0)
        kind = F.when(away, "no_answer").otherwise(F.col("answer_type"))
        out = out.withColumn("answer_type_ids", T.label_index(kind, ANSWER_TYPES))
        if key is None or keep_no_answer >= 1:
            return out
        marked = out.withColumn("__place", F.concat_ws("/", key, "passage"))
        return SP.keep_negatives(marked, "__place", [key], "answer_type_ids <> 0", keep_no_answer, seed).drop("__place")

    return run


def similarity_inputs(vocabulary: Sequence[str], positives: int = 1, negatives: int = 1, size: int = 64, passage_size: int = 256, titles: bool = True) -> Processor:
    """``(query, passages)`` of the retrieval reader to ids of the query and of each passage, a title before its text as a pair.

    Missing passages are empty ones; ``label_ids`` is 1 for positives.
    """

    def run(df: DataFrame) -> DataFrame:
        empty = F.struct(F.lit("").alias("title"), F.lit("").alias("text"), F.lit("padding").alias("label"), F.lit("").alias("external_id"))
        pick = lambda name, n: F.slice(F.filter("passages", lambda p: p["label"] == name), 1, n)
        count = positives + negatives
        chosen = F.slice(F.concat(pick("positive", positives), pick("hard_negative", negatives), F.array_repeat(empty, count)), 1, count)
        work = df.withColumn("chosen", chosen)
        outs = []
        for i in range(count):
            title, body = (S.word_pieces(_words(F.col("chosen")[i][c], passage_size), vocabulary)["ids"] for c in ("title", "text"))
            sides = _truncated(title, body, passage_size) if titles else _truncated(body, None, passage_size)
            outs.append(F.struct(*_assembled(vocabulary, *sides, passage_size)))
        query, _ = _truncated(S.word_pieces(_words(F.col("query"), size), vocabulary)["ids"], None, size)
        names = ("input_ids", "segment_ids", "padding_mask")
        of_query = [c.alias("query_" + n) for c, n in zip(_assembled(vocabulary, query, None, size), ("input_ids", "padding_mask", "segment_ids"), strict=True)]
        marks = F.transform("chosen", lambda p: (p["label"] == "positive").cast("int")).alias("label_ids")
        work = work.select("*", *of_query, marks, F.array(*outs).alias("ready")).drop("chosen")
        return work.select("*", *[F.col("ready." + n).alias("passage_" + n) for n in names]).drop("ready")

    return run


def _masking(vocabulary: Sequence[str], size: int, share: float, most: int, seed: int):
    """The masking of :func:`language_inputs`, as a function of keys, bounds of rows, ids (changed in place) and word starts; gives what is asked for."""
    mask, budget, ids = list(vocabulary).index(S.MASK), min(most, max(1, round(share * size))), len(vocabulary)

    ends = [f"-{i}-{seed}".encode() for i in range(size)], [f"-{-1 - i}-{seed}".encode() for i in range(size)]

    def masked(keys: list[str], bounds: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        wanted = np.full(len(values), -1, np.int32)
        last = np.concatenate([[-1], starts[:-1]])
        last[bounds[:-1]] = -1
        begins = (starts == 1) | ((starts == 0) & (last == -1))  # a segment may begin within a word
        firsts = np.flatnonzero(begins)
        sizes = np.bincount(np.cumsum(begins)[starts != -1] - 1, minlength=len(firsts)).tolist()
        words = np.searchsorted(firsts, bounds).tolist()
        firsts = firsts.tolist()
        for r, k in enumerate(keys):
            key, at, used = str(k).encode("utf-8", "surrogatepass"), int(bounds[r]), 0
            draw = lambda end: hashlib.md5(key + end, usedforsecurity=False).digest()[:8]  # noqa: B023, E731
            for _, w in sorted((draw(ends[0][firsts[w] - at]), w) for w in range(words[r], words[r + 1])):
                if used + sizes[w] > budget:
                    continue
                used += sizes[w]
                for i in range(firsts[w], firsts[w] + sizes[w]):
                    wanted[i], what = values[i], int.from_bytes(draw(ends[1][i - at]), "big")
                    if what % 10 < 9:
                        values[i] = mask if what % 10 < 8 else what // 10 % ids
                if used == budget:
                    break
        return wanted

    return masked


def bert_inputs(vocabulary: Sequence[str], key: str = "doc_id", text: str = "text", size: int = 128, share: float = 0.15, most: int = 20, seed: int = 0) -> Processor:
    """Documents ``(key, text)``, a sentence a line, to masked inputs of packed pairs, of which half go on in another document.

    Pieces are packed as :func:`textloom.operators.pairs.segment_pairs` packs tokens, so every piece of a document is in one pair; masks
    and labels are those of :func:`language_inputs`.  Gives ``key, pair, a_from, a_to, b_key, b_from, b_to, is_next`` and the inputs.
    """
    masked, room = _masking(vocabulary, size, share, most, seed), size - 3
    small = len(vocabulary) <= 1 << 15
    number, kinds = pa.int16() if small else pa.int32(), ["array<smallint>" if small else "array<int>", "array<tinyint>"]
    cls, sep, pad = (vocabulary.index(t) for t in (S.CLS, S.SEP, S.PAD))
    made = S.pieces_of(vocabulary)
    memory: list[B.Pieces] = []  # a task's

    def read(batch: pa.RecordBatch) -> tuple[list[list[int]], list[pa.Array]]:
        if not memory:
            memory.append(made())
        lines = batch.column("lines")
        rows, ends, found, within, *_ = memory[0](lines.flatten())
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lines).to_numpy())])
        sizes = np.diff(ends[rows]).tolist()
        pieces = [[m for n in sizes[i:j] for m in (*[room] * (n // room), *([n % room] if n % room else ()))] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        bounds = pa.array(ends[rows][edges].astype(np.int32))
        return pieces, [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (found[:, 0].astype(number.to_pandas_dtype()), (within == 0).astype(np.int8))]

    def finish(pairs: pa.RecordBatch, names: list[str | None]) -> pa.RecordBatch:
        na, nb = (pc.list_value_length(pairs.column(c)).to_numpy().astype(np.int64) for c in ("a0", "b0"))
        tokens, starts = np.full((len(na), size), pad, np.int32), np.full((len(na), size), -1, np.int32)
        for first, n, c in ((np.ones(len(na), np.int64), na, "a"), (na + 2, nb, "b")):
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(np.arange(len(n)) * size + first, n) + within
            tokens.ravel()[at], starts.ravel()[at] = (pairs.column(f"{c}{i}").flatten().to_numpy() for i in (0, 1))
        every = np.arange(len(na))
        tokens[:, 0], tokens[every, na + 1], tokens[every, na + nb + 2] = cls, sep, sep
        bounds = np.arange(len(na) + 1) * size
        keys = [str(p) if k is None else f"{k}/{p}" for k, p in zip(names, pairs.column("pair").to_pylist(), strict=True)]
        wanted = masked(keys, bounds, tokens.ravel(), starts.ravel())
        return pa.RecordBatch.from_arrays([*pairs.columns[:8], B.lists(bounds, tokens.ravel()), B.lists(bounds, wanted)], [*pairs.schema.names[:8], "input_ids", "lm_label_ids"])

    def run(df: DataFrame) -> DataFrame:
        if room < 2:
            raise ValueError("no room for two segments")
        docs = PR.in_hash_order(df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").rlike(r"\S")), seed)
        lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))
        docs = docs.select("key", "rn", "n_rows", F.transform(lines, T.punctuation_tokens).alias("lines"))
        out = PR.met_pairs(docs, read, kinds, room, seed, finish, "input_ids array<int>, lm_label_ids array<int>")
        na, nb = ((F.col(f"{s}_to") - F.col(f"{s}_from")).cast("int") for s in "ab")
        ones, zeros = (lambda n, x=x: F.array_repeat(F.lit(x), n) for x in (1, 0))
        masks = T.pad(ones(na + nb + 3), size, F.lit(0)).alias("padding_mask"), T.pad(F.concat(zeros(na + 2), ones(nb + 1)), size, F.lit(0)).alias("segment_ids")
        return out.select(F.col("key").alias(key), *PR.PLACES, "input_ids", "lm_label_ids", *masks, F.when(F.col("is_next"), 0).otherwise(1).alias("nextsentence_label_ids"))

    return run


def language_inputs(vocabulary: Sequence[str], key: str = "id", size: int = 128, share: float = 0.15, most: int = 20, seed: int = 0) -> Processor:
    """``(key, text, text_b, is_next)`` to masked inputs: ``lm_label_ids`` (-1 where nothing is asked) and ``nextsentence_label_ids``.

    Whole words are taken in hash order while min(most, max(1, round(share * size))) pieces are not exceeded, a word that would exceed
    it is passed over; of their pieces 80 % become the mask, 10 % another id, 10 % stay.  0 means that B follows A.  A
    draw depends on the key and the place only, so reruns agree.  A null ``text_b`` is a text without a partner.
    """
    masked = _masking(vocabulary, size, share, most, seed)

    @F.arrow_udf("struct<input_ids: array<int>, lm_label_ids: array<int>>")
    def made(it: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, tokens, initial in (part for batch in it for part in B.column_slices(batch)):
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy())])
            values = tokens.flatten().to_numpy().copy()
            wanted = masked(keys.to_pylist(), bounds, values, initial.flatten().to_numpy())
            yield pa.StructArray.from_arrays([B.lists(bounds, values), B.lists(bounds, wanted)], ["input_ids", "lm_label_ids"])

    def run(df: DataFrame) -> DataFrame:
        a, b = (S.word_pieces(_words(F.col(c), size), vocabulary) for c in ("text", "text_b"))
        na, nb = T.pair_lengths(F.size("a.ids"), F.size("b.ids"), size - 3)
        work = df.withColumn("a", a).withColumn("b", b).withColumn("na", na).withColumn("nb", nb)
        side = lambda s, field: F.slice(F.col(f"{s}.{field}"), F.lit(1), F.col("n" + s))
        starts = T.pad(T.with_specials(side("a", "initial"), side("b", "initial"), -1, -1), size, F.lit(-1))
        tokens, *masks = _assembled(vocabulary, side("a", "ids"), side("b", "ids"), size)
        out = work.withColumn("made", made(F.col(key).cast("string"), tokens, starts)).select("*", "made.*", *masks).drop("made")
        return out.withColumn("nextsentence_label_ids", F.when(F.col("is_next"), 0).otherwise(1)).drop("a", "b", "na", "nb")

    return run


for _n, _f in {
    "text_inputs": text_inputs, "tag_inputs": tag_inputs, "question_inputs": question_inputs,
    "natural_questions_inputs": natural_questions_inputs, "similarity_inputs": similarity_inputs, "language_inputs": language_inputs, "bert_inputs": bert_inputs,
}.items():
    register_processor(_n, _f)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LETTERS = [chr(c) for c in range(ord("a"), ord("z") + 1)]
#: The queries' vocabulary: single letters at the start of a word (ids from 5) and within (from 31).
VOCABULARY = [S.PAD, S.UNK, S.CLS, S.SEP, S.MASK, *LETTERS, *(S.INNER + c for c in LETTERS)]
#: And one with pieces of two letters, from 57.
PAIRS = [*VOCABULARY, *(a + b for a in "adeins" for b in "enrst"), *(S.INNER + a + b for a in "adeins" for b in "enrst")]


def _word_sql(words: str) -> str:
    """Ids by ``VOCABULARY`` of a list of words."""
    return rf"""flatten(list_transform({words}, lambda u: CASE WHEN regexp_full_match(u, '[a-z]+') AND length(u) <= 100
        THEN list_transform(range(1, length(u) + 1), lambda i: ascii(u[i]) - 92 + CASE WHEN i = 1 THEN 0 ELSE 26 END) ELSE [1] END))"""


def _split_sql(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{P}}$+<=>^`|~]|[^\s\p{{P}}$+<=>^`|~]+')"


def _pad_sql(tokens: str, size: int) -> str:
    return f"array_to_string(list_concat({tokens}, list_transform(range(0, {size} - len({tokens})), lambda i: 0)), ' ')"


def _joined(c: str) -> Column:
    return F.array_join(F.col(c).cast("array<string>"), " ").alias(c)


@query(
    rf"""WITH a AS (SELECT doc_id, list_position(['de', 'en'], lang) - 1 AS label_ids, {_word_sql(_split_sql("text"))}[1:62] AS t FROM documents WHERE lang IN ('de', 'en')),
    b AS (SELECT doc_id, label_ids, list_concat([2], t, [3]) AS t FROM a)
    SELECT doc_id, label_ids, {_pad_sql("t", 64)} AS input_ids, len(t) AS n_mask FROM b"""
)
def process_text_inputs(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    out = processor("text_inputs", vocabulary=VOCABULARY, labels=["de", "en"], size=64)(docs)
    return out.select("doc_id", "label_ids", _joined("input_ids"), F.size(F.array_remove("padding_mask", 0)).cast("long").alias("n_mask"))


@query(
    rf"""WITH a AS (SELECT doc_id, {_word_sql(_split_sql("lang || ' ' || source"))} AS x, {_word_sql(_split_sql("text"))} AS y, n_chars FROM documents),
    b AS (SELECT doc_id, n_chars, x, y, CASE WHEN len(x) + len(y) <= 29 THEN len(x) WHEN len(y) <= 15 THEN greatest(0, 29 - len(y)) WHEN len(x) <= 14 THEN len(x) ELSE 14 END AS na FROM a),
    c AS (SELECT doc_id, n_chars, na, list_concat([2], x[1:na], [3], y[1:29 - na], [3]) AS t FROM b)
    SELECT doc_id, (n_chars - 100) / 50.0 AS regression_label, {_pad_sql("t", 32)} AS input_ids, len(t) - na - 2 AS n_second FROM c"""
)
def process_pair_inputs(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.concat_ws(" ", "lang", "source").alias("text_a"), "text", F.col("n_chars").alias("label"))
    out = processor("text_inputs", vocabulary=VOCABULARY, text="text_a", text_b="text", size=32, scaling=(100.0, 50.0))(docs)
    return out.select("doc_id", "regression_label", _joined("input_ids"), F.size(F.array_remove("segment_ids", 0)).cast("long").alias("n_second"))


@query(
    rf"""WITH a AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents),
    b AS (SELECT doc_id, w, list_transform(w, lambda x: {_word_sql("[x]")}) AS p FROM a),
    c AS (SELECT doc_id, flatten(p)[1:30] AS t, flatten(list_transform(range(1, len(w) + 1), lambda k:
        list_transform(range(1, len(p[k]) + 1), lambda i: CASE WHEN i > 1 THEN 1 WHEN length(w[k]) > 4 THEN 3 ELSE 2 END)))[1:30] AS l FROM b)
    SELECT doc_id, {_pad_sql("list_concat([2], t, [3])", 32)} AS input_ids, {_pad_sql("list_concat([1], l, [1])", 32)} AS label_ids FROM c"""
)
def process_tag_inputs(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", T.space_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    docs = docs.withColumn("tags", F.transform("tokens", lambda w: F.when(F.length(w) > 4, "B-LONG").otherwise("O")))
    out = processor("tag_inputs", vocabulary=VOCABULARY, labels=["[PAD]", "X", "O", "B-LONG"], size=32)(docs)
    return out.select("doc_id", _joined("input_ids"), _joined("label_ids"))


@query(
    rf"""WITH a AS (SELECT doc_id, {_word_sql(_split_sql("lang || ' or ' || source || '?'"))}[1:10] AS q, list_transform(regexp_extract_all(lower(text), '\S+'), lambda w: {_word_sql(_split_sql("w"))}) AS w FROM documents),
    b AS (SELECT doc_id, q, len(w) >= 44 AS has, flatten(w) AS p, 61 - len(q) AS room, len(flatten(w[1:39])) AS s, len(flatten(w[1:44])) - 1 AS e FROM a WHERE len(w) > 0),
    c AS (SELECT doc_id, q, has, k, room, (k * 32)::INT AS passage_start_t, p[k * 32 + 1:k * 32 + room] AS h, s - k * 32 AS s, e - k * 32 AS e FROM b, range(0, greatest(0, ceil((len(p) - room) / 32.0))::BIGINT + 1) r(k)),
    f AS (SELECT *, has AND s >= 0 AND e < len(h) AS held FROM c)
    SELECT doc_id, k::INT AS passage, passage_start_t, md5({_pad_sql("list_concat([2], q, [3], h, [3])", 64)}) AS input_ids,
        CASE WHEN held THEN s + len(q) + 2 ELSE 0 END::INT AS label_start, CASE WHEN held THEN e + len(q) + 2 ELSE 0 END::INT AS label_end, CASE WHEN has THEN 0 ELSE -1 END::INT AS second FROM f"""
)
def process_question_inputs(spark: SparkSession, d: str) -> DataFrame:
    docs = PS.with_offsets(read(spark, d, "documents").select("doc_id", "text", F.concat(F.col("lang"), F.lit(" or "), F.col("source"), F.lit("?")).alias("question")), most=44)
    at, end = F.get("starts", 39), F.get("starts", 43) + F.length(F.get("tokens", 43))
    answer = F.struct(at.alias("start"), F.col("text").substr((at + 1).cast("int"), (end - at).cast("int")).alias("text"))
    far = F.struct((F.length("text") + 10).cast("long").alias("start"), F.lit("").alias("text"))  # an answer outside the text is none
    docs = docs.withColumn("answers", F.when(F.size("tokens") >= 44, F.array(answer, far)).otherwise(F.array().cast("array<struct<start: bigint, text: string>>")))
    out = processor("question_inputs", vocabulary=VOCABULARY, size=64, stride=32, question_size=10)(docs)
    return out.select(
        "doc_id", "passage", "passage_start_t", F.md5(_joined("input_ids")).alias("input_ids"), F.col("labels")[0]["start"].alias("label_start"),
        F.col("labels")[0]["end"].alias("label_end"), F.when(F.col("labels")[1]["start"] == -1, -1).otherwise(0).alias("second"),
    )


@query(
    rf"""WITH a AS (SELECT item_id, {_word_sql(_split_sql("text"))} AS t FROM benchmark),
    b AS (SELECT item_id, list_concat([2], t[1:30], [3]) AS q, list_concat([2, 24, 3], t[1:60], [3]) AS p FROM a)
    SELECT item_id, {_pad_sql("q", 32)} AS query, {_pad_sql("p", 64)} AS positive, {_pad_sql("[2, 3, 3]", 64)} AS missing, '1 0' AS label_ids FROM b"""
)
def process_similarity_inputs(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct(F.lit("t").alias("title"), F.col("text"), F.lit("positive").alias("label"), F.col("item_id").cast("string").alias("external_id"))
    items = read(spark, d, "benchmark").select("item_id", F.col("text").alias("query"), F.array(one).alias("passages"))
    out = processor("similarity_inputs", vocabulary=VOCABULARY, size=32, passage_size=64)(items)
    ids = [F.array_join(F.col("passage_input_ids")[i].cast("array<string>"), " ") for i in (0, 1)]
    return out.select("item_id", _joined("query_input_ids").alias("query"), ids[0].alias("positive"), ids[1].alias("missing"), _joined("label_ids"))


@query(
    r"""WITH RECURSIVE l AS (SELECT chr(97 + i::INT) AS c, i FROM range(26) r(i)),
    ab AS (SELECT a || b AS c, (i - 1) * 5 + j - 1 AS i FROM (SELECT unnest(['a', 'd', 'e', 'i', 'n', 's']) AS a, unnest(range(1, 7)) AS i), (SELECT unnest(['e', 'n', 'r', 's', 't']) AS b, unnest(range(1, 6)) AS j)),
    v AS (SELECT c, true AS first, 5 + i AS id FROM l UNION ALL SELECT c, false, 31 + i FROM l UNION ALL SELECT c, true, 57 + i FROM ab UNION ALL SELECT c, false, 87 + i FROM ab),
    w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\S+')) AS w FROM documents),
    cut AS (SELECT w, 1::BIGINT AS pos, []::BIGINT[] AS ids FROM w UNION ALL
        SELECT w, pos + length(top.c), list_append(ids, top.id) FROM
            (SELECT cut.w, cut.pos, cut.ids, max_by(struct_pack(c := v.c, id := v.id), length(v.c)) AS top FROM cut JOIN v ON v.first = (cut.pos = 1) AND substr(cut.w, cut.pos, length(v.c)) = v.c GROUP BY ALL))
    SELECT w.w AS word, coalesce(array_to_string(any_value(cut.ids), ' '), '1') AS ids FROM w LEFT JOIN cut ON cut.w = w.w AND cut.pos = length(w.w) + 1 AND length(w.w) <= 100 GROUP BY w.w"""
)
def word_pieces(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "documents").select(F.explode(T.space_tokens(F.lower("text"))).alias("word")).distinct()
    cut = S.word_pieces(F.array("word"), PAIRS)["ids"]
    return words.select("word", F.array_join(cut.cast("array<string>"), " ").alias("ids"))


@query()
def process_language_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Every two neighbouring lines of the documents, masked."""
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "sentence")).where("sentence <> ''")
    pairs = PR.next_sentences(lines).select(F.concat_ws("-", "doc_id", "line").alias("id"), "text", "text_b", F.lit(True).alias("is_next"))
    return processor("language_inputs", vocabulary=VOCABULARY)(pairs).select("id", _joined("input_ids"), _joined("lm_label_ids"), "nextsentence_label_ids")


@query()
def process_bert_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Packed and masked pairs of whole documents."""
    out = processor("bert_inputs", vocabulary=VOCABULARY)(read(spark, d, "documents"))
    return out.select("doc_id", "pair", "b_key", "is_next", F.md5(_joined("input_ids")).alias("input_ids"), F.md5(_joined("lm_label_ids")).alias("lm_label_ids"), "nextsentence_label_ids")


NQ = r"""r AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w, CASE WHEN doc_id % 5 = 0 THEN 'yes' ELSE 'none' END AS yes_no, doc_id % 3 = 0 AS has FROM documents),
    s AS (SELECT doc_id, w, yes_no, CASE WHEN has THEN 30 END AS a, CASE WHEN has THEN 50 END AS e FROM r),
    k AS (SELECT *, CASE WHEN yes_no = 'yes' THEN 'yes' WHEN a IS NOT NULL THEN 'span' ELSE 'no_answer' END AS answer_type, greatest(0, coalesce(a, 0) - 20) AS low, least(len(w), coalesce(e, 0) + 20) AS high FROM s)"""


@query(
    f"""WITH {NQ} SELECT doc_id, answer_type, md5(array_to_string(w[low + 1:low + greatest(0, high - low)], ' ')) AS cropped, low::INT AS shift, (a - low)::INT AS crop_start, (e - low)::INT AS crop_end FROM k"""
)
def process_natural_questions(spark: SparkSession, d: str) -> DataFrame:
    has = F.col("doc_id") % 3 == 0
    spans = F.when(has, F.array(F.struct(F.lit(35).alias("start"), F.lit(50).alias("end")), F.struct(F.lit(30).alias("start"), F.lit(32).alias("end")))).otherwise(F.array().cast("array<struct<start: int, end: int>>"))
    docs = read(spark, d, "documents").select(
        "doc_id", T.space_tokens(F.col("text")).alias("words"), F.lit(-1).alias("long_start"), F.lit(-1).alias("long_end"), spans.alias("short"), F.when(F.col("doc_id") % 5 == 0, "yes").otherwise("none").alias("yes_no")
    )
    out = processor("natural_questions", radius=20)(docs)
    return out.select("doc_id", "answer_type", F.md5(F.array_join("cropped", " ")).alias("cropped"), F.col("shift").cast("int").alias("shift"), "crop_start", "crop_end")
