"""A trained sequence tagger: hashed word features, tag transitions, decoding by Viterbi.

The fit is a structured averaged perceptron whose rounds run per shard and are averaged (:mod:`textloom.operators.fitting`).  A tag
sequence scores the sum of its words' features and of its transitions; transitions that IOB2 forbids (an I after O, after another
type or at the start) are never taken.  Among sequences of one score the one with the earlier tags of the list, from the end on, wins.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, ShortType, StringType, StructType

from textloom.functions import batches as B
from textloom.operators.fitting import dealt, load_parameters, mean_change, save_parameters

FORBIDDEN = -1e12
#: After so many sequences in a row that are tagged right, a fit tags sequences side by side.
STREAK = 24
_SHAPES = ((re.compile(r"[A-ZÀ-Þ]+"), "X"), (re.compile(r"[a-zß-ÿ]+"), "x"), (re.compile(r"\d+"), "9"))


class WordFeatures:
    """The numbers of the features of words; a task keeps the words that come again."""

    def __init__(self, width: int):
        self.width = width
        self.known, self.older = {}, {}
        self.fixed = self._numbers("b", "<<", ">>", "i0", "i1", "i2", "i3")

    def _numbers(self, *names: str) -> list[int]:
        return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % self.width for n in names]

    def _word(self, w: str) -> list[int]:
        found = self.known.get(w) or self.older.get(w)
        if found is None:
            f, shape = w.lower(), w
            for kind, mark in _SHAPES:
                shape = kind.sub(mark, shape)
            found = self._numbers(f"w{f}", f"s{f[-3:]}", f"p{f[:2]}", f"x{shape[:20]}", f"n{len(f)}", f"<{f}", f">{f}")
        if len(self.known) >= B.KEPT:
            self.older, self.known = self.known, {}
        self.known[w] = found
        return found

    def __call__(self, words: Sequence[str]) -> list[int]:
        """``FEATURES`` numbers a word of a sequence, one word after the other."""
        every, before, after, *places = self.fixed
        own = [self._word(w) for w in words]
        out: list[int] = []
        for i, x in enumerate(own):
            out += (every, *x[:5], own[i - 1][5] if i else before, own[i + 1][6] if i + 1 < len(own) else after, places[min(i, 3)])
        return out


FEATURES = 9


def word_features(words: Sequence[str], width: int) -> np.ndarray:
    """The numbers of the features of each word of a sequence, a row a word."""
    return np.array(WordFeatures(width)(words), np.int64).reshape(-1, FEATURES)


def iob_transitions(labels: Sequence[str]) -> np.ndarray:
    """0, or ``FORBIDDEN`` for what IOB2 does not allow; a row per tag before (the last row: the start), a column per tag."""
    out = np.zeros((len(labels) + 1, len(labels)))
    for j, tag in enumerate(labels):
        if tag.startswith("I-"):
            for i, before in enumerate([*labels, "O"]):
                if before[2:] != tag[2:] or before == "O":
                    out[i, j] = FORBIDDEN
    return out


def viterbi(emissions: np.ndarray, transitions: np.ndarray) -> list[int]:
    """The best tags for scores of words (rows) and tags, with ``transitions`` as of :func:`iob_transitions`."""
    n = len(emissions)
    if not n:
        return []
    score = transitions[-1] + emissions[0]
    back = np.zeros((n, emissions.shape[1]), np.int64)
    for i in range(1, n):
        ways = score[:, None] + transitions[:-1]
        back[i] = ways.argmax(0)
        score = ways.max(0) + emissions[i]
    path = [int(score.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return path[::-1]


def viterbi_many(emissions: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """:func:`viterbi` of many sequences side by side, whose words' scores stand one after the other between ``bounds``; their tags likewise."""
    sizes = np.diff(bounds)
    out = np.zeros(len(emissions), np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], bounds[:-1][order]
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left").tolist()  # sequences of more than t words
    if not longest:
        return out
    score = transitions[-1] + emissions[starts[: alive[0]]]
    steps, back = transitions[:-1][None], []
    for t in range(1, longest):
        m = alive[t]
        ways = score[:m, :, None] + steps
        back.append(ways.argmax(1))
        score[:m] = ways.max(1) + emissions[starts[:m] + t]
    path = score.argmax(1)
    every = np.arange(len(score))
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        out[starts[:m] + t] = path[:m]
        if t:
            path[:m] = back[t - 1][every[:m], path[:m]]
    return out


def _viterbi_lists(emissions: list[list[float]], start: list[float], columns: list[list[float]]) -> list[int]:
    """:func:`viterbi` over lists, faster than arrays for a short list of tags; ``columns`` has a list of the tags before for each tag."""
    score, back = [a + b for a, b in zip(start, emissions[0], strict=True)], []
    for row in emissions[1:]:
        now, last = [], []
        for column, e in zip(columns, row, strict=True):
            ways = [a + b for a, b in zip(score, column, strict=True)]
            best = max(ways)
            last.append(ways.index(best))
            now.append(best + e)
        score = now
        back.append(last)
    path = [score.index(max(score))]
    for last in reversed(back):
        path.append(last[path[-1]])
    return path[::-1]


@dataclass
class Tagger:
    """Weights of word features and transitions."""

    labels: list[str]
    words: np.ndarray
    steps: np.ndarray
    iob: bool = True

    def decode(self, tokens: Sequence[str | None]) -> list[str]:
        held = self.steps + iob_transitions(self.labels) if self.iob else self.steps
        features = word_features(["" if t is None else t for t in tokens], len(self.words))
        return [self.labels[j] for j in viterbi(self.words[features].sum(1), held)]

    def save(self, spark: SparkSession, path: str) -> None:
        save_parameters(spark, {"words": self.words, "steps": self.steps}, {"labels": self.labels, "iob": self.iob}, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Tagger:
        params, settings = load_parameters(spark, path)
        return Tagger(settings["labels"], params["words"], params["steps"], settings["iob"])


def _learn(labels: Sequence[str], allowed: np.ndarray):
    """One round over a shard: the weights' change, and the change of their mean over the round.

    A sequence is tagged by the weights that those before it left.  While sequences come out wrong often, they are tagged one by one; after
    ``STREAK`` right ones, as many are tagged side by side, and more, since the weights stay, and those after a wrong one are tagged again.
    """
    size = len(labels)

    def work(it: Iterator[pa.RecordBatch], params: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], float]:
        words, steps = params["words"], params["steps"]
        first = {"words": words.copy(), "steps": steps.copy()}
        late = {"words": np.zeros_like(words), "steps": np.zeros_like(steps)}  # change times the number of sequences before it
        n = right = 0
        flat, flat_late = words.reshape(-1), late["words"].reshape(-1)
        signs = np.repeat([1.0, -1.0], FEATURES)
        held = steps + allowed
        begin, columns = held[-1].tolist(), held[:-1].T.tolist()

        def change(f: np.ndarray, g: list[int], p: list[int]) -> None:
            nonlocal held, begin, columns
            off = [i for i, (x, y) in enumerate(zip(g, p, strict=True)) if x != y]
            cells = (f[off][:, None, :] * size + np.array([(g[i], p[i]) for i in off])[:, :, None]).ravel()
            ones = np.tile(signs, len(off))
            np.add.at(flat, cells, ones)
            np.add.at(flat_late, cells, ones * n)
            before = size, size
            for now in zip(g, p, strict=True):
                if now[0] != now[1] or before[0] != before[1]:
                    for tag, last, sign in ((now[0], before[0], 1.0), (now[1], before[1], -1.0)):
                        steps[last, tag] += sign
                        late["steps"][last, tag] += sign * n
                before = now
            held = steps + allowed
            begin, columns = held[-1].tolist(), held[:-1].T.tolist()

        for b in (part for whole in it for part in B.slices(whole)):
            gold = b.column("gold").flatten().to_numpy().astype(np.int64)
            features = b.column("features").flatten().to_numpy().astype(np.int64).reshape(-1, FEATURES)
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column("gold")).to_numpy())]).astype(np.int64)
            wanted, edges, at, end = gold.tolist(), bounds.tolist(), 0, b.num_rows
            while at < end:
                if right < STREAK:
                    low, high = edges[at], edges[at + 1]
                    f, g = features[low:high], wanted[low:high]
                    scores = words[f].sum(1)
                    p = _viterbi_lists(scores.tolist(), begin, columns) if size <= 12 else viterbi(scores, held)
                    right += 1
                    if g != p:
                        change(f, g, p)
                        right = 0
                    n, at = n + 1, at + 1
                    continue
                stop = min(end, at + max(1, min(right, 512)))
                low, high = edges[at], edges[stop]
                guess = viterbi_many(words[features[low:high]].sum(1), bounds[at : stop + 1] - low, held)
                wrong = np.flatnonzero(guess != gold[low:high])
                k = int(np.searchsorted(bounds, low + wrong[0], side="right")) - 1 if len(wrong) else stop
                n, right = n + k - at, right + k - at
                if len(wrong):
                    change(features[edges[k] : edges[k + 1]], wanted[edges[k] : edges[k + 1]], guess[edges[k] - low : edges[k + 1] - low].tolist())
                    n, right, k = n + 1, min(k - at, right // 2), k + 1
                at = k
        changes = {k: params[k] - first[k] for k in first}
        changes |= {f"mean_{k}": changes[k] - late[k] / max(n, 1) for k in first}
        return changes, float(n)

    return work


def _numbered(df: DataFrame, key: str, labels: Sequence[str], tokens: str, tags: str, width: int) -> DataFrame:
    """``(key, features, gold)`` of the rows that teach: numbers of the words' features, one word after the other, and of their tags."""
    number = {t: i for i, t in enumerate(labels)}
    small = width <= 1 << 15

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = WordFeatures(width)
        for b in (part for whole in it for part in B.slices(whole)):
            kept, features, gold = [], [], []
            for r, (row, want) in enumerate(zip(b.column(tokens).to_pylist(), b.column(tags).to_pylist(), strict=True)):
                if row and want is not None and len(row) == len(want):
                    kept.append(r)
                    features.append(np.array(found(["" if t is None else t for t in row]), np.int16 if small else np.int32))
                    gold.append([number[t] for t in want])
            columns = [b.column(key).take(pa.array(kept, pa.int64())), pa.array(features, pa.list_(pa.int16() if small else pa.int32())), pa.array(gold, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [key, "features", "gold"])

    schema = StructType([df.schema[key]]).add("features", ArrayType(ShortType() if small else IntegerType())).add("gold", ArrayType(IntegerType()))
    return df.select(key, tokens, tags).mapInArrow(batches, schema)


def fit_tagger(df: DataFrame, key: str, labels: Sequence[str], tokens: str = "tokens", tags: str = "tags", width: int = 1 << 14, rounds: int = 5, shards: int = 4, iob: bool = True) -> Tagger:
    """Fit on ``df(key, tokens, tags)``.

    Null tokens are empty words; rows without tags, or with another number of tags than tokens, teach nothing; a tag that is not
    among ``labels`` is an error.  ``width`` bounds the model, whatever the vocabulary.  Features are numbered once, before rows are dealt.
    """
    allowed = iob_transitions(labels) if iob else np.zeros((len(labels) + 1, len(labels)))
    params = {"words": np.zeros((width, len(labels))), "steps": np.zeros((len(labels) + 1, len(labels)))}
    total = {k: np.zeros_like(v) for k, v in params.items()}
    rows = dealt(_numbered(df, key, labels, tokens, tags, width), key, shards)
    try:
        for _ in range(rounds):
            change, n = mean_change(rows, params, _learn(labels, allowed))
            for k in params:
                total[k] += params[k] + change.get(f"mean_{k}", 0.0)
                params[k] = params[k] + change.get(k, 0.0)
            if not n or not change:
                break
    finally:
        rows.unpersist()
    return Tagger(list(labels), total["words"] / rounds, total["steps"] / rounds, iob)


def tag(model: Tagger, df: DataFrame, tokens: str = "tokens", name: str = "preds") -> DataFrame:
    """``df`` with the tags of each row's tokens; null where there are no tokens to tag (a null list)."""
    columns = df.columns

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = WordFeatures(len(model.words))
        held = model.steps + iob_transitions(model.labels) if model.iob else model.steps
        names = pa.array(model.labels, pa.string())
        for b in (part for whole in it for part in B.slices(whole)):
            rows = b.column(tokens).to_pylist()
            bounds = np.cumsum([0, *(len(row or ()) for row in rows)])
            features = np.concatenate([np.zeros(0, np.int64), *(np.array(found(["" if t is None else t for t in row]), np.int64) for row in rows if row)])
            guess = viterbi_many(model.words[features.reshape(-1, FEATURES)].sum(1), bounds, held)
            nulls = pa.array([row is None for row in rows], pa.bool_())
            preds = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), names.take(pa.array(guess)), mask=nulls)
            yield pa.RecordBatch.from_arrays([*b.columns, preds], [*columns, name])

    return df.mapInArrow(batches, StructType(list(df.schema.fields)).add(name, ArrayType(StringType())))


def decode_scores(df: DataFrame, scores: str, labels: Sequence[str], transitions: np.ndarray, name: str = "preds") -> DataFrame:
    """``df`` with the best tags for given scores: an array of a row of scores per word."""
    columns, width = df.columns, len(labels)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in it for part in B.slices(whole)):
            rows = b.column(scores).to_pylist()
            found = [None if r is None else [labels[j] for j in viterbi(np.array(r, float).reshape(len(r), width), transitions)] for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], [*columns, name])

    return df.mapInArrow(batches, StructType(list(df.schema.fields)).add(name, ArrayType(StringType())))
