"""Words to subword pieces of a vocabulary, greedily by the longest match first."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import batches as B

# fixed values: the special tokens and the mark of a piece that goes on within a word
PAD, UNK, CLS, SEP, MASK = "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"
INNER = "##"
#: A word of more characters than this is one unknown piece.
LONGEST_WORD = 100


def reaches(vocabulary: Sequence[str]) -> dict[str, int]:
    """The most characters of a piece by its first one, with the mark where it goes on within a word."""
    found: dict[str, int] = {}
    for t in vocabulary:
        for mark in ("", INNER):
            if t.startswith(mark) and len(t) > len(mark):
                first = t[: len(mark) + 1]
                found[first] = max(found.get(first, 0), len(t) - len(mark))
    return found


def cut_word(word: str, ids: dict[str, int], longest: int, reach: dict[str, int] | None = None) -> list[tuple[int, int]] | None:
    """``(id, first character)`` of the pieces of a word; None if some part of it is in no piece.  ``reach``, of :func:`reaches`, saves look-ups."""
    found, at = [], 0
    while at < len(word):
        mark = INNER if at else ""
        for end in range(min(len(word), at + (longest if reach is None else reach.get(mark + word[at], 0))), at, -1):
            piece = ids.get(mark + word[at:end])
            if piece is not None:
                found.append((piece, at))
                at = end
                break
        else:
            return None
    return found


def cutter(vocabulary: Sequence[str], lower: bool = True) -> Callable[[str], list[tuple[int, int]]]:
    """:func:`cut_word` by a vocabulary, which has to hold ``[UNK]``: a word that can't be cut, or is too long, is one unknown piece."""
    first = {t: i for i, t in enumerate(vocabulary)}
    inner = {t[len(INNER) :]: i for t, i in first.items() if t.startswith(INNER) and len(t) > len(INNER)}
    unknown, tables = first[UNK], []
    for pieces in (first, inner):  # with the most characters of a piece by its first one
        reach: dict[str, int] = {}
        for t in filter(None, pieces):
            reach[t[0]] = max(reach.get(t[0], 0), len(t))
        tables.append((pieces.get, reach.get))

    def cut(w: str) -> list[tuple[int, int]]:
        form = w.lower() if lower else w
        n = len(w)
        if len(form) != n:
            form = w
        found, at = [], 0
        piece, reach = tables[0]
        while at < n <= LONGEST_WORD:
            end = at + reach(form[at], 0)
            if end > n:
                end = n
            while end > at:
                what = piece(form[at:end])
                if what is not None:
                    break
                end -= 1
            else:
                return [(unknown, 0)]
            found.append((what, at))
            at = end
            piece, reach = tables[1]
        return found or [(unknown, 0)]

    return cut


def ascii_cutter(vocabulary: Sequence[str], lower: bool = True) -> Callable[[pa.Array], tuple[np.ndarray, ...]]:
    """:func:`cutter` for the ASCII words of an array at once: all of them go down the vocabulary's trie together, piece by piece.

    Gives which words these are, and of each piece its word, its place among the word's pieces and ``(id, first character)``.  The
    trie is built when a task first needs it.
    """
    unknown, built = list(vocabulary).index(UNK), []

    def build() -> tuple[np.ndarray, ...]:
        numbers = {t: i for i, t in enumerate(vocabulary) if t and t.isascii()}
        letters = {c: k for k, c in enumerate(sorted(set("".join(numbers))), 1)}
        alphabet = np.zeros(256, np.int64)
        for c, k in letters.items():
            alphabet[ord(c)] = k
        if lower:
            alphabet[ord("A") : ord("Z") + 1] = alphabet[ord("a") : ord("z") + 1]
        edges, piece = {}, [-1, -1, -1]  # nowhere, the start of a word, within it
        for t, i in numbers.items():
            for node, form in ((1, t), (2, t[len(INNER) :] if t.startswith(INNER) else "")):
                for c in form:
                    key = node, letters[c]
                    node = edges.get(key)
                    if node is None:
                        node = edges[key] = len(piece)
                        piece.append(-1)
                if form:
                    piece[node] = i
        table = np.zeros((len(piece), len(letters) + 1), np.int32)
        if edges:
            table[tuple(np.array([*edges]).T)] = [*edges.values()]
        return alphabet, table, np.array(piece, np.int64), table.any(1)

    def many(words: pa.Array) -> tuple[np.ndarray, ...]:
        if not built:
            built.extend(build())
        alphabet, table, piece, more = built
        sizes = pc.binary_length(words).to_numpy().astype(np.int64)
        done = pc.string_is_ascii(words).to_numpy(zero_copy_only=False) & (sizes > 0) & (sizes <= LONGEST_WORD)
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
        text = alphabet[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.int64)
        failed, found, step, root = np.zeros(len(words), bool), [], 0, 1
        w = np.flatnonzero(done)
        at, stop = offsets[w], offsets[w + 1]
        while len(w):
            node = table[root, text[at]]
            best, size, depth = piece[node], np.ones(len(w), np.int64), 1
            live = np.flatnonzero(more[node] & (at + 1 < stop))
            reached = node[live]
            while len(live):
                reached = table[reached, text[at[live] + depth]]
                depth += 1
                hit = piece[reached] >= 0
                best[live[hit]], size[live[hit]] = piece[reached[hit]], depth
                on = more[reached] & (at[live] + depth < stop[live])
                live, reached = live[on], reached[on]
            good = best >= 0
            failed[w[~good]] = True
            w, at, stop, best, size = w[good], at[good], stop[good], best[good], size[good]
            found.append((w, np.full(len(w), step), best, at - offsets[w]))
            at = at + size
            on = at < stop
            w, at, stop, step, root = w[on], at[on], stop[on], step + 1, 2
        bad = np.flatnonzero(failed)
        found.append((bad, np.zeros(len(bad), np.int64), np.full(len(bad), unknown), np.zeros(len(bad), np.int64)))
        word, place, number, first = (np.concatenate(x) for x in zip(*found, strict=True))
        kept = ~failed[word]
        kept[len(kept) - len(bad) :] = True
        return done, word[kept], place[kept], np.stack([number[kept], first[kept]], 1)

    return many


def pieces_of(vocabulary: Sequence[str], lower: bool = True) -> Callable[[], B.Pieces]:
    """What makes a task's cutter of arrays of arrays of words."""
    cut, many = cutter(vocabulary, lower), ascii_cutter(vocabulary, lower)
    return lambda: B.Pieces(cut, 2, many)


def word_pieces(words: Column, vocabulary: Sequence[str], text: Column | None = None, lower: bool = True) -> Column:
    """A struct of three arrays for an array of words: ``ids`` of the pieces, ``initial`` (1 at a word's first piece), ``starts``.

    ``starts`` are the pieces' first characters in ``text``, in which the words stand in this order with only white space between
    them, or else in the words set side by side.  An id is a token's place in ``vocabulary``, which has to hold ``[UNK]``.  Batches
    come in slices of bounded size (:mod:`textloom.functions.batches`), whose rows are put together by whole arrays; a task keeps the
    pieces of its words up to a bound.  Null words have no pieces.
    """
    made = pieces_of(vocabulary, lower)

    @F.arrow_udf("struct<ids: array<int>, initial: array<int>, starts: array<int>>")
    def pieces(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cutter = made()
        for batch in it:
            for words, text in B.column_slices(batch):
                rows, ends, found, within, codes, different = cutter(words)
                n = np.diff(ends)
                known = different.to_pylist()
                sizes = np.array([*map(len, known), 0], np.int64)[codes]
                before = np.cumsum(sizes) - sizes
                at = before - np.repeat(np.concatenate([before, [0]])[np.minimum(rows[:-1], len(before))], np.diff(rows))
                if text.null_count < len(text):
                    for r, t in enumerate(text.to_pylist()):
                        place = 0
                        for i in range(rows[r], rows[r + 1]) if t is not None else ():
                            if codes[i] < len(known):
                                place = t.index(known[codes[i]], place)
                                at[i] = place
                                place += sizes[i]
                parts = (found[:, 0], within == 0, np.repeat(at, n) + found[:, 1])
                yield pa.StructArray.from_arrays([B.lists(ends[rows], x) for x in parts], ["ids", "initial", "starts"])

    return pieces(words, F.lit(None).cast("string") if text is None else text)
