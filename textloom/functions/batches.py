"""Arrow batches in slices of bounded size, so that what a task holds follows neither the rows of a batch nor the length of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a slice at most, unless one row has more.
SLICE = 1 << 20
#: Words that a task keeps with their pieces at most, and as many older ones, of which those that come again stay.
KEPT = 1 << 16


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes, or of one row; an empty batch is its own slice."""
    if batch.num_rows > 1 and batch.nbytes > most:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), most)
        yield from slices(batch.slice(half), most)
    else:
        yield batch


def column_slices(columns: tuple[pa.Array, ...], most: int = SLICE) -> Iterator[tuple[pa.Array, ...]]:
    """:func:`slices` of arrays of one length."""
    for b in slices(pa.RecordBatch.from_arrays(list(columns), [str(i) for i in range(len(columns))]), most):
        yield tuple(b.columns)


class Pieces:
    """Pieces of words by a function ``cut`` that gives tuples of numbers; a task keeps the words that come again.

    ``many`` may cut some of an array of words at once: it gives which, and of their pieces the words, the places among the word's
    pieces and the numbers (:func:`textloom.functions.subwords.ascii_cutter`).
    """

    def __init__(self, cut: Callable[[str], list[tuple[int, ...]]], width: int, many: Callable[[pa.Array], tuple[np.ndarray, ...]] | None = None):
        self.cut, self.width, self.many = cut, width, many
        self.known, self.older = {}, {}

    def _one(self, w: str) -> list[tuple[int, ...]]:
        found = self.known.get(w)
        if found is None:
            found = self.older.get(w)
            if found is None:
                found = self.cut(w)
            if len(self.known) >= KEPT:
                self.older, self.known = self.known, {}
            self.known[w] = found
        return found

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """For an array of arrays of words: each row's first word (and the end), each word's first piece (and the end), numbers of the
        pieces and their places within their words, codes of the words in the last, the different words; null words have no pieces."""
        rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64))])
        coded = words.flatten().dictionary_encode()
        different = coded.dictionary
        done, *made = self.many(different) if self.many else (np.zeros(len(different), bool),)
        cuts = [self._one(w) for w in different.filter(pa.array(~done)).to_pylist()]
        counts = np.zeros(len(different) + 1, np.int64)  # the last one is a null word's
        if made:
            counts += np.bincount(made[0], minlength=len(counts))
        counts[np.flatnonzero(~done)] = [*map(len, cuts)]
        firsts = np.concatenate([[0], np.cumsum(counts)])
        table = np.empty((int(firsts[-1]), self.width), np.int64)
        if made:
            table[firsts[made[0]] + made[1]] = made[2]
        flat = chain.from_iterable(chain.from_iterable(cuts))
        table[np.repeat(np.append(~done, False), counts)] = np.fromiter(flat, np.int64).reshape(-1, self.width)
        codes = pc.fill_null(coded.indices, len(different)).to_numpy().astype(np.int64)
        n = counts[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        within = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
        return rows, ends, table[np.repeat(firsts[codes], n) + within], within, codes, different


def lists(bounds: np.ndarray, values: np.ndarray, nulls: pa.Array | None = None) -> pa.ListArray:
    """An array of arrays of int from the bounds of its rows; ``nulls`` is true where a row is null."""
    offsets = pa.array(bounds.astype(np.int32))
    values = pa.array(values.astype(np.int32))
    if nulls is None or not pc.any(nulls).as_py():
        return pa.ListArray.from_arrays(offsets, values)
    return pa.ListArray.from_arrays(offsets, values, mask=nulls)
