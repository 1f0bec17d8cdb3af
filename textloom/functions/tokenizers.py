"""More families of tokenizers: unigram segmentation by Viterbi over log scores, and byte-level merges by rank.

Both take an array of words and give an array of the numbers of their pieces.  A task keeps the pieces of its words up to a bound, so
a frequent word is cut once, and takes batches in slices of bounded size.  Null words have no pieces; a null array gives null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import batches as B

# fixed value: the mark of a word's beginning in unigram vocabularies
SPACE = "▁"
# fixed value: how byte-level vocabularies cut a text in words, each with the space before it
BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def unigram_cut(word: str, scores: Mapping[str, float], longest: int, unknown: float) -> list[str | None]:
    """The pieces of the best total score; None for a character in no piece, at the score ``unknown``.  Ties go to longer last pieces."""
    get, totals, begins = scores.get, [0.0], [0]
    for end in range(1, len(word) + 1):
        best, begin = None, end - 1
        for start in range(max(0, end - longest), end):
            own = get(word[start:end])
            if own is None:
                if start < end - 1:
                    continue
                own = unknown
            total = totals[start] + own
            if best is None or total > best:
                best, begin = total, start
        totals.append(best)
        begins.append(begin)
    out, at = [], len(word)
    while at:
        piece = word[begins[at] : at]
        out.append(piece if piece in scores else None)
        at = begins[at]
    return out[::-1]


def unigram_pieces(words: Column, vocabulary: Sequence[tuple[str, float]], unknown_id: int = 0, space: str = SPACE, fuse_unknown: bool = True) -> Column:
    """Numbers of the unigram pieces of each word, which ``space`` is put before; a piece's number is its place in ``vocabulary``.

    An unknown character costs ten more than the least score; neighbouring ones within a word are one piece if ``fuse_unknown``.
    """
    ids = {p: i for i, (p, _) in enumerate(vocabulary)}
    scores = dict(vocabulary)
    longest = max(map(len, scores))
    unknown = min(scores.values()) - 10

    def cut(w: str) -> list[tuple[int]]:
        out: list[tuple[int]] = []
        before = ""
        for p in unigram_cut(space + w, scores, longest, unknown):
            if p is not None or before is not None or not fuse_unknown:
                out.append((unknown_id if p is None else ids[p],))
            before = p
        return out

    return _numbers(cut)(words)


def _numbers(cut: Callable[[str], list[tuple[int]]]):
    @F.arrow_udf("array<int>")
    def pieces(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cutter = B.Pieces(cut, 1)
        for batch in it:
            for (words,) in B.column_slices((batch,)):
                rows, ends, found, *_ = cutter(words)
                yield B.lists(ends[rows], found[:, 0], words.is_null())

    return pieces


def byte_letters() -> dict[int, str]:
    """A visible letter for each byte: itself where it is visible in Latin-1, and the next letters from 256 on for the others."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


def merged(parts: Sequence[str], ranks: Mapping[tuple[str, str], int]) -> list[str]:
    """The parts after all merges: at each step every pair of the least rank, from the left."""
    parts, get, none = list(parts), ranks.get, len(ranks)
    while len(parts) > 1:
        found = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
        rank = min(found)
        if rank == none:
            break
        i = found.index(rank)
        if found.count(rank) == 1:
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            continue
        pair, out = (parts[i], parts[i + 1]), parts[:i]
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def byte_words(text: Column) -> Column:
    """The words of a text for byte-level merges, with the spaces before them; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(BYTE_WORDS), F.lit(0))


def byte_pair_pieces(words: Column, vocabulary: Sequence[str], merges: Sequence[tuple[str, str]], unknown_id: int = 0) -> Column:
    """Numbers of the pieces of each word: its bytes as letters, merged by the ranks (places) of ``merges``."""
    ids = {p: i for i, p in enumerate(vocabulary)}
    ranks = {tuple(m): i for i, m in enumerate(merges)}
    letters = byte_letters()

    def cut(w: str) -> list[tuple[int]]:
        return [(ids.get(p, unknown_id),) for p in merged([letters[b] for b in w.encode("utf-8", "surrogatepass")], ranks)]

    return _numbers(cut)(words)


def byte_pair_text(ids: Sequence[int], vocabulary: Sequence[str]) -> str:
    """The text of numbers of byte-level pieces."""
    back = {c: b for b, c in byte_letters().items()}
    return bytes(back[c] for i in ids for c in vocabulary[i]).decode("utf-8", "replace")


def without_accents(text: Column) -> Column:
    """Letters without their marks, as vocabularies of lower-cased words want them."""

    @F.pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
        return texts.map(lambda t: None if t is None else t if t.isascii() else plain(t))

    return strip(text)
