"""Fill-in-the-middle: whole texts cut in prefix, middle and suffix, put in another order behind sentinels, and restored exactly.

The unit of a cut is the code point, and a text comes as UTF-8.  Its characters fall in classes by their width (one to four bytes);
a text is stored as its maximal runs of one class: the byte and the number of units at which each run begins.  A cut at
unit k is found by binary search for the run that holds it; the byte is the run's first one plus (k - units before) * width.  So no
text is decoded or walked per cut, and a text of one class (all ASCII) is a single run.

``h1`` to ``h4``, the first 32-bit groups of SHA-256 over ``salt:id``, decide: the two cuts (``h1``, ``h2`` modulo the length + 1), whether a
document is transformed at all, and the order, psm (prefix, suffix, middle) or spm (suffix, prefix, middle).  They depend on the id alone,
so that reruns agree on any cluster.  A sentinel ends the piece before it, and texts that hold one stay plain; hence the first occurrence
of each is the border, and ``restored`` needs only the output and its form.

Scale: one pass over the table without a shuffle, in slices of ``SLICE`` texts; memory grows with the largest of these only.

Defined cases: a null text is empty; an empty text is plain; a null id counts as the empty string; repeated rows give repeated results;
an empty table gives an empty result.  Extra columns are ignored, and ``keep`` may hold any name but those of the results.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE = 256


class Runs:
    """The runs of one character class of a text in UTF-8."""

    def __init__(self, text: bytes) -> None:
        self.size = len(text)
        if text.isascii():
            self.n, self.bytes, self.units, self.widths = len(text), [0], [0], [1]
            return
        leads = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        widths = np.diff(leads, append=len(text))
        first = np.concatenate([[0], np.flatnonzero(np.diff(widths)) + 1]) if len(leads) else np.zeros(0, np.int64)
        self.n = len(leads)
        self.bytes, self.units, self.widths = leads[first].tolist(), first.tolist(), widths[first].tolist()

    def offset(self, unit: int) -> int:
        """The byte at which a unit begins; the size of the text for the unit after the last."""
        if unit >= self.n:
            return self.size
        run = bisect_right(self.units, unit) - 1
        return self.bytes[run] + (unit - self.units[run]) * self.widths[run]


def draws(doc_id: object, salt: str) -> list[int]:
    """h1 to h4 of an id."""
    h = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode("utf-8", "surrogatepass")).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def arrange(text: bytes, doc_id: object, salt: str, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, units of prefix and middle, and the output of a text."""
    runs = Runs(text)
    h1, h2, h3, h4 = draws(doc_id, salt)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not text or h3 % 100 >= rate or p in text or s in text or m in text:
        return runs.n, "plain", None, None, text
    a, b = sorted((h1 % (runs.n + 1), h2 % (runs.n + 1)))
    i, j = runs.offset(a), runs.offset(b)
    parts = (s, text[j:], p, text[:i], m, text[i:j]) if h4 % 100 < spm else (p, text[:i], s, text[j:], m, text[i:j])
    return runs.n, "spm" if h4 % 100 < spm else "psm", a, b - a, b"".join(parts)


def transform(docs: DataFrame, salt: str = "1", rate: int = 90, spm: int = 20, keep: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep``, n, form, prefix_chars, middle_chars and output of every row; ``rate`` and ``spm`` are percents."""
    held = [f"k{i}" for i in range(len(keep))]
    slim = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, held, strict=True)], F.col(doc_id).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    names = [*keep, "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                texts = b.column("t").cast(pa.binary()).to_pylist()
                rows = [arrange(t, d, salt, rate, spm) for t, d in zip(texts, b.column("d").to_pylist(), strict=True)]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                cols[-1] = pc.cast(cols[-1], pa.string(), safe=False)
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in held), *cols], names)

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(batches, f"{kept}{', ' if keep else ''}n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made."""
    s, p, m = (F.instr(output, x) for x in (SUFFIX, PREFIX, MIDDLE))
    piece = lambda begin, end: F.substring(output, begin + 3, end - begin - 3)
    middle = F.substring(output, m + 3, F.length(output))
    psm = F.concat(piece(F.lit(1), s), middle, piece(s, m))
    spm = F.concat(piece(p, m), middle, piece(F.lit(1), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
