"""BPE encoding and decoding of whole texts, long unsplit text by tree concatenation.

White space never joins two tokens of this vocabulary, so a text is encoded word by word, and a Python worker remembers the
words that it has met in its task.  A word of more than ``SHORT`` bytes is normalised and pre-tokenised, every pre-token is cut in pieces of
``HALF`` symbols, and these are encoded and joined as a tree; ``n_by_tree`` counts the tokens that came so.  A word of more than ``LONG``
bytes takes more tasks: its pieces, of ``PIECE`` symbols, are encoded in parallel before they are joined.  Pieces are joined pairwise.  At a join a window of tokens from both sides is encoded again; it grows twofold until its first
token is the left side's token there and its last the right side's.  Then every two neighbours in the result are neighbours in a
valid encoding of their own text, which makes the whole the encoding of the whole.

Scale: one pass without a shuffle, except for texts that hold long words.  The memory of words is bounded by ``REMEMBERED``
entries.  Texts with long words are written once, their pieces dealt over all tasks and gathered by text: a task holds the
tokens of one text's long words, which is the bound of its memory (a single text is a single cell of its table anyway).

Defined cases: a null text is empty; an empty text has no tokens and decodes to an empty text; special tokens written in a
text are encoded as such, as the library does; repeated rows give repeated results; an empty table gives an empty result.
The vocabulary file is a parameter and has to exist on every node.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialise

SHORT, HALF, LONG, PIECE, REMEMBERED = 16, 8, 1024, 256, 100_000


class Codec:
    """The tokenizer of one file, with a memory of words: word -> (ids as text, tokens as text, number of ids, how many came by the tree)."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.path, self.last = path, self.whole.model
        self.suffix = self.last.end_of_word_suffix or ""
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.known: dict[bytes, tuple[str, str, int, int]] = {}

    @cached_property
    def inner(self) -> object:
        """The model for pieces that do not end their pre-token; nothing but it stays of the file."""
        from tokenizers.models import BPE

        with open(self.path, encoding="utf-8") as f:
            raw = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in raw["merges"]]
        rest = {k: raw.get(k) for k in ("unk_token", "continuing_subword_prefix") if raw.get(k) is not None}
        return BPE(raw["vocab"], merges, fuse_unk=bool(raw.get("fuse_unk")), byte_fallback=bool(raw.get("byte_fallback")), **rest)

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for i in range(0, len(new), 10_000):
            part = [w for w in new[i : i + 10_000] if len(w) <= SHORT]
            for w, e in zip(part, self.whole.encode_batch_fast([x.decode("utf-8", "surrogatepass") for x in part], add_special_tokens=False), strict=True):
                ids = e.ids
                self.known[w] = (" ".join(map(str, ids)), self.whole.decode(ids, skip_special_tokens=False), len(ids), 0)
        for w in new:
            if len(w) > SHORT:
                self.known[w] = self.entry(self.by_tree(w.decode("utf-8", "surrogatepass")))

    def entry(self, ids: list[int]) -> tuple[str, str, int, int]:
        """The entry of a word whose ids came by the tree."""
        return " ".join(map(str, ids)), self.whole.decode(ids, skip_special_tokens=False), len(ids), len(ids)

    def by_tree(self, word: str) -> list[int]:
        """The ids of a word whose pieces are encoded and joined here."""
        ids: list[int] = []
        for unit, special in self.units(word):
            cuts = [unit] if special else [unit[i : i + HALF] for i in range(0, len(unit), HALF)]
            parts = [cuts] if special else [t for t in (self.tokens(x, i + 1 == len(cuts)) for i, x in enumerate(cuts)) if t]
            ids += map(self.whole.token_to_id, self.tree(parts))
        return ids

    def digest(self, parts: list[tuple[str, str, int, int]]) -> tuple[int, str, str, int]:
        """Number of ids and the digests of a text whose words have these entries, and how many ids came by the tree."""
        parts = [p for p in parts if p[2]]
        sha = lambda k: hashlib.sha256(" ".join([p[k] for p in parts]).encode()).hexdigest()
        return sum(p[2] for p in parts), sha(0), sha(1), sum(p[3] for p in parts)

    # long unsplit text

    def units(self, word: str) -> Iterator[tuple[str, bool]]:
        """The pre-tokens of a word as the model takes them, and whether it is a special token."""
        for i, part in enumerate(self.added.split(word) if self.added else [word]):
            if i % 2:
                yield part, True
            elif part:
                for unit, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(part)):
                    yield unit, False

    def tokens(self, text: str, last: bool) -> list[str]:
        return [t.value for t in (self.last if last else self.inner).tokenize(text)]

    def text(self, tokens: list[str], last: bool) -> str:
        s = "".join(tokens)
        return s.removesuffix(self.suffix) if last else s

    def join(self, left: list[str], right: list[str], last: bool) -> list[str]:
        """The tokens of two neighbouring pieces as one; ``last``: the right one ends its pre-token."""
        n = 4
        while True:
            a, b = max(len(left) - n, 0), min(n, len(right))
            end = last and b == len(right)
            window = self.tokens(self.text(left[a:], False) + self.text(right[:b], end), end)
            left_agrees = a == 0 or (window[0] == left[a])
            right_agrees = b == len(right) or (window[-1] == right[b - 1])
            if left_agrees and right_agrees:
                return left[:a] + window + right[b:]
            n *= 2

    def tree(self, pieces: list[list[str]]) -> list[str]:
        """All pieces of a pre-token, joined in pairs until one is left."""
        while len(pieces) > 1:
            pairs = range(0, len(pieces), 2)
            pieces = [self.join(*pieces[i : i + 2], i + 2 >= len(pieces)) if i + 1 < len(pieces) else pieces[i] for i in pairs]
        return pieces[0] if pieces else []


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _row(c: Codec, text: str, long: list[list[int]] | None = None, limit: int = LONG) -> tuple[int, str, str, int]:
    words = text.encode("utf-8", "surrogatepass").split()
    if long is None:
        return c.digest([c.known[w] for w in words])
    c.learn({w for w in words if len(w) <= limit})
    parts, rest = [], iter(long)
    for w in words:
        if len(w) <= limit:
            parts.append(c.known[w])
        else:
            parts.append(c.entry(next(rest)))
    return c.digest(parts)


def encode_texts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LONG, piece: int = PIECE) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``n_by_tree`` of every row; ``limit`` in bytes of UTF-8."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_by_tree long"
    # a word of more than limit bytes has more than limit / 4 characters
    has_long = (F.octet_length("text") > limit) & F.exists(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: F.octet_length(w) > limit)

    def short(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in it:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column("text").to_pylist()
                words: set[bytes] = set()
                for t in texts:
                    words.update(t.encode("utf-8", "surrogatepass").split())
                c.learn(words)
                rows = [_row(c, t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, zip(*rows, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_by_tree"])
        c.known.clear()  # a worker goes on to other tasks

    easy = slim.where(~has_long).mapInArrow(short, out)
    rare = slim.where(has_long).withColumn("row", F.monotonically_increasing_id())
    rare = materialise(rare, "bpe-long")
    if rare.isEmpty():
        return easy

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, names = codec(path), ["row", "word", "unit", "piece", "special", "last", "text"]
        for b in it:
            for row, t in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = [w for w in t.encode("utf-8", "surrogatepass").split() if len(w) > limit]
                found = []
                for i, w in enumerate(words):
                    found.append((row, i, -1, 0, False, True, ""))  # a word without units stays a word
                    for j, (unit, special) in enumerate(c.units(w.decode("utf-8", "surrogatepass"))):
                        step = len(unit) if special else piece
                        found += [(row, i, j, k, special, (k + 1) * step >= len(unit), unit[k * step : (k + 1) * step]) for k in range(-(-len(unit) // step))]
                for k in range(0, len(found), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found[k : k + 1000], strict=True)], names)

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in it:
            rows = zip(*(b.column(x).to_pylist() for x in ("text", "last", "special")), strict=True)
            tokens = [[t] if special else c.tokens(t, last) if t else [] for t, last, special in rows]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(tokens, pa.list_(pa.string()))], ["row", "word", "unit", "piece", "tokens"])

    pieces = rare.select("row", "text").mapInArrow(cut, "row long, word long, unit long, piece long, special boolean, last boolean, text string")
    pieces = pieces.repartition("row", "word", "unit", "piece").mapInArrow(encode, "row long, word long, unit long, piece long, tokens array<string>")

    def assemble(key: tuple, texts: pa.Table, parts: pa.Table) -> pa.Table:
        c = codec(path)
        parts = parts.sort_by([("word", "ascending"), ("unit", "ascending"), ("piece", "ascending")])
        words: list[list[int]] = []
        held: list[list[str]] = []
        at = None
        number = c.whole.token_to_id
        for word, unit, tokens in zip(*(parts.column(x).to_pylist() for x in ("word", "unit", "tokens")), strict=True):
            if (word, unit) != at and held:
                words[-1] += map(number, c.tree(held))
                held = []
            at = (word, unit)
            if unit < 0:
                words.append([])
            elif tokens:
                held.append(tokens)
        if held:
            words[-1] += map(number, c.tree(held))
        n, ids, decoded, by_tree = _row(c, texts.column("text")[0].as_py(), words, limit)
        return pa.table({"doc_id": texts.column("doc_id").cast(texts.schema.field("doc_id").type), "n_tokens": [n], "ids_sha256": [ids], "decoded_sha256": [decoded], "n_by_tree": [by_tree]})

    hard = rare.groupBy("row").cogroup(pieces.groupBy("row")).applyInArrow(assemble, out)
    return easy.unionByName(hard)
