"""String and array functions of text preprocessing, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: ASCII punctuation; articles; punctuation and symbols as the token splitter takes them
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = ("a", "an", "the")
SPLIT_PATTERN = r"[\p{P}$+<=>^`|~]|[^\s\p{P}$+<=>^`|~]+"


def space_tokens(text: Column) -> Column:
    """The runs of characters other than white space."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def squeeze_space(text: Column) -> Column:
    """Every white-space character becomes a space."""
    return F.regexp_replace(text, r"\s", " ")


def punctuation_tokens(text: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(text, F.lit(SPLIT_PATTERN), F.lit(0))


def answer_tokens(text: Column) -> Column:
    """Lower-case words without ASCII punctuation and articles."""
    words = space_tokens(F.regexp_replace(F.lower(text), ASCII_PUNCTUATION, ""))
    return F.filter(words, lambda w: ~w.isin(*ARTICLES))


def normalize_answer(text: Column) -> Column:
    return F.array_join(answer_tokens(text), " ")


def pad(values: Column, size: int, filler: Column, left: bool = False) -> Column:
    """``values`` filled up to ``size``; longer arrays stay as they are."""
    fill = F.array_repeat(filler, F.greatest(F.lit(0), F.lit(size) - F.size(values)))
    return F.concat(fill, values) if left else F.concat(values, fill)


def pair_lengths(a: Column, b: Column, limit: int, strategy: str = "longest_first") -> tuple[Column, Column]:
    """How many of two sequences of lengths ``a`` and ``b`` stay within ``limit`` together.

    ``longest_first`` takes one from the longer one each time, from the first one at equal lengths, as a closed form;
    ``only_first`` and ``only_second`` take all from one, which keeps 0 at least.
    """
    over = F.greatest(F.lit(0), a + b - limit)
    if strategy == "only_first":
        return F.greatest(F.lit(0), a - over), b
    if strategy == "only_second":
        return a, F.greatest(F.lit(0), b - over)
    if strategy != "longest_first":
        raise ValueError(f"unknown truncation strategy {strategy!r}")
    level_a, level_b = F.lit(limit // 2), F.lit(limit - limit // 2)
    kept_a = F.when(over == 0, a).when(b <= level_b, F.greatest(F.lit(0), limit - b)).when(a <= level_a, a).otherwise(level_a)
    kept_a = F.least(a, kept_a)
    return kept_a, F.when(over == 0, b).otherwise(F.least(b, F.greatest(F.lit(0), limit - kept_a)))


def with_specials(first: Column, second: Column | None, start: str = "[CLS]", sep: str = "[SEP]") -> Column:
    """``[CLS] a [SEP]`` or ``[CLS] a [SEP] b [SEP]``."""
    s, e = F.array(F.lit(start)), F.array(F.lit(sep))
    return F.concat(s, first, e) if second is None else F.concat(s, first, e, second, e)


def segment_ids(first: Column, second: Column | None) -> Column:
    """0 for the first sequence with its special tokens, 1 for the second."""
    zeros = F.array_repeat(F.lit(0), F.size(first) + 2)
    return zeros if second is None else F.concat(zeros, F.array_repeat(F.lit(1), F.size(second) + 1))


def second_start(tokens: Column, sep: str = "[SEP]") -> Column:
    """The index (from 0) after the first separator; null where there is none."""
    at = F.array_position(tokens, sep)
    return F.when(at > 0, at)


def label_index(label: Column, labels: Sequence[str]) -> Column:
    """The index of a label in the list; null for labels that are not in it."""
    at = F.array_position(F.array(*map(F.lit, labels)), label)
    return F.when(at > 0, at - 1)


def multi_hot(label_list: Column, labels: Sequence[str], sep: str = ",") -> Column:
    """A list of labels in a string as 0 and 1 for each label."""
    given = F.split(label_list, sep)
    return F.array(*[F.array_contains(given, x).cast("int") for x in labels])


def expand_labels(labels: Column, initial: Column, filler: str = "X") -> Column:
    """Word labels dealt to tokens: ``initial`` is 1 at the first token of a word; other tokens get ``filler``."""
    starts = F.filter(F.transform(initial, lambda m, i: F.when(m == 1, i)), lambda i: i.isNotNull())
    # a one-element array makes the inputs variables, so that they are not worked out again for each token
    bound = F.array(F.struct(labels.alias("l"), starts.alias("s"), F.size(initial).alias("n")))

    def dealt(x: Column) -> Column:
        end = lambda j: F.coalesce(F.get(x["s"], j), x["n"])
        others = lambda n: F.array_repeat(F.lit(filler), n.cast("int"))
        words = F.transform(x["s"], lambda p, j: F.concat(F.array(F.coalesce(F.get(x["l"], j), F.lit(filler))), others(end(j + 1) - p - 1)))
        return F.concat(others(end(F.lit(0))), F.flatten(words))

    return F.when(initial.isNotNull(), F.get(F.transform(bound, dealt), F.lit(0)))


def initial_only(values: Column, initial: Column) -> Column:
    """The values at the first tokens of words."""
    kept = F.filter(F.arrays_zip(values.alias("v"), initial.alias("m")), lambda x: x["m"] == 1)
    return F.transform(kept, lambda x: x["v"])


def transposed(rows: Column) -> Column:
    """An array of arrays of one length the other way round; null entries where an array is shorter than the first."""
    return F.transform(F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1), lambda i: F.transform(rows, lambda r: F.get(r, i)))


def joined_sentences(sentences: Column) -> Column:
    """Tokenised sentences ``array<struct<tokens, offsets, initial>>`` as one, offsets moved on; in time linear in the tokens.

    A sentence begins two places after the first place of the last token before it.  Sentences without tokens add nothing; of a null
    array or an empty one nothing is left.
    """

    @F.arrow_udf("struct<tokens: array<string>, offsets: array<bigint>, initial: array<int>>")
    def joined(rows: pa.Array) -> pa.Array:
        count = lambda x: pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64)
        before = lambda x: np.concatenate([[0], np.cumsum(x)])
        flat = rows.flatten()
        tokens, offsets, initial = (pc.struct_field(flat, [i]) for i in range(3))
        per_row, n, values = count(rows), count(tokens), offsets.flatten().to_numpy().astype(np.int64)
        ends, edges = before(n), before(per_row)
        step = np.where(n > 0, values[np.maximum(ends[1:] - 1, 0)] + 2, 0) if len(values) else np.zeros(len(n), np.int64)
        at = before(step)
        shift = at[:-1] - np.repeat(at[edges[:-1]], per_row)
        bounds = pa.array(ends[edges].astype(np.int32))
        parts = [tokens.flatten(), pa.array(values + np.repeat(shift, n)), initial.flatten().cast(pa.int32())]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(bounds, x) for x in parts], ["tokens", "offsets", "initial"])

    return joined(sentences)


def store_path(url: Column) -> Column:
    """The bucket and the key of an object store's URL; null for a URL without one of them."""
    part = lambda i: F.regexp_extract(url, r"^[a-z0-9]+://([^/]+)/+(.+)$", i)
    return F.when(part(2) != "", F.struct(part(1).alias("bucket"), part(2).alias("key")))


def file_extension(path: Column) -> Column:
    """What stands after the last point of a file's name, with the one before it for packed archives; empty without a point."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?i)\.((?:tar\.)?[^.]+)$", 1)


def is_json(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


# fixed values: languages that a model's name may hold, and models of one language
MODEL_LANGUAGES = ("german", "english", "chinese", "indian", "french", "polish", "spanish", "multilingual")
MODELS_OF_LANGUAGES = {"camembert": "french", "umberto": "italian"}


def model_language(name: Column) -> Column:
    """The language of a model by its name; English where the name says nothing."""
    out = F.lit("english")
    for language in reversed(MODEL_LANGUAGES):
        out = F.when(F.contains(name, F.lit(language)), language).otherwise(out)
    for model, language in reversed(MODELS_OF_LANGUAGES.items()):
        out = F.when(F.contains(name, F.lit(model)), language).otherwise(out)
    return out


def truncated(text: Column, size: int) -> Column:
    return F.slice(text, 1, size)
