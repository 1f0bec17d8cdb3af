"""Quality rules whose cutoffs are certified on labelled holdouts.

A rule rejects a document whose signal exceeds a cutoff.  For each stratum (by default the language) and rule, the cutoffs of
a fixed grid are tested from the laxest on.  The null hypothesis of a test is that the rule falsely rejects more than
``alpha / rules`` of the stratum's good documents; its exact p-value is the binomial tail P(Bin(n, alpha / rules) <= k) for k
of n good holdout documents rejected.  Testing along the grid stops at the first cutoff that fails (a fixed sequence, which
needs no correction), and the level ``delta`` is divided by strata times rules (Bonferroni).  So with probability
1 - delta no stratum loses more than ``alpha`` of its good documents.  Of the certified cutoffs the one is taken that rejects
most bad documents, each good one lost counting ``cost`` bad ones; without enough labels no cutoff is certified and the
rule keeps everything in that stratum.

Each document of the holdout is one trial: repeated rows and several labels add nothing to the bound.

Scale: signals are made in one pass over the texts, without a shuffle, and written (a few numbers per document) for the holdout
and the verdicts.  The labelled ones are reduced to one row per document and then, with partial sums, to counts per stratum, rule
and grid cell, so a stratum with most rows is as cheap as any.  Cutoffs are broadcast for up to ``STRATA`` strata and joined
otherwise.

Defined cases: a null or empty text has no words, all signals 0, and fails the base rules (fewer than 50 words); a null
stratum value is a stratum of its own; a document with several or conflicting labels counts once, with the lowest quality; repeated
rows give repeated results; labelled rows of one id with different texts count once, by the least signals; an empty label table certifies nothing.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialise

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Cutoffs of more strata than this are not broadcast.
STRATA = 10_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words"]

#: rule -> (signal, cutoffs from the laxest to the strictest)
RULES: dict[str, tuple[str, Sequence[float]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "upper": ("n_upper_words / greatest(n_words, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
}


def text_counts(text: str | None) -> tuple[int, ...]:
    """The ``COUNTS`` of one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII spaces
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines, seen, dups = text.split("\n"), set(), 0
    full = [x for x in lines if x.strip(SPACES)]
    for x in full:
        dups += x in seen
        seen.add(x)
    repeat = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        times, covered = Counter(windows), bytearray(n)
        for i, w in enumerate(windows):
            if times[w] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeat = sum(covered)
    upper = sum(map(bytes.isupper, words))
    return n, chars, symbols, dups, repeat, len(full), upper


def count_signals(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """``keep`` and the ``COUNTS`` of every whole text, in one pass."""
    slim = docs.select(*keep, F.col(text).alias("whole_text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [text_counts(t) for t in b.column("whole_text").to_pylist()]
            cols = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *cols], [*keep, *COUNTS])

    kinds = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keep)
    return slim.mapInArrow(batches, kinds + "".join(f", {c} long" for c in COUNTS))


def tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certify(cells: pd.DataFrame, cutoffs: Sequence[float], alpha: float, level: float, cost: float) -> float | None:
    """The cutoff of one stratum and rule, or None; ``cells``: cell (number of cutoffs exceeded), good, bad."""
    good, bad = (cells.groupby("cell")[c].sum().to_dict() for c in ("good", "bad"))
    n, best, value = sum(good.values()), None, 0.0
    for j, cut in enumerate(cutoffs):
        least = len(cutoffs) - j  # a signal above this cutoff is above all stricter ones
        lost = sum(v for c, v in good.items() if c >= least)
        if not n or tail(lost, n, alpha) > level:
            break
        gain = sum(v for c, v in bad.items() if c >= least) - cost * lost
        if gain > value:
            best, value = float(cut), gain
    return best


def certified_cutoffs(
    signals: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    key: str = "doc_id",
    good: str = "quality",
    rules: dict[str, tuple[str, Sequence[float]]] = RULES,
    alpha: float = 0.05,
    delta: float = 0.05,
    cost: float = 5.0,
) -> DataFrame:
    """One row per stratum: ``stratum`` and ``cut_<rule>`` (null: nothing certified)."""
    known = labels.where(F.col(good).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(good).alias("good"))
    held = signals.select(F.col(key).alias("key"), F.struct(F.col(stratum).alias("stratum"), *COUNTS).alias("x")).join(known, "key")
    held = held.groupBy("key").agg(F.min("x").alias("x"), F.min("good").alias("good")).select("x.*", "good")
    cells = [F.struct(F.lit(r).alias("rule"), sum((F.expr(s) > c).cast("int") for c in cuts).alias("cell")) for r, (s, cuts) in rules.items()]
    cells = held.select("stratum", "good", F.explode(F.array(*cells)).alias("c"))
    is_good = F.col("good") > 0
    counts = cells.groupBy("stratum", "c.rule", "c.cell").agg(F.sum(is_good.cast("long")).alias("good"), F.sum((~is_good).cast("long")).alias("bad"))
    strata = counts.select("stratum").distinct().groupBy().agg(F.count("*").alias("n_strata"))
    counts = counts.crossJoin(F.broadcast(strata))  # one row
    n_rules = len(rules)

    def chosen(g: pd.DataFrame) -> pd.DataFrame:
        rule = g["rule"].iloc[0]
        level = delta / (n_rules * int(g["n_strata"].iloc[0]))
        cut = certify(g, rules[rule][1], alpha / n_rules, level, cost)
        return pd.DataFrame({"stratum": [g["stratum"].iloc[0]], "rule": [rule], "cut": [cut]}).astype({"cut": "float64"})

    kind = signals.schema[stratum].dataType.simpleString()
    cuts = counts.groupBy("stratum", "rule").applyInPandas(chosen, f"stratum {kind}, rule string, cut double")
    cut = F.when(~F.isnan("cut"), F.col("cut"))
    return cuts.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, cut)).alias(f"cut_{r}") for r in rules])


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    key: str = "doc_id",
    text: str = "text",
    rules: dict[str, tuple[str, Sequence[float]]] = RULES,
    **options: float,
) -> DataFrame:
    """Per document: key, stratum, the counts, ``base_failed``, ``failed_rules`` and ``kept``."""
    signals = materialise(count_signals(docs, text, [key, stratum]), "risk-signals")
    cuts = materialise(certified_cutoffs(signals, labels, stratum, key, rules=rules, **options).withColumnRenamed("stratum", "of_stratum"), "risk-cutoffs")
    if cuts.count() <= STRATA:
        cuts = F.broadcast(cuts)
    out = signals.join(cuts, F.col(stratum).eqNullSafe(F.col("of_stratum")), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = [F.when(F.expr(s) > F.col(f"cut_{r}"), F.lit(r)) for r, (s, _) in rules.items()]
    out = out.withColumn("base_failed", base).withColumn("failed_rules", F.array_compact(F.array(*failed)))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.select(key, stratum, *COUNTS, "base_failed", "failed_rules", "kept")
