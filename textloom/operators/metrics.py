"""Metrics as aggregates, and a registry that users extend.

Every metric maps a DataFrame with ``pred`` and ``label`` columns to a one-row DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators.ranks import running_sums

Metric = Callable[[DataFrame], DataFrame]
_METRICS: dict[str, Metric] = {}
_REPORTS: dict[str, Metric] = {}


def register_metric(name: str, metric: Metric) -> None:
    _METRICS[name] = metric


def register_report(name: str, report: Metric) -> None:
    """A user's report: a table, not one row, from ``pred`` and ``label``."""
    _REPORTS[name] = report


def compute_report(name: str, df: DataFrame) -> DataFrame:
    """The registered report, or the one per class of that name; unknown names raise ``KeyError``."""
    return ({"classification": class_report} | _REPORTS)[name](df)


def compute_metrics(name: str | Sequence[str], df: DataFrame) -> DataFrame:
    """The metrics of one name or several, side by side in one row; unknown names raise ``KeyError``."""
    if isinstance(name, str):
        return _METRICS[name](df)
    out = None
    for n in name:
        part = compute_metrics(n, df)
        out = part if out is None else out.crossJoin(part)  # one row each
    return out


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def accuracy(df: DataFrame) -> DataFrame:
    """NULL for no rows."""
    return df.agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("int")), 6).alias("acc"))


def binary_acc_f1(df: DataFrame) -> DataFrame:
    one = lambda c: F.sum(c.cast("int"))
    p, y = F.col("pred") == 1, F.col("label") == 1
    s = df.agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("acc"), one(p & y).alias("tp"), one(p).alias("np"), one(y).alias("ny"))
    f1 = _ratio(2.0 * F.col("tp"), F.col("np") + F.col("ny"))
    return s.select(F.round("acc", 6).alias("acc"), F.round(f1, 6).alias("f1"), F.round((F.col("acc") + f1) / 2, 6).alias("acc_and_f1"))


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class seen on either side."""
    preds = df.groupBy(F.col("pred").alias("cls")).agg(F.count("*").alias("np"), F.sum((F.col("pred") == F.col("label")).cast("int")).alias("tp"))
    labels = df.groupBy(F.col("label").alias("cls")).agg(F.count("*").alias("ny"))
    c = preds.join(labels, "cls", "full").na.fill(0, ["np", "tp", "ny"])
    return c.select(
        "cls",
        F.round(_ratio(F.col("tp").cast("double"), F.col("np")), 6).alias("precision"),
        F.round(_ratio(F.col("tp").cast("double"), F.col("ny")), 6).alias("recall"),
        F.round(_ratio(2.0 * F.col("tp"), F.col("np") + F.col("ny")), 6).alias("f1"),
        F.col("ny").alias("support"),
    )


def f1_macro(df: DataFrame) -> DataFrame:
    return class_report(df).agg(F.round(F.avg("f1"), 5).alias("f1_macro"))


def matthews(df: DataFrame) -> DataFrame:
    """Multiclass correlation from class counts; 0 where it is undefined."""
    preds = df.groupBy(F.col("pred").alias("cls")).agg(F.count("*").cast("double").alias("np"), F.sum((F.col("pred") == F.col("label")).cast("double")).alias("tp"))
    labels = df.groupBy(F.col("label").alias("cls")).agg(F.count("*").cast("double").alias("ny"))
    c = preds.join(labels, "cls", "full").na.fill(0, ["np", "tp", "ny"])
    s = c.agg(F.sum("tp").alias("c"), F.sum("ny").alias("s"), F.sum(F.col("np") * F.col("ny")).alias("py"), F.sum(F.col("np") ** 2).alias("pp"), F.sum(F.col("ny") ** 2).alias("yy"))
    den = F.sqrt((F.col("s") ** 2 - F.col("pp")) * (F.col("s") ** 2 - F.col("yy")))
    return s.select(F.round(_ratio(F.col("c") * F.col("s") - F.col("py"), den), 6).alias("mcc"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Each distinct value (``__v``) and its average rank; running sums in blocks of values keep tasks apart."""
    counts = df.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    return running_sums(counts, "__v", {"__r": "__c"}).select("__v", (F.col("__r") - F.col("__c") + (F.col("__c") + 1) / 2).alias(name))


def pearson_spearman(df: DataFrame) -> DataFrame:
    """Both correlations and their mean.  Ranks are made from distinct values, in blocks."""
    p = average_ranks(df, "pred", "rp").withColumnRenamed("__v", "pred")
    y = average_ranks(df, "label", "ry").withColumnRenamed("__v", "label")
    r = df.select("pred", "label").join(p, "pred").join(y, "label")
    s = r.agg(F.corr("pred", "label").alias("a"), F.corr("rp", "ry").alias("b"))
    return s.select(F.round("a", 6).alias("pearson"), F.round("b", 6).alias("spearman"), F.round((F.col("a") + F.col("b")) / 2, 6).alias("corr"))


def mse(df: DataFrame) -> DataFrame:
    return df.agg(F.round(F.avg((F.col("pred") - F.col("label")) ** 2), 4).alias("mse"))


def r2(df: DataFrame) -> DataFrame:
    s = df.agg(F.sum((F.col("pred") - F.col("label")) ** 2).alias("e"), (F.var_pop("label") * F.count("*")).alias("t"))
    return s.select(F.round(1 - F.col("e") / F.col("t"), 6).alias("r2"))


def span_scores(df: DataFrame) -> DataFrame:
    """Per question exact match and overlap F1 of predicted and gold token spans, the best over its gold spans.

    ``df(qid, p_start, p_end, g_start, g_end)`` with one row per gold span; (-1, -1) is no answer.
    """
    exact = (F.col("p_start") == F.col("g_start")) & (F.col("p_end") == F.col("g_end"))
    none = (F.col("p_start") + F.col("p_end") <= 0) | (F.col("g_start") + F.col("g_end") <= 0)
    overlap = F.greatest(F.lit(0), F.least("p_end", "g_end") - F.greatest("p_start", "g_start") + 1)
    sizes = F.col("p_end") - F.col("p_start") + F.col("g_end") - F.col("g_start") + 2
    f1 = F.when(none, exact.cast("double")).otherwise(2.0 * overlap / sizes)
    return df.groupBy("qid").agg(
        F.max(exact.cast("int")).alias("em"),
        F.max((F.col("p_start") == F.col("g_start")).cast("int")).alias("em_start"),
        F.max(f1).alias("f1"),
        F.min((F.col("g_start") >= 0).cast("int")).alias("has_answer"),
    )


def span_breakdown(scores: DataFrame) -> DataFrame:
    """EM and F1 over all questions and over those with and without answer; NULL for an empty part."""
    parts = scores.groupingSets([[], ["has_answer"]], "has_answer").agg(F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("f1"), 6).alias("f1"))
    return parts


def token_overlap(df: DataFrame) -> DataFrame:
    """Exact match and multiset F1 of the token arrays ``pred`` and ``gold``."""
    kinds = F.array_distinct(F.array_intersect("pred", "gold"))
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    common = F.aggregate(kinds, F.lit(0), lambda a, t: a + F.least(count(F.col("pred"), t), count(F.col("gold"), t)))
    n = F.size("pred") + F.size("gold")
    empty = (F.size("pred") == 0) | (F.size("gold") == 0)
    f1 = F.when(empty, (F.size("pred") == F.size("gold")).cast("double")).otherwise(2.0 * common / n)
    return df.withColumn("em", (F.col("pred") == F.col("gold")).cast("int")).withColumn("f1", f1)


def precision_recall(df: DataFrame, score: str, hit: str, positives: Column | None = None) -> DataFrame:
    """Points of the curve at each distinct score, from the smallest, with the running hits and the step of recall; from per-score counts."""
    points = df.groupBy(score).agg(F.sum(hit).alias("h"), F.count("*").alias("c"))
    run = running_sums(points, score, {"tp": "h", "rank": "c"})
    if positives is None:
        run = run.crossJoin(F.broadcast(df.agg(F.sum(hit).alias("__t"))))  # one row
        positives = F.col("__t")
    step = (F.col("h") / positives).alias("step")
    return run.select(score, "tp", "rank", (F.col("tp") / F.col("rank")).alias("precision"), (F.col("tp") / positives).alias("recall"), step)


def average_precision(curve: DataFrame) -> DataFrame:
    return curve.agg(F.round(F.sum(F.col("step") * F.col("precision")), 6).alias("avg_precision"))


def best_threshold(df: DataFrame, no_answer: str, score: str, has_answer: str) -> DataFrame:
    """The no-answer threshold with the best sum of scores: questions at or below it count their score, others that they have no answer."""
    gain = F.when(F.col(has_answer) == 1, F.col(score)).otherwise(F.lit(-1.0))
    points = df.groupBy(F.col(no_answer).alias("t")).agg(F.sum(gain).alias("g"))
    start = df.agg(F.sum((F.col(has_answer) == 0).cast("double")).alias("start"), F.count("*").alias("n"))
    run = running_sums(points, "t", {"run": "g"}).crossJoin(F.broadcast(start))  # one row
    best = run.agg(F.max(F.struct("run", (-F.col("t")).alias("nt"))).alias("m"), F.max("start").alias("start"), F.max("n").alias("n"))
    better = F.col("m.run") > 0
    return best.select(
        F.round(100 * (F.col("start") + F.when(better, F.col("m.run")).otherwise(0.0)) / F.col("n"), 6).alias("best_score"),
        F.round(F.when(better, -F.col("m.nt")).otherwise(0.0), 6).alias("threshold"),
    )


def with_no_answer(df: DataFrame, no_answer: str, score: str, has_answer: str, threshold: float) -> DataFrame:
    """``df`` with the score of the decision: above the threshold the answer is that there is none."""
    return df.withColumn(score, F.when(F.col(no_answer) > threshold, (F.col(has_answer) == 0).cast("double")).otherwise(F.col(score)))


def top_n_accuracy(scored: DataFrame, question: str, f1: str, rank: str | None = None, n: int = 1) -> DataFrame:
    """The share of questions of which one of the first ``n`` predictions shares a word with an answer; without ``rank`` all count."""
    hit = F.col(f1) > 0 if rank is None else (F.col(f1) > 0) & (F.col(rank) <= n)
    each = scored.groupBy(question).agg(F.max(hit.cast("int")).alias("__hit"))
    return each.agg(F.round(F.avg("__hit"), 6).alias("top_n_accuracy"))


def calibration_bins(df: DataFrame, confidence: str, hit: str, bins: int = 10) -> DataFrame:
    """All bins from 0 with count, hit rate and mean confidence."""
    at = F.floor(F.least(F.col(confidence), F.lit(0.9999)) * bins).cast("int")
    found = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("em"), F.round(F.avg(confidence), 6).alias("confidence"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """The share of rows in each of ``bins`` equal parts of [0, 1]."""
    at = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(at.alias("bin")).agg(F.count("*").alias("c"))
    return counts.select("bin", F.round(F.col("c") / F.sum("c").over(Window.partitionBy()), 6).alias("share"))


for _n, _f in {
    "acc": accuracy, "acc_f1": binary_acc_f1, "f1_macro": f1_macro, "mcc": matthews, "pear_spear": pearson_spearman, "mse": mse, "r2": r2,
}.items():
    register_metric(_n, _f)
