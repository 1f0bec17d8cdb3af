"""Writers of task files and results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_answers(predictions: DataFrame, questions: DataFrame) -> DataFrame:
    """``(id, answer)``: the best prediction of every question, empty where there is none or it is no answer."""
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "answer"))
    best = predictions.withColumn("__r", first).where("__r = 1").select("id", F.coalesce("answer", F.lit("")).alias("answer"))
    missing = questions.select("id").join(best, "id", "left_anti").withColumn("answer", F.lit(""))
    return best.unionByName(missing)


def write_predictions(predictions: DataFrame, questions: DataFrame, path: str) -> None:
    top_answers(predictions, questions).write.mode("overwrite").json(path)


def relevance_scores(predictions: DataFrame) -> DataFrame:
    """The probability of label 1."""
    return predictions.withColumn("score", F.when(F.col("label") == "1", F.col("probability")).otherwise(1 - F.col("probability")))


def write_run(scores: DataFrame, path: str, most: int = 10) -> None:
    """(qid, pid, rank) of the best items, tab-separated."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "pid"))
    out = scores.withColumn("rank", rank).where(F.col("rank") <= most).select("qid", "pid", "rank")
    out.write.mode("overwrite").option("sep", "\t").csv(path)


def labelled_pairs(triples: DataFrame) -> DataFrame:
    """(query, positive, negative) as two rows with label 1 and 0."""
    return triples.select("query", F.expr("stack(2, positive, 1, negative, 0) AS (passage, label)"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def cache_key(settings: Mapping[str, object]) -> str:
    """MD5 of the settings as sorted JSON."""
    return hashlib.md5(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, settings: Mapping[str, object], build: Callable[[], DataFrame]) -> DataFrame:
    """The dataset of these settings: read if it was written whole, else built and written."""
    path = f"{folder}/{cache_key(settings)}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_parts(docs: DataFrame, path: str, number: str, per_part: int = 1000) -> None:
    """Documents in folders of ``per_part`` by their number."""
    part = F.floor(F.col(number) / per_part)
    docs.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """``word v1 v2 ...`` lines."""
    values = F.array_join(F.transform("v", lambda x: x.cast("string")), " ")
    vectors.select(F.concat_ws(" ", "word", values).alias("value")).write.mode("overwrite").text(path)


def answers_json(answers: DataFrame, squad: bool = False) -> DataFrame:
    """One JSON document per question from ranked answers ``(id, question, rank, answer, score, start, end)``."""
    text = F.when(F.col("answer") == "no_answer", "").otherwise(F.col("answer")) if squad else F.col("answer")
    one = F.struct("rank", text.alias("answer"), "score", F.col("start").alias("offset_answer_start"), F.col("end").alias("offset_answer_end"))
    rows = answers.groupBy("id", "question").agg(F.array_sort(F.collect_list(one)).alias("answers"))
    return rows.select(F.to_json(F.struct(F.lit("qa").alias("task"), "id", "question", "answers")).alias("value"))


def log_metrics(metrics: DataFrame, path: str, step: int) -> None:
    """Append one-row metrics, as (step, name, value), to a table."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in metrics.columns])
    metrics.select(F.lit(step).alias("step"), F.explode(pairs).alias("m")).select("step", "m.*").write.mode("append").parquet(path)


def save_settings(spark: SparkSession, settings: Mapping[str, object], path: str) -> None:
    spark.createDataFrame([(json.dumps(settings, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
