"""Readers of task files; every one is a scan, nothing is read by the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_table(spark: SparkSession, path: str, columns: Sequence[str], rename: Mapping[str, str] | None = None, sep: str = "\t", quote: str = "'", rows: int | None = None, seed: int = 0) -> DataFrame:
    """Delimited text with a header, all strings; only ``columns``, renamed; missing values become empty.

    ``rows`` takes a reproducible sample of that many rows.
    """
    df = spark.read.option("sep", sep).option("quote", quote).option("header", True).csv(path).select(*columns)
    df = df.na.fill("").withColumnsRenamed(dict(rename or {}))
    if rows is not None:
        whole = F.concat_ws("\x1f", *df.columns)
        df = df.orderBy(F.md5(F.concat(whole, F.lit(f"-{seed}")))).limit(rows)
    return df


def read_pairs(spark: SparkSession, path: str, label: str | None = None, sep: str = "\t") -> DataFrame:
    """Sentence pairs: ``text``, ``text_b`` and a label column."""
    return read_table(spark, path, ["text", "text_b", *([label] if label else [])], sep=sep, quote='"')


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, line_no, value)``: the lines of text files; ``block`` is the first byte of the scan split that a line is in.

    Splits of a file are ordered by ``block``, and the lines of a split by ``line_no``, whose values are for comparison only.
    """
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), "value")


#: Lines of a split are counted in runs of at most 2^CHUNK, so that no task sorts a split as one group.
CHUNK = 16
RUN = ["file", "block", "__run"]
#: Bytes of text that a task sorts: Spark joins small partitions by their compressed size, and lines with their file's name compress well.
TASK_BYTES = 1 << 22


def _runs(lines: DataFrame, path: str) -> DataFrame:
    """``lines`` of a path with ``__run``, the run of a split's lines that a line is in, dealt by runs; runs are ordered as the lines are."""
    size = lines.sparkSession.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0  # a listing, no content is read
    return lines.withColumn("__run", F.shiftright("line_no", CHUNK)).repartition(1 + size // TASK_BYTES, *RUN)


def _groups(lines: DataFrame, path: str, closes: str) -> DataFrame:
    """``lines`` with ``grp``, how many lines of the file up to this one close a group.

    Each run counts by itself; what its file's earlier runs closed is carried over by a window on one row a run.
    """
    within = F.sum("__c").over(Window.partitionBy(*RUN).orderBy("line_no"))
    marked = _runs(lines, path).withColumn("__c", F.expr(closes).cast("int"))
    counted = marked.withColumn("__sum", within)
    runs = marked.groupBy(*RUN).agg(F.sum("__c").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("block", "__run").rowsBetween(Window.unboundedPreceding, -1))
    carried = runs.select(*RUN, F.coalesce(before, F.lit(0)).alias("__before"))
    return counted.join(carried, RUN).withColumn("grp", F.col("__sum") + F.col("__before")).drop("__c", "__run", "__sum", "__before")


def indexed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(n, value)``: the lines of a file, or of a folder's files by name, numbered from 0 without a window over a file."""
    lines = _runs(numbered_lines(spark, path), path)
    at = F.row_number().over(Window.partitionBy(*RUN).orderBy("line_no"))
    runs = lines.groupBy(*RUN).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("file", "block", "__run").rowsBetween(Window.unboundedPreceding, -1))  # a row per run
    starts = runs.select(*RUN, F.coalesce(before, F.lit(0)).alias("__before"))
    return lines.withColumn("__at", at).join(starts, RUN).select((F.col("__at") + F.col("__before") - 1).alias("n"), "value")


def zip_files(spark: SparkSession, left: str, right: str, skip_left: int = 0, skip_right: int = 0) -> DataFrame:
    """``(n, left, right)``: the lines of two files side by side, after leaving out some first ones; null where a file has ended."""
    side = lambda path, skip, name: indexed_lines(spark, path).where(F.col("n") >= skip).select((F.col("n") - skip).alias("n"), F.col("value").alias(name))
    return side(left, skip_left, "left").join(side(right, skip_right, "right"), "n", "full")


def read_tagged(spark: SparkSession, path: str, sep: str = " ", token_at: int = 0, tag_at: int = -1) -> DataFrame:
    """Token-per-line files: ``(file, sentence, tokens, tags)``.

    Blank and ``-DOCSTART-`` lines close a sentence; lines that begin with ``#`` are left out.
    """
    lines = numbered_lines(spark, path).where("NOT value LIKE '#%'")
    work = _groups(lines, path, "trim(value) = '' OR value LIKE '-DOCSTART-%'").where("trim(value) <> '' AND value NOT LIKE '-DOCSTART-%'")
    parts = F.split("value", sep)
    at = lambda i: F.element_at(parts, i + 1 if i >= 0 else i)
    rows = work.groupBy("file", "grp").agg(F.array_sort(F.collect_list(F.struct("block", "line_no", at(token_at).alias("token"), at(tag_at).alias("tag")))).alias("r"))
    return rows.select("file", F.col("grp").alias("sentence"), F.col("r.token").alias("tokens"), F.col("r.tag").alias("tags"))


QA_SCHEMA = (
    "data array<struct<title: string, paragraphs: array<struct<context: string, qas: array<struct<id: string, question: string, "
    "is_impossible: boolean, answers: array<struct<text: string, answer_start: int>>>>>>>>"
)


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Question-answer JSON, one row per question: doc, paragraph and question numbers, context, id, question, answers."""
    data = spark.read.schema(QA_SCHEMA).option("multiLine", True).json(path)
    docs = data.select(F.input_file_name().alias("file"), F.posexplode("data").alias("doc", "d"))
    paragraphs = docs.select("file", "doc", "d.title", F.posexplode("d.paragraphs").alias("paragraph", "p"))
    return paragraphs.select("file", "doc", "title", "paragraph", F.col("p.context").alias("context"), F.posexplode("p.qas").alias("question_no", "q")).select(
        "file", "doc", "title", "paragraph", "question_no", "context", "q.id", "q.question", "q.is_impossible", "q.answers"
    )


def normalize_qa(df: DataFrame) -> DataFrame:
    """Two request shapes, ``{context, qas}`` and ``{text, questions}``, as ``(context, question)`` rows with their number."""
    has = set(df.columns)
    forms = []
    if "context" in has:
        forms.append(df.where("context IS NOT NULL").select("context", F.posexplode(F.transform("qas", lambda q: q["question"])).alias("question_no", "question")))
    if "text" in has:
        forms.append(df.where("text IS NOT NULL").select(F.col("text").alias("context"), F.posexplode("questions").alias("question_no", "question")))
    out = forms[0]
    for f in forms[1:]:
        out = out.unionByName(f)
    return out


# fixed values: other names of the keys of retrieval records
QUERY_KEYS = ("query", "question", "questions", "query_text")
POSITIVE_KEYS = ("positive_ctxs", "positive_contexts", "positive_context", "positive_ctx", "positives")
NEGATIVE_KEYS = ("hard_negative_ctxs", "hard_negative_contexts", "hard_negative_context", "hard_negative_ctx", "hard_negatives")
PASSAGE = "array<struct<title: string, text: string, passage_id: string>>"


# fixed values: the keys of natural-questions records
NQ_SCHEMA = (
    "example_id string, question_text string, document_text string, document_url string, "
    "long_answer_candidates array<struct<start_token: int, end_token: int, top_level: boolean>>, "
    "annotations array<struct<yes_no_answer: string, long_answer: struct<start_token: int, end_token: int, candidate_index: int>, "
    "short_answers array<struct<start_token: int, end_token: int>>>>"
).replace("short_answers array", "short_answers: array")


def read_natural_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of natural-questions records, as the processor takes them.

    ``(example_id, question, words, long_start, long_end, short, yes_no)``: words are those between single spaces, positions theirs (-1 for
    none), the first annotation counts; a record without one has no answer.
    """
    raw = spark.read.schema(NQ_SCHEMA).json(path)
    first = F.get("annotations", F.lit(0))
    short = F.transform(F.coalesce(first["short_answers"], F.array().cast("array<struct<start_token: int, end_token: int>>")), lambda s: F.struct(s["start_token"].alias("start"), s["end_token"].alias("end")))
    return raw.select(
        "example_id", F.col("question_text").alias("question"), F.split(F.coalesce("document_text", F.lit("")), " ").alias("words"),
        F.coalesce(first["long_answer"]["start_token"], F.lit(-1)).alias("long_start"), F.coalesce(first["long_answer"]["end_token"], F.lit(-1)).alias("long_end"),
        short.alias("short"), F.lower(F.coalesce(first["yes_no_answer"], F.lit("none"))).alias("yes_no"),
    )


def read_retrieval(spark: SparkSession, path: str, positives: int = 1, negatives: int = 1, shuffle_seed: int | None = 0, multiline: bool = False) -> DataFrame:
    """Query-passage records: ``(query, passages array<struct<title, text, label, external_id>>)``, by any of the keys' names."""
    fields = ", ".join([f"{k} string" for k in QUERY_KEYS] + [f"{k} {PASSAGE}" for k in (*POSITIVE_KEYS, *NEGATIVE_KEYS)])
    raw = spark.read.schema(fields).option("multiLine", multiline).json(path)
    query = F.coalesce(*map(F.col, QUERY_KEYS))

    def marked(keys: Sequence[str], label: str, n: int, shuffled: bool):
        found = F.coalesce(*map(F.col, keys), F.array().cast(PASSAGE))
        name = lambda p: F.coalesce(p["passage_id"], F.md5(F.concat_ws("\x1f", p["title"], p["text"])))
        rows = F.transform(found, lambda p: F.struct(F.md5(F.concat(name(p), F.lit(f"-{shuffle_seed}"))).alias("h"), F.coalesce(p["title"], F.lit("")).alias("title"), p["text"].alias("text"), F.lit(label).alias("label"), name(p).alias("external_id")))
        rows = F.array_sort(rows) if shuffled else rows
        return F.transform(F.slice(rows, 1, n), lambda p: F.struct(p["title"].alias("title"), p["text"].alias("text"), p["label"].alias("label"), p["external_id"].alias("external_id")))

    passages = F.concat(marked(POSITIVE_KEYS, "positive", positives, False), marked(NEGATIVE_KEYS, "hard_negative", negatives, shuffle_seed is not None))
    return raw.select(F.regexp_replace(query, r"\?$", "").alias("query"), passages.alias("passages"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of sentences, one sentence a line, a blank line between documents: ``(file, doc, sentences)``."""
    work = _groups(numbered_lines(spark, path), path, "trim(value) = ''").where("trim(value) <> ''")
    rows = work.groupBy("file", "grp").agg(F.array_sort(F.collect_list(F.struct("block", "line_no", "value"))).alias("r"))
    return rows.select("file", F.col("grp").alias("doc"), F.transform("r", lambda x: F.trim(x["value"])).alias("sentences"))


def read_triples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated files without a header: candidates, judgements, queries, collections, runs."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def read_vectors(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Word vectors as text: the first line of a word counts, a header line and lines of another width do not."""
    lines = numbered_lines(spark, path).select("file", "block", "line_no", F.split(F.trim("value"), " ").alias("p")).where(F.size("p") == size + 1)
    rows = lines.select(F.struct("file", "block", "line_no").alias("at"), F.col("p")[0].alias("word"), F.slice("p", 2, size).cast("array<double>").alias("v"))
    return rows.groupBy("word").agg(F.min_by("v", "at").alias("v"))


def vectors_for(vocabulary: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """A vector for each ``(token, id)``; zeros for tokens without one."""
    out = vocabulary.join(vectors.withColumnRenamed("word", "token"), "token", "left")
    return out.withColumn("v", F.coalesce("v", F.array_repeat(F.lit(0.0), size)))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """One token a line; ids in the order of the lines, counted per file split so that no task holds the whole."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("m"), F.col("value").alias("token"))
    lines = lines.withColumn("part", F.shiftright("m", 33)).withColumn("at", F.col("m") - F.shiftleft("part", 33))
    starts = lines.groupBy("part").agg(F.count("*").alias("c"))
    starts = starts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return lines.join(F.broadcast(starts), "part").select("token", (F.col("at") + F.col("before")).alias("id"))  # a row per split


def verified_files(spark: SparkSession, path: str, md5: str | None = None) -> DataFrame:
    """``(path, length, md5)`` of files, and an error for one whose digest is another than the given."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"))
    if md5 is not None:
        files = files.withColumn("md5", F.when(F.col("md5") == md5, F.col("md5")).otherwise(F.raise_error(F.concat(F.lit("md5 differs: "), F.col("path")))))
    return files
