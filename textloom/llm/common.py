"""What the corpus operators share: words, tables cut from lineage, connected components."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six; ``bytes.split()`` splits at exactly the same ones.
WORD = r"[^\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(WORD), F.lit(False))


def need(n: Column, percent: int) -> Column:
    """ceil(percent / 100 * n)"""
    return F.floor((n * percent + 99) / 100).cast("int")


def room(percent: int) -> Column:
    """Length and positional filter: can sets x and y (sizes xn, yn) that share the element at positions xp and yp be similar enough?

    The first common element of a pair that is similar enough always passes.
    """
    x, y, xp, yp = (F.col(c) for c in ("xn", "yn", "xp", "yp"))
    most = 1 + F.least(x - xp - 1, y - yp - 1)
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & ((100 + percent) * most >= percent * (x + y))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def work_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: the session's ``spark.checkpoint.dir``.

    Only a local session (one machine, as in tests) may do without; there a folder in the warehouse takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir") + "/textloom_tables"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage: a lost executor costs only the stage that it ran, and later reads need no recomputation.  The shuffle
    files of the write are removed once it has ended, so the disk holds one step's shuffle at a time.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/textloom/" in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver free what ended steps have left (models, broadcasts, vectors) in Python and in its heap, which shrinks by that."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def grown(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the corpus: the join is a shuffled one at every size, never a broadcast."""
    return df.hint("merge")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternates the large-star and small-star steps: each node links its larger neighbours, then its smaller ones, to its
    smallest neighbour.  Edges stay as many as they were and the rounds grow with the logarithm of the longest path.  Every
    round is a written table; only its row count and a checksum of the edges come to the driver.
    """
    edges = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(grown(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(grown(least), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = materialise(small.where("u <> v").distinct(), "edges")
        drop_table(edges)
        edges = after
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"connected components: no fixed point after {max_rounds} rounds")
    nodes = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
