"""Near-duplicate lines by an exact set-similarity join; later matches go (DataFrame functions only).

A line's set is its distinct words.  Words are ordered by rarity and a line of n words keeps the p = n - ceil(t n) + 1 rarest: two
lines of Jaccard similarity t or more share one of those.  Lines that share one are candidates if their lengths and the
positions of the shared word leave room for enough common words and if their bitmaps do not differ in too many bits (every word
that only one of two lines has flips one of 64 bits), and are then verified on their whole sets.  A line goes if an
earlier line (by doc_id, then line number) of the input is equal or similar; each line is judged on the input, not on what is left.

A word that stands in more than ``OFTEN`` prefixes is too common to be a key by itself, and is taken together with the size of
the line's set, in classes of which similar lines share one.  Two lines that have to share two words
share two of their p + 1 rarest, so such words are paired with each later one; pairs that are still too common take a third word.
Only lines under a common key of ``LEVELS`` words (or of all the words they have to share) are left, which means families of
variants of one line: each line there is compared with the earliest one, and only those that find no match by that or by another
key are compared with all earlier ones of their family.

Scale: lines of equal sets are grouped first, with partial minima, so a line that a third of the documents hold is one row a
task.  Rarity is a table of ``BUCKETS`` counts over all words (a fixed size), by which any two tasks order words alike; how well
it tells rare from frequent words changes the speed and never the result.  A key outside families brings at most ``OFTEN`` lines together,
so candidates grow with the lines.  Joins are on keys or lines, with AQE dividing hot ones.

Words are 64-bit values: 7 bits of rarity (less 64, as they are ordered with their sign) and 57 of hash; sets count as equal
by two 64-bit hashes of their values.

Defined cases: a null text stays null and has no lines; an empty text stays, and so do lines without a word; rows without an id
are left as they are and remove nothing; equal rows are one document, whose lines do not remove each other; rows of one id with
different texts are different documents, in the order of a hash of the text; an empty table gives an empty result.  Extra
columns pass through, whatever their names; only ``n_lines`` and ``n_removed`` are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import drop_table, free_names, materialise, need

BUCKETS, SIMILARITY = 1 << 22, 80  # per cent
#: A key of more lines than this is common, and one of up to so many words is lengthened.  The values change the speed and never the result.
OFTEN, LEVELS = 1024, 3
#: A key of more than this part of a level's rows is hot; there are fewer such keys than this.
HEAVY = 4096
SPACE_RUN = r"[\x20\x09-\x0D]+"
LINE = ["d", "i"]
PAIR = ["xd", "xi", "yd", "yi"]


def _base(text: Column) -> Column:
    """The number of a text's line 0: rows of one id with different texts have different lines."""
    return F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit(0x3FFFFFFF).cast("long")), 32)


def _lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    return rows.select("d", _base(F.col("t")).alias("base"), F.posexplode(F.split("t", "\n")).alias("i", "line")).select("d", (F.col("base") + F.col("i")).alias("i"), "line")


def _words(text: Column) -> Column:
    """The words of a text and perhaps empty strings; texts with no space but blanks take the faster way."""
    other = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in "\t\n\x0b\x0c\r"])
    return F.when(other, F.split(text, SPACE_RUN)).otherwise(F.split(text, " "))


def rarity(docs: DataFrame, text: str) -> bytes:
    """For each of ``BUCKETS`` hash buckets of words a class of 0 to 127 by the count of its words in all texts."""
    words = docs.select(F.explode(_words(F.replace(F.col(text), F.lit("\n"), F.lit(" ")))).alias("w"))
    counts = words.groupBy(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")).count()
    rare = F.least(F.lit(127), 1 + F.floor(3 * F.log2("count")))
    table = np.zeros(BUCKETS, np.int8)
    for batch in counts.select("b", rare.cast("byte").alias("r")).toArrow().to_batches():  # at most BUCKETS rows
        table[batch.column("b").to_numpy()] = batch.column("r").to_numpy()
    return table.tobytes()


def _classes(table: bytes) -> Column:
    """The table as a value that a query looks up once: a literal of its size would stand in every text of a plan that the driver keeps."""
    classes = pa.ListArray.from_arrays([0, len(table)], pa.Array.from_buffers(pa.int8(), len(table), [None, pa.py_buffer(table)]))
    return SparkSession.active().createDataFrame(pa.table({"classes": classes})).scalar()


def _values(line: Column, table: Column | bytes) -> Column:
    """A line's words as 64-bit values, rarest first; ``table`` is a column with the classes, or the classes as a literal."""
    classes = F.split(F.lit(",".join(map(str, table))), ",").cast("array<tinyint>") if isinstance(table, bytes) else table

    def value(w: Column) -> Column:
        h = F.xxhash64(w)
        rare = classes[F.pmod(h, F.lit(BUCKETS)).cast("int")]
        return F.shiftleft(rare.cast("long") - 64, 57) + F.shiftrightunsigned(h, 7)

    return F.sort_array(F.array_distinct(F.transform(F.array_remove(_words(line), ""), value)))


def _valued(lines: DataFrame, table: bytes) -> DataFrame:
    """``lines(d, i, line)`` as ``(d, i, v)``.  The first step is only a name: functions of words may not hold queries, and Spark puts both steps together."""
    return lines.select("d", "i", "line", _classes(table).alias("classes")).select("d", "i", _values(F.col("line"), F.col("classes")).alias("v"))


def _bitmap(v: Column) -> Column:
    """64 parity bits of the values."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return F.aggregate(v, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(bit(x)))


def _prefix(percent: int) -> Column:
    return F.col("n") - need(F.col("n"), percent) + 1


def _by_size(keys: DataFrame, percent: int) -> DataFrame:
    """The rows with each key taken together with two neighbouring classes of sizes; lines that are similar share one.

    Sizes that can be similar are of the same class or of neighbouring ones, as a class is a little wider than they may differ.
    """
    size = F.floor(F.log("n") / math.log(100 / percent * (1 + 1e-9)))
    keys = keys.withColumn("size", F.explode(F.array(size, size + 1)))
    return keys.select(F.xxhash64("k", "size").alias("k"), *[c for c in keys.columns if c not in ("k", "size")])


def _alike(percent: int) -> Column:
    """Order, length, positional and bitmap filter of lines x and y that share the words of a key (``m``, the last at ``q``)."""
    x, y = F.col("xn"), F.col("yn")
    most = F.col("xm") + F.least(x - F.col("xq") - 1, y - F.col("yq") - 1)
    bits = F.bit_count(F.col("xb").bitwiseXOR(F.col("yb")))
    earlier = (F.col("yd") < F.col("xd")) | ((F.col("yd") == F.col("xd")) & (F.col("yi") < F.col("xi")))
    return (
        earlier
        & (100 * F.least(x, y) >= percent * F.greatest(x, y))
        & ((100 + percent) * most >= percent * (x + y))
        & (bits * (100 + percent) <= (x + y) * (100 - percent))
    )


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("k", *[F.col(c).alias(side + c) for c in ("d", "i", "n", "b", "m", "q")])


def _verify(pairs: DataFrame, docs: DataFrame, text: str, doc_id: str, table: bytes, percent: int) -> DataFrame:
    """The lines ``(xd, xi)`` of ``pairs(xd, xi, yd, yi)`` that are similar to their y."""
    ends = pairs.select(F.col("xd").alias("d"), F.col("xi").alias("i")).unionByName(pairs.select(F.col("yd").alias("d"), F.col("yi").alias("i"))).distinct()
    wanted = ends.groupBy("d").agg(F.collect_set("i").alias("wanted"))
    held = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t")).join(wanted, "d")
    held = held.select("d", _base(F.col("t")).alias("base"), "wanted", F.posexplode(F.split("t", "\n")).alias("i", "line")).withColumn("i", F.col("base") + F.col("i"))
    held = held.where(F.array_contains("wanted", F.col("i")))
    sets = materialise(_valued(held, table).dropDuplicates(LINE), "line-sets")
    both = pairs.join(sets.select(F.col("d").alias("xd"), F.col("i").alias("xi"), F.col("v").alias("xv")), ["xd", "xi"])
    both = both.join(sets.select(F.col("d").alias("yd"), F.col("i").alias("yi"), F.col("v").alias("yv")), ["yd", "yi"])
    common = F.size(F.array_intersect("xv", "yv"))
    found = both.where(100 * common >= percent * (F.size("xv") + F.size("yv") - common)).select("xd", "xi").distinct()
    found = materialise(found, "line-matches")
    drop_table(sets)
    return found


def _similar(classes: DataFrame, docs: DataFrame, text: str, doc_id: str, table: bytes, percent: int) -> DataFrame:
    """The lines ``(xd, xi)`` of ``classes(d, i, n, b, v)`` that are similar to an earlier one."""
    columns = ["k", "d", "i", "n", "b", "m", "q"]
    keys = classes.select("d", "i", "n", "b", F.lit(1).alias("m"), F.posexplode(F.slice("v", F.lit(1), _prefix(percent))).alias("q", "k")).select(*columns)
    tables, few, left = [], [], []
    steps = [1, *range(2, LEVELS + 2)]  # the first lengthens common words by the lines' sizes
    for at, m in enumerate(steps):
        counts = materialise(keys.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "line-key-counts")
        rows, common, most = counts.agg(F.sum("c"), F.count_if(F.col("c") > OFTEN), F.max("c")).first()
        limit = max(OFTEN, (rows or 0) // HEAVY)
        light, hot = keys, []
        if most and most > limit:  # such keys go another way before anything is dealt by key
            heavy = F.broadcast(counts.where(F.col("c") > limit).select("k"))  # fewer than HEAVY rows
            light, hot = keys.join(heavy, "k", "left_anti"), [keys.join(heavy, "k", "left_semi")]
        few.append(light.join(counts.where(F.col("c") <= OFTEN).select("k"), "k"))
        tables.append(counts)
        if not common:
            break
        hot.append(light.join(counts.where((F.col("c") > OFTEN) & (F.col("c") <= limit)).select("k"), "k", "left_semi"))
        hot = materialise(reduce(DataFrame.unionByName, hot).select(*columns), "line-keys")
        tables.append(hot)
        if m > LEVELS:
            left.append(hot)
            break
        if not at:
            keys = _by_size(hot, percent)
            continue
        left.append(hot.where(need(F.col("n"), percent) < m))  # two such lines need not share more words than they do
        spots = hot.groupBy(*LINE).agg(F.collect_list(F.struct("k", "q")).alias("spots"))
        rows = materialise(classes.join(spots, LINE), "line-rows")
        tables.append(rows)
        end = F.least(F.size("v"), _prefix(percent) + m - 1)
        rows = rows.select("d", "i", "n", "b", "v", F.explode("spots").alias("s")).where(F.col("s.q") + 1 < end)
        rows = rows.select("*", F.explode(F.sequence(F.col("s.q") + 1, end - 1)).alias("at"))
        keys = rows.select(F.xxhash64("s.k", F.get("v", F.col("at"))).alias("k"), "d", "i", "n", "b", F.lit(m).alias("m"), F.col("at").alias("q"))
    none = classes.where("false").select(F.lit(0).cast("long").alias("k"), "d", "i", "n", "b", F.lit(1).alias("m"), F.lit(0).alias("q"))
    families = reduce(DataFrame.unionByName, left, none)
    hubs = families.groupBy("k").agg(F.min(F.struct("d", "i", "n", "b", "m", "q")).alias("y")).select("k", "y.*")
    near = [_side(x, "x").join(_side(x, "y"), "k") for x in few] + ([_side(families, "x").join(_side(hubs, "y"), "k")] if left else [])
    apart = F.bit_count(F.col("xb").bitwiseXOR(F.col("yb"))).alias("apart")
    pairs = materialise(reduce(DataFrame.unionByName, [x.where(_alike(percent)).select(*PAIR, apart) for x in near]).distinct(), "line-pairs")
    # one match is enough, so the likeliest candidate of each line goes first
    likely = materialise(pairs.groupBy("xd", "xi").agg(F.min(F.struct("apart", "yd", "yi")).alias("y")).select("xd", "xi", "y.yd", "y.yi"), "line-likely")
    settled = _verify(likely, docs, text, doc_id, table, percent)
    others = materialise(pairs.select(*PAIR).join(settled, ["xd", "xi"], "left_anti").join(likely, PAIR, "left_anti"), "line-pairs")
    if not others.isEmpty():
        settled = settled.unionByName(_verify(others, docs, text, doc_id, table, percent))
    tables += [pairs, likely, others]
    if left:
        rest = _side(families, "x").join(settled, ["xd", "xi"], "left_anti").join(_side(families, "y"), "k").where(_alike(percent))
        rest = materialise(rest.select(*PAIR).distinct().join(pairs, PAIR, "left_anti"), "line-pairs")
        if not rest.isEmpty():
            settled = settled.unionByName(_verify(rest, docs, text, doc_id, table, percent))
        tables.append(rest)
    for t in tables:
        drop_table(t)
    return settled


def later_matches(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = SIMILARITY) -> DataFrame:
    """``(d, gone)``: the numbers of each document's lines that have an earlier match (``_base`` of the text is its first)."""
    table = rarity(docs, text)
    lines = _valued(_lines(docs, text, doc_id), table).withColumn("n", F.size("v"))
    first = F.slice("v", F.lit(1), F.least(F.col("n"), _prefix(percent) + LEVELS - 1))
    # lines without words go afterwards: a filter here would be pushed down and make every set twice
    marks = materialise(lines.select("d", "i", "n", F.xxhash64("v").alias("s1"), F.xxhash64("v", F.lit(7)).alias("s2"), _bitmap(F.col("v")).alias("b"), first.alias("v")), "lines")
    marks = marks.where("n > 0")
    classes = marks.groupBy("s1", "s2").agg(F.min(F.struct("d", "i", "n", "b", "v")).alias("f"), F.count("*").alias("c"))
    classes = materialise(classes.select("s1", "s2", "c", "f.*"), "line-classes")
    several = classes.where("c > 1").select("s1", "s2", F.col("d").alias("fd"), F.col("i").alias("fi"))
    copies = marks.select("d", "i", "s1", "s2").join(several, ["s1", "s2"]).where((F.col("fd") != F.col("d")) | (F.col("fi") != F.col("i")))
    copies = materialise(copies.select("d", "i"), "line-copies")
    drop_table(marks)
    similar = _similar(classes.select("d", "i", "n", "b", "v"), docs, text, doc_id, table, percent)
    gone = copies.unionByName(similar.select(F.col("xd").alias("d"), F.col("xi").alias("i")))
    out = materialise(gone.groupBy("d").agg(F.collect_set("i").alias("gone")), "lines-gone")
    for t in (copies, classes, similar):
        drop_table(t)
    return out


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = SIMILARITY) -> DataFrame:
    """``docs`` with the lines that have an earlier match taken from ``text``, plus ``n_lines`` (before) and ``n_removed``."""
    docs = docs.drop("n_lines", "n_removed")
    d, gone, base, lines = free_names(docs, "d", "gone", "base", "lines")
    matches = later_matches(docs, text, doc_id, percent).select(F.col("d").alias(d), F.col("gone").alias(gone))
    out = docs.join(matches, F.col(doc_id) == F.col(d), "left").withColumns({base: _base(F.col(text)), lines: F.split(F.col(text), "\n")})
    goes = lambda i: F.coalesce(F.array_contains(gone, F.col(base) + i), F.lit(False))
    kept = F.array_join(F.filter(lines, lambda _, i: ~goes(i)), "\n")
    size = F.size(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), goes))
    return out.select(
        *[c for c in docs.columns if c != text],
        F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept).alias(text),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.when(F.col(gone).isNull() | F.col(text).isNull(), 0).otherwise(size).alias("n_removed"),
    )
