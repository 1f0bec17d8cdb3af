"""N-gram Jaccard join with several global orders, and the components of its links.

A document's set holds the hashes of its distinct five-word shingles.  Under any global order of the shingles, two sets of
similarity t share an element among the first n - ceil(t n) + 1 of each.  Several orders are used: by ascending hash, by
descending hash, and by rarity.  The join runs on the prefixes of the hash order; documents whose prefixes hold an element of
many documents (a passage that many texts share) join each other on the prefixes of the rarity order instead, where such
elements come last.  Before that, documents go that share too few elements with all others together (by a longer prefix of which
several elements have to be shared).  Length and positional filters apply.  Candidates go on only if they share a prefix element under the hash
order and under its reverse as well, and are then verified on their whole sets.

Equal sets are one class, stood for by its smallest doc_id; links run between classes.  What is asked for is what is reachable, so
the documents that share a rare shingle are first compared with the smallest of them.  The components of those links are found,
and then all candidates that still lie in different components are compared.  No link that joins anything is lost, and a group
of thousands of near copies costs about one comparison each instead of one per pair.

Scale: sets are made from the texts where needed and only prefixes, narrow pairs, and the sets of candidates and of documents
with frequent elements are shuffled.  An element of a prefix is shared by at most ``COMMON`` documents or orders near copies only,
so candidates grow with the documents and not with the square of those that share a passage.  AQE divides hot joins; partial aggregation keeps a class with a third of all rows to a row a task.

Shingles are 64-bit hashes; sets count as equal by a 128-bit hash of theirs.

Defined cases: a null or wordless text has an empty set and is linked with nothing; with fewer than five words the whole
sequence is one shingle; rows without an id link with nothing and get a null component; repeated rows are one document and
come out as often as they stand; of rows of one id with different texts, the one whose set has the least hash stands for all (those
without words for none), and they share its component; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import connected_components, drop_table, grown, materialise, need, room

SHINGLE, SIMILARITY = 5, 80  # per cent
#: An element in more prefixes than this is frequent.  The value changes the speed and never the result.
COMMON = 16


class WordHashes(dict):
    """word -> 64-bit hash; a task's memory of up to 100,000 words, which goes with the task."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = h
        return h


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) == 0:
        return h
    if len(h) < SHINGLE:
        return _mix((_mix(h) * _FACTORS[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    m = len(h) - SHINGLE + 1
    total = np.zeros(m, np.uint64)
    for k in range(SHINGLE):
        total += h[k : k + m] * _FACTORS[k]
    return np.unique(_mix(total))


def _prefix(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _least_shared(n: int) -> int:
    """How many elements a set of this size has to share within extended prefixes."""
    return 1 + n // 20


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.view(np.int64)))


def _profiles(docs: DataFrame, percent: int) -> DataFrame:
    """``(d, n, c1, c2, v)``: id, size of the set, its hash, and its extended prefix in the order of hashes."""
    kind = docs.schema["d"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in it:
            n, c1, c2, prefix = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, hashes)
                n.append(len(s))
                for column, half in zip((c1, c2), _digest(s.tobytes()), strict=True):
                    column.append(half)
                prefix.append(s[: _prefix(len(s), percent) + _least_shared(len(s)) - 1])
            yield pa.RecordBatch.from_arrays([b.column("d"), *(pa.array(x, pa.int64()) for x in (n, c1, c2)), _lists(prefix)], ["d", "n", "c1", "c2", "v"])

    return docs.mapInArrow(batches, f"d {kind}, n long, c1 long, c2 long, v array<long>")


def _by_rarity(sets: DataFrame, percent: int) -> DataFrame:
    """``(d, n, v)``: the prefixes of ``sets(d, s, ws, ns)`` in the order of rarity; ``ws`` are the frequent elements, ``ns`` their counts."""
    kind = sets.schema["d"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n, prefix = [], []
            for s, ws, ns in zip(*(b.column(c).to_pylist() for c in ("s", "ws", "ns")), strict=True):
                s = np.frombuffer(s, np.uint64)
                count = np.zeros(len(s), np.int64)
                if ws:
                    count[np.searchsorted(s, np.array(ws, np.int64).view(np.uint64))] = ns
                n.append(len(s))
                prefix.append(s[np.lexsort((s, count))[: _prefix(len(s), percent)]])
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(n, pa.int64()), _lists(prefix)], ["d", "n", "v"])

    return sets.mapInArrow(batches, f"d {kind}, n long, v array<long>")


def _elements(sets: DataFrame) -> DataFrame:
    """``(d, w)`` of ``sets(d, s)``."""
    kind = sets.schema["d"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            parts = [np.frombuffer(s, np.int64) for s in b.column("s").to_pylist()]
            rows = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("d").take(pa.array(rows)), pa.array(flat)], ["d", "w"])

    return sets.select("d", "s").mapInArrow(batches, f"d {kind}, w long")


def _digest(s: bytes) -> tuple[int, int]:
    """A set's 128-bit hash as two signed numbers."""
    whole = xxhash.xxh3_128_intdigest(s)
    return (whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63)


def _sets(docs: DataFrame) -> DataFrame:
    """``(d, s)``: the set of every id; of an id's different texts that whose set has the least hash."""
    kind = docs.schema["d"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in it:
            sets = [shingles(t, hashes).tobytes() for t in b.column("text").to_pylist()]
            names = [_digest(s)[0] for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["d", "c1", "s"])

    return docs.select("d", "text").mapInArrow(batches, f"d {kind}, c1 long, s binary").groupBy("d").agg(F.min_by("s", "c1").alias("s"))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough; the prefixes of both hash orders are looked at first."""
    px, py = (_prefix(len(s), percent) for s in (x, y))
    for a, b in ((x[:px], y[:py]), (x[-px:], y[-py:])):
        if not np.isin(a, b, assume_unique=True).any():
            return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verify(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(xd, yd)`` that are links."""
    ends = pairs.select(F.col("xd").alias("d")).unionByName(pairs.select(F.col("yd").alias("d"))).distinct()
    sets = materialise(_sets(docs.join(grown(ends), "d", "left_semi")), "shingle-sets")
    both = grown(pairs).join(sets.select(F.col("d").alias("yd"), F.col("s").alias("ys")), "yd")
    both = grown(both).join(sets.select(F.col("d").alias("xd"), F.col("s").alias("xs")), "xd").select("xd", "yd", "xs", "ys")

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sides = zip(b.column("xs").to_pylist(), b.column("ys").to_pylist(), strict=True)
            ok = pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sides], pa.bool_())
            yield b.select(["xd", "yd"]).filter(ok)

    kind = docs.schema["d"].dataType.simpleString()
    links = materialise(both.mapInArrow(check, f"xd {kind}, yd {kind}"), "shingle-links")
    drop_table(sets)
    return links


def _posts(docs: DataFrame, stands: DataFrame, percent: int) -> DataFrame:
    """``(k, w, d, n, p, a)``: the prefix elements that two or more documents share, with their positions.

    First the documents that share too few elements go.  With a prefix longer by m - 1, two similar sets share m elements of
    their prefixes, where m follows the smaller set; a document whose extended prefix shares less than that with all others
    together links with nothing.  A line or passage that many documents share does not keep them in.

    k 0: under the order of hashes; a document is marked (a) if an element of its prefix is in more than ``COMMON`` prefixes.
    k 1: marked documents again, under the order of rarity among them.  Two documents of which one is not marked meet in k 0,
    two marked ones in k 1, where a shared passage is at the end of the order and only near copies still share their prefixes.
    """
    counts = stands.select(F.explode("v").alias("w")).groupBy("w").agg(F.count("*").alias("c")).where("c > 1")
    shared = materialise(stands.select("d", "n", F.posexplode("v").alias("p", "w")).join(grown(counts.select("w")), "w"), "shingle-shared")
    enough = 1 + F.floor(need(F.col("n"), percent) / 20)  # of the smallest set that can be similar
    own = F.count("*").over(Window.partitionBy("d"))  # at most the prefix of one document
    inner = shared.withColumn("m", own).where((F.col("m") >= enough) & (F.col("p") < F.col("n") - need(F.col("n"), percent) + 1)).drop("m")
    inner = materialise(inner, "shingle-prefixes")
    counts = inner.groupBy("w").agg(F.count("*").alias("c")).where("c > 1")
    plain = inner.join(grown(counts), "w")
    plain = materialise(plain.select("w", "d", "n", "p", (F.col("c") > COMMON).alias("often")), "shingle-posts")
    drop_table(shared)
    drop_table(inner)
    marked = materialise(plain.where("often").select("d").distinct(), "shingle-marked")
    sets = materialise(_sets(docs.join(grown(marked), "d", "left_semi")), "shingle-sets")
    often = materialise(_elements(sets).groupBy("w").agg(F.count("*").alias("c")).where(f"c > {COMMON}"), "shingle-common")
    own = _elements(sets).join(grown(often), "w").groupBy("d").agg(F.collect_list(F.struct("w", "c")).alias("x"))
    full = sets.join(grown(own), "d", "left").select("d", "s", F.col("x.w").alias("ws"), F.col("x.c").alias("ns"))
    rare = materialise(_by_rarity(full, percent), "shingle-rare")
    flat = rare.select("d", "n", F.posexplode("v").alias("p", "w"))
    again = rare.select(F.explode("v").alias("w")).groupBy("w").count().where("count > 1").select("w")
    second = flat.join(grown(again), "w").select(F.lit(1).alias("k"), "w", "d", "n", "p", F.lit(True).alias("a"))
    first = plain.where("NOT often").join(grown(marked.withColumn("a", F.lit(True))), "d", "left")
    first = first.select(F.lit(0).alias("k"), "w", "d", "n", "p", F.coalesce("a", F.lit(False)).alias("a"))
    out = materialise(first.unionByName(second), "shingle-posts")
    for t in (plain, marked, sets, often, rare):
        drop_table(t)
    return out


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = SIMILARITY) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row."""
    docs = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("text"))
    profiles = materialise(_profiles(docs, percent), "shingle-profiles")
    full = profiles.where("d IS NOT NULL AND n > 0")
    chosen = materialise(full.groupBy("d").agg(F.min(F.struct("c1", "c2")).alias("c")).select("d", "c.*"), "shingle-chosen")
    classes = materialise(chosen.groupBy("c1", "c2").agg(F.min("d").alias("rep")), "shingle-classes")
    stands = full.join(grown(classes.select(F.col("rep").alias("d"), "c1", "c2")), ["d", "c1", "c2"], "left_semi").dropDuplicates(["d", "c1", "c2"])
    posts = _posts(docs, stands, percent)
    x, y = (posts.select("k", "w", *[F.col(c).alias(side + c) for c in ("d", "n", "p", "a")]) for side in "xy")
    apart = ~((F.col("k") == 0) & F.col("xa") & F.col("ya"))  # those meet under the order of rarity
    hubs = y.groupBy("k", "w").agg(F.min(F.struct("yd", "yn", "yp", "ya")).alias("y")).select("k", "w", "y.*")
    pairs = x.join(grown(hubs), ["k", "w"]).where((F.col("yd") < F.col("xd")) & apart & room(percent)).select("xd", "yd").distinct()
    pairs = materialise(pairs, "shingle-pairs")
    links = _verify(pairs, docs, percent)
    part = materialise(connected_components(links.select(F.col("xd").alias("a"), F.col("yd").alias("b"))), "shingle-components")
    # what may still join two components
    known = posts.join(grown(part.withColumnRenamed("node", "d")), "d", "left").withColumn("component", F.coalesce("component", "d"))
    mixed = known.groupBy("k", "w").agg(F.min("component").alias("a1"), F.max("component").alias("a2")).where("a1 <> a2").select("k", "w")
    known = materialise(known.join(grown(mixed), ["k", "w"], "left_semi"), "shingle-posts")
    x, y = (known.select("k", "w", *[F.col(c).alias(side + c) for c in ("d", "n", "p", "a", "component")]) for side in "xy")
    other = F.col("xcomponent") != F.col("ycomponent")
    rest = x.join(grown(y), ["k", "w"]).where((F.col("yd") < F.col("xd")) & other & apart & room(percent)).select("xd", "yd").distinct()
    rest = materialise(rest.join(grown(pairs), ["xd", "yd"], "left_anti"), "shingle-pairs")
    if not rest.isEmpty():
        more = _verify(rest, docs, percent)
        every = links.unionByName(more).select(F.col("xd").alias("a"), F.col("yd").alias("b"))
        part = materialise(connected_components(every), "shingle-components")
    for t in (posts, known, pairs, rest):
        drop_table(t)
    named = classes.join(grown(part.select(F.col("node").alias("rep"), "component")), "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component"))
    out = profiles.select("d", "n").join(grown(chosen.join(grown(named), ["c1", "c2"]).select("d", "component")), "d", "left")
    component = F.coalesce("component", "d")
    return out.select(F.col("d").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))
