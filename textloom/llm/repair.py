"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

A conversation is a list of rows (role, text) in order of turn.  Legal role initials are ``(s?(ua)+)?``.  A row may be kept (cost 0), given
the other of the roles user and assistant (1) or deleted (2); a row without a visible character and a repetition of an earlier row
have to be deleted; an empty row of user or assistant may be inserted anywhere (5); a truncated row that stays adds 5.

The edits are a path: nodes are (rows done, last role), arcs the edits, costs the integers 0 to 6.  Distances to the end come from
shortest paths in Dial's manner: nodes wait in a ring of buckets, one for each open distance, and the ring turns from cost to cost, so there
is no heap and no comparison.  From the start, the walk follows at each node the tight arc (distance here = cost + distance there)
with the ASCII-least letter of Delete, Insert, Keep, Rerole.  A node has one arc of each letter, hence the audit is the least one.

Scale: rows are shuffled once by ranges of their order, down to the single row, so a conversation of a third of all rows is cut in
segments.  The order has at most 16 characters of a role and 64 of a text in it, so the bounds of ranges stay small.  A segment becomes a string, one letter a row.  For each last role before and after a segment one search gives the cheapest
cost through it; these 4 x 4 costs of a conversation's segments are joined backwards to the distances at their ends, each segment
walks from each of its four entries, and a pass forwards picks the walks that meet.  So no task holds more of a conversation than a
segment's letters and 16 numbers a segment, but for its audit, which is one cell of the result.  First rows of repeated ones come from a
partial aggregation and a join on the number of the row.  ``repaired_turns`` gives the rows after repair, segment by segment.
A digest of a whole conversation can only be taken in order: ``digests`` streams its rows through one task and holds none of them.

Defined cases: rows are ordered by turn (null first), then role and text by their first 16 and 64 characters, then by a digest of both; null roles and texts count as one space, and a null id or turn as
one space in the damage; rows without an id are one conversation; roles that begin with none of s, u, a are never legal as they are;
repeated rows are duplicates but for the first; a conversation of which no row is left has an empty audit and zeros; an empty table
gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import grown, materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Last role so far: none, system, user, assistant.  The conversation may end after none or assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The role that has to follow each state, as user or assistant, which an insertion or a new role gives.
FOLLOWS = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Above all costs of a segment.
FAR = 1 << 60
#: The ring has a bucket for each distance that may be open at a time.
RING = max(REROLE + TRUNCATED, INSERT) + 1


def letter(initial: Column, fault: Column) -> Column:
    """A row as one of sixteen letters from A: initial (s, u, a, other) * 4 + fault (none, truncated, blank, duplicate)."""
    at = F.when(initial == "", 3).otherwise((F.instr(F.lit("sua"), initial) + 3) % 4)
    return F.char((65 + 4 * at + fault).cast("long"))


@lru_cache(maxsize=None)
def arcs(code: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """The edits of a row in a state, in order of letters: (letter, cost, next state).  Insertions are not among them."""
    initial, fault = divmod(ord(code) - 65, 4)
    out = [("D", DELETE, state)]
    if fault < 2:
        more = TRUNCATED * fault
        after = FOLLOWS[state]
        if initial == 0 and state == NONE:
            out.append(("K", KEEP + more, SYSTEM))
        elif initial == after - 1:
            out.append(("K", KEEP + more, after))
        out.append(("R", REROLE + more, after))
    return tuple(out)


@lru_cache(maxsize=None)
def incoming(code: str) -> tuple[tuple[tuple[int, int], ...], ...]:
    """For each state after a row, the states before it and the least costs."""
    into: list[dict[int, int]] = [{}, {}, {}, {}]
    for state in range(4):
        for _, cost, after in arcs(code, state):
            into[after][state] = min(cost, into[after].get(state, FAR))
    return tuple(tuple(x.items()) for x in into)


def distances(codes: str, ends: list[int], last: bool) -> list[list[int]]:
    """The cheapest cost from each node (rows done, state) to the end of a segment.

    ``ends`` are the costs from there on; insertions after the last row belong to the next segment, but for the ``last`` one.
    """
    n = len(codes)
    back = [incoming(c) for c in codes]
    dist = [[FAR] * 4 for _ in range(n + 1)]
    done = [[False] * 4 for _ in range(n + 1)]
    ring: list[list[tuple[int, int]]] = [[] for _ in range(RING)]
    waiting = sorted((d, s) for s, d in enumerate(ends) if d < FAR)  # at most four, fed in as the ring comes to them
    now, held = (waiting[0][0] if waiting else 0), 0
    while waiting or held:
        if not held:
            now = max(now, waiting[0][0])
        while waiting and waiting[0][0] == now:
            _, s = waiting.pop(0)
            if now < dist[n][s]:
                dist[n][s] = now
                ring[now % RING].append((n, s))
                held += 1
        bucket = ring[now % RING]
        while bucket:
            i, s = bucket.pop()
            held -= 1
            if done[i][s]:
                continue
            done[i][s] = True
            if i < n or last:
                for before in range(4):
                    if FOLLOWS[before] == s and now + INSERT < dist[i][before]:
                        dist[i][before] = now + INSERT
                        ring[(now + INSERT) % RING].append((i, before))
                        held += 1
            if i:
                for before, cost in back[i - 1][s]:
                    if now + cost < dist[i - 1][before]:
                        dist[i - 1][before] = now + cost
                        ring[(now + cost) % RING].append((i - 1, before))
                        held += 1
        now += 1
    return dist


def walk(codes: str, dist: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """The least audit of a segment from a state on, and the state after it."""
    out, i, n = [], 0, len(codes)
    while True:
        here = dist[i][state]
        best = None
        if i < n:
            tight = [a for a in arcs(codes[i], state) if dist[i + 1][a[2]] < FAR and a[1] + dist[i + 1][a[2]] == here]
            best = tight[0] if tight else None  # in order of letters
        after = FOLLOWS[state]
        insert = (i < n or last) and dist[i][after] < FAR and INSERT + dist[i][after] == here
        if insert and (best is None or best[0] > "I"):
            out.append("I")
            state = after
        elif best is not None:
            out.append(best[0])
            state, i = best[2], i + 1
        else:
            return "".join(out), state


@lru_cache(maxsize=20_000)
def through(codes: str) -> tuple[int, ...]:
    """The cheapest cost from each state before a segment that is not the last to each state after it; row by row."""
    columns = [distances(codes, [0 if s == end else FAR for s in range(4)], False)[0] for end in range(4)]
    return tuple(columns[end][start] for start in range(4) for end in range(4))


@lru_cache(maxsize=20_000)
def walks(codes: str, ends: tuple[int, ...], last: bool) -> tuple[tuple[str, ...], tuple[int, ...], tuple[int, ...]]:
    """Audit, state after and cost of a segment for each state before it."""
    dist = distances(codes, list(ends), last)
    found = [walk(codes, dist, s, last) if dist[0][s] < FAR else ("", s) for s in range(4)]
    return tuple(a for a, _ in found), tuple(s for _, s in found), tuple(dist[0])


#: What is left to pay after the last row of a conversation, before insertions.
END = (0, FAR, FAR, 0)


def repair(codes: str) -> tuple[str, int]:
    """The audit of a whole conversation, and its cost."""
    audits, _, costs = walks(codes, END, True)
    return audits[NONE], costs[NONE]


def edits(codes: str, audit: str, state: int) -> Iterator[tuple[int | None, str | None]]:
    """(row, new role or None) of every row that stays, (None, role) of every inserted one, in order; deleted rows are (row, "")."""
    i = 0
    for step in audit:
        after = FOLLOWS[state]
        if step == "I":
            yield None, NAMES[after]
        elif step == "D":
            yield i, ""
        elif step == "R":
            yield i, NAMES[after]
        else:
            yield i, None
            after = SYSTEM if codes[i] < "E" else after
        if step != "D":
            state = after
        i += step != "I"


# the rows


def damage(rows: DataFrame) -> DataFrame:
    """The rows ``conv_id, turn, role, text`` damaged by the checksum of their id and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    df = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    df = df.where("fate <> 0").select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fate")
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return df.withColumn("copy", copies).drop("fate", "copy")


def ordered(rows: DataFrame) -> DataFrame:
    """The rows with ``at``, a number that rises within a conversation in order of turn, and ``seg``, the segment; a written table."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    slim = rows.select("conv_id", "turn", space("role"), space("text"))
    ties = {"r0": F.substring("role", 1, 16), "t0": F.substring("text", 1, 64), "m": F.md5(F.concat_ws(":", "role", "text")), "r": F.monotonically_increasing_id()}
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", *ties)]
    slim = slim.withColumns(ties).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop(*ties)
    return materialise(slim.withColumns({"at": F.monotonically_increasing_id(), "seg": F.spark_partition_id()}), "repair-rows")


def segments(rows: DataFrame) -> DataFrame:
    """``conv_id, seg, start, codes`` of the rows of :func:`ordered`."""
    seen = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    small = rows.select("conv_id", "seg", "at", seen.alias("seen"), F.substring("role", 1, 1).alias("initial"), "text")
    firsts = small.groupBy("conv_id", "seen").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    text = F.col("text")
    # Java's \z and not $, which may stand before a line end
    own = F.when(~text.rlike(r"[^\x20\x09-\x0D]"), 2).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), 1).otherwise(0)
    flat = small.select("conv_id", "seg", "at", "initial", own.alias("own")).join(grown(firsts), "at", "left")
    fault = F.when(F.col("own") == 2, 2).when(F.col("first").isNull(), 3).otherwise(F.col("own"))
    flat = flat.select("conv_id", "seg", "at", letter(F.col("initial"), fault).alias("code"))
    lists = flat.groupBy("conv_id", "seg").agg(F.min("at").alias("start"), F.array_sort(F.collect_list(F.struct("at", "code"))).alias("c"))
    return lists.select("conv_id", "seg", "start", F.array_join(F.col("c.code"), "").alias("codes"))


def _same(a: DataFrame, b: DataFrame, *more: str) -> Column:
    """Equal ids (null with null) and equal further columns."""
    on = a["conv_id"].eqNullSafe(b["conv_id"])
    for c in more:
        on = on & (a[c] == b[c])
    return on


def audited(segs: DataFrame) -> DataFrame:
    """``conv_id, seg, start, codes, entry, piece, cost``: the state before each segment, its part of the audit and the cost from it on."""
    kind = segs.schema["conv_id"].dataType.simpleString()

    def costs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = pa.array([through(c) for c in b.column("codes").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("seg"), found], ["conv_id", "seg", "costs"])

    def backwards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, segs_, ends, lasts = [], [], [], []
            for i, found in enumerate(b.column("found").to_pylist()):
                left = list(END)
                for at, x in enumerate(sorted(found, key=lambda x: -x["seg"])):
                    rows.append(i)
                    segs_.append(x["seg"])
                    ends.append(left)
                    lasts.append(at == 0)
                    if at == 0:  # the last segment: its insertions at the end come first
                        left = [min(FAR, *(_after_inserts(s, e) + left[e] for e in range(4))) for s in range(4)]
                    c = x["costs"]
                    left = [min(FAR, *(c[4 * s + e] + left[e] for e in range(4))) for s in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id").take(pa.array(rows, pa.int64())), pa.array(segs_, pa.int32()), pa.array(ends, pa.list_(pa.int64())), pa.array(lasts, pa.bool_())],
                ["conv_id", "seg", "ends", "last"],
            )

    def walked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [walks(c, tuple(e), x) for c, e, x in zip(*(b.column(n).to_pylist() for n in ("codes", "ends", "last")), strict=True)]
            cols = [pa.array([f[k] for f in found], pa.list_(t)) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("conv_id", "seg", "start", "codes")), *cols], ["conv_id", "seg", "start", "codes", "pieces", "exits", "costs"])

    def forwards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, segs_, entries = [], [], []
            for i, found in enumerate(b.column("found").to_pylist()):
                state = NONE
                for x in sorted(found, key=lambda x: x["seg"]):
                    rows.append(i)
                    segs_.append(x["seg"])
                    entries.append(state)
                    state = x["exits"][state]
            yield pa.RecordBatch.from_arrays([b.column("conv_id").take(pa.array(rows, pa.int64())), pa.array(segs_, pa.int32()), pa.array(entries, pa.int32())], ["conv_id", "seg", "entry"])

    gather = lambda df, c: df.groupBy("conv_id").agg(F.collect_list(F.struct("seg", c)).alias("found"))
    priced = segs.select("conv_id", "seg", "codes").mapInArrow(costs, f"conv_id {kind}, seg int, costs array<long>")
    ends = gather(priced, "costs").mapInArrow(backwards, f"conv_id {kind}, seg int, ends array<long>, last boolean")
    met = segs.join(grown(ends), _same(segs, ends, "seg")).select(segs["conv_id"], segs["seg"], "start", "codes", "ends", "last")
    done = materialise(met.mapInArrow(walked, f"conv_id {kind}, seg int, start long, codes string, pieces array<string>, exits array<int>, costs array<long>"), "repair-walks")
    entries = gather(done, "exits").mapInArrow(forwards, f"conv_id {kind}, seg int, entry int")
    out = done.join(grown(entries), _same(done, entries, "seg"))
    pick = lambda c: F.element_at(c, F.col("entry") + 1)
    return out.select(done["conv_id"], done["seg"], "start", "codes", "entry", pick("pieces").alias("piece"), pick("costs").alias("cost"))


def _after_inserts(state: int, end: int) -> int:
    """The cost of getting from a state to another by insertions alone."""
    cost = 0
    while state != end:
        if cost > 3 * INSERT:
            return FAR
        state, cost = FOLLOWS[state], cost + INSERT
    return cost


def summaries(segs: DataFrame, rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation with a row."""
    turns = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    codes = F.col("codes")
    roles = F.translate(codes, "ABCDEFGHIJKLMNOP", "ssssuuuuaaaaxxxx")
    count = lambda letters: (F.length(codes) - F.length(F.translate(codes, letters, ""))).cast("long")
    # every legal pair of neighbours, whether it overlaps another or not
    legal = F.regexp_count(roles, F.lit("(?=su|ua|au)."))
    each = segs.select(
        "conv_id", "seg", "piece", "cost", (F.length(codes) - 1 - legal).cast("long").alias("illegal"), F.substring(roles, 1, 1).alias("head"), F.substring(roles, -1, 1).alias("tail"),
        count("CGKO").alias("blank"), count("DHLP").alias("duplicate"), count("BFJN").alias("truncated"),
    )
    parts = F.array_sort(F.collect_list(F.struct("seg", "piece", "cost", "head", "tail"))).alias("parts")
    whole = each.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], parts)
    joints = F.arrays_zip(F.slice("parts.tail", 1, F.size("parts") - 1).alias("x"), F.slice("parts.head", 2, F.size("parts") - 1).alias("y"))
    more = F.size(F.filter(joints, lambda j: ~F.concat(j["x"], j["y"]).isin("su", "ua", "au"))).cast("long")
    whole = whole.select(
        "conv_id", "blank", "duplicate", "truncated", (F.col("illegal") + more).alias("illegal"),
        F.col("parts")[0]["cost"].alias("cost"), F.array_join(F.col("parts.piece"), "").alias("audit"),
    )
    return whole.join(grown(turns), _same(whole, turns)).select(turns["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _mixed(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The edits of each segment and its rows, the edits first."""
    plan = done.select("conv_id", "seg", F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"), "codes", "piece", "entry")
    own = rows.select("conv_id", "seg", "at", F.lit(1).alias("kind"), "role", "text", F.lit("").alias("codes"), F.lit("").alias("piece"), F.lit(0).alias("entry"))
    return plan.unionByName(own)


def _lines(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, str, str]]:
    """(conversation, number of the row or of the one before it, role, text) after repair, from the sorted rows of :func:`_mixed`."""
    steps: Iterator[tuple[int | None, str | None]] = iter(())

    def inserted(steps: Iterator, conv: object, at: int) -> Iterator[tuple[object, int, str, str]]:
        """The insertions before the next row, which then waits in ``held``."""
        for row, role in steps:
            if row is not None:
                held.append(role)
                return
            yield conv, at, role, ""

    held: list[str | None] = []
    for b in it:
        for conv, at, kind, role, text, codes, piece, entry in zip(*(b.column(n).to_pylist() for n in ("conv_id", "at", "kind", "role", "text", "codes", "piece", "entry")), strict=True):
            if kind == 0:
                steps = edits(codes, piece, entry)
                yield from inserted(steps, conv, at)
                continue
            new = held.pop()
            if new != "":
                yield conv, at, role if new is None else new, text
            yield from inserted(steps, conv, at)


def repaired_turns(rows: DataFrame, done: DataFrame) -> DataFrame:
    """``conv_id, place, role, text`` of the rows after repair; ``place`` gives their order in a conversation.

    ``rows`` are those of :func:`ordered`, ``done`` the segments of :func:`audited`.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    mixed = _mixed(rows, done).repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "at", "kind")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = [None, pa.int64(), pa.int64(), pa.string(), pa.string()]
        lines = enumerate(_lines(_typed(it, types)))
        while held := [(conv, at, n, role, text) for n, (conv, at, role, text) in islice(lines, 1000)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], ["conv_id", "at", "n", "role", "text"])

    out = mixed.mapInArrow(batches, f"conv_id {kind}, at long, n long, role string, text string")
    return out.select("conv_id", F.struct("at", "n").alias("place"), "role", "text")


def _typed(it: Iterator[pa.RecordBatch], types: list) -> Iterator[pa.RecordBatch]:
    for b in it:
        types[0] = b.schema.field("conv_id").type
        yield b


def digests(rows: DataFrame, done: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` over the repaired ``role:text``, joined by line ends, of conversations of which a row stays."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    mixed = _mixed(rows, done).repartition("conv_id").sortWithinPartitions("conv_id", "seg", "at", "kind")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = [None]
        whole = groupby(_lines(_typed(it, types)), key=lambda x: x[0])
        while found := [(conv, _sha(lines)) for conv, lines in islice(whole, 1000)]:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], types[0]), pa.array([h for _, h in found])], ["conv_id", "repaired_sha256"])

    return mixed.mapInArrow(batches, f"conv_id {kind}, repaired_sha256 string")


def _sha(lines: Iterator[tuple[object, int, str, str]]) -> str:
    state, between = hashlib.sha256(), ""
    for _, _, role, text in lines:
        state.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
        between = "\n"
    return state.hexdigest()


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ordered rows of ``rows(conv_id, turn, role, text)`` and their audited segments, for the functions above."""
    table = ordered(rows)
    return table, audited(materialise(segments(table), "repair-segments"))


def report(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation with a row."""
    table, done = repair_conversations(rows)
    found, hashes = summaries(done, table), digests(table, done)
    out = found.join(grown(hashes), _same(found, hashes), "left")
    return out.select(found["*"], F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
