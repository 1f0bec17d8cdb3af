"""Conversation repair against a plain search over all edits, by segments of any length and on damaged rows."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from textloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, seg string"


def least(codes):
    """Cost and audit by trying every edit."""

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        ways = []
        if i == len(codes) and state in (0, 3):
            ways.append((0, ""))
        follow = "uuau"[state]
        after = {"s": 1, "u": 2, "a": 3}
        steps = []
        if i < len(codes):
            initial, fault = codes[i]
            steps.append((2, "D", i + 1, state))
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                if initial == follow or (initial == "s" and state == 0):
                    steps.append((more, "K", i + 1, after[initial]))
                steps.append((1 + more, "R", i + 1, after[follow]))
        if inserts < 3:
            steps.append((5, "I", i, after[follow]))
        for cost, letter, j, s in steps:
            c, rest = best(j, s, inserts + 1 if letter == "I" else 0)
            ways.append((c + cost, letter + rest))
        return min(ways) if ways else (10**9, "")

    return best(0, 0, 0)


def code(initial, fault):
    return chr(65 + 4 * "suax".index(initial) + ("", "truncated", "blank", "duplicate").index(fault))


def random_rows(rnd, n):
    return tuple((rnd.choice("suaauux"), rnd.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(n))


def test_least_audit():
    rnd = random.Random(1)
    for _ in range(400):
        rows = random_rows(rnd, rnd.randrange(9))
        cost, audit = least(rows)
        assert repair.repair("".join(code(*r) for r in rows)) == (audit, cost)


def test_long_conversation_is_legal():
    rows = random_rows(random.Random(2), 4000)
    codes = "".join(code(*r) for r in rows)
    audit, cost = repair.repair(codes)
    roles = [(rows[i][0] if role is None else role[:1]) if i is not None else role[0] for i, role in repair.edits(codes, audit, repair.NONE) if role != ""]
    text = "".join(roles)
    assert (text[1:] if text[:1] == "s" else text) == "ua" * (len(text) // 2) and cost > 0


def brute(rows):
    """The report of one conversation's rows ``(turn, role, text)``."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, codes = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        codes.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault))
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit = least(tuple(codes))
    lines, state, i = [], 0, 0
    for step in audit:
        follow = ("user", "user", "assistant", "user")[state]
        role = {"I": follow, "R": follow, "K": rows[i][1] if i < len(rows) else "", "D": ""}[step]
        if step != "D":
            lines.append(f"{role}:{'' if step == 'I' else rows[i][2]}")
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        i += step != "I"
    count = lambda f: sum(c[1] == f for c in codes)
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha, lines


def conversations(rnd):
    texts = ["Yes.", "No!", "What?", "cut off", "", " \n", "ends. \n", ".\x1c", "é.", "a\n", None, "long. " * 500]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rnd.randrange(9)):
            rows.append((conv, rnd.choice([turn, turn, turn * 2, None]), rnd.choice(roles), rnd.choice(texts), "clash"))
    rows += [rows[3]] * 4  # repeated rows
    return rows


@pytest.mark.parametrize("parts", [1, 5, 23])
def test_report(spark, parts):
    rnd = random.Random(5)
    rows = conversations(rnd)
    rows += [(1000, i, rnd.choice(["user", "assistant"]), rnd.choice(["a.", "b!", f"{i}?", f"{i}", ""]), "clash") for i in range(300)]  # one of most rows
    rows += [(1001, 1, "user", "same.", "clash")] * 80
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    groups = {}
    for conv, turn, role, text, _ in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = repair.report(df).collect()
        table, done = repair.repair_conversations(df)
        turns = repair.repaired_turns(table, done).orderBy("conv_id", "place").collect()
        cut = done.groupBy("conv_id").count().where("count > 1").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(groups) and (parts == 1) == (cut == 0)
    want = {conv: brute(g) for conv, g in groups.items()}
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]][:-1]
    for conv, (*_, lines) in want.items():
        assert [f"{r['role']}:{r['text']}" for r in turns if r["conv_id"] == conv] == lines


def test_damage(spark):
    rows = [(c, t, "assistant", f"a.b! {c}?", "x") for c in [*range(12), None] for t in [*range(12), None]]
    got = sorted(map(tuple, repair.damage(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    want = []
    for c, t, role, text, _ in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: text.translate({ord(x): None for x in ".!?"})}.get(fate, text)
        want += [(c, t, "user" if fate == 4 else role, text)] * (fate != 0) * (2 if fate == 3 else 1)
    assert got == sorted(want, key=repr)


def test_empty_and_null(spark):
    assert repair.report(spark.createDataFrame([], SCHEMA)).count() == 0
    r = repair.report(spark.createDataFrame([(None, None, None, None, None)], SCHEMA)).first()
    assert (r["blank"], r["audit"], r["cost"], r["gaps"]) == (1, "D", 2, 0) and r["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_query_keeps_dropped_conversations(spark, tmp_path):
    from textloom.llm.queries import op12_dial_repair

    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(conv, 0, "user", "Gone."), (None, None, "user", "b.")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in op12_dial_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {conv, None} and got[conv]["audit"] == "" and got[conv]["cost"] == 0 and got[conv]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
