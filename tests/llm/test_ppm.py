"""Scores of both models against plain counts over all texts."""

import math
import zlib
from collections import Counter

import pytest

from textloom.llm import ppm
from textloom.llm.queries import QUERIES

TEXTS = [None, "", "the cat", "The cat sat on the mat\nthe end", "zzz unseen? ñandú", "x" * 3000, "the cat", "cat " * 400, "\u0085a\x1cb c"]


def brute(rows):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    train = Counter(w for i, _ in rows if not held[i] for w in words[i])
    n, v = sum(train.values()), len(train)
    trie = Counter()
    symbols = lambda w: [(b"     " + w + b" ")[j : j + 6] for j in range(len(w) + 1)] if w is not None else [b"     \n"]
    for w, c in train.items():
        for s in symbols(w):
            for k in range(6):
                trie[s[5 - k : 5], s[5]] += c

    def p(s):
        gone, left = set(), 1.0
        for k in range(5, -1, -1):
            seen = {x: trie[s[5 - k : 5], x] for x in range(256) if x not in gone and (s[5 - k : 5], x) in trie}
            total = sum(seen.values()) + len(seen)
            if s[5] in seen:
                return left * seen[s[5]] / total
            if seen:
                left *= len(seen) / total
                gone |= set(seen)
        return left / (256 - len(gone))

    cost = {w: sum(math.log10(p(s)) for s in symbols(w)) for w in {w for ws in words.values() for w in ws}}
    return [
        (i, held[i], len(words[i]), sum(train[w] > 0 for w in words[i]), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words[i]), sum(cost[w] for w in words[i]))
        for i, _ in rows
    ]


@pytest.mark.parametrize("chunk", [1 << 24, 1000])
def test_against_brute_force(spark, chunk):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, chunk string")
    got = sorted(tuple(r) for r in ppm.score_texts(df, chunk_bytes=chunk).collect())
    for a, b in zip(got, brute(rows), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_training_beats_noise_and_adaptive_learns():
    assert ppm.adaptive_log10("abc " * 50) > 5 * ppm.adaptive_log10("abc " * 5)
    assert ppm.adaptive_log10(None) == pytest.approx(-math.log10(256))


def test_no_rows(spark):
    assert ppm.score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_whole(rows):
    """The model's scores with contexts over the whole text."""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    streams = {i: b"     " + b" ".join([*(t or "").encode().lower().split(), b""]) + b"\n" for i, t in rows}
    symbols = {i: [s[j : j + 6] for j in range(len(s) - 5)] for i, s in streams.items()}
    seen = [{} for _ in range(6)]
    for i, _ in rows:
        for s in symbols[i] if not held[i] else []:
            for k in range(6):
                c = seen[k].setdefault(s[5 - k : 5], Counter())
                c[s[5]] += 1

    def log(s):
        gone, left = set(), 0.0
        for k in range(5, -1, -1):
            fresh = {x: n for x, n in seen[k].get(s[5 - k : 5], {}).items() if x not in gone}
            if s[5] in fresh:
                return left + math.log10(fresh[s[5]] / (sum(fresh.values()) + len(fresh)))
            if fresh:
                left += math.log10(len(fresh) / (sum(fresh.values()) + len(fresh)))
                gone |= set(fresh)
        return left - math.log10(256 - len(gone))

    return {i: sum(map(log, s)) for i, s in symbols.items()}


@pytest.mark.parametrize("chunk", [1 << 24, 1000])
def test_whole_text_contexts_against_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(ppm, "STEP", 500)
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in ppm.score_texts(df, chunk_bytes=chunk, contexts="text").collect()}
    want = brute_whole(rows)
    for i, held, n, known, train, base, _ in brute(rows):
        assert tuple(got[i])[:5] == (i, held, n, known, train)
        assert (got[i]["base_score"], got[i]["score"]) == pytest.approx((base, want[i]), rel=1e-9)


def test_query_sees_the_order_of_words(spark, tmp_path):
    fluent = "the cat sat on the mat and the dog lay by the door"
    salad = "door mat the the dog sat and on by lay the the cat"
    rows = [(i, fluent) for i in range(20)] + [(100, salad)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op9_ppm"](spark, str(tmp_path)).collect()}
    assert got[100]["base_score"] == pytest.approx(got[0]["base_score"])
    assert got[100]["score"] < 2 * got[0]["score"]
