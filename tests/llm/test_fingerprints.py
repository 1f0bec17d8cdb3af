"""Bloom lookup sketches against plain multisets of paragraphs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from textloom.llm import fingerprints as fp


def sentences(rnd, n):
    return " ".join(f"w{rnd.randrange(40)} w{rnd.randrange(40)}{rnd.choice(['.', '!', '?', chr(10)])}" for _ in range(n))


def likeness(a, b):
    x, y = (Counter(fp.paragraphs(t.encode())) for t in (a, b))
    whole = sum((x | y).values())
    return sum((x & y).values()) / whole if whole else 1.0


def test_paragraphs():
    assert fp.paragraphs(b"A b. C\n\n d?!  \n" + b"w " * 70) == [b"A b.", b"C", b"d?!", b"w " * 31 + b"w", b"w " * 31 + b"w", b"w " * 5 + b"w"]
    assert fp.paragraphs(b"") == fp.paragraphs(b" \n \t") == []
    assert len(set(fp.digests(b"a. a. a.").tolist())) == 3


def test_compare_finds_all_differences():
    rnd = np.random.default_rng(0)
    olds, news = [], []
    for _ in range(300):
        a = rnd.integers(0, 2**64, rnd.integers(0, 90), dtype=np.uint64)
        olds.append(a)
        news.append(np.concatenate([a[: rnd.integers(0, len(a) + 1)], rnd.integers(0, 2**64, rnd.integers(0, 50), dtype=np.uint64)]))
    olds += [np.arange(1, 30001, dtype=np.uint64) * np.uint64(2**40 + 15), olds[0]]
    news += [np.zeros(0, np.uint64), olds[0]]
    for a, b, (only_a, only_b, size) in zip(olds, news, fp.compare(olds, news), strict=True):
        assert sorted(only_a.tolist()) == sorted(set(a.tolist()) - set(b.tolist()))
        assert sorted(only_b.tolist()) == sorted(set(b.tolist()) - set(a.tolist()))
        assert size > fp.SIZE or len(only_a) + len(only_b) <= 3 * fp.SIZE


def test_subtract_fingerprints():
    a, b = b"One. Two. Three. Four.", b"One. Two. Other. Four."
    only_a, only_b = fp.subtract(fp.fingerprint(a), fp.fingerprint(b))
    assert set(only_a.tolist()) == set(fp.digests(a).tolist()) - set(fp.digests(b).tolist()) and len(only_b) == 1
    many = sentences(random.Random(1), 300).encode()
    assert fp.subtract(fp.fingerprint(many), fp.fingerprint(b)) is None
    big = fp.subtract(fp.fingerprint(many, 1024), fp.fingerprint(b, 1024))
    assert len(big[0]) == len(fp.digests(many)) and len(big[1]) == 4
    with pytest.raises(ValueError):
        fp.subtract(fp.fingerprint(a), fp.fingerprint(a, 8))


def documents():
    rnd = random.Random(7)
    texts = [None, "", "x", " \n", "é日😀 a. b. c. " * 20, "Same. Text.", "Same. Text.", sentences(rnd, 4000)]
    texts += [sentences(rnd, rnd.randrange(60)) for _ in range(60)]
    texts += [texts[-1] + " more.", texts[-2]]
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts)]
    return rows


def edited(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t, *_) in enumerate(rows):
        t, x = t or "", rows[(i + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), fp.fingerprint(t.encode()), fp.fingerprint(e.encode()), likeness(t, e), likeness(t, x))
    return out


@pytest.mark.parametrize("parts", [1, 4, 90])
def test_edit_with_next(spark, parts):
    rows = documents()
    want = edited(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fp.edit_with_next(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:7] == pytest.approx(want[r["doc_id"]])


def test_edit_edge_tables(spark):
    schema = "doc_id long, text string"
    assert fp.edit_with_next(spark.createDataFrame([], schema)).count() == 0
    one = fp.edit_with_next(spark.createDataFrame([(1, "ab cd. ef gh.")], schema)).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"ab cd. ab cd.").hexdigest()
    same = fp.edit_with_next(spark.createDataFrame([(5, "a. b.")] * 9 + [(None, "z.")] * 2 + [(5, "c.")], schema)).collect()
    assert len(same) == 12 and sum(r["near_next"] == 1.0 for r in same) == 9


def test_compare_versions(spark):
    rows = [(1, "One. Two.", "One. Three."), (2, None, "A."), (3, None, ""), (4, "a. a.", "a."), (5, sentences(random.Random(2), 500), "x.")]
    got = fp.compare_versions(spark.createDataFrame(rows, "id long, old string, new string"), "old", "new", ("id",)).collect()
    for r, (_, a, b) in zip(sorted(got), rows, strict=True):
        x, y = (set(fp.digests((t or "").encode()).tolist()) for t in (a, b))
        assert {int(v, 16) for v in r["removed"]} == x - y and {int(v, 16) for v in r["added"]} == y - x
        assert r["likeness"] == likeness(a or "", b or "")
    f = {r["id"]: r["fingerprint"] for r in fp.fingerprint_texts(spark.createDataFrame(rows, "id long, old string, new string"), ("id",), "old").collect()}
    assert f == {r["id"]: r["fingerprint"] for r in got}
