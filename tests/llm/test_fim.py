"""Fill-in-the-middle against slices of decoded text."""

import hashlib
import random

from pyspark.sql import functions as F

from textloom.llm import fim

TEXTS = [None, "", "a", "é", "日", "😀", "ab<P>c", "x<S>", "<M>", "<P", "a<", "<<S", "ab é日本😀 cd", "\n \x00", "plain ascii " * 300, "é" * 5000, "a😀" * 4000, "ab" * 60000 + "日" * 3 + "z" * 70000, "same", "same"]


def expected(doc_id, text, rate=90, spm=20):
    t = text or ""
    n = len(t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_runs():
    rnd = random.Random(1)
    for _ in range(300):
        t = "".join(rnd.choice("aaab é日😀") * rnd.randrange(1, 5) for _ in range(rnd.randrange(12)))
        runs = fim.Runs(t.encode())
        assert runs.n == len(t)
        assert [runs.offset(k) for k in range(len(t) + 1)] == [len(t[:k].encode()) for k in range(len(t) + 1)]
        assert all(x != y for x, y in zip(runs.widths, runs.widths[1:], strict=False))


def test_transform(spark):
    rows = [(None if i == 3 else i % 60, t, "clash", i) for i, t in enumerate(TEXTS * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n long").repartition(3)
    got = fim.transform(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [(None if i == 3 else i % 60, *expected(None if i == 3 else i % 60, t), t or "") for i, t in enumerate(TEXTS * 4)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_rates_keep_and_empty(spark):
    df = spark.createDataFrame([(str(i), f"text {i}", "en") for i in range(50)], "id string, body string, form2 string")
    every = fim.transform(df, rate=100, spm=100, keep=("id", "body", "form2"), doc_id="id", text="body")
    assert {r["form"] for r in every.collect()} == {"spm"}
    assert every.where(fim.restored(F.col("output"), F.col("form")) != F.col("body")).count() == 0
    assert {r["form"] for r in fim.transform(df, rate=0, keep=(), doc_id="id", text="body").collect()} == {"plain"}
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
