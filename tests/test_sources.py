"""Readers and writers on literal files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from textloom.sources import readers as R
from textloom.sources import writers as W


def test_table(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("text\tcoarse\tfine\nhello there\tOTHER\tx\n'quoted\ttab'\tOFFENSE\t\n")
    df = R.read_table(spark, str(tmp_path / "a.tsv"), ["text", "fine"], {"fine": "label"})
    assert sorted(map(tuple, df.collect())) == [("hello there", "x"), ("quoted\ttab", "")]
    assert R.read_table(spark, str(tmp_path / "a.tsv"), ["text"], rows=1).count() == 1


def test_tagged(spark, tmp_path):
    (tmp_path / "a.txt").write_text("-DOCSTART- -X- O\n\n# note\nEU NNP B-ORG\nrejects VBZ O\n\nPeter NNP B-PER\n")
    got = sorted((r["tokens"], r["tags"]) for r in R.read_tagged(spark, str(tmp_path / "a.txt")).collect())
    assert got == [(["EU", "rejects"], ["B-ORG", "O"]), (["Peter"], ["B-PER"])]


def test_qa(spark, tmp_path):
    data = {"data": [{"title": "t", "paragraphs": [{"context": "a b", "qas": [{"id": "1", "question": "q?", "is_impossible": False, "answers": [{"text": "b", "answer_start": 2}]}, {"id": "2", "question": "r", "is_impossible": True, "answers": []}]}]}]}
    (tmp_path / "q.json").write_text(json.dumps(data))
    got = sorted((r["id"], r["question_no"], len(r["answers"])) for r in R.read_qa(spark, str(tmp_path / "q.json")).collect())
    assert got == [("1", 0, 1), ("2", 1, 0)]


def test_normalize_qa(spark):
    schema = "context string, qas array<struct<question: string>>, text string, questions array<string>"
    df = spark.createDataFrame([("c", [("x",), ("y",)], None, None), (None, None, "t", ["z"])], schema)
    assert sorted(map(tuple, R.normalize_qa(df).collect())) == [("c", 0, "x"), ("c", 1, "y"), ("t", 0, "z")]


def test_retrieval(spark, tmp_path):
    rows = [{"question": "who?", "positive_ctxs": [{"title": "T", "text": "p", "passage_id": "1"}], "hard_negative_ctxs": [{"title": None, "text": f"n{i}", "passage_id": str(i)} for i in range(3)]}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = R.read_retrieval(spark, str(tmp_path / "r.jsonl")).first()
    assert got["query"] == "who" and [p["label"] for p in got["passages"]] == ["positive", "hard_negative"] and got["passages"][1]["title"] == ""


def test_documents_and_vocabulary(spark, tmp_path):
    (tmp_path / "d.txt").write_text("one.\ntwo.\n\nthree.\n")
    assert sorted(r["sentences"] for r in R.read_documents(spark, str(tmp_path / "d.txt")).collect()) == [["one.", "two."], ["three."]]
    (tmp_path / "v.txt").write_text("[PAD]\nthe\nof\n")
    assert sorted((r["id"], r["token"]) for r in R.read_vocabulary(spark, str(tmp_path / "v.txt")).collect()) == [(0, "[PAD]"), (1, "the"), (2, "of")]


def test_vectors(spark, tmp_path):
    (tmp_path / "w.txt").write_text("3 2\na 1 2\nb 3 4\na 9 9\nbad 1\n")
    v = R.read_vectors(spark, str(tmp_path / "w.txt"), 2)
    assert sorted((r["word"], r["v"]) for r in v.collect()) == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    vocab = spark.createDataFrame([("a", 0), ("zz", 1)], "token string, id int")
    assert {r["token"]: r["v"] for r in R.vectors_for(vocab, v, 2).collect()} == {"a": [1.0, 2.0], "zz": [0.0, 0.0]}
    W.write_vectors(v, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a 1.0 2.0", "b 3.0 4.0"]


def test_verified_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    good = hashlib.md5(b"abc").hexdigest()
    assert R.verified_files(spark, str(tmp_path / "x.bin"), good).first()["md5"] == good
    with pytest.raises(Exception, match="md5 differs"):
        R.verified_files(spark, str(tmp_path / "x.bin"), "0" * 32).collect()


def test_answers(spark, tmp_path):
    preds = spark.createDataFrame([("1", "a", 0.5), ("1", "b", 0.9), ("2", None, 0.3)], "id string, answer string, score double")
    questions = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    assert dict(map(tuple, W.top_answers(preds, questions).collect())) == {"1": "b", "2": "", "3": ""}


def test_cache(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert W.cached(spark, str(tmp_path), {"b": 1, "a": [2]}, build).count() == 3
    assert calls == [1] and W.cache_key({"a": 1, "b": 2}) == W.cache_key({"b": 2, "a": 1})


def test_parts_settings_scores_pairs(spark, tmp_path):
    W.write_parts(spark.range(25).withColumnRenamed("id", "n"), str(tmp_path / "parts"), "n", 10)
    assert sorted(r["part"] for r in spark.read.json(str(tmp_path / "parts")).select("part").distinct().collect()) == [0, 1, 2]
    W.save_settings(spark, {"x": 1}, str(tmp_path / "s"))
    assert W.load_settings(spark, str(tmp_path / "s")) == {"x": 1}
    s = spark.createDataFrame([("1", 0.8), ("0", 0.8)], "label string, probability double")
    assert sorted(round(r["score"], 6) for r in W.relevance_scores(s).collect()) == [0.2, 0.8]
    t = spark.createDataFrame([("q", "p", "n")], "query string, positive string, negative string")
    assert sorted(map(tuple, W.labelled_pairs(t).collect())) == [("q", "n", 0), ("q", "p", 1)]
    W.log_metrics(spark.range(1).select(F.lit(0.5).alias("acc")), str(tmp_path / "m"), 3)
    assert spark.read.parquet(str(tmp_path / "m")).first()["value"] == 0.5


def test_lines_of_a_split_are_counted_in_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 1)  # runs of two lines
    sizes = [3, 1, 7, 2, 40, 1]
    want = [[f"w{k}x{i}" for i in range(n)] for k, n in enumerate(sizes)]
    (tmp_path / "a.txt").write_text("\n\n".join("\n".join(f"{w} T" for w in s) for s in want) + "\n")
    path = str(tmp_path / "a.txt")
    tagged = R.read_tagged(spark, path)
    assert [r["tokens"] for r in sorted(tagged.collect(), key=lambda r: r["sentence"])] == want
    documents = R.read_documents(spark, path)
    assert [r["sentences"] for r in sorted(documents.collect(), key=lambda r: r["doc"])] == [[f"{w} T" for w in s] for s in want]
    lines = R.indexed_lines(spark, path)
    assert [r["value"] for r in sorted(lines.collect(), key=lambda r: r["n"])] == (tmp_path / "a.txt").read_text().split("\n")[:-1]
    for df in (tagged, documents, lines):
        assert "__run" in df._jdf.queryExecution().optimizedPlan().toString()
