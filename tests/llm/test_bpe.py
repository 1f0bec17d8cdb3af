"""BPE by tree concatenation against the library on whole texts."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from textloom.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def whole(text):
    t = Tokenizer.from_file(PATH)
    ids = t.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))


def texts():
    rnd = random.Random(7)
    letters = "".join(rnd.choice(["the", "an", "ble", "e", "éa", "ß", "x", "ing", "s"]) for _ in range(900))
    return [
        None, "", "  \n\t ", "a", "Don't stop", "x" * 3000, letters, letters + "'s " + letters, "á" * 700, "É" * 900, "!?." * 500,
        "12345" * 300, "你好" * 400, "<|endoftext|>" * 60, letters + "<|startoftext|>" + letters, "a b c " * 50, "'s't" * 300,
        letters.upper(), "\U0001f600" * 300, "İ" * 300, " " * 400, "ab " * 500,
    ]


def test_like_the_library(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(4, "Don't stop", "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    for limit, piece in ((16384, 4096), (200, 7), (200, 64)):
        found = bpe.encode_texts(df, PATH, limit=limit, piece=piece).collect()
        assert sorted(tuple(r)[:4] for r in found) == sorted((i, *whole(t)) for i, t, _ in rows)
        for r in found:
            long = any(len(w) > bpe.SHORT for w in (rows[r["doc_id"]][1] or "").encode().split())
            assert (r["n_by_tree"] > 0) == (long and r["n_tokens"] > 0) and r["n_by_tree"] <= r["n_tokens"]


def test_words_about_the_limits(spark):
    words = ["é" * 8, "é" * 8 + "a", "a" * 16, "a" * 17, "b" * 1024, "b" * 1025, "<|endoftext|>abcdefghijk", "<|endoftext|>" * 79, "it's" * 300]
    df = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.encode_texts(df, PATH).collect()}
    for i, w in enumerate(words):
        assert got[i][:3] == whole(w) and got[i][3] == (got[i][0] if len(w.encode()) > 16 else 0)


def test_join_agrees():
    c = bpe.codec(PATH)
    rnd = random.Random(1)
    for _ in range(300):
        s = "".join(rnd.choice("abcdefghinorstteee") for _ in range(rnd.randint(2, 120)))
        step = rnd.randint(1, 30)
        cuts = [s[i : i + step] for i in range(0, len(s), step)]
        assert c.tree([c.tokens(x, i == len(cuts) - 1) for i, x in enumerate(cuts)]) == c.tokens(s, True)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_texts(df, PATH).collect() == []
