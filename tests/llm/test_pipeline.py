"""The pipeline's stages against plain Python on the rows that each takes."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import components, kept_lines
from textloom.llm import cotraining

P = pytest.importorskip("public_tokenizers")


def tables(folder, spark):
    rnd = random.Random(11)
    vocabulary = [f"word{i}" for i in range(300)]
    texts = []
    for i in range(120):
        lines = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(6, 20))) for _ in range(rnd.randint(1, 5))]
        text = "\n".join(lines)
        texts.append(text.replace(" ", " ### ") if i % 9 == 0 else text)
    texts += [texts[1], texts[2].replace("word1", "wordx1", 1), texts[3] + " more", None, "", "one"]
    rows = [(i, t, "en", [f"s{i % 4}", None][i % 11 == 0], len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[5])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 9 > 0), 0) for i in range(0, 120, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def mixed(rows):
    """How often each row is taken."""
    size = lambda t: len((t or "").encode().split())
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += size(r[1])
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, sum(total.values()), set(order)
    while open_:
        share = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= 3 * total[s]
        open_ -= over
    md5 = lambda x, n: int(hashlib.md5(x.encode()).hexdigest()[:n], 16)
    kind = lambda n: n if n < 32 else n.bit_length() * 32 + (n >> n.bit_length() - 5 & 15)
    out = []
    for s in order:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (kind(size(r[1])), md5(f"{r[0]}/8", 2) % 16, r[0]))
        rate = target[s] / total[s] if total[s] else 0
        u = md5(("n" if s is None else "s" + s) + "/8", 8) / 2**32
        out += [r for i, r in enumerate(own) for _ in range(math.floor((i + 1) * rate + u) - math.floor(i * rate + u))]
    return out


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows = tables(folder, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    verdicts = cotraining.classify(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {r["doc_id"] for r in verdicts.where("kept").collect()}
    rows = [r for r in rows if r[0] in kept]
    assert sum(r[0] % 9 == 0 and r[0] < 120 for r in rows) <= 2 and len(rows) > 100
    text = kept_lines(rows)
    rows = [(r[0], text[r[0]], *r[2:4], len(text[r[0]]) if text[r[0]] != r[1] else r[4]) for r in rows if text[r[0]] == r[1] or text[r[0]].split()]
    first = components(rows)
    rows = list({r[0]: r for r in rows if first[r[0]][1] == r[0]}.values())
    rows = mixed(rows)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[r[0], len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r)[:4] for r in corpus_pipeline.run(spark, folder).collect()) == want


def test_columns_of_all_but_the_last(spark, tmp_path):
    tables(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
    assert all(stage(spark, docs.limit(0), str(tmp_path)).collect() == [] for _, stage in corpus_pipeline.STAGES)
