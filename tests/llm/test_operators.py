"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import gzip
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import cotraining, fm_index, line_dedup, mixing, pivot_index, risk_rules, shingle_join, warc
from textloom.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def documents():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 30
    base = [" ".join(rnd.choice(words) for _ in range(80)) for _ in range(6)]
    texts = [None, "", " \n\t", "one", "A b", "a B", "the of and\nthe of and\nthe of and a b c\n\nthe of and a b c"]
    texts += base + [base[0], base[0].replace("w1", "x1", 3), base[1] + " tail", base[2].upper(), base[3][:200] + "\n" + base[3][200:]]
    texts += ["long " * 3000 + "end", "\n".join(base[:3]), "\n".join(base[:3]) + "\nnew line of some other words here", base[4] + " " + base[5], "ñ é \x1c\x85 ü " * 20]
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "a", "b", "ü", "zz"][i % 5], len(t or ""), "clash") for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3)


def words(text):
    return (text or "").encode().split()


def test_risk_counts(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in risk_rules.apply_rules(docs, labels).collect()}
    for i, t, *_ in documents():
        w, seen, dup = words(t), [], 0
        for line in (t or "").split("\n"):
            dup += bool(line.encode().split()) and line in seen
            seen.append(line)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(j, j + 3)}
        r = got[i]
        assert (r["n_words"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), dup, len(rep))
        assert r["word_chars"] == sum(len(x.decode()) for x in w)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and r["kept"] == (not r["base_failed"])


def test_risk_bound():
    for n, k, p in [(50, 0, 0.1), (200, 7, 0.05), (10, 10, 0.5)]:
        assert risk_rules.tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_risk_cutoffs_hold_and_catch(spark):
    rows = [(i, "ab#cd " * 60 if i % 4 == 0 else " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(2400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 2400)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    signals = risk_rules.count_signals(df)
    cut = risk_rules.certified_cutoffs(signals, labels).first()
    assert cut["cut_symbols"] is not None and cut["cut_symbols"] < 0.2


def test_warc_round_trip_and_salvage(spark, tmp_path):
    html = [None, "", "<p>a</p>", "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n", "x" * 70000, None, "<p>a</p>"]
    rows = [(i, f"http://x/{i}\n", h, "clash") for i, h in enumerate(html)] + [(2, "again", "<p>a</p>", "clash"), (None, None, "null id", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    for compress in (True, False):
        path = str(tmp_path / f"archive-{compress}")
        warc.write_pages(pages, path, compress=compress)
        got = warc.read_archives(spark, path).collect()
        assert {r["kind"] for r in got} == {"record"} and len(got) == len(rows)
        for r in got:
            if r["record_id"] is None:
                assert r["payload"] == b"null id"
                continue
            text = (html[r["record_id"]] or "").encode()
            assert r["payload_bytes"] == len(text)
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(text).digest()).decode()
            first = min(i for i, h in enumerate(html) if (h or "").encode() == text)
            assert (r["record_type"], r["refers_to"]) == (("response", None) if r["record_id"] == first else ("revisit", first))


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_after_damage(compress):
    parts = [warc.record_bytes(i, "u", b"payload %d" % i * 50, len(b"payload %d" % i * 50), warc.digest_of(b"payload %d" % i * 50), None) for i in range(5)]
    data = [warc.member(p) if compress else p for p in parts]
    broken = bytearray(data[1])
    broken[len(broken) // 2] ^= 0xFF
    whole = data[0] + bytes(broken) + data[2] + b"noise" + data[3] + data[4][:-9]
    found = list(warc.salvage(whole))
    assert [r["record_id"] for r in found if r["kind"] == "record"] == [0, 2, 3]
    gaps = [(r["offset"], r["length"]) for r in found if r["kind"] == "gap"]
    assert gaps[0] == (len(data[0]), len(broken)) and gaps[1][1] == 5 and len(gaps) == 3
    assert sum(r["length"] for r in found) == len(whole)
    if compress:
        assert gzip.decompress(data[0]) == parts[0]


def test_warc_folder_without_manifest(spark, tmp_path):
    parts = [warc.record_bytes(i, "u", b"x%d" % i * 40, len(b"x%d" % i * 40), warc.digest_of(b"x%d" % i * 40), None) for i in range(4)]
    members = [warc.member(p) for p in parts]
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 0xFF
    (tmp_path / "damaged.warc.gz").write_bytes(members[0] + bytes(broken) + members[2])
    foreign = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:8f1d>\r\nContent-Type: application/http\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\npage\r\n\r\n"
    (tmp_path / "crawl.warc").write_bytes(foreign)
    kinds = lambda rows: sorted((r["file"], r["kind"], r["record_id"] if r["record_id"] is not None else -1) for r in rows)
    want = [("crawl.warc", "record", -1), ("damaged.warc.gz", "gap", -1), ("damaged.warc.gz", "record", 0), ("damaged.warc.gz", "record", 2)]
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert kinds(got) == want
    assert [bytes(r["payload"]) for r in got if r["file"] == "crawl.warc"] == [b"page"]
    (tmp_path / "own.warc.gz").write_bytes(members[3])
    (tmp_path / "_manifest-1").write_text("own.warc.gz")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert kinds(got) == [("crawl.warc", "gap", -1), ("damaged.warc.gz", "gap", -1), ("own.warc.gz", "record", 3)]
    assert {r["length"] for r in got if r["file"] == "crawl.warc"} == {len(foreign)}
    assert kinds(warc.read_archives(spark, str(tmp_path), unlisted=True).collect()) == [*want, ("own.warc.gz", "record", 3)]


def record(kind, body, *fields, version=b"WARC/1.1"):
    head = [version, b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:1>", b"Content-Length: %d" % len(body), *fields]
    return b"\r\n".join([*head, b"", b""]) + body + b"\r\n\r\n"


def test_foreign_records():
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nbody"
    b32 = base64.b32encode(hashlib.sha1(b"body").digest())
    of_block = b"WARC-Block-Digest: md5:" + hashlib.md5(http).hexdigest().encode()
    good = {
        "lower-case names": b"WARC/1.0\r\nwarc-type: response\r\nwarc-record-id: <urn:uuid:2>\r\ncontent-type: application/http\r\ncontent-length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n",
        "no blank": b"WARC/1.0\r\nWARC-Type:response\r\nWARC-Record-ID:<urn:uuid:2>\r\nContent-Type:application/http\r\nContent-Length:%d\r\n\r\n" % len(http) + http + b"\r\n\r\n",
        "sha256": record(b"response", http, b"Content-Type: application/http", b"WARC-Payload-Digest: sha256:" + hashlib.sha256(b"body").hexdigest().encode()),
        "sha1": record(b"response", http, b"Content-Type: application/http", b"WARC-Payload-Digest: sha1:" + b32),
        "unknown algorithm": record(b"response", http, b"Content-Type: application/http", b"WARC-Payload-Digest: blake9:xyz"),
        "block digest": record(b"response", http, b"Content-Type: application/http", of_block),
        "resource": record(b"resource", b"body", b"Content-Type: text/plain"),
        "folded": record(b"response", http, b"Content-Type: application/http;", b"  msgtype=response"),
    }
    for why, data in good.items():
        found = list(warc.salvage(data))
        assert [(r["kind"], r.get("payload")) for r in found] == [("record", b"body")], why
    info = list(warc.salvage(record(b"warcinfo", b"software: x\r\n\r\nformat: WARC", b"Content-Type: application/warc-fields")))
    assert info[0]["payload"] == b"software: x\r\n\r\nformat: WARC"
    for bad in (good["sha256"], good["sha1"], good["block digest"]):
        assert [r["kind"] for r in warc.salvage(bad.replace(b"body", b"bodx"))] == ["gap"]


def test_members_of_several_records():
    one, two, three = (record(b"resource", b"%d" % i) for i in (1, 2, 3))
    data = gzip.compress(one + two) + gzip.compress(three)
    found = list(warc.salvage(data))
    assert [r["payload"] for r in found] == [b"1", b"2", b"3"] and sum(r["length"] for r in found) == len(data)
    data = gzip.compress(one + two.replace(b"Content-Length", b"Content-Size") + three)
    found = list(warc.salvage(data))
    assert [(r["kind"], r.get("payload")) for r in found] == [("record", b"1"), ("record", b"3"), ("gap", None)]
    assert sum(r["length"] for r in found) == len(data)


def test_warc_of_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_pages(pages, str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).collect() == []


def test_repeated_rows_are_one_trial(spark):
    texts = ["ab#cd " * 60 if i % 4 == 0 else " ".join(f"w{i}x{j}" for j in range(60)) for i in range(160)]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    known = [(i, int(i % 4 > 0)) for i in range(160)]
    cuts = []
    for times in (1, 20):
        df = spark.createDataFrame(rows * times, "doc_id long, text string, lang string")
        labels = spark.createDataFrame(known * times, "doc_id long, quality int")
        cuts.append(risk_rules.certified_cutoffs(risk_rules.count_signals(df), labels).collect())
    assert cuts[0] == cuts[1] and cuts[0][0]["cut_symbols"] is None


def test_top_k(spark):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(300, 8)).round(1).tolist()
    v[7], v[9], v[11] = None, [1.0] * 7 + [None], [1.0] * 7 + [float("nan")]
    for i in range(100, 180):
        v[i] = [1.0] * 8
    rows = [(i, x, "clash") for i, x in enumerate(v)] + [(100, v[100], "again"), (None, v[0], "no id"), (301, [], "empty")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    got = pivot_index.top_k(df.drop("id"), F.col("id") % 20 == 0).collect()
    ok = {i: np.floor(64 * np.array(x, np.float32).astype(float)) for i, x in enumerate(v) if x and None not in x and np.isfinite(x).all()}
    want = set()
    for q in (i for i in ok if i % 20 == 0):
        best = sorted((-int(ok[q] @ ok[i]), i) for i in ok if i != q)[:20]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], int(r["score"])) for r in got} == want and len(got) == len(want)


def test_top_k_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r)[:3] for r in pivot_index.top_k(df, F.col("id") % 20 == 0).collect()) == [(0, 1, 20), (20, 1, 0)]
    assert pivot_index.top_k(df.limit(0), F.col("id") % 20 == 0).collect() == []


def removed(rows, size=13):
    starts = {}
    for i, t, *_ in rows:
        w = words(t)
        for j in range(len(w) - size + 1):
            key = tuple(w[j : j + size])
            starts[key] = min(starts.get(key, i), i)
    out = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = {k for j in range(len(w) - size + 1) if starts[tuple(w[j : j + size])] < i for k in range(j, j + size)}
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [5000, 1])
def test_substrings(docs, monkeypatch, hot):
    monkeypatch.setattr(fm_index, "HOT", hot)
    got = [(r["doc_id"], (r["n_words"], r["n_removed"], r["kept_sha256"])) for r in fm_index.dedup_substrings(docs).collect()]
    assert dict(got) == removed(documents()) and len(got) == len(documents())


def test_fm_index_statistics():
    rnd = random.Random(2)
    for window in (1, 2, 3, 5, 13):
        seqs = [[rnd.randint(1, 3) for _ in range(rnd.randint(1, 30))] for _ in range(20)]
        texts = np.array([x for s in seqs for x in [*s, 0]])
        sizes = np.array([len(s) for s in seqs])
        ends = np.cumsum(sizes + 1) - 1
        owner = np.repeat(rnd.sample(range(100), 20), sizes + 1)
        length, least = fm_index.FMIndex(texts, owner, window).statistics(texts, ends, sizes)
        for s, e, n in zip(seqs, ends, sizes, strict=True):
            for j in range(n - window + 1):
                holders = [owner[f - m] for t, f, m in zip(seqs, ends, sizes, strict=True) if any(t[k : k + window] == s[j : j + window] for k in range(m))]
                assert length[e - n + j] == window and least[e - n + j] == min(holders)


def components(rows):
    def shingles(t):
        w = words((t or "").encode().lower().decode())
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {i: shingles(t) for i, t, *_ in rows}
    part = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and part[a] != part[b]:
                    part[a] = part[b] = min(part[a], part[b])
                    changed = True
    return {i: (len(sets[i]), part[i]) for i in sets}


def test_shingle_components(docs):
    got = [(r["doc_id"], (r["n_shingles"], r["component_id"])) for r in shingle_join.components(docs).collect()]
    assert dict(got) == components(documents()) and len(got) == len(documents())


def test_shingle_chain_and_null_id(spark):
    w = [f"w{i}" for i in range(140)]
    rows = [(50 - k, " ".join(w[3 * k : 3 * k + 100])) for k in range(13)] + [(None, " ".join(w[:100])), (90, " ".join(w[:100]))]
    got = dict((r["doc_id"], r["component_id"]) for r in shingle_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got.pop(None) is None and set(got.values()) == {38}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = dict(tuple(r) for r in connected_components(edges).collect())
    assert {got[i] for i in range(1, 31)} == {1} and {got[i] for i in (90, 95, 100)} == {90}


def kept_lines(rows, percent=80):
    sets = {}
    for i, t, *_ in rows:
        for j, line in enumerate((t or "").split("\n") if t is not None else []):
            s = frozenset(line.encode().split())
            if s:
                sets[i, j] = s
    gone = {p for p, s in sets.items() if any(q < p and 100 * len(s & r) >= percent * len(s | r) for q, r in sets.items())}
    return {i: None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, t, *_ in rows}


@pytest.mark.parametrize("often", [256, 1])
def test_lines(docs, spark, monkeypatch, often):
    monkeypatch.setattr(line_dedup, "OFTEN", often)
    got = line_dedup.dedup_lines(docs).collect()
    assert {r["doc_id"]: r["text"] for r in got} == kept_lines(documents()) and len(got) == len(documents())
    rnd = random.Random(5)
    line = [f"a{i}" for i in range(20)]
    rows = []
    for i in range(60):
        x = line[:]
        for _ in range(rnd.randint(0, 3)):
            x[rnd.randrange(20)] = f"n{i}{rnd.random()}"
        rows.append((i, "head\n" + " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()} == kept_lines(rows)


@pytest.mark.parametrize("percent", [30, 50, 80, 100])
def test_common_words_by_size(spark, percent):
    keys = spark.createDataFrame([(5, n, 0) for n in range(1, 260)], "k long, n int, q int")
    found = {}
    for r in line_dedup._by_size(keys, percent).collect():
        found.setdefault(r["n"], set()).add(r["k"])
    for n in found:
        for m in range(1, n + 1):
            near, far = 100 * m >= percent * n, 100**3 * m < percent**3 * n
            assert near <= bool(found[n] & found[m]) <= (not far)


@pytest.mark.parametrize("percent", [30])
def test_lines_of_few_words(spark, monkeypatch, percent):
    monkeypatch.setattr(line_dedup, "OFTEN", 1)
    rnd = random.Random(percent)
    rows = [(i, "\n".join(" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 7))) for _ in range(3))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, percent=percent).collect()} == kept_lines(rows, percent)


def test_lines_with_clashing_names_and_one_id(spark):
    rows = [(1, "x y z\nq", 5, 6, 7), (1, "x y z\nq", 5, 6, 7), (1, "u v w\nz y  x", 5, 6, 7), (2, "q\nnew", 5, 6, 7), (2, None, 5, 6, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone long, d long, _d long")
    got = Counter(tuple(r) for r in line_dedup.dedup_lines(df).select("doc_id", "text", "gone", "d", "_d").collect())
    first, second = (1, "x y z\nq", 5, 6, 7), (1, "u v w\nz y  x", 5, 6, 7)
    rest = [(2, "new", 5, 6, 7), (2, None, 5, 6, 7)]
    one = Counter([first, first, (1, "u v w", *first[2:]), *rest])
    other = Counter([(1, "q", *first[2:])] * 2 + [second, *rest])  # by the hashes of the texts either comes first
    assert got in (one, other)


def test_frequent_words_are_last(spark):
    hashes = spark.range(1).select(F.xxhash64(F.lit("rare")), F.xxhash64(F.lit("the"))).first()
    table = bytearray(line_dedup.BUCKETS)
    for h, count in zip(hashes, (3, 1 << 22), strict=True):
        table[h % line_dedup.BUCKETS] = min(127, 1 + int(3 * math.log2(count)))
    v = lambda x: line_dedup._values(F.lit(x), bytes(table))
    both, rare, the = spark.range(1).select(v("the rare"), v("rare"), v("the")).first()
    assert both == [*rare, *the]


def test_lines_without_id_stay(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f g")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in line_dedup.dedup_lines(df).collect()) == [(0, 0), (1, 0), (2, 1)]


def test_mix(docs, spark):
    out = mixing.mix(docs).collect()
    assert len(out) == len(documents())
    total = sum(r["size"] for r in out)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in out}
    assert sum(t for t, _ in targets.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-6 for t, s in targets.values()) and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    assert [tuple(r) for r in sorted(out, key=str)] == [tuple(r) for r in sorted(mixing.mix(docs.repartition(7)).collect(), key=str)]
    rows = [(i, "w " * (i % 50 + 1), f"s{i % 3}") for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) < 0.01 * r["g"] for r in got)


def test_mix_with_clashing_names_and_null_ids(spark):
    rows = [(None, "w " * i, "a", i, -i, i * i) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, src long, rank long, hash long")
    out = mixing.mix(df).collect()
    assert sorted((r["doc_id"], r["text"], r["source"], r["src"], r["rank"], r["hash"]) for r in out) == sorted(rows, key=str) or len(out) == 19
    assert all((r["src"], r["rank"], r["hash"]) == (r["size"], -r["size"], r["size"] ** 2) for r in out)


def test_targets_stop_and_share(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 0 and got["b"] == pytest.approx(1980 * 2 / 3) and got["c"] == pytest.approx(1980 / 3)


def test_cotraining_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] and r["score"] == 1 for r in cotraining.classify(docs, empty).collect())


@pytest.mark.parametrize("run", [
    lambda d, s: risk_rules.apply_rules(d, s.createDataFrame([], "doc_id long, quality int, toxic int")),
    lambda d, s: fm_index.dedup_substrings(d),
    lambda d, s: cotraining.classify(d, s.createDataFrame([], "doc_id long, quality int, toxic int")),
    lambda d, s: shingle_join.components(d),
    lambda d, s: mixing.mix(d),
    lambda d, s: line_dedup.dedup_lines(d),
])
def test_no_rows(spark, run):
    assert run(spark.createDataFrame([], DOCS), spark).collect() == []


def test_plans_do_not_hold_the_word_table(docs, monkeypatch):
    sizes, write = [], line_dedup.materialise

    def kept(df, name, *rest):
        sizes.append(len(df._jdf.queryExecution().toString()))
        return write(df, name, *rest)

    monkeypatch.setattr(line_dedup, "materialise", kept)
    line_dedup.later_matches(docs)
    assert len(sizes) > 5 and max(sizes) < 100_000
