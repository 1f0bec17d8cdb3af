"""Subword pieces and the processors that end in ids, on small tables."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import subwords as S
from textloom.operators import tags
from textloom.plans import inputs
from textloom.plans.processors import load_processor, processor, quarantine, save_processor

V = [S.PAD, S.UNK, S.CLS, S.SEP, S.MASK, "un", "##aff", "##able", "##a", "the", "cat", "sat", "?", "who", "on", "mat", "##s"]
ID = {t: i for i, t in enumerate(V)}


def ids(*tokens):
    return [ID[t] for t in tokens]


def test_cut_word():
    assert S.cut_word("unaffable", ID, 7) == [(5, 0), (6, 2), (7, 5)]
    assert S.cut_word("unx", ID, 7) is None and S.cut_word("", ID, 7) == []


def test_word_pieces(spark):
    df = spark.createDataFrame([(["The", "cats", "\U0001f600"], "  The cats\n\U0001f600"), ([], ""), (None, None), (["x" * 101], None)], "w array<string>, t string")
    got = [r[0] for r in df.select(S.word_pieces(F.col("w"), V, F.col("t"))).collect()]
    assert (got[0].ids, got[0].initial, got[0].starts) == (ids("the", "cat", "##s", S.UNK), [1, 1, 0, 1], [2, 6, 9, 11])
    assert got[1].ids == [] and got[2].ids == [] and got[3].ids == [1]


def test_text_inputs(spark):
    df = spark.createDataFrame([(1, "The cats", "the", "a"), (2, None, "cat", "b"), (3, "the", "the", "odd")], "k int, text string, text_b string, label string")
    ready = processor("text_inputs", vocabulary=V, labels=["a", "b"], text_b="text_b", size=8)(df)
    one, two = ready.orderBy("k").collect()
    assert one.input_ids == ids(S.CLS, "the", "cat", "##s", S.SEP, "the", S.SEP, S.PAD)
    assert one.segment_ids == [0, 0, 0, 0, 0, 1, 1, 0] and one.padding_mask == [1] * 7 + [0] and one.label_ids == 0
    assert two.input_ids[:4] == ids(S.CLS, S.SEP, "cat", S.SEP)
    assert [r.k for r in quarantine(df, ready, "k").collect()] == [3]
    row = processor("text_inputs", vocabulary=V, labels=["a", "b"], multilabel=True, size=4)(df).orderBy("k").first()
    assert row.label_ids == [1, 0] and row.input_ids == ids(S.CLS, "the", "cat", S.SEP)
    assert "label_ids" not in processor("text_inputs", vocabulary=V, size=4)(df).columns
    assert processor("text_inputs", vocabulary=V, size=4)(df.limit(0)).collect() == []


def test_tag_inputs(spark):
    df = spark.createDataFrame([(["cats", "sat"], ["B-X", "O"]), (["cat"], ["odd"])], "tokens array<string>, tags array<string>")
    got = processor("tag_inputs", vocabulary=V, labels=["[PAD]", "X", "O", "B-X"], size=8)(df).collect()
    assert len(got) == 1 and got[0].initial_mask == [0, 1, 0, 1, 0, 0, 0, 0] and got[0].label_ids == [1, 3, 1, 2, 1, 0, 0, 0]
    assert len(processor("tag_inputs", vocabulary=V, labels=["X"], tags=None, size=4)(df).collect()) == 2


def test_question_inputs(spark):
    rows = [(1, "Who?", "the cat sat on the mats", [(4, "cat"), (19, "mats")]), (2, "Who?", "the cat", []), (3, "Who?", "", []), (4, None, None, [])]
    df = spark.createDataFrame(rows, "k int, question string, text string, answers array<struct<start: int, text: string>>")
    got = processor("question_inputs", vocabulary=V, size=9, stride=3, question_size=2, slots=3)(df).orderBy("k", "passage").collect()
    assert [(r.k, r.passage, r.passage_start_t) for r in got] == [(1, 0, 0), (1, 1, 3), (2, 0, 0)]
    assert got[0].input_ids == ids(S.CLS, "who", "?", S.SEP, "the", "cat", "sat", "on", S.SEP) and got[0].seq_2_start_t == 4
    assert [tuple(x) for x in got[0].labels] == [(5, 5), (0, 0), (-1, -1)]
    assert got[1].input_ids == ids(S.CLS, "who", "?", S.SEP, "on", "the", "mat", "##s", S.SEP)
    assert [tuple(x) for x in got[1].labels] == [(0, 0), (6, 7), (-1, -1)] and [tuple(x) for x in got[2].labels] == [(0, 0), (-1, -1), (-1, -1)]
    with pytest.raises(ValueError):
        processor("question_inputs", vocabulary=V, size=9, stride=5, question_size=2)


def test_natural_questions_inputs(spark):
    rows = [(1, "who", ["the", "cats", "sat", "on", "the", "mat"], -1, -1, [(1, 3)], "none"), (2, "who", ["the"], -1, -1, [], "yes"), (3, "who", ["the"], -1, -1, [], "none")]
    df = spark.createDataFrame(rows, "k int, question string, words array<string>, long_start int, long_end int, short array<struct<start: int, end: int>>, yes_no string")
    got = processor("natural_questions_inputs", vocabulary=V, size=9, stride=4, question_size=1, slots=2)(df).orderBy("k", "passage").collect()
    assert [(r.k, r.passage, r.answer_type_ids, tuple(r.labels[0])) for r in got] == [(1, 0, 1, (4, 6)), (1, 1, 0, (0, 0)), (2, 0, 2, (0, 0)), (3, 0, 0, (0, 0))]


def test_similarity_inputs(spark):
    df = spark.createDataFrame([("who", [("the", "cat sat", "positive", "1")])], "query string, passages array<struct<title: string, text: string, label: string, external_id: string>>")
    row = processor("similarity_inputs", vocabulary=V, size=4, passage_size=7)(df).first()
    assert row.query_input_ids == ids(S.CLS, "who", S.SEP, S.PAD) and row.label_ids == [1, 0]
    assert row.passage_input_ids == [ids(S.CLS, "the", S.SEP, "cat", "sat", S.SEP, S.PAD), ids(S.CLS, S.SEP, S.SEP) + [0] * 4]
    assert row.passage_segment_ids[0] == [0, 0, 0, 1, 1, 1, 0]


def test_language_inputs(spark):
    df = spark.createDataFrame([(i, "the cats sat on unaffable mats", "who sat" if i % 2 else None, i % 2 == 1) for i in range(200)], "id int, text string, text_b string, is_next boolean")
    run = processor("language_inputs", vocabulary=V, size=16, share=0.25)
    plain = {r.id: r for r in processor("text_inputs", vocabulary=V, text_b="text_b", size=16)(df).collect()}
    got = {r.id: r for r in run(df).collect()}
    changed = 0
    for i, r in got.items():
        asked = [k for k, x in enumerate(r.lm_label_ids) if x != -1]
        assert 1 <= len(asked) <= 4 and r.nextsentence_label_ids == 1 - i % 2 and len(r.input_ids) == 16
        full = plain[i].input_ids
        assert all(r.lm_label_ids[k] == full[k] for k in asked) and not {full[k] for k in asked} & {0, 2, 3}
        assert all(r.input_ids[k] == full[k] for k in range(16) if k not in asked)
        for k in asked:  # whole words: a piece is asked for with the others of its word
            assert not V[full[k]].startswith(S.INNER) or k - 1 in asked
            assert not V[full[k + 1]].startswith(S.INNER) or k + 1 in asked
        changed += sum(r.input_ids[k] == ID[S.MASK] for k in asked) / len(asked) / 200
    assert 0.7 < changed < 0.9
    assert {r.id: r for r in run(df.repartition(3)).collect()} == got


def test_saved_processor(spark, tmp_path):
    path = str(tmp_path / "p")
    save_processor(spark, "text_inputs", {"vocabulary": V, "size": 4}, path)
    df = spark.createDataFrame([("the cat",)], "text string")
    assert load_processor(spark, path)(df).first().input_ids == ids(S.CLS, "the", "cat", S.SEP)
    assert len(load_processor(spark, path, size=6)(df).first().input_ids) == 6
    with pytest.raises(KeyError):
        save_processor(spark, "unknown", {}, path)


def test_predictions(spark):
    df = spark.createDataFrame([([[0.0, 2.0], [9.0, 0.0], [1.0, 1.0]], [1, 0, 1])], "z array<array<double>>, m array<int>")
    row = tags.tag_predictions(df, "z", "m", ["O", "B"]).first()
    assert row.preds == ["B", "O"] and [round(p, 4) for p in row.probabilities] == [0.8808, 0.5]
    row = tags.next_sentence_predictions(spark.createDataFrame([([1.0, 3.0],)], "z array<double>"), "z").first()
    assert row.is_next is False and round(row.probability, 4) == 0.8808


def test_vocabularies():
    assert inputs.VOCABULARY[5] == "a" and inputs.VOCABULARY[31] == "##a" and inputs.PAIRS[57] == "ae" and inputs.PAIRS[87] == "##ae"


def test_bert_inputs_read_every_piece(spark):
    rnd = __import__("random").Random(2)
    words = ["the", "cats", "sat", "on", "unaffable", "mats", "zzz", ","]
    texts = {i: "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 14))) for _ in range(rnd.randrange(1, 9))) for i in range(30)}
    rows = [(i, t, "clash") for i, t in texts.items()] + [(100, None, "x"), (101, "", "x"), (102, "the " * 90, "x")]
    texts[102] = "the " * 90
    df = spark.createDataFrame(rows, "doc_id long, text string, pair string")
    plain = {r.doc_id: [x for x, m in zip(r.input_ids, r.padding_mask, strict=True) if m][1:-1] for r in processor("text_inputs", vocabulary=V, size=4000)(df).collect()}
    out = processor("bert_inputs", vocabulary=V, size=24, share=0.3)(df).collect()
    read = {i: [] for i in texts}
    asked = 0
    for r in sorted(out, key=lambda r: (r.doc_id, r.pair)):
        full = [y if y != -1 else x for x, y in zip(r.input_ids, r.lm_label_ids, strict=True)]
        n = sum(r.padding_mask)
        a = full[1 : 1 + r.a_to - r.a_from]
        b = full[2 + r.a_to - r.a_from : n - 1]
        assert len(full) == 24 and full[0] == V.index(S.CLS) and full[1 + len(a)] == full[n - 1] == V.index(S.SEP)
        assert a == plain[r.doc_id][r.a_from : r.a_to] and b == plain[r.b_key][r.b_from : r.b_to]
        assert r.nextsentence_label_ids == int(not r.is_next) and r.segment_ids[:n] == [0] * (len(a) + 2) + [1] * (len(b) + 1)
        read[r.doc_id] += a + (b if r.is_next else [])
        asked += sum(x != -1 for x in r.lm_label_ids)
        assert sum(x != -1 for x in r.lm_label_ids) <= 7
    assert read == {i: plain[i] for i in texts} and asked > len(out)
    assert {r.doc_id for r in out}.isdisjoint({100, 101})


def test_no_answer_passages_are_sampled(spark):
    rows = [(k, "who", ["the", "cats", "sat", "on", "the", "mat"] * 20, -1, -1, [(1, 3)] if k % 2 else [], "none") for k in range(20)]
    df = spark.createDataFrame(rows, "k int, question string, words array<string>, long_start int, long_end int, short array<struct<start: int, end: int>>, yes_no string")
    run = lambda keep: processor("natural_questions_inputs", vocabulary=V, size=9, stride=4, question_size=1, slots=2, key="k", keep_no_answer=keep)(df).select("k", "passage", "answer_type_ids").collect()
    every, some, none = run(1.0), run(0.3), run(0.0)
    assert {tuple(r) for r in none} < {tuple(r) for r in some} < {tuple(r) for r in every}
    for part in (some, none):
        assert {r.k for r in part} == set(range(20)) and sum(r.answer_type_ids > 0 for r in part) == sum(r.answer_type_ids > 0 for r in every)
    assert all(sum(r.k == k for r in none) == max(1, sum(r.k == k and r.answer_type_ids > 0 for r in every)) for k in range(20))


def test_batches_are_taken_in_slices_of_bounded_size():
    from textloom.functions import batches as B

    b = pa.RecordBatch.from_arrays([pa.array(["x" * (1 + i % 3) * 1000 for i in range(100)]), pa.array([["y"] * i for i in range(100)])], ["text", "words"]).slice(7)
    parts = list(B.slices(b, 20_000))
    assert len(parts) > 1 and all(p.nbytes <= 20_000 or p.num_rows == 1 for p in parts)
    assert pa.Table.from_batches(parts).to_pylist() == b.to_pylist()
    assert [p.num_rows for p in B.slices(b.slice(0, 0))] == [0]


def test_slices_of_words_keep_nulls_and_cut_a_kept_word_alike(monkeypatch):
    from textloom.functions import batches as B

    monkeypatch.setattr(B, "KEPT", 2)
    cutter = B.Pieces(lambda w: [(len(w),)] * len(w), 1)
    for words in (pa.array([["a", None, "bcd"], None, [], ["bcd", "ef"]]), pa.array([["g", "a"], ["hij"]])):
        rows, ends, found, *_ = cutter(words)
        want = [None if w is None else [len(x) for x in w if x for _ in x] for w in words.to_pylist()]
        assert B.lists(ends[rows], found[:, 0], words.is_null()).to_pylist() == want
        assert len(cutter.known) <= 2


def test_a_text_of_questions_is_cut_once(spark):
    from textloom.plans import inputs

    df = spark.createDataFrame([("is it", "a b c", [(0, "a")])], "question string, text string, answers array<struct<start: bigint, text: string>>")
    plan = inputs.question_inputs(inputs.VOCABULARY, 16, 4, 5)(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # of the question and of the text; a filter on pieces would be a third


def test_cutter_cuts_as_cut_word_does():
    rnd = __import__("random").Random(1)
    for k in range(30):
        drawn = {rnd.choice(["", S.INNER]) + "".join(rnd.choice("abä#") for _ in range(rnd.randrange(1, 4))) for _ in range(20)}
        vocabulary = [S.PAD, S.UNK, *sorted(drawn), *(["", S.INNER, "#"] if k % 3 == 0 else [])]
        vocabulary = list(dict.fromkeys(vocabulary))
        numbers, longest, reach = {t: i for i, t in enumerate(vocabulary)}, max(map(len, vocabulary)), S.reaches(vocabulary)
        for lower in (True, False):
            cut = S.cutter(vocabulary, lower)
            for _ in range(100):
                w = "".join(rnd.choice("abÄ#İ") for _ in range(rnd.choice([0, 1, 3, 7, 100, 101])))
                form = w.lower() if lower and len(w.lower()) == len(w) else w
                assert cut(w) == ((S.cut_word(form, numbers, longest, reach) if len(w) <= S.LONGEST_WORD else None) or [(1, 0)])


def test_bert_inputs_cut_documents_once(spark):
    df = spark.createDataFrame([(i, "the cats sat\non mats\nthe mat") for i in range(12)] + [(None, "the cats"), (50, "  \n")], "doc_id long, text string")
    run = processor("bert_inputs", vocabulary=V, size=12)
    plan = run(df)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 2 and "Join" not in plan[plan.index("MapInArrow") : plan.rindex("MapInArrow")]
    rows = run(df).collect()
    want = sorted(map(repr, rows))
    assert {r.doc_id for r in rows} == {None, *range(12)}  # a null id is a document too
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a document and the pairs that want it come in different batches
    try:
        assert sorted(map(repr, run(df).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ascii_words_are_cut_together():
    rnd = __import__("random").Random(3)
    for k in range(20):
        drawn = {rnd.choice(["", S.INNER]) + "".join(rnd.choice("abä#") for _ in range(rnd.randrange(1, 4))) for _ in range(20)}
        vocabulary = list(dict.fromkeys([S.PAD, S.UNK, *sorted(drawn), *(["", S.INNER, "#"] if k % 3 == 0 else [])]))
        for lower in (True, False):
            words = ["".join(rnd.choice("abAÄ#" if rnd.random() < 0.2 else "abA#") for _ in range(rnd.choice([0, 1, 3, 7, 100, 101]))) for _ in range(60)] + [None]
            cut, cutter = S.cutter(vocabulary, lower), S.pieces_of(vocabulary, lower)()
            _, ends, found, *_ = cutter(pa.array([words[:20], None, words[20:]], pa.list_(pa.string())))
            assert [[tuple(x) for x in found[i:j].tolist()] for i, j in zip(ends[:-1], ends[1:], strict=True)] == [[] if w is None else cut(w) for w in words]
            assert not any(w.isascii() and 0 < len(w) <= S.LONGEST_WORD for w in cutter.known)


def test_question_inputs_make_passages_in_the_pass_that_cuts(spark):
    rnd = __import__("random").Random(5)
    words = ["the", "cats", "sat,", "on", "unaffable", "mats", "zzz", "été"]
    rows = []
    for k in range(40):
        text = " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 12, 60])))
        spots = [None if rnd.random() < 0.1 else (rnd.choice([-3, 0, rnd.randrange(len(text) + 5), None]), rnd.choice([text[:3], "", None, "x" * 40])) for _ in range(rnd.randrange(5))]
        rows.append((k, rnd.choice(["who sat", "", None]), text, rnd.choice([spots, spots, None])))
    df = spark.createDataFrame(rows, "k int, question string, text string, answers array<struct<start: int, text: string>>")
    out = processor("question_inputs", vocabulary=V, size=16, stride=5, question_size=4, slots=3)(df)
    assert out.columns == [*df.columns, "passage", "passage_start_t", "input_ids", "padding_mask", "segment_ids", "seq_2_start_t", "labels"]
    assert "sequence" not in out._jdf.queryExecution().executedPlan().toString()  # passages are no array of positions that expressions slice
    got = out.collect()
    cut = S.pieces_of(V)()
    for k, _, text, answers in rows:
        tokens = __import__("re").findall(r"\w+|[^\w\s]", text)
        _, ends, found, within, *_ = cut(pa.array([tokens]))
        at, starts = 0, []
        for i, w in enumerate(tokens):
            at = text.index(w, at)
            starts += [at + int(o) for o in found[ends[i] : ends[i + 1], 1]]
            at += len(w)
        own = sorted((r for r in got if r.k == k), key=lambda r: r.passage)
        room = 18 - own[0].seq_2_start_t - 3
        assert [r.passage_start_t for r in own] == [5 * i for i in range(max(0, -(-(len(starts) - room) // 5)) + 1)]
        place = lambda c: -1 if c is None else sum(s <= c for s in starts) - 1  # noqa: B023, E731
        for r in own:
            held = found[r.passage_start_t : r.passage_start_t + room, 0].tolist()
            n = r.seq_2_start_t + len(held) + 1
            assert r.input_ids[r.seq_2_start_t :] == held + [3] + [0] * (16 - n) and r.padding_mask == [1] * n + [0] * (16 - n)
            assert r.segment_ids == [0] * r.seq_2_start_t + [1] * (len(held) + 1) + [0] * (16 - n)
            want = [(0, 0)] if not answers else []
            for a in (answers or [])[:3]:
                c, t = a or (None, None)
                first, last = place(c), place(None if c is None or t is None else c + len(t) - 1)
                first, last = first - r.passage_start_t, last - r.passage_start_t
                inside = 0 <= first <= last < len(held)
                want.append((first + r.seq_2_start_t, last + r.seq_2_start_t) if inside else (0, 0))
            assert [tuple(x) for x in r.labels] == want + [(-1, -1)] * (3 - len(want))
