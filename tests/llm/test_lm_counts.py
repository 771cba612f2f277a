"""Words and sums of op4_lm are taken in few passes."""

from collections import Counter

import numpy as np

from braidwork.llm import lm


def test_words_are_counted_before_they_leave_a_task(spark, monkeypatch):
    monkeypatch.setattr(lm, "COUNTED", 20)  # several stretches in a batch
    texts = [None, "", " \t\n", "A a\x0bB\x0cc\r\nD", "É é x\x1cy z", "word " * 30, "a\x00b a"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    taught = [r.text for r in docs.where(lm.training()).collect()]
    counts = lm.word_counts(docs)
    want = Counter(w for t in taught for w in (t or "").encode().lower().split())
    assert {r.word.encode(): r.n for r in counts.collect()} == want
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()


def test_a_word_is_looked_up_once():
    class Word(bytes):
        asked = 0

        def __hash__(self):
            Word.asked += 1
            return super().__hash__()

    places = lm.Places({b"sent": 0})
    words = [Word(w) for w in (b"sent", b"new", b"new", b"sent", b"other")]
    assert list(map(places.__getitem__, words)) == [0, 1, 1, 0, 2] and list(places) == [b"sent", b"new", b"other"]
    assert Word.asked == len(words) + 2  # once more where one is added


def test_sums_by_row():
    rng = np.random.default_rng(3)
    at, values = rng.integers(0, lm.VOCAB, 500), rng.normal(size=(500, 5))
    want = np.zeros((lm.VOCAB, 5))
    np.add.at(want, at, values)
    assert np.allclose(lm._added(lm.VOCAB, at, values), want)
    assert not lm._added(lm.VOCAB, at[:0], values[:0]).any()


def test_what_is_kept_of_words_not_sent(spark, monkeypatch):
    tables, write = {}, lm.written
    monkeypatch.setattr(lm, "START", 20)
    monkeypatch.setattr(lm, "SENT", 3)  # most words are looked up in the table of counts
    monkeypatch.setattr(lm, "written", lambda df, name: tables.setdefault(name, write(df, name)))
    rows = [(i, f"the sea and the shore {i % 9} w{i} " * (i % 4)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    some = {r.doc_id: r.score for r in lm.report(docs).collect()}
    # The model's digits come in single precision, so no more of them is moved.
    assert dict(tables["lm-scores"].dtypes)["model"] == "array<float>"
    assert tables["lm-scores"].where("size(rest) > 0").count() > 20
    assert all(".zstd." in f for t in tables.values() for f in t.inputFiles())
    monkeypatch.setattr(lm, "SENT", 1 << 16)
    every = {r.doc_id: r.score for r in lm.report(docs).collect()}
    assert max(abs(some[i] - every[i]) for i, _ in rows) < 1e-4
