"""Texts of op4_lm are cut into ids once, and its sums hold without a greatest number for each row."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from braidwork.llm import lm


def test_training_and_scores_read_one_table_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "START", 50)
    monkeypatch.setattr(lm, "SLICE", 30)  # stretches within a batch
    tables, write = {}, lm.written
    monkeypatch.setattr(lm, "written", lambda df, name: tables.setdefault(name, write(df, name)))
    rows = [(i, f"some words {i % 7} and rare{i} " * (i % 5)) for i in range(60)] + [(60, None), (61, "")]
    got = {r.doc_id: r for r in lm.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    table = {r.doc_id: r for r in tables["lm-windows"].collect()}
    assert len(got) == len(table) == len(rows)
    for i, text in rows:
        ids = np.frombuffer(table[i].ids, np.int16)
        assert (ids & lm.MARK > 0).sum() == got[i].n_tokens == len((text or "").split()) + 1
        n = len(ids)
        assert table[i].n == (0 if zlib.crc32(str(i).encode()) % 5 == 1 else 1 + max(0, -(-(n - lm.WIDTH) // lm.LAST)))
    taught = tables["lm-windows"].select(F.posexplode("tally")).agg(F.sum("col")).first()[0]
    assert taught == sum(len(r.ids) // 2 for r in table.values() if r.n)


def test_sums_of_exponentials_hold_for_numbers_far_apart():
    z = np.array([[0, 1, 2], [-300, -301, -500], [-300, 5, 7]], np.float32)
    for more in (0, 400):
        want = [np.logaddexp.reduce(r.astype(float)) for r in z + more]
        assert np.allclose(lm._log_sum((z + more).astype(np.float32)), want, rtol=1e-6)
        loss, d = lm._loss((z + more).astype(np.float32), np.array([0, 1, 2]))
        assert np.isclose(loss, sum(w - r[i] for i, (w, r) in enumerate(zip(want, z + more, strict=True))), rtol=1e-5)
        assert np.allclose(d.sum(axis=1), 0, atol=1e-6)
    assert lm._log_sum(np.zeros((0, 3), np.float32)).shape == (0,)
