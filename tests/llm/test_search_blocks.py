"""What op1_search goes through: texts once, and only blocks that can hold a result."""

import numpy as np

from braidwork.llm import search


def test_texts_are_cut_once_however_many_sets_of_queries_there_are(spark, monkeypatch):
    names, write = [], search.written
    monkeypatch.setattr(search, "written", lambda df, name: names.append(name) or write(df, name))
    monkeypatch.setattr(search, "PAIRS", 3)
    docs = spark.createDataFrame([(i * 50, f"one two w{i % 3} w{i}") for i in range(6)], "doc_id long, text string")
    assert search.report(docs).count() == 36
    assert names.count("search-documents") == 1 and names.count("search-found") > 2


def test_blocks_below_the_least_score_are_not_multiplied(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    texts = [" ".join(f"{'ab'[i % 2]}{(i + j) % 20}" for j in range(12)) for i in range(64)]
    parts = [search._terms(t) for t in texts]
    terms = np.unique(np.concatenate([p[0] for p in parts]))
    shard = search.Shard(terms, np.ones(len(terms)), 12.0)
    for i, t in enumerate(texts):
        shard.add(i, t)
    shard.seal()
    met, matrix = [], shard.matrix

    class Spy:
        shape = matrix.shape

        def __getitem__(self, b):
            met.append(b)
            return matrix[b]

    asked = (np.searchsorted(terms, parts[0][0]), parts[0][1])
    every = shard.best([(*asked, 0.0)], 3)[0]
    shard.matrix = Spy()
    assert shard.best([(*asked, every[-1][0])], 3)[0] == every
    assert 0 < len(set(met)) <= shard.blocks // 2 + 1
