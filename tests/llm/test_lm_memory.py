"""What a task of op4_lm holds at a time."""

import os
from types import SimpleNamespace

import numpy as np

from braidwork.llm import lm


def test_only_a_stretch_of_texts_is_held(monkeypatch):
    made = []

    class Value:
        def __init__(self, text):
            self.text = text

        def as_py(self):
            made.append(self.text)
            return self.text

    monkeypatch.setattr(lm, "SLICE", 5)
    texts = ["A b c d e f", None, "g h", "i j k l", "m"]
    cut = SimpleNamespace()
    steps = lm.Cut.slices(cut, list(map(Value, texts)))
    assert next(steps) == (0, [[b"a", b"b", b"c", b"d", b"e", b"f"]]) and made == texts[:1]
    assert next(steps) == (1, [[], [b"g", b"h"], [b"i", b"j", b"k", b"l"]]) and made == texts[:4]
    assert list(steps) == [(4, [[b"m"]])]


def test_the_tokenizer_keeps_to_its_task(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    with open(lm.TOKENIZER, encoding="utf-8") as f:
        _, encode = lm.encoder(f.read())
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    ids, sizes = encode([b"one", b"two"])
    assert len(sizes) == 2 and np.sum(sizes) == len(ids)
