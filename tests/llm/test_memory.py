"""What a block of op8_ctw holds while its sequences wait to be merged."""

import random

import numpy as np

from lessonlake.llm import ctw


def test_waiting_sequences_are_few(monkeypatch):
    monkeypatch.setattr(ctw, "_PENDING", 1000)
    pick, block = random.Random(2), ctw._Block()
    texts = [bytes(pick.choices(b"abcd ", k=700)) for _ in range(12)]
    for t in texts:
        block.add([t], [False])
        assert sum(map(len, block.grams[1:])) <= 1000
    want, n = np.unique(np.concatenate([ctw.grams([t + b"\n"])[0] for t in texts]), return_counts=True)
    got, m = ctw._merge(block.grams, block.gram_n)
    assert got.tolist() == want.tolist() and m.tolist() == n.tolist()
    assert [len(x) for x in ctw._merge([], [])] == [0, 0]
