"""Repeat removal: what a task sends."""

import numpy as np

from liftlake.llm import spans

from . import brute
from .conftest import frame


def test_sent_keys_lie_in_few_parts():
    rng, sent, plain = np.random.default_rng(1), spans._Sent(), {}
    for _ in range(300):
        key, doc = rng.integers(0, 5000, 40).astype(np.uint64), rng.integers(0, 99, 40)
        assert sent.smaller(key, doc).tolist() == [plain.get(k, 99) < d for k, d in zip(key.tolist(), doc.tolist())]
        sent.add(key, doc)
        for k, d in zip(key.tolist(), doc.tolist()):
            plain[k] = min(d, plain.get(k, 99))
    assert len(sent.parts) < 14 and all(2 * len(b[0]) < len(a[0]) for a, b in zip(sent.parts, sent.parts[1:]))


def test_a_task_sends_a_hot_window_once(spark, monkeypatch):
    monkeypatch.setattr(spans, "_SLICE", 100)       # a text a slice
    text = " ".join(f"word{i}" for i in range(30))
    docs = frame(spark, [text] * 40).coalesce(1)
    every = np.full(1 << (spans.BITMAP_BITS - 3), 255, np.uint8)
    rows = spans.contexts(docs, every, every, 50, 16).where("place % 128 = 1").collect()
    assert len(rows) == len(text) - 49 and {r.doc_id for r in rows} == {0}
    got = spans.remove_repeats(docs, hot_slices=2).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute.repeats([(i, text) for i in range(40)])
