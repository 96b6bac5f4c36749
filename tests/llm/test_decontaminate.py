"""Decontamination: awkward rows, repeated items, and an index of bounded size."""

import random
import resource
import time

import numpy as np
import pytest

pytest.importorskip("quillon.llm")

from quillon.llm import decontaminate  # noqa: E402


@pytest.mark.parametrize("slice_bytes", [1 << 20, 10])
def test_awkward_rows(spark, slice_bytes):
    passage = " ".join(f"w{i}" for i in range(12))
    long = ("filler words " * 50_000) + passage + " end" + " tail" * 50_000
    rows = [(1, long), (2, passage), (2, passage), (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(9))), (6, "w3 " + passage.upper())]
    docs = spark.createDataFrame([(k, t, "a", "b", "c", 1) for k, t in rows], "doc_id long, text string, row string, hits string, item string, n_words int")
    bench = spark.createDataFrame([("a", passage, "x"), ("a", passage, "x"), ("b", passage, "y"), (None, "w1 w2 w3", "z"), ("n", None, "z")], "item_id string, text string, key string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.report(docs, bench, slice_bytes=slice_bytes).collect())
    assert got == [(1, 150_013, 12, 3), (2, 12, 12, 3), (2, 12, 12, 3), (3, 0, 0, 0), (4, 0, 0, 0), (5, 9, 3, 1), (6, 13, 12, 3)]
    clean = decontaminate.keep_clean(docs, bench, slice_bytes=slice_bytes)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4]
    one = decontaminate.find(docs, bench.where("item_id = 'b'"), slice_bytes=slice_bytes).where("doc_id = 6").first()
    assert (one["hits"], one["items"]) == (list(range(1, 13)), ["b"])


def test_index_of_a_full_slice():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(200)) for _ in range(6990)]
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    index = decontaminate.Index([str(i) for i in range(len(texts))], texts, 10, 5, np.zeros(decontaminate.SLOTS, np.int64))
    assert time.process_time() - began < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400 * 1024
    assert len(index.windows.size) > 1_300_000
