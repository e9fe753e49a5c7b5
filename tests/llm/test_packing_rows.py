"""Operator 2: the piece tokenizer against the tokenizer itself, repeated rows, extra columns."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import TaskContext
from pyspark.sql import functions as F

from meshloom.llm import packing
from test_llm import pieces_ok


@pytest.fixture(scope="module")
def tok():
    return packing.PieceTokenizer(packing.default_tokenizer(), limit=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abIZ19 .,!'<|>\t\n\x0b\x1c\x00é…́ 　ß中😀-", max_size=40), min_size=1, max_size=5))
def test_pieces_give_the_tokenizers_ids(tok, texts):
    want = [tok.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tok.encode([t.encode() for t in texts])] == want


@pytest.mark.parametrize("t", ["<|endoftext|>", "a<|startoftext|>b", "don't we'll I'M x'S", "a--b...c", "1234 a1b2", "ÀÉ, naïve. “q”", "A.B.C.", ""])
def test_hard_words(tok, t):
    assert tok.encode([t.encode()])[0].tolist() == tok.tok.encode(t, add_special_tokens=False).ids


def test_table_keeps_what_collides():
    t = packing._Table(8)
    key = np.array([5, 5 + t.mask + 1, 5 + 2 * (t.mask + 1), t.mask, 6], np.uint64)
    t.add(key, key * np.uint64(3), np.arange(10, dtype=np.uint32), np.array([2, 0, 3, 4, 1], np.int32))
    slots = t.find(key, key * np.uint64(3))
    assert [t.of(slots[i:i + 1]).tolist() for i in range(5)] == [[0, 1], [], [2, 3, 4], [5, 6, 7, 8], [9]]
    assert (t.find(key, key) < 0).all()


def test_repeated_rows_and_extra_columns(spark):
    rows = [(1, "some words here"), (1, "some words here"), (1, "others"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("start", "length", "offset")})
    out = packing.pack(docs, packing.default_tokenizer()).collect()
    n = [len(packing.tokenizer(packing.default_tokenizer()).encode([t.encode()])[0]) + 1 for _, t in rows]
    assert sum(r.length for r in out) == sum(n) and sum(r.length for r in out if r.doc_id is None) == n[3]
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    one = packing.pack(docs.where("text = 'others'"), packing.default_tokenizer()).collect()
    pieces_ok(one, {1: "others"}, packing.tokenizer(packing.default_tokenizer()).tok)


def test_a_batch_is_taken_in_slices(monkeypatch):
    """24 MB of texts in one batch: what a task holds is no multiple of a batch."""
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    text = " ".join(f"w{i % 97}" for i in range(2000))
    n = 24_000_000 // len(text)
    batch = pa.record_batch({"doc_id": list(range(n)), "text": [text] * n})
    run = packing._run(packing.default_tokenizer(), packing.CAPACITY, 1000)
    packing.tokenizer(packing.default_tokenizer(), 1000)
    tracemalloc.start()
    try:
        rows = pa.Table.from_batches(list(run(iter([batch]))))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(set(rows["doc_id"].to_pylist())) == n
    assert peak < 80e6
