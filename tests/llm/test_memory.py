"""What Python workers hold: bounded runs of rows, and freed memory handed back."""

import re
from pathlib import Path

import pyarrow as pa
import pytest
from tessera.llm import best_fit, langid
from tessera.llm.common import few_at_once, lean


def held_mb() -> float:
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def taken_by_spark(df, make):
    """The function that an operator hands to mapInArrow."""
    cls, got = type(df), {}
    own = cls.mapInArrow
    cls.mapInArrow = lambda self, f, schema, *a, **k: got.setdefault("f", f) and own(self, f, schema, *a, **k)
    try:
        make(df)
    finally:
        cls.mapInArrow = own
    return got["f"]


def test_language_id_works_on_bounded_runs_of_rows(spark):
    texts = ["one two three " * 3000, None, "", "eins zwei drei " * 60_000, *["un deux trois " * 3000] * 200]
    model = langid.train([("one two three", "en"), ("eins zwei drei", "de"), ("un deux trois", "fr")])
    predict = taken_by_spark(spark.createDataFrame([(1, "x")], "doc_id long, text string"), lambda df: langid.identify(df, model))
    row = pa.StructArray.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    out = list(predict(iter([pa.RecordBatch.from_arrays([row, pa.array([bool(t) for t in texts])], ["row", "has"])])))
    assert max(b.num_rows for b in out) < 100
    assert [x["doc_id"] for b in out for x in b.column(0).to_pylist()] == list(range(len(texts)))
    assert [x for b in out for x in b.column(1).to_pylist()] == ["en", "und", "und", "de", *["fr"] * 200]


def test_few_at_once_keeps_all_rows():
    batches = [pa.RecordBatch.from_pydict({"x": ["a" * n for n in sizes]}, pa.schema([("x", pa.string())])) for sizes in ([], [5], [0, 0, 900, 1, 2], [300] * 20)]
    runs = list(few_at_once(batches, 1000))
    assert [x for b in runs for x in b.column(0).to_pylist()] == [x for b in batches for x in b.column(0).to_pylist()]
    assert all(b.num_rows for b in runs) and max(b.num_rows for b in runs) <= 5


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from /proc")
def test_packing_gives_back_what_its_worker_freed(spark):
    pins = []

    def work(batches):
        for batch in batches:
            freed = [bytes(60_000) for _ in range(3000)]  # in the heap, below what is mapped alone
            pins.append(bytes(60_000))
            del freed
            yield batch

    def through(f) -> float:
        before = held_mb()
        list(f(iter([pa.RecordBatch.from_pydict({"x": [1]})])))
        return held_mb() - before

    assert through(lean(work)) < 90
    pieces = taken_by_spark(spark.createDataFrame([(1, "x")], "doc_id long, text string"), lambda df: best_fit.token_pieces(df, best_fit.default_tokenizer()))
    assert pieces.__qualname__.startswith("lean")


def test_lean_keeps_the_number_of_tables():
    one, two = pa.table({"x": [1]}), pa.table({"x": [2]})
    assert lean(lambda t: t)(one) is one
    assert lean(lambda a, b: b)(one, two) is two
    assert [lean(f).__code__.co_argcount for f in (lambda t: t, lambda a, b: b)] == [1, 2]
