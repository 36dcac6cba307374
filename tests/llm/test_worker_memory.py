"""What Python workers hold: an executor's memory is its heap and these, so they are kept few and small."""

import tracemalloc

import pyarrow as pa
import pytest

from folioflow.llm import decontaminate
from folioflow.llm.encoding import default_path, encoder


@pytest.mark.parametrize("most", [100_000, 0])
def test_spans_are_found_and_cut_in_one_pass(spark, most):
    docs = spark.createDataFrame([(1, "It was: a B c, Really.", "x"), (2, "nothing here", "y"), (3, None, "z"), (4, "a b c", "a")], "doc_id long, text string, runs string")
    out = decontaminate.decontaminate(docs, spark.createDataFrame([(7, "a b c")], "item_id long, text string"), most_windows=most)
    # Two Python operators in a stage are two workers for each of its tasks.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {tuple(r) for r in out.collect()} == {(1, "It was: , Really.", "x"), (2, "nothing here", "y"), (3, None, "z"), (4, "", "a")}


def test_encoding_holds_a_bounded_multiple_of_the_text():
    enc = encoder(default_path())
    texts = [" ".join(f"word {i % 97} of line {j % 89}, and so on." for j in range(40)) for i in range(2000)]
    column = pa.array(texts)
    want = enc.many(column)  # pieces are known from here on
    assert want[:5] == [e.tobytes() for e in enc.ids(enc.tokenizer, texts[:5])]
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        assert enc.many(column) == want
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pa.total_allocated_bytes() <= arrow + column.nbytes
    assert peak < 8 * column.nbytes, peak / column.nbytes
