"""One very long text costs time in proportion to its length."""

import time

from driftmesh.llm import lines


def test_many_lines_in_one_text(spark):
    shared = "a line that three documents hold in common"
    text = "\n".join(f"line {k} of the long one" if k % 2 else shared for k in range(100_000))
    rows = [(1, text), (2, shared), (3, shared)]
    lines.dedup_lines(spark.createDataFrame(rows[1:], "doc_id long, text string")).collect()  # so that only the work is timed
    begin = time.perf_counter()
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.perf_counter() - begin < 30
    assert (got[1]["n_lines"], got[1]["n_dropped"]) == (100_000, 50_000)
    assert got[1]["text"] == "\n".join(f"line {k} of the long one" for k in range(1, 100_000, 2))
