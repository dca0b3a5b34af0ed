"""What Spark hands to a Python worker at a time, and what the worker keeps."""

import pyarrow as pa

from flowtide.llm import queries, text


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    """2,000 texts of 20 KB went as one batch of 40 MB."""
    queries.bound_batches(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    docs = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat('0123456789', 2000) AS text")
    found = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in found) == 2000
    assert max(r.bytes for r in found) < 2 * queries.BATCH_BYTES


def test_a_task_gives_memory_back_at_its_end(monkeypatch):
    calls, pool = [], pa.system_memory_pool()

    class Pool:
        def release_unused(self):
            calls.append(1)
            pool.release_unused()

    monkeypatch.setattr(text.pa, "default_memory_pool", Pool)
    task = text.released(lambda batches: (b for b in batches))
    rows = task(iter([1, 2]))
    assert next(rows) == 1 and not calls
    assert list(rows) == [2] and calls == [1]
