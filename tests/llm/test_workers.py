"""What Python workers hold, as all that wait for a task count as an executor's memory."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from quantloom.llm import bpe
from quantloom.session import SLICE_ROWS, by_slices


def test_bpe_workers_keep_no_codec_after_a_task(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('some words of ', id) AS text").repartition(16)
    assert len(bpe.encode_documents(docs).collect()) == 400

    def held(x: pa.Array) -> pa.Array:
        from quantloom.llm import bpe as there

        return pa.array([len(there._codecs)] * len(x), pa.int64())

    look = spark.range(64).repartition(16).select(F.arrow_udf(held, "long").asNondeterministic()("id").alias("n"))
    assert {r.n for r in look.collect()} == {0}


def test_bpe_keeps_its_results_from_task_to_task(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "CASE WHEN id % 7 = 0 THEN NULL ELSE repeat(concat('wörter ', id % 10, '<|endoftext|>'), 1 + int(id % 5)) END AS text")
    rows = bpe.encode_documents(docs.repartition(3)).collect() + bpe.encode_documents(docs.coalesce(1)).collect()
    codec = bpe.codec(bpe.default_vocabulary())
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == 2000 and all(bytes(r.ids) == codec.encode(text[r.doc_id]) and r.n_tokens == len(r.ids) // 4 and r.decoded == (text[r.doc_id] or "") for r in rows)


def test_slices_are_small_and_in_order():
    seen, over = [], []

    def run(values: list) -> pa.Array:
        seen.append(len(values))
        return pa.array(values, pa.int64())

    batches = [pa.array(range(1000), pa.int64()), pa.array([], pa.int64()), pa.array([None, 1], pa.int64())]
    made = list(by_slices(run, lambda: over.append(len(seen)))(iter(batches)))
    assert pa.concat_arrays(made).to_pylist() == [*range(1000), None, 1]
    assert max(seen) <= SLICE_ROWS and sum(seen) == 1002 and over == [len(seen)]
