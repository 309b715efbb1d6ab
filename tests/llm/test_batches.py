"""What Spark hands to the tasks that encode and decode."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from usageweave.llm import byte_bpe


def test_batches_for_python_are_bounded_by_bytes(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    before = spark.conf.get(byte_bpe._BATCH, None)
    spark.conf.unset(byte_bpe._BATCH)
    path = tokenizers.path("byte_bpe_50k.tiktoken")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "rows": [batch.num_rows]})

    try:
        byte_bpe.Bpe(spark, path, tokenizers.PATTERN)
        rows = spark.range(0, 3000, 1, 1).withColumn("ids", F.repeat(F.lit("ids "), 3000))
        found = rows.mapInArrow(sizes, "bytes long, rows long").collect()
        assert sum(r.rows for r in found) == 3000
        assert max(r.bytes for r in found) < 2 * byte_bpe.BATCH_BYTES
        # A session that has its own bound keeps it.
        spark.conf.set(byte_bpe._BATCH, "1m")
        byte_bpe.Bpe(spark, path, tokenizers.PATTERN)
        assert spark.conf.get(byte_bpe._BATCH) == "1m"
    finally:
        if before is None:
            spark.conf.unset(byte_bpe._BATCH)
        else:
            spark.conf.set(byte_bpe._BATCH, before)


def test_decoding_needs_no_vocabulary(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    bpe = byte_bpe.Bpe(spark, path, tokenizers.PATTERN)
    assert bpe._tokens.value == byte_bpe.Vocabulary.of_ranks(byte_bpe.read_ranks(path)).tokens
    docs = spark.createDataFrame([(1, "Some text, é中 "), (2, None)], "doc_id int, text string")
    found = bpe.decode(bpe.encode(docs)).orderBy("doc_id").collect()
    assert [bytes(r.bytes) for r in found] == [t.encode() for t in ("Some text, é中 ", "")]
