"""What the stages hold at once has bounds in bytes, whatever the length of documents."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import common, packing


def test_batches_are_bounded_in_bytes(spark):
    session = spark.newSession()
    corpus_pipeline.in_small_batches(session)
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{corpus_pipeline.BATCH_BYTES}b"
    assert session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(corpus_pipeline.BATCH_ROWS)
    assert session.conf.get("spark.sql.parquet.columnarReaderBatchSize") == str(corpus_pipeline.READ_ROWS)
    other = spark.newSession()
    other.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    corpus_pipeline.in_small_batches(other)
    assert other.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"


@pytest.mark.parametrize("with_ids", [True, False])
def test_packing_gives_memory_back_after_each_block(monkeypatch, with_ids):
    """A batch of 5 MB is encoded about a megabyte at a time; the pieces are those of the texts by themselves."""
    code, sizes, freed = packing.encoder("word_bpe_49k.json"), [], []
    encode = code.encode
    monkeypatch.setattr(code, "encode", lambda texts: (sizes.append(sum(map(len, texts.to_pylist()))), encode(texts))[1])
    monkeypatch.setattr(common, "give_back", lambda: freed.append(len(sizes)))
    texts = [f"word{k % 90} " * 2_000 for k in range(300)] + [None, "", "x " * 900_000]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t or "" for t in texts])], ["doc_id", "text"])
    got = pa.Table.from_batches(packing.cut_blocks(iter([rows]), code, 2048, 1, with_ids))
    assert freed == list(range(1, len(sizes) + 1)) and len(sizes) > 4
    assert all(n <= common.BLOCK for n in sizes[:-1])
    whole = got.group_by("doc_id").aggregate([("length", "sum"), ("doc_tokens", "max")]).sort_by("doc_id")
    assert whole["doc_id"].to_pylist() == list(range(len(texts)))
    assert np.array_equal(whole["length_sum"], whole["doc_tokens_max"])
    assert whole["doc_tokens_max"].to_pylist() == [len(encode(pa.array([t or ""]))[0]) + 1 for t in texts]
