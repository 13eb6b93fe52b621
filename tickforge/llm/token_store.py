"""Operator 7: token ids in ORC files, in ascending order of the document id.

The documents are range-partitioned and sorted first, so that encoding runs
once, after the shuffle, and each task writes one ascending run of ids.  ORC
stores the ids by integer run-length encoding, keeps row indexes for every
``row_index_stride`` rows and Bloom filters on ``doc_id``; a reader can thus
take stripes in parallel and skip those without a wanted document.  Within a
file every row knows its offset in the file's run; the starts of the files are
a running sum over one row per file.

Defined cases: null and empty texts give the end id alone; repeated rows are
stored as often as they come, rows with equal ids in any order; rows whose id is null come first; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.llm._common import shared_dir, trim, written
from tickforge.llm.tokens import encoder, public_file

_STORED = "doc_id long, part int, local_start long, ids array<int>"
#: A file holds about so many rows, or fewer if their texts are long.
ROWS_PER_FILE, BYTES_PER_FILE = 20_000, 64 << 20
#: Up to so many files their starts (16 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_FILES = 1_000_000


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 1, stripe_bytes: int = 16 << 20, row_index_stride: int = 1000, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Encode ``docs(doc_id, text)`` and write one ORC file per range of document ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = encoder(tokenizer_file), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                arrays = [np.append(enc.encode(t.as_py() or ""), np.uint32(end_id)) for t in part.column(1)]
                sizes = np.array([len(a) for a in arrays], dtype=np.int64)
                ends = np.cumsum(sizes)
                flat = pa.array(np.concatenate(arrays).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(at + ends - sizes), lists], names=["doc_id", "part", "local_start", "ids"])
                at += int(ends[-1])
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    files = max(1, -(-size.n // rows_per_file), -(-(size.bytes or 0) // BYTES_PER_FILE))
    runs = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    (
        runs.mapInArrow(encode, _STORED)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with ``start``, the number of ids before the document: ``(doc_id, start, ids)``.

    A filter on ``doc_id`` reaches the file statistics, row indexes and Bloom filters.
    """
    stored = spark.read.schema(_STORED).orc(path)
    totals = written(stored.groupBy("part").agg(F.max(F.col("local_start") + F.size("ids")).alias("n")), "starts")
    before = totals.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base"))
    few = totals.count() <= BROADCAST_FILES  # one row per file
    return stored.join(F.broadcast(before) if few else before, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "ids")


def token_digest(tokens: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of rows ``(doc_id, start, ids)``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            off = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder, read the files back and digest them."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_file or public_file("word_bpe_49k.json"))
    return token_digest(read_tokens(spark, path))
