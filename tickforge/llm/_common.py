"""Kernels and small helpers shared by the operators of this subpackage.

Text reaches Python as Arrow batches; the kernels here work on the raw UTF-8
buffer of a batch, in slices of half a megabyte, so that no Python object is
made per word or per character and memory stays bounded by ``SLICE_BYTES``.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
#: Text per group when documents are dealt into groups that fit one Python call.
GROUP_BYTES = 8 << 20
#: Rows per Arrow batch where whole texts travel; Spark's 10,000 hold the memory of an executor several times over.
BATCH_ROWS = 1000
#: Up to so many ids (8 bytes each) are broadcast to pick texts; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_rng = np.random.default_rng(20240229)
_ODD = np.uint64(1)
#: A random odd 64-bit value for each byte, and the same with A-Z read as a-z.
BYTE_CODE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + _ODD
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 1))
        for key, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[key] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def trim() -> None:
    """Give freed memory back to the system: workers are reused, and what one stage held should not count in the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: np.ndarray, off: np.ndarray, code: np.ndarray = LOWER_CODE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` and, per word, its document's place in ``off``."""
    if len(buf) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    black = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off[:-1]] = True
    edge = edge[: len(buf)]
    start = black.copy()
    start[1:] &= ~black[:-1] | edge[1:]
    end = black.copy()
    end[:-1] &= ~black[1:] | edge[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = powers(len(buf))
    total = np.empty(len(buf) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(code[buf] * up, out=total[1:])
    h = (total[e] - total[s]) * down[s]
    return mix(h + (e - s).astype(np.uint64)), np.searchsorted(off, s, side="right") - 1


def window_hashes(buf: np.ndarray, length: int) -> np.ndarray:
    """``out[i]`` is the 64-bit hash of ``buf[i:i+length]``; entries past the last whole window mean nothing."""
    n = len(buf)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[buf] * up[:n], out=total[1:])
    out = np.zeros(n, dtype=np.uint64)
    m = n - length + 1
    if m > 0:
        out[:m] = mix((total[length:] - total[:m]) * down[:m])
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (from 0); nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with up to ``limit`` bytes each (a longer document stands alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of an ascending array and the edges of their runs (one more)."""
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return x[start], np.append(start, len(x))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; set here only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tickforge-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, fmt: str = "parquet", **options: object) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).format(fmt).save(path)
    out = df.sparkSession.read.schema(df.schema).format(fmt).load(path)
    out._tickforge_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``written`` made, once nothing reads it any more."""
    path = getattr(df, "_tickforge_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(docs: DataFrame) -> DataFrame:
    """``docs``, dealt anew if its files make fewer tasks than there are cores; tables of many files or splits stay as they are.

    For work that is heavy per text and needs no shuffle of its own: one small file would keep one core busy.
    """
    spark = docs.sparkSession
    files, cores = len(docs.inputFiles()), spark.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return docs if files == 0 or max(files, size // split) >= cores else docs.repartition(2 * cores)


def few_beside(ids: DataFrame) -> DataFrame:
    """Ids to broadcast if there are few enough."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold at most :data:`BATCH_ROWS` rows; a smaller bound stays.  Results do not depend on it."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def group_count(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    """How many groups of about ``group_bytes`` of text the documents make."""
    return max(1, -(-text_bytes(docs) // group_bytes))


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges(a, b)``: ``(node, component)``, component = smallest node.

    Alternates the large-star and small-star steps.  Either step is one
    aggregation (a minimum per node, combined before the shuffle) and one join;
    no neighbourhood is ever gathered.  Each round is written to the shared folder.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(limit):
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("top").alias("top")).where("up + top > 1").isEmpty():
            break  # every node hangs on one root
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        big = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = written(small, "edges")
        forget(edges)
        edges = new
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
