"""Operator 2: exact top-k inner products, vectors in descending order of length.

Vectors are cut into blocks by quantiles of their length, longest first, a block
of very many equal lengths being split by a hash; queries are cut into blocks
too.  A first pass over the block of the longest vectors gives each query a
threshold, its k-th best score so far.  Further passes take twice as many blocks as
all before; a query goes only to blocks whose longest vector can reach its
threshold by Cauchy-Schwarz, ``|q| |v|``, and what no query needs is not sent.  A pair of
blocks is one bounded task.  In it the same bound ends the descending scan;
partial sums over the leading axes of an SVD rotation, plus the product of the
residual lengths, discard most of the rest; what remains is scored exactly
in integers, and the threshold rises.  Bounds are widened by more than the rounding error, and ties
are kept, so the result is exact.

The rotation is fitted on at most ``ROTATION_SAMPLE`` vectors (smallest hashes of
their ids); it decides only how much is pruned.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part; vectors of another dimension are compared among
themselves only; a ``vec_id`` that comes more than once counts once, with the
smallest vector, and a null ``vec_id`` not at all; a query with fewer candidates than k gets all; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.llm._common import written

BLOCK = 65_536
QUERY_BLOCK = 16_384
ROTATION_SAMPLE = 20_000
LEADING = 16
_TILE_Q, _TILE_V = 512, 4096
_FOUND = "query_id long, vec_id long, score long"


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return (np.concatenate(flat) if flat else np.empty(0, np.int64)).astype(np.int64).reshape(-1, dim)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All inner products, exactly: in doubles while every partial sum fits, else in 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    return (q.astype(float) @ v.T.astype(float)).astype(np.int64) if most < 2**52 else q @ v.T


_NONE = np.int64(-(2**63))


def block_top(query_id: np.ndarray, q: np.ndarray, floor: np.ndarray, vec_id: np.ndarray, v: np.ndarray, k: int, rotation: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The best ``k`` of the vectors ``v`` for each query, less those that cannot reach the query's ``floor``."""
    length = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    order = np.lexsort((vec_id, -length))
    vec_id, v, length = vec_id[order], v[order], length[order]
    lead = min(LEADING, v.shape[1])
    turned = v.astype(float) @ rotation
    head, rest = turned[:, :lead], np.sqrt((turned[:, lead:] ** 2).sum(axis=1))
    head = np.concatenate([head, rest[:, None]], axis=1)  # the bound is one product: leading sums plus the product of the residual lengths
    out = []
    for a in range(0, len(query_id), _TILE_Q):
        ids, part, least = query_id[a : a + _TILE_Q], q[a : a + _TILE_Q], floor[a : a + _TILE_Q].copy()
        long_q = np.sqrt((part.astype(float) ** 2).sum(axis=1))
        turned_q = part.astype(float) @ rotation
        head_q = np.concatenate([turned_q[:, :lead], np.sqrt((turned_q[:, lead:] ** 2).sum(axis=1, keepdims=True))], axis=1)
        best_s = best_q = best_v = np.empty((0,), np.int64)
        for b in range(0, len(vec_id), _TILE_V):
            slack = 1.0 + 1e-9 * long_q * length[b]
            alive = np.flatnonzero(long_q * length[b] + slack >= least)
            if not len(alive):
                break  # every later vector is shorter still
            w = slice(b, b + _TILE_V)
            need = (least[alive] - slack[alive])[:, None]
            may = head_q[alive] @ head[w].T >= need
            n_may = np.count_nonzero(may)
            if not n_may:
                continue
            own = np.searchsorted(ids_sorted := np.sort(vec_id[w]), ids[alive])
            mine = np.flatnonzero(ids_sorted[np.minimum(own, len(ids_sorted) - 1)] == ids[alive])  # queries that are candidates of this tile themselves
            for i in mine.tolist():
                may[i] &= vec_id[w] != ids[alive[i]]
            if n_may > may.size // 64:  # exact scores of the whole tile, of which only the best k a query go on
                score = np.where(may, _exact(part[alive], v[w]), _NONE)
                if score.shape[1] > k:
                    bar = np.maximum(least[alive], np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
                else:
                    bar = least[alive]
                row, col = np.nonzero((score >= bar[:, None]) & (score > _NONE))
                score = score[row, col]
            else:
                row, col = np.nonzero(may)
                score = np.concatenate([np.empty(0, np.int64), *((part[alive[row[i : i + 65536]]] * v[b + col[i : i + 65536]]).sum(axis=1) for i in range(0, len(row), 65536))])
                some = score >= least[alive[row]]
                row, col, score = row[some], col[some], score[some]
            if not len(row):
                continue
            best_q, best_v, best_s = np.append(best_q, alive[row]), np.append(best_v, vec_id[b + col]), np.append(best_s, score)
            keep = np.lexsort((best_v, -best_s, best_q))
            best_q, best_v, best_s = best_q[keep], best_v[keep], best_s[keep]
            start = np.flatnonzero(np.append(True, best_q[1:] != best_q[:-1]))
            rank = np.arange(len(best_q)) - np.repeat(start, np.diff(np.append(start, len(best_q))))
            ok = rank < k
            kth = rank == k - 1
            least[best_q[kth]] = np.maximum(least[best_q[kth]], best_s[kth])
            best_q, best_v, best_s = best_q[ok], best_v[ok], best_s[ok]
        out.append((ids[best_q], best_v, best_s))
    return out


def _rotation(rows: DataFrame, dim: int, n: int) -> np.ndarray:
    """Right singular vectors of a bounded sample, by way of its Gram matrix."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(pa.chunked_array([batch.column(0)]), dim).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    # a bound on the hash lets about twice the sample through, so little is ordered at any size
    bound = min(1.0, 2 * ROTATION_SAMPLE / n) * float(1 << 63)
    sample = rows.select("v", F.xxhash64("vec_id").alias("h")).where(F.shiftrightunsigned("h", 1) <= bound).orderBy("h").limit(ROTATION_SAMPLE).select("v")
    total = sum((np.frombuffer(bytes(r.m)).reshape(dim, dim) for r in sample.mapInArrow(gram, "m binary").collect()), np.zeros((dim, dim)))
    return np.linalg.svd(total)[0] if np.isfinite(total).all() else np.eye(dim)


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5, block: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Best ``k`` candidates of each query: ``(query_id, rank, vec_id, score)``.

    ``vectors(vec_id long, v array<long>)`` holds integer vectors; ``is_query`` is a
    predicate on ``vec_id``.  A query is not its own candidate.
    """
    rows = written(vectors.where("vec_id is not null and size(v) > 0").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "vectors")
    dims = [(r.dim, r["count"]) for r in rows.groupBy("dim").count().orderBy("dim").collect()]
    if not dims:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = [_one_dimension(rows.where(F.col("dim") == d).select("vec_id", "v"), d, n, is_query, k, block or min(BLOCK, max(2048, n // 32)), query_block) for d, n in dims]
    best = reduce(DataFrame.unionAll, found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_dimension(rows: DataFrame, dim: int, n: int, is_query: Column, k: int, block: int, query_block: int) -> DataFrame:
    turn = _rotation(rows, dim, n)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("norm", norm)
    cuts = max(1, n // block)
    edges = rows.agg(F.percentile_approx("norm", [i / cuts for i in range(1, cuts)], 100_000)).first()[0] if cuts > 1 else []
    edges = np.unique(np.array(edges, dtype=float))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = len(edges) - np.searchsorted(edges, batch.column(2).to_numpy(), side="left")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=["vec_id", "v", "norm", "q"])

    numbered = rows.mapInArrow(number, "vec_id long, v array<long>, norm double, q int")
    parts, first = {}, 0
    for r in numbered.groupBy("q").count().orderBy("q").collect():  # a row per block
        parts[r.q] = (first, -(-r["count"] // block))
        first += parts[r.q][1]
    lookup = np.array([parts.get(i, (0, 1)) for i in range(len(edges) + 1)], dtype=np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size = lookup[batch.column(3).to_numpy()].T
            h = batch.column(2).to_numpy().astype(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((start + (h % size.astype(np.uint64)).astype(np.int64)).astype(np.int32)), batch.column(4)], names=["vec_id", "v", "cb", "n2"])

    hashed = numbered.select("vec_id", "v", F.xxhash64("vec_id").bitwiseAND(F.lit(2**62 - 1)).alias("norm"), "q", F.col("norm").alias("n2"))
    placed = written(hashed.mapInArrow(place, "vec_id long, v array<long>, cb int, n2 double"), "placed")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.sqrt("norm").alias("length"))
    query_cuts = max(1, -(-queries.count() // query_block))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])
        got = block_top(right.column("query_id").to_numpy(), _matrix(right.column("q"), dim), right.column("floor").to_numpy(), left.column("vec_id").to_numpy(), _matrix(left.column("v"), dim), k, turn)
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*got)], names=["query_id", "vec_id", "score"])

    def grid(candidates: DataFrame, asked: DataFrame, low: int) -> DataFrame | None:
        """Each block of queries with each block of vectors down to the last that one of its queries needs; ``asked`` has that number as ``last``."""
        needs = sorted(((r["last"], r.qb) for r in asked.groupBy("qb").agg(F.max("last").alias("last")).collect()), reverse=True)  # a row per block of queries
        if not needs:
            return None
        spark = asked.sparkSession
        place_of = spark.createDataFrame([(qb, i) for i, (_, qb) in enumerate(needs)], "qb int, place int")
        asking = np.searchsorted(-np.array([x for x, _ in needs]), -np.arange(low, needs[0][0] + 1), side="right")
        served = spark.createDataFrame([(low + i, int(c)) for i, c in enumerate(asking)], "cb int, asking int")
        # the blocks of queries are numbered by what they need, so those that need a block of vectors are the first ones
        left = candidates.join(F.broadcast(served), "cb").select("vec_id", "v", "cb", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("qb"))
        right = asked.where(F.col("last") >= low).join(F.broadcast(place_of), "qb").select("query_id", "q", "floor", F.col("place").alias("qb"), F.explode(F.sequence(F.lit(low), F.col("last"))).alias("cb"))
        return left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(best, _FOUND)

    dealt = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(query_cuts)).cast("int")
    head = grid(placed.where("cb = 0").drop("n2"), queries.withColumns({"floor": F.lit(int(_NONE)), "qb": dealt, "last": F.lit(0)}), 0)
    if head is None:
        return rows.sparkSession.createDataFrame([], _FOUND)
    head = written(head, "top")
    # further passes over twice as many blocks each: the thresholds rise from pass to pass, and what they rule out is never sent
    longest = np.zeros(first)
    for r in placed.groupBy("cb").agg(F.max("n2").alias("n2")).collect():  # a row per block
        longest[r.cb] = np.sqrt(r.n2)
    longest = np.maximum.accumulate(longest[::-1])[::-1]
    low, parts_found = 1, [head]
    while low < first:
        high = min(first, 3 * low)
        kth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        top = reduce(DataFrame.unionAll, parts_found).withColumn("k", kth).where(F.col("k") == k).select("query_id", F.col("score").alias("floor"))
        until = high - 1

        def reach(batches: Iterator[pa.RecordBatch], until: int = until) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size, least = batch.column(2).to_numpy(), batch.column(3).to_numpy().astype(float)
                # |q| |v| reaches the threshold down to this block; rounding is allowed for
                need = (least - 1 - 1e-9 * np.abs(least)) / np.maximum(size, 1e-300) * (1 - 1e-9)
                last = np.where(least <= 0, until, np.clip(len(longest) - np.searchsorted(longest[::-1], need, side="left") - 1, -1, until))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(last.astype(np.int32))], names=["query_id", "q", "length", "floor", "last"])

        asked = queries.join(top, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(int(_NONE))))
        asked = asked.mapInArrow(reach, "query_id long, q array<long>, length double, floor long, last int").where(F.col("last") >= low)
        asked = written(asked.withColumn("qb", dealt), "asked")
        more = grid(placed.where(f"cb >= {low} and cb < {high}").drop("n2"), asked, low)
        if more is not None:
            parts_found.append(written(more, "top"))
        low = high
    return reduce(DataFrame.unionAll, parts_found)


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, v)`` with ``v = floor(scale * x)`` per component, x as double; unusable vectors are left out."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.col("embedding").isNotNull() & F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", doubles.alias("d")).where(usable).select("vec_id", F.transform("d", lambda x: F.floor(x * scale).cast("long")).alias("v"))
