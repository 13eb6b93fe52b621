"""Operator 4: sum-of-squares packing of token sequences.

Documents are encoded in one narrow pass; only the lengths of their pieces
(tens of bytes a piece) are shuffled.  Pieces are dealt evenly into groups of
bounded size by a hash of a unique row number, and each group is packed by the
sum-of-squares rule: a piece goes to the open bin (or a new one) for which
the sum of the squared counts of open bins per residual gap becomes smallest.
Sequences that stay badly filled are opened again and packed anew in fewer
groups, until one group holds them or a round fills too few (as with pieces of 1,100
tokens, of which no two fit together).  Then each group, of about ``group_rows`` pieces
still, also tries them longest first, by the same rule, and keeps the packing with the
fewest bins.  No group ever grows beyond that size, whatever the lengths.

Defined cases: null and empty texts are documents of the end id alone; repeated
rows are documents of their own; an empty table gives no row; columns other
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm._common import spread, trim, written
from tickforge.llm.tokens import encoder, public_file

CAPACITY = 2048
#: Pieces per group of one packing task.
GROUP_ROWS = 40_000
_PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Encode every whole text and cut those over ``capacity`` ids; the first piece takes the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_file)
        for batch in batches:
            out: list[tuple] = []
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.append(enc.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                ends = range(first, len(ids) + 1, capacity)
                start = 0
                for k, end in enumerate(ends):
                    out.append((row, doc, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start = end
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["row_id", "doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    rows = spread(docs).select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, _PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, placed in the given order by the sum-of-squares rule.

    ``count[g]`` is the number of open bins with residual gap ``g``; closed bins
    (gap 0) count for nothing.  Among equal sums the smallest gap wins.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        # change of the sum, halved: -count[s] for a perfect fit (plus 1/2), count[g - s] - count[g] + 1 for gap g, count[capacity - s] + 1/2 for a new bin
        change = count[1 : capacity - s] - count[s + 1 : capacity]
        best, gap = 2 * int(count[capacity - s]) + 1 if s < capacity else 0, capacity
        if len(change):
            g = int(change.argmin())
            c = 2 * int(change[g]) + 2
            if count[s + 1 + g] and c <= best:
                best, gap = c, s + 1 + g
            elif c <= best:
                held = np.flatnonzero(count[s + 1 : capacity])
                if len(held):
                    g = int(held[change[held].argmin()])
                    if (c := 2 * int(change[g]) + 2) <= best:
                        best, gap = c, s + 1 + g
        if s < capacity and count[s] and 1 - 2 * int(count[s]) <= best:
            gap = s
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def polished(lengths: np.ndarray, bins: np.ndarray, offsets: np.ndarray, capacity: int, full: float) -> tuple[np.ndarray, np.ndarray]:
    """The same packing with its badly filled bins packed anew, longest first, if that needs fewer."""
    used = np.bincount(bins, weights=lengths)
    loose = np.flatnonzero(used[bins] < full * capacity)
    if not len(loose):
        return bins, offsets
    loose = loose[np.argsort(-lengths[loose], kind="stable")]
    new, at = sum_of_squares(lengths[loose], capacity)
    if new.max() + 1 >= (used < full * capacity).sum():
        return bins, offsets
    bins, offsets = bins.copy(), offsets.copy()
    bins[loose], offsets[loose] = new + len(used), at
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, full: float = 0.995) -> DataFrame:
    """Give each row of ``pieces(row_id, piece, length, …)`` a ``sequence_id`` and an ``offset``.

    A group places its pieces in corpus order, as the rule is an online one
    (descending order measured slightly worse).  Bins filled below ``full`` go to
    the next round; the groups of the last round try them again longest first.  A round
    that closes less than three in ten pieces makes the next one the last, so the number of
    rounds is the logarithm of the group count at most.
    """
    keys = ["row_id", "piece", "length"]
    schema = "row_id long, piece int, length long, sequence_id long, offset long, done boolean"

    def packed(first: int, last: bool):
        def one(key: tuple, table: pa.Table) -> pa.Table:
            length = table.column("length").to_numpy()
            order = np.lexsort((table.column("piece").to_numpy(), table.column("row_id").to_numpy()))
            bins, offsets = sum_of_squares(length[order], capacity)
            if last and len(bins):
                bins, offsets = polished(length[order], bins, offsets, capacity, full)
            used = np.bincount(bins, weights=length[order]) if len(bins) else np.zeros(0)
            done = np.full(len(bins), True) if last else used[bins] >= full * capacity
            name = (np.int64(first) + np.int64(key[0].as_py())) * np.int64(1 << 24) + bins
            t = table.select(keys).take(pa.array(order))
            return pa.table([t.column(0), t.column(1), t.column(2), pa.array(name), pa.array(offsets), pa.array(done)], names=[*keys, "sequence_id", "offset", "done"])

        return one

    rest, parts, first = pieces.select(*keys), [], 0
    n, last = rest.count(), False
    while True:
        groups = max(1, -(-n // group_rows))
        last = last or groups == 1
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("row_id", "piece"), F.lit(groups)))
        out = written(dealt.groupBy("g").applyInArrow(packed(first, last), schema), "packed")
        parts.append(out.where("done"))
        if last:
            break
        first += groups
        rest = out.where("not done").select(*keys)
        left = rest.count()
        last, n = left > 0.7 * n, left
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionAll(p)
    return pieces.join(placed.drop("done", "length"), ["row_id", "piece"])


def pack_documents(docs: DataFrame, tokenizer_file: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Encode, cut and pack ``docs(doc_id, text)``; one row per piece."""
    pieces = written(token_pieces(docs, tokenizer_file or public_file("byte_bpe_50k.json"), capacity=capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
