"""Operator 8: removal of repeated runs of lines, found by winnowing.

Lines are compared without surrounding white space; blank lines do not count
and stay.  A run of counted lines is long enough if it has ``window`` lines or, being
shorter, ``long`` characters.  A line goes if it lies in a long enough run
that also occurs earlier, in a smaller document or higher up in the same one.

1. Winnowing.  Each line is hashed to 64 bits.  Of every window (the shortest long
   enough runs) the smallest hash is the fingerprint, so equal runs have equal
   fingerprints at equal places, and none is missed.  Neighbouring windows mostly share
   theirs; a document sends each distinct one once to be counted.
2. Join.  Windows whose fingerprint occurs once drop out.  The others are dealt by
   fingerprint, and there each place, named by two further 64-bit hashes of the window's
   lines, is matched with the earliest one; no pairs are made.
3. Extension.  Matches on one diagonal (same two documents, same distance) whose
   windows touch are joined both ways into one run, and the later of the two is deleted.

Hot fingerprints and hot windows (a line or passage that a third of all documents share)
are told by their counts.  At most ``HOT_KEYS`` of them can exist; these are
broadcast, and the earliest places of their windows are minima combined before the
shuffle, so their rows are matched where they lie instead of meeting in one task.

Defined cases: null text stays null and has no lines; rows with equal ids are
told apart by a hash of their text, equal rows count as one; a null id counts as the
smallest; an empty table gives no row; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.llm._common import spread, written

WINDOW, LONG = 3, 200
#: Keys with more than one part in this of all rows are hot, so there are at most this many.
HOT_KEYS = 100_000
#: Up to so many bytes of line flags are broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20
_BLANK = " \t\r\f\x0b"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _keyed(docs: DataFrame) -> DataFrame:
    """``(doc, sub, text)``: ``doc`` and ``sub`` tell rows apart, the id (null: the smallest) and a hash of the text."""
    text = F.col("text").cast("string")
    return spread(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("sub"), text.alias("text"))


def fingerprints(texts: DataFrame, window: int, long: int) -> DataFrame:
    """A row per window: ``(doc, sub, print, k, n, i, later, a, b, lead)``.

    ``k`` is its first counted line, ``n`` its size, ``i`` the number of its first line and ``later`` those of the others unless
    they follow each other; ``a`` and ``b`` name it.  ``lead`` is 1 on the document's first window of the fingerprint, 2 if
    an equal window follows in the document, else 0.
    """
    line = lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(x, F.lit(1)).alias("g"), F.length(x).alias("size"), i.alias("i"))
    hashes = F.transform(F.transform(F.split(F.col("text"), "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK))), line)
    lines = texts.where("text is not null").select("doc", "sub", F.filter(hashes, lambda x: x["size"] > 0).alias("lines"))
    if long > 0:
        lines = lines.where((F.size("lines") >= window) | (F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["size"]) >= long))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            off = lists.offsets.to_numpy().astype(np.int64)
            part = slice(off[0], off[-1])
            h, g, size, at = (lists.values.field(f).to_numpy()[part] for f in ("h", "g", "size", "i"))
            off = off - off[0]
            total = np.append(0, np.cumsum(size.astype(np.int64)))
            row = np.repeat(np.arange(batch.num_rows), np.diff(off))
            found = []
            for n in range(1, window + 1):
                m = len(h) - n + 1
                if m <= 0:
                    break
                k = np.flatnonzero((row[:m] == row[n - 1 :]) & ((n == window) | (total[n:] - total[:m] >= long)))
                least, a, b = h[k], np.full(len(k), n, np.uint64), np.full(len(k), n, np.uint64)
                for j in range(n):
                    least = np.minimum(least, h[k + j])
                    a = (a ^ h[k + j].view(np.uint64)) * _MIX[0]
                    a ^= a >> np.uint64(29)
                    b = (b ^ g[k + j].view(np.uint64)) * _MIX[1]
                    b ^= b >> np.uint64(31)
                found.append((row[k], least, k, np.full(len(k), n, np.int64), a.view(np.int64), b.view(np.int64)))
            if not found or not sum(len(f[0]) for f in found):
                continue
            doc, least, k, n, a, b = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((k, least, doc))
            doc, least, k, n, a, b = (x[order] for x in (doc, least, k, n, a, b))
            start = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])))
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(doc))))
            same = np.lexsort((b, a, group))
            again = (group[same][1:] == group[same][:-1]) & (a[same][1:] == a[same][:-1]) & (b[same][1:] == b[same][:-1])
            lead = np.zeros(len(doc), np.int8)
            lead[start] = 1
            lead[start[group[same][1:][again]]] = 2
            loose = at[k + n - 1] - at[k] != n - 1  # blank lines between
            size_later = np.where(loose, n - 1, 0)
            own = np.arange(size_later.sum()) - np.repeat(np.cumsum(size_later) - size_later, size_later) + np.repeat(k + 1, size_later)
            later = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size_later)).astype(np.int32)), pa.array(at[own].astype(np.int32)), mask=pa.array(~loose))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(least), pa.array((k - off[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(at[k].astype(np.int32)), later, pa.array(a), pa.array(b), pa.array(lead)],
                names=["doc", "sub", "print", "k", "n", "i", "later", "a", "b", "lead"],
            )

    return lines.mapInArrow(cut, "doc long, sub long, print long, k int, n int, i int, later array<int>, a long, b long, lead byte")


def repeated_runs(docs: DataFrame, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """The later places of repeated runs: ``(doc, sub, at, from_doc, from_sub, from_k, k)``; ``at`` are the run's line numbers, ``k`` and ``from_k`` its first counted line and that of its earlier place."""
    found = written(fingerprints(_keyed(docs), window, long), "fingerprints")
    prints = written(found.where("lead > 0").groupBy("print").agg(F.count("*").alias("n"), F.max("lead").alias("twice")).where("n > 1 or twice = 2").select("print", "n"), "prints")
    floor = hot_floor(found.count())
    hot = prints.where(F.col("n") > floor).select("print")  # more than one part in HOT_KEYS each
    windows = found.drop("lead")
    place = F.struct("doc", "sub", "k")
    # fingerprints of bounded count: one exchange, in whose partitions the places of a window lie together
    near = windows.join(F.broadcast(hot), "print", "left_anti").join(prints.where(F.col("n") <= floor).select("print").hint("merge"), "print")
    order = Window.partitionBy("print", "a", "b").orderBy("doc", "sub", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("first", F.first(place).over(order)).where(place > F.col("first"))
    # hot fingerprints: earliest places by minima, hot windows again by a broadcast
    far = windows.join(F.broadcast(hot), "print")
    places = written(far.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first <> last").select("a", "b", "first", "n"), "places")
    known = places.where(F.col("n") > floor).drop("n")
    rest = far.join(F.broadcast(known.select("a", "b")), ["a", "b"], "left_anti").join(places.where(F.col("n") <= floor).drop("n").hint("merge"), ["a", "b"])
    far = far.join(F.broadcast(known), ["a", "b"]).unionByName(rest).where(place > F.col("first"))
    # a run is what touches on one diagonal
    at = F.concat(F.array("i"), F.coalesce("later", F.when(F.col("n") > 1, F.sequence(F.col("i") + 1, F.col("i") + F.col("n") - 1)), F.array().cast("array<int>")))
    names = ["doc", "sub", "k", "n", at.alias("at"), "first", (F.col("k") - F.col("first.k")).alias("off")]
    rows = near.select(*names).unionByName(far.select(*names))
    diagonal = Window.partitionBy("doc", "sub", "first.doc", "first.sub", "off").orderBy("k", "n")
    reach = F.max(F.col("k") + F.col("n")).over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("reach", reach).withColumn("run", F.sum(F.when(F.col("k") <= F.col("reach"), 0).otherwise(1)).over(diagonal.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("doc", "sub", F.col("first.doc").alias("from_doc"), F.col("first.sub").alias("from_sub"), "off", "run").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"), F.min("first.k").alias("from_k"), F.min("k").alias("k")
    ).drop("off", "run")


def hot_floor(n_rows: int) -> int:
    """Keys with more rows than this are hot."""
    return n_rows // HOT_KEYS + 5000


def repeated_lines(docs: DataFrame, window: int = WINDOW, long: int = LONG) -> DataFrame:
    """``(doc, sub, gone, n_gone)``: per document that loses lines, a flag per line up to the last one that goes."""
    places = repeated_runs(docs, window, long).groupBy("doc", "sub").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, count = [], []
            for at in batch.column(2):
                at = at.values.to_numpy()
                flag = np.zeros(at.max() + 1, bool)
                flag[at] = True
                out.append(flag)
                count.append(len(at))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.bool_())), pa.array(count, pa.int32())], names=["doc", "sub", "gone", "n_gone"])

    return places.mapInArrow(flags, "doc long, sub long, gone array<boolean>, n_gone int")


def drop_lines(docs: DataFrame, window: int = WINDOW, long: int = LONG, counts: str | None = None) -> DataFrame:
    """``docs`` with repeated runs of lines cut out of ``text``.

    Adds ``n_lines`` and ``n_removed``; with ``counts`` one struct column of that name that holds both.
    """
    gone = written(repeated_lines(docs, window, long), "gone")
    size = gone.agg(F.sum(F.size("gone") + 40)).first()[0] or 0
    side = gone.select("doc", "sub", F.struct("gone", "n_gone").alias("x"))
    # all columns of the input travel in one struct, so none can clash
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("sub"))
    both = rows.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, ["doc", "sub"], "left")
    lines = F.split(F.col("row.text").cast("string"), "\n", -1)
    drop: Column = F.col("x.gone")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.coalesce(F.get(drop, i), F.lit(False))), "\n")
    text = F.when(drop.isNull(), F.col("row.text").cast("string")).otherwise(kept).alias("text")
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines")
    n_removed = F.coalesce("x.n_gone", F.lit(0)).cast("long").alias("n_removed")
    added = [F.struct(n_lines, n_removed).alias(counts)] if counts else [n_lines, n_removed]
    return both.select(*(text if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns), *added)
