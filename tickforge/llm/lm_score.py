"""Operator 6: cross-entropy difference of matched n-gram models.

Two bigram models with the same order, smoothing and vocabulary: one counts the
target documents (those with a good quality label), one all documents.  A
document's score is the mean, over its tokens, of the target model's loss less
the background model's; low scores look like the target.  A document's own
counts are left out of both models when it is scored.

Words are lower-cased runs of non-space characters; words that occur once in the
corpus are one unknown word, in both models.  ``p(w | v) = mix * c(v, w) / c(v) +
(1 - mix) * (c(w) + 1) / (n + size of vocabulary)``; the first word follows a
start mark.

All counts cover all documents.  Documents are dealt into groups by a hash of
the id (that exchange occurs twice in one plan and runs once).  A group
sends each distinct word, then each distinct bigram, once with its counts, in
sorted numpy arrays to the bucket of its hash; the bucket answers each group with
corpus counts in the order sent.  Nothing corpus-wide is broadcast but seven sums.

Defined cases: null text and text without words have 0 tokens and null scores;
rows with equal ids are scored each (and left out each for itself); target ids
may repeat or be absent; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm._common import group_count, mix, runs, slices, text_buffers, trim, word_hashes, written

MIX = 0.6
_UNKNOWN, _START = np.uint64(1), np.uint64(2)
_SUMS = ("size", "words_t", "words_b", "unknown_t", "unknown_b", "docs_t", "docs_b")
_ROWS = "kind int, g int, bucket int, blob binary, sums array<long>"


class Group:
    """The words of a group of documents: hashes, places of documents, target flags."""

    def __init__(self, table: pa.Table) -> None:
        trim()
        quality = table.column("target").combine_chunks()
        ids = table.column("doc_id").combine_chunks()
        is_doc = table.column("is_doc").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        wanted = pa.compute.unique(ids.filter(quality.fill_null(False)))
        self.ids = ids.filter(pa.array(is_doc))
        self.target = pa.compute.is_in(self.ids, wanted.drop_null()).to_numpy(zero_copy_only=False).astype(bool)
        buf, off = text_buffers(table.column("text").combine_chunks().filter(pa.array(is_doc)))
        words, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for i, j in slices(off):
            h, d = word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            words.append(h)
            docs.append(d + i)
        self.words, self.doc = np.concatenate(words), np.concatenate(docs)
        self.n = len(self.ids)
        self.length = np.bincount(self.doc, minlength=self.n) if self.n else np.zeros(0, np.int64)
        self.first = np.append(True, self.doc[1:] != self.doc[:-1])[: len(self.doc)]

    def bigrams(self, distinct: np.ndarray, inverse: np.ndarray, known: np.ndarray) -> np.ndarray:
        w = np.where(known, distinct, _UNKNOWN)[inverse]
        v = np.where(self.first, _START, np.append(_START, w[:-1])[: len(w)])
        return mix(mix(v) * np.uint64(3) + w)


def _names(keys: np.ndarray) -> bytes:
    """48 bits of each hash; with the bucket's own bits, two items of a corpus hardly ever share a name."""
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + ((keys >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def _packed(counts: np.ndarray) -> bytes:
    """Counts as a plane of low bytes and a plane of the rest, which is nearly all zeros and compresses to nothing."""
    return (counts & 0xFF).astype(np.uint8).tobytes() + (counts >> 8).astype(np.uint32).tobytes()


def _unpacked(blob: bytes, start: int = 0) -> np.ndarray:
    n = (len(blob) - start) // 10
    low = np.frombuffer(blob, np.uint8, 2 * n, start)
    return (low + (np.frombuffer(blob, np.uint8, 8 * n, start + 2 * n).copy().view(np.uint32).astype(np.uint64) << np.uint64(8))).reshape(2, n)


def _counted(keys: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(keys, return_inverse=True)
    both = np.bincount(inverse, minlength=len(distinct)).astype(np.uint32)
    return distinct, inverse, np.stack([np.bincount(inverse[target], minlength=len(distinct)).astype(np.uint32), both])


def _send(kind: int, g: int, keys: np.ndarray, counts: np.ndarray, buckets: int, sums: list[int] | None) -> pa.Table:
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # of the high bits: ascends with the keys
    full, cut = runs(bucket)
    blobs = [_names(keys[i:j]) + _packed(counts[:, i:j]) for i, j in zip(cut[:-1], cut[1:])]
    n = len(full)
    extra = [] if sums is None else [sums]
    return pa.table(
        [
            pa.array([kind] * n + [0] * len(extra), pa.int32()),
            pa.array([g] * (n + len(extra)), pa.int32()),
            pa.array([*full.tolist(), *([g % buckets] * len(extra))], pa.int32()),
            pa.array([*blobs, *([None] * len(extra))], pa.binary()),
            pa.array([*([None] * n), *extra], pa.list_(pa.int64())),
        ],
        names=["kind", "g", "bucket", "blob", "sums"],
    )


def _total(kind: int):
    """A bucket's answers: corpus counts in the order each group sent its keys; and the bucket's share of the sums."""

    def run(table: pa.Table) -> pa.Table:
        given = [x for x in table.column("sums").to_pylist() if x is not None]  # of groups, on their way to the total
        table = table.filter(pa.compute.equal(table.column("kind"), kind))
        keys, counts = [np.empty(0, np.uint64)], [np.empty((2, 0), np.uint64)]
        for blob in table.column("blob"):
            b = blob.as_py()
            n = len(b) // 16
            keys.append(np.frombuffer(b, np.uint32, n) | (np.frombuffer(b, np.uint8, 2 * n, 4 * n).copy().view(np.uint16).astype(np.uint64) << np.uint64(32)))
            counts.append(_unpacked(b, 6 * n))
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        every = np.concatenate(counts, axis=1)
        total = np.stack([np.bincount(inverse, weights=c, minlength=len(distinct)) for c in every]).astype(np.uint64)
        edge = np.cumsum([0, *map(len, keys[1:])])
        blobs = [_packed(total[:, inverse[a:b]]) for a, b in zip(edge[:-1], edge[1:])]
        rare = total[1] < 2
        words = total.sum(axis=1)
        sums = [int((~rare).sum()), int(words[0]), int(words[1]), int(total[0][rare].sum()), int(total[1][rare].sum()), 0, 0]
        n = len(blobs)
        extra = [np.sum([sums, *given], axis=0).tolist()] if kind == 1 else []
        return pa.table(
            [
                pa.array([kind] * n + [0] * len(extra), pa.int32()),
                pa.array([*table.column("g").to_pylist(), *([-1] * len(extra))], pa.int32()),
                pa.array([*table.column("bucket").to_pylist(), *([0] * len(extra))], pa.int32()),
                pa.array([*blobs, *([None] * len(extra))], pa.binary()),
                pa.array([*([None] * n), *extra], pa.list_(pa.int64())),
            ],
            names=["kind", "g", "bucket", "blob", "sums"],
        )

    return run


def _answered(answer: pa.Table, kind: int) -> np.ndarray:
    """Counts of one kind in the group's own order (buckets ascend as hashes do)."""
    rows = sorted((b, x) for k, b, x in zip(answer.column("kind").to_pylist(), answer.column("bucket").to_pylist(), answer.column("blob").to_pylist()) if k == kind)
    return np.concatenate([np.zeros((2, 0), np.uint64), *(_unpacked(x) for _, x in rows)], axis=1)


def _send_words(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        g = Group(table)
        distinct, _, counts = _counted(g.words, g.target[g.doc])
        full = g.length > 0
        return _send(1, key[0].as_py(), distinct, counts, buckets, [0, 0, 0, 0, 0, int((full & g.target).sum()), int(full.sum())])

    return run


def _send_bigrams(buckets: int):
    def run(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        g = Group(table)
        distinct, inverse = np.unique(g.words, return_inverse=True)
        known = _answered(answer, 1)[1] >= 2
        pairs, _, counts = _counted(g.bigrams(distinct, inverse, known), g.target[g.doc])
        return _send(2, key[0].as_py(), pairs, counts, buckets, None)

    return run


def _own(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """How often each row's (document, item) occurs."""
    pair, inverse, count = np.unique((doc.astype(np.uint64) << np.uint64(32)) | item.astype(np.uint64), return_inverse=True, return_counts=True)
    return count[inverse]


def _score(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
    g = Group(table)
    loss = np.zeros((2, g.n))
    if len(g.words):
        size, *sums = np.array(answer.column("total")[0].as_py(), dtype=float)
        distinct, inverse = np.unique(g.words, return_inverse=True)
        words = _answered(answer, 1)
        known = words[1] >= 2
        _, pair = np.unique(g.bigrams(distinct, inverse, known), return_inverse=True)
        pairs = _answered(answer, 2)[:, pair].astype(float)
        item = np.where(known, np.arange(len(distinct)) + 1, 0)[inverse]
        own_word, own_pair = _own(g.doc, item), _own(g.doc, pair)
        for m in range(2):
            mine = g.target[g.doc].astype(float) if m == 0 else np.ones(len(g.doc))
            every = np.append(sums[2 + m], words[m].astype(float))
            c_w = np.maximum(every[item] - mine * own_word, 0)
            total = sums[m] - mine * g.length[g.doc]
            # c(v) counts every occurrence of the word before
            context = np.append(0.0, c_w[:-1])
            context[g.first] = np.maximum(sums[4 + m] - mine[g.first], 0)
            c_vw = np.maximum(pairs[m] - mine * own_pair, 0)
            p = MIX * np.divide(c_vw, context, out=np.zeros(len(context)), where=context > 0) + (1 - MIX) * (c_w + 1) / (total + size + 1)
            loss[m] = np.bincount(g.doc, weights=-np.log(np.minimum(p, 1.0)), minlength=g.n)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(g.length > 0, loss / np.maximum(g.length, 1), np.nan)
    none = g.length == 0
    columns = [pa.array(x, mask=none) for x in (mean[0], mean[1], mean[0] - mean[1])]
    return pa.table([g.ids, pa.array(g.length.astype(np.int64)), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])


def score_documents(docs: DataFrame, target: DataFrame, groups: int | None = None) -> DataFrame:
    """``(doc_id, n_tokens, target_loss, background_loss, score)``; ``target(doc_id)`` names the target documents."""
    groups = groups or group_count(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("boolean").alias("target"), F.lit(True).alias("is_doc"))
    marks = target.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("target"), F.lit(False).alias("is_doc")).where("doc_id is not null").distinct()
    dealt = rows.unionAll(marks).withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(groups)).cast("int"))
    by_group = lambda: dealt.groupBy("g")
    words = by_group().applyInArrow(_send_words(groups), _ROWS)
    # read three times, so written: the first pass over the texts runs once
    word_answers = written(words.groupBy("bucket").applyInArrow(_total(1), _ROWS), "words")
    pairs = by_group().cogroup(word_answers.where("kind = 1").groupBy("g")).applyInArrow(_send_bigrams(groups), _ROWS)
    pair_answers = pairs.groupBy("bucket").applyInArrow(_total(2), _ROWS)
    total = word_answers.where("kind = 0").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(len(_SUMS)))).alias("total"))
    answers = word_answers.where("kind = 1").unionAll(pair_answers).select("kind", "g", "bucket", "blob").withColumn("total", total.scalar())
    return by_group().cogroup(answers.groupBy("g")).applyInArrow(_score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
