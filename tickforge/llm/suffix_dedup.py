"""Operator 10: removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of ``SPAN`` (50) bytes covers it that also starts in a
document with a smaller id.  All such strings are found, on whole texts:

1. Initial buckets.  In every string of 50 bytes the smallest hash of its 35
   16-grams marks an anchor (all ties count), so equal strings have equal
   anchors at equal offsets.  About one position in eighteen is an anchor.
   Anchor hashes are dealt into buckets; only anchors whose bucket has two
   documents stay active.
2. Refinement.  An active anchor stands for the 35 suffixes that start up to 34
   bytes before it.  Its surroundings (84 bytes) go to the anchor's bucket, once
   per group of documents and distinct surroundings.  There the suffixes' 16-gram
   buckets are refined to 32-gram buckets by sorting on the pair (own bucket
   pointer, pointer 16 bytes on), and those, reused, to 50-gram buckets by
   sorting on (own pointer, pointer 18 bytes on).  Buckets of one document drop
   out before the next sort.
   A hot anchor (one with many different surroundings, such as a rule of equal signs) is
   not gathered: its strings go, by 64-bit hashes and once per group of documents, to
   buckets of their own hashes, which spread evenly.
3. Answers.  Each group of documents learns per surroundings (or hot string) the smallest
   document that has them and which of that document's 35 strings start in a
   still smaller one, and cuts its texts.

The texts are dealt into groups by a hash of the id; that exchange occurs three
times in one plan and Spark runs it once.  All other exchanges carry packed
numpy arrays.  Copies and common passages are merged within a group of documents
before anything is sent, so a passage costs one entry per group however many
documents hold it.

Defined cases: null text is empty; texts under 50 bytes lose nothing; rows with
equal ids are one document for this purpose and never cut each other; a null id
counts as the largest; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm._common import BYTE_CODE, group_count, mix, powers, runs, slices, text_buffers, trim

SPAN = 50
GRAM = 16
REACH = SPAN - GRAM  # 34: how far before its anchor a string may start
WIDTH = REACH + SPAN  # 84 bytes around an anchor
_SLICE = 1 << 18
#: Buckets per group of documents.
_SPREAD = 4
_LAST = np.int64(2**63 - 1)
#: An anchor with more different surroundings in a group of documents, or in more than half as many groups, is hot.
HOT_KINDS = 200


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``out[i] = pick(x[i : i + width])`` by doubling; the result has ``len(x) - width + 1`` entries."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


class Anchors:
    """The anchors of a slice of documents: places, documents, hashes and the edges of their surroundings."""

    def __init__(self, buf: np.ndarray, off: np.ndarray) -> None:
        n = len(buf)
        self.buf, self.off = buf, off
        self.at = np.empty(0, np.int64)
        up, self.down = powers(n + 1)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        if n >= SPAN:
            np.cumsum(BYTE_CODE[buf] * up[:n], out=self.total[1:])
            grams = mix((self.total[GRAM:] - self.total[:-GRAM]) * self.down[: n - GRAM + 1])
            rank = (grams >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            least = _sliding(rank, SPAN - GRAM + 1, np.minimum)  # of each string of 50 bytes
            for end in off[1:].tolist():  # strings end with their document
                least[max(0, end - SPAN + 1) : end] = 0
            pad = np.zeros(REACH, np.uint32)
            most = _sliding(np.concatenate([pad, least, pad]), REACH + 1, np.maximum)  # over the strings that cover a 16-gram
            self.at = np.flatnonzero(rank == most[: len(rank)])
        self.gram = mix(grams[self.at] ^ np.uint64(0x5851F42D4C957F2D)) if len(self.at) else np.empty(0, np.uint64)
        self.doc = np.searchsorted(off, self.at, side="right") - 1
        self.low = np.maximum(off[self.doc], self.at - REACH)
        self.high = np.minimum(off[self.doc + 1], self.at + SPAN)

    def kinds(self, i: np.ndarray | slice) -> np.ndarray:
        """Hashes that name the surroundings of anchors ``i``."""
        low, high, at = self.low[i], self.high[i], self.at[i]
        h = (self.total[high] - self.total[low]) * self.down[low]
        return mix(h + mix((at - low).astype(np.uint64) * np.uint64(131) + (high - at).astype(np.uint64)))


    def strings(self) -> np.ndarray:
        """Hashes of the 50 bytes from each position on (past the last whole string they mean nothing)."""
        n = len(self.buf)
        m = max(0, n - SPAN + 1)
        return mix((self.total[SPAN:] - self.total[:m]) * self.down[:m] + np.uint64(SPAN))

    def covered(self, i: np.ndarray) -> np.ndarray:
        """Where the strings start that hold an anchor of ``i``."""
        change = np.zeros(len(self.buf) + 2, np.int32)
        first, last = self.low[i], np.minimum(self.at[i], self.high[i] - SPAN)
        ok = first <= last
        np.add.at(change, first[ok], 1)
        np.add.at(change, last[ok] + 1, -1)
        return np.flatnonzero(np.cumsum(change) > 0)


def _anchored(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, Anchors]]:
    trim()
    buf, off = text_buffers(table.column("text"))
    ids = table.column("doc_id").combine_chunks().fill_null(int(_LAST)).to_numpy(zero_copy_only=False).astype(np.int64)
    for i, j in slices(off, _SLICE):
        yield i, j, ids[i:j], Anchors(buf[off[i] : off[j]], off[i : j + 1] - off[i])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _named(gram: np.ndarray, buckets: int) -> np.ndarray:
    """An anchor's name: its bucket, then 32 bits of its hash (equal names only make candidates)."""
    return (_bucket(gram, buckets) << np.uint64(32)) | (gram & np.uint64(0xFFFFFFFF))


def _send_anchors(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        names, docs, kinds = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for _, _, ids, a in _anchored(table):
            names.append(_named(a.gram, buckets))
            docs.append(ids[a.doc])
            kinds.append(a.kinds(slice(None)))
        name, doc, kind = np.concatenate(names), np.concatenate(docs), np.concatenate(kinds)
        order = np.argsort(name, kind="stable")
        name, doc, kind = name[order], doc[order], kind[order]
        start = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.empty(0, np.int64)
        low, high = (np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)) if len(start) else (doc, doc)
        size = np.diff(np.append(start, len(name)))
        hot = np.zeros(len(start), bool)
        for i in np.flatnonzero((size > HOT_KINDS) & (low != high)):
            hot[i] = len(np.unique(kind[start[i] : start[i] + size[i]])) > HOT_KINDS
        name = np.repeat(name[start], 1 + (low != high) + hot)  # twice: two documents here already; three times: hot
        full, edge = runs(name >> np.uint64(32))
        blobs = [name[i:j].astype(np.uint32).tobytes() for i, j in zip(edge[:-1], edge[1:])]
        return pa.table([pa.array(full.astype(np.int32)), pa.array([key[0].as_py()] * len(full), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "g", "blob"])

    return run


def _repeated_anchors(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(b.as_py(), np.uint32) for b in table.column("blob")]
    every = np.sort(np.concatenate(parts))
    twice, count = np.unique(every, return_counts=True)
    many = count > HOT_KINDS
    for p in parts:  # sorted, three times is hot
        many |= np.isin(twice, p[2:][p[2:] == p[:-2]])
    twice, many = twice[count > 1], many[count > 1]
    out: list[list[bytes]] = [[], []]
    for p in parts:
        p = np.unique(p)
        k = np.minimum(np.searchsorted(twice, p), max(0, len(twice) - 1))
        known = twice[k] == p if len(twice) else np.zeros(len(p), bool)
        for hot in (0, 1):
            out[hot].append(p[known & (many[k] == bool(hot))].tobytes() if len(twice) else b"")
    g, bucket = table.column("g").combine_chunks(), table.column("bucket").combine_chunks()
    keep = [i for i, x in enumerate(out[1]) if x]
    return pa.table(
        [pa.concat_arrays([g, g.take(pa.array(keep, pa.int64()))]), pa.concat_arrays([bucket, bucket.take(pa.array(keep, pa.int64()))]), pa.array([*out[0], *(out[1][i] for i in keep)], pa.binary()), pa.array([False] * len(g) + [True] * len(keep))],
        names=["g", "bucket", "blob", "hot"],
    )


def _squeezed(text: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(text.tobytes(), asbytes=True)


def _send_surroundings(buckets: int):
    def run(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        named = [(h, (np.uint64(b) << np.uint64(32)) | np.frombuffer(x.as_py(), np.uint32).astype(np.uint64)) for b, x, h in zip(answer.column("bucket").to_pylist(), answer.column("blob"), answer.column("hot").to_pylist())]
        active, hot = (np.sort(np.concatenate([np.empty(0, np.uint64), *(x for h, x in named if h == want)])) for want in (False, True))
        got: list[tuple[np.ndarray, ...]] = []
        strings = [np.empty(0, np.uint64)]
        holders = [np.empty(0, np.int64)]
        for _, _, ids, a in _anchored(table) if len(active) + len(hot) else ():
            name = _named(a.gram, buckets)
            if len(hot):
                k = np.minimum(np.searchsorted(hot, name), len(hot) - 1)
                if len(pick := np.flatnonzero(hot[k] == name)):
                    at = a.covered(pick)
                    strings.append(a.strings()[at])
                    holders.append(ids[np.searchsorted(a.off, at, side="right") - 1])
            if not len(active):
                continue
            k = np.minimum(np.searchsorted(active, name), len(active) - 1)
            pick = np.flatnonzero(active[k] == name)
            kind, doc = a.kinds(pick), ids[a.doc[pick]]
            order = np.lexsort((doc, kind))
            kind, doc, pick = kind[order], doc[order], pick[order]
            start = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(kind) else np.empty(0, np.int64)
            if not len(start):
                continue
            one = (doc[start] == np.maximum.reduceat(doc, start)).astype(np.uint8)
            pick, kind, doc = pick[start], kind[start], doc[start]
            padded = np.concatenate([np.zeros(REACH, np.uint8), a.buf, np.zeros(SPAN, np.uint8)])
            text = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[a.at[pick]]
            clipped = np.flatnonzero(a.high[pick] - a.low[pick] < WIDTH)
            place = a.at[pick[clipped], None] - REACH + np.arange(WIDTH)
            text[clipped] *= (place >= a.low[pick[clipped], None]) & (place < a.high[pick[clipped], None])
            edges = np.stack([a.at[pick] - a.low[pick], a.high[pick] - a.at[pick]], axis=1).astype(np.uint8)
            got.append((kind, doc, a.gram[pick], one, edges, text))
        packed = [_hot_rows(key[0].as_py(), np.concatenate(strings), np.concatenate(holders), buckets)]
        if not got:
            return packed[0]
        kind, doc, gram, one, edges, text = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((doc, kind, gram))  # ascends with the buckets; equal anchors side by side compress well
        kind, doc, bucket, one = kind[order], doc[order], _bucket(gram[order], buckets), one[order]
        start = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
        one = np.minimum.reduceat(one, start) * (doc[start] == np.maximum.reduceat(doc, start))
        kind, doc, bucket, order = kind[start], doc[start], bucket[start], order[start]
        edges, text = edges[order], text[order]
        full, cut = runs(bucket)
        blobs = []
        for i, j in zip(cut[:-1], cut[1:]):
            part = slice(i, j)
            head = b"".join(x[part].tobytes() for x in (kind, doc, one.astype(np.uint8), edges))
            blobs.append(np.int64(j - i).tobytes() + head + _squeezed(text[part]))
        packed.append(pa.table([pa.array(full.astype(np.int32)), pa.array([key[0].as_py()] * len(full), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "g", "blob"]))
        return pa.concat_tables(packed)

    return run


def _hot_rows(g: int, string: np.ndarray, doc: np.ndarray, buckets: int) -> pa.Table:
    """A group's hot strings, once each with their smallest document, by buckets of their hashes (numbered from -1 down)."""
    order = np.lexsort((doc, string))
    string, doc = string[order], doc[order]
    start = np.flatnonzero(np.append(True, string[1:] != string[:-1])) if len(string) else np.empty(0, np.int64)
    one = (doc[start] == np.maximum.reduceat(doc, start)).astype(np.uint8) if len(start) else np.empty(0, np.uint8)
    string, doc = string[start], doc[start]
    full, cut = runs(_bucket(string, buckets))
    blobs = [string[i:j].tobytes() + doc[i:j].tobytes() + one[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])]
    return pa.table([pa.array(-1 - full.astype(np.int64)).cast(pa.int32()), pa.array([g] * len(full), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "g", "blob"])


def _hot_answers(table: pa.Table) -> pa.Table:
    """Per group the hot strings that a smaller document has than some of its own, with that document."""
    parts = []
    for b in table.column("blob"):
        b = b.as_py()
        n = len(b) // 17
        parts.append((np.frombuffer(b, np.uint64, n), np.frombuffer(b, np.int64, n, 8 * n), np.frombuffer(b, np.uint8, n, 16 * n)))
    string, doc = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.lexsort((doc, string))
    start = np.flatnonzero(np.append(True, string[order][1:] != string[order][:-1]))
    least = np.empty(len(string), np.int64)
    least[order] = np.repeat(doc[order][start], np.diff(np.append(start, len(string))))
    out, a = [], 0
    for s, d, one in parts:
        mine = least[a : a + len(s)]
        useful = (mine != d) | (one == 0)
        out.append(s[useful].tobytes() + mine[useful].tobytes())
        a += len(s)
    return pa.table([table.column("g"), pa.array(out, pa.binary()), pa.array([True] * len(out))], names=["g", "blob", "hot"])


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    at = np.cumsum([8, 8 * n, 8 * n, n, 2 * n])
    return (
        np.frombuffer(blob, np.uint64, n, at[0]),
        np.frombuffer(blob, np.int64, n, at[1]),
        np.frombuffer(blob, np.uint8, n, at[2]),
        np.frombuffer(blob, np.uint8, 2 * n, at[3]).reshape(n, 2),
        np.frombuffer(pa.Codec("zstd").decompress(blob[at[4] :], decompressed_size=WIDTH * n, asbytes=True), np.uint8).reshape(n, WIDTH),
    )


def refine(pointer: np.ndarray, later: np.ndarray) -> np.ndarray:
    """New bucket pointers: the rank of the pair (own pointer, pointer at a later offset)."""
    return np.unique((pointer << np.uint64(32)) | later, return_inverse=True)[1].astype(np.uint64)


def _shared(name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows have a name that occurs with two documents."""
    order = np.argsort(name, kind="stable")
    start = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))
    two = np.minimum.reduceat(doc[order], start) != np.maximum.reduceat(doc[order], start)
    out = np.empty(len(name), bool)
    out[order] = np.repeat(two, np.diff(np.append(start, len(name))))
    return out


def earlier_strings(doc: np.ndarray, edges: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Per surroundings, 35 bits: bit ``k`` is set if the string ``text[k:k+50]`` also starts in a smaller document."""
    bits = np.zeros(len(doc), dtype=np.uint64)
    if len(doc) < 2:
        return bits
    # every string holds the 33 bytes that end or those that start with the anchor: surroundings alone in both buckets drop out
    half, (up, _) = REACH // 2, powers(WIDTH)
    alone = np.ones(len(doc), bool)
    for low in (REACH - half, REACH):
        alone &= ~_shared(BYTE_CODE[text[:, low : low + GRAM + half]] @ up[: GRAM + half], doc)
    rows = np.flatnonzero(~alone)
    if not len(rows):
        return bits
    doc, edges, text = doc[rows], edges[rows], text[rows]
    code = BYTE_CODE[text]
    grams = sum(code[:, k : WIDTH - GRAM + 1 + k] * up[k] for k in range(GRAM))
    pointer = np.unique(grams, return_inverse=True)[1].reshape(grams.shape).astype(np.uint64)
    pointer = refine(pointer[:, :-GRAM].ravel(), pointer[:, GRAM:].ravel()).reshape(len(rows), -1)  # 32 bytes
    k = np.arange(REACH + 1)
    row, col = np.nonzero((k >= REACH - edges[:, :1].astype(int)) & (k <= edges[:, 1:].astype(int) - GRAM))
    if not len(row):
        return bits
    pair = (pointer[row, col] << np.uint64(32)) | pointer[row, col + (SPAN - 2 * GRAM)]
    order = np.argsort(pair, kind="stable")
    pair, row, col = pair[order], row[order], col[order]
    start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    least = np.repeat(np.minimum.reduceat(doc[row], start), np.diff(np.append(start, len(row))))
    hit = least < doc[row]
    np.bitwise_or.at(bits, rows[row[hit]], np.uint64(1) << col[hit].astype(np.uint64))
    return bits


def _answers(key: tuple, table: pa.Table) -> pa.Table:
    trim()
    if key[0].as_py() < 0:
        return _hot_answers(table)
    groups = table.column("g").to_pylist()
    parts = [_unpack(b.as_py()) for b in table.column("blob")]
    kind, doc, one = (np.concatenate([p[i] for p in parts]) for i in range(3))
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.lexsort((doc, kind))
    start = np.flatnonzero(np.append(True, kind[order][1:] != kind[order][:-1]))
    first = order[start]
    edges, text = np.concatenate([p[3] for p in parts])[first], np.concatenate([p[4] for p in parts])[first]
    del parts
    bits = earlier_strings(doc[first], edges, text)
    which = np.empty(len(kind), np.int64)
    which[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(kind))))
    useful = (bits[which] != 0) | (doc != doc[first][which]) | (one == 0)
    out = []
    for i in range(len(groups)):
        mine = np.flatnonzero((owner == i) & useful) if len(groups) < 4 else np.flatnonzero(useful[(s := slice(*np.searchsorted(owner, [i, i + 1])))]) + s.start
        w = which[mine]
        out.append(kind[mine].tobytes() + doc[first][w].tobytes() + bits[w].tobytes())
    return pa.table([pa.array(groups, pa.int32()), pa.array(out, pa.binary()), pa.array([False] * len(out))], names=["g", "blob", "hot"])


def _cut(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
    told = list(zip(answer.column("hot").to_pylist(), answer.column("blob")))
    string, holder = (np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x.as_py(), np.uint64).reshape(2, -1)[i] for h, x in told if h)]) for i in range(2))
    order = np.argsort(string)
    string, holder = string[order], holder[order].view(np.int64)
    sieve = np.zeros(1 << 22, bool)
    sieve[string & np.uint64((1 << 22) - 1)] = True
    parts = [np.frombuffer(x.as_py(), np.uint64).reshape(3, -1) for h, x in told if not h]
    kind, least, bits = (np.concatenate([np.empty(0, np.uint64), *(p[i] for p in parts)]) for i in range(3))
    order = np.argsort(kind)
    kind, least, bits = kind[order], least[order].view(np.int64), bits[order]
    out: list[tuple] = []
    for i, j, ids, a in _anchored(table):
        change = np.zeros(len(a.buf) + 1, dtype=np.int32)
        if len(kind) and len(a.at):
            name = a.kinds(slice(None))
            k = np.minimum(np.searchsorted(kind, name), len(kind) - 1)
            hit = np.flatnonzero(kind[k] == name)
            k, doc = k[hit], ids[a.doc[hit]]
            first, last = a.low[hit], np.minimum(a.at[hit], a.high[hit] - SPAN)
            gone = (doc > least[k]) & (first <= last)
            np.add.at(change, first[gone], 1)
            np.add.at(change, last[gone] + SPAN, -1)
            own = np.flatnonzero((doc == least[k]) & (bits[k] != 0))
            for b in range(REACH + 1) if len(own) else ():
                s = a.at[hit[own]][(bits[k[own]] >> np.uint64(b)) & np.uint64(1) == 1] - REACH + b
                np.add.at(change, s, 1)
                np.add.at(change, s + SPAN, -1)
        if len(string) and len(a.buf) >= SPAN:
            h = a.strings()
            at = np.flatnonzero(sieve[h & np.uint64((1 << 22) - 1)])
            k = np.minimum(np.searchsorted(string, h[at]), len(string) - 1)
            d = np.searchsorted(a.off, at, side="right") - 1
            gone = (string[k] == h[at]) & (at + SPAN <= a.off[d + 1]) & (ids[d] > holder[k])
            np.add.at(change, at[gone], 1)
            np.add.at(change, at[gone] + SPAN, -1)
        drop = np.cumsum(change[:-1]) > 0
        edge = drop.copy()
        edge[1:] &= ~drop[:-1]
        edge[a.off[:-1][a.off[:-1] < len(drop)]] = drop[a.off[:-1][a.off[:-1] < len(drop)]]
        n_drop, n_edge = np.append(0, np.cumsum(drop)), np.append(0, np.cumsum(edge))
        kept = a.buf[~drop]
        at = a.off - n_drop[a.off]
        for d in range(j - i):
            x, y = a.off[d], a.off[d + 1]
            out.append((i + d, int(y - x), int(n_drop[y] - n_drop[x]), int(n_edge[y] - n_edge[x]), kept[at[d] : at[d + 1]].tobytes()))
    rows, size, removed, spans, kept_text = zip(*out) if out else ((), (), (), (), ())
    return pa.table([table.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept_text], pa.string()), pa.array(kept_text, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


_BLOB = "bucket int, g int, blob binary"


def remove_repeats(docs: DataFrame, groups: int | None = None) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` per document; ``kept`` is what is left, as bytes."""
    groups = groups or group_count(docs)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(groups)).cast("int"))
    by_group = lambda: dealt.groupBy("g")
    anchors = by_group().applyInArrow(_send_anchors(groups * _SPREAD), _BLOB)
    active = anchors.groupBy("bucket").applyInArrow(_repeated_anchors, "g int, bucket int, blob binary, hot boolean")
    around = by_group().cogroup(active.groupBy("g")).applyInArrow(_send_surroundings(groups * _SPREAD), _BLOB)
    answers = around.groupBy("bucket").applyInArrow(_answers, "g int, blob binary, hot boolean")
    return by_group().cogroup(answers.groupBy("g")).applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
