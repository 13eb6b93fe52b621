"""Operator 5: n-gram Jaccard join by parity sketches.

A document's set holds its distinct word n-grams.  Two documents link when
``100 * |A & B| >= percent * |A | B|``; a component is what links connect.

Sketch.  The hashes of a set are dealt into ``m`` blocks and XORed within each:
an element in both sets cancels, so the number of differing blocks (the
block-wise Hamming distance) is a lower bound of the symmetric difference.
Linked sets differ in at most ``d`` elements, hence in at most ``d`` of the
``m = d + 1 + s`` blocks, and share at least ``s + 1`` (pigeonhole).  ``d`` and ``m``
belong to a band of set sizes; a set is filed in its own band and, if a linked
larger set may lie there, in the next one.

Join.  Block keys travel as packed numpy arrays to the bucket of their hash.  A key
that more than ``RARE`` sets have is hot: it stems from a passage that many share,
or from a large family of copies.  Other keys give pairs, counted per pair.  A
set with ``e`` empty and ``h`` hot blocks must share ``s + 1 - e - h`` others with
a linked one, so pairs with fewer are dropped; sets for which that number is not
positive (and only those) are joined over their hot keys, each with the smallest
such set of the key, never in all pairs.  As two of them must share a number of hot keys, the
first few of each, in one order for all, are enough (a prefix filter).  This loses no link, and common passages
do not chain documents together.  What is left makes candidate clusters
(:func:`components`).  Equal sets are one class before that.

Verify.  Inside a cluster each set meets, most similar sketch first, only sets
that are not in its component yet and whose sketch distance allows a link; the
sets themselves are compared exactly.  Clusters over ``CLUSTER_ROWS`` are cut into
a grid of blocks, each pair of blocks being one task; no partner is left out.

Defined cases: null text, or text without words, is an empty set, linked with
nothing; texts of fewer words than ``n`` have one element, the whole sequence;
rows are told apart by their place, so rows with equal ids or none are documents of their
own, which link by their texts; the class of rows without an id is the smallest id among them
all, null if there is none; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm._common import components, few_beside, mix, runs, slices, spread, text_buffers, trim, word_hashes, written

CLUSTER_ROWS = 1500
BAND_RATIO = 1.5
#: A key of more sets than this is hot.
RARE = 12
_SKETCH = 512
_C = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _step(k: int) -> np.uint64:
    """What sets the word at place ``k`` of an n-gram apart from the others."""
    return np.uint64(int(_C[k % 3]) * (2 * k + 1) % 2**64)


def document_sets(buf: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each document of a slice."""
    h, doc = word_hashes(buf, off)
    edge = np.searchsorted(doc, np.arange(len(off)))
    grams = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for k in range(n):
        grams += mix(h[k : k + len(grams)] + _step(k))
    grams = mix(grams)
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = np.uint64(0x1234567 + b - a) + sum((mix(h[i : i + 1] + _step(i - a)) for i in range(a, b)), np.zeros(1, np.uint64))
            out.append(mix(mix(whole)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def band_of(size: int) -> int:
    """The number of the size band; band ``k`` ends at :func:`band_end`."""
    k = 0
    while band_end(k) < size:
        k += 1
    return k


def band_end(k: int) -> int:
    return int(8 * BAND_RATIO**k)


def band_blocks(k: int, percent: int) -> tuple[int, int]:
    """``(m, s)`` of a band: at most ``d`` elements differ, ``m = d + 1 + s``; ``m = 0`` if only equal sets link."""
    # 100 I >= p U and U = A + B - I give (100 + p)(A + B - 2I) <= (100 - p)(A + B)
    d = (100 - percent) * 2 * band_end(k) // (100 + percent)
    s = max(2, d // 2)
    return (d + 1 + s, s) if d else (0, 0)


def block_keys(items: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """Per band ``(band, s less the empty blocks, keys)`` of one set."""
    size, out = len(items), []
    if size == 0:
        return out
    largest = 100 * size // percent
    if (100 - percent) * (size + largest) < 100 + percent:  # no element may differ
        return out
    scrambled = mix(items ^ _C[1])
    for band in range(band_of(size), band_of(largest) + 1):
        m, s = band_blocks(band, percent)
        if not m:
            continue
        block = ((scrambled >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        order = np.argsort(block, kind="stable")
        block, value = block[order], scrambled[order]
        start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        names, parity = block[start], np.bitwise_xor.reduceat(mix(value), start)
        spare = s - (m - len(names))
        if spare < 0:  # more empty blocks than a link must share: they get keys too
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), names)
            names, parity = np.append(names, empty), np.append(parity, np.zeros(len(empty), np.uint64))
        out.append((band, spare, mix(parity + mix(names * _C[2] + np.uint64(band + 1)))))
    return out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in sets], dtype=np.int64)
    h1 = np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
    h2 = np.array([np.bitwise_xor.reduce(mix(s ^ _C[0])) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
    return size, h1, h2


_SKETCHED = "bucket int, blob binary"


def sketch(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """One pass over the texts: packed block keys per bucket; a negative bucket, one of as many, holds the sizes and names of the sets and their spare blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        ids: list[int] = []
        spare: list[tuple[int, int, int]] = []
        named: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            k = np.concatenate([np.empty(0, np.uint64), *keys])
            o = np.concatenate([np.empty(0, np.uint32), *owner])
            order = np.argsort(k)
            k, o = k[order], o[order]
            bucket = (k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            full, cut = runs(bucket)
            table = np.array(ids, dtype=np.int64)
            blobs = []
            for i, j in zip(cut[:-1], cut[1:]):
                kk, oo = k[i:j], o[i:j]
                used, place = np.unique(oo >> np.uint32(8), return_inverse=True)
                blobs.append(b"".join((np.array([len(used), len(kk)], np.int64).tobytes(), table[used].tobytes(), (kk & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), ((kk >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes(), place.astype(np.uint16).tobytes(), (oo & np.uint32(0xFF)).astype(np.uint8).tobytes())))
            left = np.array(spare, dtype=np.int64).reshape(-1, 3)
            sets = np.stack([np.concatenate(x) for x in zip(*named)], axis=1) if named else np.empty((0, 4), np.int64)
            # whole flushes, of bounded size each, dealt over the buckets by their first document
            some = int(mix(sets[:1, 0].astype(np.uint64))[0] % np.uint64(buckets)) if len(sets) else 0
            blobs.append(np.int64(len(left)).tobytes() + left.T.tobytes() + sets.T.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([*full.tolist(), -1 - some], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        held = 0
        for batch in batches:
            buf, off = text_buffers(batch.column(1))
            names = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in slices(off):
                sets = document_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], n)
                seen: set[tuple[int, int]] = set()
                size, h1, h2 = _names(sets)
                named.append((names[i:j], size, h1, h2))
                for doc, s, x, y in zip(names[i:j].tolist(), sets, h1.tolist(), h2.tolist()):
                    if (x, y) in seen:  # an equal set of this slice stands for it
                        continue
                    seen.add((x, y))
                    for band, left, k in block_keys(s, percent):
                        keys.append(k)
                        owner.append(np.full(len(k), len(ids) << 8 | band, np.uint32))
                        spare.append((doc, band, left))
                        held += len(k)
                    ids.append(doc)
                if held > 1_000_000 or len(ids) > 40_000:  # a slice adds far fewer than 20,000
                    yield flush()
                    keys, owner, ids, spare, named, held = [], [], [], [], [], 0
        yield flush()
        trim()

    return spread(_rows(docs)).mapInArrow(run, _SKETCHED)


_MATCHED = "kind int, a long, b long, band long, n long"


def _match(key: tuple, table: pa.Table) -> pa.Table:
    """A bucket's pairs of sets over rare keys (kind 1, counted) and its hot keys' members (kind 2).  Of a negative bucket the spare blocks (kind 0) and the sets (kind 3: id, both halves of the name, size)."""
    trim()
    if key[0].as_py() < 0:
        spare, sets = [np.empty((3, 0), np.int64)], [np.empty((4, 0), np.int64)]
        for blob in table.column("blob"):
            b = np.frombuffer(blob.as_py(), np.int64)
            spare.append(b[1 : 1 + 3 * b[0]].reshape(3, -1))
            sets.append(b[1 + 3 * b[0] :].reshape(4, -1))
        (doc, band, left), (name, size, h1, h2) = np.concatenate(spare, axis=1), np.concatenate(sets, axis=1)
        columns = (np.repeat([0, 3], [len(doc), len(name)]).astype(np.int32), np.append(doc, name), np.append(doc, h1), np.append(band, h2), np.append(left, size))
        return pa.table([pa.array(c) for c in columns], names=["kind", "a", "b", "band", "n"])
    names, docs, bands = [], [], []
    for blob in table.column("blob"):
        b = blob.as_py()
        used, n = np.frombuffer(b, np.int64, 2).tolist()
        at = np.cumsum([16, 8 * used, 4 * n, n, 2 * n])
        ids = np.frombuffer(b, np.int64, used, at[0])
        names.append(np.frombuffer(b, np.uint32, n, at[1]).astype(np.uint64) | (np.frombuffer(b, np.uint8, n, at[2]).astype(np.uint64) << np.uint64(32)))
        docs.append(ids[np.frombuffer(b[at[3] : at[4]], np.uint16)])
        bands.append(np.frombuffer(b, np.uint8, n, at[4]))
    k, d, band = np.concatenate(names), np.concatenate(docs), np.concatenate(bands)
    k = (k << np.uint64(8)) | band  # a key belongs to one band
    order = np.lexsort((d, k))
    k, d, band = k[order], d[order], band[order]
    one = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))
    k, d, band = k[one], d[one], band[one].astype(np.int32)
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    count = np.repeat(np.diff(np.append(start, len(k))), np.diff(np.append(start, len(k))))
    hot = count > RARE
    pairs: list[np.ndarray] = []
    some = np.flatnonzero((count > 1) & ~hot)
    k2, d2, b2 = k[some], d[some], band[some]
    for step in range(1, RARE):
        i = np.flatnonzero(k2[step:] == k2[:-step]) if len(k2) > step else np.empty(0, np.int64)
        if not len(i):
            break
        pairs.append(np.stack([d2[i], d2[i + step], b2[i].astype(np.int64)], axis=1))
    found, n = np.unique(np.concatenate([np.empty((0, 3), np.int64), *pairs]), axis=0, return_counts=True)
    h = np.flatnonzero(hot)
    name = (k[h] | (np.uint64(key[0].as_py()) << np.uint64(48))).view(np.int64)
    return pa.table(
        [pa.array(np.repeat([1, 2], [len(found), len(h)]).astype(np.int32)), pa.array(np.append(found[:, 0], d[h])), pa.array(np.append(found[:, 1], name)), pa.array(np.append(found[:, 2], band[h].astype(np.int64))), pa.array(np.append(n, np.ones(len(h), np.int64)))],
        names=["kind", "a", "b", "band", "n"],
    )


def candidates(matched: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that lose no link, from the rows of :func:`_match`."""
    hot = matched.where("kind = 2").groupBy(F.col("a").alias("doc"), "band").agg(F.sort_array(F.collect_list("b")).alias("names"))  # at most a name a block
    spare = matched.where("kind = 0").groupBy(F.col("a").alias("doc"), "band").agg(F.max("n").alias("left"))
    rest = spare.join(hot, ["doc", "band"], "left").select("doc", "band", (F.col("left") - F.coalesce(F.size("names"), F.lit(0))).alias("left"), "names")
    pairs = matched.where("kind = 1").groupBy("a", "b", "band").agg(F.sum("n").alias("n")).where("a <> b")
    for side in ("a", "b"):
        pairs = pairs.join(rest.select(F.col("doc").alias(side), "band", F.col("left").alias(f"left_{side}")), [side, "band"])
    near = pairs.where(F.col("n") > F.greatest("left_a", "left_b")).select("a", "b")
    # two such sets that share no rare key share at least ``names + left + 1`` hot ones, the first of which is among the first ``-left`` of both
    open_ = rest.where("left < 0 and names is not null").select(F.explode(F.slice("names", 1, (-F.col("left")).cast("int"))).alias("name"), "doc")
    lead = open_.groupBy("name").agg(F.min("doc").alias("lead"))
    return near.unionAll(open_.join(lead, "name").where("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b"))).distinct()


def _word_sketch(items: np.ndarray) -> np.ndarray:
    out = np.zeros(_SKETCH, np.uint16)
    np.bitwise_xor.at(out, (items >> np.uint64(40)).astype(np.int64) % _SKETCH, (items & np.uint64(0xFFFF)).astype(np.uint16))
    return out


def cluster_links(sets: list[np.ndarray], side: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect all components among ``sets``; pairs on one side of a grid block (1 or 2) are another task's."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    sketches = np.stack([_word_sketch(sets[i]) for i in order])
    size, root, links = size[order], np.arange(len(sets)), []
    sides = np.array(side)[order]
    for i in range(1, len(order)):
        low = int(np.searchsorted(size[:i], -(-percent * int(size[i]) // 100)))
        if low >= i:
            continue
        distance = (sketches[low:i] != sketches[i]).sum(axis=1)
        most = (100 - percent) * (size[low:i] + size[i]) // (100 + percent)
        ok = (distance <= most) & ((sides[low:i] != sides[i]) | (sides[i] == 0))
        near = low + np.flatnonzero(ok)
        near = near[np.argsort(distance[near - low], kind="stable")]
        mine = sets[order[i]]
        for j in near.tolist():
            if root[j] == root[i]:
                continue
            both = len(np.intersect1d(mine, sets[order[j]], assume_unique=True))
            if 100 * both >= percent * (len(mine) + len(sets[order[j]]) - both):
                links.append((int(order[j]), int(order[i])))
                root[root == root[i]] = root[j]
    return links


def _odd_ids(docs: DataFrame) -> bool:
    """Whether ids are null or occur twice."""
    return not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` as a struct with a number of their own as ``doc_id``, written, so that the numbers stay."""
    return written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("doc_id"), F.col("text").cast("string").alias("text")), name)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, buckets: int | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not _odd_ids(docs):
        return _components(docs, n, percent, buckets)
    rows = _numbered(docs, "numbered")
    found = written(_components(rows, n, percent, buckets).join(rows.select("doc_id", F.col("row.doc_id").alias("id")), "doc_id"), "classes")
    least = found.groupBy("component_id").agg(F.min("id").alias("least"))
    return found.join(least, "component_id").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` less those that are near duplicates of a row with a smaller id (of equal ids, one stays; rows without an id go first)."""
    if not _odd_ids(docs):
        gone = written(_components(docs, n, percent).where("doc_id <> component_id").select("doc_id"), "duplicates")
        kept = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id")).join(few_beside(gone), "doc_id", "left_anti")
        return kept.select("row.*")
    rows = _numbered(docs, "numbered")
    found = _components(rows, n, percent).join(rows.select("doc_id", F.col("row.doc_id").cast("long").alias("id")), "doc_id")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("first"))
    stay = written(first.select(F.col("first.doc_id").alias("doc_id")), "kept")
    return rows.join(stay, "doc_id", "left_semi").select("row.*")


def _components(docs: DataFrame, n: int, percent: int, buckets: int | None = None) -> DataFrame:
    """The same for documents whose ids are distinct and not null."""
    if buckets is None:  # about half a million keys each
        buckets = max(8, -(-(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // (8 << 20)))
    matched = written(sketch(docs, n, percent, buckets).groupBy("bucket").applyInArrow(_match, _MATCHED), "matched")
    sets = matched.where("kind = 3").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("b").alias("h1"), F.col("band").alias("h2"))
    classes = sets.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    many = classes.where("copies > 1")
    same = written(sets.join(many, ["h1", "h2", "n_shingles"]).where("doc_id <> rep").select("doc_id", "rep").distinct(), "copies")
    stars = candidates(matched)
    for side in ("a", "b"):
        stars = stars.join(same.select(F.col("doc_id").alias(side), F.col("rep").alias("rep")), side, "left").withColumn(side, F.coalesce("rep", side)).drop("rep")
    cluster = components(stars.select("a", "b"))
    sizes = cluster.groupBy("component").count()
    members = written(cluster.join(sizes, "component").select(F.col("node").alias("doc_id"), "component", F.ceil(F.col("count") / CLUSTER_ROWS).cast("int").alias("cuts")), "members")
    rows = _rows(docs).join(few_beside(members), "doc_id").select("doc_id", "text", "component", "cuts")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffers(batch.column(1))
            for i, j in slices(off):
                found = [s.tobytes() for s in document_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found, pa.binary()), batch.column(2).slice(i, j - i), batch.column(3).slice(i, j - i)], names=["doc_id", "items", "component", "cuts"])

    def verify(table: pa.Table) -> pa.Table:
        trim()
        found: dict[int, tuple[np.ndarray, int]] = {}
        for d, x, p, q, r in zip(*(table.column(c).to_pylist() for c in ("doc_id", "items", "part", "one", "two"))):
            found.setdefault(d, (np.frombuffer(x, np.uint64), 0 if q == r else 1 if p == q else 2))
        names = sorted(found)
        links = cluster_links([found[d][0] for d in names], [found[d][1] for d in names], percent)
        return pa.table([pa.array([names[i] for i, _ in links], pa.int64()), pa.array([names[j] for _, j in links], pa.int64())], names=["a", "b"])

    part = F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int")
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("one"), F.greatest(k, F.col("part")).alias("two"))))
    dealt = rows.mapInArrow(to_sets, "doc_id long, items binary, component long, cuts int").withColumn("part", part).select("doc_id", "items", "component", "part", grid.alias("g")).select("*", "g.*").drop("g")
    links = dealt.groupBy("component", "one", "two").applyInArrow(verify, "a long, b long")
    final = components(links)
    named = sets.join(same, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    return named.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
