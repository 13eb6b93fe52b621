"""Operators of the llm subpackage against brute force, on small fixtures with awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.accumulators import AccumulatorParam

from tickforge.llm import _common, decontaminate, langid, line_dedup, lm_score, packing, parity_join, secrets, suffix_dedup, token_store, tokens, topk_inner

SPACE = re.compile("[\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, doc string, g int"  # the last two clash with inner names


def corpus(seed=1, n=60):
    """Random prose with copies, near copies, shared passages and lines, nulls, empty and long texts."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(r.randint(1, 9))) for _ in range(400)]
    prose = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, line = prose(30), "Terms and conditions apply to all of this."
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not texts:
            texts.append(prose(r.randint(5, 120)))
        elif kind == 1:
            texts.append(r.choice(texts))
        elif kind == 2:
            w = (r.choice(texts) or "x y z").split(" ")
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind == 3:
            texts.append(prose(10) + "\n" + passage + "\n" + prose(r.randint(1, 20)))
        elif kind == 4:
            texts.append("\n".join([line, prose(4), "same one", "same two", "same three", line]))
        else:
            texts.append(prose(3))
    texts += ["", None, "word", "two words", " \t\n", prose(5000), "aaaa " * 200, "aaaa " * 200, "É" * 60, "日本語のテキスト" * 20]
    return [(i * 3, t, ["en", "fr", None][i % 3], "x", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n):
    w = [x for x in SPACE.split((text or "").translate(LOWER)) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = {r[0]: shingles(r[1], n) for r in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if union and 100 * both >= percent * union:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(d, len(sets[d]), find(d)) for d in sets}


# -- near duplicates -------------------------------------------------------------------
@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_parity_join(docs, rows, n, percent):
    assert {tuple(r) for r in parity_join.jaccard_components(docs, n, percent, buckets=3).collect()} == brute_components(rows, n, percent)


def test_parity_join_hot_families(spark):
    """Large families, a passage that all share, and clusters cut into a grid."""
    r = random.Random(3)
    base, shared = [f"w{i}" for i in range(80)], [f"s{i}" for i in range(40)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 3):
            w[r.randrange(80)] = f"x{r.random()}"
        rows.append((i, " ".join(w), None, "", 0))
    rows += [(100 + i, " ".join([*shared, *(f"y{i}_{k}" for k in range(20))]), None, "", 0) for i in range(30)]
    old, parity_join.CLUSTER_ROWS = parity_join.CLUSTER_ROWS, 7
    try:
        got = {tuple(x) for x in parity_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), 3, 80, buckets=2).collect()}
    finally:
        parity_join.CLUSTER_ROWS = old
    assert got == brute_components(rows, 3, 80)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_parity_join_small_sets(spark, percent):
    """Very small sets, in which many blocks are empty, in families larger than a rare key."""
    r = random.Random(percent)
    rows = []
    for i in range(220):
        base = [f"w{i % 4}_{k}" for k in range(2 + i % 19)]
        if r.random() < 0.5:
            base[r.randrange(len(base))] = f"x{r.randrange(30)}"
        rows.append((i, " ".join(base), None, "", 0))
    got = {tuple(x) for x in parity_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), 1, percent, buckets=3).collect()}
    assert got == brute_components(rows, 1, percent)


def test_parity_join_empty_and_repeated(spark, none):
    assert parity_join.jaccard_components(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f", None, "", 0)] * 2 + [(None, "a b c d e f", None, "", 0)], SCHEMA)
    assert sorted(map(tuple, parity_join.jaccard_components(twice).collect()), key=str) == [(1, 2, 1), (1, 2, 1), (None, 2, 1)]
    ids = spark.createDataFrame([(7, "a b c d e f", "x", "", 0), (7, "one two three four five six", "y", "", 0), (9, "one two three four five six", None, "", 0), (None, "u v w x y z", None, "", 0), (None, "u v w x y z", None, "", 0), (None, None, None, "", 0)], SCHEMA)
    assert sorted(map(tuple, parity_join.jaccard_components(ids).collect()), key=str) == [(7, 2, 7), (7, 2, 7), (9, 2, 7), (None, 0, None), (None, 2, None), (None, 2, None)]
    kept = sorted(((r.doc_id, r.text) for r in parity_join.one_of_each(ids).collect()), key=str)
    assert kept == [(7, "a b c d e f"), (7, "one two three four five six"), (None, "u v w x y z"), (None, None)]


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = rng.integers(0, 2**63, 200, dtype=np.uint64)
        b = np.concatenate([a[: rng.integers(0, 200)], rng.integers(0, 2**63, 20, dtype=np.uint64)])
        assert (parity_join._word_sketch(a) != parity_join._word_sketch(b)).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 120), (120, 110), (7, 7)]
    got = dict(map(tuple, _common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 110: 100, 120: 100}


# -- repeated strings --------------------------------------------------------------------
def brute_repeats(rows):
    seen, out = set(), set()
    for doc, group in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        mine = set()
        for r in group:
            x = (r[1] or "").encode()
            drop = bytearray(len(x))
            for i in range(len(x) - 49):
                s = x[i : i + 50]
                mine.add(s)
                if s in seen:
                    drop[i : i + 50] = b"\1" * 50
            kept = bytes(c for c, d in zip(x, drop) if not d)
            out.add((doc, len(x), sum(drop), sum(1 for i in range(len(x)) if drop[i] and not (i and drop[i - 1])), hashlib.sha256(kept).hexdigest()))
        seen |= mine
    return out


@pytest.mark.parametrize("groups", [1, 4])
def test_remove_repeats(docs, rows, groups):
    got = suffix_dedup.remove_repeats(docs, groups)
    assert {tuple(r) for r in got.drop("kept").collect()} == brute_repeats(rows)


def test_remove_repeats_edges(spark, none):
    assert suffix_dedup.remove_repeats(none).count() == 0
    r = random.Random(9)
    soup = "".join(r.choice("ab") for _ in range(400))
    rows = [(i, soup[r.randrange(300) :][: r.randint(40, 100)] + "".join(r.choice("ab") for _ in range(30)), None, "", 0) for i in range(80)]
    rows += [(500, "x" * 49, None, "", 0), (501, "x" * 49, None, "", 0), (502, "x" * 50, None, "", 0), (503, "x" * 51, None, "", 0), (503, "x" * 51, None, "", 0)]
    assert {tuple(x) for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), 3).drop("kept").collect()} == brute_repeats(rows)


@pytest.mark.parametrize("hot", [3, 200])
def test_remove_repeats_hot_anchor(spark, monkeypatch, hot):
    """Rules of equal signs in otherwise different documents, some of which share more."""
    monkeypatch.setattr(suffix_dedup, "HOT_KINDS", hot)
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = [(i, f"{word()} {word()} {r.choice(['', 'one common sentence of some length stands here '])}{'=' * r.choice([16, 20, 40, 60])} {r.choice(['', 'and another one that many hold '])}{word()} {word()} {word()}", None, "", 0) for i in range(240)]
    rows += [(500, "=" * 200, None, "", 0), (501, "=" * 49, None, "", 0), (502, "x" + "=" * 70, None, "", 0)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), 3)
    assert {tuple(x) for x in got.drop("kept").collect()} == brute_repeats(rows)


# -- lines -----------------------------------------------------------------------------------
def brute_lines(rows, window, long=200):
    seen, out = set(), {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[doc] = (0, 0, None)
            continue
        lines = text.split("\n")
        full = [(i, x.strip(" \t\r\f\v")) for i, x in enumerate(lines) if x.strip(" \t\r\f\v")]
        gone = set()
        for k in range(len(full)):
            for n in range(1, window + 1):
                gram = tuple(x for _, x in full[k : k + n])
                if len(gram) == n and (n == window or sum(map(len, gram)) >= long):
                    if gram in seen:
                        gone |= {i for i, _ in full[k : k + n]}
                    seen.add(gram)
        out[doc] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize(("window", "long"), [(1, 200), (3, 200), (3, 10**9), (4, 60)])
def test_line_dedup(docs, rows, window, long):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.drop_lines(docs, window, long).collect()}
    assert got == brute_lines(rows, window, long)


def test_line_dedup_hot_lines_and_passages(spark, monkeypatch):
    """A line, a run of lines and a long line that most documents share; fingerprints and windows are hot."""
    r = random.Random(4)
    line, passage = "All rights reserved.", "\n".join(f"shared line {i}" for i in range(5))
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "\n".join(r.sample([line, passage, long, f"own {i}", f"other {r.randrange(9)}", line, ""], r.randint(1, 7))), None, "", 0) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    wanted = brute_lines(rows, 3)
    monkeypatch.setattr(line_dedup, "hot_floor", lambda n: 20)
    assert {x.doc_id: (x.n_lines, x.n_removed, x.text) for x in line_dedup.drop_lines(df).collect()} == wanted


def test_line_dedup_runs(spark):
    """Matches are joined into whole runs, with their earlier place."""
    rows = [(1, "a\nb\nc\nd\ne", None, "", 0), (2, "x\nb\n\nc\nd\ne\ny", None, "", 0), (3, "q" * 250 + "\nz", None, "", 0), (4, "s\n" + "q" * 250, None, "", 0)]
    got = {(r.doc, tuple(r["at"]), r.from_doc, r.from_k, r.k) for r in line_dedup.repeated_runs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(2, (1, 3, 4, 5), 1, 1, 1), (4, (1,), 3, 0, 1)}


def test_line_dedup_edges(none, spark):
    assert line_dedup.drop_lines(none).columns == [*none.columns, "n_lines", "n_removed"]
    assert line_dedup.drop_lines(none).count() == 0
    twice = spark.createDataFrame([(1, "a\nb\nc", None, "", 0)] * 2 + [(None, "a\nb\nc", None, "", 0)], SCHEMA)
    assert sorted((str(r.doc_id), r.n_removed) for r in line_dedup.drop_lines(twice).collect()) == [("1", 3), ("1", 3), ("None", 0)]
    clash = spark.createDataFrame([(1, "a\nb\nc", 5, 6, 7), (2, "a\nb\nc\nd", 8, 9, 10)], "doc_id long, text string, n_removed long, x long, sub long")
    assert sorted(tuple(r) for r in line_dedup.drop_lines(clash, counts="c").drop("c").collect()) == [(1, "a\nb\nc", 5, 6, 7), (2, "d", 8, 9, 10)]


# -- scoring ------------------------------------------------------------------------------------
def brute_scores(rows, target):
    words = {r[0]: [x for x in SPACE.split((r[1] or "").translate(LOWER)) if x] for r in rows}
    count = collections.Counter(w for ws in words.values() for w in ws)
    words = {d: [w if count[w] > 1 else None for w in ws] for d, ws in words.items()}
    size = sum(c > 1 for c in count.values())
    uni, bi, total, starts = ([collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()], [0, 0], [0, 0])
    pairs = lambda ws: list(zip(["<s>", *ws[:-1]], ws))
    for d, ws in words.items():
        for m in (0, 1):
            if m or d in target:
                uni[m].update(ws)
                bi[m].update(pairs(ws))
                total[m] += len(ws)
                starts[m] += bool(ws)
    out = {}
    for d, ws in words.items():
        u, b, loss = collections.Counter(ws), collections.Counter(pairs(ws)), [0.0, 0.0]
        for m in (0, 1):
            own = 1 if m or d in target else 0
            for v, w in pairs(ws):
                before = starts[m] - own if v == "<s>" else uni[m][v] - own * u[v]
                both = bi[m][v, w] - own * b[v, w]
                p = lm_score.MIX * (both / before if before > 0 else 0) + (1 - lm_score.MIX) * (uni[m][w] - own * u[w] + 1) / (total[m] - own * len(ws) + size + 1)
                loss[m] -= math.log(p)
        out[d] = (len(ws), *(x / len(ws) if ws else None for x in loss))
    return out


def test_scores(spark, docs, rows, none):
    target = spark.createDataFrame([(0,), (6,), (6,), (30,), (99999,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score_documents(docs, target, groups=3).collect()}
    for d, (n, t, b) in brute_scores(rows, {0, 6, 30}).items():
        assert got[d].n_tokens == n
        assert got[d].target_loss == pytest.approx(t) if n else got[d].score is None
        assert not n or (got[d].background_loss == pytest.approx(b) and got[d].score == pytest.approx(t - b))
    assert lm_score.score_documents(none, target).count() == 0


# -- tokens -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_tokenizers(name):
    from tokenizers import Tokenizer

    exact, fast = Tokenizer.from_file(tokens.public_file(name)), tokens.Encoder(tokens.public_file(name))
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFéèüßñ0123456789 \n\t'.,|<>-_²½ªºÅİ日🙂\x85\xa0"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["<|endoftext|> a", "x" * 3000, "don't it's", "  a   b  ", "ÉÀ é", "a\x01b"]
    for t in texts:
        assert fast.encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids, t


def test_packing(docs, rows, none):
    got = packing.pack_documents(docs).collect()
    enc = tokens.Encoder(tokens.public_file("byte_bpe_50k.json"))
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {r[0] for r in rows}
    for doc, text, *_ in rows:
        ids = np.append(enc.encode(text or ""), 0).astype("<u4")
        mine = sorted(pieces[doc], key=lambda r: r.piece)
        assert [p.start for p in mine] == list(np.cumsum([0, *(p.length for p in mine)])[:-1]) and sum(p.length for p in mine) == len(ids)
        assert all(p.length == 2048 for p in mine[1:]) and mine[0].length <= 2048
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in mine)
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == list(np.cumsum([0, *(n for _, n in held)])[:-1]) and sum(n for _, n in held) <= 2048
    assert len(bins) <= 1.1 * sum(r.length for r in got) / 2048 + 2
    assert packing.pack_documents(none).count() == 0


def test_packing_and_scores_of_repeated_rows(spark):
    """Rows that repeat, with equal or no ids, are documents of their own."""
    rows = [(1, "one two three", None, "", 0)] * 3 + [(1, "four five", None, "", 0), (None, "six", None, "", 0), (None, "six", None, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack_documents(df).collect()
    assert sorted(str(x.doc_id) for x in got) == ["1"] * 4 + ["None"] * 2 and len({(x.sequence_id, x.offset) for x in got}) == 6
    scored = lm_score.score_documents(df, spark.createDataFrame([(1,)], "doc_id long"), groups=2).collect()
    assert sorted((str(x.doc_id), x.n_tokens) for x in scored) == [("1", 2), ("1", 3), ("1", 3), ("1", 3), ("None", 1), ("None", 1)]


def test_packing_rounds(spark):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2049, 3000).tolist()
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "row_id long, piece int, length long")
    got = packing.pack(pieces, group_rows=400).collect()
    used = collections.Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert len(got) == 3000 and max(used.values()) <= 2048
    assert len(used) <= 1.05 * sum(lengths) / 2048


@pytest.mark.parametrize(("low", "high", "most"), [(1100, 1101, 1.0), (1100, 2049, 1.0), (700, 760, 1.01), (1, 300, 1.01)])
def test_packing_keeps_groups_small(spark, monkeypatch, low, high, most):
    """Pieces of which no two fit together, or that fill no bin, never pile up in one group."""
    lengths = np.random.default_rng(5).integers(low, high, 6000).tolist()
    sizes = spark.sparkContext.accumulator([], _Sizes())
    plain = packing.sum_of_squares
    monkeypatch.setattr(packing, "sum_of_squares", lambda x, c=packing.CAPACITY: (sizes.add([len(x)]), plain(x, c))[1])
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "row_id long, piece int, length long")
    got = packing.pack(pieces, group_rows=500).collect()
    used = collections.Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert len(got) == 6000 and max(used.values()) <= 2048
    per_bin = 2048 // low if high - low < 100 else None
    assert len(used) <= most * (6000 / per_bin + 12 if per_bin else 6000 if low > 1024 else sum(lengths) / 2048 + 24)
    assert max(sizes.value) < 700


class _Sizes(AccumulatorParam):
    def zero(self, value):
        return []

    def addInPlace(self, a, b):
        return a + b


def test_sum_of_squares_rule():
    """Each placement minimises the sum of squared counts of open bins per gap, checked by trying all."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 13, 300)
    bins, offsets = packing.sum_of_squares(lengths, 12)
    fill = collections.Counter()
    for n, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        cost = lambda f: sum(c * c for g, c in collections.Counter(12 - x for x in f.values()).items() if g)
        options = [cost({**fill, k: fill[k] + n}) for k in {fill[x]: x for x in fill if fill[x] + n <= 12}.values()] + [cost({**fill, -1: n})]
        assert fill[b] == o
        fill[b] += n
        assert cost(fill) == min(options)


def test_token_store(spark, docs, rows, none, tmp_path):
    got = [tuple(r) for r in token_store.token_round_trip(docs).orderBy("doc_id").collect()]
    enc, at = tokens.Encoder(tokens.public_file("word_bpe_49k.json")), 0
    for (doc, text, *_), r in zip(rows, got):
        ids = np.append(enc.encode(text or ""), 1).astype("<u4")
        assert r == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_store.token_round_trip(none).count() == 0
    path = f"file://{tmp_path}/t"
    token_store.write_tokens(docs, path, tokens.public_file("word_bpe_49k.json"), rows_per_file=20)
    part = token_store.read_tokens(spark, path).where("doc_id = 30")
    assert "doc_id" in part._jdf.queryExecution().executedPlan().toString() and part.count() == 1


def test_token_files_hold_indexes_filters_and_runs(spark, none, tmp_path):
    """ORC footers: row indexes, Bloom filters on the id, integer run-length encoding; a filter on the id reads few rows."""
    r = random.Random(2)
    rows = [(i * 7, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randint(0, 30))), None, "", 0) for i in range(6000)]
    path = f"file://{tmp_path}/orc"
    token_store.write_tokens(spark.createDataFrame(rows + rows[:3], SCHEMA), path, tokens.public_file("word_bpe_49k.json"), stripe_bytes=1 << 16, row_index_stride=1000, rows_per_file=3001)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = sorted(tmp_path.glob("orc/*.orc"))
    assert len(files) == 3
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000 and reader.getStripes().size() >= 1
        read = reader.rows()
        every = spark.sparkContext._gateway.new_array(jvm.boolean, 6)
        for k in range(6):
            every[k] = True
        index = read.readRowIndex(0, every, every)
        assert index.getBloomFilterIndex()[1] is not None and index.getBloomFilterIndex()[2] is None and index.getRowGroupIndex()[1].getEntryCount() >= 1
        kinds = [str(c.getKind()) for c in read.readStripeFooter(reader.getStripes()[0]).getColumnsList()]
        assert kinds[1] == kinds[3] == "DIRECT_V2" and kinds[5] in ("DIRECT_V2", "DICTIONARY_V2")
    one = spark.read.orc(path).where("doc_id = 28000")
    assert len(one.collect()) == 1
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numOutputRows").get().value() <= 2000
    digest = token_store.token_digest(token_store.read_tokens(spark, path)).collect()
    assert len(digest) == 6003 and len([d for d in digest if d.doc_id == 0]) == 2
    assert sum(d.n_tokens for d in digest) == max(d.start + d.n_tokens for d in digest)


# -- secrets ------------------------------------------------------------------------------------------
def test_base_spans():
    text = 'API_Key: "abcdefgh1" token=short secret = abc password:x12345678 AKIAABCDEFGHIJKL12 AKIAX ' + "0" * 31 + "g" + "a1" * 16
    assert [(text[a:b], k) for a, b, k in secrets.base_spans(text)] == [('API_Key: "abcdefgh1', 0), ("password:x12345678", 0), ("AKIAABCDEFGHIJKL12", 1), ("a1" * 16, 2)]
    assert secrets.base_spans("pa\u017f\u017fword=abcdefghij to\u212aen=12345678") == []
    assert secrets.base_spans("token=token=abcdefgh")[0][:2] == (0, 20)


def brute_base(text):
    """The base rules character by character, without regular expressions."""
    key = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low, out = text.translate(LOWER), []

    def run(i, allowed):
        while i < len(text) and text[i] in allowed:
            i += 1
        return i

    i = 0
    while i < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if low.startswith(word, i):
                ends = set()
                for quote in (1, 0):
                    j = i + len(word)
                    j += 1 if quote and text[j : j + 1] in ("'", '"') and j < len(text) else 0
                    j = run(j, {" "})
                    if text[j : j + 1] in (":", "=") and j < len(text):
                        k = run(j + 1, {" "})
                        for m in (k + 1 if text[k : k + 1] in ("'", '"') and k < len(text) else k, k):
                            if run(m, key) > m:
                                ends.add((m, run(m, key)))
                                break
                if ends:
                    end = max(ends)
                    break
        if end:
            if end[1] - end[0] >= 8:
                out.append((i, end[1], 0))
            i = end[1]
        else:
            i += 1
    i = 0
    while i < len(text):
        if text.startswith("AKIA", i) and (j := run(i + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))) > i + 4:
            out += [(i, j, 1)] * (j - i >= 16)
            i = j
        else:
            i += 1
    i = 0
    while i < len(text):
        j = run(i, set("0123456789abcdef"))
        out += [(i, j, 2)] * (j - i >= 32)
        i = max(j, i + 1)
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_brute_force():
    r = random.Random(12)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "APIkey", "'", '"', " ", "  ", ":", "=", "a", "f00", "AKIA", "QWER9", "TYUIOPAS", "é", "\n", "0123456789abcdef", "+/", "."]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert secrets.base_spans(text) == brute_base(text), text


def _generated(r, n, alphabet="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
    return "".join(r.choice(alphabet) for _ in range(n))


def test_secret_scan(spark, docs, none):
    """Base spans as by brute force; the field adds keys no pattern knows and leaves clean text alone."""
    r = random.Random(1)
    prose = [f"the river ran past {w} and its mill, where {v} people met in {y} and paid {c}.50 for bread" for w in ("Aston", "Brook", "Cole") for v, y, c in ((12, 1901, 3), (4800, 1999, 12))]
    clean = ["call +44 161 4960000 or write to jo.smith@mail.example.com on 2024-05-06", "see https://www.example.com/news/item-20441.html and version v1.2.3-beta", "card 4111 1111 1111 1111 from host 192.168.10.4", "the secret of the town is a token of its past", "for (i = 0; i < n; i++) { total += price_list[i]; }"]
    rows = [(i, f'{prose[i % 6]}\nsome words token = "{_generated(r, 40, "0123456789abcdef")}" and more of it\n{clean[i % 5]}', None, "", 0) for i in range(60)]
    rows += [(100 + i, prose[i % 6] + "\n" + clean[i % 5] + " and " + prose[(i + 1) % 6], None, "", 0) for i in range(60)]
    new = [lambda k: f"client_key={k}", lambda k: f"we saw ghp_{k} there", lambda k: f"the credential was {k} then", lambda k: f"auth: Bearer {k}", lambda k: f'pwd = "{k}"']
    keys = [_generated(r, 36) for _ in range(20)]
    rows += [(200 + i, prose[i % 6] + "\nÉté " + new[i % 5](k) + "\n" + clean[i % 5], None, "", 0) for i, k in enumerate(keys)]
    rows += [(900, None, None, "", 0), (901, "", None, "", 0), (902, rows[0][1], None, "", 0), (902, rows[0][1], None, "", 0), (903, "word " * 40000 + "client_key=" + keys[0], None, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = secrets.scan(df)
    got = {x.doc_id: x for x in secrets.span_digest(found).collect()}
    for doc, text, *_ in rows:
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in brute_base(text or ""))
        assert got[doc].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert got[doc].n_assign == got[doc].n_hex == int(doc < 100 or doc == 902) and set(filter(None, base.split(","))) <= set(got[doc].spans.split(","))
    spans = {x.doc_id: [(s.start, s.end) for s in x.spans if s.kind == "crf"] for x in found.collect()}
    texts = {d: t or "" for d, t, *_ in rows}
    caught = sum(any(keys[d - 200] in texts[d][a:b] for a, b in spans[d]) for d in range(200, 220))
    assert caught >= 16 and any(keys[0] in texts[903][a:b] for a, b in spans[903])
    assert sum(map(len, (spans[d] for d in range(160) if d in spans))) <= 3 and spans[900] == spans[901] == []
    assert found.where("doc_id = 902").count() == 2 and got[902].spans == got[0].spans
    assert secrets.scan(none).count() == 0


def test_crf_decoding_is_best_path():
    """Whole lines, decoded by cutting at sure tokens, against all tag sequences."""
    rng = np.random.default_rng(3)
    for trial in range(60):
        move = rng.normal(size=(3, 3))
        move[0, 2] = -1e9
        crf = secrets.Crf([], move, np.zeros(1 << 16))
        n = int(rng.integers(1, 7))
        e = rng.normal(size=(n, 3)) * rng.choice([1, 8], size=(n, 1))
        score = lambda y: sum(e[i, t] for i, t in enumerate(y)) + sum(move[a, b] for a, b in zip((0, *y), (*y, 0)))
        assert tuple(crf.decode(e, np.zeros(n))) == max(itertools.product(range(3), repeat=n), key=score)
    two = np.concatenate([e, e])
    assert crf.decode(two, np.repeat([0, 1], n)).tolist() == crf.decode(e, np.zeros(n)).tolist() * 2


def test_crf_gradient():
    """The fitted field makes its own training tags likely: it reads them back."""
    lines = [(f"alpha beta token = {_generated(random.Random(i), 40, '0123456789abcdef')} gamma", 0) for i in range(40)]
    chains, surprise = secrets.training_chains(lines)
    crf = secrets.fit_crf(chains, surprise)
    right = sum((crf.decode(crf.scores(x), np.zeros(len(y))) == y).sum() for x, y in chains)
    assert right / sum(len(y) for _, y in chains) > 0.97


def test_tokens_of_texts():
    texts = ["a.b-c. d=e", "P@ss, x", "", "é+/ -z"]
    raw = [t.encode() for t in texts]
    t = secrets.Tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), np.zeros(1 << 16))
    whole = b"".join(raw)
    assert [whole[a:b].decode() for a, b in zip(t.start, t.end)] == ["a.b-c", ".", "d", "=", "e", "P", "@", "ss", ",", "x", "é+/", "-", "z"]
    assert t.doc.tolist() == [0] * 5 + [1] * 5 + [3] * 3 and len(set(t.line.tolist())) == 3
    assert (t.x >= 0).all() and (t.x < np.array(secrets.SIZES)).all()


# -- languages ------------------------------------------------------------------------------------------
def test_language_held_out_accuracy(spark):
    r = random.Random(8)
    parts = {"aa": ["th", "er", "on", "an", "re"], "bb": ["ung", "sch", "ich", "ein"], "cc": ["eau", "que", "oi", "ment"]}
    rows = []
    for i in range(300):
        lang = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(r.randint(3, 60))), lang, "", 0))
    rows += [(1000, None, "aa", "", 0), (1001, "123 !!", "bb", "", 0), (1002, "", None, "", 0)]
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got)
    held = [got[d].lang_pred == lang for d, _, lang, *_ in rows[:300] if got[d].held_out]
    assert len(held) > 50 and sum(held) / len(held) > 0.97
    assert [(got[d].lang_pred, got[d].score) for d in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert all(0 <= x.score <= 1 for x in got.values())


def _grams(text):
    """N-grams of a text as sets of bytes: ASCII other than letters reads as a space, letters in lower case."""
    raw = bytes(32 if c < 128 and not chr(c).isalpha() else c + 32 if 65 <= c <= 90 else c for c in text.encode())
    return {raw[i : i + n] for n in (2, 3, 4) for i in range(len(raw) - n + 1)}


def test_language_kernel_equals_sets():
    """Distinct n-grams, kernel values and predictions against sets and a plain ridge regression."""
    r = random.Random(3)
    texts = ["", "a", "Ab", "the cat, the hat", "日本語のテキスト", "aaaa aaaa"] + ["".join(r.choice("abcdef gh") for _ in range(r.randint(1, 90))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    keys, edge = langid.grams(np.frombuffer(b"".join(raw), np.uint8), off)
    sets = [_grams(t) for t in texts]
    assert np.diff(edge).tolist() == [len(s) for s in sets]
    mine = [keys[a:b] for a, b in zip(edge[:-1], edge[1:])]
    vocabulary, marks = langid.landmark_rows(mine[3:20])
    kernel = langid.found_in(vocabulary, keys, edge) @ marks.T / np.sqrt(np.maximum(np.diff(edge), 1))[:, None]
    wanted = np.array([[len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b))) for b in sets[3:20]] for a in sets])
    assert np.allclose(kernel, wanted, atol=1e-5)
    labels = ["xyz"[i % 3] for i in range(len(texts))]
    model = langid.fit(kernel, labels, vocabulary, marks)
    value, vector = np.linalg.eigh(wanted[3:20])
    keep = value > 1e-6 * value.max()
    z = wanted @ (vector[:, keep] / np.sqrt(value[keep]))
    y = np.where(np.array(labels)[:, None] == np.array(["x", "y", "z"]), 1.0, -1.0)
    zc, yc = z - z.mean(axis=0), y - y.mean(axis=0)
    w = np.linalg.solve(zc.T @ zc + 1e-2 * len(z) * np.eye(z.shape[1]) / z.shape[1], zc.T @ yc)
    assert np.allclose(model.values(keys, edge), zc @ w + y.mean(axis=0), atol=2e-2)


def test_language_repeated_long_and_many_labels(spark):
    """Rows that repeat are predicted each and alike; very long texts are read whole; no label is left out."""
    r = random.Random(5)
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + (i % 260) // 26)}{r.choice('xy')}" for _ in range(30)), f"l{i % 260:03d}", "", 0) for i in range(260 * 14)]
    rows += [(9999, rows[5][1], None, "", 0)] * 2 + [(9998, rows[7][1] * 3000, None, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(df)
    assert len(model.languages) == 260
    got = langid.predict(df.where("doc_id >= 9998"), model).collect()
    assert len(got) == 3 and len({(x.lang_pred, x.score) for x in got if x.doc_id == 9999}) == 1
    assert {x.lang_pred for x in got if x.doc_id == 9998} == {"l007"}


def test_language_without_labels(spark, none):
    df = spark.createDataFrame([(1, "some text", None, "", 0)], SCHEMA)
    assert [tuple(r)[2:] for r in langid.identify(df).collect()] == [("und", 0.0)]
    assert langid.identify(none).count() == 0


# -- top-k ------------------------------------------------------------------------------------------------
def test_top_inner_products(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(-300, 300, (700, 12))
    v[100:180] = v[100]  # ties: one vector many times
    rows = [(i, [float(x) / 256 for x in row]) for i, row in enumerate(v.tolist())]
    rows += [(9000, None), (9001, [1.0, None]), (9002, [float("nan")] * 12), (9003, []), (9050, [0.5] * 12), (9050, [0.5] * 12), (9100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_inner.top_inner_products(topk_inner.integer_vectors(df), _mod("vec_id", 50), k=5, block=60, query_block=6).collect()
    ids, vectors = [*range(700), 9050], np.concatenate([v, [[128] * 12]])
    wanted = set()
    for q in (i for i in ids if i % 50 == 0):
        s = vectors @ vectors[ids.index(q)]
        best = sorted((-int(x), c) for x, c in zip(s, ids) if c != q)[:5]
        wanted |= {(q, k, c, -x) for k, (x, c) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == wanted
    assert topk_inner.top_inner_products(topk_inner.integer_vectors(df.where("false")), _mod("vec_id", 50)).count() == 0
    null = spark.createDataFrame([(None, [1.0, 2.0]), (50, [1.0, 0.0]), (50, [2.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk_inner.top_inner_products(topk_inner.integer_vectors(null), _mod("vec_id", 50)).collect()] == [(50, 1, 1, 65536)]


def test_top_inner_products_negative_and_huge(spark):
    """Scores below zero, zero vectors and products beyond the doubles' exact range."""
    rng = np.random.default_rng(8)
    v = np.concatenate([-np.abs(rng.integers(1, 9, (60, 4))), np.abs(rng.integers(1, 9, (40, 4))), np.zeros((5, 4), np.int64), rng.integers(2**28, 2**29, (30, 4))])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, v array<long>")
    got = {tuple(r) for r in topk_inner.top_inner_products(df, _mod("vec_id", 5), k=3, block=20, query_block=7).collect()}
    wanted = set()
    for q in range(0, len(v), 5):
        best = sorted((-sum(int(x) * int(y) for x, y in zip(v[q], v[c])), c) for c in range(len(v)) if c != q)[:3]
        wanted |= {(q, k, c, -x) for k, (x, c) in enumerate(best, 1)}
    assert got == wanted


def _mod(c, n):
    from pyspark.sql import functions as F

    return F.col(c) % n == 0


# -- decontamination ------------------------------------------------------------------------------------------
ITEM = "A train leaves with Maria at 60 km an hour and Peter walks 12 km after Maria has gone for 3 hours to reach the old town"


def test_decontamination(spark, none):
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    changed = ITEM.replace("Maria", "Olga").replace("Peter", "Hans").replace("60 km", "75 miles").replace("12 km", "9 miles").replace(" 3 ", " 4 ")
    broken = ITEM.replace("Maria", "Olga", 1)  # one name becomes two: no consistent reading across it
    docs = spark.createDataFrame(
        [(1, "Some text first. " + ITEM + " And more.", None, "", 0), (2, "Well, here it comes: " + changed, None, "", 0), (3, "A train leaves at noon and nobody walks after it has gone to the town", None, "", 0), (4, None, None, "", 0), (5, "", None, "", 0), (6, ITEM.lower() + " " + "word " * 3000, None, "", 0), (None, ITEM, None, "", 0), (8, ITEM, None, "", 0), (8, ITEM, None, "", 0), (9, broken, None, "", 0)],
        SCHEMA,
    )
    got = {r.doc_id: r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) - {6, 9} == {1, 2, None, 8} and all(r.item_id == 1 for r in got.values())
    assert got[1].n_changed == 0 and got[2].n_changed == 5
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {3, 4, 5} <= {r.doc_id for r in kept.collect()} <= {3, 4, 5, 6, 9}
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0


def test_decontamination_runs_no_python(spark, docs, tmp_path):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    items.write.parquet(f"file://{tmp_path}/items")
    plan = decontaminate.contaminated(docs.limit(0), spark.read.parquet(f"file://{tmp_path}/items"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("docs", ""))


def _found(spark, item, *texts):
    docs = spark.createDataFrame([(i, t, None, "", 0) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}


def test_decontamination_window_hashes(spark):
    """Equal hashes for equal windows of one size only, also of repeated tokens; no window's tokens are copied to hash it."""
    r = random.Random(11)
    lists = [[r.randint(0, 2) for _ in range(n)] for n in (1, 2, 5, 8, 9, 40, 40)] + [[1] * 20]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, h array<long>")
    named = df.select("i", *(decontaminate._hashes("h", w).alias(f"w{w}") for w in range(1, 9)))
    assert "xxhash64(slice" not in named._jdf.queryExecution().analyzed().toString()
    seen = {}
    for row in named.collect():
        tokens = lists[row.i]
        for w in range(1, 9):
            assert len(row[f"w{w}"]) == len(tokens)
            for at in range(len(tokens) - w + 1):
                assert seen.setdefault(row[f"w{w}"][at], tuple(tokens[at : at + w])) == tuple(tokens[at : at + w])
    assert len(seen) == len(set(seen.values()))


def test_decontamination_cuts_at_slot_conflicts(spark):
    """A conflict on a diagonal ends a run; the consistent parts count."""
    got = _found(spark, ITEM, ITEM.replace("Maria", "Olga", 1))
    assert got[0].longest_run == 19 and got[0].n_changed == 1
    fruit = "Ben buys 2 apples and 2 pears at the old market for 8 dollars, what is the price of one pear"
    assert set(_found(spark, fruit, fruit.replace("2 apples", "3 apples").replace("2 pears", "5 pears"), "Ben buys pears at the old market")) == {0}


def test_decontamination_names_at_sentence_starts_and_in_any_case(spark):
    assert _found(spark, ITEM, "so " + ITEM.lower() + " then")[0].n_covered == 24
    item = "Tom has 5 apples. Ann has 7 pears. Bob has 9 plums. How many pieces of fruit have they?"
    other = "Well. Jim has 3 apples. Sue has 4 pears. Max has 6 plums. How many pieces of fruit have they?"
    assert _found(spark, item, other)[0].n_covered == 19


def test_decontamination_of_short_and_dense_items(spark):
    short = "What is the capital of France?"
    assert set(_found(spark, short, "He asked: what is the capital of France? Paris.", "the capital of trade is what it is", "")) == {0}
    dense = "Solve 3 x + 4 y = 12 and 5 x - 2 y = 7"
    assert set(_found(spark, dense, "Now " + dense.lower() + " for me", "Solve 8 x + 1 y = 2 and 3 x - 9 y = 4")) == {0}


def _canonical(text):
    """The three forms of a text, by a scan of its own over the tokens."""
    units = {u.lower() for u in decontaminate.UNITS}
    words, tokens, named, first = [], [], [], True
    for m in regex.finditer(r"([.!?\n][^\p{L}\p{N}]*)?([0-9]+(?:[.,:/][0-9]+)*|\p{L}+(?:['’]\p{L}+)*)", text):
        if m.start(2) < (words[-1][1] if words else 0):  # a unit that its number has taken
            continue
        word, end, number = m[2], m.end(2), m[2][0] in "0123456789"
        if number:
            tail = regex.match(r"(\s?)(%|°|€|\$|£|\p{L}+/?\p{L}*)", text[end:])
            kind = "<num>"
            if tail:
                best = max((u for u in units if text[end + len(tail[1]) :].lower().startswith(u) and not regex.match(r"[\p{L}\p{N}]", text[end + len(tail[1]) + len(u) :][:1] or " ")), key=len, default="")
                best = tail[2] if tail[2] in "%°€$£" else best
                if best:
                    word, end, kind = text[m.start(2) : end + len(tail[1]) + len(best)], end + len(tail[1]) + len(best), "<qty>"
            token = name = kind
        else:
            capital = len(word) > 1 and word[0] != word[0].lower() and word[1:] == word[1:].lower()
            token = "<name>" if capital and not first and not m[1] else word.lower()
            name = "<name>" if capital else token
        words.append((word.lower(), end))
        tokens.append(token)
        named.append(name)
        first = False
    return [w for w, _ in words], tokens, named


def brute_contaminated(docs, items, window=8, literals=5, run=13, share=0.5):
    out = set()
    for item, text in set(items):
        forms = _canonical(text or "")
        n = len(forms[0])
        w = min(n, window)
        for doc, body in set(docs):
            own = _canonical(body or "")
            diagonals = collections.defaultdict(dict)
            for at in range(n - w + 1) if n else ():
                a = [tuple(f[at : at + w]) for f in forms]
                plain = [sum(not t.startswith("<") for t in x) for x in a]
                chosen = {a[0]} | ({a[1]} if plain[1] >= literals else set()) | ({a[2]} if plain[1] >= literals and plain[2] >= literals - 1 else set())
                for p in range(len(own[0]) - w + 1):
                    if chosen & {tuple(f[p : p + w]) for f in own}:
                        slots = {(forms[0][at + i], own[0][p + i]) for i in range(w) if forms[1][at + i].startswith("<") or forms[0][at + i] != own[0][p + i]}
                        if len({x for x, _ in slots}) == len(slots):
                            diagonals[p - at][at] = slots
            covered, whole, longest, slots = set(), set(), 0, set()
            for found in diagonals.values():
                every = set().union(*found.values())
                slots |= every
                covered |= {i for at in found for i in range(at, at + w)}
                if len({x for x, _ in every}) == len(every):
                    whole |= set(found)
                    continue
                ats = sorted(found)
                for i, j in itertools.combinations_with_replacement(range(len(ats)), 2):
                    joint = set().union(*(found[x] for x in ats[i : j + 1]))
                    if all(y - x <= w for x, y in zip(ats[i:j], ats[i + 1 : j + 1])) and len({x for x, _ in joint}) == len(joint):
                        longest = max(longest, ats[j] + w - ats[i])
            start = None
            for at in sorted(whole):
                start = at if start is None or at - before > w else start
                before = at
                longest = max(longest, at + w - start)
            if covered and (longest >= run or len(covered) >= share * n):
                out.add((doc, item, n, len(covered), longest, len(slots), sum(x != y for x, y in slots)))
    return out


@pytest.mark.parametrize("broadcast", [0, decontaminate.BROADCAST_WINDOWS])
def test_decontamination_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    r = random.Random(21)
    items = [(1, ITEM), (2, "What is the capital of France?"), (3, "Solve 3 x + 4 y = 12 and 5 x - 2 y = 7"), (4, "Tom has 5 apples. Ann has 7 pears. Bob has 9 plums. How many pieces of fruit have they?"), (5, None), (6, ""), (1, ITEM), (7, "The mill wheel turns 12.5 times a minute, how often does it turn in 3 hours and 20 min of work?")]
    names, docs = ["Olga", "Hans", "Maria", "Peter", "Ann", "Tom"], []
    for i in range(150):
        text = r.choice([t for _, t in items if t])
        for old in regex.findall(r"[0-9]+", text) if r.random() < 0.6 else ():
            text = text.replace(old, str(r.randint(2, 99)), r.choice([1, -1]))
        for old in names if r.random() < 0.5 else ():
            text = text.replace(old, r.choice(names), r.choice([1, -1]))
        w = text.split(" ")
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = r.choice(["stone", "Stone", "7", "km", "old.", "of"])
        cut = r.randrange(len(w)) if r.random() < 0.3 else 0
        docs.append((i, " ".join(["Well then.", *w[cut:], *r.choice([[], ["and", "so", "on"], text.split(" ")])])))
    docs += [(900, None), (901, ""), (902, "one"), (None, ITEM), (8, ITEM), (8, ITEM)]
    df = spark.createDataFrame([(d, t, None, "", 0) for d, t in docs], SCHEMA)
    bench = spark.createDataFrame([(i, t, 5, "h", "words") for i, t in items], "item_id long, text string, pos int, h string, words string")  # columns that clash with inner names
    got = {(x.doc_id, x.item_id, x.n_item_tokens, x.n_covered, x.longest_run, x.n_slots, x.n_changed) for x in decontaminate.contaminated(df, bench).collect()}
    wanted = brute_contaminated(docs, items)
    assert got == wanted, (sorted(got - wanted, key=str)[:3], sorted(wanted - got, key=str)[:3])
    assert 40 < len(got) < 300
