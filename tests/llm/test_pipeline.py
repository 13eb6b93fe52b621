"""The pipeline on a small corpus, stage by stage against brute force."""

import random
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, brute_components, brute_lines, corpus
from tickforge.llm import _common, langid

ITEM = "The quick wool merchant sold 14 bales to Anna and then walked 9 km home along the river road"


def test_pipeline(spark, tmp_path):
    rows = corpus(seed=5, n=48)
    rows += [(2000, "before it " + ITEM + " after it", "en", "x", 1), (2001, "12 34 !!", "en", "x", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen.append([tuple(r) for r in docs.collect()])
        docs = spark.createDataFrame(seen[-1], docs.schema)
    language, lines, near, clean, packed = seen
    kept = {r[0] for r in language}
    assert kept <= {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])} and len(kept) > 40
    wanted = {d: t for d, (_, n, t) in brute_lines(language, 3).items() if n == 0 or t.strip()}
    assert {r[0]: r[1] for r in lines} == wanted
    assert {r[0] for r in near} == {c for d, _, c in brute_components(lines, 5, 80)}
    assert {r[0] for r in near} - {r[0] for r in clean} == {2000}
    assert {r[0] for r in packed} == {r[0] for r in clean}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole.collect()} == {(r[0], r[1], r[3], r[4]) for r in packed}


CLASHES = ["lang_pred", "score", "n_removed", "n_lines", "counts", "doc", "sub", "row", "text_hash", "bucket", "component_id", "n_shingles", "h", "g", "item_id", "row_id", "piece", "start", "__h", "__id", "x"]


def test_stages_with_awkward_tables(spark, tmp_path):
    """Columns named like inner ones, null and repeated ids, repeated rows, null and empty texts, in every stage."""
    base = corpus(seed=6, n=30)
    rows = [(d, t, lang, "s", len(t or ""), *[f"c{k}" for k in range(len(CLASHES))]) for d, t, lang, *_ in base]
    again = [rows[0], rows[0], (rows[1][0], "another text that stands under an id twice, quite unlike the first one", *rows[1][2:]), *[(None, *r[1:]) for r in rows[2:4]], (None, None, *rows[0][2:])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    spark.createDataFrame(rows + again, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM, "a", "b"), (1, ITEM, "a", "b"), (None, None, None, None)], "item_id long, text string, h string, words string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    given = {tuple(r)[5:] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema == docs.schema, name
        found = out.collect()
        assert {tuple(r)[5:] for r in found} <= given and 5 < len(found) <= docs.count(), name
        docs = spark.createDataFrame(found, docs.schema)
    texts = [r.text for r in found]
    assert len(texts) == len(set(texts)) and any("stands under an id twice" in t for t in texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in packed if r.piece == 0) == sorted(str(r.doc_id) for r in found)


def test_stages_with_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [r for r in corpus(seed=7, n=12) if r[1]]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == len(rows)


def test_decontamination_shuffles_no_text(spark, tmp_path):
    rows = [(i, f"text number {i} of a few", "en", "x", 1) for i in range(20)] + [(None, "no id " + ITEM, "en", "x", 1), (7, "twice " + ITEM, "en", "x", 1), (21, None, "en", "x", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = corpus_pipeline.decontaminate(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        found = left.collect()
        plan = left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert sorted(map(str, found)) == sorted(map(str, (r for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect() if ITEM not in (r.text or ""))))


def test_registered_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def test_language_stage_rejects_unlearnt_languages(spark):
    r = random.Random(8)
    parts = {"aa": ["th", "er", "on", "an", "re"], "bb": ["ung", "sch", "ich", "ein"], "cc": ["eau", "que", "oi", "ment"], None: ["zy", "wk", "vu", "xo"]}
    prose = lambda lang, k: " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(k))
    rows = [(i, prose(lang := ["aa", "bb", "cc"][i % 3], r.randint(3, 60)), lang, "", 0) for i in range(600)]
    rows += [(1000 + i, prose(["aa", "bb", "cc"][i % 3], 2), None, "", 0) for i in range(12)]
    rows += [(2000 + i, prose(None, 40), None, "", 0) for i in range(12)] + [(2100, "日本語のテキスト" * 20, None, "", 0)]
    kept = {x.doc_id for x in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert {d for d in kept if d >= 1000} == set(range(1000, 1012))
    assert len(kept) >= 0.99 * 600 + 12


def test_floors_are_learnt_from_every_held_out_text(spark):
    r = random.Random(9)
    parts = {"aa": ["th", "er", "on", "an", "re"], "bb": ["ung", "sch", "ich", "ein"], "cc": ["eau", "que", "oi", "ment"], None: ["zy", "wk", "vu", "xo"]}
    share = lambda lang: " ".join("".join(r.choice(parts[lang if r.random() < mixed else None]) for _ in range(3)) for _ in range(30))
    rows = []
    for i in range(900):
        mixed = r.random()
        rows.append((i, share(lang := "aaaabc"[i % 6] + "aaaabc"[i % 6]), lang, "", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs)
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    brute = {}
    for cut in langid.CUTS:
        texts = spark.createDataFrame([(x[0], x[1][:cut]) for x in held if len(x[1]) >= cut], "doc_id long, text string")
        score = {x.doc_id: x.score for x in langid.predict(texts, model).collect() if x.lang_pred != "und"}
        n = {lang: sum(x[0] in score for x in held if x[2] == lang) for lang in model.languages}
        if len(score) >= langid.LEAST_TEXTS:
            weight = {x[0]: min(10, n[x[2]]) / n[x[2]] for x in held if x[0] in score}
            reached = max(k for k in {int(s * langid.STEPS) for s in score.values()} if sum(w for d, w in weight.items() if int(score[d] * langid.STEPS) < k) <= 0.01 * sum(weight.values()))
            brute[cut] = (1 / 3 + reached / langid.STEPS) / 2
    assert len(brute) >= 2 and len(held) > 200
    assert langid.floors(docs, model, sample_docs=30) == brute


def test_stages_send_texts_once_and_in_small_batches(spark):
    rows = [r for r in corpus(seed=10, n=30) if r[1]]
    docs, key = spark.createDataFrame(rows, SCHEMA), "spark.sql.execution.arrow.maxRecordsPerBatch"
    sizes = lambda b: (pa.RecordBatch.from_arrays([pa.array([x.num_rows])], names=["n"]) for x in b)
    for name, stage in corpus_pipeline.STAGES:
        if name == "benchmark decontamination":  # no Python
            continue
        spark.conf.unset(key)
        stage(spark, docs, "")
        assert max(r.n for r in spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long").collect()) <= _common.BATCH_ROWS, name
    spark.conf.set(key, "7")
    sent = corpus_pipeline.language_id(spark, docs, "")
    assert spark.conf.get(key) == "7"
    spark.conf.unset(key)
    plan = sent._jdf.queryExecution().analyzed().toString()
    assert "cast(text" not in plan and " AS text" not in plan.split("MapInArrow")[-1]
    other = corpus_pipeline.language_id(spark, docs.withColumn("text", F.col("text").cast("binary")), "")  # cast for the model, returned as it is
    assert sorted((r.doc_id, bytes(r.text).decode()) for r in other.collect()) == sorted((r.doc_id, r.text) for r in sent.collect())
