"""The queries of this subpackage and their SQL, as ``__spark_entry__.py`` adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickforge.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op2_norm_sorted_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tickforge.llm.topk_inner import integer_vectors, top_inner_products

    return top_inner_products(integer_vectors(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


def op3_crf_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickforge.llm.secrets import scan, span_digest

    return span_digest(scan(_table(spark, sf_dir, "documents")))


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickforge.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op5_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickforge.llm.parity_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op6_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickforge.llm.lm_score import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where("quality = 1"))


def op7_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickforge.llm.token_store import token_round_trip

    return token_round_trip(_table(spark, sf_dir, "documents"))


def op8_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tickforge.llm.line_dedup import drop_lines

    return drop_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickforge.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op10_bucket_pointer_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickforge.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_template_decontamination": op1_template_decontamination,
    "op2_norm_sorted_top_k": op2_norm_sorted_top_k,
    "op3_crf_secret_scan": op3_crf_secret_scan,
    "op4_sum_of_squares_packing": op4_sum_of_squares_packing,
    "op5_parity_sketch_join": op5_parity_sketch_join,
    "op6_cross_entropy_difference": op6_cross_entropy_difference,
    "op7_orc_tokens": op7_orc_tokens,
    "op8_line_winnowing": op8_line_winnowing,
    "op9_string_kernel_language": op9_string_kernel_language,
    "op10_bucket_pointer_refinement": op10_bucket_pointer_refinement,
}

ORACLE_SQL: dict[str, str] = {
    "op2_norm_sorted_top_k": """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x::DOUBLE)]) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op8_line_winnowing": """
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l),
n AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c WHERE line <> ''),
v AS (SELECT doc_id, k, line, lead(line) OVER o AS two, lead(line, 2) OVER o AS three FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
w AS (SELECT doc_id, k, 1 AS size, line AS gram FROM v WHERE length(line) >= 200 UNION ALL
      SELECT doc_id, k, 2, line || chr(10) || two FROM v WHERE length(line) + length(two) >= 200 UNION ALL
      SELECT doc_id, k, 3, line || chr(10) || two || chr(10) || three FROM v WHERE three IS NOT NULL),
r AS (SELECT doc_id, k, size, row_number() OVER (PARTITION BY size, gram ORDER BY doc_id, k) AS seen FROM w),
g AS (SELECT DISTINCT n.doc_id, n.i FROM r JOIN n ON n.doc_id = r.doc_id AND n.k BETWEEN r.k AND r.k + r.size - 1 WHERE r.seen > 1),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS kept FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
""",
}
