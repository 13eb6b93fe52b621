"""How a query is registered: a builder over a folder of tables, and the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickforge.functions import gis, scalars, series_ops
from tickforge.plans import rewrite
from tickforge.session import configure

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_ready: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Settings and SQL functions, once per session."""
    configure(spark)
    key = f"{spark.sparkContext.applicationId}/{spark._jsparkSession.sessionUUID()}"
    if key not in _ready:
        scalars.register(spark)
        gis.register(spark)
        series_ops.register(spark)
        for name, (args, result, body) in rewrite.HELPERS.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
        _ready.add(key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dialect(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a query in the engine's dialect over the tables it names."""
    for name in TABLES:
        if name in text:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    ready = rewrite.select(text, {"server_version": "1.0", "cluster_name": "spark", "deployment_mode": "singleton", "node_id": "1"}, {"current_tenant": "default", "current_user": "root", "current_database": "public", "current_role": "owner"})

    def analyses(sql: str) -> bool:
        try:
            spark.sql(sql).schema  # noqa: B018
            return True
        except Exception:  # any error of the analyser means: not this form
            return False

    return spark.sql(rewrite.integer_division(ready, analyses) if "/" in ready else ready)


def query(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder."""

    def register(build: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = oracle
        return build

    return register


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query in the engine's dialect; without ``oracle`` the same text is standard SQL."""
    query(name, oracle or text)(lambda spark, sf_dir: dialect(spark, sf_dir, text))
