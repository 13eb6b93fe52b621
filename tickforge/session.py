"""Session settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the engine's settings to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def session(name: str = "tickforge", **options: str) -> SparkSession:
    """Build or get a session with the engine's settings."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **options}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, or a temporary one where the session names none and runs on one machine."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/tickforge-{uuid.uuid4().hex}" if base else "file://" + tempfile.mkdtemp(prefix="tickforge-")
