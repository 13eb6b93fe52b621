"""Scalar functions whose meaning differs between the engine's SQL dialect and Spark's.

Each is a SQL expression over its arguments, registered as a temporary SQL
function, so Catalyst inlines it and it stays in generated code.  ``REWRITES`` maps
the dialect's names to the registered ones; names that mean the same in Spark are
absent.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_LOG = "CASE WHEN x IS NULL THEN NULL WHEN isnan(x) OR x < 0 THEN double('NaN') WHEN x = 0 THEN double('-Infinity') ELSE {f}(x) END"

#: name: (arguments, result type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "tf_chr": ("n BIGINT", "STRING", "CASE WHEN n <= 0 OR n > 1114111 THEN raise_error('chr: no such code point') WHEN n < 128 THEN chr(n) ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END"),
    "tf_left": ("s STRING, n BIGINT", "STRING", "CASE WHEN n >= 0 THEN left(s, int(n)) ELSE left(s, greatest(0, length(s) + int(n))) END"),
    "tf_right": ("s STRING, n BIGINT", "STRING", "CASE WHEN n >= 0 THEN right(s, int(n)) ELSE right(s, greatest(0, length(s) + int(n))) END"),
    "tf_initcap": ("s STRING", "STRING", "array_join(transform(regexp_extract_all(s, '([\\\\p{L}\\\\p{N}]+|[^\\\\p{L}\\\\p{N}]+)', 1), w -> upper(substring(w, 1, 1)) || lower(substring(w, 2))), '')"),
    "tf_strpos": ("s STRING, sub STRING", "BIGINT", "bigint(locate(sub, s))"),
    "tf_to_hex": ("n BIGINT", "STRING", "lower(hex(n))"),
    "tf_substr": ("s STRING, start BIGINT", "STRING", "substring(s, int(greatest(start, 1)))"),
    "tf_substr_n": ("s STRING, start BIGINT, n BIGINT", "STRING", "CASE WHEN n < 0 THEN raise_error('substr: negative length') ELSE substring(s, int(greatest(start, 1)), int(greatest(0, least(start, 1) - 1 + n))) END"),
    "tf_sha224": ("s STRING", "BINARY", "unhex(sha2(s, 224))"),
    "tf_sha256": ("s STRING", "BINARY", "unhex(sha2(s, 256))"),
    "tf_sha384": ("s STRING", "BINARY", "unhex(sha2(s, 384))"),
    "tf_sha512": ("s STRING", "BINARY", "unhex(sha2(s, 512))"),
    "tf_digest": ("s STRING, method STRING", "BINARY", "CASE lower(method) WHEN 'md5' THEN unhex(md5(s)) WHEN 'sha224' THEN unhex(sha2(s, 224)) WHEN 'sha256' THEN unhex(sha2(s, 256)) WHEN 'sha384' THEN unhex(sha2(s, 384)) WHEN 'sha512' THEN unhex(sha2(s, 512)) ELSE raise_error('digest: unknown method') END"),
    "tf_ceil": ("x DOUBLE", "DOUBLE", "CASE WHEN abs(x) < 9007199254740992 THEN double(ceil(x)) ELSE x END"),
    "tf_floor": ("x DOUBLE", "DOUBLE", "CASE WHEN abs(x) < 9007199254740992 THEN double(floor(x)) ELSE x END"),
    "tf_trunc": ("x DOUBLE", "DOUBLE", "CASE WHEN abs(x) < 9007199254740992 THEN signum(x) * double(floor(abs(x))) ELSE x END"),
    "tf_ln": ("x DOUBLE", "DOUBLE", _LOG.format(f="ln")),
    "tf_log10": ("x DOUBLE", "DOUBLE", _LOG.format(f="log10")),
    "tf_log2": ("x DOUBLE", "DOUBLE", _LOG.format(f="log2")),
    "tf_logb": ("b DOUBLE, x DOUBLE", "DOUBLE", "tf_ln(x) / tf_ln(b)"),
    # Euclid's steps in a fold: 93 steps bring any two 64-bit integers to their divisor
    "tf_gcd": ("a BIGINT, b BIGINT", "BIGINT", "aggregate(sequence(1, 93), named_struct('a', abs(a), 'b', abs(b)), (s, _) -> IF(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)"),
    "tf_lcm": ("a BIGINT, b BIGINT", "BIGINT", "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = 0 OR b = 0 THEN 0 ELSE abs(a) div tf_gcd(a, b) * abs(b) END"),
    "tf_date_part": (
        "part STRING, t TIMESTAMP_NTZ",
        "DOUBLE",
        "CASE lower(part) WHEN 'year' THEN year(t) WHEN 'quarter' THEN quarter(t) WHEN 'month' THEN month(t) WHEN 'week' THEN weekofyear(t) WHEN 'day' THEN day(t) WHEN 'doy' THEN dayofyear(t) "
        "WHEN 'dow' THEN dayofweek(t) - 1 WHEN 'hour' THEN hour(t) WHEN 'minute' THEN minute(t) WHEN 'second' THEN double(extract(second FROM t)) WHEN 'millisecond' THEN double(extract(second FROM t)) * 1000 "
        "WHEN 'microsecond' THEN double(extract(second FROM t)) * 1000000 WHEN 'nanosecond' THEN double(extract(second FROM t)) * 1000000000 WHEN 'epoch' THEN unix_micros(CAST(t AS TIMESTAMP_LTZ)) / 1000000D ELSE raise_error('date_part: unknown part') END",
    ),
    "tf_from_unixtime": ("n BIGINT", "TIMESTAMP_NTZ", "CAST(timestamp_seconds(n) AS TIMESTAMP_NTZ)"),
    "tf_to_timestamp": ("n BIGINT", "TIMESTAMP_NTZ", "CAST(timestamp_micros(bigint(floor(n / 1000BD))) AS TIMESTAMP_NTZ)"),
    "tf_to_timestamp_seconds": ("n BIGINT", "TIMESTAMP_NTZ", "CAST(timestamp_seconds(n) AS TIMESTAMP_NTZ)"),
    "tf_to_timestamp_millis": ("n BIGINT", "TIMESTAMP_NTZ", "CAST(timestamp_millis(n) AS TIMESTAMP_NTZ)"),
    "tf_to_timestamp_micros": ("n BIGINT", "TIMESTAMP_NTZ", "CAST(timestamp_micros(n) AS TIMESTAMP_NTZ)"),
    "tf_parse_timestamp": ("s STRING", "TIMESTAMP_NTZ", "CAST(CAST(s AS TIMESTAMP_LTZ) AS TIMESTAMP_NTZ)"),
    "tf_date_bin": ("w INTERVAL DAY TO SECOND, t TIMESTAMP_NTZ, o TIMESTAMP_NTZ", "TIMESTAMP_NTZ", "CAST(timestamp_micros(unix_micros(CAST(t AS TIMESTAMP_LTZ)) - pmod(unix_micros(CAST(t AS TIMESTAMP_LTZ)) - unix_micros(CAST(o AS TIMESTAMP_LTZ)), bigint(extract(DAY FROM w) * 86400000000 + extract(HOUR FROM w) * 3600000000 + extract(MINUTE FROM w) * 60000000 + extract(SECOND FROM w) * 1000000))) AS TIMESTAMP_NTZ)"),
}

#: Names of the dialect and what the front-end puts for them, by number of arguments where that matters.
REWRITES: dict[str, str | dict[int, str]] = {
    "chr": "tf_chr",
    "left": "tf_left",
    "right": "tf_right",
    "initcap": "tf_initcap",
    "strpos": "tf_strpos",
    "to_hex": "tf_to_hex",
    "substr": {2: "tf_substr", 3: "tf_substr_n"},
    "sha224": "tf_sha224",
    "sha256": "tf_sha256",
    "sha384": "tf_sha384",
    "sha512": "tf_sha512",
    "digest": "tf_digest",
    "ceil": "tf_ceil",
    "floor": "tf_floor",
    "trunc": {1: "tf_trunc"},
    "ln": "tf_ln",
    "log": {1: "tf_log10", 2: "tf_logb"},
    "log10": "tf_log10",
    "log2": "tf_log2",
    "gcd": "tf_gcd",
    "lcm": "tf_lcm",
    "date_part": "tf_date_part",
    "from_unixtime": {1: "tf_from_unixtime"},
    "to_timestamp_seconds": "tf_to_timestamp_seconds",
    "to_timestamp_millis": "tf_to_timestamp_millis",
    "to_timestamp_micros": "tf_to_timestamp_micros",
    "starts_with": "startswith",
    "random": "rand",
    "covar": "covar_samp",
    "var": "var_samp",
    "stddev": "stddev_samp",
    "approx_distinct": "approx_count_distinct",
    "approx_percentile_cont": "percentile_approx",
    "exact_count": "count",
    "arrow_typeof": "typeof",
    "character_length": "length",
    "st_asbinary": "st_asbinary_wkt",
    "st_geomfromwkb": "st_geomfromwkb_wkt",
}


def register(spark: SparkSession) -> None:
    """Create the temporary SQL functions in a session (again: replaced)."""
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
