"""Names of functions that Spark has under another one, as session SQL functions.

They are plain SQL expressions, so Catalyst inlines them: no Python, no new cost.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Signature, result type and body of each function (fixed values).
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "strpos": ("a STRING, b STRING", "INT", "instr(a, b)"),
    "sha256": ("a STRING", "STRING", "sha2(a, 256)"),
    "sha512": ("a STRING", "STRING", "sha2(a, 512)"),
    "to_hex": ("a BIGINT", "STRING", "lower(hex(a))"),
    "date_bin_minutes": ("n INT, t TIMESTAMP_NTZ", "TIMESTAMP_NTZ", "timestampadd(MINUTE, CAST(floor(timestampdiff(MINUTE, TIMESTAMP_NTZ'1970-01-01 00:00:00', t) / n) * n AS INT), TIMESTAMP_NTZ'1970-01-01 00:00:00')"),
    "date_bin": (
        "stride INTERVAL DAY TO SECOND, t TIMESTAMP_NTZ, origin TIMESTAMP_NTZ DEFAULT TIMESTAMP_NTZ'1970-01-01 00:00:00'",
        "TIMESTAMP_NTZ",
        "timestampadd(MICROSECOND, CAST(floor(timestampdiff(MICROSECOND, origin, t) / timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', TIMESTAMP_NTZ'1970-01-01 00:00:00' + stride)) AS BIGINT) * timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', TIMESTAMP_NTZ'1970-01-01 00:00:00' + stride), origin)",
    ),
    "generate_series": ("a BIGINT, b BIGINT, step BIGINT DEFAULT 1", "ARRAY<BIGINT>", "CASE WHEN (step > 0 AND a > b) OR (step < 0 AND a < b) THEN CAST(array() AS ARRAY<BIGINT>) ELSE sequence(a, b, step) END"),
    "string_to_array": ("a STRING, b STRING", "ARRAY<STRING>", r"CASE WHEN b = '' THEN array(a) ELSE split(a, concat('\\Q', replace(b, '\\E', '\\E\\\\E\\Q'), '\\E')) END"),
    "array_length": ("a ARRAY<STRING>", "INT", "size(a)"),
    "trunc_number": ("a DOUBLE", "DOUBLE", "CASE WHEN a < 0 THEN ceil(a) ELSE floor(a) END"),
}
#: Aggregates that Spark has under another name, replaced in the text of a query
#: (fixed values).
RENAMED = {
    "approx_distinct": "approx_count_distinct",
    "approx_percentile_cont": "approx_percentile",
    "approx_median": "median",
    "array_to_string": "array_join",
    "list_contains": "array_contains",
    "unnest": "explode",
}


def install(spark: SparkSession) -> None:
    """Adds the functions to the session, once."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        if not spark.catalog.functionExists(name):
            spark.sql(f"CREATE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
