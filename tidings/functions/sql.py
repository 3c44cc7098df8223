"""The library's functions under names of their own in SQL, without Python in the plan: SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "half_md5(text STRING) RETURNS STRING": "substr(md5(text), 1, 16)",
    "week_start_date(day DATE) RETURNS DATE": "CAST(date_trunc('week', day) AS DATE)",
    "month_start_date(day DATE) RETURNS DATE": "CAST(trunc(day, 'month') AS DATE)",
    "next_day_of(day DATE) RETURNS DATE": "date_add(day, 1)",
    "word_starts(text STRING, word STRING) RETURNS BOOLEAN": "text RLIKE concat('(?iu)(?:^|[^\\\\p{L}\\\\p{N}_])\\\\Q', word, '\\\\E')",
    "in_period(at TIMESTAMP, start TIMESTAMP, end TIMESTAMP) RETURNS BOOLEAN": "at >= start AND at <= end - INTERVAL 1 SECOND",
    "url_host(url STRING) RETURNS STRING": "lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1))",
}
TABLE_FUNCTIONS = {
    "weeks_between(start DATE, end DATE) RETURNS TABLE (week DATE, week_end DATE)": "SELECT CAST(w AS DATE), date_add(CAST(w AS DATE), 7) FROM (SELECT explode(sequence(CAST(date_trunc('week', start) AS DATE), end, INTERVAL 7 DAYS)) AS w)",
}


def register(spark: SparkSession) -> None:
    """Make all functions known to the session; once more does no harm. They are inlined into the plans of queries that call them."""
    for head, body in (FUNCTIONS | TABLE_FUNCTIONS).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
