"""Log queries over events written as log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossalake.operators import logs as L
from glossalake.plans.base import read, registry

QUERIES, ORACLES, query = registry()
LEVEL = "CASE event_id % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'INFO' END"
_MESSAGE = "CASE event_id % 7 WHEN 0 THEN 'SELECT x FROM t' WHEN 1 THEN '\"GET /static/a.css HTTP/1.1\" 200 -' WHEN 2 THEN 'POST /api HTTP/1.1' WHEN 3 THEN '翻译 COMMIT' WHEN 4 THEN 'loaded favicon.ico' ELSE 'user ' || CAST(user_id AS VARCHAR) END"
_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


def lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    level = F.when(k % 4 == 0, "ERROR").when(k % 4 == 1, "WARNING").otherwise("INFO")
    message = (
        F.when(k % 7 == 0, "SELECT x FROM t").when(k % 7 == 1, '"GET /static/a.css HTTP/1.1" 200 -').when(k % 7 == 2, "POST /api HTTP/1.1")
        .when(k % 7 == 3, "翻译 COMMIT").when(k % 7 == 4, "loaded favicon.ico").otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string")))
    )
    line = F.concat_ws(" - ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("app."), F.col("event_type")), level, message)
    return read(spark, d, "events").select("event_id", F.when(k % 50 == 49, "no form at all").otherwise(line).alias("value"))


@query(f"""SELECT event_id, CASE WHEN event_id % 50 = 49 THEN '' ELSE {_STAMP} END AS timestamp_str, CASE WHEN event_id % 50 = 49 THEN 'unknown' ELSE 'app.' || event_type END AS logger,
CASE WHEN event_id % 50 = 49 THEN 'INFO' ELSE {LEVEL} END AS level, CASE WHEN event_id % 50 = 49 THEN 'no form at all' ELSE {_MESSAGE} END AS message FROM events""")
def log_parse(spark: SparkSession, d: str) -> DataFrame:
    return L.parse(lines(spark, d)).select("event_id", "timestamp_str", "logger", "level", "message")


@query(f"""SELECT event_id, logger, level FROM (SELECT event_id, 'app.' || event_type AS logger, {LEVEL} AS level, {_STAMP} AS s, ts FROM events WHERE event_id % 50 <> 49)
WHERE contains(logger, 'c') AND level = 'ERROR' AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 23:59:59.999999' ORDER BY s DESC, event_id LIMIT 50""")
def log_query(spark: SparkSession, d: str) -> DataFrame:
    at = lambda t: F.to_utc_timestamp(F.lit(t).cast("timestamp"), "Asia/Shanghai")
    found = L.parse(lines(spark, d)).where(L.selected("c", "error", at("2024-01-05 00:00:00"), at("2024-01-20 23:59:59.999999")))
    return L.latest(found, 50, "event_id").select("event_id", "logger", "level")


@query(f"""SELECT category, count(*) AS n FROM (SELECT CASE WHEN event_id % 50 = 49 THEN NULL WHEN event_id % 7 = 3 THEN 'whitelist' WHEN event_id % 7 = 0 THEN 'sql' WHEN event_id % 7 = 2 THEN 'http' WHEN event_id % 7 = 1 THEN 'static' WHEN event_id % 7 = 4 THEN 'custom' END AS category FROM events) GROUP BY category""")
def log_noise(spark: SparkSession, d: str) -> DataFrame:
    rules = L.NoiseFilter.preset("development")
    return L.parse(lines(spark, d)).groupBy(rules.category(F.col("message")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM events WHERE event_id % 50 = 49 OR event_id % 7 IN (0, 3, 5, 6)")
def log_production_kept(spark: SparkSession, d: str) -> DataFrame:
    rules = L.NoiseFilter.preset("production")
    return L.parse(lines(spark, d)).where(rules.keeps(F.col("message"))).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT logger FROM (SELECT CASE WHEN event_id % 50 = 49 THEN 'unknown' ELSE 'app.' || event_type END AS logger FROM events UNION ALL SELECT 'root')")
def log_names(spark: SparkSession, d: str) -> DataFrame:
    return L.logger_names(L.parse(lines(spark, d)), ["root"])


@query(f"SELECT event_id FROM events WHERE event_id % 50 <> 49 AND {LEVEL} = 'ERROR'")
def log_errors(spark: SparkSession, d: str) -> DataFrame:
    return L.error_sink(L.parse(lines(spark, d))).select("event_id")


@query("SELECT event_id, event_id % 7 = 5 OR event_id % 50 <> 49 AND event_id % 7 = 0 AS noise FROM events")
def log_environment_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rules by settings: of the built-in ones only SQL, and two own patterns, one with a named group."""
    rules = L.NoiseFilter.from_environment({"LOG_FILTER_HTTP": "false", "LOG_FILTER_STATIC": "False", "LOG_FILTER_CUSTOM_PATTERNS": r"user (?P<n>\d)(?P=n)*, user \w", "LOG_FILTER_WHITELIST_PATTERNS": "翻译, user .*6$"})
    m = L.parse(lines(spark, d)).withColumn("message", F.when(F.col("event_id") % 7 == 6, "user 6").otherwise(F.col("message")))
    return m.select("event_id", (~rules.keeps(F.when(F.col("event_id") % 7 == 5, "USER 表").otherwise(F.col("message")))).alias("noise"))


@query("SELECT event_id, date_trunc('second', ts) - INTERVAL 8 HOUR AS read, CAST(NULL AS TIMESTAMP) AS strict FROM events")
def log_milliseconds(spark: SparkSession, d: str) -> DataFrame:
    """A stamp with milliseconds has no time, unless it may have one."""
    line = F.concat_ws(" - ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit("app"), F.lit("INFO"), F.lit("m"))
    raw = read(spark, d, "events").select("event_id", line.alias("value"))
    loose, strict = (L.parse(raw, strict_compat=x).select("event_id", F.col("timestamp").cast("timestamp_ntz").alias("strict" if x else "read")) for x in (False, True))
    return loose.join(strict, "event_id")


@query(f"SELECT count(*) AS n FROM events WHERE event_id % 50 <> 49 AND event_id % 7 = 2")
def log_custom_patterns(spark: SparkSession, d: str) -> DataFrame:
    rules = L.NoiseFilter(False, False, False, custom=("(unbalanced", r"POST\s"))
    return L.parse(lines(spark, d)).where(~rules.keeps(F.col("message"))).agg(F.count("*").alias("n"))
