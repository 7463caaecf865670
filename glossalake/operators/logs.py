"""Log lines: parsing, filtering, noise and the latest entries."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossalake.functions.text import strip
from glossalake.functions.values import parse_datetime

# The noise patterns, searched in either case, and the patterns of the two presets below them.
SQL_PATTERNS = (
    r"SELECT\s+.*FROM\s+\w+", r"INSERT\s+INTO\s+\w+", r"UPDATE\s+\w+\s+SET", r"DELETE\s+FROM\s+\w+", r"CREATE\s+TABLE\s+\w+",
    r"DROP\s+TABLE\s+\w+", r"ALTER\s+TABLE\s+\w+", r"ROLLBACK", r"COMMIT", r"BEGIN", r"START\s+TRANSACTION",
    r"sqlalchemy\.engine", r"sqlalchemy\.pool", r"sqlalchemy\.orm", r"sqlalchemy\.dialects",
    r"WHERE\s+\w+\.\w+\s*[=<>!]", r"ORDER\s+BY\s+\w+\.\w+", r"GROUP\s+BY\s+\w+\.\w+", r"HAVING\s+\w+\.\w+",
    r"JOIN\s+\w+\s+ON", r"INNER\s+JOIN", r"LEFT\s+JOIN", r"RIGHT\s+JOIN",
    r"\{'[\w_]+':\s*[^}]+\}", r"%\([\w_]+\)s", r"LIMIT\s+\d+", r"OFFSET\s+\d+",
    r"PRAGMA\s+\w+", r"SHOW\s+\w+", r"DESCRIBE\s+\w+", r"EXPLAIN\s+",
    r"mysql://", r"postgresql://", r"sqlite://", r"Database\s+connection", r"Connection\s+pool",
    r"\w+_records\.\w+", r"\w+_table\.\w+", r"AS\s+\w+_\w+",
    r"Engine\s+\w+", r"Pool\s+\w+", r"Connection\s+\w+", r"Transaction\s+\w+",
)
HTTP_PATTERNS = (
    r"127\.0\.0\.1\s+-\s+-\s+\[.*\]", r"GET\s+/\w+\s+HTTP/1\.1", r"POST\s+/\w+\s+HTTP/1\.1",
    r"HTTP/1\.1\s+\d+\s+-", r'"[A-Z]+\s+/[\w/]*\s+HTTP/1\.1"\s+\d+',
)
STATIC_PATTERNS = (
    r"GET\s+/static/", r"GET\s+/favicon\.ico", r"GET\s+/css/", r"GET\s+/js/", r"GET\s+/images/",
    r"\.css\s+HTTP/1\.1", r"\.js\s+HTTP/1\.1", r"\.png\s+HTTP/1\.1", r"\.jpg\s+HTTP/1\.1", r"\.ico\s+HTTP/1\.1",
)
DEVELOPMENT_CUSTOM = (r"favicon\.ico", r"static/", r"css/", r"js/", r"images/", r"fonts/", r"HTTP/1\.1\s+304", r"HTTP/1\.1\s+200\s+-")
DEVELOPMENT_WHITELIST = ("ERROR", "WARNING", "翻译", "任务", "上传", "处理", "失败", "成功", "开始", "完成")
PRODUCTION_CUSTOM = (r"favicon\.ico", r"HTTP/1\.1\s+304")
PRODUCTION_WHITELIST = ("ERROR", "WARNING", "CRITICAL")

_STAMPS = (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d+", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z?")
LINE = rf"^({'|'.join(_STAMPS)}) - ([^-]+) - ([A-Z]+) - (.*)"


def parse(lines: DataFrame, column: str = "value", strict_compat: bool = True) -> DataFrame:
    """timestamp, timestamp_str, logger, level, message, raw_line and df's other columns; blank lines go.

    A line of no known form has logger ``unknown`` and level ``INFO``. With strict_compat, a stamp with
    milliseconds has no timestamp (so that time filters let it pass); without, it is read.
    """
    raw = F.col(column)
    others = [c for c in lines.columns if c != column]
    # one pass of the expression tells all parts: a line of the form becomes five pieces, the first one empty
    pieces = F.split(F.regexp_replace("raw_line", rf"{LINE}(?s:.*)$", "\x01$1\x01$2\x01$3\x01$4"), "\x01", 5)
    out = _settled(lines.where(strip(raw) != "").select(*others, raw.alias("raw_line")), "__p", pieces)
    known = (F.size("__p") == 5) & (F.get("__p", F.lit(0)) == "") & ~raw_starts_odd(F.col("raw_line"))

    def part(k: int, other: Column) -> Column:
        return F.when(known, strip(F.get("__p", F.lit(k)))).otherwise(other)

    fields = F.struct(part(1, F.lit("")).alias("timestamp_str"), part(2, F.lit("unknown")).alias("logger"), part(3, F.lit("INFO")).alias("level"), part(4, strip(F.col("raw_line"))).alias("message"))
    out = _settled(out, "__f", fields).select(*others, "__f.*", "raw_line")
    read = F.col("timestamp_str") if strict_compat else F.regexp_replace("timestamp_str", r",\d+$", "")
    return _settled(out, "timestamp", F.when(F.col("timestamp_str") != "", parse_datetime(read)))


def _settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a further column that is computed once a row: filters on it stay above, where a plain one would be copied into each of them."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def raw_starts_odd(raw: Column) -> Column:
    """A line that begins with the mark that parse() puts between pieces is of no known form."""
    return raw.startswith("\x01")


def selected(logger: str | None = None, level: str | None = None, start: Column | None = None, end: Column | None = None) -> Column:
    """Logger by substring, level by its upper-case name ('all' or nothing: any), time within bounds; lines without a time pass."""
    out = F.lit(True)
    if logger and logger != "all":
        out = out & F.contains("logger", F.lit(logger))
    if level and level != "all":
        out = out & (F.col("level") == level.upper())
    for bound, keep in ((start, lambda b: F.col("timestamp") >= b), (end, lambda b: F.col("timestamp") <= b)):
        if bound is not None:
            out = out & (F.col("timestamp").isNull() | keep(bound))
    return out


def latest(parsed: DataFrame, most: int, *ties: str) -> DataFrame:
    """The last entries by their stamp's text; equal stamps in the order of ties (file, line ...)."""
    return parsed.orderBy(F.desc("timestamp_str"), *ties).limit(most)


def logger_names(parsed: DataFrame, defaults: list[str]) -> DataFrame:
    given = parsed.sparkSession.createDataFrame([(d,) for d in defaults], "logger string")
    return parsed.select("logger").union(given).distinct().orderBy("logger")


#: Either case, Unicode's letters, digits and blanks, and only the line feed ends a line.
FLAGS = "(?iUd)"


def any_pattern(c: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns is found, in either case; one that isn't a regular expression is looked for as text.

    Plain patterns are searched as one; those with groups or back references, whose numbers and names are their own, one by one.
    """
    good = [ported for p in patterns if (ported := as_java(p)) is not None]
    own = [p for p in good if re.search(r"\\[1-9k]|\(\?", p)]
    plain = [p for p in good if p not in own]
    out = c.rlike(f"{FLAGS}(?:{'|'.join(plain)})") if plain else F.lit(False)
    for p in own:
        out = out | c.rlike(FLAGS + p)
    for p in patterns:
        if as_java(p) is None:
            out = out | F.contains(F.lower(c), F.lit(p.lower()))
    return F.coalesce(out, F.lit(False))


def as_java(pattern: str) -> str | None:
    """A pattern with named groups as Java writes them; None if it is no regular expression, or none that the JVM can run."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    ported = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern))
    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(FLAGS + ported)
    except (IllegalArgumentException, Py4JJavaError):
        return None
    return ported


@dataclass(frozen=True)
class NoiseFilter:
    """What counts as noise; a whitelisted message stays whatever else it matches."""

    sql: bool = True
    http: bool = True
    static: bool = True
    custom: tuple[str, ...] = ()
    whitelist: tuple[str, ...] = ()

    @classmethod
    def preset(cls, environment: str, **custom) -> NoiseFilter:
        if environment == "development":
            return cls(custom=DEVELOPMENT_CUSTOM, whitelist=DEVELOPMENT_WHITELIST)
        if environment == "production":
            return cls(sql=False, custom=PRODUCTION_CUSTOM, whitelist=PRODUCTION_WHITELIST)
        return cls(**custom)

    @classmethod
    def from_environment(cls, environment: Mapping[str, str]) -> NoiseFilter:
        """Settings by name, as the application reads them; a pattern list is comma-separated, without blank entries."""
        on = lambda name: environment.get(name, "true").lower() == "true"
        listed = lambda name: tuple(p for x in environment.get(name, "").split(",") if (p := x.strip()))
        return cls(on("LOG_FILTER_SQL"), on("LOG_FILTER_HTTP"), on("LOG_FILTER_STATIC"), listed("LOG_FILTER_CUSTOM_PATTERNS"), listed("LOG_FILTER_WHITELIST_PATTERNS"))

    def category(self, message: Column) -> Column:
        """whitelist, sql, http, static, custom, or null for a message that matches nothing."""
        out = F.when(any_pattern(message, self.whitelist), "whitelist")
        for use, name, patterns in ((self.sql, "sql", SQL_PATTERNS), (self.http, "http", HTTP_PATTERNS), (self.static, "static", STATIC_PATTERNS), (True, "custom", self.custom)):
            if use and patterns:
                out = out.when(any_pattern(message, patterns), name)
        return out

    def keeps(self, message: Column) -> Column:
        found = self.category(message)
        return found.isNull() | (found == "whitelist")


def error_sink(parsed: DataFrame) -> DataFrame:
    """Entries that the second, errors-only log takes."""
    return parsed.where(F.col("level").isin("ERROR", "CRITICAL", "FATAL"))
