"""Dates, numbers, colours and defaults as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossalake.functions.text import blank, strip

ZONE = "Asia/Shanghai"
FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d")


def parse_datetime(c: Column, zone: str = ZONE) -> Column:
    """A local time (read in zone) or an ISO time with an offset, as an instant; null if neither. Fields need no padding."""
    local = F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in FORMATS), F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T[\d:.]+$"), F.try_to_timestamp(c)))
    offset = F.when(c.rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(c))
    # formats without an offset are read in the session's zone; move them to the given one
    return F.coalesce(offset, F.to_utc_timestamp(F.from_utc_timestamp(local, F.current_timezone()), F.lit(zone)))


def format_datetime(ts: Column, zone: str = ZONE, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Local time in zone; '' for null."""
    local = F.from_utc_timestamp(F.to_utc_timestamp(ts, F.current_timezone()), zone)
    return F.coalesce(F.date_format(local, form), F.lit(""))


def iso_datetime(ts: Column, zone: str = ZONE, offset: str = "+08:00") -> Column:
    return F.when(ts.isNull(), "").otherwise(F.concat(format_datetime(ts, zone, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset)))


def widened_end(ts: Column) -> Column:
    """An end at midnight means the whole day."""
    return F.when(ts == F.date_trunc("day", ts), ts + F.expr("INTERVAL '23:59:59.999999' HOUR TO SECOND")).otherwise(ts)


# The labels in the texts below.
def duration_text(seconds: Column) -> Column:
    """Hours and minutes above an hour, minutes and seconds above a minute, else seconds with two digits."""
    whole = F.floor(seconds)
    return (
        F.when(seconds > 3600, F.format_string("%d小时%d分钟", F.floor(whole / 3600), F.floor(whole % 3600 / 60)))
        .when(seconds > 60, F.format_string("%d分钟%d秒", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%.2f秒", seconds.cast("double")))
    )


def progress(current: Column, total: Column) -> Column:
    """Whole per cent, 0 without a total."""
    return F.when(total > 0, F.floor(current / total * 100)).otherwise(0).cast("int")


def share(part: Column, whole: Column, digits: int | None = None) -> Column:
    """Per cent, 0.0 of nothing; rounded half to even if digits are given."""
    out = F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)
    return out if digits is None else F.bround(out, digits)


def pages(total: Column, per_page: int) -> Column:
    return F.ceil(total / F.lit(per_page)).cast("bigint")


def clamped(page: Column, last: Column) -> Column:
    return F.greatest(F.least(page, last), F.lit(1))


def default(c: Column, value: str) -> Column:
    """value where c is null or empty."""
    return F.when(blank(c), value).otherwise(c)


def display_name(display: Column, first: Column, last: Column, username: Column) -> Column:
    full = F.when(~blank(first) & ~blank(last), F.concat_ws(" ", first, last))
    return F.coalesce(F.when(~blank(display), display), full, username)


def font_size(c: Column) -> Column:
    """The first run of digits, at least 1; 12 without one."""
    return F.greatest(F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("double"), F.lit(12.0)), F.lit(1.0))


def color_from_hex(c: Column) -> Column:
    """'#RRGGBB' as a packed number; black if it isn't one."""
    return F.when(c.rlike("^#[0-9A-Fa-f]{6}$"), F.conv(F.substring(c, 2, 6), 16, 10).cast("int")).otherwise(0)


def color_from_parts(rgb: Column) -> Column:
    """[r, g, b] as a packed number; black without three parts."""
    parts = [F.get(rgb, F.lit(k)).cast("int") for k in range(3)]
    return F.when(F.size(rgb) == 3, F.shiftleft(parts[0], 16) + F.shiftleft(parts[1], 8) + parts[2]).otherwise(0)


def color_parts(packed: Column) -> Column:
    return F.array(*(F.shiftright(packed, k).bitwiseAND(255) for k in (16, 8, 0)))


LANGUAGE_CODES = {"English": "en", "Chinese": "zh", "Dutch": "nl"}


def language_code(c: Column) -> Column:
    """Short code of a language; an unknown one as it is."""
    out = F.when(F.lit(False), c)
    for name, code in LANGUAGE_CODES.items():
        out = out.when(c == name, code)
    return out.otherwise(c)


def stored_filename(source: Column, target: Column, name: Column) -> Column:
    return F.concat_ws("_", language_code(source), language_code(target), F.regexp_replace(name, r'[\\/:"*?<>|]+', "_"))


def image_url(path: Column, prefix: str = "/images/") -> Column:
    """Address of a relative path; null for a missing, sentinel or absolute one."""
    usable = ~blank(path) & (path != "无截图路径") & ~path.startswith("/")
    return F.when(usable, F.concat(F.lit(prefix), F.replace(path, F.lit("\\"), F.lit("/"))))


def top_ingredients(c: Column, most: int = 3) -> Column:
    parts = F.transform(F.split(c, ","), strip)
    shown = F.array_join(F.slice(parts, 1, most), "、")
    return F.when(blank(c), "无成分信息").when(F.size(parts) > most, F.concat(shown, F.lit("等"))).otherwise(shown)


def table_cell(source: Column, target: Column, mode: Column | str) -> Column:
    """What a cell of a table gets: in mode "1" both texts, else the translation alone."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return F.when(mode == "1", F.concat_ws("\n", source, target)).otherwise(target)


def fragment_defaults(fragment: Column) -> Column:
    """A fragment's format and texts with what is missing filled in: size 12, color 0, flags false (a number other than 0 is true), texts ''."""
    size = font_size(fragment["font_size"].cast("string"))
    flags = {f: F.coalesce(fragment[f].cast("boolean"), F.lit(False)) for f in ("bold", "italic", "underline", "escapement")}
    texts = {f: F.coalesce(fragment[f], F.lit("")) for f in ("text", "translated_text")}
    return F.struct(size.alias("font_size"), F.coalesce(fragment["color"], F.lit(0)).alias("color"), *(c.alias(f) for f, c in (flags | texts).items()))


def idle_seconds(last_used: Column, as_of: Column) -> Column:
    """Whole seconds since the last use, never below 0; null without a use."""
    return F.greatest(F.timestamp_diff("SECOND", last_used, as_of), F.lit(0))


def is_idle(last_used: Column, as_of: Column, seconds: int = 1800) -> Column:
    """Unused for longer than half an hour."""
    return F.coalesce(idle_seconds(last_used, as_of) > seconds, F.lit(False))


def ran_long(started: Column, completed: Column, seconds: int = 1800) -> Column:
    """Whether a task with both times took longer than half an hour; parts of a second count."""
    took = (F.unix_micros(completed) - F.unix_micros(started)) / 1e6
    return F.coalesce(took > seconds, F.lit(False))


def bilingual(source: Column, target: Column, mode: Column | str) -> Column:
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return (
        F.when(mode == "paragraph_up", F.concat_ws("\n", source, target))
        .when(mode == "paragraph_down", F.concat_ws("\n", target, source))
        .when(mode == "translation_only", target)
        .otherwise(source)
    )


def annotation_note(ocr: Column, translation: Column, text: Column) -> Column:
    """Lines for what is there; a fixed label if nothing is."""
    lines = F.concat_ws(
        "\n",
        F.when(~blank(ocr), F.concat(F.lit("OCR: "), ocr)),
        F.when(~blank(translation), F.concat(F.lit("翻译: "), translation)),
        F.when(~blank(text) & ~text.eqNullSafe(ocr), F.concat(F.lit("备注: "), text)),
    )
    return F.when(lines == "", "注释").otherwise(lines)


def mapped_username(preferred: Column, email: Column, subject: Column) -> Column:
    """The first one that isn't blank; a name made of a hash if all are."""
    given = F.coalesce(*(F.when(~blank(c), c) for c in (preferred, email, subject)))
    seed = F.concat_ws("|", preferred, email, subject)
    return F.coalesce(given, F.concat(F.lit("user_"), F.substring(F.sha2(seed, 256), 1, 8)))


def failing(**checks: Column) -> tuple[Column, Column]:
    """Whether all checks hold, and the names of those that don't."""
    good = F.lit(True)
    for c in checks.values():
        good = good & F.coalesce(c, F.lit(False))
    names = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items())))
    return good, names
