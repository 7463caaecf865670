"""Text normalisation, classification and splitting as column functions.

Word characters are ``[\\p{L}\\p{N}_]`` (Java's ``\\w`` is ASCII only); combining marks are not
among them. Blanks are Unicode's. An empty text and null count alike where a function says "blank".
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
ROMAN = r"^[IVXivx]+$"
#: Numbers, A1, 1A, "Fig 3", "3 kg" and roman numerals.
REFERENCE = rf"^\p{{Nd}}+$|^[A-Za-z]+\s*\d+$|^\d+\s*[A-Za-z]+$|{ROMAN}"


def blank(c: Column) -> Column:
    """Null or empty."""
    return F.coalesce(c, F.lit("")) == ""


def strip(c: Column) -> Column:
    """Without white space of any kind at either end (``trim`` takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def normalize_for_comparison(c: Column) -> Column:
    """Lower case, runs of white space to one blank, without punctuation, stripped; '' for null."""
    return F.coalesce(strip(F.regexp_replace(collapse(F.lower(c)), rf"[^{WORD}\s]", "")), F.lit(""))


def normalize_hard(c: Column) -> Column:
    """Lower case, word characters only; '' for null."""
    return F.coalesce(F.regexp_replace(F.lower(c), rf"[^{WORD}]", ""), F.lit(""))


def normalize_for_translation(c: Column) -> Column:
    """Lower case, single blanks, without common punctuation marks, stripped."""
    return strip(F.regexp_replace(strip(collapse(F.lower(c))), r"""[.,!?;:()\[\]{}"'`~]""", ""))


def equal_ignoring_white_space(a: Column, b: Column) -> Column:
    """Equal without white space and case; blank texts are compared as they are, and null equals null."""
    squeezed = [F.regexp_replace(F.lower(x), r"(?U)\s+", "") for x in (a, b)]
    return F.when(blank(a) | blank(b), a.eqNullSafe(b)).otherwise(squeezed[0] == squeezed[1])


def equal_ignoring_blanks(a: Column, b: Column) -> Column:
    """Equal without the character blank; case counts."""
    return F.replace(a, F.lit(" ")) == F.replace(b, F.lit(" "))


def clean_translation(c: Column) -> Column:
    """Without control characters other than tab, line feed and return; stripped."""
    return strip(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def clean_model_output(c: Column) -> Column:
    """Without any control, zero-width or format character."""
    return F.regexp_replace(c, r"[\x00-\x1F\x7F\x{200B}-\x{200D}\x{FEFF}\p{Cf}]", "")


def clean_for_slides(c: Column) -> Column:
    """Without control characters other than tab and line feed."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x7F]", "")


def clean_vertical_tabs(c: Column) -> Column:
    return F.regexp_replace(c, r"_x000B_|\x0B", "")


def clean_brackets(c: Column) -> Column:
    return F.translate(c, "【】", "")


def valid_utf8(raw: Column) -> Column:
    """Bytes as text without what isn't UTF-8; a U+FFFD that is there itself stays."""
    own = F.unhex(F.lit("EFBFBD"))
    kept = F.transform(_cut(raw, own), lambda part: F.replace(F.make_valid_utf8(part), F.lit("�"), F.lit("")))
    return F.array_join(kept, "�")


def _cut(raw: Column, at: Column) -> Column:
    """Parts of bytes between marks that begin on a byte, found in their hex."""
    pairs = F.regexp_replace(F.hex(raw), "(..)", "$1 ")
    return F.transform(F.split(pairs, F.concat(F.regexp_replace(F.hex(at), "(..)", "$1 "))), lambda p: F.unhex(F.replace(p, F.lit(" "), F.lit(""))))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Digits of all scripts and their values, by Unicode's own tables.
_DIGITS = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd" and c > 0x39 and c < 0x10000)
_VALUES = "".join(str(unicodedata.decimal(d)) for d in _DIGITS)


def is_digits(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}+$")


def is_reference(c: Column) -> Column:
    """Numbers, A1, 1A, "Fig 3", "3 kg" and roman numerals."""
    return F.coalesce(strip(c).rlike(rf"(?U){REFERENCE}"), F.lit(False))


def is_citation(c: Column) -> Column:
    """Number, authors and a year, from the start."""
    return F.coalesce(c.rlike(r"(?U)^\d+\s*[A-Za-z&\s.\-]+,\s*\d{4}"), F.lit(False))


def is_page_number(c: Column) -> Column:
    """1 to 9999 in the digits of any script, or roman."""
    s = strip(c)
    number = F.translate(s, _DIGITS, _VALUES).try_cast("bigint")
    return F.coalesce(F.when(is_digits(s), number.between(1, 9999)).otherwise(s.rlike(ROMAN)), F.lit(False))


def is_short_number(c: Column) -> Column:
    """One to three digits."""
    return F.coalesce(c.rlike(r"(?U)^\d{1,3}$"), F.lit(False))


def is_translatable(c: Column, least: int = 2) -> Column:
    """Long enough and not a number, symbols only, a page, a reference, an address of the web or of mail."""
    return F.coalesce(once(strip(c), lambda s: _worth_translating(s, least)), F.lit(False))


def _worth_translating(stripped: Column, least: int = 2) -> Column:
    # a page number is a number or roman, and so is a reference of either kind
    other = rf"(?U){REFERENCE}|^[^{WORD}\s]+$|^https?://|^\S+@\S+\.\S+"
    return (F.length(stripped) >= least) & ~stripped.rlike(other)


def is_translatable_paragraph(c: Column) -> Column:
    """Not numeric, punctuation only, a single character or special characters only; digits and white space are those of all scripts."""
    other = rf"(?U)^[\p{{Nd}}\s\x1C-\x1F.,\-%]+$|^[^{WORD}\s]+$|^[\s\-_=+*#@$%^&()]+$"
    return F.coalesce(once(strip(c), lambda s: (F.length(s) > 1) & ~s.rlike(other)), F.lit(False))


def sentences(c: Column) -> Column:
    """Sentences worth translating; an empty array for null."""
    parts = F.transform(F.split(c, r"[.!?。！？]+\s*"), strip)
    return F.coalesce(F.filter(parts, lambda s: _worth_translating(s)), F.array().cast("array<string>"))


def meaningful(c: Column) -> Column:
    """Stripped, with single blanks; '' if not worth translating."""
    return once(strip(collapse(c)), lambda s: F.when(_worth_translating(s), s).otherwise(""))


def ingredient_tokens(c: Column) -> Column:
    """Parts of an ingredient list: opening brackets separate, closing ones go, blanks go, and so do notes of other names."""
    flat = F.replace(F.regexp_replace(F.regexp_replace(c, r"[(（]", ","), r"[)）]", ""), F.lit(" "))
    return F.transform(F.split(flat, "[、,，]"), lambda t: F.regexp_replace(t, "又名|以|记", ""))


def ingredient_token(c: Column, key: Column | str) -> Column:
    """The first part that contains the key; null without one."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.get(F.filter(ingredient_tokens(c), lambda t: F.contains(t, key)), F.lit(0))


def clean_food_name(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)备案入.*", "")


def dictionary_lines(c: Column) -> Column:
    """``a->b`` lines as (source, target); lines without exactly two parts are left out."""
    lines = F.transform(F.split(c, "\n"), lambda line: F.split(line, "->"))
    return F.transform(F.filter(lines, lambda p: F.size(p) == 2), lambda p: F.struct(strip(F.get(p, F.lit(0))).alias("source"), strip(F.get(p, F.lit(1))).alias("target")))


def stop_word_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda w: w != "")


def int_list(c: Column) -> Column:
    """Comma-separated whole numbers; one bad part empties the list."""
    parts = F.filter(F.transform(F.split(c, ","), strip), lambda p: p != "")
    good = F.forall(parts, lambda p: p.try_cast("int").isNotNull())
    return F.when(good, F.transform(parts, lambda p: p.try_cast("int"))).otherwise(F.array().cast("array<int>"))


def block_parts(c: Column) -> Column:
    """Parts between [block] marks, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\[block\]"), strip), lambda p: p != "")


def split_lines(texts: Column) -> Column:
    """All lines of the non-blank texts of an array, in order, numbered text1, text2 ..."""
    lines = F.flatten(F.transform(F.filter(texts, lambda t: ~blank(t)), lambda t: F.split(t, "\n")))
    return F.transform(lines, lambda line, k: F.struct(F.concat(F.lit("text"), (k + 1).cast("string")).alias("key"), line.alias("value")))


def truncated(c: Column, most: int) -> Column:
    return F.substring(c, 1, most)


def summary(c: Column, most: int = 30) -> Column:
    """The stripped text in quotes, cut to its first characters with ... when there are more; fixed labels for a missing and for a blank text."""
    s = strip(c)
    shown = F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)
    return F.when(c.isNull(), "无文本框").when(s == "", "空白").otherwise(F.concat(F.lit("'"), shown, F.lit("'")))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), r"(?<=.)/+$", "")


def stem(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension_allowed(name: Column, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(F.contains(name, F.lit(".")) & F.substring_index(F.lower(name), ".", -1).isin(*allowed), F.lit(False))


# Format, media type and leading bytes (hex) of images.
IMAGE_FORMATS = (
    ("PNG", "image/png", ("89504E470D0A1A0A",)),
    ("JPEG", "image/jpeg", ("FFD8FF",)),
    ("GIF", "image/gif", ("47494638",)),
    ("BMP", "image/bmp", ("424D",)),
    ("TIFF", "image/tiff", ("4D4D", "4949")),
)
METAFILES = ("D7CDC69A", "01000900")


def image_format(raw: Column) -> Column:
    """Format and media type of an image by its bytes; 'unknown' for both without a match or with fewer than 8 bytes."""
    head = F.when(F.octet_length(raw) >= 8, F.hex(F.substring(raw, 1, 12))).otherwise("")
    named = lambda name, kind: F.struct(F.lit(name).alias("format"), F.lit(kind).alias("media_type"))
    out = F.when(F.lit(False), named("", ""))
    for name, kind, starts in IMAGE_FORMATS:
        for start in starts:
            out = out.when(head.startswith(start), named(name, kind))
    out = out.when(head.startswith("52494646") & head.rlike("^(?:..)*?57454250"), named("WebP", "image/webp"))
    out = out.when(F.hex(F.substring(raw, 41, 4)) == "20454D46", named("EMF", "image/x-emf"))
    for start in METAFILES:
        out = out.when(head.startswith(start), named("WMF", "image/x-wmf"))
    return out.otherwise(named("unknown", "unknown"))


def tokens(c: Column, language: str = "en", tokenizer=None) -> Column:
    """Tokens by a given column function; without one (the tokenisers of the application aren't there), words at white space, or single characters for Chinese."""
    if tokenizer is not None:
        return tokenizer(c)
    if language == "zh":
        return F.filter(F.split(F.regexp_replace(c, r"(?U)\s+", ""), ""), lambda t: t != "")
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def mask_url(c: Column) -> Column:
    """A connection address with its password hidden."""
    return F.regexp_replace(c, r"://([^:/@]+):[^@]*@", "://$1:***@")
