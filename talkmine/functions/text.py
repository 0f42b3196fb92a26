"""Column expressions over text, links and dates. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmine import fixed_values as fixed


#: what separates words, in Java and in RE2
NOT_IN_WORD = r"[^\p{L}\p{N}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quote(text: str) -> str:
    """Regular expression that matches ``text`` literally, in Java and in RE2."""
    return "".join("\\" + ch if ch in r"\.[]{}()*+?^$|&" else ch for ch in text)


# Character class bodies: ASCII whitespace with separators, and the rest of Unicode's.
_ASCII_SPACE = r"\x09-\x0d\x1c-\x20"
_ANY_SPACE = _ASCII_SPACE + r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


_SPACE_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (``trim`` alone removes spaces only)."""
    return F.trim(c, F.lit(_SPACE_CHARS))


def is_blank(c: Column) -> Column:
    """True for text without any non-whitespace character."""
    return ~c.rlike(f"[^{_ANY_SPACE}]")


def marker_pattern(markers: list[str], ignore_case: bool = True) -> str:
    return ("(?i)" if ignore_case else "") + "|".join(quote(m) for m in markers)


def clean_text(c: Column, markers: list[str] = fixed.CLEAN_MARKERS) -> Column:
    """Drop bracketed noise markers, turn HTML entities into a space, trim spaces."""
    bare = F.regexp_replace(c, marker_pattern(markers), "")
    return F.trim(F.regexp_replace(bare, "|".join(fixed.HTML_ENTITIES), " "))


def is_artifact(
    c: Column, markers: list[str] = fixed.FLAG_MARKERS, ignore_case: bool = True
) -> Column:
    hit = c.rlike(marker_pattern(markers, ignore_case))
    openers = {m[0] for m in markers}
    if len(openers) == 1:
        # Most lines hold no marker; a plain search for its first character rules them out.
        hit = c.contains(openers.pop()) & hit
    return F.coalesce(hit, F.lit(False))


def space_count(c: Column) -> Column:
    """Pieces between single spaces; repeated and trailing spaces count."""
    return F.size(F.split(c, " ", -1)).cast("long")


def word_count(c: Column) -> Column:
    """Runs of non-whitespace. Pure ASCII text, the common case, takes the cheaper pattern."""

    def pieces(space: str) -> Column:
        return F.size(F.filter(F.split(c, f"[{space}]+"), lambda w: w != ""))

    ascii_only = F.octet_length(c) == F.length(c)
    count = F.when(ascii_only, pieces(_ASCII_SPACE)).otherwise(pieces(_ANY_SPACE))
    return F.coalesce(count, F.lit(0)).cast("long")


def padded(number: Column, width: int) -> Column:
    """Digits of a number with leading zeros; a longer number stays whole."""
    digits = number.cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def watch_url(video_id: Column) -> Column:
    return F.concat(F.lit(fixed.WATCH_URL), video_id)


def deep_link(video_id: Column, second: Column, suffix: str = "") -> Column:
    return F.concat(
        watch_url(video_id), F.lit("&t="), F.floor(second).cast("string"), F.lit(suffix)
    )


def safe_ts(c: Column) -> Column:
    return F.try_to_timestamp(c)


def icontains(c: Column, keyword: str, wildcards: bool = False) -> Column:
    """Case-insensitive contains. With ``wildcards``, ``%`` and ``_`` keep their LIKE meaning."""
    if wildcards:
        return F.lower(c).like(f"%{keyword.lower()}%")
    return F.lower(c).contains(keyword.lower())


def known_speaker(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit("UNKNOWN")))) != "UNKNOWN"


def present(c: Column) -> Column:
    """Not null and not blank."""
    return c.isNotNull() & (F.trim(c) != "")


def quality_tier(c: Column, preset: str = "view") -> Column:
    high, medium = fixed.COVERAGE_TIERS[preset]
    return F.when(c >= high, "HIGH").when(c >= medium, "MEDIUM").otherwise("LOW")


def iso_minutes(c: Column) -> Column:
    """``PT1H30M15S`` to minutes; anything else is 0."""
    pattern = r"^PT(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?"

    def part(group: int) -> Column:
        digits = F.regexp_extract(c, pattern, group)
        return F.coalesce(F.when(digits != "", digits).try_cast("double"), F.lit(0.0))

    return part(1) * 60 + part(2) + part(3) / 60


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL for a zero or missing denominator."""
    return num / F.nullif(den, F.lit(0))


def pct(num: Column, den: Column, digits: int = 1) -> Column:
    return F.round(num * F.lit(100.0) / F.nullif(den, F.lit(0)), digits)


def digest(columns: list[str]) -> Column:
    """SHA-256 of some columns: equal rows, and only those, share one."""
    return F.sha2(F.to_json(F.struct(*columns)), 256).alias("digest")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(c), NOT_IN_WORD), lambda t: t != "")


def unfence(c: Column) -> Column:
    """Remove Markdown code fences around a model response."""
    return strip_ws(F.regexp_replace(c, "```(?:json)?", ""))


def strict_json(body: Column, schema: T.DataType) -> Column:
    """The value of a text that is one JSON document and nothing else, otherwise NULL.

    ``from_json`` ignores what follows the first value; inside brackets it cannot.
    """
    wrapped = F.from_json(F.concat(F.lit("["), body, F.lit("]")), T.ArrayType(schema))
    return let(wrapped, lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))
