"""Scalar building blocks as Column functions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def contains_literal(c: Column, needle: str) -> Column:
    """Substring search without wildcards; A-Z match a-z, other letters only themselves."""
    return F.contains(ascii_lower(c), F.lit(needle.translate(str.maketrans(UPPER, LOWER))))


def strip(c: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_sha256(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def is_question_number(c: Column) -> Column:
    """1 to 999 in ASCII digits without leading zeros."""
    return c.rlike("^[1-9][0-9]{0,2}$")


def item_code(prefix: str, sha: Column, number: Column) -> Column:
    """Prefix, the first 16 digits of a digest, and the number in three digits or more."""
    return F.when(number.isNotNull(), F.concat(F.lit(prefix), F.substring(sha, 1, 16), F.lit("-"), F.format_string("%03d", number.cast("long"))))


def fresh(stamp: Column, now: str, minutes: int) -> Column:
    """Whether a text time with a zone lies within *minutes* before *now*; a time without zone, or none, is not fresh."""
    zoned = stamp.rlike(r"(Z|[+-]\d{2}:\d{2})$")
    return F.coalesce(zoned & (F.try_to_timestamp(stamp) > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")), F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def reason_list(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order, as an array."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def pixel_box(box: Column, width: int, height: int) -> Column:
    """A normalised box [l, t, r, b] as pixels: left and top rounded down, right and bottom up, inside the page."""
    at = lambda i: F.get(box, i)
    return F.struct(
        F.greatest(F.floor(at(0) * width), F.lit(0)).alias("l"), F.greatest(F.floor(at(1) * height), F.lit(0)).alias("t"),
        F.least(F.ceil(at(2) * width), F.lit(width)).alias("r"), F.least(F.ceil(at(3) * height), F.lit(height)).alias("b"),
    )


def page_range(text: Column, pages: Column) -> Column:
    """``a`` or ``a-b`` with 1 <= a <= b <= pages as a struct (start, stop); null if it is none."""
    plain = strip(text)
    start = F.regexp_extract(plain, r"^([0-9]{1,9})(?:\s*-\s*([0-9]{1,9}))?$", 1).try_cast("int")
    stop = F.coalesce(F.regexp_extract(plain, r"^[0-9]{1,9}\s*-\s*([0-9]{1,9})$", 1).try_cast("int"), start)
    return F.when((start >= 1) & (start <= stop) & (stop <= pages), F.struct(start.alias("start"), stop.alias("stop")))


def collapsed(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def first_keyword(c: Column, rules: list[tuple[list[str], str]], otherwise: Column | None = None) -> Column:
    """The result of the first rule of which one keyword (lower case) occurs in the collapsed text."""
    low = F.lower(collapsed(c))
    out = F.lit(None).cast("string") if otherwise is None else otherwise
    for words, result in reversed(rules):
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
        out = F.when(hit, F.lit(result)).otherwise(out)
    return out


def shortened(c: Column, most: int) -> Column:
    """At most *most* code points; a longer text ends in an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def half_even(c: Column) -> Column:
    """Rounded to a whole number, halves to the even one."""
    return F.rint(c).cast("long")


def labelled(label: Column, stem: Column) -> Column:
    """Label and stem with a space between; an empty one is left out."""
    return strip(F.concat_ws(" ", F.nullif(label, F.lit("")), F.nullif(stem, F.lit(""))))


def display_name(code: Column, names: dict[str, str]) -> Column:
    """The name of a code of a small fixed dictionary; an unknown code stands for itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code), code)


def safe_path(c: Column, suffix: str = ".png") -> Column:
    """A relative path without parent steps, backslashes or control characters, with the suffix."""
    return F.coalesce(~c.rlike(r"(^/)|(^|/)\.\.(/|$)|\\|[\x00-\x1F\x7F]") & c.endswith(suffix) & (F.length(c) > len(suffix)), F.lit(False))


def zoned_time(stamp: Column, now: str, ahead_minutes: int = 5) -> Column:
    """Whether a text is a time with a zone, at most *ahead_minutes* after *now*."""
    limit = F.lit(now).cast("timestamp") + F.expr(f"INTERVAL {ahead_minutes} MINUTES")
    return F.coalesce(stamp.rlike(r"(Z|[+-]\d{2}:\d{2})$") & (F.try_to_timestamp(stamp) <= limit), F.lit(False))
