"""Text primitives as Columns: white space, line breaks, normal forms, tiers of matching, percent-encoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space and line breaks that the results follow, as classes for Java and RE2 alike.
SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAKS = r"\r\n|[\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Escapes that the soft form undoes, in this order.
ESCAPES = [("\\\\", "\\"), ('\\"', '"'), ("\\'", "'"), ("\\@", "@"), ("\\.", "."), ("\\/", "/")]
# What is no printable ASCII goes through these classes; the rest, nearly all of a text, fails at one comparison.
_RUN, _BREAK = rf"(?![!-~]){SPACES}", rf"(?![ -~])(?:{BREAKS})"


def split_lines(x: Column) -> Column:
    """Lines of x without their breaks; no empty last line; none of an empty text."""
    parts = F.split(x, _BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{_RUN}++|(?![!-~])(?<!{SPACES}){SPACES}++$", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?![!-~])(?<!{SPACES}){SPACES}++$", "")


def normalize(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, rf"{_RUN}+", " "))


def soft(x: Column) -> Column:
    """White space collapsed and the escapes undone, one after the other."""
    return normalize(reduce(lambda y, e: F.replace(y, F.lit(e[0]), F.lit(e[1])), ESCAPES, strip(x)))


def compact(x: Column) -> Column:
    """The soft form without any white space."""
    return F.regexp_replace(soft(x), rf"{_RUN}+", "")


def variants(x: Column) -> Column:
    """Each non-blank line of x, stripped, the whole of it, and the soft forms of these."""
    parts = F.transform(F.split(x, _BREAK, -1), strip)
    every = F.array_distinct(F.concat(parts, F.array(strip(x))))
    both = F.get(F.transform(F.array(every), lambda e: F.concat(e, F.transform(e, soft))), F.lit(0))  # makes every once
    return F.array_distinct(F.filter(both, lambda p: p != ""))


def forms(x: Column) -> Column:
    """What `matches` looks for: (norm, compact) of each variant. The soft tier is left out: where it holds, the compact tier does."""
    return F.transform(variants(x), lambda v: F.struct(normalize(v).alias("norm"), compact(v).alias("compact")))


def matches(found: Column, norm: Column, packed: Column) -> Column:
    """Whether one of the forms is in a text, given the text's own two forms."""
    return F.exists(found, lambda f: ((f["norm"] != "") & norm.contains(f["norm"])) | ((f["compact"] != "") & packed.contains(f["compact"])))


def text_or(x: Column, other: Column | str) -> Column:
    """x, or other where x is null or empty."""
    return F.coalesce(F.when(x != "", x), other if isinstance(other, Column) else F.lit(other))


def rendered(x: Column) -> Column:
    """x as templates render it: a null as None."""
    return F.coalesce(x, F.lit("None"))


def percent_encode(x: Column) -> Column:
    """RFC 3986: all but letters, digits and -._~ is encoded."""
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def without_last_slashes(x: Column) -> Column:
    return F.rtrim(x, F.lit("/"))


def list_text(xs: Column) -> Column:
    """[1, 2]"""
    return F.concat(F.lit("["), F.array_join(F.transform(xs, lambda x: x.cast("string")), ", "), F.lit("]"))
