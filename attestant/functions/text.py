"""Text as the operators see it: Unicode white space, ASCII case, byte lengths, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in both regular expression dialects that the queries are checked in.
WS = r"[\s\p{Z}]"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(c: Column, use) -> Column:
    """``use`` of a column that is worked out once, however often it is named: keeps expressions small where they are put together."""
    return F.element_at(F.transform(F.array(c), use), 1)


def trimmed(c: Column) -> Column:
    """Without white space at both ends, whatever kind; Spark's trim takes off blanks only."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def left_trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+", "")


def ascii_upper(c: Column) -> Column:
    """Capitals for a-z only: other letters stay."""
    return F.translate(c, _LOWER, _UPPER)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def squeezed(c: Column) -> Column:
    """Trimmed, runs of white space as one blank."""
    return F.regexp_replace(trimmed(c), rf"{WS}+", " ")


def word_count(c: Column) -> Column:
    return F.when(trimmed(c) == "", 0).otherwise(F.size(F.split(trimmed(c), rf"{WS}+")))


def lines_of(c: Column) -> Column:
    """Lines of a text: no empty one after a last line end, no carriage returns."""
    parts = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(c.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(F.when(c == "", F.array().cast("array<string>")).otherwise(parts))


def number_of(c: Column, kind: str = "int") -> Column:
    """An unsigned number, null for anything else or too large a one."""
    return F.when(c.rlike(r"^\+?[0-9]+$"), c).try_cast(kind)


def canonical_label(c: Column) -> Column:
    """a label with single blanks in capitals."""
    return ascii_upper(squeezed(c))


def label_id(c: Column) -> Column:
    """label_ and the bytes of the label in capitals as hexadecimal digits."""
    return F.concat(F.lit("label_"), F.lower(F.hex(F.encode(ascii_upper(trimmed(c)), "UTF-8"))))


def shortened(c: Column, n: int) -> Column:
    """at most n characters, with three points where some are left out."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def upper_median(c: Column) -> Column:
    """Upper median of a group, without interpolation: an aggregate."""
    sorted_ = F.array_sort(F.collect_list(c))
    return F.try_element_at(sorted_, (F.size(sorted_) / 2).cast("int") + 1)
