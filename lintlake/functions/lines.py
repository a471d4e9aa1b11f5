"""Source text as lines, with Python's rules for line ends and white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line ends of str.splitlines() and the white space of str.strip().
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def decoded(content: Column) -> Column:
    """Bytes as text; null where they aren't valid UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def split_lines(text: Column) -> Column:
    """Array of lines: a line end at the very end opens no further line; null gives an empty array."""
    parts = F.split(text, LINE_ENDS, -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(whole)


def strip(line: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(line, F.lit(WHITE))


def line_at(lines: Column, number: Column) -> Column:
    """The line of that number from 1; empty where there is none."""
    return F.coalesce(F.when(number >= 1, F.get(lines, (number - 1).cast("int"))), F.lit(""))
