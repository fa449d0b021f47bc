"""String helpers as Column expressions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes (str.isspace), as a regex class.
PY_SPACE = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


# The same set as a string of characters, derived from str.isspace.
PY_WS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: trim every str.isspace character from both ends
    (plain ``trim`` only removes spaces; a set trim is linear, unlike a
    trailing-whitespace regex)."""
    return F.trim(c, F.lit(PY_WS))


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def cut(c: Column, n: int, suffix: str = "...") -> Column:
    """Keep the first n chars, appending ``suffix`` when something was cut."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit(suffix)))


def tail(c: Column, n: int) -> Column:
    """The last n characters (all when shorter)."""
    return F.when(F.length(c) > n, F.substring(c, -n, n)).otherwise(c)


def py_list_repr(arr: Column) -> Column:
    """Python ``repr(list_of_str)`` for simple strings: ['a', 'b']."""
    return F.when(F.size(arr) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("['"), F.array_join(arr, "', '"), F.lit("']")))
