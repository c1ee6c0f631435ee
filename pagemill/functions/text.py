"""String expressions shared by the extractors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters stripped at the ends (Unicode white space), and the class of the collapse rule
# (without the vertical tab).
SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
ASCII_SPACE = r"\t\n\f\r "


def trim_text(value: Column) -> Column:
    """Strip Unicode white space at both ends (plain `trim` strips U+0020 only)."""
    return F.btrim(value, F.lit(SPACES))


def clean_text(value: Column) -> Column:
    """Runs of two or more white space characters become one space; the ends are trimmed."""
    return trim_text(F.regexp_replace(value, f"[{ASCII_SPACE}]{{2,}}", " "))


def content_hash(value: Column) -> Column:
    """SHA-256 of the UTF-8 bytes as 64 lower-case hex digits."""
    return F.sha2(value, 256)
