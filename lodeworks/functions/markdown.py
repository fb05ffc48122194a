"""Markdown-safe rendering of untrusted values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows and characters shown of a result.
SHOWN_ROWS, CELL_CHARS = 100, 60


def sanitize(value: object) -> str:
    """Backslashes doubled, backticks and control characters as hex escapes, bars escaped; nothing is a question mark."""
    text = "?" if value is None else str(value)
    text = text.replace("\\", "\\\\").replace("`", "\\x60").replace("|", "\\|")
    return "".join(f"\\x{ord(c):02x}" if ord(c) < 32 or 127 <= ord(c) < 160 else c for c in text)


def sanitize_column(value: Column) -> Column:
    """The same, as a column."""
    text = F.replace(F.coalesce(value, F.lit("?")), F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("`"), F.lit("\\x60"))
    text = F.replace(text, F.lit("|"), F.lit("\\|"))
    for code in [*range(32), *range(127, 160)]:
        text = F.replace(text, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return text


def cell(value: Column) -> Column:
    """What a result table shows of a value: null as nothing, long texts cut with dots."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.length(text) > CELL_CHARS, F.concat(F.substring(text, 1, CELL_CHARS - 3), F.lit("..."))).otherwise(text)
