"""Small text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when outputs are stripped.
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def strip(text: Column) -> Column:
    """Without the white space at both ends (F.trim removes spaces only)."""
    return F.regexp_replace(text, f"\\A{SPACE}++|(?<!{SPACE}){SPACE}++\\z", "")
