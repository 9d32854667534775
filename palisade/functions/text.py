"""Text clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# At least one character above the space, tab and control range.
HAS_INK = r"[^\x00-\x20]"


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
