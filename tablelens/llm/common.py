"""What several operators over the corpus share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_source(column: Column) -> Column:
    """Spellings of one source belong together: case, blanks, dashes, dots."""
    return F.regexp_replace(F.regexp_replace(F.lower(column), r"^\s+|\s+$", ""), r"[\s\-_.]+", "_")
