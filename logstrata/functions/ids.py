"""Identifiers compared without letter case and surrounding blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"^[\s\u00a0]+|[\s\u00a0]+$"


def ident(c: Column | str) -> Column:
    """Lower case, no surrounding blanks; empty becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.regexp_replace(c, _BLANKS, "")), F.lit(""))
