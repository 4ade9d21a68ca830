"""Comparison form of accessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def accession_form(accession: Column) -> Column:
    """Lower case, without blanks, underscores and version."""
    return F.regexp_replace(F.regexp_replace(F.lower(accession), r"[\s_]+", ""), r"\.\d+$", "")
