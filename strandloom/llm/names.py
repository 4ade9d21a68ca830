"""Comparison forms of accessions, organisms, categories and sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders that stand for "no name".
PLACEHOLDERS = ("", "na", "unknown", "-", "unclassified bacterium", "uncultured organism", "metagenome")


def squeezed(name: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(name), r"\s+", "")


def _real(key: Column, placeholders: tuple[str, ...]) -> Column:
    return F.when(~key.isin(*placeholders), key)


def accession_key(accession: Column) -> Column:
    """Without case, blanks, underscores and version; null for placeholders."""
    key = F.regexp_replace(F.regexp_replace(F.lower(accession), r"[\s_]+", ""), r"\.\d+$", "")
    return _real(key, tuple(p.replace(" ", "") for p in PLACEHOLDERS))


def organism_key(lineage: Column) -> Column:
    """Last but one element of a lineage, or its only one, in comparison form; null for placeholders."""
    parts = F.split(lineage, r"\|")
    name = F.when(F.size(parts) == 1, parts[0]).otherwise(F.try_element_at(parts, F.lit(-2)))
    name = F.regexp_replace(F.lower(name), r"[_\s]+", " ")
    name = F.regexp_replace(name, r"(^| )(strain|str\.?)(?= |$)", " ")
    return _real(F.trim(F.regexp_replace(name, " +", " ")), PLACEHOLDERS)


def rank_name_key(name: Column) -> Column:
    """A taxon name without case, blanks and rank prefix (one letter and two underscores)."""
    return F.regexp_replace(squeezed(name), r"^[a-z]__", "")


def genus_key(name: Column) -> Column:
    """A taxon name without case, blanks and a final ``sp.``."""
    return F.regexp_replace(squeezed(name), r"sp\.$", "")


def source_key(name: Column) -> Column:
    """A source name without case and outer blanks, a blank read as an underscore."""
    return F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))
