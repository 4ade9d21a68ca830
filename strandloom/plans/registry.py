"""Registered queries of the core and their SQL."""

from __future__ import annotations

from strandloom.plans import markers, registry_hits, seqs, updates, words

QUERIES: dict = {**seqs.QUERIES, **words.QUERIES, **markers.QUERIES, **registry_hits.QUERIES, **updates.QUERIES}
SQL: dict[str, str] = {**seqs.SQL, **words.SQL, **markers.SQL, **registry_hits.SQL, **updates.SQL}
