"""Runs a registered query beside its SQL in DuckDB and compares rows, names and types."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings genomes fasta_records wdb_values wdb_words read_hits reference_genomes reading_labels eval_items taxon_targets mix_targets".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with the tables of a folder as views."""
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(names, data) -> list[tuple]:
    """Rows with columns in the order of their names, sorted."""
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in at) for r in data), key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, (int, float)) or x is None else (True, "n", x) for x in r))


def compare(df, c: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both agree, else what differs."""
    got = c.execute(sql)
    names = [x[0] for x in got.description]
    kinds = {x[0]: str(x[1]).upper() for x in got.description}
    want = rows(names, got.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    known = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    off = {n: (t, kinds[n]) for n, t in df.dtypes if known.get(t, t) != kinds[n]}
    mine = rows(df.columns, df.collect())
    if mine != want:
        diff = next(((a, b) for a, b in zip(mine, want, strict=False) if a != b), None)
        return f"{len(mine)} rows against {len(want)}, first difference {diff}"
    return f"types {off}" if off else ""
