"""Pieces of SQL that several oracles share."""

from __future__ import annotations


def acc(col: str = "accession") -> str:
    """Common form of an accession."""
    return rf"regexp_replace(regexp_replace(lower({col}), '[\s_]+', '', 'g'), '\.\d+$', '')"


def word(k: str, x: str, y: str) -> str:
    """Word at coordinates."""
    first = f"array_to_string(list_transform(range(0, ({k} + 1) // 2), lambda i: substr('TCAG', ((({x} - 1) >> (2 * i)::INT) & 3) + 1, 1)), '')"
    second = f"array_to_string(list_transform(range(0, ({k} + 1) // 2), lambda i: substr('AGTC', ((({y} - 1) >> (2 * ((({k} + 1) // 2) - 1 - i))::INT) & 3) + 1, 1)), '')"
    return f"left({first} || {second}, {k})"


def coord(word_: str, axis: str) -> str:
    """x or y of a word."""
    v = f"(CASE WHEN len({word_}) % 2 = 1 THEN {word_} || left({word_}, 1) ELSE {word_} END)"
    if axis == "x":
        return f"(1 + list_sum(list_transform(range(0, len({v}) // 2), lambda i: (strpos('TCAG', substr({v}, i + 1, 1)) - 1) * (1 << (2 * i)::INT))))::INTEGER"
    return f"(1 + list_sum(list_transform(range(0, len({v}) // 2), lambda i: (strpos('AGTC', substr({v}, len({v}) // 2 + i + 1, 1)) - 1) * (1 << (2 * (len({v}) // 2 - 1 - i))::INT))))::INTEGER"


def rc(s: str) -> str:
    """Reverse complement."""
    return f"translate(regexp_replace(reverse(upper({s})), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')"


def scale(level: str, values: tuple) -> str:
    """A scale over level 0..3."""
    q = [f"'{v}'" if isinstance(v, str) else f"{v}" + ("::DOUBLE" if isinstance(v, float) else "") for v in values]
    return f"(CASE {level} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(q)) + " END)"


WORDS = f"""words AS (
  SELECT acc, k, x, y, coalesce(upper(kmer), {word('k', 'x', 'y')}) AS kmer, cnt, len(replace(level_code, '0', ''))::INTEGER AS level
  FROM (SELECT {acc()} AS acc, k, x, y, kmer, cnt, level_code,
          row_number() OVER (PARTITION BY {acc()}, k, x, y ORDER BY counted_at DESC NULLS LAST, word_id DESC) AS n
        FROM wdb_words WHERE accession IS NOT NULL AND k IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL)
  WHERE n = 1)"""

SEQS = r"""seqs AS (
  SELECT record_id, accession, upper(regexp_replace(seq, '\s+', '', 'g')) AS seq FROM fasta_records WHERE seq IS NOT NULL AND record_id IS NOT NULL)"""


def counts(k: int, last: bool = True) -> str:
    """Word counts per record of ``SEQS``."""
    stop = f"len(seq) - {k} + {2 if last else 1}"
    return f"""counts{k} AS (
  SELECT record_id AS id, kmer, count(*) AS cnt, any_value(n) AS length
  FROM (SELECT record_id, substr(seq, i, {k}) AS kmer, len(seq) AS n FROM (SELECT record_id, seq, unnest(range(1, {stop})) AS i FROM seqs WHERE len(seq) >= {k}))
  WHERE regexp_full_match(kmer, '[ACGT]{{{k}}}') GROUP BY 1, 2)"""


def level(k: int, count: str, length: str, bounds: tuple) -> str:
    """Level of a count."""
    f = f"(1e6::DOUBLE * {count} / {length})"
    a, b, c = (f"{x}::DOUBLE" for x in bounds)
    return f"(CASE WHEN {f} <= {a} THEN 0 WHEN {f} <= {b} THEN 1 WHEN {f} <= {c} THEN 2 ELSE 3 END)"


_LETTER = "substr('ACGT', ((c >> {s}) & 3) + 1, 1)"
DOMAIN = f"""domain AS (
  SELECT kmer, x, y, (row_number() OVER (ORDER BY x, y) - 1)::INTEGER AS pos, kmer || '|4|' || x || '|' || y AS marker
  FROM (SELECT kmer, {coord('kmer', 'x')} AS x, {coord('kmer', 'y')} AS y
        FROM (SELECT {' || '.join(_LETTER.format(s=s) for s in (6, 4, 2, 0))} AS kmer FROM (SELECT unnest(range(0, 256))::INTEGER AS c)))
  WHERE x <= y)"""

FEATURES = r"""features AS (
  SELECT name, CASE WHEN t NOT IN ('', 'none', 'na', 'nan', '-', 'unknown') THEN t END AS taxon, marker, pos, level,
         CASE level WHEN 0 THEN -2 WHEN 1 THEN -1 WHEN 2 THEN 1 ELSE 2 END AS value
  FROM (SELECT value_id AS name, regexp_replace(regexp_replace(lower(taxon), '\s+', '', 'g'), 'sp\.$', '') AS t, marker, pos,
          CASE trim(level_values[pos + 1]) WHEN '001' THEN 1 WHEN '-1' THEN 1 WHEN '011' THEN 2 WHEN '1' THEN 2 WHEN '111' THEN 3 WHEN '2' THEN 3 ELSE 0 END AS level
        FROM wdb_values, domain WHERE len(level_values) > 0))"""
