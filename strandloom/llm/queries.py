"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from strandloom.llm import p1_neighbours, p2_sample, p3_split, p4_splits, p5_clusters, p6_leaks, p7_mixture, p8_reading

QUERIES = {
    "p1_found": p1_neighbours.p1_found,
    "p2_found": p2_sample.p2_found,
    "p2_report": p2_sample.p2_report,
    "p2_sample": p2_sample.p2_sample,
    "p3_found": p3_split.p3_found,
    "p3_pieces": p3_split.p3_pieces,
    "p4_found": p4_splits.p4_found,
    "p4_split": p4_splits.p4_split,
    "p5_found": p5_clusters.p5_found,
    "p5_clusters": p5_clusters.p5_clusters,
    "p6_found": p6_leaks.p6_found,
    "p6_leaks": p6_leaks.p6_leaks,
    "p7_found": p7_mixture.p7_found,
    "p7_shares": p7_mixture.p7_shares,
    "p7_mixture": p7_mixture.p7_mixture,
    "p8_found": p8_reading.p8_found,
    "p8_report": p8_reading.p8_report,
}

_ACC = r"regexp_replace(regexp_replace(lower(accession), '[\s_]+', '', 'g'), '\.\d+$', '')"
_PLACES = "('', 'na', 'unknown', '-', 'unclassifiedbacterium', 'uncultured organism', 'unculturedorganism', 'unclassified bacterium', 'metagenome')"
_SQUEEZED = r"regexp_replace(lower({}), '\s+', '', 'g')"


def _report(field: str, share: str, members: str, form: str) -> str:
    """One field's targets that fall short; ``members`` has unit and name."""
    names = form.format("n")
    return f"""SELECT '{field}' AS field_name, t.category FROM taxon_targets t LEFT JOIN (
    SELECT category, count(DISTINCT unit) AS have FROM (SELECT category, {names} AS name FROM (SELECT category, unnest([category, former_name]) AS n FROM taxon_targets WHERE field_name = '{field}') WHERE n IS NOT NULL) JOIN {members} USING (name) GROUP BY category) h ON h.category = t.category
  WHERE field_name = '{field}' AND coalesce(have, 0) < greatest(min_rows::DOUBLE, target_share * ({share}::DOUBLE * (SELECT count(DISTINCT unit) FROM {members})))"""


_RANKED = "regexp_replace(" + _SQUEEZED + ", '^[a-z]__', '')"
_GENUS = "regexp_replace(" + _SQUEEZED + r", 'sp\.$', '')"
_ORGANISM = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(CASE WHEN len(string_split(lineage, '|')) = 1 THEN lineage ELSE string_split(lineage, '|')[-2] END), '[_\s]+', ' ', 'g'), '(^| )(strain|str\.?)( |$)', ' ', 'g'), ' +', ' ', 'g'))"""

SQL: dict[str, str] = {
    "p2_found": f"""WITH genome_members AS (SELECT {_ACC} AS unit, {_RANKED.format('e')} AS name FROM (SELECT accession, unnest(coalesce(string_split(lineage, '|'), [''])) AS e FROM genomes) WHERE accession IS NOT NULL AND {_ACC} NOT IN {_PLACES}),
  hit_members AS (SELECT record_id AS unit, {_GENUS.format('taxon')} AS name FROM read_hits WHERE record_id IS NOT NULL)
{_report('lineage', '0.2', 'genome_members', _RANKED)} UNION ALL {_report('taxon', '0.1', 'hit_members', _GENUS)}""",
    "p3_found": r"""WITH s AS (SELECT record_id, regexp_replace(seq, '\s+', '', 'g') AS q FROM fasta_records WHERE record_id IS NOT NULL AND seq IS NOT NULL),
  r AS (SELECT record_id, len(q) AS n, list_transform(string_split_regex(q, '[^ACGTacgt]{20,}'), lambda x: len(x)) AS bases, list_transform(regexp_extract_all(q, '[^ACGTacgt]{20,}'), lambda x: len(x)) AS runs FROM s WHERE len(q) > 4000),
  c AS (SELECT record_id, n, i, bases, list_sum(bases[:i]) + list_sum(runs[:i]) AS stop FROM (SELECT *, unnest(range(1, len(runs) + 1)) AS i FROM r))
SELECT record_id, (stop + 1)::BIGINT AS cut_pos FROM c WHERE stop < n AND NOT (i = 1 AND bases[1] = 0)""",
    # plain greedy cutting, one piece of every item per round
    "p3_pieces": r"""WITH RECURSIVE s AS (SELECT record_id, regexp_replace(seq, '\s+', '', 'g') AS q FROM fasta_records WHERE record_id IS NOT NULL AND seq IS NOT NULL),
  r AS (SELECT record_id, len(q) AS n, list_transform(string_split_regex(q, '[^ACGTacgt]{20,}'), lambda x: len(x)) AS bases, list_transform(regexp_extract_all(q, '[^ACGTacgt]{20,}'), lambda x: len(x)) AS runs FROM s WHERE len(q) > 4000),
  c AS (SELECT record_id, n, i, bases, list_sum(bases[:i]) + list_sum(runs[:i]) AS stop FROM (SELECT *, unnest(range(1, len(runs) + 1)) AS i FROM r)),
  items AS (SELECT 'record' AS kind, record_id AS id, n::BIGINT AS n FROM r UNION ALL SELECT 'genome', genome_key, seqlength FROM genomes WHERE seqlength > 4000 AND genome_key IS NOT NULL),
  ends AS (SELECT 'record' AS kind, record_id AS id, list(stop::BIGINT) AS ends FROM c WHERE stop < n AND NOT (i = 1 AND bases[1] = 0) GROUP BY record_id),
  base AS (SELECT items.*, list_concat(coalesce(ends, []), [n]) AS ends FROM items LEFT JOIN ends USING (kind, id)),
  p AS (SELECT kind, id, n, ends, 0 AS piece, 0::BIGINT AS begun, 0::BIGINT AS stop FROM base
    UNION ALL SELECT kind, id, n, ends, piece + 1, stop, coalesce(list_max(list_filter(ends, lambda e: e > stop AND e <= stop + CASE WHEN stop = 0 THEN 4000 ELSE 3900 END)), stop + CASE WHEN stop = 0 THEN 4000 ELSE 3900 END) FROM p WHERE stop < n)
SELECT kind, id, piece::INTEGER AS piece, greatest(begun - 99, 1)::BIGINT AS start, stop, list_contains(ends, stop) AS natural FROM p WHERE piece > 0""",
    "p4_found": f"""WITH RECURSIVE keys AS (
    SELECT genome_key, 'a' || k AS k FROM (SELECT genome_key, {_ACC} AS k FROM genomes) WHERE k NOT IN {_PLACES}
    UNION SELECT genome_key, 'o' || k FROM (SELECT genome_key, {_ORGANISM} AS k FROM genomes) WHERE k NOT IN {_PLACES}),
  reach(a, b) AS (SELECT genome_key, genome_key FROM keys UNION SELECT r.a, y.genome_key FROM reach r JOIN keys x ON r.b = x.genome_key JOIN keys y ON x.k = y.k)
SELECT a AS genome_key, min(b) AS group_key FROM reach GROUP BY a HAVING count(*) > 1""",
    "p5_found": """WITH RECURSIVE v AS (SELECT value_id AS id, list_transform(range(1, 137), lambda i: CASE trim(level_values[i]) WHEN '001' THEN 1 WHEN '-1' THEN 1 WHEN '011' THEN 2 WHEN '1' THEN 2 WHEN '111' THEN 3 WHEN '2' THEN 3 ELSE 0 END) AS l FROM wdb_values WHERE value_id IS NOT NULL AND len(level_values) > 0),
  near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND abs(list_sum(a.l) - list_sum(b.l)) <= 24 WHERE list_sum(list_transform(list_zip(a.l, b.l), lambda z: abs(z[1] - z[2]))) <= 24),
  reach(a, b) AS (SELECT DISTINCT a, a FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)
SELECT a AS value_id, min(b) AS cluster_id FROM reach GROUP BY a""",
    # counted in words: any common tokenizer gives the same sources
    "p7_found": r"""WITH d AS (SELECT replace(lower(trim(source)), ' ', '_') AS k, sum(len(regexp_extract_all(coalesce(text, ''), '\w+|[^\w\s]'))) AS size FROM documents WHERE source IS NOT NULL GROUP BY 1),
  t AS (SELECT source, target_share, max_repeats, coalesce(size, 0) AS size FROM mix_targets LEFT JOIN d ON d.k = replace(lower(trim(source)), ' ', '_'))
SELECT source FROM t WHERE max_repeats * size < target_share * (SELECT sum(size) FROM t)""",
}
