"""Queries over the genome registry, lineages and classification results."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import text
from strandloom.functions.names import accession_form
from strandloom.operators import classify, taxonomy
from strandloom.operators.vectors import taxon_form
from strandloom.plans import sql
from strandloom.session import cut_lineage, table
from strandloom.streaming.classify import hit_rates

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = oracle
        return f

    return add


def leaves(spark, d):
    """Genomes with the elements of their lineage, the accession at its end left out."""
    g = table(spark, d, "genomes").where("genome_key is not null and lineage is not null")
    parts = taxonomy.lineage_parts(F.lower(F.regexp_replace("lineage", r"[_\s]+", " ")))
    taxa = F.filter(parts, lambda e: ~e.rlike(r"^[a-z]{3} ?[0-9]{8}(\.[0-9]+)?$"))
    return g.select("genome_key", accession_form(F.col("accession")).alias("acc"), taxa.alias("parts"))


_LEAVES = rf"""leaves AS (SELECT genome_key, {sql.acc()} AS acc, list_filter(list_filter(list_transform(string_split(lower(regexp_replace(lineage, '[_\s]+', ' ', 'g')), '|'), lambda e: trim(e)), lambda e: e <> ''), lambda e: NOT regexp_full_match(e, '[a-z]{{3}} ?[0-9]{{8}}(\.[0-9]+)?')) AS parts
  FROM genomes WHERE genome_key IS NOT NULL AND lineage IS NOT NULL),
  nodes AS (SELECT path, any_value(parent) AS parent, any_value(title) AS title, any_value(depth)::INTEGER AS depth, count(*) AS leaves, bool_or(ends) AS is_end
  FROM (SELECT array_to_string(parts[:i], '>') AS path, CASE WHEN i > 1 THEN array_to_string(parts[:i - 1], '>') END AS parent, parts[i] AS title, i AS depth, i = len(parts) AS ends FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM leaves)) GROUP BY path)"""


@query(f"WITH {_LEAVES} SELECT * FROM nodes")
def lineage_nodes(spark, d):
    """Every prefix of a lineage as a tree node."""
    return taxonomy.tree_nodes(leaves(spark, d))


@query(f"WITH {_LEAVES} SELECT parent AS path, count(*) AS children, sum(leaves)::BIGINT AS leaves FROM nodes WHERE parent IS NOT NULL GROUP BY parent")
def lineage_children(spark, d):
    """Children and leaves below each inner node."""
    return taxonomy.children_counts(taxonomy.tree_nodes(leaves(spark, d)))


@query(f"WITH {_LEAVES} SELECT path, title, depth, leaves FROM nodes WHERE path NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL)")
def end_nodes(spark, d):
    """Nodes without children."""
    nodes = cut_lineage(taxonomy.tree_nodes(leaves(spark, d)))
    return taxonomy.leaf_nodes(nodes).select("path", "title", "depth", "leaves")


@query(
    f"""WITH {_LEAVES}, s AS (SELECT acc, array_to_string(parts[:i], '>') AS path, i AS depth FROM (SELECT acc, parts, unnest(range(0, len(parts) + 1)) AS i FROM leaves WHERE len(parts) > 0)),
  t AS (SELECT path, depth, count(*) AS all_ FROM s GROUP BY ALL), o AS (SELECT acc, path, depth, count(*) AS members FROM s WHERE acc IS NOT NULL GROUP BY ALL),
  w AS (SELECT *, max(members) OVER (PARTITION BY acc) AS n FROM o), g AS (SELECT acc, max(depth) AS lca_depth, any_value(n) AS members, arg_max(path, depth) AS path FROM w WHERE members = n GROUP BY acc)
SELECT acc, lca_depth::INTEGER AS lca_depth, members, all_ = members AS monophyletic FROM g JOIN t ON t.path = g.path AND t.depth = g.lca_depth"""
)
def accession_ancestors(spark, d):
    """Deepest common node of all deliveries of an accession."""
    return taxonomy.group_ancestor(leaves(spark, d), "acc")


_TAXON = r"CASE WHEN regexp_replace(regexp_replace(lower(taxon), '\s+', '', 'g'), 'sp\.$', '') NOT IN ('', 'none', 'na', 'nan', '-', 'unknown') THEN regexp_replace(regexp_replace(lower(taxon), '\s+', '', 'g'), 'sp\.$', '') END"
_HITS = f"hits AS (SELECT DISTINCT record_id, {_TAXON} AS taxon, round(identity_score, 6) AS identity, tree_path AS path, species_level FROM read_hits WHERE record_id IS NOT NULL)"


def hits(spark, d):
    """Distinct hits with the taxon in common form."""
    h = table(spark, d, "read_hits").where("record_id is not null")
    return h.select("record_id", taxon_form(F.col("taxon")).alias("taxon"), F.round("identity_score", 6).alias("identity"), F.col("tree_path").alias("path"), "species_level").distinct()


@query(
    f"""WITH {_HITS}, r AS (SELECT *, coalesce(species_level, false) AS f, row_number() OVER (PARTITION BY record_id ORDER BY coalesce(species_level, false) DESC,
  CASE WHEN coalesce(species_level, false) THEN 0 ELSE -len(regexp_split_to_array(path, '[.>]')) END, identity DESC NULLS LAST, taxon NULLS LAST, path NULLS LAST) AS place FROM hits)
SELECT record_id, taxon, identity, path, species_level, place::INTEGER AS place FROM r WHERE f OR place = 1"""
)
def best_hits(spark, d):
    """Final hits of each read by identity, or its deepest other hit (K5)."""
    return classify.best_hits(hits(spark, d), "record_id", "identity", "path", "species_level", "taxon")


@query(f"WITH {_HITS} SELECT taxon, count(*) AS hits, count(DISTINCT record_id) AS reads, round(avg(identity), 6) AS mean_identity, count(*) FILTER (species_level) AS final FROM hits GROUP BY taxon")
def hits_per_taxon(spark, d):
    """Hits, reads and mean identity per taxon."""
    return hits(spark, d).groupBy("taxon").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("record_id").alias("reads"), F.round(F.avg("identity"), 6).alias("mean_identity"), F.count_if("species_level").alias("final"))


@query(
    f"""WITH {_HITS}, s AS (SELECT record_id, taxon, max(identity) AS i FROM hits WHERE taxon IS NOT NULL AND identity > 0 GROUP BY ALL), p AS (SELECT record_id, taxon, i / sum(i) OVER (PARTITION BY record_id) AS p, count(*) OVER (PARTITION BY record_id) AS n FROM s),
  o AS (SELECT *, CASE WHEN p >= 1 THEN 10 ELSE p / (1 - p) END AS o FROM p)
SELECT record_id, taxon, round(p, 6) AS p, round(CASE WHEN o = max(o) OVER w THEN 1 ELSE max(o) OVER w - o END, 6) AS odds_gap, round(CASE WHEN n < 2 OR max(p) OVER w >= 1 THEN 0 ELSE sum(-p * log2(p)) OVER w / log2(n) END, 6) AS entropy FROM o WINDOW w AS (PARTITION BY record_id)"""
)
def hit_entropy(spark, d):
    """Shares of a read's taxa, their odds below the best and the entropy (M7)."""
    from pyspark.sql import Window as W

    s = hits(spark, d).where("taxon is not null and identity > 0").groupBy("record_id", "taxon").agg(F.max("identity").alias("i"))
    p = s.withColumn("p", F.col("i") / F.sum("i").over(W.partitionBy("record_id")))
    r = classify.probability_report(p, "record_id", "p")
    return r.select("record_id", "taxon", *[F.round(c, 6).alias(c) for c in ("p", "odds_gap", "entropy")])


@query(f"SELECT date_trunc('day', loaded_at) AS day, {_TAXON} AS taxon, count(*) AS hits FROM read_hits WHERE loaded_at IS NOT NULL GROUP BY ALL")
def daily_hits(spark, d):
    """Hits per day of loading and taxon: the windowed count that the stream runs with a watermark."""
    h = table(spark, d, "read_hits").where("loaded_at is not null").select("loaded_at", taxon_form(F.col("taxon")).alias("taxon"))
    return hit_rates(h, "loaded_at", "taxon")


@query(
    f"""WITH h AS (SELECT record_id, arg_max({_TAXON}, (identity_score, hit_id)) AS taxon FROM read_hits WHERE identity_score IS NOT NULL AND {_TAXON} IS NOT NULL GROUP BY record_id),
  t AS (SELECT record_id, {_TAXON.replace('taxon', "split_part(description, ' ', 1)")} AS truth FROM fasta_records)
SELECT truth, taxon AS called, count(*) AS n FROM t JOIN h USING (record_id) GROUP BY ALL"""
)
def confusion(spark, d):
    """Taxa called against the taxa that the reads' headers name."""
    h = table(spark, d, "read_hits").select("record_id", "hit_id", "identity_score", taxon_form(F.col("taxon")).alias("taxon")).where("identity_score is not null and taxon is not null")
    called = h.groupBy("record_id").agg(F.max_by("taxon", F.struct("identity_score", "hit_id")).alias("called"))
    truth = table(spark, d, "fasta_records").select("record_id", taxon_form(F.split("description", " ")[0]).alias("truth"))
    return truth.join(called, "record_id").groupBy("truth", "called").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LEAVES}, e AS (SELECT path, depth FROM nodes WHERE is_end) SELECT n.path, count(*) AS ends, max(e.depth - n.depth)::DOUBLE AS longest, min(e.depth - n.depth)::DOUBLE AS shortest, round(avg(e.depth - n.depth), 6) AS average, sum(e.depth - n.depth)::DOUBLE AS total FROM nodes n JOIN e ON starts_with(e.path, n.path || '>') GROUP BY n.path")
def branch_metrics(spark, d):
    """Steps from each inner lineage node to the end nodes below it."""
    nodes = cut_lineage(taxonomy.tree_nodes(leaves(spark, d)))
    return taxonomy.branch_metrics(nodes).withColumn("average", F.round("average", 6))


@query(f"WITH {_LEAVES}, q AS (SELECT unnest([1, 2, 3])::INTEGER AS sector, unnest(quantile_cont(depth, [0.25, 0.5, 0.75])) AS edge FROM nodes) SELECT sector, path, leaves FROM nodes, q WHERE depth >= edge AND depth - 1 < edge")
def depth_cuts(spark, d):
    """Maximal subtrees below the quartile depths of the lineage tree."""
    return taxonomy.depth_cuts(cut_lineage(taxonomy.tree_nodes(leaves(spark, d))))


_P = "string_split(trim(regexp_replace(CASE WHEN len(string_split(lineage, '|')) = 1 THEN lineage ELSE string_split(lineage, '|')[-2] END, '[_ ]+', ' ', 'g')), ' ')"
_N = f"(left(coalesce({_P}[1], ''), 1) || '.' || coalesce({_P}[2], '') || ' ' || coalesce({_P}[3], '') || ' [' || coalesce(accession, '') || ']')"


@query(f"SELECT genome_key, CASE WHEN len({_N}) > 25 THEN left({_N}, 22) || '...' ELSE {_N} END AS label, translate(coalesce(lineage, ''), ' :/?#=$*[]@|<>\"', '_______________') AS file_name FROM genomes WHERE lineage IS NOT NULL")
def genome_labels(spark, d):
    """Short labels and safe file names of genomes."""
    g = table(spark, d, "genomes").where("lineage is not null")
    parts = F.split("lineage", r"\|")
    organism = F.when(F.size(parts) == 1, parts[0]).otherwise(F.try_element_at(parts, F.lit(-2)))
    p = F.split(F.trim(F.regexp_replace(organism, "[_ ]+", " ")), " ")
    at = lambda i: F.get(p, F.lit(i))
    return g.select("genome_key", text.short_genome(at(0), at(1), at(2), F.col("accession")).alias("label"), text.file_name(F.col("lineage")).alias("file_name"))
