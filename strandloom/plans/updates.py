"""Queries over changing word databases, word neighbourhoods, level arrays and marker tables of all word lengths."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import levels as L
from strandloom.functions import seq as S
from strandloom.functions import text
from strandloom.functions.names import accession_form
from strandloom.operators import markers as M
from strandloom.operators import taxonomy, wdb
from strandloom.operators.vectors import word_domain
from strandloom.plans import sql
from strandloom.plans.registry_hits import _LEAVES, leaves
from strandloom.plans.seqs import _deplete_sql, seqs
from strandloom.plans.words import _BORDER, _DIVERGENCY, archived, r6, words
from strandloom.session import cut_lineage, small, table
from strandloom.sources.sequences import SPACER, concatenate

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


_QUARTERS = sql.scale("level", (0, 1, 3, 4))


@query(
    f"""WITH {sql.WORDS}, q AS (SELECT k, kmer, count(*) AS n, sum({_QUARTERS})::BIGINT AS s, sum({_QUARTERS} * {_QUARTERS})::BIGINT AS q, (count(*) // 2) AS h FROM words WHERE level IS NOT NULL GROUP BY ALL)
SELECT k, kmer, n, CASE WHEN n < 2 THEN 0 ELSE (10 * (n * q - s * s))::DOUBLE / (16 * h * (n - h)) END AS divergency, (10 * s)::DOUBLE / (4 * n) AS commonality, (40 * n - 10 * s)::DOUBLE / (4 * n) AS rareness FROM q"""
)
def word_divergency_exact(spark, d):
    """Divergency, commonality and rareness of words from whole-number sums, not rounded."""
    return wdb.divergency(words(spark, d), "k", "kmer")


def _extreme(score: str) -> str:
    return f"WITH {sql.WORDS}, {_DIVERGENCY} SELECT k, kmer, round(s, 6) AS score, place::INTEGER AS place FROM (SELECT k, kmer, s, row_number() OVER (PARTITION BY k ORDER BY s DESC, kmer) AS place FROM (SELECT k, kmer, round({score}, 9) AS s FROM divergency)) WHERE place <= 50"


def _extremes(spark, d, score: str):
    s = wdb.divergency(words(spark, d), "k", "kmer").select("k", "kmer", F.round(score, 9).alias("score"))
    return wdb.extreme_words(s, "score", 50).select("k", "kmer", r6(F.col("score")).alias("score"), "place")


@query(_extreme("commonality"))
def extreme_abundant(spark, d):
    """The 50 most abundant words of each length."""
    return _extremes(spark, d, "commonality")


@query(_extreme("rareness"))
def extreme_rare(spark, d):
    """The 50 rarest words of each length."""
    return _extremes(spark, d, "rareness")


def _confrontation_sql(score: str) -> str:
    return f"""WITH {sql.WORDS}, a AS (SELECT k, kmer, left(acc, 3) AS archive, {_BORDER} AS b FROM words WHERE level IS NOT NULL),
  o AS (SELECT k, kmer, avg(b) AS o, CASE WHEN count(*) > 1 THEN var_pop(b) ELSE 0 END AS v, count(*) AS n FROM a WHERE archive = 'qvx' GROUP BY ALL),
  c AS (SELECT k, kmer, avg(g) AS c FROM (SELECT k, kmer, archive, avg(b) AS g FROM a WHERE archive <> 'qvx' GROUP BY ALL) GROUP BY ALL)
SELECT k, kmer, round({score} / 2 / sqrt(1 + v / n), 5) AS score FROM o JOIN c USING (k, kmer)"""


@query(_confrontation_sql("(10 + o - c)"))
def confrontation_richer(spark, d):
    """Words richer in one archive than in the others."""
    return wdb.confrontation(archived(spark, d), "archive", "qvx", "+++").withColumn("score", F.round("score", 5))


@query(_confrontation_sql("(10 + c - o)"))
def confrontation_poorer(spark, d):
    """Words poorer in one archive than in the others."""
    return wdb.confrontation(archived(spark, d), "archive", "qvx", "---").withColumn("score", F.round("score", 5))


_CONTROL = "control AS (SELECT acc FROM (SELECT acc, count(*) AS n FROM words GROUP BY acc) ORDER BY n DESC, acc LIMIT 1)"


def control_genome(words_):
    """``(acc)``: the genome of most entries, one row."""
    return words_.groupBy("acc").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct(-F.col("n"), F.col("acc").alias("acc")))["acc"].alias("acc")).where("acc is not null")


@query(
    f"""WITH {sql.WORDS}, {_CONTROL}, m AS (SELECT acc, k, kmer, level, {sql.scale('level', L.MEDIANS)} AS m FROM words WHERE level IS NOT NULL),
  r AS (SELECT k, kmer, level AS rl, m AS rm FROM m WHERE acc IN (SELECT acc FROM control))
SELECT acc, count(*) AS words, sum(abs(level - rl))::BIGINT AS differing, 3 * count(*) AS most, round(avg(abs(m - rm)), 6) AS median_gap FROM m JOIN r USING (k, kmer) WHERE acc NOT IN (SELECT acc FROM control) GROUP BY acc"""
)
def control_gaps(spark, d):
    """Levels of every genome against the control genome: differing bits and mean distance of rank medians."""
    w = cut_lineage(words(spark, d))
    name = control_genome(w).first()  # one row
    return wdb.median_gaps(w, name["acc"] if name else "").withColumn("median_gap", F.round("median_gap", 6))


@query(f"WITH {sql.WORDS}, t AS (SELECT DISTINCT kmer FROM words WHERE k = 7), s AS (SELECT kmer, kmer AS at, 0 AS side FROM t UNION ALL SELECT kmer, {sql.rc('kmer')} AS at, 1 AS side FROM t) SELECT s.kmer, w.acc, coalesce(sum(w.cnt) FILTER (side = 0), 0)::BIGINT AS cnt, coalesce(sum(w.cnt) FILTER (side = 1), 0)::BIGINT AS rc_cnt FROM words w JOIN s ON w.kmer = s.at GROUP BY ALL")
def word_lookup(spark, d):
    """Counts of every stored seven-letter word and of its reverse complement in each genome."""
    w = words(spark, d)
    return wdb.lookup(w, w.where("k = 7"))


@query(f"WITH {sql.WORDS}, t AS (SELECT DISTINCT k, kmer FROM words) SELECT k, kmer, lead(kmer) OVER (PARTITION BY k ORDER BY kmer) AS next FROM t")
def next_word(spark, d):
    """The word behind each stored one."""
    return wdb.next_words(words(spark, d))


@query(f"WITH {sql.WORDS}, {_CONTROL}, g AS (SELECT DISTINCT kmer FROM words WHERE acc IN (SELECT acc FROM control)) SELECT acc, count(*) FILTER (kmer IN (SELECT kmer FROM g)) AS popped, count(*) FILTER (kmer NOT IN (SELECT kmer FROM g)) AS rest FROM words GROUP BY acc")
def popped_words(spark, d):
    """Entries per genome of the words that the control genome holds, and those that stay when these are taken out."""
    w = cut_lineage(words(spark, d))
    popped, rest = wdb.pop_words(w, w.join(F.broadcast(control_genome(w)), "acc", "left_semi"))  # one row
    count = lambda df, name: df.groupBy("acc").agg(F.count(F.lit(1)).alias(name))
    return count(popped, "popped").join(count(rest, "rest"), "acc", "full").fillna(0, ["popped", "rest"])


_BY_FILE = f"""files AS (SELECT wdb_file, acc, k, x, y, coalesce(upper(kmer), {sql.word('k', 'x', 'y')}) AS kmer, cnt FROM (
  SELECT wdb_file, {sql.acc()} AS acc, k, x, y, kmer, cnt, row_number() OVER (PARTITION BY wdb_file, {sql.acc()}, k, x, y ORDER BY counted_at DESC NULLS LAST, word_id DESC) AS n
  FROM wdb_words WHERE accession IS NOT NULL AND k IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL) WHERE n = 1)"""


@query(f"WITH {_BY_FILE} SELECT acc, k, x, y, kmer, sum(cnt)::BIGINT AS cnt FROM files GROUP BY ALL")
def merged_databases(spark, d):
    """All database files as one: entries of one genome and word in several files are added (F32)."""
    raw = table(spark, d, "wdb_words")
    newest = W.partitionBy("wdb_file", "acc", "k", "x", "y").orderBy(F.col("counted_at").desc_nulls_last(), F.col("word_id").desc())
    known = raw.withColumn("acc", accession_form(F.col("accession"))).where("acc is not null and k is not null and x is not null and y is not null")
    one = known.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    entries = one.select("acc", "k", "x", "y", F.coalesce(F.upper("kmer"), S.word_at(F.col("k"), F.col("x"), F.col("y"))).alias("kmer"), F.col("cnt").cast("bigint").alias("cnt"))
    return wdb.merge_databases(entries, entries.limit(0))


@query(f"WITH {sql.WORDS}, {_CONTROL} SELECT acc, dense_rank() OVER (ORDER BY acc) AS genome_id FROM (SELECT DISTINCT acc FROM words WHERE acc NOT IN (SELECT acc FROM control))")
def registry_without_control(spark, d):
    """Genomes with their ids after the control genome is deleted: the ids behind it move up."""
    w = cut_lineage(words(spark, d))
    return wdb.delete_genomes(wdb.genome_ids(w), control_genome(w)).select("acc", "genome_id")


_GENOME_SEQS = f"genome_seqs AS (SELECT {sql.acc()} AS acc, string_agg(seq, '{SPACER}' ORDER BY record_id, seq) AS seq FROM seqs WHERE accession IS NOT NULL GROUP BY ALL)"
_DEPLETED = _deplete_sql(2000, 20).split("seqs AS (", 1)[1].split("), g AS", 1)[1].replace("SELECT record_id, string_agg", "SELECT acc, string_agg").replace("GROUP BY record_id", "GROUP BY acc").replace("record_id", "acc").replace("FROM seqs)", "FROM genome_seqs)")


@query(
    f"""WITH {sql.WORDS}, {sql.SEQS}, {_GENOME_SEQS}, depleted AS (WITH g AS{_DEPLETED}),
  counted AS (SELECT acc, kmer, count(*) AS cnt, any_value(n) AS length FROM (SELECT acc, substr(depleted, i, 4) AS kmer, len(depleted) AS n FROM (SELECT acc, depleted, unnest(range(1, len(depleted) - 2)) AS i FROM depleted WHERE len(depleted) >= 4)) WHERE regexp_full_match(kmer, '[ACGT]{{4}}') GROUP BY 1, 2),
  new AS (SELECT acc, 4::INTEGER AS k, {sql.coord('kmer', 'x')} AS x, {sql.coord('kmer', 'y')} AS y, kmer, cnt, {sql.level(4, 'cnt', 'length', L.THRESHOLDS[4])}::INTEGER AS level FROM counted)
SELECT acc, k, x, y, kmer, cnt, level FROM words WHERE NOT (k = 4 AND acc IN (SELECT acc FROM genome_seqs)) UNION ALL SELECT * FROM new WHERE x <= y"""
)
def added_genomes(spark, d):
    """The database after every accession with sequences is depleted to 2,000 bases in 20 chunks, counted, levelled and put in its place."""
    s = seqs(spark, d).where("accession is not null").withColumn("acc", accession_form(F.col("accession")))
    return wdb.upsert_genomes(words(spark, d), concatenate(s, by="acc", order="record_id"), 4, 2000, 20)


_T = f"WITH {sql.WORDS}, t AS (SELECT DISTINCT k, kmer FROM words)"


@query(f"{_T} SELECT a.kmer, hamming(a.kmer, b.kmer)::INTEGER AS distance, count(*) AS neighbours FROM t a JOIN t b ON a.k = b.k AND a.kmer <> b.kmer AND hamming(a.kmer, b.kmer) <= 2 GROUP BY ALL")
def distance_neighbours(spark, d):
    """Stored words one or two letters away from each stored word."""
    t = cut_lineage(words(spark, d).select("kmer").distinct())
    n = t.select("kmer", F.explode(S.words_at_distance(F.col("kmer"), 1, 2)).alias("other"))
    found = n.join(t.select(F.col("kmer").alias("other")), "other")
    return found.groupBy("kmer", S.mismatches(F.col("kmer"), F.col("other")).alias("distance")).agg(F.count(F.lit(1)).alias("neighbours"))


@query(
    f"""{_T}, p AS (SELECT a.kmer, 'right' AS side, b.kmer AS other FROM t a JOIN t b ON a.k = b.k AND substr(a.kmer, 2) = left(b.kmer, b.k - 1) UNION SELECT a.kmer, 'right', b.kmer FROM t a JOIN t b ON a.k = b.k AND substr(a.kmer, 3) = left(b.kmer, b.k - 2)
  UNION SELECT a.kmer, 'left', b.kmer FROM t a JOIN t b ON a.k = b.k AND left(a.kmer, a.k - 1) = substr(b.kmer, 2) UNION SELECT a.kmer, 'left', b.kmer FROM t a JOIN t b ON a.k = b.k AND left(a.kmer, a.k - 2) = substr(b.kmer, 3))
SELECT kmer, side, count(*) AS shifted FROM p WHERE kmer <> other GROUP BY ALL"""
)
def shifts_within_two(spark, d):
    """Stored words that frame shifts by one or two letters to the right or left give."""
    t = cut_lineage(words(spark, d).select("kmer").distinct())
    sides = [t.select("kmer", F.lit(name).alias("side"), F.explode(S.shifts_within(F.col("kmer"), 2, left)).alias("other")) for name, left in (("right", False), ("left", True))]
    found = sides[0].unionByName(sides[1]).where("kmer <> other").join(t.select(F.col("kmer").alias("other")), "other", "left_semi")
    return found.groupBy("kmer", "side").agg(F.count(F.lit(1)).alias("shifted"))


@query(
    f"""{_T}, l AS (SELECT DISTINCT kmer, left(kmer, i - 1) || substr(kmer, i + 1) AS w FROM (SELECT kmer, unnest(range(1, k + 1)) AS i FROM t)),
  e AS (SELECT kmer, c, kmer || c AS longer, c || kmer AS before FROM t, (SELECT unnest(['A', 'C', 'G', 'T']) AS c))
SELECT t.kmer, (SELECT count(*) FROM l WHERE l.kmer = t.kmer) AS shorter, (SELECT count(*) FROM l WHERE l.kmer = t.kmer AND l.w IN (SELECT kmer FROM t)) AS shorter_stored,
  (SELECT count(*) FROM e WHERE e.kmer = t.kmer AND e.longer IN (SELECT kmer FROM t)) AS right_stored, (SELECT count(*) FROM e WHERE e.kmer = t.kmer AND e.before IN (SELECT kmer FROM t)) AS left_stored FROM t"""
)
def word_edits(spark, d):
    """Words that the loss or gain of one letter gives, and how many of them are stored."""
    t = cut_lineage(words(spark, d).select("kmer").distinct())
    kinds = {"shorter": S.deletions(F.col("kmer")), "right": S.extensions(F.col("kmer")), "left": S.extensions(F.col("kmer"), left=True)}
    edits = None
    for kind, other in kinds.items():
        part = t.select("kmer", F.lit(kind).alias("kind"), F.explode(other).alias("other"))
        edits = part if edits is None else edits.unionByName(part)
    marked = edits.join(t.select(F.col("kmer").alias("other"), F.lit(True).alias("stored")), "other", "left")
    n = lambda kind: F.count_if((F.col("kind") == kind) & F.col("stored").isNotNull())
    return marked.groupBy("kmer").agg(F.count_if(F.col("kind") == "shorter").alias("shorter"), n("shorter").alias("shorter_stored"), n("right").alias("right_stored"), n("left").alias("left_stored"))


_MASK = "left(kmer, 1) || 'N' || substr(kmer, 3, k - 3) || 'N'"


@query(
    f"""{_T}, m AS (SELECT DISTINCT k, {_MASK} AS masked FROM t), e AS (SELECT masked, left(masked, 1) || a || substr(masked, 3, k - 3) || b AS kmer FROM m, (SELECT unnest(['A', 'C', 'G', 'T']) AS a), (SELECT unnest(['A', 'C', 'G', 'T']) AS b))
SELECT masked, kmer, {sql.coord('kmer', 'x')} AS x, {sql.coord('kmer', 'y')} AS y, kmer IN (SELECT kmer FROM t) AS stored FROM e"""
)
def masked_words(spark, d):
    """Words with N in their second and last place, the words they stand for and their coordinates."""
    t = cut_lineage(words(spark, d).select("kmer", "k").distinct())
    kmer = F.col("kmer")
    masked = F.concat(F.substr(kmer, F.lit(1), F.lit(1)), F.lit("N"), F.substr(kmer, F.lit(3), F.col("k") - 3), F.lit("N"))
    each = t.select(masked.alias("masked")).distinct().select("masked", F.explode(S.expanded(F.col("masked"))).alias("kmer"))
    marked = each.join(t.select("kmer", F.lit(True).alias("s")), "kmer", "left")
    return marked.select("masked", "kmer", S.word_x(kmer).alias("x"), S.word_y(kmer).alias("y"), F.col("s").isNotNull().alias("stored"))


@query(
    f"""WITH {sql.WORDS}, l AS (SELECT acc, k, list(level ORDER BY x, y) AS l FROM words WHERE level IS NOT NULL GROUP BY ALL)
SELECT acc, k, array_to_string(list_concat(l[1:1], [3], l[2:]), '') AS inserted, array_to_string(list_concat([0], l[2:]), '') AS replaced, array_to_string(l[2:], '') AS deleted, array_to_string(list_filter([l[1], l[3]], lambda v: v IS NOT NULL), '') AS picked, array_to_string(list_concat(l, l), '') AS merged FROM l"""
)
def edited_levels(spark, d):
    """The levels of a genome's words with one put in, replaced, taken out, picked, and doubled."""
    w = words(spark, d).where("level is not null").groupBy("acc", "k").agg(F.array_sort(F.collect_list(F.struct("x", "y", "level"))).alias("l"))  # at most 4^k words
    levels, one = F.transform("l", lambda s: s["level"]), F.lit(1)
    line = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), "")
    edits = {
        "inserted": L.inserted(levels, F.lit(2), F.lit(3)),
        "replaced": L.replaced(levels, one, F.lit(0)),
        "deleted": L.without_places(levels, F.array(one)),
        "picked": L.picked(levels, F.array(one, F.lit(3))),
        "merged": L.merged(levels, levels),
    }
    return w.select("acc", "k", *[line(e).alias(name) for name, e in edits.items()])


@query(f"WITH {sql.WORDS}, f AS (SELECT acc, k, least(y, x) AS x, greatest(x, y) AS y, cnt FROM (SELECT acc, k, y AS x, x AS y, cnt FROM words)) SELECT acc, k, x, y, sum(cnt)::BIGINT AS cnt FROM f GROUP BY ALL")
def folded_entries(spark, d):
    """Entries given from the upper triangle, folded into the lower one."""
    x, y = S.folded(F.col("y"), F.col("x"))
    return words(spark, d).select("acc", "k", x.alias("x"), y.alias("y"), "cnt").groupBy("acc", "k", "x", "y").agg(F.sum("cnt").alias("cnt"))


@query(f"WITH {sql.WORDS}, {sql.DOMAIN}, g AS (SELECT DISTINCT acc FROM words), v AS (SELECT acc, kmer, {sql.scale('level', L.VALUES)} AS value FROM words WHERE k = 4) SELECT g.acc AS name, domain.marker, coalesce(v.value, -2) AS value FROM g, domain LEFT JOIN v ON v.acc = g.acc AND v.kmer = domain.kmer")
def marker_values(spark, d):
    """Value of each possible four-letter word for each genome of the databases, -2 where it is missing."""
    w = cut_lineage(words(spark, d))
    domain = word_domain(spark, 4).select("marker", "kmer")
    levels = w.where("k = 4").join(small(domain), "kmer").select(F.col("acc").alias("name"), "marker", "level")
    return M.dense_features(w.select(F.col("acc").alias("name")).distinct(), domain, levels)


def _archive_features(spark, d):
    """Values of the stored words of every length: node is the archive, name the genome."""
    w = archived(spark, d).where("level is not null")
    marker = M.marker_title(F.col("kmer"), F.col("k"), F.col("x"), F.col("y"))
    return w.select(F.col("archive").alias("node"), F.col("acc").alias("name"), "k", marker.alias("marker"), L.on_scale(F.col("level"), L.VALUES).alias("value"))


_ARCHIVE = f"WITH {sql.WORDS}, f AS (SELECT left(acc, 3) AS node, acc AS name, k, kmer || '|' || k || '|' || x || '|' || y AS marker, {sql.scale('level', L.VALUES)} AS value FROM words WHERE level IS NOT NULL)"


@query(
    f"""{_ARCHIVE}, g AS (SELECT node, k, count(DISTINCT name) AS g FROM f GROUP BY ALL), m AS (SELECT node, k, marker, (sum(value) - 2 * (any_value(g) - count(*)))::DOUBLE / any_value(g) AS mean FROM f JOIN g USING (node, k) GROUP BY ALL),
  r AS (SELECT *, count(*) FILTER (mean BETWEEN -0.5 AND 0.5) OVER (PARTITION BY node, k) AS nd, row_number() OVER (PARTITION BY node, k ORDER BY abs(mean), marker) AS rd FROM m)
SELECT node, k, marker, round(mean, 6) AS mean FROM r WHERE CASE WHEN nd < 10 THEN rd <= 10 ELSE mean BETWEEN -0.5 AND 0.5 END"""
)
def leaf_features(spark, d):
    """Diverse words of every archive, chosen per word length and then put together; a genome without a word counts as -2."""
    chosen = M.merge_leaf(_archive_features(spark, d), least=10)
    return chosen.select("node", "k", "marker", F.round("mean", 6).alias("mean"))


@query(f"{_ARCHIVE}, t AS (SELECT count(DISTINCT node) AS t FROM f), e AS (SELECT marker, count(DISTINCT node) AS children FROM f GROUP BY marker) SELECT marker, children FROM e, t WHERE children = t")
def shared_archive_words(spark, d):
    """Words that every archive holds."""
    return M.shared_markers(_archive_features(spark, d), child="node")


@query(f"{_ARCHIVE}, n AS (SELECT DISTINCT k, name FROM f) SELECT b.k, a.name FROM (SELECT DISTINCT name FROM n) a, (SELECT DISTINCT k FROM n) b EXCEPT SELECT k, name FROM n")
def missing_titles(spark, d):
    """Genomes that one word length has and another lacks: what the check before joining matrices reports."""
    f = _archive_features(spark, d)
    return M.missing_rows(f.select("k", "name").distinct(), "k", ["name"])


@query(
    f"""WITH {_LEAVES}, d AS (SELECT path, depth, (SELECT max(depth) FROM nodes) - depth AS up FROM nodes)
SELECT path, depth, round(-0.5::DOUBLE - 0.1::DOUBLE * up, 6) AS diverse_low, round(0.5::DOUBLE + 0.1::DOUBLE * up, 6) AS diverse_high, round(-1 - 0.1::DOUBLE * up, 6) AS common_low, round(1 + 0.1::DOUBLE * up, 6) AS common_high, row_number() OVER (ORDER BY depth DESC, path) AS place FROM d"""
)
def summary_order(spark, d):
    """Lineage nodes from the bottom up, with thresholds that widen by a tenth per level."""
    order = taxonomy.bottom_up(cut_lineage(taxonomy.tree_nodes(leaves(spark, d))))
    return order.select("path", "depth", *[r6(F.col(c)).alias(c) for c in ("diverse_low", "diverse_high", "common_low", "common_high")], "place")


@query(
    f"""WITH {_LEAVES}, o AS (SELECT acc, min_by(parts, genome_key) AS first FROM leaves WHERE acc IS NOT NULL AND len(parts) > 0 GROUP BY acc),
  p AS (SELECT genome_key, acc, parts, first, list_max(list_filter(range(0, least(len(parts), len(first)) + 1), lambda i: parts[:i] = first[:i])) AS c FROM leaves JOIN o USING (acc) WHERE len(parts) > 0)
SELECT genome_key, acc, c AS shared_depth, len(parts) + len(first) - 2 * c AS distance, round((len(parts) + len(first) - 2 * c)::DOUBLE / (len(parts) + len(first)), 6) AS relative FROM p"""
)
def delivery_distance(spark, d):
    """Steps in the lineage tree between each delivery of a genome and its first one."""
    rows = leaves(spark, d).where("acc is not null and size(parts) > 0")
    first = rows.groupBy("acc").agg(F.min_by("parts", "genome_key").alias("first"))
    out = taxonomy.path_distance(rows.join(first, "acc"), "parts", "first")
    return out.select("genome_key", "acc", F.col("shared_depth").cast("bigint").alias("shared_depth"), F.col("distance").cast("bigint").alias("distance"), r6(F.col("relative")).alias("relative"))


@query(
    f"""WITH {_LEAVES}, s AS (SELECT acc, array_to_string(parts[:i], '>') AS path, i AS depth FROM (SELECT acc, parts, unnest(range(0, len(parts) + 1)) AS i FROM leaves WHERE len(parts) > 0)),
  t AS (SELECT path, depth, count(*) AS all_ FROM s GROUP BY ALL), o AS (SELECT acc, path, depth, count(*) AS members FROM s WHERE acc IS NOT NULL GROUP BY ALL),
  w AS (SELECT *, max(members) OVER (PARTITION BY acc) AS n FROM o), g AS (SELECT acc, max(depth) AS depth, any_value(n) AS members, arg_max(path, depth) AS path FROM w WHERE members = n GROUP BY acc)
SELECT acc, members, all_ - members AS others, round((all_ - members)::DOUBLE / all_, 6) AS admixture FROM g JOIN t ON t.path = g.path AND t.depth = g.depth"""
)
def admixture(spark, d):
    """Share of other genomes below the deepest common node of an accession."""
    return taxonomy.admixture(leaves(spark, d), "acc").withColumn("admixture", r6(F.col("admixture")))


@query(
    f"""WITH {_LEAVES}, s AS (SELECT DISTINCT left(acc, 3) AS g, array_to_string(parts[:i], '>') AS path FROM (SELECT acc, parts, unnest(range(1, len(parts) + 1)) AS i FROM leaves WHERE acc IS NOT NULL AND len(acc) >= 3))
SELECT a.g AS a, b.g AS b, count(*) AS nodes FROM s a JOIN s b ON a.path = b.path AND a.g < b.g GROUP BY ALL"""
)
def lineage_overlap(spark, d):
    """Lineage nodes that two archives share."""
    rows = leaves(spark, d).where("length(acc) >= 3").withColumn("archive", F.substr("acc", F.lit(1), F.lit(3)))
    return taxonomy.overlap(rows, "archive")


@query(
    """SELECT hit_id, CASE WHEN s BETWEEN 0 AND 1 THEN s END AS identity, CASE WHEN p BETWEEN 1 AND 1000000 THEN p END AS record, CASE lower(trim(species_level::VARCHAR)) WHEN 'true' THEN true WHEN 'false' THEN false END AS final
FROM (SELECT hit_id, species_level, try_cast(identity_score::VARCHAR AS DOUBLE) AS s, try_cast(record_id::VARCHAR AS BIGINT) AS p FROM read_hits)"""
)
def checked_fields(spark, d):
    """Fields of hits read from text within their bounds."""
    h = table(spark, d, "read_hits")
    as_text = lambda c: F.col(c).cast("string")
    return h.select("hit_id", text.ranged(as_text("identity_score"), 0, 1).alias("identity"), text.ranged(as_text("record_id"), 1, 1_000_000, "bigint").alias("record"), text.truth(as_text("species_level")).alias("final"))
