"""Queries over level vectors: features, marker choice, distances, trees and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import levels as L
from strandloom.operators import classify, distances, kmers, models
from strandloom.operators import markers as M
from strandloom.operators.vectors import vector_features, word_domain_size
from strandloom.plans import sql
from strandloom.session import cut_lineage, each_of, small, table
from strandloom.sources.wdb import wide_matrix

QUERIES: dict = {}
SQL: dict[str, str] = {}
LEAST_GENOMES = 5  # a taxon with fewer vectors has no label of its own


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = oracle
        return f

    return add


def features(spark, d):
    """The feature table of wdb_values."""
    return vector_features(table(spark, d, "wdb_values"))


_BASE = f"WITH {sql.DOMAIN}, {sql.FEATURES}"


@query(f"{_BASE} SELECT taxon, marker, sum(level)::BIGINT AS levels, count(*) AS genomes FROM features WHERE taxon IS NOT NULL GROUP BY ALL")
def kmer_matrix_long(spark, d):
    """The matrix of taxa and words in long form."""
    return features(spark, d).where("taxon is not null").groupBy("taxon", "marker").agg(F.sum("level").alias("levels"), F.count(F.lit(1)).alias("genomes"))


@query(f"{_BASE} SELECT name, " + ", ".join(f"max(value) FILTER (pos = {p}) AS m{p}" for p in range(16)) + " FROM features GROUP BY name")
def value_matrix(spark, d):
    """The first 16 words as columns, one row per vector."""
    f = features(spark, d).where("pos < 16").select("name", F.concat(F.lit("m"), F.col("pos").cast("string")).alias("marker"), "value")
    return wide_matrix(f, ["name"], [f"m{p}" for p in range(16)])


@query(f"{_BASE} SELECT name, " + ", ".join(f"max(value) FILTER (pos = {p}) AS m{p}" for p in range(word_domain_size(4))) + " FROM features GROUP BY name")
def whole_value_matrix(spark, d):
    """All words as columns, one row per vector."""
    f = features(spark, d).select("name", F.concat(F.lit("m"), F.col("pos").cast("string")).alias("marker"), "value")
    return wide_matrix(f, ["name"], [f"m{p}" for p in range(word_domain_size(4))])


@query(f"{_BASE}, m AS (SELECT marker, avg(value) AS mean FROM features GROUP BY marker), r AS (SELECT *, count(*) FILTER (mean BETWEEN -0.5 AND 0.5) OVER () AS nd, count(*) FILTER (mean <= -1 OR mean >= 1) OVER () AS nc, row_number() OVER (ORDER BY abs(mean), marker) AS rd, row_number() OVER (ORDER BY abs(mean) DESC, marker) AS rc FROM m) SELECT marker, round(mean, 6) AS mean, CASE WHEN nd < 10 THEN rd <= 10 ELSE mean BETWEEN -0.5 AND 0.5 END AS is_diverse, CASE WHEN nc < 10 THEN rc <= 10 ELSE mean <= -1 OR mean >= 1 END AS is_common FROM r")
def marker_choice(spark, d):
    """Diverse and common markers by mean value, at least 10 of each (A3)."""
    s = M.select_by_mean(M.marker_means(features(spark, d)), least=10)
    return s.select("marker", F.round("mean", 6).alias("mean"), "is_diverse", "is_common")


@query(f"{_BASE}, m AS (SELECT marker, avg(value) AS mean, var_samp(value) AS v FROM features GROUP BY marker) SELECT marker, round(CASE WHEN mean <= -1 OR mean >= 1 THEN -v ELSE v END, 6) AS score FROM m")
def variance_scores(spark, d):
    """Variance of each marker's values, negated for common markers: the score of the redundancy filter."""
    return M.variance_scores(features(spark, d)).select("marker", F.round("score", 6).alias("score"))


@query(r"""WITH e AS (SELECT trim(taxon) AS label, pos, coalesce(try_cast(trim(v) AS INTEGER), 0) AS value FROM (SELECT taxon, unnest(level_values) AS v, unnest(range(1, len(level_values) + 1)) AS pos FROM wdb_values))
SELECT label, pos::INTEGER AS pos, count(*) AS n, sum(value)::BIGINT AS total, count(*) FILTER (value = 0) AS zeros FROM e WHERE label <> '' AND lower(label) NOT IN ('nan', 'none', 'null') GROUP BY ALL""")
def cleaned_features(spark, d):
    """Per label and position, the cells of the raw vectors after the cleaning of classifier input."""
    cells = table(spark, d, "wdb_values").select("taxon", F.posexplode("level_values").alias("pos", "value")).withColumn("pos", F.col("pos") + 1)
    clean = M.clean_features(cells, "taxon", "value")
    return clean.groupBy(F.col("taxon").alias("label"), "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.count_if(F.col("value") == 0).alias("zeros"))


_CHI = """, o AS (SELECT marker, taxon, value, count(*)::DOUBLE AS o FROM features WHERE taxon IS NOT NULL GROUP BY ALL),
  c AS (SELECT *, sum(o) OVER (PARTITION BY marker, taxon) AS r, sum(o) OVER (PARTITION BY marker, value) AS c FROM o),
  chi AS (SELECT marker, sum(o)::BIGINT AS n, sum(o) * (sum(o * o / (r * c)) - 1) AS chi2, (count(DISTINCT taxon) - 1) * (count(DISTINCT value) - 1) AS dof FROM c GROUP BY marker)"""


@query(f"{_BASE}{_CHI} SELECT marker, round(chi2, 4) AS chi2, dof, n FROM chi")
def chi2_markers(spark, d):
    """Chi-square of taxon and value per marker (A4)."""
    return M.chi_square(features(spark, d)).select("marker", F.round("chi2", 4).alias("chi2"), "dof", "n")


@query()
def ranked_markers(spark, d):
    """Markers with p-value, FDR and rank, filtered and topped up (A4, A5, K1, K2)."""
    tests = M.with_fdr(M.with_p_values(M.chi_square(features(spark, d))))
    chosen = M.select_ranked(M.rank_markers(tests))
    return chosen.select("marker", "chi2", "dof", "p", "fdr", "significant", "rank")


@query(f"{_BASE} SELECT marker, taxon, round(avg(value), 6) AS mean FROM features WHERE taxon IS NOT NULL GROUP BY ALL")
def group_means(spark, d):
    """Mean value per marker and taxon."""
    g = M.group_means(features(spark, d))
    return g.select("marker", "taxon", F.round("mean", 6).alias("mean"))


@query(f"{_BASE}, s AS (SELECT taxon, count(DISTINCT name) AS n FROM features WHERE taxon IS NOT NULL GROUP BY taxon) SELECT floor(quantile_cont(n, 0.5))::INTEGER AS median_size, count(*) AS labels FROM s")
def median_cluster(spark, d):
    """Median number of vectors per taxon."""
    return M.median_cluster(features(spark, d).select("name", "taxon").distinct())


def _present(spark, d):
    """Markers that occur in a taxon: mean level above 1."""
    means = features(spark, d).where("taxon is not null").groupBy("taxon", "marker").agg(F.sum("level").alias("s"), F.count(F.lit(1)).alias("n"))
    return means.where("s > n").select("taxon", "marker")


_PRESENT = f"{_BASE}, present AS (SELECT taxon, marker FROM features WHERE taxon IS NOT NULL GROUP BY ALL HAVING sum(level) > count(*)), each AS (SELECT marker, count(DISTINCT taxon) AS children FROM present GROUP BY marker), total AS (SELECT count(DISTINCT taxon) AS t FROM present)"


@query(f"{_PRESENT} SELECT marker, children FROM each, total WHERE children = t")
def shared_markers(spark, d):
    """Markers that every taxon has."""
    return M.shared_markers(_present(spark, d))


@query(f"{_PRESENT} SELECT marker, children FROM each, total WHERE children < t ORDER BY children DESC, marker LIMIT 40")
def padding_markers(spark, d):
    """The 40 most frequent markers that some taxon lacks (K3)."""
    return M.padding_markers(_present(spark, d), 40)


@query(f"{_BASE} SELECT right(taxon, 6) AS node, taxon, count(DISTINCT name) AS names, count(DISTINCT marker) AS markers, sum(value)::BIGINT AS values FROM features WHERE taxon IS NOT NULL GROUP BY ALL")
def node_summary(spark, d):
    """Features of the inner nodes one level above the taxa, by the last letters of their names."""
    rows = features(spark, d).where("taxon is not null").select(F.col("taxon").alias("node"), "name", "taxon", "marker", "value")
    ends = rows.select("node").distinct().select("node", F.right("node", F.lit(6)).alias("parent"), F.col("node").alias("title"))
    s = M.summarize_children(rows, ends)
    return s.groupBy("node", "taxon").agg(F.countDistinct("name").alias("names"), F.countDistinct("marker").alias("markers"), F.sum("value").alias("values"))


def taxon_levels(spark, d):
    """Profile of every taxon: the rounded mean level of each marker."""
    means = features(spark, d).where("taxon is not null").groupBy("taxon", "marker").agg(F.sum("level").alias("s"), F.count(F.lit(1)).alias("n"))
    return means.select(F.col("taxon").alias("name"), "marker", F.floor((2 * F.col("s") + F.col("n")) / (2 * F.col("n"))).cast("int").alias("level"))


_PROFILE = f"{_BASE}, profile AS (SELECT taxon AS name, marker, ((2 * sum(level) + count(*)) // (2 * count(*)))::INTEGER AS level FROM features WHERE taxon IS NOT NULL GROUP BY ALL)"


@query(f"{_PROFILE} SELECT a.name AS a, b.name AS b, round(sum(abs(a.level - b.level)) / (3::DOUBLE * count(*)), 6) AS d FROM profile a JOIN profile b ON a.marker = b.marker AND a.name < b.name GROUP BY ALL")
def taxon_distance(spark, d):
    """Distances between taxon profiles."""
    return distances.level_distances(cut_lineage(taxon_levels(spark, d))).select("a", "b", F.round("d", 6).alias("d"))


@query(f"{_PROFILE}, n AS (SELECT f.name, p.name AS taxon, sum(abs(f.level - p.level)) AS d FROM features f JOIN profile p ON f.marker = p.marker GROUP BY ALL) SELECT name, arg_min(taxon, (d, taxon)) AS nearest, min(d)::BIGINT AS steps FROM n GROUP BY name")
def nearest_profile(spark, d):
    """The taxon profile nearest to each vector."""
    as_array = lambda df: df.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("marker", "level"))).alias("l"))  # noqa: E731  # 136 markers each
    p = as_array(taxon_levels(spark, d)).select(F.col("name").alias("taxon"), F.col("l.level").alias("at"))
    v = as_array(features(spark, d).select("name", "marker", "level")).select("name", F.col("l.level").alias("level"))
    pairs = each_of(v, cut_lineage(p).select(F.struct("taxon", "at").alias("p")), "p", 5_000).select("name", "level", "p.taxon", "p.at")  # taxa, their number is checked
    steps = F.aggregate(F.zip_with("level", "at", lambda a, b: F.abs(a - b)), F.lit(0), lambda x, y: x + y).cast("bigint")
    near = pairs.select("name", "taxon", steps.alias("steps"))
    return near.groupBy("name").agg(F.min_by("taxon", F.struct("steps", "taxon")).alias("nearest"), F.min("steps").alias("steps"))


@query(f"{_BASE}, s AS (SELECT taxon, count(DISTINCT name) AS n FROM features WHERE taxon IS NOT NULL GROUP BY taxon), c AS (SELECT count(*) AS c, count(*) FILTER (level = 0) AS z FROM features WHERE taxon IS NOT NULL) SELECT sum(n)::BIGINT AS genomes, count(*) AS classes, round(max(n) / min(n)::DOUBLE, 6) AS balance, (SELECT count(*) FILTER (value = 0)::DOUBLE / count(*) FROM features WHERE taxon IS NOT NULL) AS sparsity, (SELECT count(*) FILTER (value IS NULL)::DOUBLE / count(*) FROM features WHERE taxon IS NOT NULL) AS missing FROM s")
def class_statistics(spark, d):
    """Class balance, sparsity and missing cells of the feature table."""
    s = models.class_statistics(features(spark, d).where("taxon is not null"))
    return s.withColumn("balance", F.round("balance", 6))


def _model(spark, d, least=LEAST_GENOMES):
    """Mean value per marker and taxon, for taxa of at least ``least`` vectors."""
    f = features(spark, d).where("taxon is not null")
    g = f.groupBy("marker", F.col("taxon").alias("label")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= least).select("marker", "label", "mean")


def _reads_sql(shortest: int, least: int) -> str:
    return f"""{_BASE}, {sql.SEQS}, {sql.counts(4)}, model AS (SELECT marker, taxon AS label, avg(value) AS mean FROM features WHERE taxon IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
  long AS (SELECT * FROM counts4 WHERE length >= {shortest}),
  ids AS (SELECT DISTINCT id, length FROM long),
  cells AS (SELECT ids.id, d.marker, greatest(coalesce(a.cnt, 0), coalesce(b.cnt, 0)) AS cnt, ids.length FROM ids CROSS JOIN domain d LEFT JOIN long a ON a.id = ids.id AND a.kmer = d.kmer LEFT JOIN long b ON b.id = ids.id AND b.kmer = {sql.rc('d.kmer')}),
  vals AS (SELECT id, marker, {sql.scale(sql.level(4, 'cnt', 'length', L.THRESHOLDS[4]), L.VALUES)} AS value FROM cells)"""


_SCORES = "scores AS (SELECT id, label, round(sum(4 - floor(round(abs(mean - value), 9))) / (4::DOUBLE * count(*)), 6) AS score FROM vals JOIN model USING (marker) GROUP BY ALL)"
_READS = f"{_reads_sql(1000, LEAST_GENOMES)},\n  {_SCORES}"


def _record_counts(spark, d, shortest):
    """Four-letter words of the records of ``shortest`` letters or more, the markers and the reads."""
    n = F.length(F.regexp_replace("seq", r"\s+", ""))
    records = table(spark, d, "fasta_records").where("seq is not null").where(n >= shortest)
    counts = cut_lineage(kmers.word_counts(records, "record_id", "seq", (4,)))
    domain = features(spark, d).select("marker").distinct().withColumn("kmer", F.split("marker", r"\|")[0])
    return counts, cut_lineage(domain)


def _best_taxa(spark, d, shortest, least):
    from pyspark.sql import Window as W

    counts, markers = _record_counts(spark, d, shortest)
    scores = classify.read_agreement(counts, cut_lineage(_model(spark, d, least)), markers, (4,))
    best = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "label"))
    return scores.withColumn("score", F.round("score", 6)).withColumn("place", best).where("place <= 3").select("id", "label", "score")


@query(f"{_READS}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS place FROM scores) SELECT id, label, score FROM t WHERE place <= 3")
def classified_reads(spark, d):
    """The three taxa that agree best with each record of 1,000 letters or more."""
    return _best_taxa(spark, d, 1000, LEAST_GENOMES)


@query(f"{_reads_sql(0, 1)}, {_SCORES}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS place FROM scores) SELECT id, label, score FROM t WHERE place <= 3")
def classified_records(spark, d):
    """The three taxa, of all, that agree best with each record of any length."""
    return _best_taxa(spark, d, 0, 1)


_MATCH = "round(sum(4 - floor(round(abs(mean - value), 9))) / (4::DOUBLE * count(*)), 9)"


@query(
    f"""{_reads_sql(0, 1)}, top AS (SELECT marker, right(label, 6) AS label, avg(mean) AS mean FROM model GROUP BY ALL),
  first AS (SELECT id, label, {_MATCH} AS score FROM vals JOIN top USING (marker) GROUP BY ALL),
  second AS (SELECT v.id, right(m.label, 6) AS node, m.label, {_MATCH.replace('mean', 'm.mean').replace('value', 'v.value')} AS score FROM first f JOIN model m ON right(m.label, 6) = f.label JOIN vals v ON v.id = f.id AND v.marker = m.marker WHERE f.score >= 0.5 GROUP BY ALL),
  hits AS (SELECT id, label AS taxon, score AS identity, 'Root' AS path, false AS species_level FROM first WHERE score >= 0.7
    UNION ALL SELECT id, 'root', 0::DOUBLE, 'Root', false FROM first GROUP BY id HAVING max(score) < 0.5
    UNION ALL SELECT id, label, score, 'Root.' || node, true FROM second WHERE score >= 0.7),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY species_level DESC, CASE WHEN species_level THEN 0 ELSE -len(string_split(path, '.')) END, identity DESC, taxon, path) AS place FROM hits)
SELECT id, taxon, round(identity, 6) AS identity, path, species_level, place::INTEGER AS place FROM r WHERE species_level OR place = 1"""
)
def classified_descent(spark, d):
    """Records descending a two-level tree: groups of taxa by the last six letters of their names, then taxa."""
    model = cut_lineage(_model(spark, d, 1))
    group = F.right("label", F.lit(6))
    top = model.groupBy("marker", group.alias("label")).agg(F.avg("mean").alias("mean")).select(F.lit("root").alias("node"), "marker", "label", "mean")
    low = model.select(group.alias("node"), "marker", "label", "mean")
    edges = top.select("node", "label").distinct().withColumn("child", F.col("label")).unionByName(low.select("node", "label").distinct().withColumn("child", F.lit(None).cast("string")))
    counts, markers = _record_counts(spark, d, 0)
    values = cut_lineage(classify.read_values(classify.present_counts(counts, markers), (4,)))
    hits = classify.descend(values, cut_lineage(top.unionByName(low)), cut_lineage(edges), reads=counts.select("id").distinct())
    best = classify.best_hits(hits.withColumn("identity", F.round("identity", 9)), "id", "identity", "path", "species_level", "taxon")
    return best.withColumn("identity", F.round("identity", 6))


@query()
def forest_predictions(spark, d):
    """Held-out predictions of a random forest over the taxa, with class probabilities (M2, M7)."""
    sized = features(spark, d).where("taxon is not null")
    model, test = models.train_node(sized, "forest")
    p = classify.probability_report(models.class_probabilities(test, model), "name", "p")
    return p.select("name", "taxon", "label", "p", "odds_gap", "entropy")


_HEADER = r"regexp_replace(regexp_replace(lower(split_part(description, ' ', 1)), '\s+', '', 'g'), 'sp\.$', '')"


@query(f"WITH {sql.SEQS}, {sql.counts(4)}, names AS (SELECT record_id AS id, t AS taxon FROM (SELECT record_id, {_HEADER} AS t FROM fasta_records) WHERE t NOT IN ('', 'none', 'na', 'nan', '-', 'unknown')) SELECT taxon, kmer, sum(cnt)::BIGINT AS cnt, round(avg({sql.level(4, 'cnt', 'length', L.THRESHOLDS[4])}), 6) AS level FROM counts4 JOIN names USING (id) GROUP BY ALL")
def spectrum_of_taxa(spark, d):
    """4-letter words per taxon named in a record's description, with the mean level."""
    from strandloom.operators.vectors import taxon_form

    names = table(spark, d, "fasta_records").select(F.col("record_id").alias("id"), taxon_form(F.split("description", " ")[0]).alias("taxon")).where("taxon is not null")
    c = kmers.abundance(kmers.word_counts(table(spark, d, "fasta_records"), "record_id", "seq", (4,)), 4)
    return c.join(names, "id").groupBy("taxon", "kmer").agg(F.sum("cnt").alias("cnt"), F.round(F.avg("level"), 6).alias("level"))
