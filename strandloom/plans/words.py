"""Queries over word databases (wdb_words)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import levels as L
from strandloom.functions import seq as S
from strandloom.operators import wdb
from strandloom.operators.ranking import global_rank
from strandloom.operators.vectors import word_domain
from strandloom.plans import sql
from strandloom.session import cut_lineage, small, table

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


def words(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned word table."""
    return wdb.clean_words(table(spark, d, "wdb_words"))


def archived(spark: SparkSession, d: str) -> DataFrame:
    """Words with the archive (first three letters of the accession) as group."""
    return words(spark, d).withColumn("archive", F.substr("acc", F.lit(1), F.lit(3)))


def r6(col):
    """Rounded to six decimals for comparison."""
    return F.round(col, 6)


@query(f"WITH {sql.WORDS} SELECT k, count(DISTINCT acc) AS genomes, count(DISTINCT kmer) AS words, count(*) AS entries FROM words GROUP BY ROLLUP (k)")
def db_info(spark, d):
    """Genomes, words and entries per word length and over all."""
    return wdb.db_info(words(spark, d))


@query(f"WITH {sql.WORDS} SELECT k, kmer, sum(cnt)::BIGINT AS cnt, count(*) AS genomes FROM words GROUP BY ALL")
def word_totals(spark, d):
    """Global counter of each word (A2)."""
    return words(spark, d).groupBy("k", "kmer").agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("genomes"))


@query(f"WITH {sql.WORDS} SELECT k, kmer, " + ", ".join(f"count(*) FILTER (level = {i}) AS n{i}" for i in range(4)) + " FROM words GROUP BY ALL")
def level_table(spark, d):
    """Genomes of each word at each level."""
    return wdb.level_counts(words(spark, d), "k", "kmer")


@query(f"WITH {sql.WORDS} SELECT k, " + ", ".join(f"count(*) FILTER (level = {i}) AS n{i}" for i in range(4)) + " FROM words GROUP BY ALL")
def word_distribution(spark, d):
    """Scarce, common, frequent and abundant entries per word length."""
    return wdb.level_counts(words(spark, d), "k")


_RANK, _BORDER = sql.scale("level", L.RANKS), sql.scale("level", L.BORDERS)


@query(f"WITH {sql.WORDS} SELECT k, kmer, count(*) AS n, round(avg({_RANK}), 6) AS rank_mean, round(var_pop({_RANK}), 6) AS rank_var, round(avg({_BORDER}) - 1, 6) AS border_mean, round(var_pop({_BORDER}), 6) AS border_var FROM words WHERE level IS NOT NULL GROUP BY ALL")
def rank_stats(spark, d):
    """Mean and variance on the rank and border scales."""
    s = wdb.rank_statistics(words(spark, d), "k", "kmer")
    return s.select("k", "kmer", "n", *[r6(F.col(c)).alias(c) for c in ("rank_mean", "rank_var", "border_mean", "border_var")])


_SAMPLE = sql.scale("level", L.SAMPLE)
_DIVERGENCY = f"""divergency AS (SELECT k, kmer, n, CASE WHEN n < 2 THEN 0 ELSE 10 * v / ((n // 2)::DOUBLE / n * (1 - (n // 2)::DOUBLE / n)) END AS divergency, 10 * m AS commonality, 10 - 10 * m AS rareness
  FROM (SELECT k, kmer, count(*) AS n, var_pop({_SAMPLE}) AS v, avg({_SAMPLE}) AS m FROM words WHERE level IS NOT NULL GROUP BY ALL))"""


@query(f"WITH {sql.WORDS}, {_DIVERGENCY} SELECT k, kmer, n, round(divergency, 6) AS divergency, round(commonality, 6) AS commonality, round(rareness, 6) AS rareness FROM divergency")
def word_divergency(spark, d):
    """Divergency, commonality and rareness of words."""
    s = wdb.divergency(words(spark, d), "k", "kmer")
    return s.select("k", "kmer", "n", *[r6(F.col(c)).alias(c) for c in ("divergency", "commonality", "rareness")])


@query(f"WITH {sql.WORDS}, {_DIVERGENCY} SELECT k, kmer, round(s, 6) AS score, place::INTEGER AS place FROM (SELECT k, kmer, s, row_number() OVER (PARTITION BY k ORDER BY s DESC, kmer) AS place FROM (SELECT k, kmer, round(divergency, 9) AS s FROM divergency)) WHERE place <= 50")
def extreme_words(spark, d):
    """The 50 most diverse words of each length."""
    s = wdb.divergency(words(spark, d), "k", "kmer").select("k", "kmer", F.round("divergency", 9).alias("score"))
    return wdb.extreme_words(s, "score", 50).select("k", "kmer", r6(F.col("score")).alias("score"), "place")


@query(
    f"""WITH {sql.WORDS}, a AS (SELECT k, kmer, left(acc, 3) AS archive, {_BORDER} AS b FROM words WHERE level IS NOT NULL),
  o AS (SELECT k, kmer, avg(b) AS o, CASE WHEN count(*) > 1 THEN var_pop(b) ELSE 0 END AS v, count(*) AS n FROM a WHERE archive = 'qvx' GROUP BY ALL),
  c AS (SELECT k, kmer, avg(g) AS c FROM (SELECT k, kmer, archive, avg(b) AS g FROM a WHERE archive <> 'qvx' GROUP BY ALL) GROUP BY ALL)
SELECT k, kmer, round(abs(o - c) / sqrt(1 + v / n), 6) AS score FROM o JOIN c USING (k, kmer)"""
)
def confrontation(spark, d):
    """Words of one archive against the others."""
    s = wdb.confrontation(archived(spark, d), "archive", "qvx")
    return s.select("k", "kmer", r6(F.col("score")).alias("score"))


@query(
    f"""WITH {sql.WORDS}, a AS (SELECT k, kmer, left(acc, 3) AS archive, {_SAMPLE} AS s FROM words WHERE level IS NOT NULL),
  p AS (SELECT k, kmer, archive, count(*) AS n, sum(s) AS s, sum(s * s) AS q FROM a GROUP BY ALL),
  w AS (SELECT k, kmer, sum(n) AS n, count(*) AS g, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM p GROUP BY ALL),
  f AS (SELECT k, kmer, (b - s * s / n) / (g - 1) / ((q - b) / (n - g)) AS f FROM w WHERE g > 1 AND n > g AND (q - b) / (n - g) > 1e-12)
SELECT k, kmer, round(10 * f / (SELECT max(f) FROM f), 5) AS score FROM f"""
)
def taxa_variance(spark, d):
    """One-way F ratio of words between archives."""
    s = wdb.taxa_variance(archived(spark, d), "archive")
    return s.select("k", "kmer", F.round("score", 5).alias("score"))


@query(f"WITH {sql.WORDS} SELECT k, kmer, left(acc, 3) AS archive, floor(avg({_RANK}) / 2.5)::INTEGER AS merged FROM words WHERE level IS NOT NULL GROUP BY ALL")
def merged_levels(spark, d):
    """Levels of a group merged to one, the whole part of mean rank / 2.5."""
    rank = L.on_scale(F.col("level"), L.RANKS)
    return archived(spark, d).where("level is not null").groupBy("k", "kmer", "archive").agg(F.floor(F.avg(rank) / 2.5).cast("int").alias("merged"))


@query(f"WITH {sql.WORDS} SELECT acc, k, kmer, 10::DOUBLE AS score, row_number() OVER (PARTITION BY acc ORDER BY k DESC, kmer)::INTEGER AS place FROM words WHERE level = 3")
def over_represented(spark, d):
    """Words at the top level of each genome, longest first."""
    from pyspark.sql import Window as W

    top = words(spark, d).where("level = 3")
    return top.select("acc", "k", "kmer", F.lit(10.0).alias("score"), F.row_number().over(W.partitionBy("acc").orderBy(F.desc("k"), "kmer")).alias("place"))


@query(
    f"""WITH {sql.WORDS}, c AS (SELECT DISTINCT k, x, y FROM words), r AS (SELECT k, x, count(*) AS n FROM c GROUP BY ALL), q AS (SELECT k, y, count(*) AS n FROM c GROUP BY ALL)
SELECT k, (SELECT count(*) FROM c WHERE c.k = r.k) AS size, count(*) AS rows, arg_max(x, n * 100000 - x) AS top_x, arg_min(x, n * 100000 + x) AS bottom_x,
  any_value(ty) AS top_y, any_value(byy) AS bottom_y
FROM r JOIN (SELECT k, arg_max(y, n * 100000 - y) AS ty, arg_min(y, n * 100000 + y) AS byy FROM q GROUP BY k) USING (k) GROUP BY k"""
)
def word_shape(spark, d):
    """Occupied cells per word length and the fullest and emptiest rows and columns."""
    cells = words(spark, d).select("k", "x", "y").distinct()
    x = cells.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    y = cells.groupBy("k", "y").agg(F.count(F.lit(1)).alias("n"))
    top = lambda c: F.max_by(c, F.struct("n", -F.col(c)))
    low = lambda c: F.min_by(c, F.struct("n", c))
    rows = x.groupBy("k").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("rows"), top("x").alias("top_x"), low("x").alias("bottom_x"))
    return rows.join(y.groupBy("k").agg(top("y").alias("top_y"), low("y").alias("bottom_y")), "k")


@query(f"WITH w AS (SELECT DISTINCT upper(kmer) AS kmer FROM wdb_words WHERE kmer IS NOT NULL) SELECT kmer, len(kmer)::INTEGER AS k, {sql.coord('kmer', 'x')} AS x, {sql.coord('kmer', 'y')} AS y FROM w")
def kmer_coordinates(spark, d):
    """Coordinates of every stored word."""
    w = table(spark, d, "wdb_words").where("kmer is not null").select(F.upper("kmer").alias("kmer")).distinct()
    return w.select("kmer", F.length("kmer").alias("k"), S.word_x(F.col("kmer")).alias("x"), S.word_y(F.col("kmer")).alias("y"))


@query(f"WITH w AS (SELECT DISTINCT k, x, y FROM wdb_words) SELECT k, x, y, {sql.word('k', 'x', 'y')} AS kmer, (CASE WHEN x <= y THEN (y - 1) * y // 2 + x - 1 ELSE -1 END)::BIGINT AS pos FROM w")
def kmer_restored(spark, d):
    """Words back from coordinates and their place in the upper triangle."""
    w = table(spark, d, "wdb_words").select("k", "x", "y").distinct()
    return w.select("k", "x", "y", S.word_at(F.col("k"), F.col("x"), F.col("y")).alias("kmer"), S.linear_index(F.col("x"), F.col("y")).alias("pos"))


_F = "(1e6::DOUBLE * cnt / total)"
_P = f"((ln({_F}) + 4.5 * ln(k) - 9) / 3)"


@query(f"WITH {sql.WORDS}, t AS (SELECT acc, k, kmer, cnt, sum(cnt) OVER (PARTITION BY acc, k) AS total FROM words WHERE cnt > 0), p AS (SELECT acc, k, kmer, CASE WHEN {_P} < 0.05 THEN 0 WHEN {_P} > 0.95 THEN 1 ELSE {_P} END AS p FROM t) SELECT acc, k, kmer, round(p, 6) AS percentile, round(exp(3 * p + 9) / pow(k, 4.5), 4) AS border FROM p")
def percentile_border(spark, d):
    """Log percentile of a word's share of its database and the frequency at that percentile."""
    from pyspark.sql import Window as W

    w = words(spark, d).where("cnt > 0")
    f = F.lit(1e6) * F.col("cnt") / F.sum("cnt").over(W.partitionBy("acc", "k"))
    p = w.withColumn("f", f).withColumn("p", L.percentile_of(F.col("f"), F.col("k")))
    return p.select("acc", "k", "kmer", r6(F.col("p")).alias("percentile"), F.round(L.border_frequency(F.col("p"), F.col("k")), 4).alias("border"))


@query(f"WITH {sql.WORDS} SELECT DISTINCT k, kmer, x, y FROM words WHERE k BETWEEN 4 AND 6 AND kmer LIKE 'AT%'")
def word_search(spark, d):
    """Words of length 4 to 6 that match a template."""
    return words(spark, d).where("k between 4 and 6 and kmer like 'AT%'").select("k", "kmer", "x", "y").distinct()


@query(f"WITH {sql.WORDS} SELECT substr(kmer, i, 4) AS kmer, sum(cnt)::BIGINT AS cnt FROM (SELECT kmer, cnt, unnest(range(1, k - 2)) AS i FROM words) GROUP BY ALL")
def word_reprojection(spark, d):
    """Counts of 4-letter words inside the stored words."""
    inner = words(spark, d).select(F.explode(S.windows(F.col("kmer"), 4)).alias("kmer"), "cnt")
    return inner.groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


@query(
    f"""WITH {sql.WORDS}, t AS (SELECT kmer, sum(cnt)::BIGINT AS cnt FROM words GROUP BY kmer),
  n AS (SELECT kmer, cnt, substr(kmer, 2) || c AS other FROM t, (SELECT unnest(['A', 'C', 'G', 'T']) AS c))
SELECT n.kmer, n.other, n.cnt, t.cnt AS other_cnt FROM n JOIN t ON n.other = t.kmer WHERE n.kmer <> n.other"""
)
def frame_shifts(spark, d):
    """Stored words that follow one another by a frame shift."""
    t = cut_lineage(words(spark, d).groupBy("kmer").agg(F.sum("cnt").alias("cnt")))
    n = t.select("kmer", "cnt", F.explode(S.shifts(F.col("kmer"))).alias("other")).where("kmer <> other")
    return n.join(t.select(F.col("kmer").alias("other"), F.col("cnt").alias("other_cnt")), "other").select("kmer", "other", "cnt", "other_cnt")


@query(
    f"""WITH {sql.WORDS}, t AS (SELECT DISTINCT kmer FROM words),
  n AS (SELECT kmer, left(kmer, i - 1) || c || substr(kmer, i + 1) AS other FROM (SELECT kmer, unnest(range(1, len(kmer) + 1)) AS i FROM t), (SELECT unnest(['A', 'C', 'G', 'T']) AS c))
SELECT kmer, count(DISTINCT other) AS neighbours FROM n WHERE kmer <> other AND other IN (SELECT kmer FROM t) GROUP BY kmer"""
)
def hamming_neighbours(spark, d):
    """Stored words one substitution away from each stored word."""
    t = cut_lineage(words(spark, d).select("kmer").distinct())
    n = t.select("kmer", F.explode(S.substitutions(F.col("kmer"))).alias("other"))
    return n.join(t.select(F.col("kmer").alias("other")), "other").groupBy("kmer").agg(F.count(F.lit(1)).alias("neighbours"))


@query(f"WITH {sql.WORDS}, t AS (SELECT DISTINCT kmer FROM words) SELECT kmer, {sql.rc('kmer')} AS reverse_word, list_sum(list_transform(range(1, len(kmer) + 1), lambda i: (substr(kmer, i, 1) <> substr({sql.rc('kmer')}, i, 1))::INT))::INTEGER AS differing FROM t")
def strand_mismatches(spark, d):
    """Letters by which a word differs from its reverse complement."""
    t = words(spark, d).select("kmer").distinct().withColumn("reverse_word", S.reverse_complement(F.col("kmer")))
    return t.withColumn("differing", S.mismatches(F.col("kmer"), F.col("reverse_word")))


@query(f"WITH {sql.WORDS}, {sql.DOMAIN} SELECT domain.kmer, domain.x, domain.y, domain.pos, count(words.acc) AS genomes FROM domain LEFT JOIN words ON words.kmer = domain.kmer AND words.k = 4 GROUP BY ALL")
def domain_coverage(spark, d):
    """Genomes that have each of the possible 4-letter words."""
    domain = word_domain(spark, 4).select("kmer", "x", "y", "pos")
    found = words(spark, d).where("k = 4").groupBy("kmer").agg(F.count("acc").alias("genomes"))
    return F.broadcast(domain).join(found, "kmer", "left").select("kmer", "x", "y", "pos", F.coalesce("genomes", F.lit(0)).alias("genomes"))


@query(f"WITH {sql.WORDS} SELECT k, count(*) AS whole, count(*) FILTER (x <= y) AS lower, count(*) FILTER (x >= y) AS upper FROM words GROUP BY ALL")
def geometry_counts(spark, d):
    """Entries that each matrix geometry keeps."""
    w = words(spark, d)
    out = None
    for kind in ("whole", "lower", "upper"):
        n = wdb.geometry(w, kind).groupBy("k").agg(F.count(F.lit(1)).alias(kind))
        out = n if out is None else out.join(n, "k", "left").fillna(0, [kind])
    return out


@query(f"WITH {sql.WORDS} SELECT acc, dense_rank() OVER (ORDER BY acc) AS genome_id, n AS words, k_low, k_high FROM (SELECT acc, count(*) AS n, min(k) AS k_low, max(k) AS k_high FROM words GROUP BY acc)")
def genome_registry(spark, d):
    """Genomes with ids and the words they hold."""
    g = words(spark, d).groupBy("acc").agg(F.count(F.lit(1)).alias("words"), F.min("k").alias("k_low"), F.max("k").alias("k_high"))
    return global_rank(g, [F.col("acc")], "genome_id").select("acc", "genome_id", "words", "k_low", "k_high")


@query(f"WITH {sql.WORDS} SELECT acc, k, string_agg(lpad(bin(level), 2, '0'), '' ORDER BY x, y) AS levels FROM words WHERE level IS NOT NULL GROUP BY ALL")
def level_strings(spark, d):
    """All levels of a genome as one string of two bits each."""
    bits = F.lpad(F.bin(F.col("level").cast("bigint")), 2, "0")
    g = words(spark, d).where("level is not null").groupBy("acc", "k").agg(F.array_sort(F.collect_list(F.struct("x", "y", bits.alias("b")))).alias("l"))
    return g.select("acc", "k", F.array_join(F.transform("l", lambda s: s["b"]), "").alias("levels"))


@query(
    f"""WITH {sql.WORDS}, s AS (SELECT kmer, sum(cnt)::BIGINT AS cnt FROM words WHERE k = 6 GROUP BY kmer),
  n AS (SELECT kmer, cnt, {sql.rc('kmer')} AS other FROM s
    UNION SELECT kmer, cnt, left(kmer, i - 1) || c || substr(kmer, i + 1) FROM (SELECT kmer, cnt, unnest(range(1, 7)) AS i FROM s), (SELECT unnest(['A', 'C', 'G', 'T']) AS c)
    UNION SELECT kmer, cnt, substr(kmer, 2) || c FROM s, (SELECT unnest(['A', 'C', 'G', 'T']) AS c)
    UNION SELECT kmer, cnt, c || left(kmer, 5) FROM s, (SELECT unnest(['A', 'C', 'G', 'T']) AS c))
SELECT kmer, cnt FROM s WHERE kmer NOT IN (SELECT n.kmer FROM n JOIN s AS o ON o.kmer = n.other WHERE n.other <> n.kmer AND (o.cnt > n.cnt OR (o.cnt = n.cnt AND o.kmer < n.kmer)))"""
)
def nonredundant_words(spark, d):
    """Words of six letters that no neighbour outnumbers (K6, as local maxima)."""
    s = cut_lineage(words(spark, d).where("k = 6").groupBy("kmer").agg(F.sum("cnt").alias("cnt")))
    return wdb.without_dominated(s, "cnt")


@query(f"WITH {sql.WORDS}, m AS (SELECT min(acc) AS acc FROM words) SELECT acc, k, kmer, cnt, level FROM words WHERE acc NOT IN (SELECT acc FROM m) UNION ALL SELECT acc, k, kmer, cnt * 2, level FROM words WHERE acc IN (SELECT acc FROM m)")
def replaced_genome(spark, d):
    """The database with one genome's rows replaced by a new count of it."""
    w = words(spark, d).select("acc", "k", "kmer", "cnt", "level")
    first = w.agg(F.min("acc").alias("acc"))
    new = w.join(F.broadcast(first), "acc", "left_semi").withColumn("cnt", F.col("cnt") * 2)  # one row
    return wdb.replace_genome(w, new)


@query(f"WITH {sql.WORDS} SELECT chunk, min(kmer) AS first_word, max(kmer) AS last_word, count(*) AS n FROM (SELECT kmer, ((row_number() OVER (ORDER BY kmer)) - 1) // 1000 AS chunk FROM (SELECT DISTINCT kmer FROM words)) GROUP BY ALL")
def word_chunks(spark, d):
    """Words in chunks of 1,000 for a sink of bounded documents."""
    from strandloom.sources.wdb import chunked

    c = chunked(words(spark, d).select("kmer").distinct(), ["kmer"], 1000)
    return c.groupBy("chunk").agg(F.min("kmer").alias("first_word"), F.max("kmer").alias("last_word"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {sql.WORDS}, t AS (SELECT acc, sum(cnt)::DOUBLE AS total FROM words WHERE k = 4 GROUP BY acc),
  o AS (SELECT acc, kmer, CASE WHEN p < 0.05 THEN 0 WHEN p > 0.95 THEN 1 ELSE p END AS o FROM (SELECT acc, kmer, (ln(1e5::DOUBLE * cnt / total) + 4.5 * ln(4) - 9) / 3 AS p FROM words JOIN t USING (acc) WHERE k = 4 AND cnt > 0)),
  e AS (SELECT kmer, avg({sql.scale('level', L.BORDERS)} - 1) / 10 AS e FROM words WHERE k = 4 AND level IS NOT NULL GROUP BY kmer),
  x AS (SELECT acc, sum((1 + (o - e) / (2 - e)) * (o - e) * (o - e)) AS c, sum((1 + (m - e) / (2 - e)) * (m - e) * (m - e)) AS w FROM (SELECT acc, o, e, CASE WHEN e >= 0.5 THEN 0 ELSE 1 END AS m FROM o JOIN e USING (kmer)) GROUP BY acc)
SELECT acc, round(10 * sqrt(c / w), 6) AS distance FROM x"""
)
def profile_distance(spark, d):
    """Weighted distance of each genome's 4-letter words to the mean profile, 0..10."""
    w = words(spark, d).where("k = 4")
    total = w.groupBy("acc").agg(F.sum("cnt").cast("double").alias("total"))
    o = w.where("cnt > 0").join(total, "acc").select("acc", "kmer", L.percentile_of(F.lit(1e5) * F.col("cnt") / F.col("total"), F.col("k")).alias("o"))
    e = w.where("level is not null").groupBy("kmer").agg((F.avg(L.on_scale(F.col("level"), L.BORDERS) - 1) / 10).alias("e"))
    x = o.join(small(e), "kmer").withColumn("m", F.when(F.col("e") >= 0.5, 0.0).otherwise(1.0))
    gap = lambda c: F.sum((1 + (F.col(c) - F.col("e")) / (2 - F.col("e"))) * (F.col(c) - F.col("e")) * (F.col(c) - F.col("e")))
    return x.groupBy("acc").agg(r6(10 * F.sqrt(gap("o") / gap("m"))).alias("distance"))


@query(
    f"""WITH {sql.WORDS}, s AS (SELECT kmer, sum(cnt)::BIGINT AS cnt FROM words GROUP BY kmer),
  n AS (SELECT kmer, cnt, {sql.rc('kmer')} AS other FROM s
    UNION SELECT kmer, cnt, left(kmer, i - 1) || c || substr(kmer, i + 1) FROM (SELECT kmer, cnt, unnest(range(1, len(kmer) + 1)) AS i FROM s), (SELECT unnest(['A', 'C', 'G', 'T']) AS c)
    UNION SELECT kmer, cnt, substr(kmer, 2) || c FROM s, (SELECT unnest(['A', 'C', 'G', 'T']) AS c)
    UNION SELECT kmer, cnt, c || left(kmer, len(kmer) - 1) FROM s, (SELECT unnest(['A', 'C', 'G', 'T']) AS c))
SELECT kmer, cnt FROM s WHERE kmer NOT IN (SELECT n.kmer FROM n JOIN s AS o ON o.kmer = n.other WHERE n.other <> n.kmer AND (o.cnt > n.cnt OR (o.cnt = n.cnt AND o.kmer < n.kmer)))"""
)
def nonredundant_words_all(spark, d):
    """Words of every length that no neighbour outnumbers (K6, as local maxima)."""
    s = cut_lineage(words(spark, d).groupBy("kmer").agg(F.sum("cnt").alias("cnt")))
    return wdb.without_dominated(s, "cnt")


@query(
    f"""WITH {sql.WORDS}, t AS (SELECT acc, k, sum(cnt)::DOUBLE AS total FROM words GROUP BY ALL),
  o AS (SELECT acc, k, kmer, CASE WHEN p < 0.05 THEN 0 WHEN p > 0.95 THEN 1 ELSE p END AS o FROM (SELECT acc, k, kmer, (ln(1e5::DOUBLE * cnt / total) + 4.5 * ln(k) - 9) / 3 AS p FROM words JOIN t USING (acc, k) WHERE cnt > 0)),
  e AS (SELECT k, kmer, avg({sql.scale('level', L.BORDERS)} - 1) / 10 AS e FROM words WHERE level IS NOT NULL GROUP BY ALL),
  x AS (SELECT acc, k, sum((1 + (o - e) / (2 - e)) * (o - e) * (o - e)) AS c, sum((1 + (m - e) / (2 - e)) * (m - e) * (m - e)) AS w FROM (SELECT acc, k, o, e, CASE WHEN e >= 0.5 THEN 0 ELSE 1 END AS m FROM o JOIN e USING (k, kmer)) GROUP BY ALL)
SELECT acc, k, round(10 * sqrt(c / nullif(w, 0)), 5) AS distance FROM x"""
)
def profile_distances(spark, d):
    """Weighted distance of each genome's words to the mean profile, 0..10, for every word length."""
    from pyspark.sql import Window as W

    w = words(spark, d)
    total = F.sum("cnt").over(W.partitionBy("acc", "k")).cast("double")
    o = w.withColumn("total", total).where("cnt > 0").select("acc", "k", "kmer", L.percentile_of(F.lit(1e5) * F.col("cnt") / F.col("total"), F.col("k")).alias("o"))
    e = w.where("level is not null").groupBy("k", "kmer").agg((F.avg(L.on_scale(F.col("level"), L.BORDERS) - 1) / 10).alias("e"))
    x = o.join(e, ["k", "kmer"]).withColumn("m", F.when(F.col("e") >= 0.5, 0.0).otherwise(1.0))
    gap = lambda c: F.sum((1 + (F.col(c) - F.col("e")) / (2 - F.col("e"))) * (F.col(c) - F.col("e")) * (F.col(c) - F.col("e")))
    return x.groupBy("acc", "k").agg(F.round(10 * F.sqrt(F.try_divide(gap("o"), gap("m"))), 5).alias("distance"))
