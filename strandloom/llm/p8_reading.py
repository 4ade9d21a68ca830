"""Problem 8: reading levels by gradient-boosted regression trees."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.names import source_key
from strandloom.llm.textwords import LOWER, hash_word, split_words
from strandloom.session import cut_lineage, small, table, wide

LEAST_WORDS = 50
MOST_RATED = 4000  # rated documents used for training; a bound on the training set, not on what is scored
FOLDS = 3

# Frequent short words that tell English, German and French apart.
MARKERS = (("the", "of", "and"), ("die", "der", "und"), ("les", "la", "de"))
WORD_LENGTHS = (4, 7, 10, 13, 16)
SENTENCE_LENGTHS = (6, 12, 18, 26, 36)
FEATURES = (
    "word_len",
    "word_len_sd",
    *(f"words_ge_{n}" for n in WORD_LENGTHS),
    "vowel_groups",
    "sentence_len",
    "sentence_len_sd",
    *(f"sentences_ge_{n}" for n in SENTENCE_LENGTHS),
    "commas",
    "semicolons",
    "clause_len",
    "numbers",
    "distinct",
    "once",
    "overlap",
    "marker_en",
    "marker_de",
    "marker_fr",
)

_LATER = np.zeros(256, bool)
_LATER[0x80:0xC0] = True
_VOWEL = np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiouy"]] = True


def speech(text: Column) -> Column:
    """The text without markup and without interruptions in brackets, however long.

    Each alternative stops at the next bracket of its kind and never goes back, so the time is linear in the text.
    """
    return F.regexp_replace(text, r"<[^<>]*+>|\[[^\[\]]*+\]|\([^()]*+\)|­", " ")


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words and the ``FEATURES`` of every text, all texts of a batch at once."""
    n = len(texts)
    w = split_words(texts, digits=False)
    raw, ends, doc, start, stop, h = w.raw, w.ends, w.doc, w.start, w.stop, w.hash
    low = LOWER[raw]
    words = np.bincount(doc, minlength=n)
    safe = np.maximum(words, 1)
    per = lambda x: np.bincount(doc, weights=x, minlength=n) / safe
    later = np.concatenate([[0], np.cumsum(_LATER[raw])])
    length = (stop - start) - (later[stop] - later[start])
    mean = per(length)
    out = [mean, np.sqrt(np.maximum(per(length.astype(float) ** 2) - mean**2, 0))]
    out += [per(length >= k) for k in WORD_LENGTHS]
    vowel = _VOWEL[low] | _LATER[raw]
    groups = np.concatenate([[0], np.cumsum(vowel & ~np.concatenate([[False], vowel[:-1]]))])
    out.append(per(groups[stop] - groups[start]))
    # a sentence ends at . ! ? before white space and no digit or small letter, and at the text's end
    ahead = np.concatenate([raw[1:], [0, 0]])
    blank = (ahead[:-1] == 32) | (ahead[:-1] == 10) | (ahead[:-1] == 13) | (ahead[:-1] == 0)
    after = ahead[1:]
    close = ((raw == 46) | (raw == 33) | (raw == 63)) & blank & ~((after >= 48) & (after <= 57)) & ~((after >= 97) & (after <= 122))
    close[ends] = True
    sentence_of = np.concatenate([[0], np.cumsum(close)])[start]
    sentence, inverse, size = np.unique(sentence_of, return_inverse=True, return_counts=True)
    first_word = np.searchsorted(sentence_of, sentence)
    sdoc = doc[first_word] if len(first_word) else np.zeros(0, np.int64)
    sentences = np.maximum(np.bincount(sdoc, minlength=n), 1)
    each = lambda x: np.bincount(sdoc, weights=x, minlength=n) / sentences
    slen = each(size)
    out += [slen, np.sqrt(np.maximum(each(size.astype(float) ** 2) - slen**2, 0))]
    out += [each(size >= k) for k in SENTENCE_LENGTHS]
    at = lambda code: np.bincount(np.searchsorted(ends, np.flatnonzero(raw == code)), minlength=n)
    commas, semicolons = at(44), at(59)
    out += [commas / sentences, semicolons / sentences, words / (sentences + commas + semicolons)]
    digit = (raw >= 48) & (raw <= 57)
    number = digit & ~np.concatenate([[False], digit[:-1]])
    out.append(np.bincount(np.searchsorted(ends, np.flatnonzero(number)), minlength=n) / safe)
    # vocabulary and cohesion over word hashes
    mixed = h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    kinds, which, count = np.unique(mixed, return_inverse=True, return_counts=True)
    kdoc = np.zeros(len(kinds), np.int64)
    kdoc[which] = doc
    distinct = np.bincount(kdoc, minlength=n)
    out += [distinct / np.sqrt(safe), np.bincount(kdoc, weights=count == 1, minlength=n) / np.maximum(distinct, 1)]
    content = length >= 5
    here = np.unique(np.stack([which[content], inverse[content]]), axis=1) if content.any() else np.zeros((2, 0), np.int64)
    key = here[0].astype(np.int64) * (len(sentence) + 2) + here[1]
    again = np.isin(key + 1, key, assume_unique=True)
    out.append(np.bincount(kdoc[here[0]], weights=again, minlength=n) / np.maximum(np.bincount(kdoc[here[0]], minlength=n), 1))
    for group in MARKERS:
        out.append(per(np.isin(h, [hash_word(x) for x in group])))
    return words, np.stack(out, 1)


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``(id, words, f)`` of every document with at least ``least`` words of speech; ``f`` is the array of ``FEATURES``.

    Null, blank and short texts have no row. Whole texts are measured, in batches by size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                words, f = measure(part.column(1).to_pylist())
                ok = words >= least
                flat = np.ascontiguousarray(f[ok]).ravel()
                offsets = np.arange(int(ok.sum()) + 1, dtype=np.int32) * f.shape[1]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), pa.array(words[ok].astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "words", "f"])

    rows = docs.where(f"{id_col} is not null and {text_col} is not null").select(F.col(id_col).cast("bigint").alias("id"), speech(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "id bigint, words bigint, f array<double>")


def _vectors(df: DataFrame) -> DataFrame:
    flat = df.select("*", *(F.get("f", F.lit(i)).alias(name) for i, name in enumerate(FEATURES)))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(flat).drop(*FEATURES)


def _trees(seed: int) -> GBTRegressor:
    return GBTRegressor(labelCol="level", featuresCol="features", predictionCol="score", maxDepth=4, maxIter=20, stepSize=0.25, subsamplingRate=0.8, maxBins=64, minInstancesPerNode=4, seed=seed)


def best_cuts(score: np.ndarray, level: np.ndarray) -> list[float]:
    """The four cut points between levels that misplace fewest of the held-out scores, each between its neighbours' medians."""
    cuts = []
    for k in range(1, 5):
        x = np.sort(score)
        lo, hi = k - 0.2, k + 1.2
        tries = np.unique(np.concatenate([x[(x > lo) & (x < hi)], [k + 0.5]]))
        if len(tries) > 400:
            tries = np.quantile(tries, np.linspace(0, 1, 400))
        wrong = [((score > t) != (level > k)).sum() for t in tries]
        best = np.flatnonzero(np.array(wrong) == min(wrong))
        cuts.append(float(tries[best].mean()))
    return sorted(cuts)


def rated_sample(features: DataFrame, ratings: DataFrame, sources: DataFrame, most: int = MOST_RATED, folds: int = FOLDS) -> DataFrame:
    """``(id, source, fold, level, f)`` of at most ``most`` rated documents, chosen by hash of the id.

    Null ratings are dropped, several of one document are averaged. A fold holds whole sources,
    so every held-out score is of a source the model has not seen; documents without one share a name.
    """
    level = ratings.where("reading_level between 1 and 5 and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.avg("reading_level").alias("level"))
    named = sources.select(F.col("doc_id").alias("id"), F.coalesce(source_key(F.col("source")), F.lit("")).alias("source"))
    rated = features.join(level, "id").orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(most)
    rated = rated.join(named, "id").groupBy("id").agg(F.first("source").alias("source"), F.first("level").alias("level"), F.first("f").alias("f"))
    # sources dealt to folds by size, so that a dominant one does not fill all of them
    order = W.orderBy(F.desc("n"), "source")
    dealt = rated.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("fold", F.pmod(F.row_number().over(order) - 1, F.lit(folds)))
    return rated.join(small(dealt.select("source", "fold")), "source")


def reading_levels(features: DataFrame, ratings: DataFrame, sources: DataFrame, folds: int = FOLDS, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(levels, report)``: a level 1..5 for every row of ``features`` and the cross-validation by source.

    Boosted regression trees are trained on the rated sample with one fold of sources held out
    at a time; the held-out scores set the four cut points between levels (the calibration),
    and a model over all folds scores every document. The report has, per source, the rated
    documents, the mean error of the held-out score and the share of exact levels. Without any
    rating there is nothing to learn from: both results are empty.
    """
    features = cut_lineage(features)
    rated = cut_lineage(_vectors(rated_sample(features, ratings, sources, folds=folds)).coalesce(2))
    spark = features.sparkSession
    have = [r[0] for r in rated.select("fold").distinct().collect()]  # at most `folds` rows
    if not have:
        return spark.createDataFrame([], "id bigint, reading_level int, score double"), spark.createDataFrame([], "source string, rated bigint, mean_error double, exact double")
    rated.persist()

    def fit(fold: int | None):
        train = rated if fold is None or len(have) == 1 else rated.where(F.col("fold") != fold)
        return _trees(seed).fit(train)

    with ThreadPoolExecutor(len(have) + 1) as pool:
        models = list(pool.map(fit, [*have, None]))
    held = None
    for fold, model in zip(have, models, strict=False):
        part = model.transform(rated.where(F.col("fold") == fold)).select("id", "source", "level", "score")
        held = part if held is None else held.union(part)
    held = cut_lineage(held)
    seen = held.select("score", "level").toPandas()  # at most MOST_RATED rows
    cuts = best_cuts(seen["score"].to_numpy(), np.round(seen["level"].to_numpy() + 1e-9))
    rated.unpersist()

    def graded(df: DataFrame) -> DataFrame:
        grade = F.lit(1)
        for c in cuts:
            grade = grade + (F.col("score") > F.lit(c)).cast("int")
        return df.withColumn("reading_level", grade)

    levels = graded(models[-1].transform(_vectors(features))).select("id", "reading_level", "score")
    exact = (F.col("reading_level") == F.round("level")).cast("double")
    report = graded(held).groupBy("source").agg(F.count(F.lit(1)).alias("rated"), F.avg(F.abs(F.col("score") - F.col("level"))).alias("mean_error"), F.avg(exact).alias("exact"))
    return levels, report


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    features = text_features(wide(docs.select("doc_id", "text")))
    return reading_levels(features, table(spark, d, "reading_labels"), docs.select("doc_id", "source"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document with at least 50 words of speech and its level."""
    return _run(spark, d)[0].select(F.col("id").alias("doc_id"), "reading_level")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validation of the levels by source."""
    return _run(spark, d)[1]
