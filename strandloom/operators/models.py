"""Optional machine-learning models per node on Spark ML."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.sources.wdb import column_titles, wide_matrix

KINDS = ("forest", "logistic", "perceptron", "svm")


def feature_matrix(features: DataFrame) -> tuple[DataFrame, list[str]]:
    """``(name, taxon, m0..)`` and its column names; the marker titles are kept out of column names."""
    titles = column_titles(features)
    rows = wide_matrix(features.where("taxon is not null"), ["name", "taxon"], titles).fillna(0)
    cols = [f"m{i}" for i in range(len(titles))]
    return rows.toDF("name", "taxon", *cols), cols


def node_model(kind: str, cols: list[str], classes: int, seed: int = 42, trees: int = 300) -> Pipeline:
    """An unfitted pipeline: label index, vector, scaler, classifier."""
    steps = [StringIndexer(inputCol="taxon", outputCol="label", handleInvalid="skip"), VectorAssembler(inputCols=cols, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    last = {
        "forest": lambda: RandomForestClassifier(numTrees=trees, seed=seed, featureSubsetStrategy="sqrt"),
        "logistic": lambda: LogisticRegression(maxIter=100, regParam=0.01),
        "perceptron": lambda: MultilayerPerceptronClassifier(layers=[len(cols), 128, 64, classes], seed=seed),
        "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=50, regParam=0.01)),
    }[kind]()
    return Pipeline(stages=[*steps, last])


def holdout(rows: DataFrame, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, ``share`` of every taxon held out by hash order."""
    order = W.partitionBy("taxon").orderBy(F.xxhash64(F.lit(seed), "name"), "name")
    marked = rows.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("taxon")))
    test = F.col("_r") <= F.floor(F.col("_n") * share)
    return marked.where(~test).drop("_r", "_n"), marked.where(test).drop("_r", "_n")


def train_node(features: DataFrame, kind: str = "forest", seed: int = 42, trees: int = 300, least_median: int = 0) -> tuple[PipelineModel, DataFrame] | None:
    """A fitted model and the predictions on the held-out fifth; None if the median cluster is under ``least_median``."""
    rows, cols = feature_matrix(features)
    sizes = rows.groupBy("taxon").count()
    median, classes = sizes.agg(F.percentile("count", 0.5), F.count(F.lit(1))).first()
    if median is None or int(median) < least_median:
        return None
    train, test = holdout(rows, seed=seed)
    model = node_model(kind, cols, classes, seed, trees).fit(train)
    return model, model.transform(test)


def class_probabilities(predictions: DataFrame, model: PipelineModel) -> DataFrame:
    """``(name, taxon, label, p)`` in long form."""
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    zipped = F.arrays_zip(labels.alias("label"), vector_to_array("probability").alias("p"))
    return predictions.select("name", "taxon", F.explode(zipped).alias("z")).select("name", "taxon", F.col("z.label").alias("label"), F.col("z.p").alias("p"))


def accuracy(predictions: DataFrame) -> float:
    """Share of right predictions."""
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(predictions)


def class_statistics(features: DataFrame) -> DataFrame:
    """Genomes, classes, class balance, and share of 0 cells of a feature table."""
    sizes = features.groupBy("taxon").agg(F.countDistinct("name").alias("n"))
    balance = sizes.agg(F.sum("n").alias("genomes"), F.count(F.lit(1)).alias("classes"), (F.max("n") / F.min("n")).alias("balance"))
    cells = features.agg(F.count_if(F.col("value") == 0).alias("z"), F.count(F.lit(1)).alias("c"), F.count_if(F.col("value").isNull()).alias("m"))
    return balance.crossJoin(F.broadcast(cells)).select("genomes", "classes", "balance", F.try_divide("z", "c").alias("sparsity"), F.try_divide("m", "c").alias("missing"))


def cluster_quality(features: DataFrame, k: int, seed: int = 42) -> float:
    """Silhouette of k-means clusters on the feature matrix."""
    rows, cols = feature_matrix(features)
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(rows)
    return ClusteringEvaluator().evaluate(KMeans(k=k, seed=seed).fit(data).transform(data))


def select_model(features: DataFrame, kinds: tuple[str, ...] = ("forest", "logistic"), seed: int = 42) -> tuple[str, dict[str, float]]:
    """The kind of best held-out accuracy, and all accuracies."""
    scores = {}
    for kind in kinds:
        fitted = train_node(features, kind, seed, trees=50)
        scores[kind] = accuracy(fitted[1]) if fitted else 0.0
    return max(scores, key=lambda x: (scores[x], x)), scores


def cluster_indices(features: DataFrame, k: int, seed: int = 42) -> dict[str, float]:
    """Silhouette, Calinski-Harabasz and Davies-Bouldin indices of k-means clusters on the feature matrix.

    Spreads come from sums per cluster and column; only the k centres, their sizes and spreads reach the driver.
    """
    rows, cols = feature_matrix(features)
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(rows)
    model = KMeans(k=k, seed=seed).fit(data)
    placed = model.transform(data).select("prediction", "features", vector_to_array("features").alias("v"))
    centres = [c.tolist() for c in model.clusterCenters()]
    own = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres]), F.col("prediction") + 1)
    square = F.aggregate(F.zip_with("v", own, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    stats = placed.withColumn("q", square).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"), F.avg(F.sqrt("q")).alias("s")).collect()  # at most k rows
    n = sum(r["n"] for r in stats)
    mean = [sum(centres[r["prediction"]][i] * r["n"] for r in stats) / n for i in range(len(cols))]
    gap = lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))
    within, between, used = sum(r["q"] for r in stats), sum(r["n"] * gap(centres[r["prediction"]], mean) ** 2 for r in stats), len(stats)
    worst = [max(((a["s"] + b["s"]) / d for b in stats if b is not a and (d := gap(centres[a["prediction"]], centres[b["prediction"]])) > 0), default=0.0) for a in stats]
    harabasz = between / (used - 1) / (within / (n - used)) if used > 1 and n > used and within > 0 else 0.0
    return {"silhouette": ClusteringEvaluator().evaluate(model.transform(data)) if used > 1 else 0.0, "calinski_harabasz": harabasz, "davies_bouldin": sum(worst) / used}


def fold_accuracy(features: DataFrame, kind: str, folds: int = 5, seed: int = 42, trees: int = 50) -> float:
    """Mean accuracy of a kind of model over ``folds`` folds, into which the rows of every taxon are dealt by hash order."""
    rows, cols = feature_matrix(features)
    order = W.partitionBy("taxon").orderBy(F.xxhash64(F.lit(seed), "name"), "name")
    rows = rows.withColumn("fold", F.pmod(F.row_number().over(order), F.lit(folds))).cache()
    classes = rows.select("taxon").distinct().count()
    scores = []
    for fold in range(folds):
        test = rows.where(F.col("fold") == fold)
        if not test.isEmpty():
            scores.append(accuracy(node_model(kind, cols, classes, seed, trees).fit(rows.where(F.col("fold") != fold)).transform(test)))
    rows.unpersist()
    return sum(scores) / len(scores) if scores else 0.0


def save_models(models: dict[str, PipelineModel], path: str) -> None:
    """Fitted models of nodes, each in a folder named by the node in file-safe form; existing ones are replaced."""
    for node, model in models.items():
        model.write().overwrite().save(f"{path}/{_safe(node)}")


def load_model(path: str, node: str) -> PipelineModel:
    """The saved model of one node."""
    return PipelineModel.load(f"{path}/{_safe(node)}")


def _safe(node: str) -> str:
    return "".join(c if c.isalnum() or c in "-." else f"_{ord(c):x}_" for c in node)
