"""Clusters of vectors, their labels, and a trainable classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import centroids, cosine, unit


def cluster_posts(posts: DataFrame, *, vector: str, k: int = 8, seed: int = 42) -> DataFrame:
    """Adds cluster, by k-means on unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = posts.withColumn("__v", array_to_vector(unit(vector)))
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(rows.where("__v IS NOT NULL")).transform(rows).drop("__v")


def label_clusters(posts: DataFrame, *, id_col: str, vector: str, cluster: str = "cluster", substance: str, risk: str, n: int = 5) -> DataFrame:
    """(cluster, n, examples, substance, risk): the n ids nearest to the centroid, and the most common substance and
    risk, ties by name."""
    middle = centroids(posts, [cluster], vector)
    near = posts.join(middle, cluster).withColumn("s", F.round(cosine(vector, "centroid"), 9))
    w = Window.partitionBy(cluster).orderBy(F.desc("s"), id_col)
    top = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    examples = top.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", id_col))), lambda x: x[id_col]).alias("examples"))

    def most_common(c: str) -> DataFrame:
        counts = posts.where(F.col(c).isNotNull()).groupBy(cluster, c).agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy(cluster).orderBy(F.desc("n"), c)
        return counts.withColumn("k", F.row_number().over(w)).where("k = 1").select(cluster, c)

    return middle.select(cluster, "n").join(examples, cluster).join(most_common(substance), cluster, "left").join(most_common(risk), cluster, "left")


def train_classifier(posts: DataFrame, *, text: str, label: str, features: int = 1 << 14, max_iter: int = 30):
    """A logistic regression over hashed words: the trainable slot of the vote. Texts of ten characters or fewer and
    unknown labels are left out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer

    rows = posts.where((F.length(F.trim(text)) > 10) & F.col(label).isin("low", "medium", "high"))
    stages = [
        StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="keep"),
        RegexTokenizer(inputCol=text, outputCol="__t", pattern=r"\W+"),
        HashingTF(inputCol="__t", outputCol="__h", numFeatures=features),
        IDF(inputCol="__h", outputCol="__f"),
        LogisticRegression(featuresCol="__f", labelCol="__y", maxIter=max_iter, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(rows)


def run_inference(model, posts: DataFrame, *, id_col: str) -> DataFrame:
    """(id_col, risk_level, confidence)."""
    from pyspark.ml.functions import vector_to_array

    names = F.array(*map(F.lit, [*model.stages[0].labelsArray[0], "low"]))
    out = model.transform(posts).withColumn("__p", vector_to_array("probability"))
    return out.select(id_col, F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("risk_level"), F.round(F.array_max("__p"), 4).alias("confidence"))
