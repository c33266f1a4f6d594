"""Embeddings: centroids, cosine similarity to references, k-means with a choice of k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """(key, i, mean): mean of each coordinate. Long form, so the aggregation is partial before its shuffle."""
    return vectors.select(key, F.posexplode("embedding").alias("i", "v")).groupBy(key, "i").agg(F.avg(F.col("v").cast("double")).alias("mean"))


FEW_REFERENCES = 10_000


def nearest_reference(vectors: DataFrame, key: str, few: int = FEW_REFERENCES) -> DataFrame:
    """(vec_id, nearest, similarity, confidence): the key whose centroid is most alike, similarity clamped to [0.4, 0.9].

    Up to few references travel to the vectors as one checked, broadcast row. More are cut into parts of that size, and
    the best of each part is kept, so that no task holds all references. Ties go to the smaller key.
    """
    refs = centroids(vectors, key).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda x: x["mean"]).alias("ref"))
    refs = refs.withColumnRenamed(key, "nearest")
    parts = -(-max(1, refs.count()) // few)
    one = refs.groupBy(F.pmod(F.xxhash64("nearest"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("nearest", "ref")).alias("refs"))
    side = F.broadcast(one) if parts == 1 else one
    s = vectors.crossJoin(side).select("vec_id", F.transform("refs", lambda r: F.struct(F.round(cosine(F.col("embedding"), r["ref"]), 9).alias("s"), (-r["nearest"]).alias("minus"))).alias("all"))  # a stated set of references, in blocks
    best = s.select("vec_id", F.array_max("all").alias("b"))
    if parts > 1:
        best = best.groupBy("vec_id").agg(F.max("b").alias("b"))
    return best.select("vec_id", (-F.col("b.minus")).alias("nearest"), F.round("b.s", 6).alias("similarity"), F.when(F.col("b.s") > 0.3, F.round(F.greatest(F.lit(0.4), F.least(F.lit(0.9), F.col("b.s"))), 6)).otherwise(0.4).alias("confidence"))


def clusters(vectors: DataFrame, k_min: int = 2, k_max: int = 8, seed: int = 42) -> DataFrame:
    """(vec_id, cluster, k): k-means for the k of best silhouette, k at most half the vectors; null or empty vectors give no row.

    Fewer than four vectors are one cluster. The vectors are read once and kept for the fits.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = vectors.filter("embedding is not null and size(embedding) > 0").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).persist()
    n = data.count()
    best = None
    for k in range(k_min, min(k_max, n // 2) + 1):
        out = KMeans(k=k, seed=seed, maxIter=10).fit(data).transform(data)
        score = ClusteringEvaluator().evaluate(out)
        if best is None or score > best[0]:
            best = (score, k, out)
    if best is None:
        return data.select("vec_id", F.lit(0).cast("bigint").alias("cluster"), F.lit(1).cast("bigint").alias("k"))
    return best[2].select("vec_id", F.col("prediction").cast("bigint").alias("cluster"), F.lit(best[1]).cast("bigint").alias("k"))


# Words of a cluster's names and texts that tell its category, first match first.
CLUSTER_WORDS = (
    ("invoices", ("invoice", "bill", "payment", "$")),
    ("contracts", ("contract", "agreement", "terms")),
    ("reports", ("report", "analysis", "summary")),
    ("correspondence", ("email", "letter", "correspondence")),
)


def cluster_categories(docs: DataFrame, key: str) -> DataFrame:
    """(cluster, category, confidence) from the words in any name or text of a cluster; the fallback without references.

    Whether a word occurs is aggregated, not the texts, so a cluster of any size is one small row.
    """
    low = F.lower(F.concat_ws(" ", "file_name", "content"))
    has = [F.max(sum((F.contains(F.col("low"), F.lit(w)).cast("int") for w in words), F.lit(0))).alias(c) for c, words in CLUSTER_WORDS]
    t = docs.select(F.col(key).alias("cluster"), low.alias("low")).groupBy("cluster").agg(*has)
    category = F.lit("other")
    for c, _ in reversed(CLUSTER_WORDS):
        category = F.when(F.col(c) > 0, c).otherwise(category)
    return t.select("cluster", category.alias("category"), F.when(category == "other", 0.4).otherwise(0.6).alias("confidence"))
