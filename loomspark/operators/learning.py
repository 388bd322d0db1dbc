"""Uncertainty model, ranking, hashed text vectors and density clusters."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .density import density_clusters, density_labels
from .nearest import core_distance  # noqa: F401  part of this module's interface


def train_uncertainty(training: DataFrame):
    """A weighted logistic model of (features: array, y, weight); None under two rows or one class."""
    s = training.agg(F.count(F.lit(1)), F.countDistinct("y"), F.sum("weight")).first()
    if s[0] < 2 or s[1] < 2:
        return None
    data = training.select(array_to_vector(F.transform("features", lambda x: x.cast("double"))).alias("features"), F.col("y").cast("double").alias("label"), "weight")
    return LogisticRegression(regParam=1.0 / s[2], elasticNetParam=0.0, standardization=False, weightCol="weight", maxIter=1000).fit(data)


def rank_uncertain(model, vectors: DataFrame, exclude: DataFrame) -> DataFrame:
    """(id, p) by ascending |p - 0.5|, without the excluded ids."""
    left = vectors.join(exclude, "id", "left_anti").withColumn("features", array_to_vector(F.transform("features", lambda x: x.cast("double"))))
    return model.transform(left).select("id", vector_to_array("probability")[1].alias("p")).orderBy(F.abs(F.col("p") - 0.5), "id")


def hashed_vectors(texts: DataFrame, dims: int = 256) -> DataFrame:
    """(id, vector): the default encoder, l2-normed hashed term counts of (id, text)."""
    out = Normalizer(inputCol="tf", outputCol="v").transform(HashingTF(numFeatures=dims, inputCol="w", outputCol="tf").transform(Tokenizer(inputCol="text", outputCol="w").transform(texts)))
    return out.select("id", vector_to_array("v").alias("vector"))


def reduced(vectors: DataFrame, dims: int) -> DataFrame:
    """(id, features) on the first principal components, at most one less than the rows and dimensions."""
    n = vectors.limit(dims + 2).count()
    wide = vectors.select(F.size("features")).limit(1).collect()
    keep = min(dims, max(n - 2, 1), wide[0][0] if wide else dims)
    if n < 2:
        return vectors.select("id", F.transform("features", lambda x: x.cast("double")).alias("features"))
    data = vectors.select("id", array_to_vector(F.transform("features", lambda x: x.cast("double"))).alias("x"))
    return PCA(k=keep, inputCol="x", outputCol="y").fit(data).transform(data).select("id", vector_to_array("y").alias("features"))


def cluster_map(vectors: DataFrame, dims: int = 8, min_size: int = 30, second: int = 15, most: float = 0.05) -> DataFrame:
    """(id, cluster_id, x, y): density clusters over the reduced vectors, and a place on a plane for each.

    An empty table gives no rows; a single row lies at its first two values (0 where it has none)."""
    clusters = density_clusters(materialize(reduced(vectors, dims), "reduced"), min_size, second, most)
    value = lambda i: F.coalesce(F.get("features", F.lit(i)), F.lit(0.0))
    return clusters.join(reduced(vectors, 2).select("id", value(0).alias("x"), value(1).alias("y")), "id")


def missing(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """The texts whose id has no vector yet."""
    return texts.join(stored.select("id"), "id", "left_anti")


#: Encoders of (id, text) to (id, vector) by name; a caller may add its own.
ENCODERS: dict = {}


def encode(texts: DataFrame, stored: DataFrame, encoder: str = "hashing", limit: int | None = None) -> DataFrame:
    """(id, vector) by a registered encoder for the texts that have none, ``limit`` of them by id at most."""
    left = missing(texts, stored)
    return ENCODERS[encoder](left.orderBy("id").limit(limit) if limit is not None else left)


def recluster(x: np.ndarray, ids: np.ndarray, min_size: int, most: float) -> np.ndarray:
    """New clusters among outliers, numbered after the old ones; too large ones stay outliers."""
    out, lone = ids.copy(), np.flatnonzero(ids == -1)
    if len(lone) < min_size:
        return out
    sub = density_labels(x[lone], min_size)
    top = ids.max(initial=-1) + 1
    for c in [c for c in np.unique(sub[sub >= 0]) if (sub == c).sum() <= most * len(ids)]:
        out[lone[sub == c]] = top
        top += 1
    return out


ENCODERS["hashing"] = hashed_vectors
