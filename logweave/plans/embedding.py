"""Template vectors, their reduction and clustering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import WILDCARD, tokenize
from logweave.operators.density import density_clusters
from logweave.session import materialize

FEATURES = 256  # directions of the random projection; the covariance of so many columns is one small matrix
AXES = 15


def embed_templates(templates: DataFrame, features: int = FEATURES) -> DataFrame:
    """``(id, vector)``: unit TF-IDF vectors of the constant tokens of each template, projected at random.

    Every token is a dimension of its own. It has a sign in each of ``features`` directions, fixed by a hash of token
    and direction, so that products of vectors survive the projection up to a few hundredths.
    """
    ids = templates.select(F.col("template_id").alias("id"), tokenize(F.col("Template")).alias("words"))
    used = F.filter("words", lambda t: (t != WILDCARD) & (t != ""))
    counts = ids.select("id", F.explode(used).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    holders = counts.groupBy("token").agg(F.count("*").alias("df"))
    rows = ids.agg(F.count("*").alias("rows"))  # one row
    weight = F.col("tf") * F.log((F.col("rows") + 1) / (F.col("df") + 1))
    weighed = counts.join(holders, "token").join(F.broadcast(rows)).select("id", F.struct("token", weight.alias("weight")).alias("t"))
    held = weighed.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("held"), F.sqrt(F.sum(F.col("t.weight") ** 2)).alias("norm"))

    def along(direction):
        sign = lambda t: F.when(F.pmod(F.xxhash64(t["token"], direction), F.lit(2)) == 0, t["weight"]).otherwise(-t["weight"])
        total = F.aggregate("held", F.lit(0.0), lambda s, t: s + sign(t)) / (F.col("norm") * features**0.5)
        return F.when(F.col("norm") > 0, total).otherwise(0.0)

    return ids.join(held, "id", "left").select("id", F.transform(F.sequence(F.lit(0), F.lit(features - 1)), along).alias("vector"))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Scale vectors to length one, so that Euclidean distance orders like cosine distance."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scaled = F.transform("vector", lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))
    return vectors.select("id", scaled.alias("vector"))


def principal_axes(vectors: DataFrame, axes: int) -> DataFrame:
    """``(id, vector)`` on its first principal axes; never more than the input has rows - 2 or columns."""
    shape = vectors.agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("columns")).first()
    axes = max(1, min(axes, shape["rows"] - 2, shape["columns"] or 1))
    features = vectors.select("id", array_to_vector("vector").alias("features"))
    model = PCA(k=axes, inputCol="features", outputCol="reduced").fit(features)
    return model.transform(features).select("id", vector_to_array("reduced").alias("vector"))


def cluster_vectors(vectors: DataFrame, eps: float = 0.5, min_points: int = 5, axes: int = AXES) -> DataFrame:
    """``(id, vector)`` to ``(id, x, y, cluster)``: place on a plane and density cluster, noise -1.

    The plane is the first two of the axes used for clustering.
    """
    reduced = materialize(principal_axes(unit_vectors(vectors), axes))
    plane = reduced.select(
        "id", F.get("vector", F.lit(0)).alias("x"), F.coalesce(F.get("vector", F.lit(1)), F.lit(0.0)).alias("y")
    )
    return plane.join(density_clusters(reduced, eps, min_points), "id")


def cluster_templates(
    templates: DataFrame, eps: float = 0.5, min_points: int = 5, embed: Callable[[DataFrame], DataFrame] = embed_templates
) -> DataFrame:
    """``embed`` turns the template table into ``(id, vector)``; any model of that shape can stand in."""
    return cluster_vectors(embed(templates), eps, min_points).withColumnRenamed("id", "template_id")
