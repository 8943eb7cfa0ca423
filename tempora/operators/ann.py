"""An inverted-file index for vector search: lists around centroids, written once, partitioned by list.

The centroids are fitted on at most SAMPLE vectors, chosen by a hash of their ids; every row is indexed. A query reads the
lists of its `probes` nearest centroids only and ranks their rows exactly, so its cost grows with the rows of these lists
and not with the table. The exact scan of retrieval.vector_top_k stays the reference; recall is measured against it.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import Files
from .retrieval import vector_top_k

SAMPLE = 100_000


def _unit(vector: str) -> Column:
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


@dataclass
class VectorIndex:
    spark: SparkSession
    root: str
    centroids: list[list[float]]

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def nearest_lists(self, query: list[float], probes: int) -> list[int]:
        norm = math.sqrt(sum(x * x for x in query)) or 1.0
        near = sorted(range(len(self.centroids)), key=lambda i: (-sum(a * b for a, b in zip(self.centroids[i], query)) / norm / (math.sqrt(sum(x * x for x in self.centroids[i])) or 1.0), i))
        return near[:probes]

    def search(self, query: list[float], k: int, probes: int = 8, tie: str = "id") -> DataFrame:
        """The k nearest rows of the probed lists: the columns of the rows and score, the cosine distance."""
        part = self.rows.where(F.col("list").isin(self.nearest_lists(query, probes)))
        return vector_top_k(part, query, k, tie=tie).drop("list")


def build(rows: DataFrame, root: str, lists: int | None = None, vector: str = "embedding", seed: int = 1) -> VectorIndex:
    """Index rows (id, a vector, and whatever else). The manifest is written last."""
    spark = rows.sparkSession
    usable = rows.where(F.col(vector).isNotNull())
    n = usable.count()
    if not n:
        raise ValueError("an index needs a vector")
    share = min(1.0, SAMPLE / n)
    sample = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(SAMPLE)
    k = max(2, lists or int(math.sqrt(n)))
    # a fixed order, so that the same vectors give the same centroids
    fit = sample.select("id", array_to_vector(_unit(vector)).alias("features")).orderBy("id")
    model = KMeans(k=k, seed=seed, maxIter=15).fit(fit)
    centroids = [[float(x) for x in c] for c in model.clusterCenters()]
    data = f"{root}/data-{uuid.uuid4().hex}"
    dealt = model.transform(usable.withColumn("features", array_to_vector(_unit(vector)))).withColumnRenamed("prediction", "list").drop("features")
    # a list may be large: its rows are spread over several files
    dealt.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("list").parquet(f"{data}/rows")
    Files(spark, root).publish("index.json", json.dumps({"data": data.rsplit("/", 1)[1], "centroids": centroids}))
    return open_index(spark, root)


def open_index(spark: SparkSession, root: str) -> VectorIndex:
    files = Files(spark, root)
    if not files.exists("index.json"):
        raise FileNotFoundError(root)
    m = json.loads(files.read("index.json"))
    return VectorIndex(spark, f"{root}/{m['data']}", m["centroids"])
