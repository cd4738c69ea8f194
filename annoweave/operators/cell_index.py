"""An index of vectors that is kept: k-means centroids and the vectors of each cell, in files.

`build` fits the centroids on a bounded sample and writes all references under their cells. `add` places more of them in the cells there are, without
fitting again, under a batch that replaces itself when it is run again. Files hold ranges of cells, so a search skips those that no query probes. A reference
that is added twice counts once, at its nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from . import knn


class CellIndex:
    """Cosine search over the cells below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()  # as many as the square root of the references
        self.centroids = np.array([r["centroid"] for r in rows])

    @classmethod
    def build(cls, references: DataFrame, path: str, cells: int | None = None, seed: int = 42) -> CellIndex:
        """Fits on about `knn.FIT_ROWS` references at most, chosen by hash, and writes them all."""
        own = references.select("id", "vector").filter("vector is not null")
        n = own.count()
        cells = cells or max(2, math.isqrt(n))
        unit = vectors.l2_normalize(F.col("vector").cast("array<double>"))
        sample = knn.fit_rows(own, n).select(array_to_vector(unit).alias("features"))
        centres = KMeans(k=cells, seed=seed, maxIter=10).fit(sample).clusterCenters()
        own.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
        index = cls(own.sparkSession, path)
        index.add(own, "built")
        return index

    def _placed(self, df: DataFrame, side: str, most: int) -> DataFrame:
        """Vectors under the `most` cells that lie nearest to them."""
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = knn.matrix_of(pa.chunked_array([b.column(1)])).astype(np.float64)
                    x = x / (np.linalg.norm(x, axis=1)[:, None] + vectors.EPSILON)
                    near = np.argsort(knn.distances(x, centroids, "l2"), axis=1, kind="stable")[:, :most]
                    take = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([*[b.column(i).take(take) for i in (0, 1)], pa.array(near.ravel().astype(np.int64))], [f"{side}_id", f"{side}_vector", "_bucket"])

        return knn.as_rows(df.select("id", "vector"), side).mapInArrow(run, f"{side}_id {df.schema['id'].dataType.simpleString()}, {side}_vector array<float>, _bucket long")

    def add(self, references: DataFrame, batch: str) -> None:
        """Files by ranges of cells, in order of cells: as many as the shuffle has partitions, however many cells there are."""
        placed = self._placed(references, "r", 1).withColumnRenamed("_bucket", "cell").withColumn("batch", F.lit(batch))
        placed = placed.repartitionByRange("cell").sortWithinPartitions("cell")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/vectors")

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
        """(query, rank, ref, distance) among the cells that a query probes, all of them unless given. With all of them no query is placed: it meets every vector once."""
        if probes is None or probes >= len(self.centroids):
            return knn.knn_exact(queries, self.vectors().select(F.col("r_id").alias("id"), F.col("r_vector").alias("vector")), k)
        q = knn.checkpointed(self._placed(queries, "q", probes))
        probed = q.select(F.col("_bucket").alias("cell")).distinct()
        low, high = q.agg(F.min("_bucket"), F.max("_bucket")).first()
        r = self.vectors().filter(F.col("cell").between(low, high)).join(F.broadcast(probed), "cell", "left_semi").select("r_id", "r_vector", F.col("cell").alias("_bucket"))
        return knn.top_k(knn.bucket_search(q, r, k, "cosine", max(1, r.count())), k)
