"""Layer aggregation and chunk pooling of per-residue vectors in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, vectors


def pool_layers(layers: DataFrame, how: str = "mean") -> DataFrame:
    """(sequence_id, embedding) from (sequence_id, layer, vector) with any number of layers: the mean, the shallowest asked for ("last"), or all joined from there ("concat").

    Means are partial sums by dimension and the last is a running choice; only the joined vector, which is the result itself, is gathered by sequence.
    """
    if how == "concat":
        ordered = F.array_sort(F.collect_list(F.struct("layer", "vector")))
        return layers.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda s: s["vector"])).alias("embedding"))
    if how == "last":
        return layers.groupBy("sequence_id").agg(F.min_by("vector", "layer").alias("embedding"))
    if how != "mean":
        raise ValueError(f"unknown aggregation {how}")
    cells = layers.select("sequence_id", F.posexplode("vector").alias("dim", "x")).groupBy("sequence_id", "dim").agg(F.avg("x").alias("x"))
    listed = cells.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("cells"))  # one a dimension
    return listed.select("sequence_id", F.transform("cells", lambda c: c["x"]).alias("embedding"))


def pool_chunks(residues: DataFrame, how: str = "mean", size: int = 512, overlap: int = 0, normalize: bool = False) -> DataFrame:
    """(sequence_id, chunk_start, chunk_end, embedding) from (sequence_id, position, vector), positions from 0.

    `cls` takes position 0 and makes one chunk. Values are pooled by (chunk, dimension) with partial aggregation.
    """
    lengths = residues.groupBy("sequence_id").agg((F.max("position") + 1).cast("int").alias("length"))
    if how == "cls":
        out = residues.filter("position = 0").join(lengths, "sequence_id").select("sequence_id", F.lit(0).alias("chunk_start"), F.col("length").alias("chunk_end"), F.col("vector").alias("embedding"))
    else:
        spans = lengths.select("sequence_id", F.explode(scalars.chunk_spans(F.col("length"), size, overlap)).alias("s")).select("sequence_id", "s.start", "s.end")
        cells = residues.join(spans, "sequence_id").filter("position >= start and position < end").select("sequence_id", "start", "end", F.posexplode("vector").alias("dim", "x"))
        pooled = cells.groupBy("sequence_id", "start", "end", "dim").agg(F.avg("x").alias("mean"), F.max("x").alias("max"))
        listed = pooled.groupBy("sequence_id", "start", "end").agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "max"))).alias("cells"))
        mean, largest = F.transform("cells", lambda c: c["mean"]), F.transform("cells", lambda c: c["max"])
        value = {"mean": mean, "max": largest, "mean_max": F.concat(mean, largest)}[how]
        out = listed.select("sequence_id", F.col("start").alias("chunk_start"), F.col("end").alias("chunk_end"), value.alias("embedding"))
    return out.withColumn("embedding", vectors.l2_normalize(F.col("embedding"))) if normalize else out
