"""Label transfer from neighbours, and the features of transferred labels.

Neighbours are (query, rank, ref, distance) and maybe aspect; annotations (protein, go_id, aspect, qualifier, evidence_code).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence

#: Neighbours that may be broadcast.
BROADCAST_ROWS = 100_000
OPTIONAL_DOUBLES = tuple(f"{x}_{m}" for m in ("nw", "sw") for x in ("identity", "similarity", "alignment_score", "gaps_pct", "alignment_length"))
OPTIONAL_INTS = ("length_query", "length_ref", "vote_count", "k_position", "go_term_frequency", "ref_annotation_density", "query_taxonomy_id", "ref_taxonomy_id", "taxonomic_lca", "taxonomic_distance", "taxonomic_common_ancestors")
OPTIONAL_STRINGS = ("qualifier", "evidence_code", "taxonomic_relation")


def hits(neighbours: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row a neighbour and annotation of it; negated annotations are never transferred."""
    keys = ["ref", "aspect"] if "aspect" in neighbours.columns else ["ref"]
    usable = annotations.filter(evidence.not_negated(F.col("qualifier"))).withColumnRenamed("protein", "ref")
    return neighbours.join(usable, keys)


def first_per_term(found: DataFrame) -> DataFrame:
    """The nearest neighbour's row for each (query, term); ties by rank, ref, evidence, qualifier."""
    order = Window.partitionBy("query", "go_id").orderBy("distance", "rank", "ref", F.col("evidence_code").asc_nulls_first(), F.col("qualifier").asc_nulls_first())
    return found.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def predict_terms(neighbours: DataFrame, annotations: DataFrame) -> DataFrame:
    """(protein, go_id, aspect, ref, distance, qualifier, evidence_code)."""
    return first_per_term(hits(neighbours, annotations)).select(F.col("query").alias("protein"), "go_id", "aspect", "ref", "distance", "qualifier", "evidence_code")


def votes(found: DataFrame) -> DataFrame:
    """vote_count (rows: two evidence codes of a neighbour are two votes) and k_position (rank of the first neighbour with the term)."""
    return found.groupBy(F.col("query").alias("protein"), "go_id").agg(F.count(F.lit(1)).alias("vote_count"), F.min("rank").alias("k_position"))


def term_frequency(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("go_id").agg(F.count(F.lit(1)).alias("go_term_frequency"))


def annotation_density(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy(F.col("protein").alias("ref")).agg(F.count(F.lit(1)).alias("ref_annotation_density"))


def distance_std(neighbours: DataFrame) -> DataFrame:
    """Population deviation of a query's neighbour distances; 0 below two of them."""
    return neighbours.groupBy(F.col("query").alias("protein")).agg(F.when(F.count("distance") < 2, 0.0).otherwise(F.stddev_pop("distance")).alias("neighbor_distance_std"))


def reranker_features(neighbours: DataFrame, annotations: DataFrame, proteins: DataFrame | None = None) -> DataFrame:
    """Predictions with vote count, position, frequency, density and spread, all over the full reference; with `proteins` (protein), only theirs.

    What depends on a neighbour or a query is put to the neighbours, which are few beside annotations. So a hit is moved twice: to its term's
    frequency, then to the other hits of its query and term, where the nearest one is taken and votes are counted.
    """
    usable = annotations.filter(evidence.not_negated(F.col("qualifier")))
    near = neighbours.join(annotation_density(usable), "ref").join(distance_std(neighbours).withColumnRenamed("protein", "query"), "query")
    if proteins is not None:
        near = near.join(proteins.select(F.col("protein").alias("query")), "query", "left_semi")
    found = hits(F.broadcast(near) if neighbours.count() <= BROADCAST_ROWS else near, usable).join(term_frequency(usable), "go_id")
    pair = Window.partitionBy("query", "go_id")
    order = pair.orderBy("distance", "rank", "ref", F.col("evidence_code").asc_nulls_first(), F.col("qualifier").asc_nulls_first())
    counted = found.withColumns({"_n": F.row_number().over(order), "vote_count": F.count(F.lit(1)).over(pair), "k_position": F.min("rank").over(pair)}).filter("_n = 1")
    return counted.select(F.col("query").alias("protein"), "ref", "go_id", "aspect", "distance", "qualifier", "evidence_code", "vote_count", "k_position", "go_term_frequency", "ref_annotation_density", "neighbor_distance_std")


def complete_features(predictions: DataFrame) -> DataFrame:
    """The predictions with every optional feature column, null where it wasn't computed."""
    missing = {c: F.lit(None).cast(kind) for names, kind in ((OPTIONAL_DOUBLES + ("neighbor_distance_std",), "double"), (OPTIONAL_INTS, "int"), (OPTIONAL_STRINGS, "string")) for c in names if c not in predictions.columns}
    return predictions.withColumns(missing)
