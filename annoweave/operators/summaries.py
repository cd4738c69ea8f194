"""Counts, listings and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def protein_stats(proteins: DataFrame, annotations: DataFrame, embedded: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row: totals; a null `reviewed` counts as unreviewed. Metadata belong to canonical accessions, all proteins of one have them."""
    base = proteins.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_canonical").alias("canonical"), F.count_if(F.coalesce("reviewed", F.lit(False))).alias("reviewed"), F.countDistinct("canonical_accession").alias("families")
    )
    annotated = annotations.join(proteins.select(F.col("accession").alias("protein")), "protein", "left_semi").agg(F.countDistinct("protein").alias("with_annotation"))
    vectors = embedded.agg(F.countDistinct("accession").alias("with_embedding"))
    described = proteins.join(metadata.select("canonical_accession"), "canonical_accession", "left_semi").agg(F.countDistinct("accession").alias("with_metadata"))
    out = base.crossJoin(annotated).crossJoin(vectors).crossJoin(described)  # one row each
    return out.withColumns({"isoforms": F.col("total") - F.col("canonical"), "unreviewed": F.col("total") - F.col("reviewed")})


def prediction_proteins(predictions: DataFrame, annotations: DataFrame, proteins: DataFrame) -> DataFrame:
    """Per predicted protein: predictions, least distance, annotations, distinct matched terms, whether it is in the database."""
    base = predictions.groupBy("protein").agg(F.count(F.lit(1)).alias("n_predictions"), F.round(F.min("distance"), 6).alias("min_distance"))
    own = annotations.groupBy("protein").agg(F.count(F.lit(1)).alias("n_annotations"))
    matched = predictions.select("protein", "go_id").join(annotations.select("protein", "go_id").distinct(), ["protein", "go_id"]).groupBy("protein").agg(F.countDistinct("go_id").alias("n_matched"))
    known = proteins.select(F.col("accession").alias("protein")).distinct().withColumn("in_db", F.lit(True))
    joined = base.join(own, "protein", "left").join(matched, "protein", "left").join(known, "protein", "left")
    return joined.na.fill({"n_annotations": 0, "n_matched": 0, "in_db": False})


def term_distribution(predictions: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent terms with their share of their aspect (null aspect: other)."""
    named = predictions.withColumn("aspect", F.coalesce("aspect", F.lit("other")))
    by_term = named.groupBy("go_id", "aspect").agg(F.count(F.lit(1)).alias("n"))
    by_aspect = by_term.groupBy("aspect").agg(F.sum("n").alias("aspect_total"))
    return by_term.orderBy(F.desc("n"), "go_id").limit(top).join(by_aspect, "aspect").select("go_id", "aspect", "n", "aspect_total")


def min_distance(predictions: DataFrame, cap: float | None = None) -> DataFrame:
    own = predictions if cap is None else predictions.filter(F.col("distance") <= cap)
    return own.groupBy("protein", "go_id").agg(F.round(F.min("distance"), 6).alias("min_distance"))


def best_results(results: DataFrame, *keys: str) -> DataFrame:
    """The result with the greatest Fmax per group; ties keep the first run."""
    best = results.groupBy(*keys).agg(F.max_by(F.struct("run", "method", "fmax"), F.struct("fmax", -F.col("run"))).alias("b"))
    return best.select(*keys, "b.run", "b.method", "b.fmax")


def fmax_by(results: DataFrame, *keys: str) -> DataFrame:
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fmax"), 6).alias("avg_fmax"), F.max("fmax").alias("best_fmax"), F.min("fmax").alias("worst_fmax"))


def pair_overlap(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """How many true pairs a tool also names, and the share in percent."""
    named = predicted.select("protein", "go_id").distinct().withColumn("hit", F.lit(1))
    joined = truth.select("protein", "go_id").distinct().join(named, ["protein", "go_id"], "left")
    return joined.agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("matches"), F.round(100 * F.avg(F.coalesce("hit", F.lit(0))), 4).alias("percent"))


def protein_detail(proteins: DataFrame, annotations: DataFrame, metadata: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Canonical proteins with their own and their metadata columns, counts of annotations and embeddings, and isoforms in order of index."""
    counts = annotations.groupBy(F.col("protein").alias("accession")).agg(F.count(F.lit(1)).alias("n_annotations"))
    vectors = embeddings.groupBy("accession").agg(F.count(F.lit(1)).alias("n_embeddings"))
    isoforms = proteins.filter("not is_canonical").groupBy(F.col("canonical_accession").alias("accession")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("isoform_index", F.col("accession").alias("a")))), lambda s: s["a"]), ",").alias("isoforms"))
    joined = proteins.filter("is_canonical").join(metadata, "canonical_accession", "left").join(counts, "accession", "left").join(vectors, "accession", "left").join(isoforms, "accession", "left")
    return joined.drop("canonical_accession", "is_canonical", "isoform_index").na.fill({"n_annotations": 0, "n_embeddings": 0, "isoforms": ""})
