"""Joins and listings over proteins, sequences, embeddings, annotations and prediction sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def with_vectors(entities: DataFrame, embeddings: DataFrame, config_id: int) -> DataFrame:
    """Entities (sequence_id, ...) with their embedding of one configuration; those without drop out."""
    own = embeddings.filter(F.col("config_id") == config_id)
    return entities.join(own, "sequence_id")


def annotated_only(references: DataFrame, annotations: DataFrame) -> DataFrame:
    return references.join(annotations.select("protein").distinct(), references["accession"] == F.col("protein"), "left_semi")


def with_term(facts: DataFrame, terms: DataFrame, *columns: str) -> DataFrame:
    """Facts joined to chosen columns of their term."""
    return facts.join(terms.select("go_id", *columns), "go_id")


def labelled(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """predictions and label: 1 where the pair is true, else 0."""
    known = truth.select("protein", "go_id").distinct().withColumn("_true", F.lit(1))
    return predictions.join(known, ["protein", "go_id"], "left").withColumn("label", F.coalesce("_true", F.lit(0))).drop("_true")


def matching_known(predictions: DataFrame, annotations: DataFrame) -> DataFrame:
    """Predictions whose pair is annotated, by protein: distinct terms."""
    return predictions.join(annotations.select("protein", "go_id").distinct(), ["protein", "go_id"]).groupBy("protein").agg(F.countDistinct("go_id").alias("matched_terms"))


def with_counts(catalog: DataFrame, facts: DataFrame, key: str, output: str) -> DataFrame:
    """The catalog and how many facts each entry has, 0 without any; facts are counted before the join."""
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias(output))
    return catalog.join(counts, key, "left").withColumn(output, F.coalesce(output, F.lit(0)))


def without(df: DataFrame, *users: tuple[DataFrame, str]) -> DataFrame:
    """Rows that none of the (user table, key) pairs refers to."""
    for user, key in users:
        df = df.join(user.select(key).distinct(), key, "left_anti")
    return df


def pending_sequences(sequences: DataFrame, embeddings: DataFrame, config_id: int, wanted: DataFrame | None = None) -> DataFrame:
    done = embeddings.filter(F.col("config_id") == config_id).select("sequence_id")
    left = sequences.join(done, "sequence_id", "left_anti")
    return left if wanted is None else left.join(wanted.select("sequence_id").distinct(), "sequence_id", "left_semi")


def valid_references(annotations: DataFrame, proteins: DataFrame, terms: DataFrame) -> DataFrame:
    """Annotations and whether their protein and their term exist."""
    p, t = proteins.select(F.col("accession").alias("protein")).distinct().withColumn("_p", F.lit(True)), terms.select("go_id").distinct().withColumn("_t", F.lit(True))
    marked = annotations.join(p, "protein", "left").join(t, "go_id", "left")
    return marked.withColumns({"protein_exists": F.col("_p").isNotNull(), "term_exists": F.col("_t").isNotNull()}).drop("_p", "_t")


def sweep(predictions: DataFrame, configs: DataFrame) -> DataFrame:
    """Every prediction under every scoring configuration (a table of a few rows): config, protein, go_id, score.

    Weights are columns w_<signal>; absent signals are left out of the mean.
    """
    from ..functions.scoring import SIGNALS, signals

    found = signals(predictions)
    base = predictions.select("protein", "go_id", "aspect", *[found[s].alias(s) for s in SIGNALS])
    all_ = base.crossJoin(F.broadcast(configs))
    total, weights = F.lit(0.0), F.lit(0.0)
    for s in SIGNALS:
        total = total + F.coalesce(F.col(s) * F.col(f"w_{s}"), F.lit(0.0))
        weights = weights + F.when(F.col(s).isNotNull(), F.col(f"w_{s}")).otherwise(0.0)
    score = F.when(weights == 0, 0.0).otherwise(total / F.nullif(weights, F.lit(0.0)))
    score = F.when(F.col("formula") == "evidence_weighted", score * F.col("evidence_weight")).otherwise(score)
    return all_.select("config", "protein", "go_id", "aspect", F.round(score, 6).alias("score"))


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def search(df: DataFrame, term: str, *columns: str) -> DataFrame:
    return df.filter(scalars.contains_ilike(term, *[F.col(c) for c in columns]))


def latest_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
