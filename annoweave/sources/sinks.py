"""Exports: the rows and columns of each file, and the writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scoring import ScoringConfig, score
from ..operators.transfer import OPTIONAL_DOUBLES, complete_features

# Columns of the prediction export, in order.
PREDICTION_COLUMNS = (
    "protein", "go_id", "go_name", "aspect", "distance", "ref", "qualifier", "evidence_code",
    "identity_nw", "similarity_nw", "alignment_score_nw", "gaps_pct_nw", "alignment_length_nw", "identity_sw", "similarity_sw", "alignment_score_sw", "gaps_pct_sw", "alignment_length_sw",
    "length_query", "length_ref", "query_taxonomy_id", "ref_taxonomy_id", "taxonomic_lca", "taxonomic_distance", "taxonomic_common_ancestors", "taxonomic_relation",
    "vote_count", "k_position", "go_term_frequency", "ref_annotation_density", "neighbor_distance_std",
)


def significant(c: Column, digits: int = 6) -> Column:
    """A number with so many significant digits and no trailing zeros, in plain notation from 1e-5 up to 1e6."""
    places = F.greatest(F.lit(0), digits - 1 - F.floor(F.log10(F.abs(c)))).cast("int")
    rounded = F.when(c == 0, F.lit("0")).otherwise(F.format_string(f"%.{digits + 5}f", F.floor(c * F.pow(F.lit(10.0), places) + 0.5) / F.pow(F.lit(10.0), places)))
    return F.when(c.isNotNull(), F.regexp_replace(F.regexp_replace(rounded, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def prediction_rows(predictions: DataFrame, terms: DataFrame, accession: str | None = None, aspect: str | None = None, max_distance: float | None = None) -> DataFrame:
    """All columns of the export as typed values, in order of protein and distance."""
    own = predictions.drop("aspect").join(terms.select("go_id", F.col("name").alias("go_name"), "aspect"), "go_id")
    for given, test in ((accession, F.col("protein") == accession), (aspect, F.col("aspect") == aspect), (max_distance, F.col("distance") <= F.lit(max_distance))):
        own = own if given is None else own.filter(test)
    return complete_features(own).select(*PREDICTION_COLUMNS).orderBy("protein", "distance", "go_id")


def cafa_rows(predictions: DataFrame, proteins: DataFrame | None = None, aspect: str | None = None) -> DataFrame:
    """(protein, go_id, score) with score max(0, 1 - least distance), 4 decimals."""
    own = predictions if aspect is None else predictions.filter(F.col("aspect") == aspect)
    own = own if proteins is None else own.join(proteins.select("protein").distinct(), "protein", "left_semi")
    best = own.groupBy("protein", "go_id").agg(F.min("distance").alias("d"))
    return best.select("protein", "go_id", F.round(scalars.distance_score(F.col("d"), "full"), 4).alias("score"))


def scored_rows(predictions: DataFrame, config: ScoringConfig, min_score: float | None = None, accession: str | None = None) -> DataFrame:
    own = predictions if accession is None else predictions.filter(F.col("protein") == accession)
    scored = own.withColumn("score", score(own, config)).select("protein", "go_id", "aspect", "score")
    return scored if min_score is None else scored.filter(F.col("score") >= min_score)


def truth_rows(truth: DataFrame, category: str) -> DataFrame:
    return truth.filter(F.col("category") == category).select("protein", "go_id").distinct().orderBy("protein", "go_id")


def delta_fasta(truth: DataFrame, proteins: DataFrame, categories: tuple[str, ...] = ("NK", "LK", "PK")) -> DataFrame:
    """(accession, record) of proteins (accession, entry_name, organism, taxonomy_id, sequence) with new terms; NK before LK before PK. A null sequence is an empty one."""
    rank = F.when(F.col("category") == "NK", 0).when(F.col("category") == "LK", 1).otherwise(2)
    label = truth.filter(F.col("category").isin(*categories)).groupBy(F.col("protein").alias("accession")).agg(F.min_by("category", rank).alias("label"))
    head = F.concat_ws(" ", F.concat(F.lit(">"), "accession"), F.nullif("entry_name", F.lit("")), F.concat(F.lit("OS="), F.nullif("organism", F.lit(""))), F.concat(F.lit("OX="), F.nullif(F.col("taxonomy_id").cast("string"), F.lit(""))), F.concat(F.lit("("), "label", F.lit(")")))
    return proteins.join(label, "accession").select("accession", F.concat(head, F.lit("\n"), F.regexp_replace(F.coalesce("sequence", F.lit("")), "(.{60})(?=.)", "$1\n")).alias("record"))


CATEGORY_ORDER = ("NK", "LK", "PK")
ASPECT_ORDER = ("P", "F", "C")


def metric_rows(results: DataFrame) -> DataFrame:
    """Metrics by category and aspect in their fixed order; cells without a result don't appear."""
    category, aspect = F.array_position(F.array(*map(F.lit, CATEGORY_ORDER)), F.col("category")), F.array_position(F.array(*map(F.lit, ASPECT_ORDER)), F.col("aspect"))
    return results.filter("fmax is not null").orderBy(category, aspect)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, sep="\t", header=header, nullValue="", emptyValue="", quote="")


def write_fasta(records: DataFrame, path: str) -> None:
    """FASTA files of (accession, record), in order of accession."""
    records.orderBy("accession").select("record").write.text(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """The prediction export: optional numbers with six significant digits, nulls blank."""
    write_tsv(rows.withColumns({c: significant(F.col(c)) for c in (*OPTIONAL_DOUBLES, "neighbor_distance_std")}), path)


def write_splits(rows: DataFrame, path: str) -> None:
    """Labelled rows by category and split, to be read back one by one or together."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("category", "split").parquet(path)
