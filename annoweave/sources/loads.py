"""Annotation files as rows of the annotation table: known proteins and terms, one row a key.

Rows are (protein, go_id, evidence_code, qualifier, assigned_by, db_reference, with_from, annotation_date). Of lines with one key
(protein, go_id, evidence_code, null codes equal) the first by place stays, whole; with a table that is there already, its keys stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.maintenance import first_occurrence, insert_ignore

KEY = ("protein", "go_id", "evidence_code")
REST = ("qualifier", "assigned_by", "db_reference", "with_from", "annotation_date")
# QuickGO's names of the columns.
QUICKGO_COLUMNS = {"protein": "GENE PRODUCT ID", "go_id": "GO TERM", "evidence_code": "ECO ID", "qualifier": "QUALIFIER", "assigned_by": "ASSIGNED BY", "db_reference": "REFERENCE", "with_from": "WITH/FROM", "annotation_date": "DATE"}


def _loaded(rows: DataFrame, accessions: DataFrame, terms: DataFrame, existing: DataFrame | None) -> DataFrame:
    known = rows.join(accessions.distinct(), "protein", "left_semi").join(terms.select("go_id").distinct(), "go_id", "left_semi")
    if existing is None:
        return first_occurrence(known, list(KEY), ["place"]).select(*KEY, *REST)
    return insert_ignore(existing.select(*KEY, *REST).withColumn("place", F.lit(None).cast(known.schema["place"].dataType)), known.select(*KEY, *REST, "place"), list(KEY), order=["place"]).drop("place")


def load_gaf(rows: DataFrame, proteins: DataFrame, terms: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows of `read_gaf` with places: proteins are named by canonical accessions, evidence codes stay as they are."""
    return _loaded(rows, proteins.select(F.col("canonical_accession").alias("protein")), terms, existing)


def load_quickgo(rows: DataFrame, proteins: DataFrame, terms: DataFrame, eco: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Rows of `read_quickgo` with places: proteins are named by their own accessions, isoforms too; ECO ids become codes (eco_id, code) where the map has one. Columns that a file lacks are null."""
    own = rows.select("place", *[(F.col(f"`{title}`") if title in rows.columns else F.lit(None).cast("string")).alias(name) for name, title in QUICKGO_COLUMNS.items()])
    if eco is not None:
        own = own.join(eco.select(F.col("eco_id").alias("evidence_code"), F.col("code").alias("_code")), "evidence_code", "left").withColumn("evidence_code", F.coalesce("_code", "evidence_code")).drop("_code")
    return _loaded(own, proteins.select(F.col("accession").alias("protein")), terms, existing)
