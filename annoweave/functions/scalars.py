"""Scalar expressions of proteins, sequences and predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISOFORM = r"^(.*)-(\d+)$"


def isoform(accession: Column) -> tuple[Column, Column, Column]:
    """(canonical accession, is canonical, isoform index): X-<digits> at the last hyphen is an isoform of X."""
    found = accession.rlike(ISOFORM)
    return (
        F.when(found, F.regexp_extract(accession, ISOFORM, 1)).otherwise(accession),
        ~found,
        F.when(found, F.regexp_extract(accession, ISOFORM, 2).try_cast("int")),
    )


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def tolerant_int(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def distance_score(distance: Column, mode: str = "half") -> Column:
    """1 - d/2 ("half") or 1 - d ("full"), not below 0."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - (distance / 2 if mode == "half" else distance))


def clean_residues(sequence: Column, longest: int | None = None) -> Column:
    """Rare residues as X, truncated, a space between residues."""
    own = F.regexp_replace(sequence, "[UZOB]", "X")
    own = F.substring(own, 1, longest) if longest else own
    return F.regexp_replace(own, "(.)(?=.)", "$1 ")


def chunk_spans(length: Column, size: int, overlap: int = 0) -> Column:
    """array<struct<start, end>> of windows of `size` that share `overlap`, the last one cut."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk")
    starts = F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, length).alias("end")))


def method_label(reranker: Column, scoring: Column) -> Column:
    return F.when(reranker.isNotNull(), "reranker").when(scoring.isNotNull(), "scored").otherwise("baseline")


def contains_ilike(term: str, *columns: Column) -> Column:
    """Case-insensitive substring in any of the columns; at most 100 characters, no wildcards."""
    own = F.lit(term[:100].lower())
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), own), F.lit(False))
    return found


def fasta_header(header: Column) -> dict[str, Column]:
    """Fields of a UniProt FASTA header (without its >)."""

    def field(pattern: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(header, pattern, 1)), F.lit(""))

    first = F.split(header, r"\s+").getItem(0)
    parts = F.split(first, r"\|")
    piped = F.size(parts) >= 3
    return {
        "accession": F.when(piped, F.get(parts, F.lit(1))).otherwise(first),
        "entry_name": F.when(piped, F.get(parts, F.lit(2))),
        "reviewed": F.startswith(header, F.lit("sp|")),
        "organism": field(r"OS=(.+?)(?:\s[A-Z]{2}=|$)"),
        "taxonomy_id": field(r"OX=(\d+)"),
        "gene_name": field(r"GN=(\S+)"),
    }
