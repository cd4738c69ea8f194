r"""Readers: every format is read as records split in parallel by Spark's text source, then taken apart by column expressions.

Multi-line records use the source's own record separator: FASTA splits at "\n>", OBO at "\n[".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

# Ontology relations and namespaces, columns of formats.
RELATIONS = ("part_of", "regulates", "positively_regulates", "negatively_regulates", "occurs_in", "capable_of", "capable_of_part_of")
NAMESPACES = {"biological_process": "P", "molecular_function": "F", "cellular_component": "C"}
GAF_COLUMNS = {"protein": 1, "qualifier": 3, "go_id": 4, "db_reference": 5, "evidence_code": 6, "with_from": 7, "annotation_date": 13, "assigned_by": 14}
METADATA_COLUMNS = {
    "absorption": "Absorption", "active_site": "Active site", "binding_site": "Binding site", "catalytic_activity": "Catalytic activity", "cofactor": "Cofactor", "dna_binding": "DNA binding",
    "ec_number": "EC number", "activity_regulation": "Activity regulation", "function_cc": "Function [CC]", "pathway": "Pathway", "kinetics": "Kinetics", "ph_dependence": "pH dependence",
    "redox_potential": "Redox potential", "rhea_id": "Rhea ID", "site": "Site", "temperature_dependence": "Temperature dependence", "keywords": "Keywords", "features": "Features",
}


def _fields(line: Column | str = "value") -> Column:
    return F.split(F.col(line) if isinstance(line, str) else line, "\t")


def _place() -> Column:
    """Where a line of a text source stands: file, beginning of the split, and the order within it. Places compare as lines follow one another, files by name."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(~F.col("value").startswith("#"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence) of FASTA records: the header's line, and the other lines joined without spaces."""
    own = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("r"))
    lines = F.split("r", "\r?\n")
    sequence = F.regexp_replace(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s", "")
    return own.select(F.trim(lines[0]).alias("header"), sequence.alias("sequence")).filter("sequence != ''")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Proteins with their sequence, its length and MD5; records without residues are dropped."""
    records = _records(spark, path).filter("header != ''")
    fields = scalars.fasta_header(F.col("header"))
    named = records.select(*[c.alias(n) for n, c in fields.items()], "sequence")
    canonical, is_canonical, index = scalars.isoform(F.col("accession"))
    return named.withColumns({"canonical_accession": canonical, "is_canonical": is_canonical, "isoform_index": index, "length": F.length("sequence"), "sequence_hash": F.md5("sequence")})


def read_query_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(accession, SEQUENCE): the header's first token; records without one are dropped."""
    records = _records(spark, path).select(F.get(F.regexp_extract_all("header", F.lit(r"(\S+)")), F.lit(0)).alias("accession"), F.upper("sequence").alias("sequence"))
    return records.filter("accession is not null")


def _stanzas(spark: SparkSession, path: str) -> DataFrame:
    own = spark.read.text(path, lineSep="\n[").filter(F.col("value").startswith("Term]") | F.col("value").startswith("[Term]"))
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("!"))
    return own.select(lines.alias("lines")).withColumn("go_id", _value("id: GO:", "id:")).filter("go_id is not null")


def _value(prefix: str, label: str) -> Column:
    """What stands behind the label on the last line that starts with the prefix."""
    found = F.element_at(F.filter("lines", lambda x: x.startswith(prefix)), -1)
    return F.when(F.size(F.filter("lines", lambda x: x.startswith(prefix))) > 0, F.trim(F.substr(found, F.lit(len(label) + 1))))


def obo_version(spark: SparkSession, path: str) -> str:
    """The data-version of the header; an ontology without one is an error."""
    found = spark.read.text(path).filter(F.col("value").startswith("data-version:")).limit(1).collect()
    if not found:
        raise ValueError("the ontology has no data-version")
    return found[0]["value"].split(":", 1)[1].strip()


def read_obo_terms(spark: SparkSession, path: str) -> DataFrame:
    """(go_id, name, aspect, definition, is_obsolete) of the [Term] stanzas. An ontology without a data-version is an error."""
    obo_version(spark, path)
    stanzas = _stanzas(spark, path)
    aspect = F.lit(None).cast("string")
    for name, letter in NAMESPACES.items():
        aspect = F.when(_value("namespace:", "namespace:") == name, letter).otherwise(aspect)
    definition = F.nullif(F.regexp_extract(_value("def:", "def:"), r'^"(.*?)"', 1), F.lit(""))
    return stanzas.select("go_id", _value("name:", "name:").alias("name"), aspect.alias("aspect"), definition.alias("definition"), F.array_contains("lines", "is_obsolete: true").alias("is_obsolete"))


def read_obo_edges(spark: SparkSession, path: str) -> DataFrame:
    """(child, parent, relation_type) between known terms. An ontology without a data-version is an error."""
    obo_version(spark, path)
    stanzas = _stanzas(spark, path)
    lines = stanzas.select(F.col("go_id").alias("child"), F.explode("lines").alias("l"))
    is_a = F.regexp_extract("l", r"^is_a:\s+(GO:[^\s!]+)", 1)
    kind, other = F.regexp_extract("l", r"^relationship:\s*(\S+)\s+(GO:\S+)", 1), F.regexp_extract("l", r"^relationship:\s*(\S+)\s+(GO:\S+)", 2)
    edges = lines.select("child", F.when(is_a != "", is_a).when(kind.isin(*RELATIONS), other).alias("parent"), F.when(is_a != "", "is_a").otherwise(kind).alias("relation_type")).filter("parent is not null")
    known = stanzas.select(F.col("go_id").alias("parent")).distinct()
    return edges.join(known, "parent", "left_semi").select("child", "parent", "relation_type")


def read_gaf(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    """Annotations of a GAF file, plain or gzip; lines of less than 15 fields are dropped. Only protein and GO id are trimmed, blanks are null. With `places`, where each line stands."""
    rows = spark.read.text(path).filter("value != '' and not startswith(value, '!')").select(_fields().alias("f"), *([_place().alias("place")] if places else [])).filter("size(f) >= 15")
    return rows.select(*(["place"] if places else []), *[(F.trim(F.col("f")[i]) if c in ("protein", "go_id") else F.nullif(F.col("f")[i], F.lit(""))).alias(c) for c, i in GAF_COLUMNS.items()])


def read_quickgo(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    """Rows under their header's names; rows shorter than the header are dropped, every field is trimmed and blanks are null. With `places`, where each line stands."""
    header = spark.read.text(path).first()["value"].split("\t")
    rows = spark.read.text(path).filter(F.col("value") != F.lit("\t".join(header))).select(_fields().alias("f"), *([_place().alias("place")] if places else [])).filter(F.size("f") >= len(header))
    return rows.select(*(["place"] if places else []), *[scalars.blank_to_null(F.col("f")[i]).alias(c) for i, c in enumerate(header)])


def read_eco_map(spark: SparkSession, path: str) -> DataFrame:
    """(eco_id, code): the first two tokens of lines that start ECO:, the last line of an id wins, files in order of their names."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"), _place().alias("at")).filter("size(t) >= 2 and startswith(t[0], 'ECO:')")
    return rows.groupBy(F.col("t")[0].alias("eco_id")).agg(F.max_by(F.col("t")[1], "at").alias("code"))


def read_metadata_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Protein metadata: the known columns under their names, missing ones and nulls as blanks."""
    df = spark.read.csv(path, sep="\t", header=True, quote="")
    own = [F.coalesce(F.col(f"`{title}`") if title in df.columns else F.lit(None).cast("string"), F.lit("")).alias(name) for name, title in METADATA_COLUMNS.items()]
    return df.select(F.col("Entry").alias("canonical_accession"), *own)


def read_ia(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(_fields().alias("f")).filter("size(f) >= 2")
    return rows.select(F.trim(F.col("f")[0]).alias("go_id"), F.col("f")[1].try_cast("double").alias("ia")).filter("ia is not null")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).select(_fields().alias("f")).filter("size(f) >= 2 and startswith(f[1], 'GO:')")
    return rows.select(F.col("f")[0].alias("protein"), F.col("f")[1].alias("go_id")).distinct()


def read_emapper(spark: SparkSession, path: str) -> DataFrame:
    """(protein, go_id); of a repeated protein the last line with terms counts, files in order of their names."""
    rows = _lines(spark, path).select(_fields().alias("f"), _place().alias("at")).filter("size(f) >= 10")
    terms = F.array_distinct(F.filter(F.transform(F.split(F.col("f")[9], ","), lambda x: F.trim(x)), lambda x: x.startswith("GO:")))
    last = rows.select(F.col("f")[0].alias("protein"), "at", terms.alias("terms")).filter("size(terms) > 0").groupBy("protein").agg(F.max_by("terms", "at").alias("terms"))
    return last.select("protein", F.explode("terms").alias("go_id"))


def read_interproscan(spark: SparkSession, path: str) -> DataFrame:
    """(protein, go_id): terms of column 13 without their source; repeated proteins unite."""
    rows = _lines(spark, path).select(_fields().alias("f")).filter("size(f) >= 14")
    exploded = rows.select(F.col("f")[0].alias("protein"), F.explode(F.split(F.col("f")[13], r"\|")).alias("g")).withColumn("g", F.trim("g")).filter("startswith(g, 'GO:')")
    return exploded.select("protein", F.regexp_replace("g", r"\(.*", "").alias("go_id")).distinct()


def read_pannzer2(spark: SparkSession, path: str) -> DataFrame:
    """(protein, go_id, score): the best PPV of ARGOT rows, 1 where it is no number."""
    rows = _lines(spark, path).filter(~F.col("value").startswith("qpid")).select(_fields().alias("f")).filter("size(f) >= 5 and startswith(f[4], 'GO:') and contains(f[1], 'ARGOT')")
    return rows.groupBy(F.col("f")[0].alias("protein"), F.col("f")[4].alias("go_id")).agg(F.max(F.coalesce(F.col("f")[3].try_cast("double"), F.lit(1.0))).alias("score"))


def read_training_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, then numbers where they are numbers and label null as 0."""
    from ..operators.reranker import prepare_features

    return prepare_features(spark.read.csv(path, sep="\t", header=True, quote=""))


def read_set(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """One set of a table that is partitioned by it: other partitions aren't opened."""
    return spark.read.parquet(path).filter(F.col(key) == value)

