"""Queries of readers, exports, table maintenance, the re-ranker and streaming.

Files that readers read are written by Spark from the driver's tables into a new folder first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scoring import PRESETS
from ..operators import evaluation, graph, maintenance, reranker, transfer
from ..operators.cell_index import CellIndex
from ..operators.relational import labelled
from ..sources import loads, readers, sinks
from ..sources.versions import Versions
from ..streaming import ingest
from .bindings import Bound
from .registry import query
from .transfers import _EV, _FEATURES, _SCORED, _SIM, curve_sql, fmax_sql, scored

TAB = "\t"


def tabbed(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.concat_ws(TAB, *[F.coalesce(c.cast("string") if not isinstance(c, str) else F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))


# -- sources

_SEQ = "upper(regexp_replace({t}, '[^A-Za-z]', '', 'g'))"


def fasta_records(b: Bound) -> DataFrame:
    sequence = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    docs = b.table("documents").select(F.col("doc_id").alias("idx"), sequence.alias("sequence"))
    return b.protein.join(docs, "idx")


@query(
    "read_fasta",
    f"""SELECT accession, CASE WHEN idx % 13 <> 0 THEN entry_name END AS entry_name, canonical_accession, is_canonical, isoform_index, organism, CAST(taxonomy_id AS STRING) AS taxonomy_id, gene_name, idx % 2 = 0 AS reviewed, s AS sequence, length(s) AS length, md5(s) AS sequence_hash
 FROM (SELECT p.*, {_SEQ.format(t='d.text')} AS s FROM v_protein p JOIN documents d ON d.doc_id = p.idx) WHERE s <> ''""",
)
def read_fasta(b: Bound):
    own = fasta_records(b)
    header = F.concat(F.when(F.col("idx") % 2 == 0, ">sp|").otherwise(">tr|"), "accession", F.lit("|"), F.coalesce("entry_name", F.lit("")), F.lit(" x OS="), "organism", F.lit(" OX="), F.col("taxonomy_id").cast("string"), F.lit(" GN="), "gene_name", F.lit(" PE=1"))
    path = b.text_file("fasta", own.select(F.concat(header, F.lit("\n"), F.regexp_replace("sequence", "(.{60})(?=.)", "$1\n"))))
    found = readers.read_fasta(b.spark, path)
    return found.withColumn("entry_name", F.nullif("entry_name", F.lit(""))).select("accession", "entry_name", "canonical_accession", "is_canonical", "isoform_index", "organism", "taxonomy_id", "gene_name", "reviewed", "sequence", F.col("length").cast("long").alias("length"), "sequence_hash")


@query("read_query_fasta", f"SELECT accession, s AS sequence FROM (SELECT p.accession, p.idx, {_SEQ.format(t='d.text')} AS s FROM v_protein p JOIN documents d ON d.doc_id = p.idx) WHERE s <> '' AND idx % 9 <> 0")
def read_query_fasta(b: Bound):
    own = fasta_records(b)
    header = F.when(F.col("idx") % 9 == 0, ">").otherwise(F.concat(F.lit(">"), "accession", F.lit(" some words")))
    path = b.text_file("query-fasta", own.select(F.concat(header, F.lit("\n"), F.lower("sequence"))))
    return readers.read_query_fasta(b.spark, path)


def obo_file(b: Bound) -> str:
    parents = b.edge.groupBy(F.col("child").alias("go_id")).agg(F.array_sort(F.collect_list(F.when(F.col("relation_type") == "is_a", F.concat(F.lit("is_a: "), "parent", F.lit(" ! label"))).otherwise(F.concat(F.lit("relationship: "), "relation_type", F.lit(" "), "parent", F.lit(" ! label"))))).alias("edges"))
    space = F.when(F.col("aspect") == "F", "molecular_function").when(F.col("aspect") == "P", "biological_process").otherwise("cellular_component")
    definition = F.when(F.col("t") % 10 == 0, "def: none").otherwise(F.concat(F.lit('def: "about '), "name", F.lit('" [x "y"]')))
    lines = F.concat(F.array(F.lit("[Term]"), F.concat(F.lit("id: "), "go_id"), F.concat(F.lit("name: "), "name"), F.concat(F.lit("namespace: "), space), definition, F.when(F.col("is_obsolete"), "is_obsolete: true").otherwise("comment: x"), F.lit("relationship: has_part GO:0000001"), F.lit("is_a: CHEBI:1")), F.coalesce("edges", F.array().cast("array<string>")))
    stanzas = b.term.join(parents, "go_id", "left").select(F.concat(F.array_join(lines, "\n"), F.lit("\n\n[Typedef]\nid: part_of\nname: part of\n")).alias("value"))
    head = b.spark.range(1).select(F.lit("format-version: 1.2\ndata-version: releases/2024-01-17\n"))
    return b.text_file("obo", head.union(stanzas))


@query("read_obo_terms", "SELECT go_id, name, aspect, CASE WHEN t % 10 <> 0 THEN concat('about ', name) END AS definition, is_obsolete FROM v_term")
def read_obo_terms(b: Bound):
    return readers.read_obo_terms(b.spark, obo_file(b))


@query("read_obo_edges", "SELECT child, parent, relation_type FROM v_edge WHERE parent IN (SELECT go_id FROM v_term)")
def read_obo_edges(b: Bound):
    return readers.read_obo_edges(b.spark, obo_file(b))


def gaf_lines(b: Bound, own: DataFrame | None = None) -> DataFrame:
    own = b.annotation if own is None else own
    e, blank = F.lit(""), F.lit("UniProtKB")
    fields = [blank, "protein", e, F.coalesce("qualifier", e), F.concat(F.lit(" "), "go_id"), F.concat(F.lit("PMID:"), F.col("line_order").cast("string")), F.coalesce("evidence_code", e), e, "aspect", e, e, e, e, F.lit("20240101"), blank]
    return own.select(F.when(F.col("line_number") == 7, "too\tshort").otherwise(F.concat_ws(TAB, *fields)).alias("value")).union(b.spark.createDataFrame([("!gaf-version: 2.2",), ("",)], "value string"))


@query("read_gaf", "SELECT protein, qualifier, go_id, concat('PMID:', line_order) AS db_reference, evidence_code, CAST(NULL AS STRING) AS with_from, '20240101' AS annotation_date, 'UniProtKB' AS assigned_by FROM v_annotation WHERE line_number <> 7")
def read_gaf(b: Bound):
    path = b.folder("gaf")
    gaf_lines(b).write.option("compression", "gzip").text(path)
    return readers.read_gaf(b.spark, path)


@query("read_quickgo", "SELECT protein AS \"GENE PRODUCT ID\", qualifier AS \"QUALIFIER\", go_id AS \"GO TERM\", evidence_code AS \"ECO ID\" FROM v_annotation WHERE line_number <> 6")
def read_quickgo(b: Bound):
    header = ["GENE PRODUCT ID", "QUALIFIER", "GO TERM", "ECO ID"]
    rows = b.annotation.select(F.when(F.col("line_number") == 6, "short\trow").otherwise(F.concat_ws(TAB, "protein", F.concat(F.lit(" "), F.coalesce("qualifier", F.lit(""))), "go_id", F.coalesce("evidence_code", F.lit("")))).alias("value"))
    path = b.folder("quickgo")
    rows.toDF(TAB.join(header)).write.csv(path, sep="\x01", header=True, quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)  # each file begins with the header
    return readers.read_quickgo(b.spark, path)


_LOADED = """SELECT protein, go_id, evidence_code, qualifier, assigned_by, db_reference, with_from, annotation_date FROM (SELECT *, row_number() OVER (PARTITION BY protein, go_id, evidence_code ORDER BY line_order, line_number, qualifier NULLS FIRST) AS k FROM ({rows}) WHERE go_id IN (SELECT go_id FROM v_term WHERE NOT is_obsolete)) WHERE k = 1"""


def in_order(b: Bound) -> DataFrame:
    """Lines of one key in one file, in their order."""
    return b.annotation.repartition("protein").sortWithinPartitions("protein", "line_order", "line_number", "qualifier")


@query("load_gaf", _LOADED.format(rows="SELECT *, 'UniProtKB' AS assigned_by, concat('PMID:', line_order) AS db_reference, CAST(NULL AS STRING) AS with_from, '20240101' AS annotation_date FROM v_annotation WHERE line_number <> 7 AND protein IN (SELECT canonical_accession FROM v_protein)"))
def load_gaf(b: Bound):
    """GAF lines of canonical accessions and current terms, the first of each key whole."""
    path = b.folder("gaf")
    gaf_lines(b, in_order(b)).write.text(path)
    return loads.load_gaf(readers.read_gaf(b.spark, path, places=True), b.protein, b.term.filter("not is_obsolete"))


@query("load_quickgo", _LOADED.format(rows="SELECT a.* EXCLUDE (evidence_code), coalesce(e.code, a.evidence_code) AS evidence_code, 'GOC' AS assigned_by, concat('PMID:', line_order) AS db_reference, CAST(NULL AS STRING) AS with_from, CAST(NULL AS STRING) AS annotation_date FROM v_annotation a LEFT JOIN (SELECT 'ECO:0000314' AS eco, 'IDA' AS code) e ON e.eco = a.evidence_code WHERE protein IN (SELECT accession FROM v_protein)"))
def load_quickgo(b: Bound):
    """QuickGO rows of plain accessions; evidence by the map where it knows a code, so some rows have the key of another one."""
    header = ["GENE PRODUCT ID", "QUALIFIER", "GO TERM", "ECO ID", "REFERENCE", "ASSIGNED BY"]
    rows = in_order(b).select(F.concat_ws(TAB, "protein", F.coalesce("qualifier", F.lit("")), "go_id", F.coalesce("evidence_code", F.lit("")), F.concat(F.lit("PMID:"), "line_order"), F.lit("GOC")).alias("value"))
    path = b.folder("quickgo")
    rows.toDF(TAB.join(header)).write.csv(path, sep="\x01", header=True, quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    eco = readers.read_eco_map(b.spark, b.text_file("eco", b.spark.range(1).select(F.lit("ECO:0000314 IDA Default"))))
    return loads.load_quickgo(readers.read_quickgo(b.spark, path, places=True), b.protein, b.term.filter("not is_obsolete"), eco)


@query("read_eco_map", "SELECT concat('ECO:', lpad(CAST(p_partkey AS STRING), 7, '0')) AS eco_id, p_brand AS code FROM part WHERE p_brand NOT LIKE '% %'")
def read_eco_map(b: Bound):
    eco = F.concat(F.lit("ECO:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))
    own = b.table("part").filter("p_brand not like '% %'").select(F.concat(eco, F.lit(" old\n"), eco, F.lit("   "), "p_brand", F.lit(" Default\n# comment")))
    return readers.read_eco_map(b.spark, b.text_file("eco", own))


@query("read_metadata_tsv", "SELECT concat('C', c_custkey) AS canonical_accession, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS function_cc, c_mktsegment AS keywords, '' AS kinetics FROM customer")
def read_metadata_tsv(b: Bound):
    path = b.folder("metadata")
    b.table("customer").select(F.concat(F.lit("C"), "c_custkey").alias("Entry"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("Function [CC]"), F.col("c_mktsegment").alias("Keywords")).write.csv(path, sep=TAB, header=True, nullValue="")
    return readers.read_metadata_tsv(b.spark, path).select("canonical_accession", "function_cc", "keywords", "kinetics")


@query("read_ia", "SELECT go_id, CAST(t % 7 AS DOUBLE) / 4 AS ia FROM v_term WHERE t % 5 <> 0")
def read_ia(b: Bound):
    rows = b.term.select(F.when(F.col("t") % 5 == 0, F.col("go_id")).otherwise(F.concat_ws(TAB, "go_id", ((F.col("t") % 7).cast("double") / 4).cast("string"))))
    return readers.read_ia(b.spark, b.text_file("ia", rows))


def terms_by_protein(b: Bound, suffix: str = "") -> DataFrame:
    return b.old.groupBy("protein").agg(F.array_sort(F.collect_set(F.concat("go_id", F.lit(suffix)))).alias("terms"))


@query("read_emapper", "SELECT DISTINCT protein, go_id FROM v_old")
def read_emapper(b: Bound):
    own = terms_by_protein(b)
    columns = ["protein", *[F.lit("x")] * 8]
    text = F.concat(F.concat_ws(TAB, *columns, F.lit("GO:9999999")), F.lit("\n"), F.concat_ws(TAB, *columns, F.lit("-")), F.lit("\n#c\n"), F.concat_ws(TAB, *columns, F.array_join("terms", ",")))
    return readers.read_emapper(b.spark, b.text_file("emapper", own.select(text)))


@query("read_interproscan", "SELECT DISTINCT protein, go_id FROM v_old UNION SELECT DISTINCT protein, 'GO:9999999' FROM v_old")
def read_interproscan(b: Bound):
    own = terms_by_protein(b, "(InterPro)")
    columns = ["protein", *[F.lit("x")] * 12]
    text = F.concat(F.concat_ws(TAB, *columns, F.lit("GO:9999999")), F.lit("\n"), F.concat_ws(TAB, *columns, F.array_join("terms", "|")))
    return readers.read_interproscan(b.spark, b.text_file("interproscan", own.select(text)))


@query("read_pairs", "SELECT DISTINCT protein, go_id FROM v_annotation")
def read_pairs(b: Bound):
    return readers.read_pairs(b.spark, b.text_file("pairs", tabbed(b.annotation, "protein", "go_id", F.lit("0.5"))))


def pannzer_file(b: Bound) -> str:
    kind = F.when(F.col("line_number") == 2, "BP_PANZ").otherwise("BP_ARGOT")
    ppv = F.when(F.col("line_number") == 4, "n/a").otherwise((F.col("line_number") / 10).cast("string"))
    return b.text_file("pannzer2", tabbed(b.annotation, "protein", kind, F.lit("9"), ppv, "go_id", F.lit("d")), "gzip")


@query("read_pannzer2", "SELECT protein, go_id, max(CASE WHEN line_number = 4 THEN 1 ELSE line_number / 10.0 END)::DOUBLE AS score FROM v_annotation WHERE line_number <> 2 GROUP BY 1, 2")
def read_pannzer2(b: Bound):
    return readers.read_pannzer2(b.spark, pannzer_file(b))


@query("read_training_tsv", "SELECT CAST(protein AS STRING) AS protein, go_id, CASE WHEN line_number = 3 THEN NULL ELSE CAST(line_number AS DOUBLE) END AS distance, qualifier, CASE WHEN line_number = 5 THEN 0 ELSE CAST(line_number % 2 AS INT) END AS label FROM v_annotation")
def read_training_tsv(b: Bound):
    path = b.folder("training")
    own = b.annotation.select("protein", "go_id", F.when(F.col("line_number") == 3, "bad").otherwise(F.col("line_number").cast("string")).alias("distance"), "qualifier", F.when(F.col("line_number") == 5, "").otherwise((F.col("line_number") % 2).cast("string")).alias("label"))
    own.write.csv(path, sep=TAB, header=True, nullValue="")
    return readers.read_training_tsv(b.spark, path).select("protein", "go_id", "distance", "qualifier", "label")


@query("scan_by_set", "SELECT protein, go_id, count(*) AS n FROM v_annotation WHERE evidence_code = 'IMP' GROUP BY 1, 2")
def scan_by_set(b: Bound):
    path = b.folder("annotation")
    b.annotation.select("protein", "go_id", F.coalesce("evidence_code", F.lit("none")).alias("annotation_set")).write.partitionBy("annotation_set").parquet(path)
    return readers.read_set(b.spark, path, "annotation_set", "IMP").groupBy("protein", "go_id").agg(F.count(F.lit(1)).alias("n"))


# -- sinks


@query("export_predictions", f"SELECT p.protein, p.go_id, t.name AS go_name, t.aspect, round(p.distance, 6) AS distance, p.ref, p.qualifier, p.evidence_code, CAST(NULL AS STRING) AS identity_nw, CAST(p.vote_count AS STRING) AS vote_count, printf('%.6g', p.neighbor_distance_std) AS neighbor_distance_std FROM ({_FEATURES}) p JOIN v_term t ON t.go_id = p.go_id WHERE t.aspect = 'P' AND p.distance <= 0.8")
def export_predictions(b: Bound):
    path = b.folder("predictions")
    own = transfer.reranker_features(b.neighbours, b.old_labels)
    sinks.write_predictions(sinks.prediction_rows(own, b.term, aspect="P", max_distance=0.8), path)
    found = b.spark.read.csv(path, sep=TAB, header=True)
    return found.select("protein", "go_id", "go_name", "aspect", F.round(F.col("distance").cast("double"), 6).alias("distance"), "ref", "qualifier", "evidence_code", "identity_nw", "vote_count", "neighbor_distance_std")


@query("export_cafa", "SELECT protein, go_id, round(greatest(0, 1 - min(distance)), 4) AS score FROM v_prediction WHERE aspect = 'F' AND protein IN (SELECT protein FROM v_truth WHERE category IN ('NK', 'LK')) GROUP BY 1, 2")
def export_cafa(b: Bound):
    path = b.folder("cafa")
    sinks.write_tsv(sinks.cafa_rows(b.prediction, b.truth.filter("category in ('NK', 'LK')"), "F"), path, header=False)
    return b.spark.read.csv(path, sep=TAB, schema="protein string, go_id string, score double")


@query("export_scored", f"SELECT protein, go_id, aspect, round((0.2 * {_SIM} + 0.8 * {_EV}), 6) AS score FROM v_prediction WHERE round((0.2 * {_SIM} + 0.8 * {_EV}), 6) >= 0.5")
def export_scored(b: Bound):
    path = b.folder("scored")
    sinks.write_tsv(sinks.scored_rows(b.prediction, PRESETS[4], 0.5), path)
    return b.spark.read.csv(path, sep=TAB, header=True, schema="protein string, go_id string, aspect string, score double")


@query("export_training", f"SELECT f.protein, f.go_id, f.vote_count, f.k_position, CASE WHEN t.go_id IS NULL THEN 0 ELSE 1 END AS label FROM ({_FEATURES}) f LEFT JOIN (SELECT DISTINCT protein, go_id FROM v_truth WHERE category = 'LK') t ON t.protein = f.protein AND t.go_id = f.go_id")
def export_training(b: Bound):
    return training(b, "LK").select("protein", "go_id", "vote_count", "k_position", "label")


def training(b: Bound, category: str) -> DataFrame:
    return labelled(transfer.reranker_features(b.neighbours, b.old_labels), b.truth.filter(F.col("category") == category))


@query("export_gt", "SELECT DISTINCT protein, go_id FROM v_truth WHERE category = 'PK'")
def export_gt(b: Bound):
    path = b.folder("truth")
    sinks.write_tsv(sinks.truth_rows(b.truth, "PK"), path, header=False)
    return b.spark.read.csv(path, sep=TAB, schema="protein string, go_id string")


@query(
    "export_delta_fasta",
    f"""SELECT p.accession, concat('>', p.accession, coalesce(' ' || p.entry_name, ''), ' OS=', p.organism, ' OX=', p.taxonomy_id, ' (', l.label, ')', chr(10), rtrim(regexp_replace({_SEQ.format(t='d.text')}, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10))) AS record
 FROM v_protein p JOIN documents d ON d.doc_id = p.idx JOIN (SELECT protein, CASE WHEN bool_or(category = 'NK') THEN 'NK' WHEN bool_or(category = 'LK') THEN 'LK' ELSE 'PK' END AS label FROM v_truth GROUP BY 1) l ON l.protein = p.accession""",
)
def export_delta_fasta(b: Bound):
    """Proteins with new terms and their sequences: the letters of whole texts."""
    path = b.folder("delta-fasta")
    sinks.write_fasta(sinks.delta_fasta(b.truth, fasta_records(b)), path)
    own = b.spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>|\n+$", "").alias("r")).filter("r != ''")
    records = own.select(F.when(F.col("r").contains("\n"), F.col("r")).otherwise(F.concat("r", F.lit("\n"))).alias("r"))  # without residues a record keeps its empty line
    return records.select(F.split("r", " ")[0].alias("accession"), F.concat(F.lit(">"), "r").alias("record"))


_METRICS = " UNION ALL ".join(
    f"SELECT '{c}' AS category, '{a}' AS aspect, fmax, threshold_at_fmax, auc_pr FROM ({fmax_sql(curve_sql(f'SELECT * FROM ({_SCORED}) WHERE aspect = {a!r}', f'SELECT protein, go_id FROM v_truth WHERE category = {c!r} AND aspect = {a!r}'))}) WHERE EXISTS (SELECT 1 FROM v_truth WHERE category = '{c}' AND aspect = '{a}')"
    for c in ("NK", "LK", "PK") for a in ("P", "F", "C")
)


@query("export_metrics", _METRICS)
def export_metrics(b: Bound):
    """Fmax, its threshold and the area of each category and namespace, as a file; cells without truth are skipped."""
    curve = evaluation.pr_curve(scored(b), b.truth, by=("category", "aspect"))
    found = evaluation.fmax(curve, "category", "aspect")
    path = b.folder("metrics")
    sinks.write_tsv(sinks.metric_rows(found), path)
    return b.spark.read.csv(path, sep=TAB, header=True, schema="category string, aspect string, fmax double, threshold_at_fmax double, auc_pr double")


@query("split_store", "SELECT category, aspect AS split, count(*) AS n FROM v_truth GROUP BY 1, 2")
def split_store(b: Bound):
    path = b.folder("splits")
    sinks.write_splits(b.truth.withColumnRenamed("aspect", "split"), path)
    return b.spark.read.parquet(path).groupBy("category", "split").agg(F.count(F.lit(1)).alias("n"))


# -- set operations and maintenance

_HELD = "SELECT protein, go_id, evidence_code, min(line_order * 10 + line_number) AS line FROM v_annotation WHERE line_order % 2 = {r} GROUP BY 1, 2, 3"


def half(b: Bound, r: int) -> DataFrame:
    return b.annotation.filter(F.col("line_order") % 2 == r).select("protein", "go_id", "evidence_code", (F.col("line_order") * 10 + F.col("line_number")).alias("line"))


@query(
    "insert_ignore",
    f"""WITH held AS ({_HELD.format(r=0)}) SELECT * FROM held UNION ALL SELECT * FROM ({_HELD.format(r=1)}) n
 WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.protein = n.protein AND h.go_id = n.go_id AND h.evidence_code IS NOT DISTINCT FROM n.evidence_code)""",
)
def insert_ignore(b: Bound):
    """Lines of odd orders into those of even ones; many share a key, of which the first line stays."""
    keys = ["protein", "go_id", "evidence_code"]
    held = half(b, 0).groupBy(*keys).agg(F.min("line").alias("line"))
    return maintenance.insert_ignore(held, half(b, 1), keys, order=["line"])


@query("concat_splits", "SELECT protein, go_id, evidence_code FROM v_old UNION ALL SELECT protein, go_id, evidence_code FROM v_annotation")
def concat_splits(b: Bound):
    columns = ["protein", "go_id", "evidence_code"]
    return b.old.select(*columns).unionByName(b.annotation.select(*columns))


@query("dedupe_sequences", "SELECT sequence_hash, count(*) AS n_rows, sequence_hash IN (SELECT sequence_hash FROM v_sequence WHERE sequence_id % 3 = 0) AS reused FROM v_sequence WHERE sequence_id % 3 <> 0 GROUP BY 1")
def dedupe_sequences(b: Bound):
    return maintenance.dedupe_sequences(b.sequence.filter("sequence_id % 3 != 0"), b.sequence.filter("sequence_id % 3 = 0"))


def versions(b: Bound) -> tuple[DataFrame, DataFrame]:
    old = b.protein.filter("idx % 4 != 0").select("accession", F.when(F.col("idx") % 3 == 0, "").otherwise(F.col("gene_name")).alias("gene_name"), F.col("entry_name"), F.lit(True).alias("is_canonical"))
    offer = b.protein.filter("idx % 5 != 0")
    new = offer.select("accession", F.lit("new gene").alias("gene_name"), F.lit("new entry").alias("entry_name"), "is_canonical", F.lit(1).alias("at"))
    later = offer.filter("idx % 7 = 3").select("accession", F.lit("newer gene").alias("gene_name"), F.lit("new entry").alias("entry_name"), "is_canonical", F.lit(2).alias("at"))
    return old, new.unionByName(later)


_OLD = "(SELECT accession, CASE WHEN idx % 3 = 0 THEN '' ELSE gene_name END AS gene_name, entry_name, TRUE AS is_canonical FROM v_protein WHERE idx % 4 <> 0)"
_NEW = "(SELECT accession, CASE WHEN idx % 7 = 3 THEN 'newer gene' ELSE 'new gene' END AS gene_name, 'new entry' AS entry_name, is_canonical FROM v_protein WHERE idx % 5 <> 0)"


@query(
    "upsert_fill",
    f"""SELECT accession, gene_name, entry_name, is_canonical, 'inserted' AS change FROM {_NEW} WHERE accession NOT IN (SELECT accession FROM {_OLD})
 UNION ALL SELECT *, 'kept' FROM {_OLD} WHERE accession NOT IN (SELECT accession FROM {_NEW})
 UNION ALL SELECT o.accession, CASE WHEN o.gene_name IS NULL OR o.gene_name = '' THEN n.gene_name ELSE o.gene_name END, CASE WHEN o.entry_name IS NULL OR o.entry_name = '' THEN n.entry_name ELSE o.entry_name END, n.is_canonical,
  CASE WHEN o.gene_name IS NULL OR o.gene_name = '' OR o.entry_name IS NULL OR o.entry_name = '' OR NOT n.is_canonical THEN 'updated' ELSE 'kept' END FROM {_OLD} o JOIN {_NEW} n ON o.accession = n.accession""",
)
def upsert_fill(b: Bound):
    old, new = versions(b)
    return maintenance.upsert_fill(old, new, "accession", ["gene_name", "entry_name"], ["is_canonical"], order=["at"])


@query(
    "upsert_overwrite",
    f"""SELECT accession, gene_name, entry_name, is_canonical, CASE WHEN inserted THEN 'inserted' WHEN offered AND (gene_name IS DISTINCT FROM og OR entry_name IS DISTINCT FROM oe OR is_canonical IS DISTINCT FROM oc) THEN 'updated' ELSE 'kept' END AS change FROM (
 SELECT coalesce(o.accession, n.accession) AS accession, CASE WHEN n.accession IS NOT NULL THEN n.gene_name ELSE o.gene_name END AS gene_name, CASE WHEN n.accession IS NOT NULL THEN n.entry_name ELSE o.entry_name END AS entry_name, CASE WHEN n.accession IS NOT NULL THEN n.is_canonical ELSE o.is_canonical END AS is_canonical,
  o.accession IS NULL AS inserted, n.accession IS NOT NULL AS offered, o.gene_name AS og, o.entry_name AS oe, o.is_canonical AS oc FROM {_OLD} o FULL JOIN {_NEW} n ON o.accession = n.accession)""",
)
def upsert_overwrite(b: Bound):
    return maintenance.upsert_overwrite(*versions(b), "accession", order=["at"])


@query(
    "publish_versions",
    f"""SELECT accession, gene_name, entry_name, is_canonical FROM (SELECT coalesce(o.accession, n.accession) AS accession, CASE WHEN n.accession IS NOT NULL THEN n.gene_name ELSE o.gene_name END AS gene_name, CASE WHEN n.accession IS NOT NULL THEN n.entry_name ELSE o.entry_name END AS entry_name, CASE WHEN n.accession IS NOT NULL THEN n.is_canonical ELSE o.is_canonical END AS is_canonical
 FROM {_OLD} o FULL JOIN {_NEW} n ON o.accession = n.accession) WHERE gene_name IS DISTINCT FROM ''""",
)
def publish_versions(b: Bound):
    """A table published, overwritten by offers and rid of blank genes, each as a new version; a handle from before the changes reads the last one."""
    old, new = versions(b)
    table, reader = Versions(b.spark, path := b.folder("published")), Versions(b.spark, path)
    table.publish(old)
    table.update(lambda rows: maintenance.upsert_overwrite(rows, new, "accession", order=["at"]).drop("change"))
    table.update(lambda rows: rows.filter("gene_name is null or gene_name != ''"))
    table.drop_others()
    return reader.read()


@query("store_embeddings", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def store_embeddings(b: Bound):
    e = b.table("embeddings").select("vec_id")
    return maintenance.replace_or_skip(e.filter("vec_id % 2 = 0").withColumn("origin", F.lit("old")), e.filter("vec_id % 3 = 0").withColumn("origin", F.lit("new")), "vec_id", skip_existing=False)


@query("backfill_edges", "SELECT child, parent, relation_type FROM v_edge")
def backfill_edges(b: Bound):
    """A version without edges gets them, one that has them doesn't get them twice."""
    none = b.edge.withColumn("version", F.lit("v0")).limit(0)
    first = maintenance.backfill(none, b.edge, "v1")
    again = maintenance.backfill(first, b.edge, "v1")
    return first.unionByName(again).select("child", "parent", "relation_type")


@query("delete_set", "SELECT evidence_code, count(*) AS n FROM v_annotation WHERE evidence_code <> 'IEA' GROUP BY 1")
def delete_set(b: Bound):
    """The IEA set goes; a set that is still referred to would stay."""
    rest, _ = maintenance.delete_set(b.annotation.filter("evidence_code is not null"), "evidence_code", "IEA", b.annotation.filter("evidence_code = 'IDA'").select("evidence_code"))
    return rest.groupBy("evidence_code").agg(F.count(F.lit(1)).alias("n"))


@query("vacuum", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings) OR doc_id IN (SELECT doc_id FROM labels)")
def vacuum(b: Bound):
    """Documents that neither an embedding nor a label refers to go."""
    stays, _ = maintenance.vacuum(b.table("documents").select("doc_id"), "doc_id", (b.table("embeddings"), "vec_id"), (b.table("labels"), "doc_id"))
    return stays


@query("reject_duplicates", "SELECT sequence_hash, count(*) AS n, TRUE AS rejected FROM v_sequence GROUP BY 1 HAVING count(*) > 1")
def reject_duplicates(b: Bound):
    """Hashes that occur twice, and whether an upload of them is rejected; one without them goes through."""
    twice = maintenance.duplicate_keys(b.sequence, "sequence_hash")
    try:
        maintenance.reject_duplicates(b.sequence, "sequence_hash")
        rejected = False
    except ValueError:
        rejected = True
    once = b.sequence.join(twice, "sequence_hash", "left_anti")
    assert maintenance.reject_duplicates(once, "sequence_hash") is once
    return twice.withColumn("rejected", F.lit(rejected))


# -- re-ranker


@query("prepare_features", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS distance, CASE WHEN doc_id % 3 <> 0 THEN lang END AS qualifier, 0 AS label FROM documents")
def prepare_features(b: Bound):
    raw = b.table("documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "n/a").otherwise(F.col("n_chars").cast("string")).alias("distance"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")).alias("qualifier"), F.lit(None).cast("string").alias("label"))
    return reranker.prepare_features(raw).select("doc_id", "distance", "qualifier", "label")


_ORDER = "md5(concat(CAST(doc_id AS STRING), '|42'))"
_SPLIT = f"SELECT doc_id, label, n <= greatest(1, floor(size * CAST(0.2 AS DOUBLE))) AS is_val FROM (SELECT doc_id, toxic AS label, row_number() OVER (PARTITION BY toxic ORDER BY {_ORDER}) AS n, count(*) OVER (PARTITION BY toxic) AS size FROM labels)"


def labels(b: Bound) -> DataFrame:
    return b.table("labels").select("doc_id", F.col("toxic").alias("label"))


@query("stratified_split", _SPLIT)
def stratified_split(b: Bound):
    return reranker.stratified_split(labels(b), ["doc_id"])


@query("neg_sample", f"SELECT doc_id, label, is_val FROM (SELECT *, row_number() OVER (PARTITION BY is_val, label ORDER BY {_ORDER}) AS n, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY is_val) AS pos FROM ({_SPLIT})) WHERE label = 1 OR n <= greatest(1, floor(pos * 2.0))")
def neg_sample(b: Bound):
    return reranker.sample_negatives(reranker.stratified_split(labels(b), ["doc_id"]), ["doc_id"], 2.0).select("doc_id", "label", "is_val")


@query("ia_weights", "SELECT p.protein, p.go_id, coalesce(ia, 1.0)::DOUBLE AS weight FROM v_prediction p LEFT JOIN (SELECT go_id, CAST(t % 7 AS DOUBLE) / 4 AS ia FROM v_term WHERE t % 5 <> 0) i ON i.go_id = p.go_id")
def ia_weights(b: Bound):
    ia = b.term.filter("t % 5 <> 0").select("go_id", ((F.col("t") % 7).cast("double") / 4).alias("ia"))
    return reranker.with_ia_weights(b.prediction.select("protein", "go_id"), ia).select("protein", "go_id", "weight")


def pair_truth(b: Bound, old: str, new: str) -> DataFrame:
    return b.once(f"truth {old} {new}", lambda: graph.checkpointed(evaluation.ground_truth(b.release_exp(old), b.release_exp(new))))


def pair_table(b: Bound, old: str, new: str) -> DataFrame:
    """Predictions for one pair of releases, from what the old one knows, with the categories in which the new one gained them (`_true`) or any term of their protein (`_in`)."""
    known = b.release(b.releases.index(old)).select("protein", "go_id", "aspect", "qualifier", "evidence_code")
    truth = pair_truth(b, old, new)
    gained, of_protein = (truth.groupBy(*keys).agg(F.collect_set("category").alias(c)) for c, keys in (("_true", ["protein", "go_id"]), ("_in", ["protein"])))
    return transfer.reranker_features(b.neighbours, known, evaluation.delta_proteins(truth)).join(gained, ["protein", "go_id"], "left").join(of_protein, "protein")


def rows_of(pairs: DataFrame, category: str | None = None) -> DataFrame:
    """Labelled rows of `pair_table`: true if the new release gained them, in the category if one is given; then only of proteins that gained any term in it."""
    there = F.coalesce("_true", F.array().cast("array<string>"))
    own, label = (pairs, F.size(there) > 0) if category is None else (pairs.filter(F.array_contains("_in", category)), F.array_contains(there, category))
    return own.withColumn("label", label.cast("int")).drop("_true", "_in")


def pair_rows(b: Bound, old: str, new: str, category: str | None = None) -> DataFrame:
    """Labelled rows of one pair of releases, whose features are computed once for all categories."""
    return rows_of(b.once(f"pairs {old} {new}", lambda: b.kept("pairs", pair_table(b, old, new))), category)


def _pair_sql(old: int, new: int) -> str:
    hit = f"(SELECT n.query AS protein, a.go_id, n.rank FROM v_neighbour n JOIN v_annotation a ON a.protein = n.ref WHERE a.since <= {old} AND (a.qualifier IS NULL OR a.qualifier NOT LIKE '%NOT%'))"
    gain = f"(SELECT DISTINCT protein, go_id FROM (SELECT * FROM v_exp{new} EXCEPT SELECT * FROM v_exp{old}))"
    return f"""SELECT protein, go_id, count(*) AS vote_count, CAST(min(rank) AS INT) AS k_position, max(CASE WHEN (protein, go_id) IN (SELECT (protein, go_id) FROM {gain}) THEN 1 ELSE 0 END) AS label, 'r{old}-r{new}' AS split
 FROM {hit} h WHERE protein IN (SELECT protein FROM {gain}) GROUP BY 1, 2"""


@query("training_pairs", " UNION ALL ".join(_pair_sql(r, r + 1) for r in range(3)))
def training_pairs(b: Bound):
    """Rows of every pair of consecutive releases."""
    pairs = reranker.temporal_pairs(list(b.releases), set(b.releases))
    return reranker.temporal_training_rows(pairs, lambda old, new: rows_of(pair_table(b, old, new)).select("protein", "go_id", "vote_count", "k_position", "label"))


def prepared(b: Bound) -> DataFrame:
    """Labelled training rows of all pairs but the last, split."""

    def make() -> DataFrame:
        pairs = reranker.temporal_pairs(list(b.releases[:-1]), set(b.releases))
        rows = reranker.prepare_features(reranker.temporal_training_rows(pairs, lambda old, new: pair_rows(b, old, new)))
        return b.kept("prepared", reranker.stratified_split(rows, ["split", "protein", "go_id"]))

    return b.once("prepared", make)


ROUNDS = 20  # at most; fewer where the validation rows gain nothing more


@query("train_reranker")
def train_reranker(b: Bound):
    """The fitted model's validation metrics and the rounds that were kept."""
    rows = prepared(b)
    model = reranker.train(rows, rounds=ROUNDS, neg_pos_ratio=20.0, keys=("split", "protein", "go_id"))
    found = reranker.validation_metrics(reranker.apply(model, rows.filter("is_val")))
    return found.withColumn("rounds", F.lit(reranker.best_rounds(model)))


@query("feature_importance")
def feature_importance(b: Bound):
    model = reranker.train(prepared(b), rounds=ROUNDS)
    return b.spark.createDataFrame(reranker.importances(model), "feature string, importance double").filter("importance > 0").orderBy(F.desc("importance"))


@query("train_aspect")
def train_aspect(b: Bound):
    """A model a namespace, each judged on its own validation rows."""
    rows, out = prepared(b), None
    for aspect, model in reranker.train_by_aspect(rows, rounds=ROUNDS).items():
        found = reranker.validation_metrics(reranker.apply(model, rows.filter((F.col("aspect") == aspect) & F.col("is_val")))).withColumn("aspect", F.lit(aspect))
        out = found if out is None else out.unionByName(found)
    return out


def saved_model(b: Bound, rows: DataFrame):
    from pyspark.ml import PipelineModel

    path = b.folder("model")
    reranker.train(rows, rounds=ROUNDS).write().overwrite().save(path)
    return PipelineModel.load(path)


@query("apply_reranker")
def apply_reranker(b: Bound):
    """A model that was saved and loaded scores the last pair of releases, which it hasn't seen."""
    last = reranker.prepare_features(pair_rows(b, *b.releases[-2:]))
    return reranker.apply(saved_model(b, prepared(b)), last).select("protein", "go_id", "label", F.round("reranker_score", 9).alias("reranker_score"))


@query("export_reranked")
def export_reranked(b: Bound):
    path = b.folder("reranked")
    sinks.write_tsv(apply_reranker(b).filter("reranker_score >= 0.01").orderBy("protein", F.desc("reranker_score"), "go_id"), path)
    return b.spark.read.csv(path, sep=TAB, header=True, schema="protein string, go_id string, label int, reranker_score double")


@query(
    "val_metrics",
    """WITH s AS (SELECT label, CAST(doc_id % 100 AS DOUBLE) / 100 AS p FROM (SELECT doc_id, toxic AS label FROM labels)), c AS (SELECT count(*) AS n, avg(-(label * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - label) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))) AS ll,
 sum(CASE WHEN p >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.5 AND label = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN p < 0.5 AND label = 1 THEN 1 ELSE 0 END) AS fn, avg(label) AS rate FROM s),
 u AS (SELECT avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc FROM s a JOIN s b ON a.label = 1 AND b.label = 0)
SELECT n, round(ll, 6) AS log_loss, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(rate, 6) AS positive_rate, round(auc, 6) AS auc FROM c, u""",
)
def val_metrics(b: Bound):
    """The metrics on scores that SQL knows too; train_reranker gives those of a fitted model."""
    own = labels(b).withColumn("reranker_score", (F.col("doc_id") % 100).cast("double") / 100)
    m = reranker.validation_metrics(own)
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("log_loss", "precision", "recall", "f1", "positive_rate", "auc")])


@query("route_models")
def route_models(b: Bound):
    """The last pair of releases: NK by a model a namespace, LK by one model for all, PK by distance."""
    models = {"NK": reranker.train_by_aspect(prepared(b), ("P", "F"), rounds=ROUNDS), "LK": {"": reranker.train(prepared(b), rounds=ROUNDS)}}
    last = None
    for category in ("NK", "LK", "PK"):
        own = reranker.prepare_features(pair_rows(b, *b.releases[-2:], category)).withColumn("category", F.lit(category))
        last = own if last is None else last.unionByName(own)
    return reranker.route(models, last).withColumn("score", F.round("score", 6))


@query("temporal_training")
def temporal_training(b: Bound):
    """One row a category: a model trained on the pairs of releases before the last, judged on the last pair by Fmax against 1 - d/2.

    Where the training rows lack a label no model can be trained, and where the last pair has no truth none can be judged: gains are null there.
    """
    pairs, (old, new) = reranker.temporal_pairs(list(b.releases[:-1]), set(b.releases)), b.releases[-2:]
    found = []
    for category in ("NK", "LK", "PK"):
        rows = reranker.prepare_features(reranker.temporal_training_rows(pairs, lambda o, n, c=category: pair_rows(b, o, n, c)))
        rows = b.kept("prepared", reranker.stratified_split(rows, ["split", "protein", "go_id"]))
        trained = rows.filter("not is_val").select("label").distinct().count() == 2
        gains = (None, None)
        truth = pair_truth(b, old, new).filter(F.col("category") == category)
        if trained and truth.head(1):
            model = reranker.train(rows, rounds=ROUNDS)
            test = reranker.prepare_features(pair_rows(b, old, new, category))
            base = evaluation.fmax(evaluation.pr_curve(test.select("protein", "go_id", scalars.distance_score(F.col("distance")).alias("score")), truth))
            own = evaluation.fmax(evaluation.pr_curve(reranker.apply(model, test).select("protein", "go_id", F.col("reranker_score").alias("score")), truth))
            gains = tuple(evaluation.compare(base, own).first())
        found.append((category, rows.count(), trained, *gains))
    return b.spark.createDataFrame(found, "category string, n_rows long, trained boolean, fmax_gain double, auc_gain double")


# -- streaming

_LINE = "protein string, go_id string, qualifier string, evidence_code string, assigned_by string, db_reference string, with_from string, annotation_date string, page long"
_PAGE = 500


def annotation_lines(b: Bound) -> DataFrame:
    """Whole lines; all lines of a protein in one file, in their order."""
    own = b.annotation.select(
        "protein", "go_id", "qualifier", "evidence_code", F.lit("UniProtKB").alias("assigned_by"), F.concat(F.lit("PMID:"), "line_order").alias("db_reference"), F.lit(None).cast("string").alias("with_from"), F.lit("20240101").alias("annotation_date"), F.floor(F.col("line_order") / _PAGE).cast("long").alias("page"), "line_order", "line_number"
    )
    return own.repartition("protein").sortWithinPartitions("protein", "line_order", "line_number", "qualifier")


def add_lines(b: Bound, folder: str, half: int) -> None:
    """A delivery of files: the lines of even or odd orders."""
    annotation_lines(b).filter(F.col("line_order") % 2 == half).drop("line_order", "line_number").write.mode("append").parquet(folder)


@query(
    "stream_annotations",
    """SELECT protein, go_id, evidence_code, qualifier, assigned_by, db_reference, with_from, annotation_date FROM (
 SELECT protein, go_id, evidence_code, qualifier, 'UniProtKB' AS assigned_by, concat('PMID:', line_order) AS db_reference, CAST(NULL AS STRING) AS with_from, '20240101' AS annotation_date, row_number() OVER (PARTITION BY protein, go_id, evidence_code ORDER BY line_order % 2, line_order, line_number, qualifier NULLS FIRST) AS k
 FROM v_annotation WHERE protein IN (SELECT accession FROM v_protein) AND go_id IN (SELECT go_id FROM v_term WHERE NOT is_obsolete)) WHERE k = 1""",
)
def stream_annotations(b: Bound):
    """Two deliveries, the stream started for each: the first line of a key stays, from whichever it came."""
    lines, path, checkpoint = b.folder("lines"), b.folder("ingested"), b.folder("checkpoint")
    for half in (0, 1):
        add_lines(b, lines, half)
        stream = ingest.file_stream(b.spark, lines, _LINE, 100).drop("page")
        ingest.stream_annotations(stream, b.protein, b.term.filter("not is_obsolete"), path, checkpoint).awaitTermination()
    return b.spark.read.parquet(path).drop("batch")


@query("stream_predictions", "SELECT protein, go_id, ref FROM v_prediction")
def stream_predictions(b: Bound):
    """Every query delivered twice, predicted once, by an index that was built on half of the references and had the others added. All cells are probed, so the result is exact."""
    source, path = b.folder("queries"), b.folder("predicted")
    b.queries.repartition(2).write.parquet(source)
    b.queries.write.mode("append").parquet(source)
    half = F.crc32("id") % 2 == 0
    index = CellIndex.build(b.references.filter(half), b.folder("index"))
    index.add(b.references.filter(~half), "others")
    stream = ingest.file_stream(b.spark, source, "id string, vector array<double>", 2)
    ingest.stream_predictions(stream, lambda q: index.search(q, 5), b.old_labels, path, b.folder("checkpoint")).awaitTermination()
    return b.spark.read.parquet(path).select("protein", "go_id", "ref")


@query(
    "ingest_counters",
    f"""SELECT page, count(*) AS read, count(*) FILTER (protein IN (SELECT accession FROM v_protein) AND go_id IN (SELECT go_id FROM v_term)) AS valid
 FROM (SELECT *, CAST(floor(line_order / {_PAGE}) AS BIGINT) AS page FROM v_annotation) GROUP BY 1""",
)
def ingest_counters(b: Bound):
    """Lines read and valid of every page, kept by the stream over two deliveries."""
    lines, path, checkpoint = b.folder("lines"), b.folder("counts"), b.folder("checkpoint")
    for half in (0, 1):
        add_lines(b, lines, half)
        ingest.count_pages(ingest.file_stream(b.spark, lines, _LINE, 100), b.protein, b.term, "page", path, checkpoint).awaitTermination()
    return ingest.page_counts(b.spark, path, "page")


@query("ingest_batches", "SELECT count(*) AS read, count(*) FILTER (ok) AS valid, count(DISTINCT CASE WHEN ok THEN concat_ws('|', protein, go_id, coalesce(evidence_code, '')) END) AS inserted FROM (SELECT *, protein IN (SELECT accession FROM v_protein) AND go_id IN (SELECT go_id FROM v_term) AS ok FROM v_annotation)")
def ingest_batches(b: Bound):
    """Lines read, valid and inserted over all batches."""
    lines, path, counts = b.folder("lines"), b.folder("ingested"), b.folder("counts")
    add_lines(b, lines, 0)
    add_lines(b, lines, 1)
    ingest.stream_annotations(ingest.file_stream(b.spark, lines, _LINE, 4).drop("page"), b.protein, b.term, path, b.folder("checkpoint")).awaitTermination()
    ingest.count_pages(ingest.file_stream(b.spark, lines, _LINE, 4), b.protein, b.term, "page", counts, b.folder("checkpoint")).awaitTermination()
    return ingest.totals(b.spark, path, counts, "page")


@query("ingest_limit", "SELECT least(count(*), 1000) AS read, TRUE AS stopped FROM v_annotation")
def ingest_limit(b: Bound):
    """Ingest ends with the first thousand lines, also when it is started again with more of them there."""
    lines, path, checkpoint = b.folder("lines"), b.folder("ingested"), b.folder("checkpoint")
    counters, read = ingest.Counters(b.spark), 0
    for half in (0, 1):
        add_lines(b, lines, half)
        stream = ingest.stream_annotations(ingest.file_stream(b.spark, lines, _LINE, 100, total_limit=1_000), b.protein, b.term, path, checkpoint)
        stream.awaitTermination()
        read = sum(c["read"] for c in counters.of(stream).values())
    counters.close()
    return b.spark.createDataFrame([(read, read <= 1_000)], "read long, stopped boolean")
