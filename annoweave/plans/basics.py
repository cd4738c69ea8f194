"""Queries of scalar functions, joins, aggregations and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence, scalars
from ..functions.scoring import PRESETS, score
from ..operators import graph, knn, maintenance, relational, summaries, transfer
from .bindings import Bound
from .registry import query

ROUND = 6


# -- scalar functions


@query("isoform", "SELECT accession, CASE WHEN regexp_matches(accession, '^(.*)-(\\d+)$') THEN regexp_extract(accession, '^(.*)-(\\d+)$', 1) ELSE accession END AS canonical, NOT regexp_matches(accession, '^(.*)-(\\d+)$') AS is_canonical, TRY_CAST(regexp_extract(accession, '^(.*)-(\\d+)$', 2) AS INT) AS isoform_index FROM v_protein")
def isoform(b: Bound):
    canonical, own, index = scalars.isoform(F.col("accession"))
    return b.protein.select("accession", canonical.alias("canonical"), own.alias("is_canonical"), index.alias("isoform_index"))


@query("seq_hash", "SELECT sequence_id, md5(sequence) AS hash FROM v_sequence")
def seq_hash(b: Bound):
    return b.sequence.select("sequence_id", F.md5("sequence").alias("hash"))


@query("fasta_header", "SELECT accession, entry_name AS entry, idx % 2 = 0 AS reviewed, organism, CAST(taxonomy_id AS STRING) AS taxonomy, gene_name FROM v_protein")
def fasta_header(b: Bound):
    own = b.protein
    header = F.concat(F.when(F.col("idx") % 2 == 0, "sp").otherwise("tr"), F.lit("|"), "accession", F.lit("|"), F.coalesce("entry_name", F.lit("")), F.lit(" protein OS="), "organism", F.lit(" OX="), F.col("taxonomy_id").cast("string"), F.lit(" GN="), "gene_name", F.lit(" PE=1 SV=1"))
    found = scalars.fasta_header(F.col("header"))
    return own.select(header.alias("header")).select(found["accession"].alias("accession"), F.nullif(found["entry_name"], F.lit("")).alias("entry"), found["reviewed"].alias("reviewed"), found["organism"].alias("organism"), found["taxonomy_id"].alias("taxonomy"), found["gene_name"].alias("gene_name"))


@query("eco_normalize", f"SELECT line_order, line_number, {evidence.in_sql('evidence_code')} AS code FROM v_annotation")
def eco_normalize(b: Bound):
    return b.annotation.select("line_order", "line_number", evidence.normalize(F.col("evidence_code")).alias("code"))


@query("is_experimental", f"SELECT evidence_code, {evidence.experimental_in_sql('evidence_code')} AS experimental, count(*) AS n FROM v_annotation GROUP BY 1, 2")
def is_experimental(b: Bound):
    return b.annotation.groupBy("evidence_code", evidence.is_experimental(F.col("evidence_code")).alias("experimental")).agg(F.count(F.lit(1)).alias("n"))


@query("not_negated", "SELECT line_order, line_number, qualifier FROM v_annotation WHERE qualifier IS NULL OR qualifier NOT LIKE '%NOT%'")
def not_negated(b: Bound):
    return b.annotation.filter(evidence.not_negated(F.col("qualifier"))).select("line_order", "line_number", "qualifier")


@query("evidence_weight", f"SELECT line_order, line_number, {evidence.weight_in_sql('evidence_code')} AS weight, CASE WHEN evidence_code IN ('IEA', 'ECO:0000501') THEN CAST(0.25 AS DOUBLE) ELSE {evidence.weight_in_sql('evidence_code')} END AS overridden FROM v_annotation")
def evidence_weight(b: Bound):
    return b.annotation.select("line_order", "line_number", evidence.weight(F.col("evidence_code")).alias("weight"), evidence.weight(F.col("evidence_code"), {"IEA": 0.25}).alias("overridden"))


@query("blank_to_null", "SELECT doc_id, nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE concat(' ', lang, ' ') END), '') AS lang FROM documents")
def blank_to_null(b: Bound):
    own = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "lang", F.lit(" ")))
    return b.table("documents").select("doc_id", scalars.blank_to_null(own).alias("lang"))


@query("tax_id_norm", "SELECT accession, CASE WHEN idx % 4 = 0 THEN NULL ELSE taxonomy_id END AS taxonomy_id FROM v_protein")
def tax_id_norm(b: Bound):
    raw = F.when(F.col("idx") % 8 == 0, "n/a").when(F.col("idx") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("taxonomy_id").cast("string"), F.lit(" ")))
    return b.protein.select("accession", scalars.tolerant_int(raw).alias("taxonomy_id"))


@query("search_ilike", "SELECT accession, entry_name, gene_name, organism FROM v_protein WHERE contains(lower(accession), 'ent1') OR contains(lower(coalesce(entry_name, '')), 'ent1') OR contains(lower(gene_name), 'ent1') OR contains(lower(organism), 'ent1')")
def search_ilike(b: Bound):
    return relational.search(b.protein, "ENT1", "accession", "entry_name", "gene_name", "organism").select("accession", "entry_name", "gene_name", "organism")


@query("dist_score", "SELECT protein, go_id, round(greatest(0, 1 - distance / 2), 6) AS half, round(greatest(0, 1 - distance), 6) AS full_score FROM v_prediction")
def dist_score(b: Bound):
    return b.prediction.select("protein", "go_id", F.round(scalars.distance_score(F.col("distance"), "half"), ROUND).alias("half"), F.round(scalars.distance_score(F.col("distance"), "full"), ROUND).alias("full_score"))


@query("clean_residues", "SELECT sequence_id, rtrim(regexp_replace(substr(regexp_replace(replace(sequence, chr(10), ''), '[UZOB]', 'X', 'g'), 1, 1022), '(.)', '\\1 ', 'g')) AS residues FROM v_sequence")
def clean_residues(b: Bound):
    """Residues of whole texts, as many as a model takes (1022)."""
    return b.sequence.select("sequence_id", F.rtrim(scalars.clean_residues(F.replace("sequence", F.lit("\n"), F.lit("")), 1022)).alias("residues"))


@query("chunk_spans", "SELECT doc_id, s AS chunk_start, least(s + 512, n_chars) AS chunk_end FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars, 448)) AS s FROM documents)")
def chunk_spans(b: Bound):
    own = b.table("documents").select("doc_id", F.explode(scalars.chunk_spans(F.col("n_chars").cast("int"), 512, 64)).alias("s"))
    return own.select("doc_id", F.col("s.start").cast("long").alias("chunk_start"), F.col("s.end").cast("long").alias("chunk_end"))


@query("method_label", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'reranker' WHEN o_orderkey % 2 = 0 THEN 'scored' ELSE 'baseline' END AS method FROM orders")
def method_label(b: Bound):
    reranker, scoring = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey"))
    return b.table("orders").select("o_orderkey", scalars.method_label(reranker, scoring).alias("method"))


# -- joins


def embedded(b: Bound):
    """Embeddings as rows of one configuration: sequence s<vec_id>, configuration vec_id % 2."""
    return b.table("embeddings").select(F.concat(F.lit("s"), "vec_id").alias("sequence_id"), (F.col("vec_id") % 2).cast("int").alias("config_id"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("x"))


@query("protein_embedding", "SELECT p.accession, round(CAST(e.embedding[1] AS DOUBLE), 6) AS x FROM v_protein p JOIN embeddings e ON p.idx = e.vec_id WHERE e.vec_id % 2 = 1")
def protein_embedding(b: Bound):
    own = b.protein.withColumn("sequence_id", F.concat(F.lit("s"), "idx"))
    return relational.with_vectors(own, embedded(b), 1).select("accession", "x")


@query("query_embedding", "SELECT concat('Q', item_id) AS query_id, round(CAST(e.embedding[1] AS DOUBLE), 6) AS x FROM benchmark JOIN embeddings e ON e.vec_id = item_id * 3 WHERE e.vec_id % 2 = 0")
def query_embedding(b: Bound):
    entries = b.table("benchmark").select(F.concat(F.lit("Q"), "item_id").alias("query_id"), F.concat(F.lit("s"), (F.col("item_id") * 3).cast("string")).alias("sequence_id"))
    return relational.with_vectors(entries, embedded(b), 0).select("query_id", "x")


@query("annotated_refs", "SELECT accession FROM v_protein WHERE accession IN (SELECT protein FROM v_old)")
def annotated_refs(b: Bound):
    return relational.annotated_only(b.protein, b.old).select("accession")


@query("annotation_aspect", "SELECT a.line_order, a.line_number, t.aspect, t.name FROM v_annotation a JOIN v_term t ON a.go_id = t.go_id")
def annotation_aspect(b: Bound):
    return relational.with_term(b.annotation.select("line_order", "line_number", "go_id"), b.term, "aspect", "name").select("line_order", "line_number", "aspect", "name")


@query("transfer", "SELECT query, rank, ref, round(distance, 6) AS distance, go_id, qualifier, evidence_code FROM v_hit")
def transfer_(b: Bound):
    return b.hits.select("query", "rank", "ref", F.round("distance", ROUND).alias("distance"), "go_id", "qualifier", "evidence_code")


@query("prediction_term", "SELECT p.protein, p.go_id, t.name, t.is_obsolete FROM v_prediction p JOIN v_term t ON p.go_id = t.go_id")
def prediction_term(b: Bound):
    return relational.with_term(b.prediction.select("protein", "go_id"), b.term, "name", "is_obsolete").select("protein", "go_id", "name", "is_obsolete")


@query("label", "SELECT p.protein, p.go_id, CASE WHEN EXISTS (SELECT 1 FROM v_truth t WHERE t.protein = p.protein AND t.go_id = p.go_id) THEN 1 ELSE 0 END AS label FROM v_prediction p")
def label(b: Bound):
    return relational.labelled(b.prediction, b.truth).select("protein", "go_id", "label")


@query("match_known", "SELECT p.protein, count(DISTINCT p.go_id) AS matched_terms FROM v_prediction p JOIN v_annotation a ON a.protein = p.protein AND a.go_id = p.go_id GROUP BY p.protein")
def match_known(b: Bound):
    return relational.matching_known(b.prediction, b.annotation)


@query("protein_metadata", "SELECT p.accession, d.lang, d.source, d.n_chars FROM v_protein p LEFT JOIN documents d ON d.doc_id = CAST(replace(p.canonical_accession, 'P', '') AS BIGINT)")
def protein_metadata(b: Bound):
    metadata = b.table("documents").select(F.concat(F.lit("P"), "doc_id").alias("canonical_accession"), "lang", "source", "n_chars")
    return b.protein.join(metadata, "canonical_accession", "left").select("accession", "lang", "source", "n_chars")


@query("protein_annotations", "SELECT a.line_order, a.line_number, a.protein, t.aspect, t.name, CASE WHEN a.in_old THEN 't0' ELSE 't1' END AS set_name, a.evidence_code FROM v_annotation a JOIN v_term t ON a.go_id = t.go_id")
def protein_annotations(b: Bound):
    """The annotations of every protein with their terms and sets."""
    sets = b.spark.createDataFrame([(True, "t0"), (False, "t1")], "in_old boolean, set_name string")
    own = b.annotation.drop("aspect").join(b.term.select("go_id", "aspect", "name"), "go_id").join(F.broadcast(sets), "in_old")
    return own.select("line_order", "line_number", "protein", "aspect", "name", "set_name", "evidence_code").orderBy("protein", "aspect", "name")


@query("set_counts", "SELECT n_nationkey, n_name, coalesce(c, 0) AS n_customers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 5000 GROUP BY 1) x ON c_nationkey = n_nationkey")
def set_counts(b: Bound):
    facts = b.table("customer").filter("c_acctbal > 5000").withColumnRenamed("c_nationkey", "n_nationkey")
    return relational.with_counts(b.table("nation").select("n_nationkey", "n_name"), facts, "n_nationkey", "n_customers")


@query("orphan_sequences", "SELECT doc_id AS sequence_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND doc_id NOT IN (SELECT item_id FROM benchmark)")
def orphan_sequences(b: Bound):
    own = b.table("documents").select(F.col("doc_id").alias("sequence_id"))
    return relational.without(own, (b.table("embeddings").withColumnRenamed("vec_id", "sequence_id"), "sequence_id"), (b.table("benchmark").withColumnRenamed("item_id", "sequence_id"), "sequence_id"))


@query("unindexed_embeddings", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def unindexed_embeddings(b: Bound):
    return relational.without(b.table("embeddings").select("vec_id"), (b.table("labels").withColumnRenamed("doc_id", "vec_id"), "vec_id"))


@query("pending_sequences", "SELECT doc_id AS sequence_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 1) AND doc_id IN (SELECT doc_id FROM labels)")
def pending_sequences(b: Bound):
    done = b.table("embeddings").select(F.col("vec_id").alias("sequence_id"), (F.col("vec_id") % 2).alias("config_id"))
    return relational.pending_sequences(b.table("documents").select(F.col("doc_id").alias("sequence_id")), done, 1, b.table("labels").select(F.col("doc_id").alias("sequence_id")))


@query("valid_refs", "SELECT p.accession IS NOT NULL AS protein_exists, t.go_id IS NOT NULL AS term_exists, count(*) AS n FROM v_annotation a LEFT JOIN v_protein p ON p.accession = a.protein LEFT JOIN (SELECT * FROM v_term WHERE NOT is_obsolete) t ON t.go_id = a.go_id GROUP BY 1, 2")
def valid_refs(b: Bound):
    marked = relational.valid_references(b.annotation, b.protein, b.term.filter("not is_obsolete"))
    return marked.groupBy("protein_exists", "term_exists").agg(F.count(F.lit(1)).alias("n"))


@query("drop_negatives", "SELECT line_order, line_number FROM v_annotation a WHERE NOT EXISTS (SELECT 1 FROM v_negative n WHERE n.protein = a.protein AND n.go_id = a.go_id)")
def drop_negatives(b: Bound):
    return b.annotation.join(graph.ruled_out(b.annotation, b.annotation, b.closed), ["protein", "go_id"], "left_anti").select("line_order", "line_number")


@query("prediction_set_list", "SELECT o_orderkey AS set_id, concat_ws(' ', n_name, r_name) AS label, c_name AS config, coalesce(n, 0) AS n_rows FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def prediction_set_list(b: Bound):
    newest = b.table("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)
    counts = b.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_rows"))
    joined = newest.join(b.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(b.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(b.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(counts, "o_orderkey", "left")
    return joined.select(F.col("o_orderkey").alias("set_id"), F.concat_ws(" ", "n_name", "r_name").alias("label"), F.col("c_name").alias("config"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


# -- aggregations


@query(
    "protein_stats",
    """SELECT count(*) AS total, sum(CASE WHEN is_canonical THEN 1 ELSE 0 END) AS canonical, sum(CASE WHEN reviewed THEN 1 ELSE 0 END) AS reviewed, count(DISTINCT canonical_accession) AS families,
 sum(CASE WHEN NOT is_canonical THEN 1 ELSE 0 END) AS isoforms, sum(CASE WHEN reviewed THEN 0 ELSE 1 END) AS unreviewed,
 (SELECT count(DISTINCT protein) FROM v_annotation WHERE protein IN (SELECT accession FROM v_protein)) AS with_annotation, (SELECT count(DISTINCT accession) FROM v_protein WHERE idx % 2 = 0) AS with_embedding,
 (SELECT count(DISTINCT accession) FROM v_protein WHERE canonical_accession IN (SELECT canonical_accession FROM v_metadata)) AS with_metadata FROM v_protein""",
)
def protein_stats(b: Bound):
    return summaries.protein_stats(b.protein, b.annotation, b.protein.filter("idx % 2 = 0"), b.view("v_metadata"))


@query("group_counts", "SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def group_counts(b: Bound):
    return relational.with_counts(b.table("nation").select("n_nationkey"), b.table("supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey", "n")


@query(
    "prediction_proteins",
    """SELECT p.protein, count(*) AS n_predictions, round(min(p.distance), 6) AS min_distance, coalesce(max(a.n), 0) AS n_annotations, coalesce(max(m.n), 0) AS n_matched, coalesce(bool_or(d.accession IS NOT NULL), FALSE) AS in_db
 FROM v_prediction p LEFT JOIN (SELECT protein, count(*) AS n FROM v_annotation GROUP BY 1) a ON a.protein = p.protein
 LEFT JOIN (SELECT p.protein, count(DISTINCT p.go_id) AS n FROM v_prediction p JOIN v_annotation a ON a.protein = p.protein AND a.go_id = p.go_id GROUP BY 1) m ON m.protein = p.protein
 LEFT JOIN v_protein d ON d.accession = p.protein GROUP BY p.protein""",
)
def prediction_proteins(b: Bound):
    return summaries.prediction_proteins(b.prediction, b.annotation, b.protein)


@query("term_distribution", "SELECT go_id, t.aspect, n, aspect_total FROM (SELECT go_id, aspect, count(*) AS n FROM v_prediction GROUP BY 1, 2 ORDER BY n DESC, go_id LIMIT 20) t JOIN (SELECT aspect, count(*) AS aspect_total FROM v_prediction GROUP BY 1) a ON a.aspect = t.aspect")
def term_distribution(b: Bound):
    return summaries.term_distribution(b.prediction)


@query("min_distance", "SELECT protein, go_id, round(min(distance), 6) AS min_distance FROM v_prediction WHERE distance <= 0.8 GROUP BY 1, 2")
def min_distance(b: Bound):
    return summaries.min_distance(b.prediction, 0.8)


@query("term_frequency", "SELECT go_id, count(*) AS go_term_frequency FROM v_old GROUP BY 1")
def term_frequency(b: Bound):
    return transfer.term_frequency(b.old)


@query("annotation_density", "SELECT protein AS ref, count(*) AS ref_annotation_density FROM v_old GROUP BY 1")
def annotation_density(b: Bound):
    return transfer.annotation_density(b.old)


@query("vote_count", "SELECT query AS protein, go_id, count(*) AS vote_count FROM v_hit GROUP BY 1, 2")
def vote_count(b: Bound):
    return transfer.votes(b.hits).select("protein", "go_id", "vote_count")


@query("distance_std", "SELECT query AS protein, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(distance) END, 6) AS neighbor_distance_std FROM v_neighbour GROUP BY 1")
def distance_std(b: Bound):
    return transfer.distance_std(b.neighbours).select("protein", F.round("neighbor_distance_std", ROUND).alias("neighbor_distance_std"))


def results(b: Bound):
    """Evaluation results read off orders: run, category, aspect, k, method, fmax."""
    return b.sql(RESULTS)


RESULTS = """
SELECT o_orderkey AS run, CASE o_orderkey % 3 WHEN 0 THEN 'NK' WHEN 1 THEN 'LK' ELSE 'PK' END AS category, CASE o_custkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'F' ELSE 'C' END AS aspect,
       CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE 50 END AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'reranker' WHEN '2-HIGH' THEN 'scored' ELSE 'baseline' END AS method,
       CAST(floor(o_totalprice) AS BIGINT) % 1000 / 1000.0 AS fmax FROM orders"""


@query("best_fmax", f"SELECT category, aspect, run, method, CAST(fmax AS DOUBLE) AS fmax FROM (SELECT *, row_number() OVER (PARTITION BY category, aspect ORDER BY fmax DESC, run) AS n FROM ({RESULTS})) WHERE n = 1")
def best_fmax(b: Bound):
    return summaries.best_results(results(b), "category", "aspect").withColumn("fmax", F.col("fmax").cast("double"))


@query("fmax_by_k", f"SELECT k, aspect, count(*) AS n, round(avg(CAST(fmax AS DOUBLE)), 6) AS avg_fmax, CAST(max(fmax) AS DOUBLE) AS best_fmax, CAST(min(fmax) AS DOUBLE) AS worst_fmax FROM ({RESULTS}) GROUP BY 1, 2")
def fmax_by_k(b: Bound):
    return summaries.fmax_by(results(b).withColumn("fmax", F.col("fmax").cast("double")), "k", "aspect")


@query("table_counts", "SELECT (SELECT count(*) FROM v_protein) AS proteins, (SELECT count(*) FROM v_annotation) AS annotations, (SELECT count(*) FROM v_term) AS terms, (SELECT count(*) FROM documents) AS sequences")
def table_counts(b: Bound):
    one = {"proteins": b.protein, "annotations": b.annotation, "terms": b.term, "sequences": b.table("documents")}
    out = None
    for name, df in one.items():
        c = df.agg(F.count(F.lit(1)).alias(name))
        out = c if out is None else out.crossJoin(c)
    return out


@query("pair_overlap", "SELECT count(*) AS pairs, count(p.go_id) AS matches, round(100.0 * count(p.go_id) / count(*), 4) AS percent FROM (SELECT DISTINCT protein, go_id FROM v_truth) t LEFT JOIN v_prediction p ON p.protein = t.protein AND p.go_id = t.go_id")
def pair_overlap(b: Bound):
    return summaries.pair_overlap(b.truth, b.prediction)


@query("prediction_set_detail", "SELECT protein, count(*) AS n, (SELECT count(*) FROM v_prediction) AS total FROM v_prediction GROUP BY 1")
def prediction_set_detail(b: Bound):
    per = b.prediction.groupBy("protein").agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("total"))))


@query(
    "protein_detail",
    """SELECT p.accession, p.entry_name, p.organism, p.gene_name, m.lang, m.source, m.n_chars, coalesce(n, 0) AS n_annotations, coalesce(e.n_embeddings, 0) AS n_embeddings, coalesce(i.isoforms, '') AS isoforms FROM v_protein p
 LEFT JOIN v_metadata m ON m.canonical_accession = p.canonical_accession LEFT JOIN (SELECT protein, count(*) AS n FROM v_annotation GROUP BY 1) a ON a.protein = p.accession
 LEFT JOIN (SELECT vec_id AS idx, count(*) AS n_embeddings FROM embeddings GROUP BY 1) e ON e.idx = p.idx
 LEFT JOIN (SELECT canonical_accession, string_agg(accession, ',' ORDER BY isoform_index) AS isoforms FROM v_protein WHERE NOT is_canonical GROUP BY 1) i ON i.canonical_accession = p.accession WHERE p.is_canonical""",
)
def protein_detail(b: Bound):
    vectors = b.table("embeddings").select(F.concat(F.lit("P"), "vec_id").alias("accession"))
    return summaries.protein_detail(b.protein.select("accession", "canonical_accession", "is_canonical", "isoform_index", "entry_name", "organism", "gene_name"), b.annotation, b.view("v_metadata"), vectors)


# -- ranking, sorting, paging


@query("topk", "SELECT query, CAST(rank AS INT) AS rank, ref, round(distance, 6) AS distance FROM v_neighbour WHERE rank <= 3")
def topk(b: Bound):
    return knn.top_k(b.neighbours.select("query", "ref", "distance"), 3).withColumn("distance", F.round("distance", ROUND))


@query("first_transfer", "SELECT protein, go_id, ref, round(distance, 6) AS distance, evidence_code, qualifier FROM v_prediction")
def first_transfer(b: Bound):
    return b.prediction.select("protein", "go_id", "ref", F.round("distance", ROUND).alias("distance"), "evidence_code", "qualifier")


@query("k_position", "SELECT query AS protein, go_id, min(rank) AS k_position FROM v_hit GROUP BY 1, 2")
def k_position(b: Bound):
    return transfer.votes(b.hits).select("protein", "go_id", "k_position")


@query("dedupe_best", "SELECT protein, go_id, round(1 - min(distance) / 2, 6) AS score FROM v_hit h JOIN (SELECT query AS q, query AS protein FROM v_neighbour GROUP BY 1) x ON x.q = h.query GROUP BY 1, 2")
def dedupe_best(b: Bound):
    scored = b.hits.select(F.col("query").alias("protein"), "go_id", (1 - F.col("distance") / 2).alias("score"))
    return relational.latest_first(scored, ["protein", "go_id"], [F.desc("score")]).withColumn("score", F.round("score", ROUND))


@query("dedupe_nearest", "SELECT query AS protein, go_id, round(min(distance), 6) AS distance FROM v_hit GROUP BY 1, 2")
def dedupe_nearest(b: Bound):
    near = b.hits.select(F.col("query").alias("protein"), "go_id", "distance")
    return relational.latest_first(near, ["protein", "go_id"], [F.asc("distance")]).withColumn("distance", F.round("distance", ROUND))


@query("page", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100")
def page(b: Bound):
    return relational.page(b.table("customer").select("c_custkey", "c_name", "c_acctbal"), [F.desc("c_acctbal"), "c_custkey"], 100, 50)


@query("protein_predictions", "SELECT p.protein, p.go_id, t.name, round(p.distance, 4) AS distance FROM v_prediction p JOIN v_term t ON t.go_id = p.go_id")
def protein_predictions(b: Bound):
    """The predictions of every protein, nearest first."""
    own = relational.with_term(b.prediction, b.term, "name")
    return own.select("protein", "go_id", "name", F.round("distance", 4).alias("distance")).orderBy("protein", "distance", "go_id")


@query("score_sort", f"SELECT protein, go_id, round((0.2 * (1 - distance / 2) + 0.8 * {evidence.weight_in_sql('evidence_code')}), 6) AS score FROM v_prediction ORDER BY score DESC")
def score_sort(b: Bound):
    scored = b.prediction.withColumn("score", score(b.prediction, PRESETS[4]))
    return scored.select("protein", "go_id", "score").orderBy(F.desc("score"), "protein", "go_id")


@query("dedupe_ingest", "SELECT protein, go_id, evidence_code, min(line_order * 10 + line_number) AS first_line FROM v_annotation GROUP BY 1, 2, 3")
def dedupe_ingest(b: Bound):
    lines = b.annotation.withColumn("first_line", F.col("line_order") * 10 + F.col("line_number"))
    return maintenance.first_occurrence(lines, ["protein", "go_id", "evidence_code"], ["first_line"]).select("protein", "go_id", "evidence_code", "first_line")
