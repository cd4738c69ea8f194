"""Queries of vector search, label transfer, features, scoring, graph and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence, scalars, vectors
from ..functions.scoring import PRESETS, score
from ..operators import evaluation, features, graph, knn, pooling, relational, transfer
from ..operators.graph import checkpointed
from ..sources import readers
from .bindings import Bound
from .registry import query

ROUND = 6
_Q, _R = "CAST(q.embedding AS DOUBLE[])", "CAST(r.embedding AS DOUBLE[])"
_PAIRS = "FROM embeddings q JOIN embeddings r ON r.vec_id = q.vec_id + 1"


def near_pairs(b: Bound):
    e = b.table("embeddings")
    return e.select("vec_id", F.col("embedding").alias("q")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("r")), "vec_id")


@query("cosine_distance", f"SELECT q.vec_id, round(1 - list_inner_product({_Q}, {_R}) / ((sqrt(list_inner_product({_Q}, {_Q})) + 1e-9) * (sqrt(list_inner_product({_R}, {_R})) + 1e-9)), 6) AS distance {_PAIRS}")
def cosine_distance(b: Bound):
    return near_pairs(b).select("vec_id", F.round(vectors.cosine_distance(F.col("q"), F.col("r")), ROUND).alias("distance"))


@query("l2_distance", f"SELECT q.vec_id, round(greatest(0, list_inner_product({_Q}, {_Q}) + list_inner_product({_R}, {_R}) - 2 * list_inner_product({_Q}, {_R})), 6) AS distance {_PAIRS}")
def l2_distance(b: Bound):
    return near_pairs(b).select("vec_id", F.round(vectors.squared_l2(F.col("q"), F.col("r")), ROUND).alias("distance"))


def _rounded(df):
    return df.withColumn("distance", F.round("distance", ROUND))


@query("knn_exact", "SELECT query, CAST(rank AS INT) AS rank, ref, round(distance, 6) AS distance FROM v_neighbour")
def knn_exact(b: Bound):
    return _rounded(b.neighbours)


@query("knn_ivf")
def knn_ivf(b: Bound):
    """Probes as measured for a recall of 0.95; the tests hold it against the exact search."""
    return _rounded(knn.knn_ivf(b.queries, b.references, 5))


@query("knn_ivf_all_cells", "SELECT query, CAST(rank AS INT) AS rank, ref, round(distance, 6) AS distance FROM v_neighbour")
def knn_ivf_all_cells(b: Bound):
    """All cells probed, so it must equal the exact search."""
    return _rounded(knn.knn_ivf(b.queries, b.references, 5, cells=8, probes=8))


@query("knn_lsh")
def knn_lsh(b: Bound):
    return _rounded(knn.knn_lsh(b.queries, b.references, 5))


@query(
    "knn_dedupe",
    f"""SELECT query, CAST(rank AS INT) AS rank, ref, round(distance, 6) AS distance FROM (
 SELECT query, ref, distance, row_number() OVER (PARTITION BY query ORDER BY distance, ref) AS rank FROM (
  SELECT concat('P', q.vec_id) AS query, p.canonical_accession AS ref, min(1 - list_inner_product({_Q}, {_R}) / ((sqrt(list_inner_product({_Q}, {_Q})) + 1e-9) * (sqrt(list_inner_product({_R}, {_R})) + 1e-9))) AS distance
  FROM embeddings q JOIN embeddings r ON q.vec_id % 10 = 0 JOIN v_protein p ON p.idx = r.vec_id GROUP BY 1, 2)) WHERE rank <= 3""",
)
def knn_dedupe(b: Bound):
    """One neighbour a canonical protein: isoforms are references of the same name, which count once before the cut."""
    named = b.references.join(b.protein.select(F.concat(F.lit("P"), "idx").alias("id"), "canonical_accession"), "id")
    return _rounded(knn.knn_exact(b.queries, named.select(F.col("canonical_accession").alias("id"), "vector"), 3))


_ASPECT = f"""SELECT aspect, query, CAST(rank AS INT) AS rank, ref, distance FROM (SELECT x.*, row_number() OVER (PARTITION BY aspect, query ORDER BY distance, ref) AS rank FROM (
 SELECT concat('P', q.vec_id) AS query, a.ref, a.aspect, 1 - list_inner_product({_Q}, {_R}) / ((sqrt(list_inner_product({_Q}, {_Q})) + 1e-9) * (sqrt(list_inner_product({_R}, {_R})) + 1e-9)) AS distance
 FROM embeddings q JOIN embeddings r ON q.vec_id % 10 = 0 JOIN (SELECT DISTINCT protein AS ref, aspect FROM v_old) a ON a.ref = concat('P', r.vec_id)) x) WHERE rank <= 5"""


def aspect_neighbours(b: Bound):
    return knn.knn_per_aspect(b.queries, b.references, b.old.select(F.col("protein").alias("ref"), "aspect"), 5)


@query("knn_per_aspect", f"SELECT aspect, query, rank, ref, round(distance, 6) AS distance FROM ({_ASPECT})")
def knn_per_aspect(b: Bound):
    return _rounded(aspect_neighbours(b))


@query("predict_terms", "SELECT protein, go_id, aspect, ref, round(distance, 6) AS distance, qualifier, evidence_code FROM v_prediction")
def predict_terms(b: Bound):
    return b.prediction.withColumn("distance", F.round("distance", ROUND))


@query(
    "predict_terms_aspect",
    f"""SELECT protein, go_id, aspect, ref, round(distance, 6) AS distance, qualifier, evidence_code FROM (
 SELECT n.query AS protein, a.go_id, a.aspect, n.ref, n.distance, a.qualifier, a.evidence_code, row_number() OVER (PARTITION BY n.query, a.go_id ORDER BY n.distance, n.rank, n.ref, a.evidence_code NULLS FIRST, a.qualifier NULLS FIRST) AS k
 FROM ({_ASPECT}) n JOIN v_old a ON a.protein = n.ref AND a.aspect = n.aspect WHERE a.qualifier IS NULL OR a.qualifier NOT LIKE '%NOT%') WHERE k = 1""",
)
def predict_terms_aspect(b: Bound):
    return transfer.predict_terms(aspect_neighbours(b), b.old_labels).withColumn("distance", F.round("distance", ROUND))


_FEATURES = """SELECT p.protein, p.go_id, p.aspect, p.ref, p.distance, p.qualifier, p.evidence_code, v.vote_count, v.k_position, f.n AS go_term_frequency, d.n AS ref_annotation_density, s.x AS neighbor_distance_std
 FROM v_prediction p JOIN (SELECT query, go_id, count(*) AS vote_count, min(rank) AS k_position FROM v_hit GROUP BY 1, 2) v ON v.query = p.protein AND v.go_id = p.go_id
 JOIN (SELECT go_id, count(*) AS n FROM v_old WHERE qualifier IS NULL OR qualifier NOT LIKE '%NOT%' GROUP BY 1) f ON f.go_id = p.go_id
 JOIN (SELECT protein, count(*) AS n FROM v_old WHERE qualifier IS NULL OR qualifier NOT LIKE '%NOT%' GROUP BY 1) d ON d.protein = p.ref
 JOIN (SELECT query, CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(distance) END AS x FROM v_neighbour GROUP BY 1) s ON s.query = p.protein"""


@query("reranker_features", f"SELECT protein, go_id, ref, round(distance, 6) AS distance, vote_count, CAST(k_position AS INT) AS k_position, go_term_frequency, ref_annotation_density, round(neighbor_distance_std, 6) AS neighbor_distance_std FROM ({_FEATURES})")
def reranker_features(b: Bound):
    f = transfer.reranker_features(b.neighbours, b.old_labels)
    return f.select("protein", "go_id", "ref", F.round("distance", ROUND).alias("distance"), "vote_count", "k_position", "go_term_frequency", "ref_annotation_density", F.round("neighbor_distance_std", ROUND).alias("neighbor_distance_std"))


@query("alignment_features")
def alignment_features(b: Bound):
    """Each turn of a conversation aligned with the next one: their whole texts as residues."""
    turns = b.table("conversations")

    def name(turn):
        return F.concat(F.lit("C"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))

    sequences = turns.select(name(F.col("turn")).alias("id"), F.regexp_replace(F.upper("text"), "[^A-Z]", "").alias("sequence")).filter("sequence != ''")
    return features.alignment_features(turns.select(name(F.col("turn")).alias("query"), name(F.col("turn") + 1).alias("ref")), sequences)


@query(
    "taxonomy_features",
    """SELECT c_custkey, a AS query_taxonomy_id, z AS ref_taxonomy_id, CASE WHEN a = z THEN a WHEN ra IS NULL OR rz IS NULL THEN NULL WHEN ra = rz THEN 100 + ra ELSE 1 END AS taxonomic_lca,
 CASE WHEN a = z THEN 0 WHEN ra IS NULL OR rz IS NULL THEN NULL WHEN ra = rz THEN 4 ELSE 6 END AS taxonomic_distance,
 CASE WHEN a = z THEN 1 WHEN ra IS NULL OR rz IS NULL THEN 0 WHEN ra = rz THEN 2 ELSE 1 END AS taxonomic_common_ancestors,
 CASE WHEN a = z THEN 'same' WHEN ra IS NULL OR rz IS NULL THEN 'unrelated' WHEN ra = rz THEN 'distant' ELSE 'root-only' END AS taxonomic_relation
 FROM (SELECT c_custkey, CAST(c_nationkey + 1000 AS INT) AS a, CASE WHEN c_custkey % 10 = 0 THEN 99 ELSE CAST(c_custkey % 25 + 1000 AS INT) END AS z FROM customer)
 LEFT JOIN (SELECT taxonomy_id AS t1, region AS ra FROM v_lineage) ON t1 = a LEFT JOIN (SELECT taxonomy_id AS t2, region AS rz FROM v_lineage) ON t2 = z""",
)
def taxonomy_features(b: Bound):
    pairs = b.table("customer").select("c_custkey", (F.col("c_nationkey") + 1000).cast("int").alias("query_taxonomy_id"), F.when(F.col("c_custkey") % 10 == 0, 99).otherwise(F.col("c_custkey") % 25 + 1000).cast("int").alias("ref_taxonomy_id"))
    return features.taxonomy_features(pairs, b.lineage)


_SIM = "greatest(0, least(1, 1 - distance / 2))"
_EV = evidence.weight_in_sql("evidence_code")


@query("compute_score", f"SELECT protein, go_id, round({_SIM}, 6) AS embedding_only, round((({_SIM} + {_EV}) / 2 * {_EV}), 6) AS plus_evidence, round((0.2 * {_SIM} + 0.8 * {_EV}), 6) AS evidence_primary FROM v_prediction")
def compute_score(b: Bound):
    p = b.prediction
    return p.select("protein", "go_id", score(p, PRESETS[0]).alias("embedding_only"), score(p, PRESETS[1]).alias("plus_evidence"), score(p, PRESETS[4]).alias("evidence_primary"))


@query("empty_features", "SELECT protein, go_id, CAST(NULL AS DOUBLE) AS identity_nw, CAST(NULL AS INT) AS length_query, CAST(NULL AS STRING) AS taxonomic_relation FROM v_prediction")
def empty_features(b: Bound):
    return transfer.complete_features(b.prediction).select("protein", "go_id", "identity_nw", "length_query", "taxonomic_relation")


# -- graph


@query("descendants", "SELECT ancestor, descendant FROM v_closure")
def descendants(b: Bound):
    return b.closure


@query("extend_descendants", "SELECT ancestor, descendant FROM v_closure")
def extend_descendants(b: Bound):
    """The closure of two thirds of the edges, with the others added."""
    first = F.crc32(F.concat("child", "parent")) % 3 != 0
    return graph.extend_descendants(graph.closed(b.edge.filter(first)), b.edge.filter(~first))


@query("term_levels", """WITH RECURSIVE up AS (SELECT go_id, 0 AS level FROM v_term UNION SELECT e.parent, level + 1 FROM up JOIN v_edge e ON e.child = up.go_id AND e.relation_type IN ('is_a', 'part_of') JOIN v_term p ON p.go_id = e.parent)
SELECT child, parent, min(a.level) AS level, min(b.level) AS parent_level FROM (SELECT DISTINCT child, parent FROM v_edge WHERE relation_type IN ('is_a', 'part_of')) JOIN (SELECT go_id, max(level) AS level FROM up GROUP BY 1) a ON a.go_id = child JOIN (SELECT go_id, max(level) AS level FROM up GROUP BY 1) b ON b.go_id = parent GROUP BY 1, 2""")
def term_levels(b: Bound):
    """Edges with the levels of their ends: the longest way up to a term from below."""
    return b.leveled


@query("negative_keys", "SELECT protein, go_id FROM v_negative")
def negative_keys(b: Bound):
    return b.negatives


_SUBGRAPH = """WITH RECURSIVE up AS (SELECT go_id, 0 AS depth FROM v_term WHERE t IN (101, 188, 150) UNION SELECT e.parent, depth + 1 FROM up JOIN v_edge e ON e.child = up.go_id WHERE depth < 3)
"""


def _seeds(b: Bound):
    return b.term.filter(F.col("t").isin(101, 188, 150))


@query("ancestor_subgraph", _SUBGRAPH + "SELECT DISTINCT go_id, go_id IN (SELECT go_id FROM v_term WHERE t IN (101, 188, 150)) AS is_query FROM up")
def ancestor_subgraph(b: Bound):
    return graph.ancestor_subgraph(_seeds(b), b.edge, 3)[0]


@query("ancestor_subgraph_edges", _SUBGRAPH + "SELECT DISTINCT e.child, e.parent, e.relation_type FROM up JOIN v_edge e ON e.child = up.go_id WHERE up.depth < 3")
def ancestor_subgraph_edges(b: Bound):
    return graph.ancestor_subgraph(_seeds(b), b.edge, 3)[1]


def scored(b: Bound):
    return b.prediction.select("protein", "go_id", "aspect", scalars.distance_score(F.col("distance")).alias("score"))


_SCORED = "SELECT protein, go_id, aspect, greatest(0, 1 - distance / 2) AS score FROM v_prediction"


@query("propagate_max", f"SELECT protein, go_id, round(max(score), 6) AS score FROM (SELECT protein, go_id, score FROM ({_SCORED}) UNION ALL SELECT s.protein, c.ancestor, s.score FROM ({_SCORED}) s JOIN v_closure c ON c.descendant = s.go_id) GROUP BY 1, 2")
def propagate_max(b: Bound):
    return graph.propagate_max(scored(b), graph.closing(b.edge)).withColumn("score", F.round("score", ROUND))


# -- evaluation


@query("experimental_by_ns", "SELECT protein, aspect, go_id FROM v_new_exp")
def experimental_by_ns(b: Bound):
    return b.new_exp


@query("release_delta", "SELECT * FROM v_new_exp EXCEPT SELECT * FROM v_old_exp")
def release_delta(b: Bound):
    return evaluation.release_delta(b.old_exp, b.new_exp)


@query("ground_truth", "SELECT category, protein, aspect, go_id FROM v_truth")
def ground_truth(b: Bound):
    return b.truth


@query("known_terms", "SELECT protein, aspect, go_id, EXISTS (SELECT 1 FROM v_truth t WHERE t.category = 'PK' AND t.protein = o.protein AND t.aspect = o.aspect) AS is_pk_known FROM v_old_exp o")
def known_terms(b: Bound):
    return evaluation.known_terms(b.old_exp, b.truth)


@query("evaluation_stats", "SELECT category, count(DISTINCT protein) AS proteins, count(*) AS pairs FROM v_truth GROUP BY 1")
def evaluation_stats(b: Bound):
    return evaluation.evaluation_stats(b.truth)


@query("delta_proteins", "SELECT DISTINCT protein FROM v_truth")
def delta_proteins(b: Bound):
    return evaluation.delta_proteins(b.truth)


@query("true_positives", "SELECT p.protein, count(*) AS n_true FROM v_prediction p JOIN (SELECT DISTINCT protein, go_id FROM v_truth) t ON t.protein = p.protein AND t.go_id = p.go_id GROUP BY 1")
def true_positives(b: Bound):
    return evaluation.true_positives(b.prediction, b.truth)


def curve_sql(scored_sql: str, truth_sql: str, keys: str = "") -> str:
    """The curve as a comparison of every threshold with every pair."""
    k, on = (f"{keys}, ", " AND ".join(f"p.{x.strip()} = g.{x.strip()}" for x in keys.split(","))) if keys else ("", "TRUE")
    groups = f"(SELECT DISTINCT {keys} FROM ({scored_sql}))" if keys else "(SELECT 1 AS one)"
    gk = ", ".join(f"g.{x.strip()}" for x in keys.split(",")) + ", " if keys else ""
    return f"""SELECT {k}threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1_exact FROM (
 SELECT {gk}t.threshold, CASE WHEN count(p.go_id) > 0 THEN count(h.go_id) / count(p.go_id) ELSE 0 END AS p, count(h.go_id) / (SELECT count(*) FROM (SELECT DISTINCT protein, go_id FROM ({truth_sql}))) AS r
 FROM (SELECT i * CAST(0.01 AS DOUBLE) AS threshold FROM range(101) x(i)) t CROSS JOIN {groups} g
 LEFT JOIN (SELECT {k}protein, go_id, max(score) AS score FROM ({scored_sql}) WHERE protein IN (SELECT protein FROM ({truth_sql})) GROUP BY ALL) p ON p.score >= t.threshold AND {on}
 LEFT JOIN (SELECT DISTINCT protein, go_id FROM ({truth_sql})) h ON h.protein = p.protein AND h.go_id = p.go_id GROUP BY {gk}t.threshold)"""


_LK = "SELECT protein, go_id FROM v_truth WHERE category = 'LK'"
_ALL_TRUTH = "SELECT protein, go_id FROM v_truth"


def fmax_sql(curve: str, keys: str = "") -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    k, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""SELECT {k}round(max(f1_exact), 4) AS fmax, round(arg_max(threshold, {{'f': f1_exact, 't': -threshold}}), 4) AS threshold_at_fmax, round(coalesce(sum(area), 0), 4) AS auc_pr FROM (
 SELECT *, (recall - lag(recall) OVER ({by}ORDER BY threshold DESC)) * (precision + lag(precision) OVER ({by}ORDER BY threshold DESC)) / 2 AS area FROM ({curve})) {group}"""


@query("pr_curve", f"SELECT threshold, precision, recall, f1 FROM ({curve_sql(_SCORED, _ALL_TRUTH)})")
def pr_curve(b: Bound):
    return evaluation.pr_curve(scored(b), b.truth).drop("f1_exact")


@query("fmax", fmax_sql(curve_sql(_SCORED, _ALL_TRUTH)))
def fmax(b: Bound):
    return evaluation.fmax(evaluation.pr_curve(scored(b), b.truth))


@query("compare_methods", f"SELECT round(b.fmax - a.fmax, 4) AS fmax_gain, round(b.auc_pr - a.auc_pr, 4) AS auc_gain FROM ({fmax_sql(curve_sql(_SCORED, _ALL_TRUTH))}) a CROSS JOIN ({fmax_sql(curve_sql(f'SELECT protein, go_id, round(({_SIM} + {_EV}) / 2 * {_EV}, 6) AS score FROM v_prediction', _ALL_TRUTH))}) b")
def compare_methods(b: Bound):
    p = b.prediction
    other = p.select("protein", "go_id", score(p, PRESETS[1]).alias("score"))
    return evaluation.compare(evaluation.fmax(evaluation.pr_curve(scored(b), b.truth)), evaluation.fmax(evaluation.pr_curve(other, b.truth)))


def configs(b: Bound):
    rows = [(c.name, c.formula, *[float(c.weights.get(s, 0.0)) for s in ("embedding_similarity", "identity_nw", "identity_sw", "evidence_weight", "taxonomic_proximity")]) for c in PRESETS]
    return b.spark.createDataFrame(rows, "config string, formula string, w_embedding_similarity double, w_identity_nw double, w_identity_sw double, w_evidence_weight double, w_taxonomic_proximity double")


_SWEEP = f"""SELECT config, protein, go_id, round(CASE config WHEN 'embedding_only' THEN {_SIM} WHEN 'alignment_weighted' THEN {_SIM} * 0.5 / 0.5 WHEN 'embedding_plus_evidence' THEN ({_SIM} + {_EV}) / 2 * {_EV}
 WHEN 'composite' THEN ({_SIM} * 0.4 + {_EV} * 0.2) / (CAST(0.4 AS DOUBLE) + 0.2) * {_EV} ELSE ({_SIM} * 0.2 + {_EV} * 0.8) / (CAST(0.2 AS DOUBLE) + 0.8) END, 6) AS score
 FROM v_prediction CROSS JOIN (SELECT unnest(['embedding_only', 'embedding_plus_evidence', 'alignment_weighted', 'composite', 'evidence_primary']) AS config)"""


@query("config_sweep", f"SELECT config, protein, go_id, score FROM ({_SWEEP})")
def config_sweep(b: Bound):
    return relational.sweep(b.prediction, configs(b)).drop("aspect")


_SETS = f"""SELECT 'nearest' AS prediction_set, config, protein, go_id, score FROM ({_SWEEP}) UNION ALL
 SELECT 'near', config, s.protein, s.go_id, score FROM ({_SWEEP}) s JOIN v_prediction p ON p.protein = s.protein AND p.go_id = s.go_id WHERE p.distance <= 0.7"""
_CATEGORIES = ("NK", "LK", "PK")


@query("experiment_sweep", " UNION ALL ".join(f"SELECT '{c}' AS category, * FROM ({fmax_sql(curve_sql(_SETS, f'SELECT protein, go_id FROM v_truth WHERE category = {c!r}', 'prediction_set, config'), 'prediction_set, config')}) WHERE EXISTS (SELECT 1 FROM v_truth WHERE category = '{c}')" for c in _CATEGORIES))
def experiment_sweep(b: Bound):
    """Prediction sets by configurations by categories: Fmax, its threshold and the area under the curve."""
    swept = relational.sweep(b.prediction, configs(b))
    near = b.prediction.filter("distance <= 0.7").select("protein", "go_id")
    sets = checkpointed(swept.withColumn("prediction_set", F.lit("nearest")).unionByName(swept.join(near, ["protein", "go_id"], "left_semi").withColumn("prediction_set", F.lit("near"))))
    groups = sets.select("prediction_set", "config").distinct()
    curve = evaluation.pr_curve(sets.drop("aspect"), b.truth, "prediction_set", "config", groups=groups, by=("category",))
    return evaluation.fmax(curve, "category", "prediction_set", "config")


_IA = "SELECT go_id, CAST(1 + t % 7 AS DOUBLE) / 4 AS ia FROM v_term WHERE t % 5 <> 0"


def ia(b: Bound):
    return b.term.filter("t % 5 <> 0").select("go_id", ((F.col("t") % 7 + 1).cast("double") / 4).alias("ia"))


def weighted_sql(category: str | None, known: bool, scored_sql: str = _SCORED, curve: bool = False) -> str:
    where = f"WHERE category = '{category}'" if category else ""
    gone = "AND NOT EXISTS (SELECT 1 FROM v_old_exp k WHERE k.protein = x.protein AND k.go_id = x.go_id)" if known else ""
    s = f"(SELECT protein, go_id, max(score) AS score FROM (SELECT protein, go_id, score FROM ({scored_sql}) UNION ALL SELECT s.protein, c.ancestor, s.score FROM ({scored_sql}) s JOIN v_closure c ON c.descendant = s.go_id) GROUP BY 1, 2)"
    t = f"(SELECT DISTINCT protein, go_id FROM (SELECT protein, go_id FROM v_truth {where} UNION ALL SELECT t.protein, c.ancestor FROM v_truth t JOIN v_closure c ON c.descendant = t.go_id {where}))"
    chosen = "SELECT aspect, round(threshold, 2) AS tau, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coverage, 6) AS coverage, n AS n_proteins FROM cur" if curve else "SELECT aspect, round(f, 4) AS fmax, round(precision, 4) AS precision, round(recall, 4) AS recall, round(threshold, 2) AS tau, round(coverage, 4) AS coverage, n AS n_proteins FROM best WHERE k = 1"
    return f"""WITH aspects AS (SELECT go_id, aspect FROM v_term), ia AS ({_IA}),
 tt AS (SELECT x.protein, x.go_id, a.aspect, coalesce(ia.ia, 1) AS ia FROM {t} x JOIN aspects a ON a.go_id = x.go_id LEFT JOIN ia ON ia.go_id = x.go_id WHERE TRUE {gone}),
 ss AS (SELECT x.protein, x.go_id, a.aspect, x.score, coalesce(ia.ia, 1) AS ia FROM {s} x JOIN aspects a ON a.go_id = x.go_id LEFT JOIN ia ON ia.go_id = x.go_id WHERE TRUE {gone}),
 tot AS (SELECT aspect, protein, sum(ia) AS total FROM tt GROUP BY 1, 2),
 per AS (SELECT th.threshold, s.aspect, s.protein, sum(s.ia) AS w, sum(CASE WHEN t.go_id IS NOT NULL THEN s.ia ELSE 0 END) AS hit, max(tot.total) AS total
  FROM (SELECT i * CAST(0.01 AS DOUBLE) AS threshold FROM range(1, 101) x(i)) th JOIN ss s ON s.score >= th.threshold JOIN tot ON tot.aspect = s.aspect AND tot.protein = s.protein
  LEFT JOIN tt t ON t.protein = s.protein AND t.go_id = s.go_id AND t.aspect = s.aspect GROUP BY 1, 2, 3),
 n AS (SELECT aspect, count(*) AS n FROM tot GROUP BY 1),
 cur AS (SELECT n.aspect, n.n, th.threshold, CASE WHEN count(p.protein) > 0 THEN coalesce(sum(p.hit / nullif(p.w, 0)), 0) / count(p.protein) ELSE 0 END AS precision, coalesce(sum(p.hit / p.total), 0) / n.n AS recall, count(p.protein) / n.n AS coverage
  FROM n CROSS JOIN (SELECT i * CAST(0.01 AS DOUBLE) AS threshold FROM range(1, 101) x(i)) th LEFT JOIN per p ON p.aspect = n.aspect AND p.threshold = th.threshold GROUP BY 1, 2, 3),
 ff AS (SELECT *, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f FROM cur),
 best AS (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY f DESC, threshold) AS k FROM ff)
{chosen}"""


@query("fmax_ia", " UNION ALL ".join(f"SELECT '{c}' AS category, * FROM ({weighted_sql(c, c == 'PK')})" for c in _CATEGORIES))
def fmax_ia(b: Bound):
    """Every category in one job; terms that PK proteins had in a namespace before are left out there."""
    known = b.old_exp.select(F.lit("PK").alias("category"), "protein", "go_id")
    return evaluation.fmax_weighted(scored(b), b.truth, ia(b), b.term, b.steps, known, by=("category",))


@query("pr_curve_ia", weighted_sql("NK", False, curve=True))
def pr_curve_ia(b: Bound):
    found = evaluation.weighted_curve(scored(b), b.truth.filter("category = 'NK'"), ia(b), b.term, b.steps)
    return found.select("aspect", "tau", *[F.round(c, ROUND).alias(c) for c in ("precision", "recall", "coverage")], "n_proteins")


_TOOL = "SELECT protein, go_id, aspect, max(CASE WHEN line_number = 4 THEN 1 ELSE line_number / 10.0 END)::DOUBLE AS score FROM v_annotation WHERE line_number <> 2 GROUP BY 1, 2, 3"


@query(
    "evaluate_external",
    f"""SELECT category, aspect, fmax, precision, recall, tau, coverage, n_proteins, round(100.0 * (SELECT count(DISTINCT protein) FROM v_truth t WHERE t.category = x.category AND t.protein IN (SELECT protein FROM ({_TOOL}))) / (SELECT count(DISTINCT protein) FROM v_truth t WHERE t.category = x.category), 2) AS covered_percent
 FROM ({" UNION ALL ".join(f"SELECT '{c}' AS category, * FROM ({weighted_sql(c, False, _TOOL)})" for c in _CATEGORIES)}) x""",
)
def evaluate_external(b: Bound):
    """A tool's own file, read and judged in each category, with the share of delta proteins that it has any term for."""
    from .files import pannzer_file

    path = b.folder("tool")
    readers.read_pannzer2(b.spark, pannzer_file(b)).write.parquet(path)
    tool = b.spark.read.parquet(path)
    found = evaluation.fmax_weighted(tool, b.truth, ia(b), b.term, b.steps, by=("category",))
    return found.join(evaluation.coverage(tool, b.truth, "category"), "category")


_GIVEN = "SELECT protein, go_id, CAST(min(line_number) AS DOUBLE) / 10 AS reranker_score FROM v_annotation WHERE line_number IN (1, 3) GROUP BY 1, 2"


@query(
    "eval_scores",
    f"""SELECT p.protein, p.go_id, round(coalesce(r.reranker_score, CASE WHEN p.aspect = 'F' THEN 0.2 * {_SIM} + 0.8 * {_EV} END, greatest(0, 1 - p.distance / 2)), 6) AS score,
 CASE WHEN r.reranker_score IS NOT NULL THEN 'reranker' WHEN p.aspect = 'F' THEN 'config' ELSE 'distance' END AS source
 FROM v_prediction p LEFT JOIN ({_GIVEN}) r ON r.protein = p.protein AND r.go_id = p.go_id WHERE distance <= 0.9 AND p.protein IN (SELECT protein FROM v_truth)""",
)
def eval_scores(b: Bound):
    """Scores for an evaluation: delta proteins only, within a distance, by re-ranker, else configuration (of one namespace here), else 1 - d/2."""
    given = b.annotation.filter("line_number in (1, 3)").groupBy("protein", "go_id").agg((F.min("line_number").cast("double") / 10).alias("reranker_score"))
    return evaluation.evaluation_scores(b.prediction, b.truth, {"F": PRESETS[4]}, given, 0.9)


# -- pooling


@query("l2_normalize", f"SELECT q.vec_id, i, round(CAST(q.embedding[i] AS DOUBLE) * 3 / sqrt(list_inner_product({_Q}, {_Q}) * 9), 5) AS x FROM embeddings q, range(1, 65) r(i)")
def l2_normalize(b: Bound):
    own = b.table("embeddings").select("vec_id", vectors.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return own.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 5).alias("x"))


@query(
    "agg_layers",
    """SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 5) AS mean, round(first(CAST(embedding[i] AS DOUBLE) ORDER BY vec_id), 5) AS last, round(first(CAST(embedding[i] AS DOUBLE) ORDER BY vec_id DESC), 5) AS joined_last FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2""",
)
def agg_layers(b: Bound):
    """Vectors of one label as the layers of one sequence, any number of them; of the joined vector the part of the deepest layer."""
    layers = b.table("embeddings").select(F.col("label").alias("sequence_id"), F.col("vec_id").alias("layer"), F.col("embedding").cast("array<double>").alias("vector"))
    found = {how: pooling.pool_layers(layers, how) for how in ("mean", "last", "concat")}
    found["concat"] = found["concat"].withColumn("embedding", F.slice("embedding", -64, 64))
    cells = [df.select(F.col("sequence_id").alias("label"), F.posexplode("embedding").alias("i", how)) for how, df in found.items()]
    both = cells[0].join(cells[1], ["label", "i"]).join(cells[2], ["label", "i"])
    return both.select("label", (F.col("i") + 1).cast("long").alias("i"), *[F.round(c, 5).alias(n) for c, n in (("mean", "mean"), ("last", "last"), ("concat", "joined_last"))])


@query(
    "chunk_pool",
    """SELECT sequence_id, chunk_start, chunk_end, i, round(avg(x), 5) AS mean, round(max(x), 5) AS largest FROM (
 SELECT CAST(floor(vec_id / 25) AS BIGINT) AS sequence_id, s AS chunk_start, least(s + 10, len) AS chunk_end, i, CAST(embedding[i] AS DOUBLE) AS x
 FROM embeddings JOIN (SELECT CAST(floor(vec_id / 25) AS BIGINT) AS sid, max(vec_id % 25) + 1 AS len FROM embeddings GROUP BY 1) l ON l.sid = CAST(floor(vec_id / 25) AS BIGINT), range(0, 25, 8) c(s), range(1, 65) r(i)
 WHERE s < len AND vec_id % 25 >= s AND vec_id % 25 < s + 10) GROUP BY 1, 2, 3, 4""",
)
def chunk_pool(b: Bound):
    """25 vectors in a row as the residues of one sequence, in chunks of 10 that share 2."""
    residues = b.table("embeddings").select(F.floor(F.col("vec_id") / 25).alias("sequence_id"), (F.col("vec_id") % 25).alias("position"), F.col("embedding").cast("array<double>").alias("vector"))
    pooled = pooling.pool_chunks(residues, "mean_max", size=10, overlap=2)
    half = F.col("i") < 64
    cells = pooled.select("sequence_id", "chunk_start", "chunk_end", F.posexplode("embedding").alias("i", "x"))
    return cells.groupBy("sequence_id", F.col("chunk_start").cast("long").alias("chunk_start"), F.col("chunk_end").cast("long").alias("chunk_end"), (F.col("i") % 64 + 1).cast("long").alias("i")).agg(F.round(F.max(F.when(half, F.col("x"))), 5).alias("mean"), F.round(F.max(F.when(~half, F.col("x"))), 5).alias("largest"))
