"""Domain tables derived from the driver's tables.

Each view is written once, in SQL that Spark and DuckDB both read. `Bound` gives them as DataFrames; `with_views` puts
those that a query names in front of it as common table expressions.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence
from ..operators import evaluation, features, graph, knn, transfer
from ..operators.graph import checkpointed

# `since` is the first release (0 to 3) that knows a line: by its date, later for every fifth protein and for one namespace of another fifth.
_ANNOTATION = """
SELECT concat('P', l_orderkey % n) AS protein, t.go_id, t.aspect, t.t,
       CASE WHEN l_quantity >= 49 THEN 'NOT|involved_in' WHEN l_linestatus = 'O' THEN 'enables' END AS qualifier,
       CASE l_linenumber WHEN 1 THEN 'IDA' WHEN 2 THEN 'IEA' WHEN 3 THEN 'ECO:0000314' WHEN 4 THEN 'ISS' WHEN 5 THEN 'IMP' WHEN 6 THEN 'ECO:0000501' END AS evidence_code,
       l_orderkey AS line_order, l_linenumber AS line_number, l_orderkey % n AS idx,
       l_shipdate < CAST('1999-01-01' AS TIMESTAMP) AND (l_orderkey % n) % 5 <> 0 AND NOT ((l_orderkey % n) % 5 = 1 AND t.aspect = 'C') AS in_old,
       CAST(greatest(CASE WHEN l_shipdate < CAST('1997-01-01' AS TIMESTAMP) THEN 0 WHEN l_shipdate < CAST('1999-01-01' AS TIMESTAMP) THEN 1 WHEN l_shipdate < CAST('2000-06-01' AS TIMESTAMP) THEN 2 ELSE 3 END,
                     CASE WHEN (l_orderkey % n) % 5 = 0 THEN 1 + floor((l_orderkey % n) / 5) % 3 WHEN (l_orderkey % n) % 5 = 1 AND t.aspect = 'C' THEN 1 + floor((l_orderkey % n) / 5) % 3 ELSE 0 END) AS INT) AS since
FROM lineitem CROSS JOIN (SELECT count(*) AS n FROM embeddings) c JOIN v_term t ON t.t = l_partkey
"""

VIEWS = {
    "v_protein": """
SELECT vec_id AS idx, CASE WHEN vec_id % 7 = 6 THEN concat('P', vec_id - 1, '-2') ELSE concat('P', vec_id) END AS accession,
       CASE WHEN vec_id % 7 = 6 THEN concat('P', vec_id - 1) ELSE concat('P', vec_id) END AS canonical_accession,
       vec_id % 7 <> 6 AS is_canonical, CASE WHEN vec_id % 7 = 6 THEN 2 END AS isoform_index,
       CASE WHEN vec_id % 13 <> 0 THEN concat('ENT', vec_id, '_', label) END AS entry_name, concat('organism ', vec_id % 25) AS organism,
       CAST(vec_id % 25 AS INT) AS taxonomy_id, concat('gene', label) AS gene_name, CASE WHEN vec_id % 11 <> 0 THEN vec_id % 3 = 0 END AS reviewed,
       vec_id % 10 = 0 AS is_query
FROM embeddings""",
    "v_term": """
SELECT t, concat('GO:', lpad(CAST(t AS STRING), 7, '0')) AS go_id, concat('term ', t) AS name,
       CASE t % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'P' ELSE 'C' END AS aspect, t % 97 = 0 AS is_obsolete
FROM (SELECT p_partkey AS t FROM part) x""",
    "v_edge": """
SELECT concat('GO:', lpad(CAST(child AS STRING), 7, '0')) AS child, concat('GO:', lpad(CAST(parent AS STRING), 7, '0')) AS parent, relation_type FROM (
  SELECT t AS child, 3 * CAST(floor(floor(t / 3) / 2) AS BIGINT) + t % 3 AS parent, 'is_a' AS relation_type FROM v_term WHERE t >= 3
  UNION ALL SELECT t, 3 * CAST(floor(floor(t / 3) / 3) AS BIGINT) + t % 3, 'part_of' FROM v_term WHERE t >= 3 AND floor(floor(t / 3) / 3) <> floor(floor(t / 3) / 2)
  UNION ALL SELECT t, t - 3, 'regulates' FROM v_term WHERE t >= 3) e""",
    "v_annotation": _ANNOTATION,
    "v_old": "SELECT * FROM v_annotation WHERE in_old",
    "v_lineage": "SELECT CAST(n_nationkey + 1000 AS INT) AS taxonomy_id, CAST(n_regionkey AS INT) AS region FROM nation",
    "v_metadata": "SELECT concat('P', doc_id) AS canonical_accession, lang, source, n_chars FROM documents WHERE doc_id % 3 <> 1",
    "v_sequence": "SELECT doc_id AS sequence_id, text AS sequence, md5(text) AS sequence_hash, source FROM documents",
}

#: Views that the two engines express differently: the SQL of the second one.
SQL_ONLY = {
    "v_neighbour": """
SELECT query, rank, ref, distance FROM (
  SELECT query, ref, distance, row_number() OVER (PARTITION BY query ORDER BY distance, ref) AS rank FROM (
    SELECT concat('P', q.vec_id) AS query, concat('P', r.vec_id) AS ref,
           1 - list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) /
             ((sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) + 1e-9) * (sqrt(list_inner_product(CAST(r.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))) + 1e-9)) AS distance
    FROM embeddings q JOIN embeddings r ON q.vec_id % 10 = 0)) WHERE rank <= 5""",
    "v_hit": """
SELECT n.query, n.rank, n.ref, n.distance, a.go_id, a.aspect, a.qualifier, a.evidence_code
FROM v_neighbour n JOIN v_old a ON a.protein = n.ref WHERE a.qualifier IS NULL OR a.qualifier NOT LIKE '%NOT%'""",
    "v_prediction": """
SELECT query AS protein, go_id, aspect, ref, distance, qualifier, evidence_code FROM (
  SELECT *, row_number() OVER (PARTITION BY query, go_id ORDER BY distance, rank, ref, evidence_code NULLS FIRST, qualifier NULLS FIRST) AS n FROM v_hit) WHERE n = 1""",
    "v_closure": """
SELECT * FROM (WITH RECURSIVE c AS (
  SELECT DISTINCT parent AS ancestor, child AS descendant FROM v_edge WHERE relation_type IN ('is_a', 'part_of')
  UNION SELECT c.ancestor, e.child FROM c JOIN v_edge e ON e.parent = c.descendant WHERE e.relation_type IN ('is_a', 'part_of'))
SELECT ancestor, descendant FROM c)""",
    "v_negative": """
SELECT DISTINCT protein, go_id FROM v_annotation WHERE qualifier LIKE '%NOT%'
UNION SELECT DISTINCT a.protein, c.descendant FROM v_annotation a JOIN v_closure c ON c.ancestor = a.go_id WHERE a.qualifier LIKE '%NOT%'""",
    "v_new_exp": f"""
SELECT DISTINCT protein, aspect, go_id FROM v_annotation a WHERE {evidence.experimental_in_sql("evidence_code")} AND (qualifier IS NULL OR qualifier NOT LIKE '%NOT%')
  AND aspect IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_negative n WHERE n.protein = a.protein AND n.go_id = a.go_id)""",
    "v_old_exp": f"""
SELECT DISTINCT protein, aspect, go_id FROM v_old a WHERE {evidence.experimental_in_sql("evidence_code")} AND (qualifier IS NULL OR qualifier NOT LIKE '%NOT%')
  AND aspect IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_negative n WHERE n.protein = a.protein AND n.go_id = a.go_id)""",
    "v_truth": """
SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM v_old_exp o WHERE o.protein = n.protein) THEN 'NK'
            WHEN NOT EXISTS (SELECT 1 FROM v_old_exp o WHERE o.protein = n.protein AND o.aspect = n.aspect) THEN 'LK' ELSE 'PK' END AS category,
       n.protein, n.aspect, n.go_id
FROM (SELECT * FROM v_new_exp EXCEPT SELECT * FROM v_old_exp) n""",
}
for _r in range(4):
    SQL_ONLY[f"v_neg{_r}"] = f"""
SELECT DISTINCT protein, go_id FROM v_annotation WHERE since <= {_r} AND qualifier LIKE '%NOT%'
UNION SELECT DISTINCT a.protein, c.descendant FROM v_annotation a JOIN v_closure c ON c.ancestor = a.go_id WHERE a.since <= {_r} AND a.qualifier LIKE '%NOT%'"""
    SQL_ONLY[f"v_exp{_r}"] = f"""
SELECT DISTINCT protein, aspect, go_id FROM v_annotation a WHERE since <= {_r} AND {evidence.experimental_in_sql("evidence_code")} AND (qualifier IS NULL OR qualifier NOT LIKE '%NOT%')
  AND NOT EXISTS (SELECT 1 FROM v_neg{_r} n WHERE n.protein = a.protein AND n.go_id = a.go_id)"""
_ALL = VIEWS | SQL_ONLY


def with_views(sql: str) -> str:
    """The query behind the definitions of all views it needs."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if name in _ALL and name not in needed:
                need(_ALL[name])
                needed.append(name)

    need(sql)
    own = sql.strip()
    if not needed:
        return own
    head = ",\n".join(f"{n} AS ({_ALL[n].strip()})" for n in needed)
    if own[:5].upper() == "WITH ":
        recursive = own[5:15].upper().startswith("RECURSIVE")
        return f"WITH RECURSIVE {head},\n{own[15:] if recursive else own[5:]}"
    return f"WITH RECURSIVE {head}\n{own}"


class Bound:
    """The domain tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._views: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            self._views[name] = self.sql(VIEWS[name])
        return self._views[name]

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What `make` gives, made at the first call."""
        if name not in self._views:
            self._views[name] = make()
        return self._views[name]

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the driver's tables and the shared views."""
        tables = "region nation customer supplier part orders lineitem events documents embeddings labels benchmark conversations pages".split()
        used = {n: self.table(n) for n in tables if re.search(rf"\b{n}\b(?!\s*\()", text) and re.search(rf"(?:FROM|JOIN)\s+{n}\b", text, re.IGNORECASE)}
        used |= {n: self.view(n) for n in VIEWS if re.search(rf"(?:FROM|JOIN)\s+{n}\b", text, re.IGNORECASE)}
        for n in used:
            text = re.sub(rf"((?:FROM|JOIN)\s+){n}\b", rf"\g<1>{{{n}}}", text, flags=re.IGNORECASE)
        return self.spark.sql(text, **used)

    protein = property(lambda self: self.view("v_protein"))
    term = property(lambda self: self.view("v_term"))
    edge = property(lambda self: self.view("v_edge"))
    annotation = property(lambda self: self.view("v_annotation"))
    old = property(lambda self: self.view("v_old"))
    sequence = property(lambda self: self.view("v_sequence"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.concat(F.lit("P"), "vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "vec_id")

    @property
    def queries(self) -> DataFrame:
        return self.vectors.filter("vec_id % 10 = 0").drop("vec_id")

    @property
    def references(self) -> DataFrame:
        """All vectors, those of the queries too."""
        return self.vectors.drop("vec_id")

    @cached_property
    def neighbours(self) -> DataFrame:
        return checkpointed(knn.knn_exact(self.queries, self.references, 5))

    @cached_property
    def old_labels(self) -> DataFrame:
        return self.old.select("protein", "go_id", "aspect", "qualifier", "evidence_code")

    @property
    def hits(self) -> DataFrame:
        return transfer.hits(self.neighbours, self.old_labels)

    @cached_property
    def prediction(self) -> DataFrame:
        return checkpointed(transfer.predict_terms(self.neighbours, self.old_labels))

    @cached_property
    def leveled(self) -> DataFrame:
        return graph.leveled(graph.within_aspect(self.edge, self.term))

    @cached_property
    def steps(self) -> DataFrame:
        """Edges of one aspect that a closure follows."""
        return checkpointed(graph.within_aspect(graph.closing(self.edge), self.term).select("child", "parent").distinct())

    @cached_property
    def closure(self) -> DataFrame:
        return graph.descendants(self.edge)

    @cached_property
    def closed(self) -> graph.Closure:
        """The closure by numbers."""
        return graph.closed(self.edge)

    @cached_property
    def negatives(self) -> DataFrame:
        return checkpointed(graph.negative_keys(self.annotation, self.edge, self.closure))

    @cached_property
    def ruled_out(self) -> DataFrame:
        """Of the experimental pairs of all lines, and so of the old ones and of each release, those that are negated, and since which release."""
        return checkpointed(graph.ruled_out(evaluation.experimental(self.annotation), self.annotation, self.closed, "since"))

    @cached_property
    def new_exp(self) -> DataFrame:
        return checkpointed(evaluation.experimental_by_namespace(self.annotation, self.ruled_out))

    @cached_property
    def old_exp(self) -> DataFrame:
        return checkpointed(evaluation.experimental_by_namespace(self.old, self.ruled_out))

    @cached_property
    def truth(self) -> DataFrame:
        return checkpointed(evaluation.ground_truth(self.old_exp, self.new_exp))

    def release(self, r: int) -> DataFrame:
        """The annotations that release r knows."""
        return self.annotation.filter(F.col("since") <= r)

    @cached_property
    def releases(self) -> tuple[str, ...]:
        return ("r0", "r1", "r2", "r3")

    def release_exp(self, name: str) -> DataFrame:
        """Experimental terms of a release, by namespace."""
        r = self.releases.index(name)
        return self.once(name, lambda: checkpointed(evaluation.experimental_by_namespace(self.release(r), self.ruled_out.filter(F.col("since") <= r))))

    @cached_property
    def lineage(self) -> DataFrame:
        """Nations below regions below one root."""
        own = self.view("v_lineage")
        root = self.spark.range(1).select(F.lit(1).alias("taxonomy_id"), F.lit(1).alias("parent"))
        return features.lineages(own.select("taxonomy_id", (F.col("region") + 100).alias("parent")).union(own.select((F.col("region") + 100), F.lit(1)).distinct()).union(root))

    def folder(self, name: str) -> str:
        """A new folder below the shared one, for files that a query writes and reads."""
        return f"{graph.shared_folder(self.spark, 'files')}/{name}-{uuid.uuid4().hex}"

    def kept(self, name: str, rows: DataFrame) -> DataFrame:
        """rows, written as Parquet, where columns without values take no room."""
        path = self.folder(name)
        rows.write.parquet(path)
        return self.spark.read.parquet(path)

    def text_file(self, name: str, lines: DataFrame, compression: str = "none") -> str:
        """Writes a one-column DataFrame as text and returns its folder."""
        path = self.folder(name)
        lines.write.option("compression", compression).text(path)
        return path
