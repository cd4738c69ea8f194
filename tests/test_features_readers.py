"""Lineages, places of lines over many files, pooling of layers, curves by group and routed models."""

import random

import pytest
from pyspark.sql import functions as F

from annoweave.operators import evaluation, features, pooling, reranker, transfer
from annoweave.sources import loads, readers


def lineages_of(spark, pairs):
    return {r.taxonomy_id: list(r.lineage) for r in features.lineages(spark.createDataFrame(pairs, "taxonomy_id int, parent int")).collect()}


def test_lineage_of_a_chain_and_a_forest(spark):
    chain = lineages_of(spark, [(1, 1), *[(i, i - 1) for i in range(2, 42)]])
    assert chain[41] == list(range(1, 42))
    assert chain[1] == [1]
    forest = lineages_of(spark, [(1, None), (2, 1), (3, 1), (10, 10), (11, 10), (12, 11), (20, 99), (21, 20)])
    assert forest == {1: [1], 2: [1, 2], 3: [1, 3], 10: [10], 11: [10, 11], 12: [10, 11, 12], 20: [20], 21: [20, 21]}
    assert lineages_of(spark, []) == {}


def test_no_lineage_on_or_below_a_cycle(spark):
    """Cycles of two and of five, taxa below them, and a table row that stands twice."""
    assert lineages_of(spark, [(1, 2), (2, 1), (3, 1), (4, 3), *[(10 + i, 10 + (i + 1) % 5) for i in range(5)], (30, 12), (7, None), (8, 7), (8, 7)]) == {7: [7], 8: [7, 8]}


def test_taxonomy_features_from_parents(spark):
    lineage = features.lineages(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (5, 6), (6, 5)], "taxonomy_id int, parent int"))
    pairs = spark.createDataFrame([(3, 4), (3, 5), (2, 3)], "query_taxonomy_id int, ref_taxonomy_id int")
    got = {tuple(r)[:2]: tuple(r)[2:] for r in features.taxonomy_features(pairs, lineage).collect()}
    assert got[3, 4] == (2, 4, 2, "distant")
    assert got[3, 5] == (None, None, 0, "unrelated")
    assert got[2, 3][3] == "ancestor"


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_the_last_line_counts_over_files_and_splits(spark, tmp_path, split):
    """Files of very uneven size, read in splits of 64 bytes or several files a split: the last line is that of the last file by name."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        for k, n in enumerate((400, 1, 90, 2)):
            (tmp_path / f"eco-{k}.txt").write_text("".join(f"ECO:{i % 3} {chr(65 + k)}{i}\n" for i in range(n)))
            (tmp_path / f"map-{k}.tsv").write_text("".join("\t".join([f"P{i % 3}", *"x" * 8, f"GO:{k}{i}"]) + "\n" for i in range(n)))
        eco = {r.eco_id: r.code for r in readers.read_eco_map(spark, f"{tmp_path}/eco-*.txt").collect()}
        assert eco == {"ECO:0": "D0", "ECO:1": "D1", "ECO:2": "C89"}
        terms = {r.protein: r.go_id for r in readers.read_emapper(spark, f"{tmp_path}/map-*.tsv").collect()}
        assert terms == {"P0": "GO:30", "P1": "GO:31", "P2": "GO:289"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_an_ontology_without_a_version_is_refused(spark, tmp_path):
    path = tmp_path / "x.obo"
    path.write_text("format-version: 1.2\n\n[Term]\nid: GO:1\nname: a\n")
    for read in (readers.read_obo_terms, readers.read_obo_edges):
        with pytest.raises(ValueError, match="data-version"):
            read(spark, str(path))


def test_layers_are_joined_in_order(spark):
    layers = spark.createDataFrame([("s", 2, [5.0, 6.0]), ("s", 0, [1.0, 2.0]), ("s", 1, [3.0, 4.0]), ("t", 7, [9.0, 9.0])], "sequence_id string, layer int, vector array<double>")
    got = {how: {r.sequence_id: list(r.embedding) for r in pooling.pool_layers(layers, how).collect()} for how in ("concat", "mean", "last")}
    assert got["concat"] == {"s": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "t": [9.0, 9.0]}
    assert got["mean"]["s"] == [3.0, 4.0]
    assert got["last"]["s"] == [1.0, 2.0]
    with pytest.raises(ValueError):
        pooling.pool_layers(layers, "other")


def test_curves_by_category_are_those_of_each_alone(spark):
    scored = spark.createDataFrame([("p", "a", "P", 0.9, "x"), ("p", "b", "F", 0.4, "x"), ("q", "a", "P", 0.7, "y"), ("r", "a", "P", 0.7, "y")], "protein string, go_id string, aspect string, score double, config string")
    truth = spark.createDataFrame([("NK", "p", "a", "P"), ("NK", "q", "b", "F"), ("PK", "q", "a", "P")], "category string, protein string, go_id string, aspect string")
    for by in (("category",), ("category", "aspect")):
        together = evaluation.pr_curve(scored, truth, "config", by=by)
        for cell in truth.select(*by).distinct().collect():
            own, part = truth, scored
            for c in by:
                own = own.filter(F.col(c) == cell[c])
                part = part.filter(F.col(c) == cell[c]) if c in part.columns else part
            alone = evaluation.pr_curve(part, own, "config", groups=scored.select("config").distinct())
            mine = together
            for c in by:
                mine = mine.filter(F.col(c) == cell[c])
            assert sorted(map(tuple, mine.drop(*by).collect())) == sorted(map(tuple, alone.collect()))
        assert together.select(*by).distinct().count() == truth.select(*by).distinct().count()  # cells without truth don't appear


def test_models_by_category_and_aspect(spark, monkeypatch):
    """A model for one aspect, one for all of a category, and the distance for the rest, rows without an aspect too."""
    monkeypatch.setattr(reranker, "apply", lambda model, df: df.withColumn("reranker_score", F.lit(model)))
    rows = spark.createDataFrame([(c, f"{c}{a}", "g", a, 0.5) for c in ("NK", "LK", "PK") for a in ("P", "F", None)], "category string, protein string, go_id string, aspect string, distance double")
    got = {(r.category, r.aspect): (r.score, r.source) for r in reranker.route({"NK": {"P": 0.1}, "LK": {"": 0.2, "P": 0.9}}, rows).collect()}
    assert len(got) == 9
    assert got["NK", "P"] == (0.1, "model")
    assert got["NK", "F"] == got["NK", None] == got["PK", "P"] == (0.75, "distance")
    assert got["LK", "P"] == got["LK", None] == (0.2, "model")
    assert {r.score for r in reranker.route({}, rows).collect()} == {0.75}


def test_loads_by_their_own_rules(spark, tmp_path):
    """GAF knows canonical accessions, QuickGO plain ones; codes are mapped before keys are compared; keys of the table stay."""
    proteins = spark.createDataFrame([("P1", "P1"), ("P1-2", "P1"), ("P2", "P2")], "accession string, canonical_accession string")
    terms = spark.createDataFrame([("GO:1",)], "go_id string")

    def gaf(protein, evidence, reference, go="GO:1"):
        return "\t".join(["U", protein, "", "enables", go, reference, evidence, "", *"x" * 5, "2024", "by"])

    (tmp_path / "a.gaf").write_text("\n".join(["!x", gaf("P1", "IEA", "first"), gaf("P1", "IEA", "second"), gaf("P1-2", "IEA", "isoform"), gaf("P2", "", "none"), gaf("P2", "", "again"), gaf("P2", "IDA", "x", "GO:9")]) + "\n")
    rows = readers.read_gaf(spark, f"{tmp_path}/a.gaf", places=True)
    got = loads.load_gaf(rows, proteins, terms)
    assert sorted((r.protein, r.evidence_code or "", r.db_reference) for r in got.collect()) == [("P1", "IEA", "first"), ("P2", "", "none")]
    again = loads.load_gaf(rows, proteins, terms, existing=got.filter("protein = 'P2'").withColumn("db_reference", F.lit("old")))
    assert sorted((r.protein, r.db_reference) for r in again.collect()) == [("P1", "first"), ("P2", "old")]
    (tmp_path / "q.tsv").write_text("GENE PRODUCT ID\tQUALIFIER\tGO TERM\tECO ID\nP1-2\t\tGO:1\tECO:1\nP1-2\tlate\tGO:1\tIDA\nP1\tq\tGO:1\tECO:2\nP3\t\tGO:1\tECO:1\n")
    eco = spark.createDataFrame([("ECO:1", "IDA")], "eco_id string, code string")
    found = loads.load_quickgo(readers.read_quickgo(spark, f"{tmp_path}/q.tsv", places=True), proteins, terms, eco)
    assert sorted((r.protein, r.evidence_code, r.qualifier or "", r.with_from) for r in found.collect()) == [("P1", "ECO:2", "q", None), ("P1-2", "IDA", "", None)]


@pytest.mark.parametrize("local", [False, True])
def test_pairs_aligned_together_are_aligned_as_alone(local):
    """Texts of all lengths side by side, few and many letters, ties, unknown letters, empty texts, and one too long for packed counts."""
    draw = random.Random(5)
    for letters in ("A", "AR", "ARNDCQEGHILKMFPSTWYVBZX*", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACJx*é"):
        pairs = [tuple("".join(draw.choices(letters, k=draw.randint(1, 30))) for _ in "ab") for _ in range(60)]
        groups = list(features.alike([(len(a), len(b)) for a, b in pairs], 200))
        assert sorted(i for g in groups for i in g) == list(range(60))
        found = {i: row for g in groups for i, row in zip(g, features.align_together([pairs[i] for i in g], local), strict=True)}
        assert [found[i] for i in range(60)] == [features.align(a, b, local) for a, b in pairs]
    odd = [("", "ACE"), ("ACE", "ACE"), ("ACDE" * 700, "ACD" * 800)]
    assert features.align_together(odd[:2], local) == [features.align(a, b, local) for a, b in odd[:2]]
    assert features.align_together(odd[2:], local) == [features.align(*odd[2], local)]


def test_features_move_a_hit_twice(spark):
    """All features of a term's nearest hit, only of the named proteins, in a plan that joins annotations once with the neighbours."""
    neighbours = spark.createDataFrame([("q", 1, "r", 0.1), ("q", 2, "s", 0.3), ("z", 1, "r", 0.2)], "query string, rank int, ref string, distance double")
    lines = [("r", "G1", "F", None, "IDA"), ("r", "G1", "F", None, "IEA"), ("s", "G1", "F", None, None), ("s", "G2", "P", "NOT", "IDA"), ("s", "G3", "P", None, "IDA")]
    annotations = spark.createDataFrame(lines, "protein string, go_id string, aspect string, qualifier string, evidence_code string")
    out = transfer.reranker_features(neighbours, annotations, spark.createDataFrame([("q",)], "protein string"))
    got = sorted(tuple(r)[:-1] for r in out.collect())
    assert got == [("q", "r", "G1", "F", 0.1, None, "IDA", 3, 1, 3, 2), ("q", "s", "G3", "P", 0.3, None, "IDA", 1, 2, 1, 2)]
    assert abs(out.first()["neighbor_distance_std"] - 0.1) < 1e-9
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 2
