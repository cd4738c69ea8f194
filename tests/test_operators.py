"""Toy cases of the operators, worked by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from annoweave.functions import evidence, scalars, vectors
from annoweave.functions.scoring import PRESETS, ScoringConfig, score
from annoweave.operators import evaluation, features, graph, knn, maintenance, pooling, reranker
from annoweave.sources import readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_isoforms(spark):
    df = spark.createDataFrame([("P1-2",), ("P1",), ("A-B-12",), ("A-x",)], "a string")
    c, own, i = scalars.isoform(F.col("a"))
    assert rows(df.select("a", c, own, i)) == [("A-B-12", "A-B", False, 12), ("A-x", "A-x", True, None), ("P1", "P1", True, None), ("P1-2", "P1", False, 2)]


def test_evidence(spark):
    df = spark.createDataFrame([("ECO:0000314",), ("IEA",), ("??",), ("",), (None,)], "c string")
    found = {r[0]: tuple(r[1:]) for r in df.select("c", evidence.normalize(F.col("c")), evidence.is_experimental(F.col("c")), evidence.weight(F.col("c")), evidence.weight(F.col("c"), {"ECO:0000314": 0.2, "IEA": 0.9})).collect()}
    assert found["ECO:0000314"] == ("IDA", True, 1.0, 1.0)
    assert found["IEA"] == ("IEA", False, 0.3, 0.9)
    assert found["??"][1:] == (False, 0.5, 0.5) and found[None][1:] == (False, 0.5, 0.5) and found[""][2] == 0.5


def test_scores(spark):
    df = spark.createDataFrame([(0.0, "IDA", 0.5), (1.0, None, None), (2.0, "IEA", 1.0)], "distance double, evidence_code string, identity_nw double")
    assert [r[0] for r in df.select(score(df, PRESETS[0])).collect()] == [1.0, 0.5, 0.0]
    assert [r[0] for r in df.select(score(df, ScoringConfig("x", {"embedding_similarity": 0.5, "identity_nw": 0.5}))).collect()] == [0.75, 0.5, 0.5]
    assert [r[0] for r in df.select(score(df, ScoringConfig("none", {}))).collect()] == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        ScoringConfig("x", {}, "other")


def test_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0]), ([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(vectors.squared_l2(F.col("a"), F.col("b")), vectors.cosine_distance(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == 25.0 and abs(got[1][1]) < 1e-6 and abs(got[2][1] - 1) < 1e-6


def vectors_of(spark, n, dim, seed, name):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x, spark.createDataFrame([(f"{name}{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_knn_exact_and_cells(spark, metric):
    q, dq = vectors_of(spark, 17, 6, 1, "q")
    r, dr = vectors_of(spark, 90, 6, 2, "r")
    d = knn.distances(q.astype(np.float32), r.astype(np.float32), metric)
    expected = {(f"q{i:03d}", k + 1, f"r{j:03d}") for i in range(17) for k, j in enumerate(np.argsort(d[i])[:4])}
    assert {tuple(x)[:3] for x in knn.knn_exact(dq, dr, 4, metric, rows=7).collect()} == expected
    assert {tuple(x)[:3] for x in knn.knn_ivf(dq, dr, 4, cells=5, probes=5, metric=metric).collect()} == expected
    some = [tuple(x)[:3] for x in knn.knn_ivf(dq, dr, 4, cells=5, probes=2, metric=metric).collect()]
    assert len(some) == 4 * 17  # queries that find too few are searched exactly


@pytest.mark.parametrize("index", [knn.knn_ivf, knn.knn_lsh])
def test_recall_of_the_indexes(spark, sf_dir, index):
    """All vectors of a table are indexed and every tenth is a query; found with the settings of the registered queries."""
    from annoweave.plans.bindings import Bound

    b = Bound(spark, sf_dir)
    exact = {(r.query, r.ref) for r in knn.knn_exact(b.queries, b.references, 5).collect()}
    found = [(r.query, r.ref) for r in index(b.queries, b.references, 5).collect()]
    assert len(found) == len(exact) and len(exact & set(found)) >= 0.9 * len(exact)


def test_knn_ties_and_threshold(spark):
    dq = spark.createDataFrame([("q", [1.0, 0.0])], "id string, vector array<double>")
    dr = spark.createDataFrame([(f"r{i}", [1.0, 0.0]) for i in range(9)] + [("z", [0.0, 1.0])], "id string, vector array<double>")
    assert [r.ref for r in knn.knn_exact(dq, dr, 1, rows=20).collect()] == ["r0"]
    assert [r.ref for r in knn.knn_exact(dq, dr, 3, rows=4).collect()] == ["r0", "r1", "r2"]
    assert knn.block_search(dq, dr.coalesce(1), 2, "cosine", None, 300).count() == 2  # ties don't multiply
    many = spark.createDataFrame([("a", [1.0, 0.01 * i]) for i in range(9)] + [("b", [1.0, 0.2])], "id string, vector array<double>").coalesce(1)
    assert [r.ref for r in knn.knn_exact(dq, many, 2).orderBy("rank").collect()] == ["a", "b"]  # a reference of many rows counts once
    assert knn.knn_exact(dq, dr, 20, threshold=0.5).count() == 9


def test_closure(spark):
    def edges(*pairs):
        return spark.createDataFrame([(c, p, "is_a") for p, c in pairs], "child string, parent string, relation_type string")

    assert rows(graph.descendants(edges(("a", "b"), ("b", "c")))) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert rows(graph.descendants(edges(("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")))) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "d"), ("c", "d")]
    assert ("a", "a") in rows(graph.descendants(edges(("a", "b"), ("b", "a"))))


def test_closure_of_a_long_chain_and_a_given_one(spark):
    e = spark.createDataFrame([(f"n{i + 1:02d}", f"n{i:02d}", "is_a") for i in range(20)], "child string, parent string, relation_type string")
    closure = graph.descendants(e)
    assert closure.count() == 20 * 21 // 2
    a = spark.createDataFrame([("P", "n18", "NOT|x")], "protein string, go_id string, qualifier string")
    assert rows(graph.negative_keys(a, e.limit(0), closure)) == [("P", "n18"), ("P", "n19"), ("P", "n20")]


def test_negatives_go_down(spark):
    e = spark.createDataFrame([("b", "a", "is_a"), ("c", "b", "part_of"), ("d", "a", "regulates")], "child string, parent string, relation_type string")
    a = spark.createDataFrame([("P", "a", "NOT|x"), ("P", "d", None)], "protein string, go_id string, qualifier string")
    assert rows(graph.negative_keys(a, e)) == [("P", "a"), ("P", "b"), ("P", "c")]


@pytest.mark.parametrize(
    ("old", "new", "expected"),
    [
        ([], [("P1", "F", "1"), ("P1", "F", "2")], [("NK", "P1", "F", "1"), ("NK", "P1", "F", "2")]),
        ([("P1", "F", "1")], [("P1", "F", "1"), ("P1", "P", "2")], [("LK", "P1", "P", "2")]),
        ([("P1", "F", "1")], [("P1", "F", "1"), ("P1", "F", "2")], [("PK", "P1", "F", "2")]),
        ([("P1", "F", "1")], [("P1", "F", "1"), ("P1", "F", "2"), ("P1", "C", "3")], [("LK", "P1", "C", "3"), ("PK", "P1", "F", "2")]),
        ([("P1", "F", "1")], [("P1", "F", "1")], []),
        ([("P1", "F", "1")], [], []),
    ],
)
def test_ground_truth(spark, old, new, expected):
    schema = "protein string, aspect string, go_id string"
    assert rows(evaluation.ground_truth(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))) == expected


def metrics(spark, predictions, truth):
    s = spark.createDataFrame(predictions, "protein string, go_id string, score double")
    t = spark.createDataFrame(truth, "protein string, go_id string")
    curve = evaluation.pr_curve(s, t)
    assert curve.count() == 101
    return evaluation.fmax(curve).first()


def test_fmax(spark):
    assert metrics(spark, [], [("P", "1")]).fmax == 0
    assert metrics(spark, [("P", "1", 1.0)], [("P", "1")]).fmax == 1
    assert metrics(spark, [("P", "9", 1.0)], [("P", "1")]).fmax == 0
    assert metrics(spark, [("P", "1", 1.0), ("Q", "7", 1.0)], [("P", "1")]).fmax == 1
    assert 0 < metrics(spark, [("P", "1", 1.0)], [("P", "1"), ("P", "2")]).fmax < 1


def test_thresholds_in_double_arithmetic(spark):
    values = [i / 100 for i in range(101)] + [0.285, 1.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    got = [r[0] for r in df.select(evaluation.reached(F.col("s"))).collect()]
    assert got == [sum(v >= i * 0.01 for i in range(101)) for v in values]


def test_alignment():
    assert features.align("ACE", "ACE")[:1] == (1.0,)
    identity, _, _, gaps, length = features.align("AE", "ACE")
    assert (length, gaps) == (3.0, 1 / 3) and identity == 2 / 3
    assert features.align("", "")[4] == 0.0
    local = features.align("WWWAAAA", "CCCWWWC", local=True)
    assert local[0] == 1.0 and local[2] == 33.0 and local[4] == 3.0


def test_taxonomy(spark):
    lineage = spark.createDataFrame([(1, [1]), (9, [1, 9]), (5, [1, 9, 5]), (6, [1, 9, 6]), (7, [1, 7])], "taxonomy_id int, lineage array<int>")
    pairs = spark.createDataFrame([(5, 6), (5, 5), (5, 9), (9, 5), (5, 7), (5, None)], "query_taxonomy_id int, ref_taxonomy_id int")
    got = {(r[0], r[1]): tuple(r[2:]) for r in features.taxonomy_features(pairs, lineage).collect()}
    assert got[5, 6] == (9, 4, 2, "distant") and got[5, 5] == (5, 0, 1, "same")
    assert got[9, 5][3] == "ancestor" and got[5, 9][3] == "descendant" and got[5, 7][3] == "root-only"
    assert got[5, None] == (None, None, 0, "unrelated")


def test_upsert_twice_changes_nothing(spark):
    schema = "k string, a string, c int"
    old, new = spark.createDataFrame([("x", "", 1), ("y", "v", 1)], schema), spark.createDataFrame([("x", "n", 2), ("y", "n", 1), ("z", None, 3)], schema)
    once = maintenance.upsert_fill(old, new, "k", ["a"], ["c"])
    assert rows(once) == [("x", "n", 2, "updated"), ("y", "v", 1, "kept"), ("z", None, 3, "inserted")]
    again = maintenance.upsert_fill(once.drop("change"), new, "k", ["a"], ["c"])
    assert {r.change for r in again.collect()} == {"kept"}


def test_upsert_leaves_what_is_not_offered(spark):
    schema = "k string, a string, c int"
    old, new = spark.createDataFrame([("A", "", 1), ("B", None, 1), ("C", "", 1)], schema), spark.createDataFrame([("C", "n", 2)], schema)
    assert sorted(map(tuple, maintenance.upsert_fill(old, new, "k", ["a"], ["c"]).collect())) == [("A", "", 1, "kept"), ("B", None, 1, "kept"), ("C", "n", 2, "updated")]


def test_vacuum_and_rejection(spark):
    df, users = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int"), spark.createDataFrame([(2,), (9,), (None,)], "u int")
    stays, goes = maintenance.vacuum(df, "k", (users, "u"))
    assert rows(stays) == [(2,), (2,)] and rows(goes) == [(1,), (3,)]
    with pytest.raises(ValueError, match="k occurs more than once: 2"):
        maintenance.reject_duplicates(df, "k")
    assert maintenance.reject_duplicates(df.distinct(), "k").count() == 3


def test_insert_ignore_and_nulls(spark):
    schema = "k string, e string"
    old, new = spark.createDataFrame([("a", None)], schema), spark.createDataFrame([("a", None), ("b", "x")], schema)
    assert maintenance.insert_ignore(old, new, ["k", "e"]).count() == 2
    assert maintenance.insert_ignore(old, new, ["k", "e"], null_safe=False).count() == 3


def test_chunks(spark):
    df = spark.createDataFrame([(0,), (5,), (10,)], "n int")
    got = [[tuple(s) for s in r[0]] for r in df.select(scalars.chunk_spans(F.col("n"), 4, 1)).collect()]
    assert got == [[], [(0, 4), (3, 5)], [(0, 4), (3, 7), (6, 10), (9, 10)]]
    with pytest.raises(ValueError):
        scalars.chunk_spans(F.col("n"), 4, 4)


def test_pooling(spark):
    df = spark.createDataFrame([("s", 0, [1.0, 0.0]), ("s", 1, [3.0, 2.0]), ("s", 2, [5.0, 9.0])], "sequence_id string, position int, vector array<double>")
    got = {r.chunk_start: list(r.embedding) for r in pooling.pool_chunks(df, "mean_max", 2).collect()}
    assert got == {0: [2.0, 1.0, 3.0, 2.0], 2: [5.0, 9.0, 5.0, 9.0]}
    assert [math.hypot(*r.embedding) for r in pooling.pool_chunks(df, "mean", 3, normalize=True).collect()] == [pytest.approx(1)]
    assert [list(r.embedding) for r in pooling.pool_chunks(df, "cls").collect()] == [[1.0, 0.0]]


def test_split_keeps_both_labels(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(50)], "id int, label int")
    split = reranker.stratified_split(df, ["id"], 0.2)
    assert {(r[0], r[1]): r[2] for r in split.groupBy("label", "is_val").count().collect()} == {(1, True): 1, (1, False): 2, (0, True): 9, (0, False): 38}
    with pytest.raises(ValueError):
        reranker.temporal_pairs(["a", "b"], {"a"})


def test_places_by_ranges_are_those_of_one_sort(spark):
    df = spark.createDataFrame([(i, int(i % 50 == 0)) for i in range(3_000)], "id int, label int")
    order = reranker.hash_order(["id"], 7)
    got = {r.id: r._n for r in reranker.numbered(df, ["label"], order, digits=2).collect()}
    hashes = {r.id: (r.label, r.h) for r in df.withColumn("h", order).collect()}
    for label in (0, 1):
        own = sorted((h, i) for i, (x, h) in hashes.items() if x == label)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))


def test_one_negative_at_least(spark):
    df = spark.createDataFrame([(i, 0, i % 2 == 0) for i in range(10)], "id int, label int, is_val boolean")
    assert {(r.is_val, r["count"]) for r in reranker.sample_negatives(df, ["id"], 5.0).groupBy("is_val").count().collect()} == {(True, 1), (False, 1)}


def test_auc(spark):
    rng = np.random.default_rng(6)
    y, p = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    won = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "label int, reranker_score double")
    assert reranker.auc(df).first().auc == pytest.approx(np.mean(won))
    assert reranker.auc(df.filter("label = 1")).first().auc is None


def test_a_fitted_model_is_judged_and_flags_what_is_missing(spark):
    rng = np.random.default_rng(2)
    data = [(f"P{i}", "g", "P", float(x) if i % 3 else None, int(x > 0.5) if i % 3 else i % 2) for i, x in enumerate(rng.random(600))]
    df = reranker.stratified_split(reranker.prepare_features(spark.createDataFrame(data, "protein string, go_id string, aspect string, distance double, label int")), ["protein"])
    model = reranker.train(df, rounds=5, neg_pos_ratio=50.0, keys=("protein",))
    m = reranker.validation_metrics(reranker.apply(model, df.filter("is_val"))).first()
    assert m.auc > 0.7 and 0 < reranker.best_rounds(model) <= 5 and m.log_loss < 0.65
    assert sum(v for _, v in reranker.importances(model)) == pytest.approx(1)
    assert {r.distance_missing for r in reranker.filled(df).filter("distance = -1").collect()} == {1.0}
    assert list(reranker.train_by_aspect(df, rounds=2)) == ["P"]


def test_evidence_values():
    """Written out, so that a wrong constant shows: some codes of each group and their weights."""
    assert {k: evidence.ECO_TO_CODE[k] for k in ("ECO:0000269", "ECO:0000314", "ECO:0000315", "ECO:0000353", "ECO:0000316", "ECO:0000270", "ECO:0000304", "ECO:0000501", "ECO:0000318", "ECO:0000307")} == {
        "ECO:0000269": "EXP", "ECO:0000314": "IDA", "ECO:0000315": "IMP", "ECO:0000353": "IPI", "ECO:0000316": "IGI", "ECO:0000270": "IEP", "ECO:0000304": "TAS", "ECO:0000501": "IEA", "ECO:0000318": "IBA", "ECO:0000307": "ND",
    }
    assert sorted(evidence.EXPERIMENTAL) == sorted("EXP IDA IPI IMP IGI IEP HTP HDA HMP HGI HEP IC TAS".split())
    assert {c: evidence.WEIGHTS[c] for c in ("EXP", "TAS", "ISS", "RCA", "NAS", "IEA", "ND")} == {"EXP": 1.0, "TAS": 1.0, "ISS": 0.7, "RCA": 0.7, "NAS": 0.5, "IEA": 0.3, "ND": 0.1}


def test_evaluation_scores_by_priority(spark):
    p = spark.createDataFrame([("A", "1", "F", 0.4, "IDA"), ("A", "2", "F", 0.4, "IDA"), ("A", "3", "P", 0.4, "IDA"), ("B", "1", "P", 0.4, None), ("A", "4", "P", 1.9, None)], "protein string, go_id string, aspect string, distance double, evidence_code string")
    truth, given = spark.createDataFrame([("A", "9")], "protein string, go_id string"), spark.createDataFrame([("A", "1", 0.123)], "protein string, go_id string, reranker_score double")
    got = rows(evaluation.evaluation_scores(p, truth, {"F": PRESETS[4]}, given, 1.0))
    assert got == [("A", "1", 0.123, "reranker"), ("A", "2", 0.96, "config"), ("A", "3", 0.8, "distance")]


def brute_alignment(a, b, local, gap_open, gap_extend):
    """The score by the recurrence, cell by cell."""
    s = lambda x, y: int(features._SCORES[features.RESIDUES.find(x), features.RESIDUES.find(y)])
    low = -(10**9)
    h, u, v = {(0, 0): 0}, {}, {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                u[i, j] = max(h[i - 1, j] - gap_open, u[i - 1, j] - gap_extend) if i else low
                v[i, j] = max(h[i, j - 1] - gap_open, v[i, j - 1] - gap_extend) if j else low
                h[i, j] = max(u[i, j], v[i, j], h[i - 1, j - 1] + s(a[i - 1], b[j - 1]) if i and j else low, 0 if local else low)
            else:
                u[0, 0] = v[0, 0] = low
    return max(h.values()) if local else h[len(a), len(b)]


def test_alignment_scores_and_counts():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("ACDW"), rng.integers(0, 12))) for _ in range(2))
        for local in (False, True):
            identity, _, score_, gaps, length = features.align(a, b, local, 4, 1)
            assert score_ == brute_alignment(a, b, local, 4, 1)
            assert 0 <= identity + gaps <= 1.0001
            if not local:
                assert length >= max(len(a), len(b)) and round(gaps * length) == 2 * length - len(a) - len(b)
    long = "ACDEFGHIKL" * 2_000  # 20,000 residues, 4·10^8 cells: a band of rows is all that is kept
    assert features.align(long[:3_000], long[5:3_005])[4] == 3_005


def test_obo(spark, tmp_path):
    text = "format-version: 1.2\ndata-version: releases/2024\n\n[Term]\nid: GO:0000001\nname: one\nnamespace: molecular_function\ndef: no quotes\n\n[Term]\nid: GO:0000002\nname: two\nnamespace: x\ndef: \"a \\b\" [c \"d\"]\nis_a: GO:0000001 ! one\nrelationship: part_of GO:0000001 ! one\nrelationship: has_part GO:0000001\nis_a: GO:0000099\nis_obsolete: true\n\n[Typedef]\nid: GO:0000003\n"
    path = tmp_path / "x.obo"
    path.write_text(text)
    assert readers.obo_version(spark, str(path)) == "releases/2024"
    assert rows(readers.read_obo_terms(spark, str(path)).select("go_id", "aspect", "definition", "is_obsolete")) == [("GO:0000001", "F", None, False), ("GO:0000002", None, "a \\b", True)]
    assert rows(readers.read_obo_edges(spark, str(path))) == [("GO:0000002", "GO:0000001", "is_a"), ("GO:0000002", "GO:0000001", "part_of")]
    bad = tmp_path / "y.obo"
    bad.write_text("format-version: 1\n")
    with pytest.raises(ValueError):
        readers.obo_version(spark, str(bad))


def test_knn_per_aspect(spark):
    q, dq = vectors_of(spark, 9, 5, 3, "q")
    r, dr = vectors_of(spark, 60, 5, 4, "r")
    marks = [(f"r{i:03d}", a) for i in range(60) for a, m in (("F", 2), ("P", 3)) if i % m == 0] + [("r001", None)]
    d = knn.distances(q.astype(np.float32), r.astype(np.float32))
    expected = {(a, f"q{i:03d}", n + 1, f"r{j:03d}") for i in range(9) for a, m in (("F", 2), ("P", 3)) for n, j in enumerate([j for j in np.argsort(d[i]) if j % m == 0][:3])}
    got = knn.knn_per_aspect(dq, dr, spark.createDataFrame(marks, "ref string, aspect string"), 3, rows=7)
    assert {tuple(x)[:4] for x in got.collect()} == expected


def test_readers_and_streams_of_empty_tables(spark):
    empty = spark.createDataFrame([], "id string, vector array<double>")
    full = spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<double>")
    assert knn.knn_exact(empty, full).count() == 0 and knn.knn_exact(full, empty).count() == 0


def test_inputs_without_values_are_not_trained_on(spark):
    """An input that is the same in all rows takes no part in the rounds; trees, scores and importances are those with it."""
    rng = np.random.default_rng(5)
    data = [(f"P{i}", "g", float(x), int(i % 7), "a" if i % 5 else None, int(x + i % 7 > 3)) for i, x in enumerate(rng.random(400))]
    df = reranker.prepare_features(spark.createDataFrame(data, "protein string, go_id string, distance double, vote_count int, qualifier string, label int"))
    df = reranker.stratified_split(df, ["protein"]).localCheckpoint()
    model = reranker.train(df, rounds=3)
    assert model.stages[-2].getInputCols() == ["distance", "vote_count", "qualifier_i"]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(reranker, "varied", lambda rows: reranker.INPUTS)
        whole = reranker.train(df, rounds=3)
    got, want = ({r.protein: r.reranker_score for r in reranker.apply(x, df).collect()} for x in (model, whole))
    assert got == want
    assert dict(reranker.importances(model)) == pytest.approx(dict(reranker.importances(whole)))
