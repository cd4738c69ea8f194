"""The grid search against brute force, what it moves, and what hashing compares."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from annoweave.operators import knn
from annoweave.operators.cell_index import CellIndex


def frame(spark, x, name, parts=3):
    return spark.createDataFrame([(f"{name}{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>").repartition(parts)


def clustered(n, dim, seed, clusters=60, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(clusters, dim))
    return centres[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, dim))


def brute(q, r, k, metric="cosine"):
    d = knn.distances(q.astype(np.float32), r.astype(np.float32), metric)
    return {(f"q{i:04d}", rank + 1, f"r{j:04d}") for i in range(len(q)) for rank, j in enumerate(np.argsort(d[i], kind="stable")[:k])}


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize(("rows", "cell"), [(2_048, 16_384), (7, 16_384), (16, 30), (5, 11)])
def test_the_grid_is_exact(spark, metric, rows, cell):
    q, r = np.random.default_rng(1).normal(size=(40, 8)), np.random.default_rng(2).normal(size=(130, 8))
    got = {tuple(x)[:3] for x in knn.knn_exact(frame(spark, q, "q"), frame(spark, r, "r"), 4, metric, rows=rows, cell=cell).collect()}
    assert got == brute(q, r, 4, metric)


def test_repeated_references_and_groups_over_cells(spark):
    """A reference of many rows counts once, at its nearest, also where a part of a cell would cut between its rows."""
    refs = spark.createDataFrame([(f"r{i % 6}", [1.0, 0.1 * (i % 17)]) for i in range(60)], "id string, vector array<double>")
    one = spark.createDataFrame([("q", [1.0, 0.0])], "id string, vector array<double>")
    want = {f"r{k}": min(round(1 - 1 / np.hypot(1, 0.1 * (i % 17)), 6) for i in range(60) if i % 6 == k) for k in range(6)}
    for rows, cell in ((4, 100), (2_048, 7)):
        got = {r.ref: round(r.distance, 6) for r in knn.knn_exact(one, refs, 6, rows=rows, cell=cell).collect()}
        assert got == pytest.approx(want, abs=2e-6)
    aspects = spark.createDataFrame([("r0", "P"), ("r1", "P"), ("r1", "F"), ("r2", "F"), ("r3", None)], "ref string, aspect string")
    got = sorted((r.aspect, r.ref) for r in knn.knn_per_aspect(one, refs, aspects, 5, rows=3).collect())
    assert got == [("F", "r1"), ("F", "r2"), ("P", "r0"), ("P", "r1")]


def test_vectors_move_once_a_grid_line(spark, monkeypatch):
    """25 queries and 90 references in cells of 10: three rows and nine columns, so 25 * 9 + 90 * 3 vectors reach Python, not 25 * 90 pairs."""
    moved = spark.sparkContext.accumulator(0)
    own = knn.cell_search

    def counting(*args):
        kernel, schema = own(*args)

        def counted(q, r):
            moved.add(q.num_rows + r.num_rows)
            return kernel(q, r)

        return counted, schema

    monkeypatch.setattr(knn, "cell_search", counting)
    q, r = np.random.default_rng(1).normal(size=(25, 4)), np.random.default_rng(2).normal(size=(90, 4))
    got = {tuple(x)[:3] for x in knn.knn_exact(frame(spark, q, "q"), frame(spark, r, "r"), 3, cell=10).collect()}
    assert got == brute(q, r, 3)
    assert moved.value == 25 * 9 + 90 * 3


def test_hashing_selects(spark):
    """Clustered vectors: recall of 0.9 or more with less than a tenth of all pairs compared."""
    q, r = clustered(60, 32, 1), clustered(3_000, 32, 2)
    dq, dr = frame(spark, q, "q"), frame(spark, r, "r")
    got = {tuple(x)[:3:2] for x in knn.knn_lsh(dq, dr, 5).collect()}
    want = {x[::2] for x in brute(q, r, 5)}
    assert len(got & want) >= 0.9 * len(want)
    hashing, probes = knn.measured_probes([knn.SignHashing(32, 16, bits, 42) for bits in range(6, 13)], dq, dr, 5, 0.92, 3_000)
    homes, probed = hashing.homes(r.astype("f4")), hashing.probed(q.astype("f4"), probes)
    compared = sum(len(set().union(*[np.flatnonzero(homes[:, t] == b) for t in range(16) for b in probed[i, t]])) for i in range(60))
    assert compared < 0.1 * 60 * 3_000, (hashing.bits, probes, compared)


def test_hashing_splits_large_buckets_and_falls_back(spark):
    same = frame(spark, np.ones((50, 4)), "r")
    one = frame(spark, np.ones((1, 4)), "q")
    assert sorted(r.ref for r in knn.knn_lsh(one, same, 3, cell=8).collect()) == ["r0000", "r0001", "r0002"]
    far = frame(spark, -np.ones((3, 4)), "r")
    assert knn.knn_lsh(one, far, 2, probes=1).count() == 2
    assert knn.knn_lsh(one, far.limit(0), 2).count() == 0


def test_probes_come_in_order_of_distance():
    hashing = knn.SignHashing(6, 3, 5, 1)
    x = np.random.default_rng(4).normal(size=(10, 6))
    probed = hashing.probed(x, 32)
    assert (probed[:, :, 0] == hashing.homes(x)).all()
    assert all(len(set(probed[i, t])) == 32 for i in range(10) for t in range(3))
    sides = hashing._sides(x)
    for i in range(10):
        for t in range(3):
            cost = [sum(sides[i, t, b] ** 2 for b in range(5) if (int(n) ^ int(probed[i, t, 0])) >> b & 1) for n in probed[i, t]]
            assert cost == sorted(cost)


def test_a_kept_index_grows_without_fitting(spark, tmp_path):
    """Recall of 0.9 or more with a fifth of the cells after adding, all neighbours with all cells; a handle on the files does the same; replays change nothing."""
    q, r = clustered(40, 16, 1), clustered(900, 16, 2)
    dq, dr = frame(spark, q, "q"), frame(spark, r, "r")
    old, new = dr.filter("id < 'r0500'"), dr.filter("id >= 'r0500'")
    index = CellIndex.build(old, f"{tmp_path}/index")
    before = index.centroids.copy()
    for _ in range(2):
        index.add(new, "more")
    again = CellIndex(spark, f"{tmp_path}/index")
    assert (again.centroids == before).all()
    assert again.vectors().count() == 900
    want = brute(q, r, 5)
    assert {tuple(x)[:3] for x in again.search(dq, 5).collect()} == want
    some = {tuple(x)[:3:2] for x in again.search(dq, 5, probes=len(before) // 5).collect()}
    assert len(some & {x[::2] for x in want}) >= 0.9 * len(want)
    assert again.search(dq.limit(0), 5).count() == 0


def test_an_index_has_few_files_and_places_no_query_for_all_cells(spark, tmp_path, monkeypatch):
    """As many files a batch as the shuffle has partitions, though there are more cells; with all cells a query is not written once a cell."""
    q, r = clustered(40, 16, 1), clustered(900, 16, 2)
    index = CellIndex.build(frame(spark, r, "r"), f"{tmp_path}/index", cells=30)
    index.add(frame(spark, r, "r").filter("id < 'r0100'"), "more")
    assert sum(1 for _ in (tmp_path / "index" / "vectors").rglob("*.parquet")) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(index, "_placed", None)
    assert {tuple(x)[:3] for x in index.search(frame(spark, q, "q"), 5).collect()} == brute(q, r, 5)


def test_fitting_rows_are_dealt_to_tasks(spark, monkeypatch):
    """Neither the choice of rows to fit on nor the fit is left to one task; about FIT_ROWS are chosen of more, all of fewer."""
    monkeypatch.setattr(knn, "FIT_ROWS", 400)
    monkeypatch.setattr(knn, "FIT_PART", 50)
    df = spark.range(2_000).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0)).alias("vector"))
    own = knn.fit_rows(df, 2_000)
    assert own.rdd.getNumPartitions() == 8 and 320 <= own.count() <= 480
    assert knn.fit_rows(df.limit(300), 300).count() == 300


def test_a_query_goes_once_to_a_group_of_buckets(spark, monkeypatch):
    """With all buckets probed, hashing equals the exact search, in small groups, shares and parts; a group gets a query once, not once a bucket it probes."""
    moved, whole = spark.sparkContext.accumulator(0), knn.slot_search

    def counting(k, types, most=1_000_000):
        kernel, schema = whole(k, types, 40)

        def counted(q, r):
            moved.add(q.num_rows)
            return kernel(q, r)

        return counted, schema

    monkeypatch.setattr(knn, "slot_search", counting)
    q, r = np.random.default_rng(1).normal(size=(40, 6)), np.random.default_rng(2).normal(size=(90, 6))
    dq, dr = frame(spark, q, "q"), frame(spark, r, "r")
    got = sorted(tuple(x)[:3] for x in knn.knn_lsh(dq, dr.union(dr), 3, bits=4, probes=16, cell=8).collect())
    assert got == sorted(brute(q, r, 3))
    moved.value = 0
    assert knn.knn_lsh(dq, dr, 3, bits=4, probes=16, cell=480).count() == 120
    assert moved.value <= 40 * 3  # three groups; 16 tables with 16 buckets each
