"""Nearest neighbours: exact by blocks, by inverted cells, by hashing, and per aspect.

Vectors come as (id, vector); results as (query, rank, ref, distance), ties in distance by ref. A reference that occurs several times
counts once, at its nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import vectors
from .graph import checkpointed

BLOCK = 2_048
#: Queries, and references, that a cell of the grid holds about.
CELL = 16_384
#: References that a bucket of the hashing keeps about.
BUCKET = 64
#: References that could be compared in the time a bucket takes.
PROBE = 32
#: References that cells are fitted on about at most, how many of them a task gets, and queries that the number of probes is measured on.
FIT_ROWS = 100_000
FIT_PART = 2_000
MEASURED_QUERIES = 200


def distances(q: np.ndarray, r: np.ndarray, metric: str = "cosine") -> np.ndarray:
    """All distances of a block of queries and a block of references."""
    q, r = q.astype(np.float64), r.astype(np.float64)
    if metric == "cosine":
        q /= np.linalg.norm(q, axis=1)[:, None] + vectors.EPSILON
        r /= np.linalg.norm(r, axis=1)[:, None] + vectors.EPSILON
        return 1 - q @ r.T
    if metric == "l2":
        return np.maximum(0, (q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2 * q @ r.T)
    raise ValueError(f"unknown metric {metric}")


def nearest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest distances of each row, ties by column."""
    n = min(k, d.shape[1])
    last = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
    tied = d == last
    room = n - (d < last).sum(1)
    return np.nonzero((d < last) | (tied & (np.cumsum(tied, axis=1) <= room[:, None])))


def top_k(pairs: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k nearest references of each query (and other keys); one row a reference, its nearest."""
    once = pairs.groupBy(*keys, "query", "ref").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy(*keys, "query").orderBy("distance", "ref"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select(*keys, "query", "rank", "ref", "distance")


def matrix_of(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    own = column.combine_chunks()
    own = own if isinstance(own, pa.ListArray) else pa.concat_arrays(own.chunks)
    return own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)


def cell_search(k: int, metric: str, threshold: float | None, rows: int, types: list[str]):
    """The kernel of a cell: its queries against its references, `rows` of each at a time, and the k nearest references of each query (and group) in the cell.

    References are taken in order of their ids and a repeated one counts once. With buckets, only those of one bucket meet.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(f"aspect string, query {types[0]}, ref {types[1]}, distance double"))

    def meeting(x: np.ndarray, near: np.ndarray, y: np.ndarray, named: list | None) -> pd.DataFrame:
        """(q, ref, distance, aspect), q being the number of the query."""
        order = np.argsort(near, kind="stable")
        near, y = near[order], y[order]
        sets = {name: [i for i, at in enumerate(order) if name in named[at]] for name in sorted({n for own in named for n in own})} if named else {None: range(len(near))}
        found = []
        for name, members in sets.items():
            members = np.asarray(members)
            _, code = np.unique(near[members], return_inverse=True)
            edges = [0, *np.flatnonzero(np.r_[False, code[1:] != code[:-1]]), len(members)]
            for top in range(0, len(x), rows):
                best = None
                at = 0
                while at < len(members):
                    # A part ends where an id does, so all rows of a reference are in one part.
                    end = next((e for e in edges[np.searchsorted(edges, min(at + rows, len(members))) :]), len(members))
                    part = members[at:end]
                    d = distances(x[top : top + rows], y[part], metric)
                    first = np.flatnonzero(np.r_[True, near[part][1:] != near[part][:-1]])
                    least = np.minimum.reduceat(d, first, axis=1)
                    i, j = nearest(least, k)
                    fresh = pd.DataFrame({"q": i + top, "ref": near[part][first][j], "distance": least[i, j]})
                    best = fresh if best is None else pd.concat([best, fresh]).sort_values(["q", "distance", "ref"], kind="stable").groupby("q").head(k)
                    at = end
                found.append(best.assign(aspect=name))
        return pd.concat(found)

    def local(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return arrow.empty_table()
        own, near = np.asarray(q.column("q_id").to_pylist()), np.asarray(r.column("r_id").to_pylist())
        x, y = matrix_of(q.column("q_vector")), matrix_of(r.column("r_vector"))
        if "_bucket" in q.column_names:
            order = np.argsort(near, kind="stable")
            near, y = near[order], y[order]
            mine, theirs = q.select(["_bucket", "_share"]).to_pandas().groupby(["_bucket", "_share"]).indices, r.select(["_bucket", "_share"]).to_pandas().iloc[order].groupby(["_bucket", "_share"]).indices
            found = []
            for key in mine.keys() & theirs.keys():
                b = theirs[key]
                first = np.flatnonzero(np.r_[True, near[b][1:] != near[b][:-1]])
                for top in range(0, len(mine[key]), 512):
                    a = mine[key][top : top + 512]
                    d = distances(x[a], y[b], metric)
                    least = d if len(first) == len(b) else np.minimum.reduceat(d, first, axis=1)
                    i, j = nearest(least, k)
                    found.append((own[a][i], near[b][first][j], least[i, j]))
            if not found:
                return arrow.empty_table()
            out = pd.DataFrame(dict(zip(("q", "ref", "distance"), map(np.concatenate, zip(*found, strict=True)), strict=True))).assign(aspect=None)
            out = out.sort_values(["q", "distance", "ref"]).drop_duplicates(["q", "ref"]).groupby("q").head(k)
            own, out = out["q"].to_numpy(), out.assign(q=np.arange(len(out)))
        else:
            out = meeting(x, near, y, r.column("groups").to_pylist() if "groups" in r.column_names else None)
        out = out if threshold is None else out[out["distance"] <= threshold]
        return pa.Table.from_arrays([pa.array(out["aspect"].tolist(), arrow.field(0).type), pa.array(own[out["q"].to_numpy()].tolist(), arrow.field(1).type), pa.array(out["ref"].tolist(), arrow.field(2).type), pa.array(out["distance"].to_numpy())], schema=arrow)

    return local, f"aspect string, query {types[0]}, ref {types[1]}, distance double"


def as_rows(df: DataFrame, side: str) -> DataFrame:
    """Vectors as `<side>_id` and `<side>_vector`: columns of their own, also where both sides come from one table."""
    own = df.filter("vector is not null")
    return own.select(F.col("id").alias(f"{side}_id"), F.col("vector").cast("array<float>").alias(f"{side}_vector"), *([F.col("groups").alias("groups")] if "groups" in df.columns else []))


def types_of(queries: DataFrame, references: DataFrame) -> list[str]:
    return [df.schema["id"].dataType.simpleString() for df in (queries, references)]


def block_search(queries: DataFrame, references: DataFrame, k: int, metric: str, threshold: float | None, rows: int, cell: int = CELL) -> DataFrame:
    """Every query against every reference, on a grid: queries are dealt to its rows and references to its columns, by ids.

    A cell holds about `cell` of each. A query goes once to every column and a reference once to every row, so what is moved is the queries times
    the columns and the references times the rows, and each cell gives k rows a query.
    """
    q, r = as_rows(queries, "q"), as_rows(references, "r")
    down, across = (max(1, math.ceil(df.count() / cell)) for df in (q, r))
    q = q.withColumn("_row", F.pmod(F.xxhash64("q_id"), F.lit(down)).cast("int")).withColumn("_col", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    r = r.withColumn("_col", F.pmod(F.xxhash64("r_id"), F.lit(across)).cast("int")).withColumn("_row", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    kernel, schema = cell_search(k, metric, threshold, rows, types_of(queries, references))
    return q.groupBy("_row", "_col").cogroup(r.groupBy("_row", "_col")).applyInArrow(kernel, schema)


def knn_exact(queries: DataFrame, references: DataFrame, k: int = 5, metric: str = "cosine", threshold: float | None = None, rows: int = BLOCK, cell: int = CELL) -> DataFrame:
    """Exact neighbours over a grid of cells; behind it the only shuffle has k rows a query and column."""
    return top_k(block_search(queries.select("id", "vector"), references.select("id", "vector"), k, metric, threshold, rows, cell).drop("aspect"), k)


def fit_rows(references: DataFrame, n: int) -> DataFrame:
    """Of n references about `FIT_ROWS` by a hash of their ids, all if there are no more, dealt to tasks: a sorted limit would leave them, and the fit, to one task."""
    own = references if n <= FIT_ROWS else references.filter(F.pmod(F.xxhash64("id"), F.lit(n)) < FIT_ROWS)
    return own.repartition(max(1, math.ceil(min(n, FIT_ROWS) / FIT_PART)), "id")


def knn_ivf(queries: DataFrame, references: DataFrame, k: int = 5, cells: int | None = None, probes: int | None = None, metric: str = "cosine", seed: int = 42, recall: float = 0.95) -> DataFrame:
    """Inverted cells: k-means cells of the references; a query is compared with the references of its nearest cells. All cells probed: exact.

    The number of cells grows with the square root of the references. Cells are fitted on about `FIT_ROWS` references at most, all are
    placed. Unless given, the number of probes is measured: the least that finds the share `recall` of the exact neighbours of at most
    `MEASURED_QUERIES` queries. Cells are dealt to tasks whole, queries and references each as rows, and each query gives k rows a group of
    cells. A query that finds fewer than k references in its cells is searched exactly.
    """
    references = references.select("id", "vector").filter("vector is not null")
    n = references.count()
    if not n:
        return knn_exact(queries, references, k, metric)
    cells = cells or max(2, math.isqrt(n))
    unit = F.col("vector").cast("array<double>") if metric == "l2" else vectors.l2_normalize(F.col("vector").cast("array<double>"))
    sample = fit_rows(references, n).select(array_to_vector(unit).alias("features"))
    centers = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(sample).clusterCenters())  # cells × dimensions, the index itself

    def placing(most: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                d = distances(np.stack(b["unit"].to_numpy()), centers, "l2")
                yield b[["id", "vector"]].assign(cells=np.argsort(d, axis=1, kind="stable")[:, :most].tolist())

        return run

    def placed(df: DataFrame, most: int) -> DataFrame:
        own = df.filter("vector is not null").select("id", "vector", unit.alias("unit"))
        types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("id", "vector"))
        return own.mapInPandas(placing(most), f"{types}, cells array<int>")

    queries = queries.select("id", "vector")
    homes = checkpointed(placed(references, 1).select("id", "vector", F.element_at("cells", 1).alias("cell")))
    if probes is None:
        some = queries.orderBy(F.xxhash64("id"), "id").limit(MEASURED_QUERIES)
        exact = knn_exact(some, references, k, metric).select(F.col("query").alias("id"), "ref")
        near = exact.join(homes.select(F.col("id").alias("ref"), "cell"), "ref").join(placed(some, len(centers)).select("id", "cells"), "id")
        at = near.groupBy(F.array_position("cells", F.col("cell")).alias("at")).count().orderBy("at").collect()  # at most a row a cell
        found = np.cumsum([r["count"] for r in at])
        probes = next((int(r["at"]) for r, f in zip(at, found, strict=True) if f >= recall * found[-1]), len(centers))
    q = placed(queries, probes).select(F.col("id").alias("q_id"), F.col("vector").cast("array<float>").alias("q_vector"), F.explode("cells").alias("_bucket"))
    r = homes.select(F.col("id").alias("r_id"), F.col("vector").cast("array<float>").alias("r_vector"), F.col("cell").alias("_bucket"))
    met = n + queries.count() * probes  # rows of both sides, so that a group holds about CELL of them
    return or_exact(top_k(bucket_search(q, r, k, metric, met), k), queries, references, k, metric)


def or_exact(found: DataFrame, queries: DataFrame, references: DataFrame, k: int, metric: str) -> DataFrame:
    """found, and the exact neighbours of queries that have fewer than k there."""
    found = checkpointed(found)
    full = found.filter(F.col("rank") == k).select(F.col("query").alias("id"))
    short = queries.select("id", "vector").join(full, "id", "left_anti")
    return found.join(full.withColumnRenamed("id", "query"), "query", "left_semi").select("query", "rank", "ref", "distance").unionByName(knn_exact(short, references, k, metric))


class SignHashing:
    """Tables of buckets by the signs of several random projections each; a query looks into the buckets that lie nearest to it."""

    #: Signs of a table, those with the smallest projections, that probes may flip.
    FREE = 10

    def __init__(self, dim: int, tables: int, bits: int, seed: int):
        self.tables, self.bits = tables, bits
        self.planes = np.random.default_rng(seed).normal(size=(dim, tables * bits))

    def _sides(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) @ self.planes).reshape(len(x), self.tables, self.bits)

    def _numbers(self, sides: np.ndarray) -> np.ndarray:
        return ((sides > 0) << np.arange(self.bits)).sum(2) + (np.arange(self.tables) << self.bits)

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        return self._numbers(self._sides(x))

    def probed(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The `probes` nearest buckets of each vector in each table, by the squared projections that would have to change sign."""
        sides = self._sides(x)
        free = min(self.FREE, self.bits)
        low = np.argsort(np.abs(sides), axis=2, kind="stable")[:, :, :free]
        margin = np.take_along_axis(sides, low, 2) ** 2
        subsets = (np.arange(1 << free)[:, None] >> np.arange(free)) & 1
        near = np.argsort(margin @ subsets.T, axis=2, kind="stable")[:, :, :probes]
        flips = ((subsets[near] << low[:, :, None, :]).sum(3)).astype(np.int64)
        return self._numbers(sides)[:, :, None] ^ flips


def knn_lsh(queries: DataFrame, references: DataFrame, k: int = 5, tables: int = 16, bits: int | None = None, probes: int | None = None, seed: int = 42, recall: float = 0.92, cell: int = CELL) -> DataFrame:
    """Buckets by the signs of `bits` random projections in each of `tables` tables (cosine); a query is compared with the references of the buckets it probes.

    Bits grow with the logarithm of the references: at least so many that a bucket keeps about `BUCKET` of them. Unless given, bits and probes
    are measured: the least number of buckets a table that finds the share `recall` of the exact neighbours of at most `MEASURED_QUERIES`
    queries, and of the numbers of bits the one that then compares least. How few pairs that are depends on the vectors: neighbours that are
    hardly nearer than others take many probes. Large buckets are split. Queries with fewer than k candidates are searched exactly.
    """
    queries, references = queries.select("id", "vector").filter("vector is not null"), references.select("id", "vector").filter("vector is not null")
    n = references.count()
    if not n:
        return knn_exact(queries, references, k)
    dim, least = len(references.first()["vector"]), max(4, math.ceil(math.log2(n / BUCKET)))
    plans = [SignHashing(dim, tables, own, seed) for own in ([bits] if bits else range(least, least + 7))]
    hashing, probes = (plans[0], probes) if probes else measured_probes(plans, queries, references, k, recall, n)

    # Buckets are dealt to so many groups that each has about `cell` of the references, large ones in shares; a query goes once to a group, whatever
    # number of its buckets that has. Queries are dealt to parts, which references meet as in a grid, where a group would get too many.
    groups, asked = max(1, math.ceil(n * tables / cell)), queries.count()
    parts = max(1, math.ceil(asked / (4 * cell)), math.ceil(asked * tables * probes / (groups * 256 * cell)))
    large = {r["_bucket"]: -(-r["_n"] // cell) for r in _sizes(references, hashing, cell).collect()}  # at most `groups`
    r = _dealt(as_rows(references, "r"), "r", references, hashing.homes, tables, large, groups, False).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    q = _dealt(as_rows(queries, "q"), "q", queries, lambda x: hashing.probed(x, probes), tables << min(hashing.FREE, hashing.bits), large, groups, True).withColumn("_part", F.pmod(F.xxhash64("q_id"), F.lit(parts)).cast("int"))
    kernel, schema = slot_search(k, types_of(queries, references))
    found = q.groupBy("_part", "_group").cogroup(r.groupBy("_part", "_group")).applyInArrow(kernel, schema)
    return or_exact(top_k(found, k), queries, references, k, "cosine")


#: Rows of vectors that a task makes at a time when it deals them to buckets, and cells of the tables it sorts for that.
DEALT_ROWS = 1 << 18
#: Shares that a bucket may have.
SHARES = 1 << 20


def _sizes(references: DataFrame, hashing: SignHashing, cell: int) -> DataFrame:
    """(_bucket, _n) of the buckets of more than `cell` references."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bucket, n = np.unique(hashing.homes(matrix_of(pa.chunked_array([b.column(1)]))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(n.astype(np.int64))], ["_bucket", "_n"])

    return as_rows(references, "r").mapInArrow(run, "_bucket long, _n long").groupBy("_bucket").agg(F.sum("_n").alias("_n")).filter(F.col("_n") > cell)


def _dealt(rows: DataFrame, side: str, df: DataFrame, buckets, width: int, large: dict[int, int], groups: int, every: bool) -> DataFrame:
    """(id, vector, _slots, _group): a row of vectors goes once to each group that has any of its buckets, with their slots (bucket and share).

    Of a large bucket a reference goes to one share, and a query (`every`) to each. Few rows are dealt at a time, since each may go to thousands of groups.
    """
    step = max(1, DEALT_ROWS // width)

    def slots_of(found: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, slot)."""
        row, bucket = np.repeat(np.arange(len(found)), found.shape[1]), found.ravel().astype(np.int64)
        shares = np.array([large.get(b, 1) for b in bucket.tolist()]) if large else np.ones(len(bucket), np.int64)
        if not every:
            return row, bucket * SHARES + spread[row] % shares
        at = np.repeat(np.arange(len(row)), shares)
        return row[at], bucket[at] * SHARES + np.arange(len(at)) - np.repeat(np.cumsum(shares) - shares, shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for top in range(0, whole.num_rows, step):
                b = whole.slice(top, step)
                row, slot = slots_of(buckets(matrix_of(pa.chunked_array([b.column(1)]))).reshape(b.num_rows, -1), b.column(2).to_numpy())
                group = (slot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(groups)
                order = np.lexsort((group, row))
                row, group, slot = row[order], group[order].astype(np.int32), slot[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])])
                take, ends = pa.array(row[first]), pa.array(np.r_[first, len(row)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.ListArray.from_arrays(ends, pa.array(slot)), pa.array(group[first])], [f"{side}_id", f"{side}_vector", "_slots", "_group"])

    own = rows.withColumn("_h", F.pmod(F.xxhash64(f"{side}_id"), F.lit(1 << 40)))
    return own.mapInArrow(run, f"{side}_id {df.schema['id'].dataType.simpleString()}, {side}_vector array<float>, _slots array<long>, _group int")


def slot_search(k: int, types: list[str], most: int = 1_000_000):
    """The kernel of a group: each slot's queries against its references, reduced to k a query whenever `most` rows were found."""
    arrow = to_arrow_schema(T.StructType.fromDDL(f"query {types[0]}, ref {types[1]}, distance double"))

    def rows_by_slot(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lists = table.column("_slots").combine_chunks()
        slot, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        order = np.argsort(slot, kind="stable")
        return slot[order], row[order]

    def least(found: list[tuple]) -> list[tuple]:
        """Of (query, reference, distance) the k nearest references of each query; references are numbered in order of their ids."""
        q, r, d = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((r, d, q))
        q, r, d = q[order], r[order], d[order]
        _, once = np.unique(q * (int(r.max()) + 1) + r, return_index=True)
        once.sort()
        q, r, d = q[once], r[once], d[once]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        return [(q[rank < k], r[rank < k], d[rank < k])]

    def local(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return arrow.empty_table()
        x, y = matrix_of(q.column("q_vector")), matrix_of(r.column("r_vector"))
        names, code = np.unique(np.asarray(r.column("r_id").to_pylist()), return_inverse=True)
        mine, a = rows_by_slot(q)
        theirs, b = rows_by_slot(r)
        found, size = [], 0
        for slot in np.intersect1d(mine, theirs):
            own, near = a[slice(*np.searchsorted(mine, [slot, slot + 1]))], b[slice(*np.searchsorted(theirs, [slot, slot + 1]))]
            near = near[np.argsort(code[near], kind="stable")]
            first = np.flatnonzero(np.r_[True, code[near][1:] != code[near][:-1]])
            for top in range(0, len(own), 512):
                some = own[top : top + 512]
                d = distances(x[some], y[near])
                d = d if len(first) == len(near) else np.minimum.reduceat(d, first, axis=1)
                i, j = nearest(d, k)
                found.append((some[i], code[near][first][j], d[i, j]))
                size += len(i)
            if size > most:
                found = least(found)
                size = 0
        if not found:
            return arrow.empty_table()
        own, near, d = least(found)[0]
        return pa.Table.from_arrays([q.column("q_id").combine_chunks().take(pa.array(own)), pa.array(names[near].tolist(), arrow.field(1).type), pa.array(d)], schema=arrow)

    return local, f"query {types[0]}, ref {types[1]}, distance double"


def bucket_search(q: DataFrame, r: DataFrame, k: int, metric: str, rows: int, cell: int = CELL) -> DataFrame:
    """(query, ref, distance): queries (q_id, q_vector, _bucket) against the references (r_id, r_vector, _bucket) of their buckets, k a query and group.

    A group is a set of whole buckets, or of shares of those with more than `cell` references, and has about `cell` of the `rows` references.
    """
    sizes = checkpointed(r.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")))  # a row a bucket
    shares, groups = F.ceil(F.col("_n") / cell).cast("int"), max(1, math.ceil(rows / cell))

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("_group", F.pmod(F.xxhash64("_bucket", "_share"), F.lit(groups)).cast("int")).drop("_n")

    types = [df.schema[c].dataType.simpleString() for df, c in ((q, "q_id"), (r, "r_id"))]
    r = dealt(r.join(sizes, "_bucket").withColumn("_share", F.pmod(F.xxhash64("r_id"), shares).cast("int")))
    q = dealt(q.join(sizes, "_bucket").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))))
    kernel, schema = cell_search(k, metric, None, BLOCK, types)
    return q.groupBy("_group").cogroup(r.groupBy("_group")).applyInArrow(kernel, schema).drop("aspect")


def measured_probes(plans: list[SignHashing], queries: DataFrame, references: DataFrame, k: int, recall: float, n: int) -> tuple[SignHashing, int]:
    """The hashing that compares least of n references, a probe counted as `PROBE` of them, and how many buckets of a table it probes, to find the share `recall` of exact neighbours of some queries."""
    some = queries.orderBy(F.xxhash64("id"), "id").limit(MEASURED_QUERIES)
    pairs = knn_exact(some, references, k).select(F.col("query").alias("id"), "ref").join(some, "id").join(references.select(F.col("id").alias("ref"), F.col("vector").alias("near")), "ref").toPandas()  # at most MEASURED_QUERIES * k
    if not len(pairs):
        return plans[-1], 1
    own, near, found = np.stack(pairs["vector"].to_numpy()), np.stack(pairs["near"].to_numpy()), []
    for plan in plans:
        most = 1 << min(plan.FREE, plan.bits)
        homes, at = plan.homes(near), []
        for i in range(len(own)):
            hit = plan.probed(own[i : i + 1], most)[0] == homes[i][:, None]
            at.append(np.where(hit.any(1), hit.argmax(1), most).min() + 1)
        probes = int(min(most, np.sort(at)[max(0, math.ceil(recall * len(at)) - 1)]))
        found.append((probes * (PROBE + n / (1 << plan.bits)), plan, probes))
    _, plan, probes = min(found, key=lambda x: x[0])
    return plan, probes


def knn_per_aspect(queries: DataFrame, references: DataFrame, annotated: DataFrame, k: int = 5, metric: str = "cosine", rows: int = BLOCK) -> DataFrame:
    """Neighbours among the references annotated in each aspect (ref, aspect); each pair of blocks is multiplied once for all aspects."""
    aspects = annotated.select(F.col("ref").alias("id"), "aspect").dropna().groupBy("id").agg(F.collect_set("aspect").alias("groups"))
    own = references.select("id", "vector").join(aspects, "id")
    return top_k(block_search(queries.select("id", "vector"), own, k, metric, None, rows), k, "aspect")
