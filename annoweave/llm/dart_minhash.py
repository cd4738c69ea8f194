"""Near-duplicate classes by DartMinHash and banded joining.

Words are runs of word characters, lower case; a document's elements are its distinct shingles of
five words (fewer words: one shingle of all). An element that occurs n times weighs 1 + log2(n) (`weights="tf"`), 1 ("set") or n
("count"). Similarity is the weighted Jaccard coefficient, the sum of the smaller over the sum of the larger weights; where no
shingle is repeated the three are the same.

Signatures (DartMinHash, Christiani 2020): every element throws darts into the plane of weight and
rank, a Poisson process that its hash alone determines. The plane is cut into dyadic regions: weight
layers [0,1), [1,2), [2,4), ... and rank segments, each twice as long as the one before. A dart counts
if it falls below the element's weight; it belongs to a random coordinate, and each coordinate keeps
its earliest dart. Segments are opened until a document's coordinates are all filled, so a document
throws about k·ln k darts whatever its length, and two documents agree in a coordinate with a
probability of their weighted Jaccard coefficient.

Joining: documents with equal words collapse to one node, named by a digest of 128 bits. `BANDS` bands of `ROWS` coordinates
make buckets (a pair at similarity 0.8 shares one with probability 0.9996). First every bucket names its
most central member, the one with most company over all its buckets, as its leader, and each node is checked exactly, on
weighted shingles, against the leader it shares most buckets with: one pair a node, which joins most of any large group. Found
links merge classes. Buckets that still hold several classes are then compared in full, without emitting pairs: a task gets one bucket, or
two blocks of a large one (at most 2 · `BLOCK` members), counts all intersections by matrix products and returns only links between
different classes. Classes are connected components of the verified links; no link between different texts of a bucket is lost.
Wherever a bucket, leader, label or text may hold many rows, they are joined under salted keys (`meet`), so none is one task.

Null or wordless text has no shingles: such documents are near-duplicates of identical texts only. A class is named by its smallest
doc_id; null ids have the class of their text, which is null if the class has no other id. Repeated rows fall into one class, and an id
that stands for several texts has a row for each of them. A very long text is only a larger set. Other columns are ignored,
whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Memo, checkpointed, few_bytes, map_slices, meet, table, text_or_empty, type_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: Length of the first rank segment.
FIRST_SEGMENT = 2.0**-7
#: Members of a bucket that are compared in one go, and columns of the matrix that counts their common shingles.
BLOCK = 256
COLUMNS = 8_192
#: Words of documents whose darts are thrown together.
CHUNK = 100_000

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_STEPS = np.array([pow(0x9E3779B97F4A7C15 | 1, k + 1, 2**64) for k in range(SHINGLE)], _U)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_hashes(lists: list[list[str]]) -> list[np.ndarray]:
    """The hashes of the words of some documents; a word is hashed once among them."""
    own = {w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for words in lists for w in words}
    return [np.fromiter(map(own.__getitem__, words), _U, len(words)) for words in lists]


def shingles(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of a document's shingles, and how often each occurs."""
    if not len(h):
        return np.empty(0, _U), np.empty(0, int)
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    x = np.zeros(n, _U)
    for k in range(size):
        x += mix64(h[k : k + n] + _STEPS[k]) * _STEPS[k]
    x = np.sort(mix64(x))
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return x[first], np.diff(np.r_[first, n])


def weighed(counts: np.ndarray, weights: str) -> np.ndarray:
    """The weight of elements that occur so often."""
    return 1 + np.log2(counts) if weights == "tf" else counts.astype(float) if weights == "count" else np.ones(len(counts))


def _poisson_cdf(mean: float) -> np.ndarray:
    k = np.arange(int(mean + 12 * math.sqrt(mean) + 16))
    log_p = k * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in k])
    return np.cumsum(np.exp(log_p))[:-1]


_CDF = Memo(_poisson_cdf, 1_000)


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """A row of k coordinates for each weighted set; rows of empty sets are 0."""
    sizes = np.array([len(s) for s, _ in sets])
    doc = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate([s for s, _ in sets]) if sets else np.empty(0, _U)
    weight = np.concatenate([w for _, w in sets]) if sets else np.empty(0)
    # Weight layers: [0, 1), then [2^(v-1), 2^v) up to the element's weight.
    layers = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(int)
    doc, element, weight = np.repeat(doc, layers), np.repeat(element, layers), np.repeat(weight, layers)
    layer = np.arange(len(doc)) - np.repeat(np.cumsum(layers) - layers, layers)
    low = np.where(layer == 0, 0.0, 2.0 ** np.maximum(layer - 1, 0))
    width = np.where(layer == 0, 1.0, low)
    out, filled = np.zeros((len(sets), k), _U), np.zeros(len(sets) * k, bool)
    start, length, segment = 0.0, FIRST_SEGMENT, 0
    live = sizes > 0
    while live.any():
        own = np.flatnonzero(live[doc])
        seed = mix64(element[own] + _GOLDEN * (layer[own].astype(_U) * _U(4096) + _U(segment + 1)))
        u, count = _unit(seed), np.zeros(len(own), int)
        for v in np.unique(layer[own]):
            at = layer[own] == v
            count[at] = np.searchsorted(_CDF[(1.0 if v == 0 else 2.0 ** (v - 1)) * length], u[at], side="right")
        hit = np.repeat(np.arange(len(own)), count)
        number = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix64(seed[hit] + _GOLDEN * (number.astype(_U) + _U(1)))
        more = mix64(dart + _GOLDEN)
        at = own[hit]
        inside = low[at] + width[at] * _unit(more) < weight[at]
        hit, dart, at = hit[inside], dart[inside], at[inside]
        rank, key = dart >> _U(8), doc[at] * k + (mix64(dart ^ _GOLDEN) % _U(k)).astype(int)
        order = np.lexsort((dart, rank, key))
        key, dart = key[order], dart[order]
        first = np.r_[True, key[1:] != key[:-1]][: len(key)] & ~filled[key]
        out.reshape(-1)[key[first]] = dart[first]
        filled[key[first]] = True
        live &= ~filled.reshape(len(sets), k).all(axis=1)
        start, length, segment = start + length, start + length, segment + 1
    return out


def band_hashes(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket for each band."""
    s = signatures.reshape(len(signatures), bands, rows)
    h = np.tile(mix64(np.arange(1, bands + 1, dtype=_U)), (len(s), 1))
    for r in range(rows):
        h = mix64(h * _GOLDEN + s[:, :, r])
    return h.view(np.int64)


def chunks(texts: list[str]) -> Iterator[tuple[list[str], list[list[str]]]]:
    """Some texts and their words at a time, about `CHUNK` words."""
    own, words, held = [], [], 0
    for t in texts:
        own.append(t)
        words.append(words_of(t))
        held += len(words[-1])
        if held >= CHUNK:
            yield own, words
            own, words, held = [], [], 0
    if own:
        yield own, words


def digest(words: list[str], text: str) -> bytes:
    return hashlib.blake2b((" ".join(words) if words else f"\0{text}").encode("utf-8", "surrogatepass"), digest_size=16).digest()


def signed(df: DataFrame, text: str = "text", doc_id: str = "doc_id", bands: int = BANDS, rows: int = ROWS, weights: str = "tf") -> DataFrame:
    """(doc_id, node, bands) of every row: the digest of its words, and its buckets; none where there are no words."""

    def kernel():
        def run(part: dict) -> dict:
            nodes, found = [], []
            for texts, words in chunks(part["text"].to_pylist()):
                nodes += map(digest, words, texts)
                sets = [shingles(h) for h in word_hashes(words)]
                buckets = band_hashes(dart_signatures([(x, weighed(c, weights)) for x, c in sets], bands * rows), bands, rows)
                found += [f if len(x) else f[:0] for f, (x, _) in zip(buckets, sets, strict=True)]
            return {"doc_id": part["doc_id"], "node": nodes, "bands": found}

        return run

    own = text_or_empty(df, doc_id, text=text).toDF("doc_id", "text")
    return map_slices(own, kernel, f"doc_id {type_of(df, doc_id)}, node binary, bands array<long>")


def shingle_sets(df: DataFrame, wanted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(node, elements, counts) of the texts of the wanted ids, once each; counts are null where nothing is repeated."""
    ids = F.broadcast(wanted) if few_bytes(wanted, "id") else wanted
    texts = df.select(df[doc_id].alias("own"), F.coalesce(df[text], F.lit("")).alias("text")).join(ids, F.col("own").eqNullSafe(F.col("id")), "left_semi")

    def kernel():
        def run(part: dict) -> dict:
            nodes, elements, counts = [], [], []
            for own, words in chunks(part["text"].to_pylist()):
                nodes += map(digest, words, own)
                for x, c in map(shingles, word_hashes(words)):
                    elements.append(x.tobytes())
                    counts.append(c.astype("<u4").tobytes() if len(c) and c.max() > 1 else None)
            return {"node": nodes, "elements": elements, "counts": counts}

        return run

    found = map_slices(texts.select("text"), kernel, "node binary, elements binary, counts binary")
    return found.groupBy("node").agg(F.first("elements").alias("elements"), F.first("counts").alias("counts"))


def unpacked(elements: bytes, counts: bytes | None, weights: str) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(elements, _U)
    return x, np.ones(len(x)) if counts is None or weights == "set" else weighed(np.frombuffer(counts, "<u4"), weights)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (x, p), (y, q) = a, b
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    small = np.minimum(p[i], q[j]).sum()
    return small / max(1.0, p.sum() + q.sum() - small)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, weights: str) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold; a occurs once, b may be a leader of any number of pairs."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x"), F.col("counts").alias("p")), "a")
    met = meet(left, sets.select(F.col("node").alias("b"), F.col("elements").alias("y"), F.col("counts").alias("q")), "b", "a")

    def kernel():
        def run(part: dict) -> dict:
            rows = zip(*(part[c].to_pylist() for c in ("x", "p", "y", "q")), strict=True)
            keep = pa.array([jaccard(unpacked(x, p, weights), unpacked(y, q, weights)) >= similarity for x, p, y, q in rows], pa.bool_())
            return {c: part[c].filter(keep) for c in ("a", "b")}

        return run

    return map_slices(met.select("a", "b", "x", "p", "y", "q"), kernel, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each connected component; smallest labels spread and jump over themselves."""
    both = checkpointed(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = meet(both, labels.withColumnsRenamed({"node": "other", "label": "l"}), "other", "node").groupBy("node").agg(F.min("l").alias("m"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))  # every label is a node
        new = checkpointed(meet(spread, jump, "label", "node").select("node", "old", F.least("label", "further").alias("label")))
        labels = new.select("node", "label")
        if new.filter("label != old").isEmpty():
            return labels


def similarities(sets: list[np.ndarray], weights: list[np.ndarray] | None = None) -> np.ndarray:
    """All weighted Jaccard coefficients of some sets. Elements of one set alone can't be shared, so only the others are counted."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    weight = np.ones(len(row)) if weights is None else np.concatenate(weights)
    total = np.bincount(row, weight, n)
    shared = count[column] > 1
    row, column, weight = row[shared], np.unique(column[shared], return_inverse=True)[1], weight[shared]
    both = np.zeros((n, n))
    order = np.argsort(column, kind="stable")
    row, column, weight = row[order], column[order], weight[order]
    last = column[-1] + 1 if len(column) else 0
    levels = np.unique(weight)
    for at in range(0, last, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        below = 0.0
        for level in levels:  # the smaller of two weights is the sum over the levels that both reach
            up = weight[i:j] >= level
            used, place = np.unique(column[i:j][up], return_inverse=True)
            m = np.zeros((n, len(used)), np.float32)
            m[row[i:j][up], place] = 1
            both += (level - below) * (m @ m.T)
            below = level
    return both / np.maximum(total[:, None] + total[None, :] - both, 1e-300)


def block_links(rows: DataFrame, similarity: float, weights: str) -> DataFrame:
    """Links (a, b) between classes in rows (bucket, one, two, class, elements, counts), which are dealt and sorted by bucket and blocks."""

    def links(group: list[tuple]) -> set[tuple]:
        classes = [g[0] for g in group]
        if len(set(classes)) < 2:
            return set()
        sets = [unpacked(x, p, weights) for _, x, p in group]
        repeated = weights != "set" and any(p is not None for _, _, p in group)
        i, j = np.nonzero(np.triu(similarities([x for x, _ in sets], [w for _, w in sets] if repeated else None) >= similarity, 1))
        return {(min(x, y), max(x, y)) for x, y in ((classes[k], classes[m]) for k, m in zip(i.tolist(), j.tolist(), strict=True)) if x != y}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def out(found: set[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in sorted(found)], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            found: set[tuple] = set()
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                keys = zip(*(part.column(c).to_pylist() for c in ("bucket", "one", "two")), strict=True)
                for own, row in zip(keys, zip(*(part.column(c).to_pylist() for c in ("class", "elements", "counts")), strict=True), strict=True):
                    if own != key:
                        found |= links(group)
                        key, group = own, []
                    group.append(row)
            yield out(found)
        yield out(links(group))

    return rows.select("bucket", "one", "two", "class", "elements", "counts").mapInArrow(run, "a binary, b binary").distinct()


def merged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (node, class) with the classes replaced by those they merged into; a class may have many rows."""
    into = rows.select(F.col("class").alias("node")).distinct().join(labels, "node", "left").select(F.col("node").alias("class"), F.coalesce("label", "node").alias("into"))
    return meet(rows, into, "class", "node").select("node", F.col("into").alias("class"))


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weights: str = "tf", block: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, class_id (smallest doc_id of its class), kept (it is that one)."""
    docs = checkpointed(signed(df, text, doc_id, bands, rows, weights))
    nodes = checkpointed(docs.groupBy("node").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    dealt = nodes.select("node", F.explode("bands").alias("bucket"))
    full = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = checkpointed(meet(dealt, full, "bucket", "node").select("bucket", "n", "node"))  # of buckets with several nodes
    central = checkpointed(members.groupBy("node").agg(F.sum("n").alias("company")))
    wanted = checkpointed(nodes.join(central, "node", "left_semi").select("id").distinct())
    sets = checkpointed(shingle_sets(df, wanted, text, doc_id))

    known = members.join(central, "node")
    leaders = known.groupBy("bucket").agg(F.min_by("node", F.struct(-F.col("company"), F.col("node"))).alias("leader"))
    met = meet(members, leaders, "bucket", "node").filter("node != leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("shared"))
    pairs = met.groupBy(F.col("node").alias("a")).agg(F.max_by("leader", F.struct("shared", "leader")).alias("b"))
    labels = components(verified(pairs, sets, similarity, weights))
    first = checkpointed(central.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("class")))
    classed = checkpointed(members.join(first, "node"))

    several = classed.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low != high").select("bucket")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = meet(classed, several, "bucket", "node").withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    spread = spread.select("node", "class", "bucket", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    compared = spread.join(sets, "node").repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    classes = merged(first, components(block_links(compared, similarity, weights)))

    # The smallest id of every text, then of every class; a node without company is a class of its own.
    ids = nodes.join(classes, "node", "left").select("node", "id", F.coalesce("class", "node").alias("class"))
    named = meet(ids, ids.groupBy("class").agg(F.min("id").alias("class_id")), "class", "node").select("node", "class_id")
    spread = docs.select("doc_id", "node", F.monotonically_increasing_id().alias("_row"))
    return meet(spread, named, "node", "_row").select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df that represent their class, with its columns; rows with a null id or a repeated one that stays are kept.

    The ids that go are broadcast if they are few bytes, else whole rows meet them by a shuffle.
    """
    found = near_duplicates(df, text, doc_id, similarity).filter("doc_id is not null").groupBy(F.col("doc_id").alias("gone")).agg(F.max("kept").alias("kept"))
    gone = checkpointed(found.filter("not kept").select("gone"))
    dealt = F.broadcast(gone) if few_bytes(gone, "gone") else gone
    key = next(f"_key{k}" for k in range(len(df.columns) + 1) if f"_key{k}" not in df.columns)
    rows = df.withColumn(key, df[doc_id])
    return rows.join(dealt.withColumnRenamed("gone", key), key, "left_anti").select(*df.columns)


def op6(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
