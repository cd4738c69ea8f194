"""Merkle manifest of a dataset with octopus multiproofs.

Rows are leaves; per tree (a language) leaves ascend by id, and every `ARITY` nodes in a row make one of the next level until one
remains, the tree's subroot. Subroots in the order of their trees make the top tree, whose last node is the root of the dataset.
Digests are sha256 over the hexadecimal text of the digests below.

1. Leaves are digested in the JVM and range-sorted by tree, id and digest; a place is the count of the parts before, by prefix sums over
   one row a part, and the row's number in its part.
2. Nodes are made in blocks of `BLOCK` aligned leaves, whose tops are the leaves of the next pass; so no task sees more than
   one block, and passes grow with the logarithm of the rows.
3. Multiproof: each block of the leaves to prove (all of them or a few) computes the smallest set of node coordinates (tree, level, place)
   it can't derive, level by level, as octopus authentication does: of every run that a known node is in, the members that aren't
   known. The sets of all blocks are met with the node table by one join, in which wanted nodes of high levels, which all
   blocks share, are dealt out under salts.
4. With what it fetched, a block derives the shared interior nodes once and expands the proof of each leaf from them.

A null value has the digest input `-`, so it differs from every text. Null ids come first and rows of one id are ordered by digest; equal rows
are leaves of their own. A null tree is a tree, before all others. An empty table has no leaves and no root. Very long texts are
digested whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, meet, table, type_of

ARITY = 8
#: Levels that one block makes: 8^4 leaves.
LEVELS = 4
BLOCK = ARITY**LEVELS
#: The tree over the subroots. Names of other trees are empty or begin with "=".
TOP = "^"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts: bytes) -> bytes:
    """The sha256 of the parts one after another, as hexadecimal text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field_text(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    own = value.cast("string")
    return F.when(own.isNull(), "-").otherwise(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_text(v) for v in values]), 256))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tree_name(value: Column) -> Column:
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value.cast("string")))


def placed(rows: DataFrame) -> DataFrame:
    """rows (tree, order, digest, ...) with `place` and `total`: the row's number in its tree by order and digest, and the tree's rows.

    The sorted parts are kept by a checkpoint, since a range sort that is run again may cut elsewhere.
    """
    by = ["tree", "order", "digest"]
    part = checkpointed(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = part.withColumn("_part", F.shiftright("_at", 33))
    counts = part.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part")
    whole = Window.partitionBy("tree")
    offsets = counts.select("tree", "_part", "_first", (F.sum("_n").over(before) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("total"))
    found = part.join(offsets, ["tree", "_part"])
    return found.withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


NODES = "tree string, level int, place long, total long, digest binary"


def block_nodes(leaves: pa.Table) -> pa.Table:
    """The nodes above one block of nodes of a level: up to `LEVELS` levels, or up to the tree's last node. `total` counts the nodes of a level of the tree."""
    order = np.argsort(leaves.column("place").to_numpy())
    tree, level, total = leaves.column("tree")[0].as_py(), leaves.column("level")[0].as_py(), leaves.column("total")[0].as_py()
    at = int(leaves.column("place").to_numpy()[order[0]])
    own = [d.hex().encode() for d in leaves.column("digest").take(pa.array(order)).to_pylist()]
    out = []
    for _ in range(LEVELS):
        if total == 1:
            break
        own = [hashed(*own[k : k + ARITY]) for k in range(0, len(own), ARITY)]
        level, at, total = level + 1, at // ARITY, -(-total // ARITY)
        out += [(tree, level, at + k, total, bytes.fromhex(d.decode())) for k, d in enumerate(own)]
    return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["tree", "level", "place", "total", "digest"])


def levels_above(leaves: DataFrame) -> DataFrame:
    """All nodes above the leaves (tree, place, total, digest) of their trees, and the last node of each tree (the leaf itself where there is but one)."""
    tops = leaves.select("tree", F.lit(0).cast("int").alias("level"), "place", "total", "digest")
    out = tops.filter("total = 1")
    while True:
        open_ = tops.filter("total > 1")
        if not open_.head(1):
            return out
        made = checkpointed(open_.withColumn("_block", F.floor(F.col("place") / BLOCK)).groupBy("tree", "_block").applyInArrow(lambda t: block_nodes(t.drop_columns(["_block"])), NODES))
        out = out.unionByName(made)
        highest = made.groupBy("tree").agg(F.max("level").alias("_highest"))
        tops = made.join(highest, "tree").filter("level = _highest").drop("_highest")


@dataclass
class Manifest:
    """leaves (tree, order, digest, place, total and the columns of their rows), nodes (tree, level, place, total, digest) above them with those of the top tree, and trees (tree, digest, place, total) as leaves of the top tree."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame

    def root(self) -> str | None:
        """The digest of the dataset; None where it has no rows."""
        found = self.nodes.filter((F.col("tree") == TOP) & (F.col("total") == 1)).select(F.lower(F.hex("digest"))).first()
        return found[0] if found else None


def manifest(leaves: DataFrame) -> Manifest:
    """The tree over leaves (tree, order, digest, ...)."""
    leaves = checkpointed(placed(leaves))
    own = levels_above(leaves)
    subroots = own.filter("total = 1").select(F.lit(TOP).alias("tree"), F.col("tree").alias("order"), "digest")
    trees = checkpointed(placed(subroots))
    return Manifest(leaves, own.unionByName(levels_above(trees)), trees.select(F.col("order").alias("tree"), "digest", "place", "total"))


# -- proofs


def missing(places: np.ndarray, total: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, places of the nodes to fetch) so that all nodes above the given ones of a tree can be derived: of every run that is touched, what isn't known."""
    known, level = np.unique(places), 0
    while total > 1:
        runs = np.unique(known // ARITY)
        members = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        yield level, np.setdiff1d(members[members < total], known, assume_unique=True)
        known, level, total = runs, level + 1, -(-total // ARITY)


WANTED = "tree string, _block long, _tree string, _level int, _place long"


def wanted_nodes(own: pa.Table) -> pa.Table:
    """The coordinates that a block of leaves has to fetch, in its tree and in the top tree."""
    tree, block = own.column("tree")[0].as_py(), own.column("_block")[0].as_py()
    out: list[tuple] = []
    for name, places, total in ((tree, own.column("place").to_numpy(), own.column("total")[0].as_py()), (TOP, own.column("_rank").to_numpy()[:1], own.column("_trees")[0].as_py())):
        out += [(tree, block, name, level, int(p)) for level, found in missing(places, total) for p in found]
    return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()))], names=["tree", "_block", "_tree", "_level", "_place"])


class Multiproof:
    """The nodes above some leaves of a tree, derived from those and from fetched ones ((level, place) -> digest)."""

    def __init__(self, leaves: dict[int, bytes], total: int, fetched: dict[tuple[int, int], bytes]):
        self.total = total
        #: Of every level: the digests of each touched run.
        self.runs: list[dict[int, list[bytes]]] = []
        self.above: dict[tuple[int, int, bytes], bytes] = {}
        known, level = leaves, 0
        while total > 1:
            runs = {}
            for run in {p // ARITY for p in known}:
                first = run * ARITY
                runs[run] = [known[p] if p in known else fetched[level, p] for p in range(first, min(first + ARITY, total))]
            self.runs.append(runs)
            known = {run: hashed(*own) for run, own in runs.items()}
            level, total = level + 1, -(-total // ARITY)
        (self.root,) = known.values()
        self.tails: list[dict[int, bytes]] = [{} for _ in self.runs] + [{0: b""}]

    def siblings(self, place: int, level: int = 0) -> bytes:
        """The siblings on the way from a node to the last one of its tree, as one text; those that nodes share are put together once."""
        tails = self.tails[level]
        if place not in tails:
            own = self.runs[level][place // ARITY]
            at = place % ARITY
            tails[place] = b"".join(own[:at] + own[at + 1 :]) + self.siblings(place // ARITY, level + 1)
        return tails[place]

    def fold(self, digest: bytes, place: int) -> bytes:
        """What the last node would be if a leaf were this digest and its siblings were as they are."""
        for level, runs in enumerate(self.runs):
            key = (level, place, digest)
            if key not in self.above:
                own, at = runs[place // ARITY], place % ARITY
                self.above[key] = hashed(*own[:at], digest, *own[at + 1 :])
            digest, place = self.above[key], place // ARITY
        return digest


def proofs(m: Manifest, leaves: DataFrame | None = None, claimed: str | None = None, keep: tuple[str, ...] = (), with_siblings: bool = False) -> DataFrame:
    """One row a leaf to prove: the columns to keep, leaf, subroot, root, proof_sha256, folded_root, verified; with_siblings adds the proof itself.

    `leaves` are rows of the manifest's leaves, all of them unless given. Folding begins with the digest in the column `claimed` where it isn't null.
    """
    own = m.leaves if leaves is None else leaves
    trees = m.trees.select("tree", F.col("place").alias("_rank"), F.col("total").alias("_trees"), F.col("digest").alias("_subroot"))
    own = own.withColumn("_block", F.floor(F.col("place") / BLOCK)).join(F.broadcast(trees) if m.trees.count() <= 10_000 else trees, "tree")
    wanted = own.select("tree", "_block", "place", "total", "_rank", "_trees").groupBy("tree", "_block").applyInArrow(wanted_nodes, WANTED)
    all_nodes = m.nodes.select("tree", "level", "place", "digest")
    all_nodes = all_nodes.unionByName(m.trees.select(F.lit(TOP).alias("tree"), F.lit(0).cast("int").alias("level"), "place", "digest"))
    if leaves is not None:
        all_nodes = all_nodes.unionByName(m.leaves.select("tree", F.lit(0).cast("int").alias("level"), "place", "digest"))
    lookup = all_nodes.select(F.struct(F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("place").alias("_place")).alias("_node"), F.col("digest").alias("_digest")).dropDuplicates(["_node"])
    asked = wanted.select("tree", "_block", F.struct("_tree", "_level", "_place").alias("_node"))
    fetched = meet(asked, lookup, "_node", "_block").select("tree", "_block", "_node._tree", "_node._level", "_node._place", "_digest")
    types = {c: type_of(own, c) for c in keep}
    schema = ", ".join([f"`{c}` {t}" for c, t in types.items()] + ["leaf string", "subroot string", "root string", "proof_sha256 string", "folded_root string", "verified boolean"] + ["siblings array<string>"] * with_siblings)

    def expand(block: pa.Table, nodes: pa.Table) -> pa.Table:
        name = block.column("tree")[0].as_py()
        found: dict[str, dict] = {name: {}, TOP: {}}
        for tree, level, place, digest in zip(*[nodes.column(c).to_pylist() for c in ("_tree", "_level", "_place", "_digest")], strict=True):
            found[tree][level, place] = digest.hex().encode()
        digests = [d.hex().encode() for d in block.column("digest").to_pylist()]
        places = block.column("place").to_pylist()
        inner = Multiproof(dict(zip(places, digests, strict=True)), block.column("total")[0].as_py(), found[name])
        rank = block.column("_rank")[0].as_py()
        outer = Multiproof({rank: inner.root}, block.column("_trees")[0].as_py(), found[TOP])
        tail = outer.siblings(rank)
        given = block.column(claimed).to_pylist() if claimed else [None] * len(places)
        out: list[list] = [[] for _ in range(6 + with_siblings)]
        root = outer.root.decode()
        for place, digest, claim in zip(places, digests, given, strict=True):
            proof = inner.siblings(place) + tail
            folded = outer.fold(inner.fold(digest if claim is None else claim.hex().encode(), place), rank).decode()
            row = [digest.decode(), inner.root.decode(), root, hashed(proof).decode(), folded, folded == root]
            if with_siblings:
                row.append([proof[k : k + 64].decode() for k in range(0, len(proof), 64)])
            for column, value in zip(out, row, strict=True):
                column.append(value)
        names = [*keep, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["siblings"] * with_siblings
        return pa.Table.from_arrays([*[block.column(c) for c in keep], *[pa.array(c, pa.list_(pa.string())) if n == "siblings" else pa.array(c) for n, c in zip(names[len(keep) :], out, strict=True)]], names=names)

    columns = ["tree", "_block", "digest", "place", "total", "_rank", "_trees", *([claimed] if claimed else []), *keep]
    left = own.select(*dict.fromkeys(columns)).groupBy("tree", "_block")
    return left.cogroup(fetched.groupBy("tree", "_block")).applyInArrow(expand, schema)


def document_leaves(docs: DataFrame) -> DataFrame:
    """The leaves of documents, with the digest of their tampered rows: where 3 divides the crc32 of the id, A-Z of the text lower-cased."""
    own = docs.select(*[docs[c] for c in FIELDS])
    values = {c: F.col(c) for c in FIELDS}
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = leaf_digest(*(values | {"text": ascii_lower(F.col("text"))}).values())
    return own.select(tree_name(F.col("lang")).alias("tree"), F.col("doc_id").alias("order"), leaf_digest(*values.values()).alias("digest"), F.when(changed, tampered).alias("tampered"))


def op11(spark, sf_dir):
    """The proof of every document, and whether it still leads to the root after tampering."""
    m = manifest(checkpointed(document_leaves(table(spark, sf_dir, "documents"))))
    return proofs(m, claimed="tampered", keep=("order",)).withColumnRenamed("order", "doc_id")


# -- the same in SQL: levels one by one, enough for 8^8 documents of a language and 8^4 languages


def _field_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"


def _level_sql(name: str, key: str) -> str:
    """Nodes of a level with the siblings of their run on the left and on the right."""
    run = f"(PARTITION BY {key}, i // {ARITY} ORDER BY i ROWS BETWEEN"
    return f"SELECT *, coalesce(string_agg(digest, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}"


def _tree_sql(prefix: str, first: str, key: str, levels: int) -> list[str]:
    """Tables prefix0 to prefix<levels>; a tree's last node is handed up as it is."""
    parts = [f"{prefix}0 AS ({_level_sql(f'({first})', key)})"]
    for k in range(levels):
        up = f"SELECT {key}, i // {ARITY} AS i, CASE WHEN max(n) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY i)) END AS digest, (max(n) + {ARITY - 1}) // {ARITY} AS n FROM {prefix}{k} GROUP BY ALL"
        parts.append(f"{prefix}{k + 1} AS ({_level_sql(f'({up})', key)})")
    return parts


def _op11_sql(levels: int = 8, top: int = 4) -> str:
    crc = "xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: [ascii(CAST(doc_id AS VARCHAR)[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    leaf = " || ".join(_field_sql(c) for c in FIELDS)
    changed = " || ".join(_field_sql(f"translate(text, '{letters}', '{letters.lower()}')" if c == "text" else c) for c in FIELDS)
    parts = [
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({leaf}) AS digest, CASE WHEN {crc} % 3 = 0 THEN sha256({changed}) ELSE sha256({leaf}) END AS claim FROM documents)",
        "p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d)",
        *_tree_sql("a", "SELECT tree, i, digest, n FROM p", "tree", levels),
        f"s AS (SELECT tree, digest FROM a{levels})",
        *_tree_sql("b", "SELECT 1 AS one, row_number() OVER (ORDER BY tree) - 1 AS i, digest, (SELECT count(*) FROM s) AS n FROM s", "one", top),
        "q AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS j FROM s)",
        "f0 AS (SELECT p.doc_id, p.digest AS leaf, p.claim AS c, '' AS proof, p.i, p.tree, q.j FROM p JOIN q ON q.tree = p.tree)",
    ]
    for k in range(levels + top):
        node, on = (f"a{k}", f"x.tree = f.tree AND x.i = f.i // {ARITY**k}") if k < levels else (f"b{k - levels}", f"x.i = f.j // {ARITY ** (k - levels)}")
        parts.append(f"f{k + 1} AS (SELECT f.doc_id, f.leaf, CASE WHEN x.n = 1 THEN f.c ELSE sha256(x.l || f.c || x.r) END AS c, f.proof || x.l || x.r AS proof, f.i, f.tree, f.j FROM f{k} f JOIN {node} x ON {on})")
    return f"WITH {', '.join(parts)} SELECT f.doc_id, f.leaf, s.digest AS subroot, t.digest AS root, sha256(f.proof) AS proof_sha256, f.c AS folded_root, f.c = t.digest AS verified FROM f{levels + top} f JOIN s ON s.tree = f.tree CROSS JOIN b{top} t"


OP11_SQL = _op11_sql()
