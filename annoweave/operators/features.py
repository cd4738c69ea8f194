"""Pair features: taxonomy, and alignments computed as a distributed job over distinct pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

# The BLOSUM62 matrix, rows and columns in this order.
RESIDUES = "ARNDCQEGHILKMFPSTWYVBZX*"
BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1  0 -4
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0 -1 -4
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0 -1 -4
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1 -1 -4
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -4
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3 -1 -4
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2 -1 -4
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0 -1 -4
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3 -1 -4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3 -1 -4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1 -1 -4
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1 -1 -4
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3 -1 -4
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1 -2 -4
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0  0 -4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1  0 -4
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3 -2 -4
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1 -3 -2 -1 -4
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4 -3 -2 -1 -4
-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4  1 -1 -4
-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1 -4
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
"""
_SCORES = np.array([[int(x) for x in line.split()] for line in BLOSUM62.strip().splitlines()])
GAP_OPEN, GAP_EXTEND = 10, 1
#: Cells of one diagonal of all pairs that are aligned together.
ALIGNED_CELLS = 8_192
ALIGNED = ("identity", "similarity", "alignment_score", "gaps_pct", "alignment_length")


def align(a: str, b: str, local: bool = False, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> tuple[float, float, float, float, float]:
    """(identity, similarity, score, gap share, length) of an affine-gap alignment, global or local.

    Row by row in memory linear in the length of b: with every score goes what its best path has counted so far (equal, similar,
    gaps, length), so nothing is walked back. Gaps along a row come from a running maximum, since a gap of length g costs
    open + (g - 1) extend. Of equal paths a pair of residues comes first, then a gap in b; gaps are as short as they can be.
    """
    if len(b) > len(a) and not local:  # memory goes by the shorter one
        return align(b, a, local, gap_open, gap_extend)
    x, y = (np.array([RESIDUES.find(c) if c in RESIDUES else 22 for c in s], int) for s in (a, b))
    letters_x, letters_y = (np.array([ord(c) for c in s], np.int64) for s in (a, b))
    n, m = len(x), len(y)
    low, steps = -(10**9), np.arange(m + 1)
    h, up = np.zeros(m + 1, np.int64), np.full(m + 1, low, np.int64)
    counted, counted_up = np.zeros((4, m + 1), np.int64), np.zeros((4, m + 1), np.int64)  # equal, similar, gaps, length
    if not local:
        h[1:] = -gap_open - gap_extend * steps[:-1]
        counted[2] = counted[3] = steps
    best_score, best = 0, (0, 0, 0, 0)
    for i in range(n):
        opened = h - gap_open >= up - gap_extend
        up = np.maximum(h - gap_open, up - gap_extend)
        counted_up = np.where(opened, counted, counted_up)
        counted_up[2:] += 1
        pair = h[:-1] + _SCORES[x[i], y]
        same = letters_y == letters_x[i]
        own = counted[:, :-1].copy()
        own[0] += same
        own[1] += same | (_SCORES[x[i], y] > 0)
        own[3] += 1
        row, counts = np.empty(m + 1, np.int64), np.empty((4, m + 1), np.int64)
        row[0] = 0 if local else -gap_open - gap_extend * i
        counts[:, 0] = (0, 0, 0, 0) if local else (0, 0, i + 1, i + 1)
        diagonal = pair >= up[1:]
        row[1:] = np.where(diagonal, pair, up[1:])
        counts[:, 1:] = np.where(diagonal, own, counted_up[:, 1:])
        if local:
            none = row <= 0
            row[none], counts[:, none] = 0, 0
        # The last place that reaches the running maximum opens the shortest gap.
        level = row + gap_extend * steps
        reach = np.maximum.accumulate(level)
        origin = np.maximum.accumulate(np.where(level == reach, steps, 0))[:-1]
        left = reach[:-1] - gap_open - gap_extend * (steps[1:] - 1)
        longer = np.flatnonzero(left > row[1:])
        if len(longer):
            begin, gap = origin[longer], longer + 1 - origin[longer]
            filled, row[1 + longer] = counts[:, begin], left[longer]
            filled[2:] += gap
            counts[:, 1 + longer] = filled
        h, counted = row, counts
        if local and (j := int(h.argmax())) >= 0 and h[j] > best_score:
            best_score, best = int(h[j]), tuple(counted[:, j].tolist())
    same, similar, gaps, length = best if local else tuple(counted[:, m].tolist())
    score = float(best_score if local else h[m])
    if not length:
        return 0.0, 0.0, score, 0.0, 0.0
    return same / length, similar / length, score, gaps / length, float(length)


def alike(sizes: list[tuple[int, int]], cells: int = ALIGNED_CELLS) -> Iterator[list[int]]:
    """Numbers of the pairs of lengths in groups of similar ones, so that little is padded; a group's diagonals hold about `cells` cells."""
    own: list[int] = []
    n = m = used = 0
    for at in sorted(range(len(sizes)), key=lambda i: (int(3 * np.log2(max(1, *sizes[i]))), sizes[i][0] > sizes[i][1], min(sizes[i]))):
        a, b = sizes[at]
        n, m, used = max(n, a), max(m, b), used + a * b
        if own and (len(own) * min(n, m) > cells or (len(own) > 4 and n * m * (len(own) + 1) > 1.5 * used)):
            yield own
            own, n, m, used = [], a, b, a * b
        own.append(at)
    if own:
        yield own


def align_together(pairs: list[tuple[str, str]], local: bool = False, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> list[tuple[float, float, float, float, float]]:
    """What `align` gives for each pair, by diagonals of all pairs at once.

    A cell is one 64-bit number: its score above what its best path has counted (gaps, equal, similar, and pairs where local), with two bits
    between that are set while candidates of equal score are chosen from: residues before a gap in b before one in a, and opening before going on.
    Shorter texts are padded by a letter that only lowers scores. Pairs whose numbers don't fit go one by one.
    """
    own = pairs if local else [(b, a) if len(b) > len(a) else (a, b) for a, b in pairs]
    n, m = (max((len(p[side]) for p in own), default=0) for side in (0, 1))
    letters = sorted({c for p in own for s in p for c in s})
    share, gap_bits = min(n, m).bit_length(), (n + m).bit_length()
    fields = {name: gap_bits + share * i for i, name in enumerate(("equal", "similar", "paired")[: 3 if local else 2])}
    low = gap_bits + share * len(fields)  # the bits that choose; the score begins above them
    at = low + 2
    if at + (11 * min(n, m) + (n + m + 4) * max(1, gap_extend) + 4 * gap_open).bit_length() > 62 or len(letters) > 500 or not all(a and b for a, b in own):
        return [align(a, b, local, gap_open, gap_extend) for a, b in pairs]
    code = {c: i + 1 for i, c in enumerate(letters)}  # 0 pads
    residue = np.array([22] + [RESIDUES.find(c) if c in RESIDUES else 22 for c in letters])
    scores = _SCORES[np.ix_(residue, residue)].astype(np.int64)
    scores[0], scores[:, 0] = -4, -4
    same = np.eye(len(residue), dtype=bool)
    same[0, 0] = False
    chosen = 1 << low
    table = (scores << at) + (2 << low) + (same.astype(np.int64) << fields["equal"]) + ((same | (scores > 0)).astype(np.int64) << fields["similar"]) + ((1 << fields["paired"]) if local else 0)
    table, width = table.ravel(), len(residue)
    k = len(own)
    x, y = np.zeros((n, k), np.int64), np.zeros((m, k), np.int64)
    for i, (a, b) in enumerate(own):
        x[: len(a), i] = [code[c] * width for c in a]
        y[m - len(b) :, i] = [code[c] for c in reversed(b)]  # backwards, so that a diagonal is a slice of both
    opened, longer, keep = 1 - (gap_open << at) + chosen, 1 - (gap_extend << at), ~(3 << low)
    least = -(n + m + 4) * gap_extend - 3 * gap_open << at
    h, before, last = (np.zeros((n + 1, k), np.int64) for _ in range(3))  # this diagonal, that before the last, the last one; by place in a
    across, down, down_next = (np.full((n + 1, k), least) for _ in range(3))
    spare, codes = np.empty((n + 1, k), np.int64), np.empty((n + 1, k), np.int64)
    best, below = np.zeros((n + 1, k), np.int64), (1 << at) - 1
    ends, found = {}, np.zeros(k, np.int64)
    for i, (a, b) in enumerate(own):
        ends.setdefault(len(a) + len(b), []).append(i)
    for d in range(1, n + m + 1):
        edge = 0 if local else (-gap_open - gap_extend * (d - 1) << at) + d
        if d <= m:
            h[0], down_next[0] = edge, least
        lo, hi = max(1, d - m), min(n, d - 1) + 1
        if lo < hi:
            e, f, cell, free = across[lo:hi], down_next[lo:hi], h[lo:hi], spare[lo:hi]
            np.add(last[lo:hi], opened, out=free)
            np.add(e, longer, out=e)
            np.maximum(e, free, out=e)
            np.bitwise_and(e, keep, out=e)
            np.add(last[lo - 1 : hi - 1], opened, out=free)
            np.add(down[lo - 1 : hi - 1], longer, out=f)
            np.maximum(f, free, out=f)
            np.bitwise_and(f, keep, out=f)
            np.add(x[lo - 1 : hi - 1], y[m - d + lo : m - d + hi], out=codes[lo:hi])
            np.take(table, codes[lo:hi], out=cell, mode="clip")
            np.add(cell, before[lo - 1 : hi - 1], out=cell)
            np.add(f, chosen, out=free)
            np.maximum(cell, free, out=cell)
            np.maximum(cell, e, out=cell)
            np.bitwise_and(cell, keep, out=cell)
            if local:
                cell[cell <= below] = 0
                np.bitwise_or(best[lo:hi], below, out=free)
                np.copyto(best[lo:hi], cell, where=cell > free)
        if d <= n:
            h[d], across[d] = edge, least
        if not local:
            for i in ends.get(d, ()):
                found[i] = h[len(own[i][0]), i]
        h, before, last = before, last, h
        down, down_next = down_next, down
    if local:
        found = best[np.argmax(best >> at, axis=0), np.arange(k)]
    out = []
    for (a, b), value in zip(own, found.tolist(), strict=True):
        gaps, counts = value & (1 << gap_bits) - 1, {name: value >> shift & (1 << share) - 1 for name, shift in fields.items()}
        length = gaps + (counts["paired"] if local else (len(a) + len(b) - gaps) // 2)
        out.append((counts["equal"] / length, counts["similar"] / length, float(value >> at), gaps / length, float(length)) if length else (0.0, 0.0, float(value >> at), 0.0, 0.0))
    return out


def alignment_features(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Distinct (query, ref) pairs and their global (nw) and local (sw) alignment features; sequences are (id, sequence)."""
    q, r = sequences.select(F.col("id").alias("query"), F.col("sequence").alias("a")), sequences.select(F.col("id").alias("ref"), F.col("sequence").alias("b"))
    met = pairs.select("query", "ref").distinct().join(q, "query").join(r, "ref").select("query", "ref", "a", "b")
    columns = [f"{x}_{m}" for m in ("nw", "sw") for x in ALIGNED] + ["length_query", "length_ref"]

    def together(texts: list[tuple[str, str]], local: bool) -> np.ndarray:
        found = np.empty((len(texts), len(ALIGNED)))
        for own in alike([(len(a), len(b)) if local else (max(len(a), len(b)), min(len(a), len(b))) for a, b in texts]):
            found[own] = align_together([texts[i] for i in own], local)
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(zip(b["a"], b["b"], strict=True))
            lengths = np.array([(len(x), len(y)) for x, y in texts]).reshape(-1, 2)
            found = np.hstack([together(texts, False), together(texts, True), lengths])
            yield pd.concat([b[["query", "ref"]], pd.DataFrame(found, columns=columns, index=b.index).astype({"length_query": int, "length_ref": int})], axis=1)

    kinds = ", ".join(f"{c} {'int' if c.startswith('length') else 'double'}" for c in columns)
    return met.repartition("query", "ref").mapInPandas(run, f"query {pairs.schema['query'].dataType.simpleString()}, ref {pairs.schema['ref'].dataType.simpleString()}, {kinds}")


def lineages(parents: DataFrame) -> DataFrame:
    """(taxonomy_id, lineage) of (taxonomy_id, parent): the way from the root to the taxon itself, by pointer doubling.

    A taxon without a parent, with itself as parent, or with one that isn't in the table is a root. A taxon on a cycle, or below one, has no
    lineage. Each round joins every taxon with the one its way has reached and takes over that one's way, so rounds grow with the
    logarithm of the depth.
    """
    own = parents.select("taxonomy_id", F.when(F.col("parent") != F.col("taxonomy_id"), F.col("parent")).alias("parent")).groupBy("taxonomy_id").agg(F.min("parent").alias("parent"))
    there = own.select(F.col("taxonomy_id").alias("parent"), F.lit(True).alias("_there"))
    ways = own.join(there, "parent", "left").select("taxonomy_id", F.when(F.col("_there"), F.col("parent")).alias("next"), F.array("taxonomy_id").alias("way"))
    ways = graph.checkpointed(ways)
    while ways.filter("next is not null").head(1):
        onward = ways.select(F.col("taxonomy_id").alias("next"), F.col("next").alias("_next"), F.col("way").alias("_way"))
        longer = ways.filter("next is not null").join(onward, "next").select("taxonomy_id", F.col("_next").alias("next"), F.concat("way", "_way").alias("way"))
        # A way that comes back to where it has been, or leads to one that did, ends without a lineage: it takes no part in later rounds.
        open_ = longer.filter(~F.coalesce(F.array_contains("way", F.col("next")), F.lit(False)))
        ways = graph.checkpointed(ways.filter("next is null").unionByName(open_))
    return ways.select("taxonomy_id", F.reverse("way").alias("lineage"))


def taxonomy_features(pairs: DataFrame, lineages: DataFrame) -> DataFrame:
    """pairs (with query_taxonomy_id, ref_taxonomy_id) and the lowest common ancestor, distance, common ancestors and relation.

    Lineages are (taxonomy_id, lineage) from the root to the taxon itself; the distance counts both end nodes. An
    unknown taxon gives distance null, 0 common ancestors and `unrelated`.
    """
    one, two = lineages.select(F.col("taxonomy_id").alias("query_taxonomy_id"), F.col("lineage").alias("l1")), lineages.select(F.col("taxonomy_id").alias("ref_taxonomy_id"), F.col("lineage").alias("l2"))
    p = pairs.join(one, "query_taxonomy_id", "left").join(two, "ref_taxonomy_id", "left")
    t1, t2, l1, l2 = F.col("query_taxonomy_id"), F.col("ref_taxonomy_id"), F.col("l1"), F.col("l2")
    known, same = l1.isNotNull() & l2.isNotNull(), t1 == t2
    shared = F.array_intersect(l1, l2)
    common = F.size(shared)
    lca = F.when(common > 0, F.element_at(shared, -1))
    distance = (F.size(l1) - F.array_position(l1, lca) + 1) + (F.size(l2) - F.array_position(l2, lca) + 1)
    relation = (
        F.when(F.array_contains(l2, t1), "ancestor").when(F.array_contains(l1, t2), "descendant").when((common == 1) & (lca == 1), "root-only").when(common <= 2, "distant").when(common <= 15, "intermediate").otherwise("close")
    )
    none = F.lit(None).cast("int")
    return p.select(
        *pairs.columns,
        F.when(same, t1).when(known, lca).otherwise(none).cast("int").alias("taxonomic_lca"),
        F.when(same, 0).when(known, distance).otherwise(none).cast("int").alias("taxonomic_distance"),
        F.when(same, 1).when(known, common).otherwise(0).cast("int").alias("taxonomic_common_ancestors"),
        F.when(same, "same").when(known, relation).otherwise("unrelated").alias("taxonomic_relation"),
    )
