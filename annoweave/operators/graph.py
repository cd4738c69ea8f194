"""Label graph: closures, negative propagation, ancestor subgraphs, score propagation. Edges are (child, parent, relation_type)."""

from __future__ import annotations

import re
import tempfile
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLOSURE_RELATIONS = ("is_a", "part_of")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """The session's spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a session whose tasks run in the driver's own process gets a temporary folder; a cluster gets an error, since
    its executors don't see the driver's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix=f"spark-{purpose}-")
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the session's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def steps_of(edges: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    return edges.filter(F.col("relation_type").isin(*relations)).select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct()


def numbered(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the pairs as numbers, (number, term)): terms named by a 64-bit hash with the first seed that gives each its own."""
    terms = checkpointed(steps.select(F.col("ancestor").alias("term")).union(steps.select("descendant")).distinct())
    seed, n = 0, terms.count()
    while terms.select(F.xxhash64("term", F.lit(seed))).distinct().count() < n:
        seed += 1
    return steps.select(*[F.xxhash64(c, F.lit(seed)).alias(c) for c in ("ancestor", "descendant")]), terms.select(F.xxhash64("term", F.lit(seed)).alias("number"), "term")


def peeled(steps: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(core, layers): the steps down to terms without descendants, then to those that have none left, and so on, while a layer holds a quarter of what is left.

    So layers are as many as the logarithm of the steps. Cycles, and what is deep and narrow, stay in the core.
    """
    core, n, layers = steps, steps.count(), []
    while n:
        inner = core.select(F.col("ancestor").alias("descendant")).distinct()
        rest = core.join(inner, "descendant", "left_semi").select("ancestor", "descendant")
        left = rest.count()
        if left > 0.75 * n:
            break
        layers.append(core.join(inner, "descendant", "left_anti").select("ancestor", "descendant"))
        core, n = checkpointed(rest), left
    return core, layers


def paired(steps: DataFrame) -> DataFrame:
    """(ancestor, descendant, far) of the closure of any steps, cycles too, by doubling.

    A pair further apart than all known ones begins with a pair of just the greatest distance so far: in each round only those, found in the last
    one, are extended, by all known pairs. Distances double, so rounds grow with the logarithm of the depth.
    """
    known = found = checkpointed(steps.withColumn("far", F.lit(1)))
    reach = 1
    while found.filter(F.col("far") == reach).head(1):
        onward = known.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("next"), (F.col("far") + reach).alias("_far"))
        longer = found.filter(F.col("far") == reach).join(onward, "descendant").groupBy("ancestor", F.col("next").alias("descendant")).agg(F.min("_far").alias("far"))
        found = checkpointed(longer.join(known, ["ancestor", "descendant"], "left_anti"))
        known = known.unionByName(found)
        reach *= 2
    return known


def ancestor_lists(steps: DataFrame, layers: list[DataFrame], core: DataFrame) -> DataFrame:
    """(descendant, ancestors): the terms above each term. The core's pairs are listed, layers take over the lists of their parents, so every step moves one list."""
    lists = core.groupBy("descendant").agg(F.collect_list("ancestor").alias("ancestors"))
    for layer in reversed(layers):
        above = layer.join(lists.withColumnRenamed("descendant", "ancestor"), "ancestor", "left")
        own = F.concat(F.array("ancestor"), F.coalesce("ancestors", F.array().cast("array<long>")))
        lists = lists.unionByName(checkpointed(above.groupBy("descendant").agg(F.array_distinct(F.flatten(F.collect_list(own))).alias("ancestors"))))
    return lists


@dataclass(frozen=True)
class Closure:
    """Steps and the layers and closed core they were peeled into, as numbers, and (number, term)."""

    steps: DataFrame
    layers: list[DataFrame]
    core: DataFrame
    terms: DataFrame

    @cached_property
    def lists(self) -> DataFrame:
        """(descendant, ancestors): the closure as one list a term."""
        return ancestor_lists(self.steps, self.layers, self.core)


def closed(edges: DataFrame, relations: tuple[str, ...] = CLOSURE_RELATIONS) -> Closure:
    """The closure of edges, of numbers in place of terms; its lists are made when they are asked for."""
    steps, terms = numbered(checkpointed(steps_of(edges, relations)))
    core, layers = peeled(steps)
    return Closure(steps, layers, paired(core), terms)


def inherited(core: DataFrame, layers: list[DataFrame], own: DataFrame) -> DataFrame:
    """(descendant, items): the items of each term and of all terms above it, from rows (descendant, items) of numbers; terms without any are left out.

    `core` is closed, `layers` are those of `peeled`: a term of a layer takes over the lists of its parents, so every step moves one list.
    """

    def merged(rows: DataFrame) -> DataFrame:
        return checkpointed(rows.groupBy("descendant").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))

    def handed(pairs: DataFrame, lists: DataFrame) -> DataFrame:
        return pairs.join(lists.toDF("ancestor", "items"), "ancestor").select("descendant", "items")

    # Layers have descendants of their own, so a row is dealt to its layer once.
    if layers:
        layer_of = reduce(DataFrame.unionByName, [layer.select("descendant", F.lit(i).alias("_layer")).distinct() for i, layer in enumerate(layers)])
        own = checkpointed(own.join(layer_of, "descendant", "left"))
    inside = merged(own.filter("_layer is null").select("descendant", "items") if layers else own)
    lists = merged(inside.unionByName(handed(core, inside))) if core.head(1) else inside
    for i in reversed(range(len(layers))):
        here = own.filter(F.col("_layer") == i).select("descendant", "items")
        lists = lists.unionByName(merged(handed(layers[i], lists).unionByName(here)))
    return lists


def named_pairs(lists: DataFrame, terms: DataFrame) -> DataFrame:
    """(ancestor, descendant) of lists of numbers, by name."""
    named = lists.join(terms.toDF("descendant", "_descendant"), "descendant")
    return named.select("_descendant", F.explode("ancestors").alias("ancestor")).join(terms.toDF("ancestor", "_ancestor"), "ancestor").select(F.col("_ancestor").alias("ancestor"), F.col("_descendant").alias("descendant"))


def descendants(edges: DataFrame, relations: tuple[str, ...] = CLOSURE_RELATIONS) -> DataFrame:
    """(ancestor, descendant) of the transitive closure. A term is its own descendant only by a cycle.

    Terms outside the core get the list of their ancestors layer by layer, and lists become pairs at the end; work is on numbers in place of terms.
    """
    steps, terms = numbered(checkpointed(steps_of(edges, relations)))
    core, layers = peeled(steps)
    pairs = paired(core)
    if layers:
        return checkpointed(named_pairs(ancestor_lists(steps, layers, pairs), terms))
    for c in ("ancestor", "descendant"):
        pairs = pairs.join(terms.toDF(c, f"_{c}"), c)
    return checkpointed(pairs.select(F.col("_ancestor").alias("ancestor"), F.col("_descendant").alias("descendant")))


def with_terms(terms: DataFrame, steps: DataFrame) -> DataFrame:
    """(number, term) with the terms of steps that have no number yet, by the first seed that gives all their own."""
    fresh = checkpointed(steps.select(F.col("ancestor").alias("term")).union(steps.select("descendant")).distinct().join(terms, "term", "left_anti"))
    seed, n = 0, terms.count() + fresh.count()
    while True:
        found = terms.unionByName(fresh.select(F.xxhash64("term", F.lit(seed)).alias("number"), "term"))
        if found.select("number").distinct().count() == n:
            return found
        seed += 1


def extend_descendants(closure: DataFrame | Closure, added: DataFrame, relations: tuple[str, ...] = CLOSURE_RELATIONS) -> DataFrame:
    """(ancestor, descendant) of a closure with edges added.

    Only terms on or below an added edge get new lists: from the untouched lists above them and layer by layer among themselves. A closure given
    with its steps (`closed`) moves one list a step; one given as pairs, whose steps aren't known, moves one a pair.
    """
    if isinstance(closure, Closure):
        steps, lists, terms = closure.steps, closure.lists, closure.terms
    else:
        steps, terms = numbered(checkpointed(closure.select("ancestor", "descendant").distinct()))
        lists = steps.groupBy("descendant").agg(F.collect_list("ancestor").alias("ancestors"))
    own = checkpointed(steps_of(added, relations))
    terms = checkpointed(with_terms(terms, own))
    for c in ("ancestor", "descendant"):
        own = own.join(terms.toDF(f"_{c}", c), c).drop(c)
    fresh = checkpointed(own.toDF("ancestor", "descendant"))
    ends = fresh.select("descendant").distinct()
    below = lists.select("descendant", F.explode("ancestors").alias("ancestor")).join(ends.toDF("ancestor"), "ancestor", "left_semi").select("descendant")
    touched = checkpointed(ends.union(below).distinct())
    kept = lists.join(touched, "descendant", "left_anti").select("descendant", F.col("ancestors").alias("items"))
    again = checkpointed(steps.join(touched, "descendant", "left_semi").select("ancestor", "descendant").unionByName(fresh).distinct())
    outer = again.join(kept.toDF("ancestor", "items"), "ancestor").select("descendant", "items")
    core, layers = peeled(checkpointed(again.join(touched.toDF("ancestor"), "ancestor", "left_semi").select("ancestor", "descendant")))
    found = inherited(paired(core), layers, again.select("descendant", F.array("ancestor").alias("items")).unionByName(outer))
    return named_pairs(kept.unionByName(found).toDF("descendant", "ancestors"), terms)


def closing(edges: DataFrame, relations: tuple[str, ...] = CLOSURE_RELATIONS) -> DataFrame:
    """The edges of relations that a closure follows."""
    return edges.filter(F.col("relation_type").isin(*relations))


def within_aspect(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """Edges between terms (go_id, aspect) of one aspect; those to unknown terms go."""
    own = terms.select("go_id", "aspect").distinct()
    child, parent = own.select(F.col("go_id").alias("child"), F.col("aspect").alias("_a")), own.select(F.col("go_id").alias("parent"), F.col("aspect").alias("_b"))
    return edges.join(child, "child").join(parent, "parent").filter("_a = _b").select(*edges.columns)


def leveled(edges: DataFrame, relations: tuple[str, ...] = CLOSURE_RELATIONS) -> DataFrame:
    """(child, parent, level, parent_level) of an acyclic graph: a term without children is of level 0, others are one above their highest child.

    Each round keeps the edges whose child is the parent of one kept before, so rounds are as many as levels. A cycle is an error.
    """
    steps = steps_of(edges, relations).toDF("parent", "child")
    kept, level, above, left = checkpointed(steps), 0, None, None
    while (n := kept.count()) and n != left:
        level, left = level + 1, n
        parents = kept.select("parent").distinct()
        own = parents.withColumn("level", F.lit(level))
        above = own if above is None else above.unionByName(own)
        kept = checkpointed(kept.join(parents.toDF("child"), "child", "left_semi"))
    if n:
        raise ValueError(f"terms on or above a cycle: {', '.join(r[0] for r in kept.select('child').distinct().orderBy('child').limit(5).collect())}")
    if above is None:
        return steps.select("child", "parent", F.lit(0).alias("level"), F.lit(1).alias("parent_level"))
    highest = above.groupBy("parent").agg(F.max("level").alias("level"))
    return checkpointed(steps.join(highest.toDF("child", "level"), "child", "left").join(highest.toDF("parent", "parent_level"), "parent").select("child", "parent", F.coalesce("level", F.lit(0)).alias("level"), "parent_level"))


def propagate(rows: DataFrame, edges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows (keys, go_id, value) carried up edges without cycles, leveled or of relations that count: the greatest value of each term's own row and of those below it.

    Rows are dealt by their keys to tasks that hold the graph. Where it is too large for that, there is one join a level: rows of a level are reduced
    to one a term before they are handed to its parents, and what was handed up is kept by a checkpoint and waits for the level of its term.
    """
    from . import climb

    if climb.fits(edges):
        return climb.greatest(rows, edges, keys, value)
    edges = edges if "level" in edges.columns else leveled(edges)
    of_term = edges.select(F.col("child").alias("go_id"), "level").union(edges.select("parent", "parent_level")).distinct()
    own = rows.select(*keys, "go_id", value)
    waiting = checkpointed(own.join(of_term, "go_id", "left").select(*own.columns, F.coalesce("level", F.lit(-1)).alias("level")))
    for level in sorted(r[0] for r in edges.select("level").distinct().collect()):  # as many as the graph is deep
        here = waiting.filter(F.col("level") == level).groupBy(*keys, "go_id").agg(F.max(value).alias(value))
        up = edges.filter(F.col("level") == level).select(F.col("child").alias("go_id"), "parent", "parent_level")
        waiting = waiting.unionByName(checkpointed(here.join(up, "go_id").select(*keys, F.col("parent").alias("go_id"), value, F.col("parent_level").alias("level"))))
    return waiting.groupBy(*keys, "go_id").agg(F.max(value).alias(value))


def carried_up(terms: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((go_id, aspect, numbers, weights), (go_id, number, aspect)) of terms (go_id, aspect, ia).

    For every term of the edges or of the table, the terms that a row of it counts for, itself and those above it: for each aspect their
    numbers and weights as two lists. Terms that aren't in the table are only led over.
    """
    itself = terms.select("go_id")
    if edges is None:
        lists, names = None, numbered(itself.select(F.col("go_id").alias("ancestor"), F.col("go_id").alias("descendant")))[1]
    else:
        own = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct()
        loops = itself.select(F.col("go_id").alias("ancestor"), F.col("go_id").alias("descendant"))
        pairs, names = numbered(checkpointed(own.unionByName(loops)))
        steps = pairs.filter("ancestor <> descendant")
        core, layers = peeled(steps)
        lists = ancestor_lists(steps, layers, paired(core))
    names = names.withColumnRenamed("term", "go_id")
    numbers = checkpointed(terms.join(names, "go_id").select("go_id", "number", "aspect", "ia"))
    reach = names.select(F.col("number").alias("descendant"), F.col("number"))
    if lists is not None:
        reach = reach.unionByName(lists.select("descendant", F.explode("ancestors").alias("number")))
    listed = reach.join(numbers.select("number", "aspect", "ia"), "number").groupBy("descendant", "aspect").agg(F.collect_list(F.struct("number", "ia")).alias("x"))
    return names.toDF("descendant", "go_id").join(listed, "descendant").select("go_id", "aspect", F.col("x.number").alias("numbers"), F.col("x.ia").alias("weights")), numbers.select("go_id", "number", "aspect")


def negative_keys(annotations: DataFrame, edges: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(protein, go_id) that a negated annotation rules out: its term and all its descendants. The closure is computed unless given."""
    closure = descendants(edges) if closure is None else closure
    negated = annotations.filter(F.col("qualifier").contains("NOT")).select("protein", "go_id").distinct()
    below = negated.join(closure.select(F.col("ancestor").alias("go_id"), "descendant"), "go_id").select("protein", F.col("descendant").alias("go_id"))
    return negated.union(below).distinct()


#: Marks that a term's list may hold at most; more are worked on in shares.
MARKS = 1 << 20


def ruled_out(pairs: DataFrame, annotations: DataFrame, closure: Closure, since: str | None = None) -> DataFrame:
    """The (protein, go_id) among pairs that a negated annotation of the protein rules out: those of `negative_keys` without the others.

    Proteins that negate a term are handed down the steps of `closed` as lists of numbers, and a pair meets the list of its term once: no list is
    made into rows. With `since`, a column of the annotations, the first of its values that rules a pair out goes along.
    """
    names = ["protein", "go_id"]
    first = F.min(F.lit(0) if since is None else F.col(since)).alias("_since")
    negated = checkpointed(annotations.filter(F.col("qualifier").contains("NOT")).groupBy(*names).agg(first))
    # A mark is the number of a protein and a value of `since`: by the first seed that gives each its own.
    values = checkpointed(negated.select("protein", "_since").distinct())
    seed, n = 0, values.count()
    while values.select(F.xxhash64("protein", "_since", F.lit(seed))).distinct().count() < n:
        seed += 1
    mark, numbers = F.xxhash64("protein", "_since", F.lit(seed)), closure.terms.withColumnRenamed("term", "go_id")
    of_protein = values.groupBy("protein").agg(F.collect_list(F.struct(mark.alias("mark"), "_since")).alias("_marks"))
    of_term = negated.select("go_id", mark.alias("mark"))
    shares, found = max(1, -(-n // MARKS)), []
    for i in range(shares):
        share = of_term.filter(F.pmod("mark", F.lit(shares)) == i)
        own = checkpointed(share.join(numbers, "go_id").groupBy(F.col("number").alias("descendant")).agg(F.collect_list("mark").alias("items")))
        lists = inherited(closure.core, closure.layers, own).join(numbers.withColumnRenamed("number", "descendant"), "descendant").select("go_id", "items")
        found.append(lists.unionByName(share.join(numbers, "go_id", "left_anti").groupBy("go_id").agg(F.collect_list("mark").alias("items"))))
    lists = reduce(DataFrame.unionByName, found)
    met = pairs.select(*names).join(of_protein, "protein").join(lists, "go_id")
    hit = met.select(*names, F.filter("_marks", lambda m: F.array_contains(F.col("items"), m["mark"])).alias("_hit")).filter(F.size("_hit") > 0)
    ruled = hit.groupBy(*names).agg(F.min(F.array_min(F.transform("_hit", lambda m: m["_since"]))).alias("_since"))
    return ruled.select(*names) if since is None else ruled.withColumnRenamed("_since", since)


def ancestor_subgraph(seeds: DataFrame, edges: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes (go_id, is_query) and edges within `depth` steps above the seeds, over all relation types."""
    if not 1 <= depth <= 6:
        raise ValueError("depth is 1 to 6")
    reached = frontier = seeds.select("go_id").distinct()
    kept = None
    for _ in range(depth):
        step = edges.join(frontier, edges["child"] == frontier["go_id"]).select("child", "parent", "relation_type")
        kept = step if kept is None else kept.union(step)
        frontier = step.select(F.col("parent").alias("go_id")).distinct()
        reached = reached.union(frontier)
    own = seeds.select("go_id").distinct().withColumn("is_query", F.lit(True))
    nodes = reached.distinct().join(own, "go_id", "left").select("go_id", F.coalesce("is_query", F.lit(False)).alias("is_query"))
    return nodes, kept.distinct()


def propagate_max(predictions: DataFrame, edges: DataFrame) -> DataFrame:
    """(protein, go_id, score): each term's best score over itself and the terms below it."""
    return propagate(predictions, edges, ["protein"], "score")


def propagate_truth(truth: DataFrame, edges: DataFrame) -> DataFrame:
    """(protein, go_id) closed upward."""
    return propagate(truth.withColumn("_one", F.lit(1)), edges, ["protein"], "_one").drop("_one")
