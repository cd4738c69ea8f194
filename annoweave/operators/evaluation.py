"""Temporal holdout evaluation: ground truth of two releases, precision and recall, Fmax.

Annotations are (protein, go_id, aspect, qualifier, evidence_code); truth is (category, protein, go_id, aspect).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence
from ..functions.scalars import distance_score
from ..functions.scoring import ScoringConfig, score
from . import climb, graph

STEPS = 100


def experimental(annotations: DataFrame) -> DataFrame:
    """Distinct (protein, aspect, go_id) of experimental annotations that aren't negated themselves; terms without an aspect go."""
    good = annotations.filter(evidence.is_experimental(F.col("evidence_code")) & evidence.not_negated(F.col("qualifier")) & F.col("aspect").isNotNull())
    return good.select("protein", "aspect", "go_id").distinct()


def experimental_by_namespace(annotations: DataFrame, negatives: DataFrame) -> DataFrame:
    """Distinct (protein, aspect, go_id) of experimental annotations that nothing negates; terms without an aspect go."""
    return experimental(annotations).join(negatives, ["protein", "go_id"], "left_anti").select("protein", "aspect", "go_id")


def release_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old, ["protein", "aspect", "go_id"], "left_anti")


def ground_truth(old: DataFrame, new: DataFrame) -> DataFrame:
    """(category, protein, aspect, go_id): NK proteins had nothing before, LK nothing in this namespace, PK gained terms in a namespace they had."""
    gained = release_delta(old, new)
    had = old.select("protein").distinct().withColumn("had", F.lit(True))
    had_here = old.select("protein", "aspect").distinct().withColumn("had_here", F.lit(True))
    marked = gained.join(had, "protein", "left").join(had_here, ["protein", "aspect"], "left")
    category = F.when(F.col("had").isNull(), "NK").when(F.col("had_here").isNull(), "LK").otherwise("PK")
    return marked.select(category.alias("category"), "protein", "aspect", "go_id")


def known_terms(old: DataFrame, truth: DataFrame) -> DataFrame:
    """Old experimental terms of every protein, flagged where they lie in a PK namespace."""
    pk = truth.filter("category = 'PK'").select("protein", "aspect").distinct().withColumn("pk", F.lit(True))
    return old.join(pk, ["protein", "aspect"], "left").select("protein", "aspect", "go_id", F.coalesce("pk", F.lit(False)).alias("is_pk_known"))


def evaluation_stats(truth: DataFrame) -> DataFrame:
    return truth.groupBy("category").agg(F.countDistinct("protein").alias("proteins"), F.count(F.lit(1)).alias("pairs"))


def delta_proteins(truth: DataFrame) -> DataFrame:
    return truth.select("protein").distinct()


def true_positives(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Distinct terms both predicted and true, per protein."""
    return predictions.select("protein", "go_id").distinct().join(truth.select("protein", "go_id").distinct(), ["protein", "go_id"]).groupBy("protein").agg(F.count(F.lit(1)).alias("n_true"))


def reached(score: Column) -> Column:
    """How many of the thresholds i * 0.01 (i from 0 to 100, in double arithmetic) a score reaches."""
    near = F.greatest(F.lit(0), F.least(F.lit(STEPS), F.floor(score * STEPS).cast("int")))
    # floor() may be off by one at the edges, where i * 0.01 and the score differ in the last bit.
    up = F.when((near < STEPS) & (score >= (near + 1) * F.lit(0.01)), near + 1).otherwise(near)
    exact = F.when(score < up * F.lit(0.01), up - 1).otherwise(up)
    return (exact + 1).cast("int")


def thresholds(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(STEPS + 1).select(F.col("id").cast("int").alias("i"), (F.col("id") * F.lit(0.01)).alias("threshold"))


def pr_curve(scored: DataFrame, truth: DataFrame, *keys: str, groups: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Micro-averaged precision, recall and F1 at 101 thresholds for each group of the keys.

    Only proteins with ground truth count; a pair's best score counts; recall is over all true pairs. Each pair falls into
    one bucket and buckets are summed from above, so nothing is multiplied by the thresholds. Groups are those of the scored rows unless given.
    `by` names columns of truth, and perhaps of scored rows: each of their values is judged against its own truth, those without truth don't appear.
    """
    by, own_by = list(by), [c for c in by if c in scored.columns]
    keys = [k for k in keys if k not in by]
    pairs = truth.select(*by, "protein", "go_id").distinct()
    within = scored.join(pairs.select(*by, "protein").distinct(), [*own_by, "protein"])
    best = within.groupBy(*by, *keys, "protein", "go_id").agg(F.max("score").alias("score"))
    hit = best.join(pairs.withColumn("hit", F.lit(1)), [*by, "protein", "go_id"], "left")
    counted = hit.groupBy(*by, *keys, reached(F.col("score")).alias("n")).agg(F.count(F.lit(1)).alias("predicted"), F.count("hit").alias("right"))
    total = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    if groups is None:
        groups = scored.select(*keys).distinct() if keys else total.select().limit(1) if by else total.select()
    grid = groups.crossJoin(total).crossJoin(F.broadcast(thresholds(scored)))
    keys = [*by, *keys]
    grid = grid.withColumn("n", F.col("i") + 1).join(counted, [*keys, "n"], "left")
    above = Window.partitionBy(*keys).orderBy(F.desc("n")) if keys else Window.orderBy(F.desc("n"))
    summed = grid.select(*keys, "threshold", "total", F.sum(F.coalesce("predicted", F.lit(0))).over(above).alias("predicted"), F.sum(F.coalesce("right", F.lit(0))).over(above).alias("right"))
    precision = F.when(F.col("predicted") > 0, F.col("right") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("total") > 0, F.col("right") / F.col("total")).otherwise(0.0)
    summed = summed.withColumns({"p": precision, "r": recall})
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return summed.withColumn("f", f1).select(*keys, "threshold", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round("f", 6).alias("f1"), F.col("f").alias("f1_exact"))


def fmax(curve: DataFrame, *keys: str) -> DataFrame:
    """The first greatest F1 over ascending thresholds and the area under the curve by trapezoids, 4 decimals."""
    order = Window.partitionBy(*keys).orderBy(F.desc("threshold")) if keys else Window.orderBy(F.desc("threshold"))
    area = (F.col("recall") - F.lag("recall").over(order)) * (F.col("precision") + F.lag("precision").over(order)) / 2
    found = curve.withColumn("area", area).groupBy(*keys).agg(
        F.max("f1_exact").alias("best"), F.max_by("threshold", F.struct("f1_exact", -F.col("threshold"))).alias("at"), F.sum("area").alias("area")
    )
    return found.select(*keys, F.round("best", 4).alias("fmax"), F.round("at", 4).alias("threshold_at_fmax"), F.round(F.coalesce("area", F.lit(0.0)), 4).alias("auc_pr"))


def _by_lists(rows: DataFrame, known: DataFrame | None, counted: DataFrame, edges: DataFrame | None, keys: list[str], bucket: Column) -> DataFrame:
    """What `climb.weighed` gives, for graphs that tasks can't hold: every row meets the list of terms above its own."""
    terms_of, numbers = graph.carried_up(counted, edges)
    best = rows.groupBy(*keys, "go_id").agg(F.max("score").alias("score"), F.max("_true").alias("_true"))
    met = best.join(terms_of, "go_id").select(*keys, "aspect", "numbers", "weights", "score", "_true", F.lit(False).alias("_known"))
    if known is not None:
        gone = known.join(numbers, "go_id")
        met = met.unionByName(gone.select(*keys, "aspect", F.array("number").alias("numbers"), F.array(F.lit(0.0)).alias("weights"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("_true"), F.lit(True).alias("_known")))
    # A protein's rows are dealt out once, with their lists; they are made into terms, reduced to one a term and summed where they lie.
    each = met.repartition(*keys).select(*keys, "aspect", "score", "_true", "_known", F.explode(F.arrays_zip("numbers", "weights")).alias("x"))
    once = each.groupBy(*keys, "aspect", "x.numbers").agg(F.max("score").alias("score"), F.max("_true").alias("_true"), F.max("_known").alias("_known"), F.max("x.weights").alias("ia")).filter("not _known")
    hit = F.when(F.col("_true"), F.col("ia")).otherwise(0.0)
    return once.groupBy(*keys, "aspect", bucket.alias("n")).agg(F.sum("ia").alias("w"), F.sum(hit).alias("hit"), F.max("_true").alias("_true"))


def weighted_curve(scored: DataFrame, truth: DataFrame, weights: DataFrame, terms: DataFrame, edges: DataFrame | None = None, known: DataFrame | None = None, roots: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Information-weighted precision and recall per aspect at the thresholds 0.01 to 1, with CAFA averaging (Radivojac et al. 2013, Jiang et al. 2016).

    Precision averages over proteins with a prediction at the threshold, recall over all proteins with truth. Weights are (go_id, ia), 1
    where missing. Terms are (go_id, aspect); rows of other terms don't count. With edges (child, parent; of one aspect each, without cycles), scores
    and truth go up the graph first, in tasks that hold it where it isn't too large. Known pairs (protein, go_id) and the terms in roots are left out of both afterwards; known terms aren't closed upward.
    `by` names columns of truth (and perhaps of scored and known rows) that make groups of their own, judged in the same jobs.
    """
    by = list(by)
    aspects = terms.filter("aspect is not null").select("go_id", "aspect").distinct()
    aspects = aspects if roots is None else aspects.join(roots.select("go_id").distinct(), "go_id", "left_anti")
    own = weights.select("go_id", F.col("ia").cast("double").alias("ia"))
    own_by = [c for c in by if c in scored.columns]
    groups = truth.select(*by, "protein").distinct()
    counted = aspects.join(own, "go_id", "left").select("go_id", "aspect", F.coalesce("ia", F.lit(1.0)).alias("ia"))
    t = truth.select(*by, "protein", "go_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("_true"))
    s = scored.select(*own_by, "protein", "go_id", F.col("score").cast("double").alias("score")).join(groups, [*own_by, "protein"]).withColumn("_true", F.lit(False))
    rows, gone = t.unionByName(s.select(*t.columns)), None
    if known is not None:
        keys = [c for c in by if c in known.columns] + ["protein"]
        gone = known.select(*keys, "go_id").distinct().join(groups, keys).select(*by, "protein", "go_id")
    group = [*by, "aspect"]
    bucket = F.when(F.col("score").isNotNull(), reached(F.col("score"))).otherwise(0)
    if climb.fits(terms, *([] if edges is None else [edges])):
        buckets = climb.weighed(rows, gone, counted, edges, [*by, "protein"], bucket, scored.count() + truth.count())
    else:
        buckets = _by_lists(rows, gone, counted, edges, [*by, "protein"], bucket)
    buckets = buckets.select(*group, "protein", "n", "w", F.col("hit").alias("w_hit"), F.col("hit").alias("total"), "_true")
    # A protein's sums change only at its own buckets: each carries the range of thresholds for which its sums hold. Bucket 0 has what is true and not predicted.
    all_of = Window.partitionBy(*group, "protein")
    above = all_of.orderBy(F.desc("n"))
    held = buckets.select(
        *group, "protein", "n", F.sum("w").over(above).alias("w"), F.sum("w_hit").over(above).alias("w_hit"), F.coalesce(F.lead("n").over(above), F.lit(0)).alias("below"), F.sum("total").over(all_of).alias("total"), F.max("_true").over(all_of).alias("_true")
    )
    held = graph.checkpointed(held.filter("_true"))
    values = held.filter("n > 0").select(*group, "n", "below", F.when(F.col("w") > 0, F.col("w_hit") / F.col("w")).otherwise(0.0).alias("p"), F.when(F.col("total") > 0, F.col("w_hit") / F.col("total")).otherwise(0.0).alias("r"))
    # +value where the range begins, -value below it; running sums from above give the sums at each threshold.
    changes = values.select(*group, "n", "p", "r", F.lit(1).alias("c")).union(values.filter("below > 0").select(*group, "below", -F.col("p"), -F.col("r"), F.lit(-1)))
    changes = changes.groupBy(*group, "n").agg(F.sum("p").alias("p"), F.sum("r").alias("r"), F.sum("c").alias("c"))
    proteins = held.groupBy(*group, "protein").agg(F.lit(1)).groupBy(*group).agg(F.count(F.lit(1)).alias("proteins"))
    grid = proteins.crossJoin(F.broadcast(thresholds(scored))).filter("i > 0").withColumn("n", F.col("i") + 1)
    over = Window.partitionBy(*group).orderBy(F.desc("n"))
    curve = grid.join(changes, [*group, "n"], "left").select(*group, "threshold", "proteins", *[F.sum(F.coalesce(c, F.lit(0))).over(over).alias(c) for c in ("p", "r", "c")])
    return curve.select(*group, F.round("threshold", 2).alias("tau"), F.when(F.col("c") > 0, F.col("p") / F.col("c")).otherwise(0.0).alias("precision"), (F.col("r") / F.col("proteins")).alias("recall"), (F.col("c") / F.col("proteins")).alias("coverage"), F.col("proteins").alias("n_proteins"))


def fmax_weighted(scored: DataFrame, truth: DataFrame, weights: DataFrame, terms: DataFrame, edges: DataFrame | None = None, known: DataFrame | None = None, roots: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The point of the weighted curve with the greatest F, the lowest threshold of equal ones."""
    curve, group = weighted_curve(scored, truth, weights, terms, edges, known, roots, by), [*by, "aspect"]
    f = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    best = curve.withColumn("f", F.round(f, 9)).groupBy(*group, "n_proteins").agg(F.max_by(F.struct("f", "precision", "recall", "tau", "coverage"), F.struct("f", -F.col("tau"))).alias("b"))
    return best.select(*group, F.round("b.f", 4).alias("fmax"), F.round("b.precision", 4).alias("precision"), F.round("b.recall", 4).alias("recall"), F.col("b.tau").alias("tau"), F.round("b.coverage", 4).alias("coverage"), "n_proteins")


def coverage(scored: DataFrame, truth: DataFrame, *by: str) -> DataFrame:
    """The share in percent of proteins with truth that have any score, for each group of truth."""
    delta = truth.select(*by, "protein").distinct().join(scored.select("protein").distinct().withColumn("hit", F.lit(1)), "protein", "left")
    return delta.groupBy(*by).agg(F.round(100 * F.avg(F.coalesce("hit", F.lit(0))), 2).alias("covered_percent"))


def evaluation_scores(predictions: DataFrame, truth: DataFrame, configs: dict[str, ScoringConfig], reranked: DataFrame | None = None, max_distance: float | None = None) -> DataFrame:
    """(protein, go_id, score, source) of delta proteins: the re-ranker's score where there is one, else that of the namespace's configuration, else 1 - d/2; best per pair."""
    own = predictions if max_distance is None else predictions.filter(F.col("distance") <= max_distance)
    own = own.join(delta_proteins(truth), "protein", "left_semi")
    given = F.lit(None).cast("double")
    if reranked is not None:
        own = own.join(reranked.select("protein", "go_id", F.col("reranker_score").alias("_given")), ["protein", "go_id"], "left")
        given = F.col("_given")
    by_config = F.lit(None).cast("double")
    for aspect, config in configs.items():
        by_config = F.when(F.col("aspect") == aspect, score(own, config)).otherwise(by_config)
    found = F.coalesce(given, by_config, distance_score(F.col("distance")))
    source = F.when(given.isNotNull(), "reranker").when(by_config.isNotNull(), "config").otherwise("distance")
    rows = own.select("protein", "go_id", F.round(found, 6).alias("score"), source.alias("source"))
    return rows.groupBy("protein", "go_id").agg(F.max_by(F.struct("score", "source"), "score").alias("b")).select("protein", "go_id", "b.score", "b.source")


def compare(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """Differences of Fmax and area, second minus first."""
    a, b = first.select(*keys, F.col("fmax").alias("f1"), F.col("auc_pr").alias("a1")), second.select(*keys, F.col("fmax").alias("f2"), F.col("auc_pr").alias("a2"))
    both = a.join(b, list(keys)) if keys else a.crossJoin(b)
    return both.select(*keys, F.round(F.col("f2") - F.col("f1"), 4).alias("fmax_gain"), F.round(F.col("a2") - F.col("a1"), 4).alias("auc_gain"))
