"""Learned re-ranking: features, stratified split, boosted trees, application, temporal training."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of features.
NUMERIC = (
    "distance", "identity_nw", "similarity_nw", "alignment_score_nw", "gaps_pct_nw", "alignment_length_nw", "identity_sw", "similarity_sw", "alignment_score_sw", "gaps_pct_sw", "alignment_length_sw",
    "length_query", "length_ref", "taxonomic_distance", "taxonomic_common_ancestors", "vote_count", "k_position", "go_term_frequency", "ref_annotation_density", "neighbor_distance_std",
)
CATEGORICAL = ("qualifier", "evidence_code", "taxonomic_relation")


INPUTS = [*NUMERIC, *(f"{c}_missing" for c in NUMERIC), *(f"{c}_i" for c in CATEGORICAL)]


def prepare_features(df: DataFrame) -> DataFrame:
    """Numbers as doubles (bad ones null), blank categories null, label null as 0; missing feature columns are null."""

    def own(c: str, kind: str):
        return F.col(c) if c in df.columns else F.lit(None).cast(kind)

    out = {c: own(c, "double").try_cast("double") for c in NUMERIC} | {c: F.nullif(F.trim(own(c, "string").cast("string")), F.lit("")) for c in CATEGORICAL}
    if "label" in df.columns:
        out["label"] = F.coalesce(F.col("label").try_cast("int"), F.lit(0))
    return df.withColumns(out)


def hash_order(keys: list[str], seed: int) -> Column:
    """A random order that any engine can repeat: the MD5 of the keys and the seed."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def numbered(df: DataFrame, by: list[str], order: Column, digits: int = 3) -> DataFrame:
    """df and _n, each row's place within its group by the order, a hash in hexadecimal digits; a group may hold nearly all rows.

    Rows are counted by group and range of hashes (the first digits), running sums of those few counts tell where each range
    begins, and only rows of one range are sorted together.
    """
    own = df.withColumn("_h", order).withColumn("_r", F.substring("_h", 1, digits))
    counts = own.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.withColumn("_before", before).drop("_c")
    within = F.row_number().over(Window.partitionBy(*by, "_r").orderBy("_h"))
    return own.join(begins, [*by, "_r"]).withColumn("_n", F.col("_before") + within).drop("_h", "_r", "_before")


def stratified_split(df: DataFrame, keys: list[str], val_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """df and is_val: of each label the first share of a shuffled order, at least one row."""
    sizes = df.groupBy("label").agg(F.count(F.lit(1)).alias("_size"))
    marked = numbered(df, ["label"], hash_order(keys, seed)).join(F.broadcast(sizes), "label")  # two labels
    return marked.withColumn("is_val", F.col("_n") <= F.greatest(F.lit(1), F.floor(F.col("_size") * val_fraction))).drop("_n", "_size")


def sample_negatives(df: DataFrame, keys: list[str], ratio: float, seed: int = 42) -> DataFrame:
    """All positives and at most ratio times as many negatives (one at least), train and validation rows apart."""
    positives = df.groupBy("is_val").agg(F.count_if(F.col("label") == 1).alias("_pos"))
    ranked = numbered(df, ["is_val", "label"], hash_order(keys, seed)).join(F.broadcast(positives), "is_val")  # two rows
    return ranked.filter((F.col("label") == 1) | (F.col("_n") <= F.greatest(F.lit(1), F.floor(F.col("_pos") * ratio)))).drop("_n", "_pos")


def with_ia_weights(df: DataFrame, weights: DataFrame) -> DataFrame:
    return df.join(weights.select("go_id", F.col("ia").cast("double").alias("weight")), "go_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def filled(df: DataFrame) -> DataFrame:
    """Missing numbers as -1 with a flag (<name>_missing), missing categories as a class of their own."""
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in NUMERIC}
    return df.withColumns(flags).na.fill(-1.0, list(NUMERIC)).na.fill("missing", list(CATEGORICAL))


def varied(df: DataFrame) -> list[str]:
    """The inputs of filled rows that aren't the same in all of them: no tree splits by another one. Categories count as different from unknown ones."""
    found = [*NUMERIC, *(f"{c}_missing" for c in NUMERIC), *CATEGORICAL]
    ends = df.agg(*[F.min(c).alias(f"{c}_min") for c in found], *[F.max(c).alias(f"{c}_max") for c in found]).first()
    kept = [c for c in found if ends[f"{c}_min"] != ends[f"{c}_max"]]
    return [f"{c}_i" if c in CATEGORICAL else c for c in kept or found]


def train(df: DataFrame, rounds: int = 100, depth: int = 5, step: float = 0.1, seed: int = 42, neg_pos_ratio: float | None = None, keys: tuple[str, ...] = ("protein", "go_id")) -> PipelineModel:
    """Boosted trees on prepared rows (label, is_val, maybe weight). Rounds end early where the validation rows gain nothing more.

    With neg_pos_ratio, negatives are sampled first. Unknown categories are a class of their own. Inputs that are the same in all rows are left
    out, since every round sums up each of them for each row.
    """
    if neg_pos_ratio is not None:
        df = sample_negatives(df, list(keys), neg_pos_ratio, seed)
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in CATEGORICAL]
    own = filled(df)
    assembler = VectorAssembler(inputCols=varied(own), outputCol="features", handleInvalid="keep")
    trees = GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, validationIndicatorCol="is_val", validationTol=1e-4, maxBins=64)
    if "weight" in df.columns:
        trees = trees.setWeightCol("weight")
    return Pipeline(stages=[*indexers, assembler, trees]).fit(own)


def best_rounds(model: PipelineModel) -> int:
    """The rounds that were kept."""
    return model.stages[-1].getNumTrees


def apply(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df and the model's probability as reranker_score."""
    scored = model.transform(filled(df)).withColumn("reranker_score", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction", *(f"{c}_i" for c in CATEGORICAL), *(f"{c}_missing" for c in NUMERIC))


def validation_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: AUC, log-loss, precision, recall, F1, positive rate."""
    p, y = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("reranker_score"))), F.col("label")
    hit = F.col("reranker_score") >= threshold
    sums = scored.agg(
        F.count(F.lit(1)).alias("n"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 1)).alias("fn"), F.avg("label").alias("positive_rate")
    )
    precision, recall = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    out = sums.withColumns({"precision": precision, "recall": recall})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)).drop("tp", "fp", "fn").crossJoin(auc(scored))  # one row each


def auc(scored: DataFrame) -> DataFrame:
    """One row: the area under the ROC curve, ties counted half; null unless both labels are there.

    Rows are counted by score first; distinct scores meet in one running sum a range of scores.
    """
    counts = scored.groupBy(F.col("reranker_score").alias("s")).agg(F.count_if(F.col("label") == 1).cast("double").alias("p"), F.count_if(F.col("label") == 0).cast("double").alias("n"))
    part = F.floor(F.col("s") * 1_000).cast("int")
    ranges = counts.groupBy(part.alias("r")).agg(F.sum("n").alias("n")).withColumn("lower", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("n")  # a thousand rows
    below = F.coalesce(F.sum("n").over(Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    own = counts.withColumn("r", part).join(ranges, "r").withColumn("below", F.col("lower") + below)
    sums = own.agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).alias("auc"))


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """(input, importance); 0 for inputs that were the same in all rows."""
    found = dict(zip(model.stages[-2].getInputCols(), model.stages[-1].featureImportances.toArray(), strict=True))
    return [(c.removesuffix("_i"), float(found.get(c, 0.0))) for c in INPUTS]


def route(models: dict[str, dict[str, PipelineModel]], predictions: DataFrame) -> DataFrame:
    """Predictions (with category and aspect) by the model of their category and aspect: category, protein, go_id, aspect, score, source.

    A category's model under "" scores all of its aspects, those without an aspect too. Where there is no model, the score is 1 - d/2.
    """
    from ..functions.scalars import distance_score

    columns = ["category", "protein", "go_id", "aspect"]
    left, out = predictions, None
    for category, by_aspect in models.items():
        for aspect, model in {"": by_aspect[""]}.items() if "" in by_aspect else by_aspect.items():
            own = F.col("category").eqNullSafe(category) & (F.lit(True) if aspect == "" else F.col("aspect").eqNullSafe(aspect))
            found = apply(model, left.filter(own)).select(*columns, F.col("reranker_score").alias("score"), F.lit("model").alias("source"))
            out, left = found if out is None else out.unionByName(found), left.filter(~own)
    rest = left.select(*columns, distance_score(F.col("distance")).alias("score"), F.lit("distance").alias("source"))
    return rest if out is None else out.unionByName(rest)


def temporal_pairs(versions: list[str], available: set[str]) -> list[tuple[str, str]]:
    """Consecutive releases; a missing one is an error."""
    if missing := [v for v in versions if v not in available]:
        raise ValueError(f"no annotation set for {missing}")
    return list(zip(versions, versions[1:], strict=False))


def temporal_training_rows(pairs: list[tuple[str, str]], rows_of: Callable[[str, str], DataFrame]) -> DataFrame:
    """Labelled rows of every pair of releases, with the pair's name."""
    out = None
    for old, new in pairs:
        own = rows_of(old, new).withColumn("split", F.lit(f"{old}-{new}"))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def train_by_aspect(rows: DataFrame, aspects: tuple[str, ...] = ("P", "F", "C"), **options) -> dict[str, PipelineModel]:
    """A model for each aspect whose rows hold both labels."""
    found = {}
    for aspect in aspects:
        own = rows.filter(F.col("aspect") == aspect)
        if own.filter("not is_val").select("label").distinct().count() == 2:
            found[aspect] = train(own, **options)
    return found
