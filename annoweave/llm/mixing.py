r"""Mixing sources to target weights.

Each document gets a hash-random key, an order within its source that any worker can compute. Every
source's documents are range-sorted by it and read from the start until the source's budget is used
up; a budget beyond the source's size starts further epochs. The cut falls inside one document, which
gives only as many words as are still due, so budgets are met exactly.

The sort is distributed: word counts are summed by (source, range of keys), the running sums of those
ranges tell the one range in which a source's budget ends, and only that range is sorted finely. What
comes out is one line a source (whole epochs, key of the cut, words left for it), and every document
decides by it on its own. That table has as many rows as there are sources; it is broadcast if at most
`BROADCAST_SOURCES`, else joined by a shuffle. A source with a third of all rows costs no more than
others: partial sums by range come first, and no document is moved at all.

Null text: size 0, takes 0. A null source is a source (the last in order). Rows with equal keys (repeated
ids) at the cut share what is left in proportion to their sizes, rounded down. Sources without words have
target 0. Reruns agree: keys depend on the id and seed only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_WS, checkpointed, table

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
#: Ranges of keys a source is cut into, and the digits of a hash that make a key (15: below 2^60).
RANGES = 1_024
DIGITS = 15
BROADCAST_SOURCES = 10_000


def mix_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, DIGITS), 16, 10).cast("long")


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WS)), F.lit(0)).cast("long")


def sized(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, source, size, key."""
    return df.select(df[doc_id].alias("doc_id"), df[source].alias("source"), words_in(df[text]).alias("size"), mix_key(df[doc_id], seed).alias("key"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to these, target, in words. One row a source goes in and comes out.

    Resharing what capped sources leave until none is above its cap is filling to one level: sources in
    ascending order of cap over weight are capped as long as the share of those not yet capped is above it.
    """
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.withColumns({"weight": weight, "cap": F.col("source_size") * epochs})
    w = w.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    w = w.withColumns({"all_size": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything), "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    level = (F.col("all_size") - F.col("cap_before")).cast("double") / (F.col("all_weight") - F.col("weight_before"))
    w = w.withColumn("level", F.when(F.col("ratio") >= level, level))  # of the first source that is not capped, and of later ones
    w = w.withColumn("level", F.first("level", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return w.select("source", "source_size", F.round(target, 6).alias("target"))


def cuts(docs: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS, ranges: int = RANGES) -> DataFrame:
    """One row a source: source, source_size, target, whole (epochs), cut_key, cut_left (words of it to take), cut_size."""
    range_of = F.floor(F.col("key") / (16**DIGITS // ranges)).alias("range")
    sums = checkpointed(docs.groupBy("source", range_of).agg(F.sum("size").alias("size")))
    plan = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", whole).withColumn("left", (F.floor("target") - F.col("whole") * F.col("source_size")).cast("long"))
    plan = checkpointed(plan)
    small = plan.count() <= BROADCAST_SOURCES
    dealt = F.broadcast(plan) if small else plan
    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        sums.withColumn("upto", F.sum("size").over(running))
        .join(dealt.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("upto") - F.col("size") <= F.col("left")) & (F.col("upto") > F.col("left")))
        .select("s", F.col("range").alias("r"), (F.col("left") - F.col("upto") + F.col("size")).alias("left"))
    )
    ends = checkpointed(ends)  # at most one row a source
    fine = docs.join(F.broadcast(ends) if small else ends, F.col("source").eqNullSafe(F.col("s")) & (range_of == F.col("r"))).groupBy("source", "left", "key").agg(F.sum("size").alias("size"))
    running = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        fine.withColumn("upto", F.sum("size").over(running))
        .filter((F.col("upto") - F.col("size") <= F.col("left")) & (F.col("upto") > F.col("left")))
        .select(F.col("source").alias("s"), F.col("key").alias("cut_key"), (F.col("left") - F.col("upto") + F.col("size")).alias("cut_left"), F.col("size").alias("cut_size"))
    )
    return plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "left")


def with_taken(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs (source, size, key and more) and source_size, target, taken."""
    plan = checkpointed(plan)
    dealt = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    joined = docs.join(dealt.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    part = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.floor(F.col("size").cast("decimal(30,0)") * F.col("cut_left") / F.col("cut_size"))).otherwise(0)
    return joined.withColumn("taken", (F.col("whole") * F.col("size") + part).cast("long")).drop("s", "whole", "cut_key", "cut_left", "cut_size")


def mix(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken."""
    docs = checkpointed(sized(df, text, doc_id, source, seed))
    return with_taken(docs, cuts(docs, weights, epochs)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself, with df's columns: a document once for each whole epoch, and cut to its first words where the budget ends inside it."""
    plan = cuts(checkpointed(sized(df, text, doc_id, source, seed)), weights, epochs)
    rows = df.select(F.struct(*[df[c].alias(c) for c in df.columns]).alias("row"), df[text].alias("text"), df[source].alias("source"), words_in(df[text]).alias("size"), mix_key(df[doc_id], seed).alias("key"))
    # Copies of `size` words each, the last one shorter; a word and the white space before it make a unit.
    copies = F.expr("transform(sequence(1, cast(ceil(taken / size) as int)), i -> if(i * size <= taken, size, taken - (i - 1) * size))")
    unit = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    cut = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(unit, F.lit(1), F.col("words").cast("int")), ""))
    given = with_taken(rows, plan).filter("taken > 0").withColumn("words", F.explode(copies)).withColumn("cut", cut)
    return given.select(*[(F.col("cut") if c == text else F.col("row")[c]).alias(c) for c in df.columns])


def op9(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight FROM s
), fill AS (  -- reshare until none is above 3 times its size
  SELECT 0 AS step, source, source_size, weight, FALSE AS capped,
         CAST((SELECT sum(source_size) FROM w) AS DOUBLE) / (SELECT sum(weight) FROM w) AS level FROM w
  UNION ALL
  SELECT step + 1, source, source_size, weight, now,
         CAST((SELECT sum(source_size) FROM w) - coalesce(sum(CASE WHEN now THEN 3 * source_size END) OVER (), 0) AS DOUBLE)
           / nullif(sum(CASE WHEN NOT now THEN weight END) OVER (), 0)
  FROM (SELECT *, capped OR CAST(3 * source_size AS DOUBLE) / weight < level AS now FROM fill)
  WHERE step < 60
), t AS (
  SELECT source, source_size,
         round(CASE WHEN capped OR level IS NULL THEN CAST(3 * source_size AS DOUBLE) ELSE weight * level END, 6) AS target
  FROM fill WHERE step = 60
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS due,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (due // source_size) * size
         + greatest(0, least(size, due % source_size - before)) END AS BIGINT) AS taken
FROM r
"""
