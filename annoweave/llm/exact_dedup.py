"""Exact dedup with a heavy-hitter split.

Texts are equal when they are identical after each run of ASCII white space became one space; the
key is the SHA-256 of that text. Digests are computed once and checkpointed, with a number for every row. A Misra-Gries summary
of every partition (at most `COUNTERS` digests each) is merged into at most `COUNTERS` candidates,
which include every digest with more than 1/(COUNTERS+1) of the rows. Their exact counts and winners
are verified by one aggregation; those with at least `HEAVY_ROWS` rows are broadcast (a bound of
COUNTERS rows of about 100 bytes), and all their rows, repeats of the winner too, are decided map-side. All other rows take the
ordinary shuffle by digest, where no group can be hot.

Null text counts as empty. Of equal texts the smallest doc_id stays (null ids last); where that row is
repeated, one of the repeats stays. Other columns are ignored by `exact_duplicates` and kept by
`drop_exact_duplicates`, whatever their names. A very long text is no more than its digest. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WS, checkpointed, table

COUNTERS = 1_024
HEAVY_ROWS = 256


def text_digest(text: str | Column = "text") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.regexp_replace(F.coalesce(c, F.lit("")), WS, " "), 256)


def misra_gries(df: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """(item, lower): at most `counters` items with a lower bound of their count, all items of more than n/(counters+1) rows among them."""

    def cut(counts: pd.Series) -> pd.Series:
        if len(counts) > counters:  # the merge step: the next count is taken from all
            counts = counts.nlargest(counters + 1)
            counts = counts - counts.iloc[-1]
            counts = counts[counts > 0]
        return counts

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="int64")
        for b in batches:
            held = cut(held.add(b["item"].value_counts(), fill_value=0).astype("int64"))
        yield pd.DataFrame({"item": held.index.astype(str), "lower": held.to_numpy()})

    parts = df.select(F.col(column).alias("item")).mapInPandas(summarise, "item string, lower long")
    return parts.groupBy("item").agg(F.sum("lower").alias("lower")).orderBy(F.desc("lower"), "item").limit(counters)


def digested(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(key, digest, row): every row's id, digest and number, checkpointed so that numbers stay."""
    return checkpointed(df.select(df[doc_id].alias("key"), text_digest(df[text]).alias("digest"), F.monotonically_increasing_id().alias("row")))


def first_of_text() -> Column:
    """Orders the rows of a text: null ids last, repeats by number."""
    return F.struct(F.col("key").isNull().alias("none"), "key", "row")


def heavy_winners(digests: DataFrame, counters: int = COUNTERS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(digest, heavy_keep, heavy_row, heavy_size) of the verified heavy digests; at most `counters` rows."""
    likely = misra_gries(digests, "digest", counters).select(F.col("item").alias("digest"))
    found = digests.join(F.broadcast(likely), "digest", "left_semi").groupBy("digest").agg(F.min(first_of_text()).alias("first"), F.count(F.lit(1)).alias("heavy_size"))
    return checkpointed(found.filter(F.col("heavy_size") >= heavy_rows).select("digest", F.col("first.key").alias("heavy_keep"), F.col("first.row").alias("heavy_row"), "heavy_size"))


def exact_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = digested(df, text, doc_id)
    winners = F.broadcast(heavy_winners(digests, counters, heavy_rows))
    columns = [F.col("key").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")]
    heavy = digests.join(winners, "digest").withColumns({"keep_id": F.col("heavy_keep"), "group_size": F.col("heavy_size"), "kept": F.col("row") == F.col("heavy_row")})
    group = Window.partitionBy("digest")
    light = digests.join(winners, "digest", "left_anti").withColumns({"keep_id": F.min("key").over(group), "group_size": F.count(F.lit(1)).over(group), "kept": F.row_number().over(group.orderBy(first_of_text())) == 1})
    return heavy.select(*columns).unionByName(light.select(*columns))


def drop_exact_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The rows of df that stay, with its columns.

    Only ids and digests are shuffled. (digest, id) pairs that lose go by a broadcast if they are few bytes, else by a shuffle of
    the rows; pairs that win but are repeated, the same id with the same text, are few as a rule and lose their repeats by an aggregation.
    """
    digests = digested(df, text, doc_id)
    winners = heavy_winners(digests, counters, heavy_rows)
    pairs = digests.groupBy("digest", "key").agg(F.count(F.lit(1)).alias("n"))
    light = pairs.join(F.broadcast(winners), "digest", "left_anti")
    best = light.withColumn("wins", F.row_number().over(Window.partitionBy("digest").orderBy(F.col("key").asc_nulls_last())) == 1)
    lost = checkpointed(best.filter("not wins").select("digest", "key"))
    many = checkpointed(pairs.filter("n > 1").select("digest").distinct())

    names = {c: f"_{k}" for k, c in enumerate(df.columns)}  # so that no column of df clashes with those added
    rows = df.select(*[df[c].alias(n) for c, n in names.items()], df[doc_id].alias("key"), text_digest(df[text]).alias("digest"))

    def small(found: DataFrame) -> DataFrame:
        return F.broadcast(found) if found.count() * 100 <= BROADCAST_BYTES else found

    rest = rows.join(F.broadcast(winners), "digest", "left").filter(F.col("heavy_size").isNull() | F.col("key").eqNullSafe(F.col("heavy_keep")))
    lost = small(lost.select(F.col("digest").alias("d"), F.col("key").alias("k")))
    rest = rest.join(lost, (F.col("digest") == F.col("d")) & F.col("key").eqNullSafe(F.col("k")), "left_anti").select(*names.values(), "digest")
    repeated = small(many)
    once = rest.join(repeated, "digest", "left_semi").groupBy("digest").agg(F.first(F.struct(*names.values())).alias("row")).select("row.*")
    kept = rest.join(repeated, "digest", "left_anti").select(*names.values())
    return kept.unionByName(once).select(*[F.col(n).alias(c) for c, n in names.items()])


def op5(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
