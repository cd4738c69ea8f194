"""Incremental table maintenance. Tables are immutable files: each function returns the new state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_occurrence(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key, null keys equal."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], null_safe: bool = True, order: list | None = None) -> DataFrame:
    """existing and the rows of new whose key it doesn't hold; of new rows with one key the first by `order` (else by their other columns, nulls first).

    With null_safe off, a null in a key makes a row differ from all others, so all such rows are inserted.
    """
    order = [F.col(c).asc_nulls_first() for c in existing.columns if c not in keys] or [F.lit(0)] if order is None else order
    if null_safe:
        once = first_occurrence(new, keys, order)
        held = existing.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        fresh = once.join(held, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")
    else:
        blank = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
        once = first_occurrence(new.filter(~blank), keys, order).unionByName(new.filter(blank))
        fresh = once.join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def one_offer(new: DataFrame, key: str, order: list | None) -> DataFrame:
    """The last offer of each key by `order`; without an order, a key that is offered twice is an error. Rows without a key stay."""
    if order is None:
        reject_duplicates(new.filter(F.col(key).isNotNull()), key)
        return new
    return first_occurrence(new.filter(F.col(key).isNotNull()), [key], [F.col(c).desc_nulls_last() if isinstance(c, str) else c.desc() for c in order]).unionByName(new.filter(F.col(key).isNull()))


def dedupe_sequences(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct hashes of new rows (sequence_hash) with how many rows share each and whether it exists already."""
    own = new.groupBy("sequence_hash").agg(F.count(F.lit(1)).alias("n_rows"))
    known = existing.select("sequence_hash").distinct().withColumn("_known", F.lit(True))
    return own.join(known, "sequence_hash", "left").select("sequence_hash", "n_rows", F.col("_known").isNotNull().alias("reused"))


def upsert_fill(old: DataFrame, new: DataFrame, key: str, fill: list[str], overwrite: list[str], order: list | None = None) -> DataFrame:
    """Old rows take new values where theirs are null or blank, `overwrite` columns always do; unknown keys are inserted. `change` says what happened.

    A row that nothing is offered for stays as it is, blanks too. Of several offers of a key the last by `order` counts; without an order they
    are an error. Old keys are unique, so those of the result are.
    """
    new = one_offer(new, key, order)
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")

    def kept(c: str) -> Column:
        blank = F.nullif(F.col(f"o.{c}"), F.lit("")) if dict(old.dtypes)[c] == "string" else F.col(f"o.{c}")
        return F.when(F.col("n._new"), F.coalesce(blank, F.col(f"n.{c}"))).otherwise(F.col(f"o.{c}"))

    values = {c: kept(c) for c in fill} | {c: F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in overwrite}
    changed = reduce(lambda x, y: x | y, [~v.eqNullSafe(F.col(f"o.{c}")) for c, v in values.items()])
    change = F.when(F.col("o._old").isNull(), "inserted").when(F.col("n._new").isNotNull() & changed, "updated").otherwise("kept")
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[v.alias(c) for c, v in values.items()], change.alias("change"))


def upsert_overwrite(old: DataFrame, new: DataFrame, key: str, order: list | None = None) -> DataFrame:
    """New values replace old ones by key, null-safe comparison tells whether anything changed. Several offers of a key are dealt with as in `upsert_fill`."""
    columns = [c for c in old.columns if c != key]
    return upsert_fill(old, new, key, [], columns, order)


def replace_or_skip(old: DataFrame, new: DataFrame, key: str, skip_existing: bool) -> DataFrame:
    if skip_existing:
        return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti").select(*old.columns))
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def backfill(existing: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """Rows of a versioned snapshot to add: none if that version has rows already."""
    there = existing.filter(F.col("version") == version).select("version").distinct()
    return new.withColumn("version", F.lit(version)).join(there, "version", "left_anti")


def delete_set(rows: DataFrame, key: str, value, users: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with how many go). A set that users still refer to stays whole."""
    doomed = rows.filter(F.col(key) == value)
    if users is not None:
        doomed = doomed.join(users.select(key).distinct(), key, "left_anti")
    gone = doomed.select(key).distinct()
    return rows.join(gone, key, "left_anti"), doomed.agg(F.count(F.lit(1)).alias("deleted"))


def vacuum(rows: DataFrame, key: str, *users: tuple[DataFrame, str]) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes): rows go whose key none of the (user table, key) pairs refers to."""
    used = reduce(lambda a, b: a.union(b), [user.select(F.col(k).alias(key)) for user, k in users]).distinct()
    return rows.join(used, key, "left_semi"), rows.join(used, key, "left_anti")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def reject_duplicates(df: DataFrame, key: str) -> DataFrame:
    """df, unless a key occurs twice: then the upload is rejected with an error that names some of the keys."""
    if twice := [str(r[key]) for r in duplicate_keys(df, key).orderBy(key).limit(5).collect()]:
        raise ValueError(f"{key} occurs more than once: {', '.join(twice)}")
    return df
