"""Every bound query with SQL against DuckDB, on the smallest tables."""

import pytest

from annoweave.plans import QUERIES, SQL
from oracle import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["protein", "go_id", "aspect", "ref", "distance", "qualifier", "evidence_code"]
    assert df.limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["knn_ivf", "knn_lsh", "alignment_features", "train_reranker", "train_aspect", "feature_importance", "export_reranked", "route_models", "temporal_training"])
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_delta_fasta_of_texts_without_letters(spark, sf_dir, tmp_path):
    """Texts that are null, empty or without letters give records of a header and an empty line, as the SQL does."""
    import os

    from pyspark.sql import functions as F

    for name in os.listdir(sf_dir):
        if not name.startswith("documents"):
            os.symlink(f"{sf_dir}/{name}", f"{tmp_path}/{name}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.when(F.col("doc_id") % 4 == 0, "12 34").when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 2, F.col("text"))
    docs.withColumn("text", text).write.parquet(f"{tmp_path}/documents.parquet")
    same(QUERIES["export_delta_fasta"](spark, str(tmp_path)), SQL["export_delta_fasta"], str(tmp_path))
