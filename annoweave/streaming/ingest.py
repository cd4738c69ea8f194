"""Incremental ingest of annotations and predictions as file streams.

What is known already is keyed state of the stream, so a batch reads its own lines and nothing of the table. A batch that is run
again after a failure has the same lines, time and state, and replaces its own folder; so the table is the same whenever a job dies. State and
table belong to one checkpoint folder. State lies in RocksDB unless the session names another provider than Spark's own, since a heap full of
keys is copied and collected in every batch.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import transfer

KEY = ["protein", "go_id", "evidence_code"]
_STATE = "spark.sql.streaming.stateStore."


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1, total_limit: int | None = None) -> DataFrame:
    """Lines of Parquet files with their `place` (file, number in the file); with `total_limit`, only the first ones by age, name and place of files.

    Which lines those are depends on the files alone, so a stream that is started again stops at the same line. It is found by one count a file.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    if total_limit is not None:
        stream = stream.filter(_before_cut(spark, path, schema, total_limit))
    return stream.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"))


def _before_cut(spark: SparkSession, path: str, schema: str, total_limit: int) -> Column:
    age, name, row = F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = spark.read.schema(schema).parquet(path).groupBy(age.alias("age"), name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    before = files.withColumn("before", F.sum("n").over(Window.orderBy("age", "name")) - F.col("n"))  # a row a file
    cut = before.filter((F.col("before") <= total_limit) & (F.col("before") + F.col("n") > total_limit)).orderBy("before").first()
    if cut is None:
        return F.lit(True)
    earlier = (age < F.lit(cut["age"])) | ((age == F.lit(cut["age"])) & (name < cut["name"]))
    return earlier | ((name == cut["name"]) & (row < total_limit - cut["before"]))


class Counters(StreamingQueryListener):
    """What streams observed: for each batch how many lines were read, valid and inserted.

    Spark sums what is observed before a shuffle by finished tasks, so where an executor is lost and tasks run again, their lines count twice.
    Exact counts are those of `totals`, which come from state and files.
    """

    def __init__(self, spark: SparkSession):
        super().__init__()
        self.batches: dict[tuple[str, int], dict[str, int]] = {}
        self._ended: dict[str, threading.Event] = {}
        self._spark = spark
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        self._ended.setdefault(str(event.runId), threading.Event())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics
        if found:
            self.batches[str(event.progress.id), event.progress.batchId] = {name: row["n"] or 0 for name, row in found.items()}

    def onQueryTerminated(self, event) -> None:
        self._ended.setdefault(str(event.runId), threading.Event()).set()

    def of(self, query: StreamingQuery) -> dict[int, dict[str, int]]:
        """Counts by batch of a query that has ended, all runs of it that this listener saw."""
        if not self._ended.setdefault(str(query.runId), threading.Event()).wait(600):
            raise TimeoutError(f"the end of {query.runId} wasn't reported, so counts may be missing")
        return {batch: counts for (own, batch), counts in sorted(self.batches.items()) if own == str(query.id)}

    def close(self) -> None:
        self._spark.streams.removeListener(self)


def _counted(df: DataFrame, name: str) -> DataFrame:
    return df.observe(name, F.count(F.lit(1)).alias("n"))


def _replace_batch(path: str, *parts: str) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch under `batch=<id>`, in place of what an earlier run of it wrote."""

    def run(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *parts).parquet(path)

    return run


def _known(lines: DataFrame, proteins: DataFrame, terms: DataFrame) -> DataFrame:
    return lines.join(proteins.select(F.col("accession").alias("protein")), "protein", "left_semi").join(terms.select("go_id"), "go_id", "left_semi")


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started meanwhile keep their state in RocksDB and write its changes, unless the session has chosen a provider."""
    chosen = {_STATE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", _STATE + "rocksdb.changelogCheckpointing.enabled": "true"}
    if not spark.conf.get(_STATE + "providerClass").endswith(".HDFSBackedStateStoreProvider"):
        chosen = {}
    before = {name: spark.conf.get(name, None) for name in chosen}
    for name, value in chosen.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stream_annotations(lines: DataFrame, proteins: DataFrame, terms: DataFrame, path: str, checkpoint: str, existing: DataFrame | None = None, sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Annotation lines (KEY columns, any others and `place`, as a stream) of known proteins and terms; the first line of each key is appended whole.

    First is the line that arrives in an earlier batch, in one batch the first by place; null keys are equal. The state holds that line with the
    time of its batch, and a batch hands on the keys whose line bears its own time. `existing` is a table loaded by other means before the
    stream's first batch. Lines read, valid and inserted are observed under these names.
    """
    rest = [c for c in lines.columns if c not in (*KEY, "place")]
    valid = _counted(_known(_counted(lines, "read"), proteins, terms), "valid")
    if existing is not None:
        held = existing.select(*[F.col(k).alias(f"_{k}") for k in KEY]).distinct()
        same = F.lit(True)
        for k in KEY:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        valid = valid.join(held, same, "left_anti")
    first = valid.withColumn("_at", F.current_timestamp()).groupBy(*KEY).agg(F.min(F.struct("_at", "place", *rest)).alias("_first"))
    new = _counted(first.filter(F.col("_first._at") == F.current_timestamp()), "inserted")
    rows = new.select(*KEY, *[F.col(f"_first.{c}").alias(c) for c in rest])
    with _state_on_disk(lines.sparkSession):
        return rows.writeStream.outputMode("update").foreachBatch(sink or _replace_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_pages(lines: DataFrame, proteins: DataFrame, terms: DataFrame, page: str, path: str, checkpoint: str) -> StreamingQuery:
    """Lines read and valid of every page, batch by batch: each writes the counts of its own lines, in place of what an earlier run of it wrote, and no state is kept."""
    accessions = proteins.select(F.col("accession").alias("protein"), F.lit(1).alias("_p")).distinct()
    known, write = terms.select("go_id", F.lit(1).alias("_t")).distinct(), _replace_batch(path)

    def run(batch: DataFrame, number: int) -> None:
        marked = batch.join(accessions, "protein", "left").join(known, "go_id", "left")
        write(marked.groupBy(page).agg(F.count(F.lit(1)).alias("read"), F.count(F.col("_p") + F.col("_t")).alias("valid")), number)

    return lines.select("protein", "go_id", page).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_counts(spark: SparkSession, path: str, page: str, kind: str | None = None) -> DataFrame:
    """(page, read, valid) over all batches. With the type of pages, there may be none yet."""
    files = spark.read if kind is None else spark.read.schema(f"{page} {kind}, read long, valid long")
    return files.parquet(path).groupBy(page).agg(F.sum("read").alias("read"), F.sum("valid").alias("valid"))


def totals(spark: SparkSession, path: str, counts: str, page: str) -> DataFrame:
    """One row: lines read and valid, by the pages that `count_pages` keeps in `counts`, and the rows inserted into the table at `path`.

    A batch's folder is replaced as a whole, so tasks and batches that run again count once, whoever listened.
    """
    lines = page_counts(spark, counts, page, "long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("read", "valid")])
    return lines.crossJoin(spark.read.schema(f"{KEY[0]} string").parquet(path).agg(F.count(F.lit(1)).alias("inserted")))  # a row each


def stream_predictions(queries: DataFrame, neighbours_of: Callable[[DataFrame], DataFrame], annotations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Query vectors (id, vector as a stream) against static references. A query counts once, also over batches, so (protein, term) stays unique."""
    write = _replace_batch(path)

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            write(transfer.predict_terms(neighbours_of(batch), annotations), number)
        finally:
            batch.unpersist()

    return queries.select("id", "vector").dropDuplicates(["id"]).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
