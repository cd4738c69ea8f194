"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space, the separator of every contract in this subpackage.
WS = r"[\x20\x09-\x0D]+"
NOT_WS = r"[^\x20\x09-\x0D]+"
WORD = re.compile(r"\w+")
#: Rows that a Python kernel works on at a time.
SLICE = 500
#: Parts that the rows of one key are dealt to where a key may be hot.
SALTS = 256
#: Bytes of ids that may be broadcast.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The named columns and the text, null as the empty string; all other columns go."""
    return df.select(*[df[c] for c in keep], F.coalesce(df[text], F.lit("")).alias("text"))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """The session's spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a session whose tasks run in the driver's own process gets a temporary folder; a cluster gets an error,
    since its executors don't see the driver's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix=f"spark-{purpose}-")
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def doc_bucket(doc_id: str = "doc_id", n: int = 5) -> Column:
    """crc32 of the id as text, modulo n: the fold a document belongs to (null id: fold 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def release() -> None:
    """Gives memory that kernels have freed back to the system, since a worker lives on for other tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def map_slices(df: DataFrame, start: Callable[[], Callable[[dict[str, pa.Array]], dict]], schema: str, rows: int = SLICE) -> DataFrame:
    """df through a Python kernel, `rows` rows at a time as Arrow columns.

    `start` is called once a task and gives the kernel, which turns named columns into those of the schema: lists, NumPy arrays,
    or Arrow columns handed on as they are (ids never pass through floating point). A result may have another number of rows.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = start()
        for batch in batches:
            release()
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = kernel(dict(zip(part.schema.names, part.columns, strict=True)))
                yield pa.RecordBatch.from_arrays([c if isinstance(c := found[f.name], pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow)
        del kernel
        release()

    return df.mapInArrow(run, schema)


def meet(rows: DataFrame, lookup: DataFrame, key: str, by: str, salts: int = SALTS) -> DataFrame:
    """rows joined with lookup (one row a key) where a key may hold a large share of rows.

    The rows of a key are dealt to `salts` parts by a hash of the column `by`, and the lookup's row goes once to every part that
    there is; so no task gets more than a share of a hot key, whatever its size.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    dealt = salted.select(key, "_salt").distinct().join(lookup, key)
    return salted.join(dealt, [key, "_salt"]).drop("_salt")


def few_bytes(df: DataFrame, column: str, most: int = BROADCAST_BYTES) -> bool:
    """Whether the values of a column are few enough to be broadcast: 8 bytes each, strings by their length."""
    width = F.octet_length(F.col(column).cast("string")) if df.schema[column].dataType == T.StringType() else F.lit(8)
    return (df.agg(F.sum(width).alias("n")).first()["n"] or 0) <= most


class Memo(dict):
    """A dict that computes a missing value once. Of two generations of at most `most` entries, what is still asked for survives, so memory stays bounded."""

    def __init__(self, make, most: int = 80_000):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
