"""Token counts kept by deltas.

Totals by source, language and tokenizer version are additive, so a change of a document is a signed
row: an insert adds its tokens, a delete takes them away, a revised count does both. `Rollup` keeps one folder:
each committed batch is a partition `batch=<id>` of signed sums by key. A batch is written with dynamic
partition overwrite, so committing it again, after a lost driver or a replay, puts the same sums in
place of the same sums and the totals don't change. `totals` adds up the batches; `compact` folds them into one, which also
lists the ids it holds: a folded batch is final, committing it again changes nothing.

Changes are pre-aggregated map-side before the only shuffle (keys: source, lang, version), so a hot
source costs no more than others. Null text counts as empty, with 0 tokens; null source or language is a key
of its own. Repeated rows count once each. A very long text is one number. An empty batch commits and changes nothing. Keys whose
documents and tokens are all taken away don't appear in the totals. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Pointer
from .common import NOT_WS, checkpointed, map_slices, shared_folder, table, type_of

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, docs long, tokens long, folded string, batch string"
BPE_FILE = "byte_bpe_50k.tiktoken"


def words_in(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WS)), F.lit(0)).cast("long")


def word_counts(df: DataFrame, text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(source, lang, tokens) of every row, tokens being its words."""
    return df.select(df[source].cast("string").alias("source"), df[lang].cast("string").alias("lang"), words_in(df[text]).alias("tokens"))


def bpe_counts(df: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", keep: tuple[str, ...] = (), file: str | None = None) -> DataFrame:
    """(source, lang, tokens and the kept columns) of every row under a public byte-level BPE vocabulary (tiktoken format)."""
    import public_tokenizers

    path, pattern = file or public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN
    inner = [f"_k{k}" for k in range(len(keep))]
    rows = df.select(df[source].cast("string").alias("source"), df[lang].cast("string").alias("lang"), F.coalesce(df[text], F.lit("")).alias("text"), *[df[c].alias(n) for c, n in zip(keep, inner, strict=True)])

    def kernel():
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda part: part | {"tokens": [len(encode(t)) for t in part["text"].to_pylist()]}

    schema = "source string, lang string, tokens long" + "".join(f", {n} {type_of(df, c)}" for c, n in zip(keep, inner, strict=True))
    return map_slices(rows, kernel, schema).withColumnsRenamed(dict(zip(inner, keep, strict=True)))


def signed(counts: DataFrame, sign: int, version: str | Column) -> DataFrame:
    """Changes (source, lang, version, docs, tokens): documents that come (sign 1) or go (-1)."""
    v = F.lit(version) if isinstance(version, str) else version
    return counts.select("source", "lang", v.alias("version"), F.lit(sign).cast("long").alias("docs"), (F.col("tokens") * sign).cast("long").alias("tokens"))


def revised(counts: DataFrame, version: str, old: str, new: str) -> DataFrame:
    """Changes of documents whose count of `old` becomes `new`: no document comes or goes."""
    return counts.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(version).alias("version"), F.lit(0).cast("long").alias("docs"), (F.col(new) - F.col(old)).cast("long").alias("tokens"))


class Rollup:
    """Additive totals in a folder that all executors share. All handles of a path follow its pointer to the generation in use; there is one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.pointer = spark, Pointer(spark, path)

    @property
    def path(self) -> str:
        """The folder of the generation in use."""
        return f"{self.pointer.path}/{self.pointer.get() or 'generation-0'}"

    def _mark(self) -> DataFrame:
        """A row that adds nothing."""
        one = self.spark.range(1, numPartitions=1)
        return one.select(*[F.lit(None).cast("string").alias(k) for k in KEYS], *[F.lit(0).cast("long").alias(c) for c in ("docs", "tokens")], F.lit(None).cast("string").alias("folded"))

    def _write(self, batch: str, rows: DataFrame, path: str | None = None) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path or self.path)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Puts the batch's signed sums in place; doing so again leaves the totals as they are. False if it is folded already."""
        if self.started() and not self.batches().filter(F.col("folded") == batch).isEmpty():
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).withColumn("folded", F.lit(None).cast("string"))
        # A batch without changes still leaves its mark, so that commits can be listed.
        self._write(batch, sums.unionByName(self._mark()))
        return True

    def started(self) -> bool:
        """Whether anything was committed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def batches(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def totals(self) -> DataFrame:
        sums = self.batches().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("version is not null and (docs != 0 or tokens != 0)")

    def compact(self, into: str) -> None:
        """Writes the totals as one batch of a new generation, with the ids of all batches it holds, and then moves the pointer there.

        A compaction that fails before that leaves the old generation in use, for new handles too.
        """
        own = self.batches()
        ids = own.select(F.col("batch").alias("folded")).union(own.filter("folded is not null").select("folded")).distinct()
        held = ids.crossJoin(self._mark().drop("folded")).select(*KEYS, "docs", "tokens", "folded")  # the mark is one row
        name = f"generation-{uuid.uuid4().hex}"
        self._write(into, self.totals().withColumn("folded", F.lit(None).cast("string")).unionByName(held), f"{self.pointer.path}/{name}")
        self.pointer.set(name)


def state_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark, 'state')}/{name}-{uuid.uuid4().hex}"


#: Runs of symbols alone.
SYMBOLS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{N}]+(?![^\x20\x09-\x0D])"


def op2(spark, sf_dir):
    """All documents loaded under two tokenizer versions, low-quality ones deleted from both, counts of symbols revised, one batch replayed, all folded.

    Texts are read once, for a line of counts a document; what follows joins and adds up these lines.
    """
    docs, text = table(spark, sf_dir, "documents"), F.col("text")
    flagged = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()
    own = docs.select("doc_id", "text", "lang", "source", words_in(text).alias("words"), F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("symbols"))
    counts = checkpointed(bpe_counts(own, keep=("doc_id", "words", "symbols")))
    bad, good = (counts.join(flagged, "doc_id", how) for how in ("left_semi", "left_anti"))

    def words(rows: DataFrame) -> DataFrame:
        return rows.select("source", "lang", F.col("words").alias("tokens"))

    rollup = Rollup(spark, state_folder(spark, "token-rollup"))
    rollup.commit("load-word-1", signed(words(counts), 1, "word-1"))
    rollup.commit("load-bpe-1", signed(counts, 1, "bpe-1"))
    rollup.commit("delete-low-quality", signed(words(bad), -1, "word-1").unionByName(signed(bad, -1, "bpe-1")))
    # Counts revised: a tokenizer fix that no longer counts runs of symbols alone.
    changes = revised(good.filter("symbols > 0").withColumn("new", F.col("words") - F.col("symbols")), "word-1", "words", "new")
    rollup.commit("revise-word-1", changes)
    rollup.compact("folded")
    rollup.commit("revise-word-1", changes)  # a replay changes nothing
    return rollup.totals()
