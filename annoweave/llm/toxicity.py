"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words, lower case, and the words' beginnings of 4 and 6 bytes, each hashed
into 2^16 buckets. Every bucket is an input: none is chosen or left out by its label, so a term that is neutral on its own and
tells only beside another one (a group's name beside an insult) is learned as well. An input is 1 shrunk by
n / (n + `SHRINK`), where n counts the sample's documents with that bucket: what was hardly ever seen hardly counts, and what was
never seen counts nothing. Spark's FMClassifier learns linear weights plus factor vectors whose products weigh every pair.

It learns from labelled rows only, outside the held-out fold, at most `SAMPLE_ROWS` of them (those with the
smallest hash of their id, a documented bound; their ids are broadcast). Neither labels nor id, language or source enter a
score. The model, 2^16 · (`FACTORS` + 1) numbers (2.6 MB), is broadcast once. Scoring is map-only over whole texts: the distinct terms
of some hundred documents, then sums over all of them at once.

Null and empty text score as the model's bias. Without labels of both classes every score is the share
of toxic ones (0 without any). A doc_id labelled more than once counts as toxic if any label says so. Repeated rows score alike;
a very long text is only a larger set of terms. Other columns don't matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, WORD, checkpointed, doc_bucket, few_bytes, map_slices, table, type_of

BUCKETS = 1 << 16
PREFIXES = (4, 6)
SHRINK = 20.0
SAMPLE_ROWS = 20_000
#: Tasks that the bounded sample is dealt to; each sends one gradient an iteration. With more than five, treeAggregate puts a further stage
#: between, and the driver serialises the whole vector of sums some more times for each stage of each iteration.
SAMPLE_PARTS = 5
FACTORS = 4
ITERATIONS = 60
STEP = 0.1
RIDGE = 1e-3
SEED = 7


def word_terms(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    own = word.encode("utf-8", "surrogatepass")
    found = [zlib.crc32(own) % BUCKETS]
    for n in PREFIXES:
        if len(own) >= n:
            found.append(zlib.crc32(own[:n], n) % BUCKETS)  # n tells a beginning from a word
    return found


def term_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct terms of every text, by row and bucket."""
    place: dict[str, int] = {}
    words, sizes = [], []
    for t in texts:
        own = set(WORD.findall(t.lower()))
        words += [place.setdefault(w, len(place)) for w in own]
        sizes.append(len(own))
    terms = [word_terms(w) for w in place]
    count = np.array([len(t) for t in terms], int)
    flat = np.fromiter((b for t in terms for b in t), np.int64, int(count.sum()))
    begin = np.cumsum(count) - count
    words, row = np.array(words, int), np.repeat(np.arange(len(texts)), sizes)
    own = count[words]
    at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    found = np.sort(np.repeat(row, own) * BUCKETS + flat[np.repeat(begin[words], own) + at])
    found = found[np.r_[True, found[1:] != found[:-1]][: len(found)]]
    return found // BUCKETS, found % BUCKETS


@dataclass(frozen=True)
class Model:
    """A factorization machine: bias, and for every bucket a weight and a factor vector, both times the bucket's shrinkage."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of the label for every text."""
        row, bucket = term_sets(texts)
        n = len(texts)
        z = self.bias + np.bincount(row, self.linear[bucket], n)
        for v in self.factors.T:
            s = np.bincount(row, v[bucket], n)
            z += 0.5 * (s * s - np.bincount(row, v[bucket] ** 2, n))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def constant(share: float) -> Model:
    bias = np.clip(np.log(share / (1 - share)) if 0 < share < 1 else np.inf if share else -np.inf, -500, 500)
    return Model(float(bias), np.zeros(BUCKETS), np.zeros((BUCKETS, 0)))


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(label, terms) of at most `rows` labelled documents outside the held-out fold."""
    known = labels.select(labels[doc_id].alias("doc_id"), labels[label].cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = checkpointed(known.filter(doc_bucket("doc_id") != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    dealt = F.broadcast(chosen) if few_bytes(chosen, "doc_id") else chosen
    texts = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text")).join(dealt, "doc_id").select("label", "text")

    def kernel():
        def terms(part: dict) -> dict:
            own = part["text"].to_pylist()
            row, bucket = term_sets(own)
            ends = np.searchsorted(row, np.arange(1, len(own)))
            return {"label": part["label"], "terms": np.split(bucket.astype(np.int32), ends)}

        return terms

    return checkpointed(map_slices(texts, kernel, "label int, terms array<int>"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    sample = training_rows(docs, labels, text, doc_id, label, rows).select((F.col("label") > 0).cast("double").alias("label"), "terms")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return constant(1.0 if 1.0 in sizes else 0.0)
    seen = sample.select(F.explode("terms").alias("bucket")).groupBy("bucket").count().orderBy("bucket").toArrow()  # at most BUCKETS rows, as columns
    if not seen.num_rows:
        return constant(sizes[1.0] / sum(sizes.values()))
    buckets, counts = (seen.column(c).to_numpy() for c in ("bucket", "count"))
    shrink = counts / (counts + SHRINK)
    vectors = CountVectorizerModel.from_vocabulary([str(b) for b in buckets], inputCol="terms", outputCol="ones").setBinary(True)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(shrink), inputCol="ones", outputCol="features")
    own = vectors.transform(sample.withColumn("terms", F.col("terms").cast("array<string>")))
    data = scaled.transform(own).select("label", "features").repartition(SAMPLE_PARTS).persist()
    found = FMClassifier(factorSize=FACTORS, maxIter=ITERATIONS, stepSize=STEP, regParam=RIDGE, initStd=0.05, seed=SEED, tol=1e-5).fit(data)
    data.unpersist()
    linear, factors = np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS))
    linear[buckets], factors[buckets] = found.linear.toArray() * shrink, found.factors.toArray() * shrink[:, None]
    return Model(float(found.intercept), linear, factors)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", output: str = "score") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel():
        own = shared.value
        return lambda part: {"id": part["id"], "score": own.scores(part["text"].to_pylist())}

    rows = docs.select(docs[doc_id].alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return map_slices(rows, kernel, f"id {type_of(docs, doc_id)}, score double").select(F.col("id").alias("doc_id"), F.col("score").alias(output))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, text, doc_id), text, doc_id)
    return scored.select("doc_id", (doc_bucket("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text, doc_id))

    @F.arrow_udf("double")
    def own_score(texts: pa.Array) -> pa.Array:
        parts = [shared.value.scores(texts.slice(i, SLICE).to_pylist()) for i in range(0, len(texts), SLICE)]
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return docs.filter(own_score(F.coalesce(docs[text], F.lit(""))) < threshold)


def op8(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
