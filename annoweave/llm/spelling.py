"""Spelling variants: words one edit apart, found over a variable-length gram index (VGRAM, Li, Wang and Yang 2007).

1. Words: maximal runs of Latin letters with A-Z lower-cased, counted over all documents.
2. Gram dictionary: grams of `QMIN` to `QMAX` letters are counted over the distinct words. A gram is open if more than a share of
   1 / `OPEN` of all grams of its length (and more than `RARE`) are equal to it; only open grams are prolonged, so frequent
   beginnings get long grams and rare ones stay short. At most `OPEN` grams a length can be open: that bounds the dictionary.
3. Decomposition: at every place the longest gram of the dictionary, unless an earlier one reaches as far.
4. Affected grams: how many grams of a word one edit can touch at most, over all places of the edit. If that is less than a word
   has, each near word shares at least the rest with it, so its rarest (affected + 1) grams include a shared one, and in
   the near word too. Only these are listed, each under gram, place and length; a gram behind the edit moves by one place.
5. Merging: words that meet in a list are near if one edit makes them equal; only such pairs leave the join. Long lists
   are split: the probing words are dealt out and the listed ones repeated for each share.
6. Words that an edit may touch in all their grams (most short ones) list all grams, which finds near words with gram bounds of
   their own; among themselves they meet by halves, one of which an edit leaves whole.

Null texts have no words. A null id is written as the empty string where ids are hashed. Repeated rows count
each time; ties between near words of one count go to the smallest in code-point order. A very long text is one more text, an empty
table has no words, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, table, text_or_empty

QMIN, QMAX = 2, 4
#: Grams of a length that may be open at most; each takes 16 bytes of the dictionary.
OPEN = 65_536
#: A gram in no more words than this is never prolonged.
RARE = 32
#: Listed words that a share of a list holds.
SHARE = 2_000
LETTERS = 7
COUNT = 2
TIMES = 10

RUN = re.compile("[A-Za-zÀ-ÿ]{7,}")
LOWER = {c: c + 32 for c in range(65, 91)}
FLUSH = 200_000


def counted_words(df: DataFrame, text: str = "text", doc_id: str = "doc_id", every: int = 31) -> DataFrame:
    """(word, n): words of `LETTERS` letters or more that occur `COUNT` times or more.

    A run whose crc32 with its document's id is a multiple of `every` loses one letter first, as a slip of the pen (0: none does).
    """
    rows = text_or_empty(df.withColumn("_id", F.coalesce(df[doc_id].cast("string"), F.lit(""))), "_id", text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for own, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                head = zlib.crc32(f"{own}:".encode())
                for word, n in Counter(RUN.findall(t.as_py())).items():
                    word = word.translate(LOWER)
                    if every:
                        h = zlib.crc32(word.encode(), head)
                        if h % every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= LETTERS:
                        held[word] += n
                if len(held) >= FLUSH:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= COUNT)


# -- grams. A letter is a number from 1 to 127 (7 bits), a gram the number that its letters make.


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of letter numbers."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.int64)
    return np.where(codes < 128, codes - 96, codes - 0xC0 + 27)


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the list, letters) of words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size), at, letters_of([words[i] for i in at])


def gram_codes(letters: np.ndarray, q: int) -> np.ndarray:
    code = letters[:, : letters.shape[1] - q + 1]
    for k in range(1, q):
        code = code << 7 | letters[:, k : letters.shape[1] - q + 1 + k]
    return code


class GramDictionary:
    """The open grams of every length with their counts, as sorted arrays."""

    def __init__(self, grams: dict[int, tuple[np.ndarray, np.ndarray]], qmin: int, qmax: int):
        self.grams, self.qmin, self.qmax = grams, qmin, qmax

    def counts(self, codes: np.ndarray, q: int) -> np.ndarray:
        """How many words hold each gram; 0 if it isn't open."""
        known, n = self.grams.get(q, (None, None))
        if known is None or not len(known):
            return np.zeros(codes.shape, np.int64)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[at] == codes, n[at], 0)

    def decompose(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words of one length: whether a gram of the word begins at each place, its number, its count, its length, and the affected grams of each word."""
        rows, size = letters.shape
        places = max(0, size - self.qmin + 1)
        length = np.full((rows, places), self.qmin)
        code = gram_codes(letters, self.qmin) if places else np.zeros((rows, 0), np.int64)
        code, weight = code.copy(), self.counts(code, self.qmin)
        for q in range(self.qmin + 1, self.qmax + 1):
            reach = size - q + 1
            if reach <= 0:
                break
            longer = gram_codes(letters, q)
            on = (length[:, :reach] == q - 1) & (weight[:, :reach] > 0)
            count = self.counts(longer, q)
            length[:, :reach][on], code[:, :reach][on], weight[:, :reach][on] = q, longer[on], count[on]
        start = np.arange(places)
        end = start + length
        before = np.maximum.accumulate(np.concatenate([np.zeros((rows, 1), np.int64), end[:, :-1]], axis=1), axis=1) if places else end
        own = end > before
        # A gram that ends with its word might be prolonged by a letter behind it, unless it is closed or of full length.
        last = np.where((length < self.qmax) & (weight > 0), end, end - 1)
        first = np.maximum(0, end - self.qmax)
        touched = np.zeros((rows, size + 2), np.int64)
        line = np.arange(rows)
        for p in range(places):
            np.add.at(touched, (line, first[:, p]), own[:, p])
            np.add.at(touched, (line, last[:, p] + 1), -own[:, p].astype(np.int64))
        affected = np.cumsum(touched, axis=1)[:, : size + 1].max(axis=1) if rows else np.zeros(0, np.int64)
        return own, code, weight, length, affected


def mixed(*parts) -> np.ndarray:
    """One 64-bit key of several numbers; keys of different numbers may be equal, which only adds words to compare."""
    key = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for part in parts:
            key = (key ^ np.asarray(part).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key = key ^ (key >> np.uint64(29))
    return key.astype(np.int64)


def listed(dictionary: GramDictionary, words: list[str], shorter: bool) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, key of a list) under which words are listed; with `shorter`, those under which they look for words with one letter more."""
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(at, *parts):
        key = np.broadcast_to(mixed(*parts), at.shape)
        rows.append(at)
        keys.append(key)

    for size, at, letters in by_length(words):
        own, code, weight, length, affected = dictionary.decompose(letters)
        order = np.lexsort((np.broadcast_to(np.arange(code.shape[1]), code.shape), code, length, weight, ~own), axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        row, place = np.nonzero(own & (rank <= affected[:, None]))
        gram, q = code[row, place], length[row, place]
        if shorter:
            for moved in (0, 1):
                add(at[row], 1, size + 1, place + moved, q, gram)
        else:
            add(at[row], 1, size, place, q, gram)
        weak = np.flatnonzero(own.sum(axis=1) <= affected)
        if not len(weak):
            continue
        part, half = letters[weak], size // 2
        if shorter:
            add(at[weak], 2, size, size + 1, *part[:, :half].T)
            add(at[weak], 3, size, size + 1, *part[:, half:].T)
        else:
            add(at[weak], 2, size, size, *part[:, :half].T)
            add(at[weak], 3, size, size, *part[:, half:].T)
            half = (size - 1) // 2
            add(at[weak], 2, size - 1, size, *part[:, :half].T)
            add(at[weak], 3, size - 1, size, *part[:, half + 1 :].T)
    return np.concatenate(rows), np.concatenate(keys)


def parities(words: list[str]) -> np.ndarray:
    """A bit for each letter that stands in a word an odd number of times: one edit changes at most two."""
    out = np.zeros(len(words), np.int64)
    for _, at, letters in by_length(words):
        out[at] = np.bitwise_xor.reduce(np.left_shift(np.int64(1), letters % 63), axis=1)
    return out


def gram_dictionary(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, most: int = OPEN, rare: int = RARE) -> GramDictionary:
    """The open grams of the distinct words: counted by all tasks, at most `most` a length reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[int, list] = {q: [] for q in range(qmin, qmax + 1)}
            for size, _, letters in by_length(b.column(0).to_pylist()):
                for q in range(qmin, min(qmax, size) + 1):
                    found[q].append(gram_codes(letters, q).ravel())
            for q, parts in found.items():
                if parts:
                    code, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), q, np.int32)), pa.array(code), pa.array(n)], ["q", "code", "n"])

    counts = checkpointed(words.select("word").mapInArrow(run, "q int, code long, n long").groupBy("q", "code").agg(F.sum("n").alias("n")).filter(F.col("n") > rare))
    totals = counts.groupBy("q").agg(F.sum("n").alias("total"))
    frequent = counts.join(F.broadcast(totals), "q").filter(F.col("n") * most > F.col("total")).select("q", "code", "n").toPandas()
    grams = {}
    for q, own in frequent.groupby("q"):
        own = own.sort_values("code")
        grams[int(q)] = (own["code"].to_numpy(), own["n"].to_numpy())
    return GramDictionary(grams, qmin, qmax)


def near_words(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, most: int = OPEN, rare: int = RARE, share: int = SHARE) -> DataFrame:
    """(word, n, other, other_n): each pair of words (word, n) exactly one edit apart once."""
    dictionary = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, qmin, qmax, most, rare))

    def lists(shorter: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = b.column(0).to_pylist()
                at, key = listed(dictionary.value, own, shorter)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(parities(own)[at]), pa.array(key)], ["word", "n", "odd", "key"])

        return words.select("word", "n").mapInArrow(run, "word string, n long, odd long, key long")

    entries = lists(False)
    long = checkpointed(entries.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > share))
    shares = F.ceil(F.coalesce("_size", F.lit(1)) / share).cast("int")
    held = entries.join(long, "key", "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).select("key", "_share", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("odd").alias("_odd"))
    probes = entries.unionByName(lists(True)).join(long, "key", "left").withColumn("_share", F.pmod(F.xxhash64("word"), shares).cast("int")).drop("_size")
    a, b = F.length("word"), F.length("other")
    near = (F.bit_count(F.col("odd").bitwiseXOR(F.col("_odd"))) <= 2) & ((a < b) | ((a == b) & (F.col("word") < F.col("other")))) & (F.levenshtein("word", "other", 1) == 1)
    return probes.join(held, ["key", "_share"]).filter(near).select("word", "n", "other", "other_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): forms followed to the last. In every round each word takes the root of its root, so rounds grow with the logarithm of a chain's length."""
    found = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        stepped = found.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        stepped = checkpointed(stepped)
        found = stepped.drop("_moved")
        if not stepped.filter("_moved").head(1):
            return found


def variants(words: DataFrame, times: int = TIMES, **settings) -> DataFrame:
    """One row a word (word, n): its form, the last form that forms lead to, and how many near words it has."""
    pairs = near_words(words, **settings)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_b"))
    known = words.join(near, "word", "left")
    often = -F.col("_b.less") >= times * F.col("n")
    own = checkpointed(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("_b.other")).alias("form"), F.when(often, -F.col("_b.less")).alias("form_n")))
    last = roots(own.filter("form is not null"))
    return own.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, text: str = "text", doc_id: str = "doc_id", every: int = 31, **settings) -> DataFrame:
    """Words of the documents with their forms and roots."""
    return variants(checkpointed(counted_words(df, text, doc_id, every)), **settings)


def op13(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))
