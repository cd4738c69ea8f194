r"""Personal data: patterns, and weak supervision over looser candidates.

Pattern spans (`email`, `ip`, `card`, `phone`) are always reported. The method adds `weak` spans: a
loose candidate generator (numbers of 7 digits or more with any separators, obfuscated mail addresses,
all pairs of neighbouring capitalised words in any alphabet that has capitals) is labelled by labelers of three sorts, each of which
votes personal, not personal or nothing: patterns (shape and length of the candidate), gazetteers (dialling codes, mail providers, given
names) and context (words before and after it). Expectation-maximisation over the vote patterns of all candidates in
the corpus estimates every labeler's reliability and each pattern's probability (Dawid-Skene with one
coin per labeler and class, for each sort of candidate; for names, which are rare among pairs, also how often each votes at all). A
logistic span classifier is then trained on those probabilities as soft labels. It sees none of the votes, only hashed features of the
text: the candidate's words and shape, and the words around it; so it also decides where no labeler has an opinion.

Votes are counted over all documents; there are at most 3 · 3^5 patterns. The classifier learns from at most `SAMPLE` distinct pairs of
votes and features (those with the smallest hash, a documented bound), weighed by their counts over all documents.

Null text counts as empty. Positions are code points, end exclusive. Very long texts are scanned whole. Without any candidate there are no
weak spans. Repeated rows are scanned each on their own; other columns are ignored, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_slices, table, text_or_empty, type_of

# The base patterns, in the order of their kinds.
KINDS = ("email", "ip", "card", "phone", "weak")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # such a match never begins inside a run of digits
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Word lists of the labelers.
CONTEXT_FOR = ("phone", "tel", "mobile", "call", "fax", "contact", "mail", "email", "ssn", "passport", "account", "iban", "name", "mr", "mrs", "ms", "dr", "dear", "signed", "address", "born")
CONTEXT_AGAINST = ("order", "isbn", "issn", "version", "figure", "table", "page", "chapter", "section", "error", "code", "year", "part", "item", "line", "price", "total")
AFTER_FOR = ("said", "says", "wrote", "writes", "called", "signed", "lives", "born", "asked", "told", "met", "please", "reply", "regards")
AFTER_AGAINST = ("street", "road", "river", "bank", "company", "inc", "ltd", "gmbh", "university", "museum", "edition", "pages", "items", "units", "percent", "euro", "dollars", "usd", "kg", "km")
ARTICLES = ("the", "a", "an", "of", "in", "on", "at", "der", "die", "das", "le", "la", "les", "el", "los", "un", "une", "ein", "eine")
GIVEN_NAMES = frozenset("alice anna anne antonio carlos charles claire daniel david elena emily emma eva francois george hans helen henry isabel jack james jane jean john jose juan julia karl laura lisa lucas luis maria marie mark martin mary max michael miguel nina olivia paul pedro peter pierre robert sara sarah sofia sophie thomas tom william".split())
MAIL_PROVIDERS = ("gmail", "yahoo", "hotmail", "outlook", "proton", "icloud", "aol", "gmx", "mail")

DIGITS = re.compile(r"(?<![A-Za-z0-9])[0-9](?:[\x20().-]{0,2}[0-9]){6,}(?![A-Za-z0-9])")
OBFUSCATED = re.compile(r"[A-Za-z0-9._-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z]{2,12}|\.[A-Za-z]{2,12})", re.IGNORECASE)


def letters(test: Callable[[str], bool]) -> str:
    """The characters that pass, as ranges for a regular expression."""
    found = [i for i in range(sys.maxunicode + 1) if test(chr(i))]
    starts, ends = [i for i in found if not test(chr(i - 1))], [i for i in found if not test(chr(i + 1))]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends, strict=True))


UPPER, LOWER = f"[{letters(str.isupper)}]", f"[{letters(str.islower)}\u0300-\u036f]"
REST = rf"(?:{LOWER}{{1,20}}|['\u2019])(?:[-'\u2019]?{UPPER}{LOWER}{{1,20}})?"  # of Anna, Jean-Luc, McDonald, O'Brien
#: Two names, with an initial between them or not; what precedes is looked at after the first letter, which is faster.
NAME = re.compile(rf"{UPPER}(?<!\w.){REST}(?:[\x20\xa0]{UPPER}\.)?[\x20\xa0]({UPPER}{REST})(?!\w)")
LETTERS = re.compile(r"[^\W\d_]+")
REACH = 60
#: Sorts of candidates, and the labelers.
NUMBER, MAIL, NAME_PAIR = 0, 1, 2
LABELERS = ("shape", "gazetteer", "context", "after", "length")
#: Labelers whose word for a name is taken at the start.
NAME_EXPERTS = (1, 2, 3)
FEATURES = 1 << 14
SAMPLE = 50_000


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    r"""Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, found from their @, in linear time."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > floor and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at) if s < at else None
        if m:
            found.append((s, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern spans; kind is an index into KINDS."""
    found = [(s, 0, e) for s, e in emails(text)]
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(z := p.lstrip("0")) <= 3 and int(z or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 37 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def name_pairs(text: str) -> Iterator[re.Match]:
    """Matches of NAME, each from the last word of the one before on, so that pairs overlap."""
    at = 0
    while m := NAME.search(text, at):
        yield m
        at = m.start(1)


def plain(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


GENERATORS = (DIGITS.finditer, OBFUSCATED.finditer, name_pairs)


def votes(kind: int, own: str, before: list[str], after: list[str]) -> tuple[int, ...]:
    """Each labeler's vote: 1 personal, 0 not, -1 nothing. `before` and `after` are the lower-case words around, nearest last and first."""
    near, next_ = before[-4:], after[:2]
    context = 1 if any(w in CONTEXT_FOR for w in near) else 0 if any(w in CONTEXT_AGAINST for w in near) or near[-1:] and near[-1] in ARTICLES else -1
    follow = 1 if any(w in AFTER_FOR for w in next_) else 0 if any(w in AFTER_AGAINST for w in next_) else -1
    if kind == NUMBER:
        digits = sum(c.isdigit() for c in own)
        return (int(any(c in " -.()" for c in own) and 9 <= digits <= 16), int(own.startswith("00") or before[-1:] == ["+"]), context, follow, int(9 <= digits <= 15))
    if kind == MAIL:
        words = [plain(w) for w in LETTERS.findall(own)]
        return (int(len(words) >= 4 and 2 <= len(words[-1]) <= 6), int(any(p in words for p in MAIL_PROVIDERS)), context, follow, int(len(own) <= 64))
    words = [plain(w) for w in own.split()]
    listed = any(w in CONTEXT_FOR or w in CONTEXT_AGAINST for w in words)  # Dear Anna is no name
    return (int(not listed and all(len(w) > 2 or w.endswith(".") for w in words)), int(words[0] in GIVEN_NAMES), context, follow, -1)


def shape(own: str) -> str:
    """Runs of digits, capitals and small letters by their lengths, anything else as it is."""
    kinds = "".join("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in own)
    return re.sub(r"9+|X+|x+", lambda m: f"{m[0][0]}{len(m[0]) if m[0][0] == '9' else ''}", kinds)


def features(kind: int, own: str, before: list[str], after: list[str]) -> list[int]:
    """Hashed features of a candidate's text."""
    found = [f"s:{shape(own)}", *(f"o:{plain(w)}" for w in LETTERS.findall(own))]
    found += [f"b:{w}" for w in before[-3:]] + [f"b1:{w}" for w in before[-1:]] + [f"a:{w}" for w in after[:2]] + [f"a1:{w}" for w in after[:1]]
    return sorted({zlib.crc32(f"{kind}{f}".encode("utf-8", "surrogatepass")) % FEATURES for f in ["", *found]})


def candidates(text: str, known: list[tuple[int, int, int]]) -> list[dict]:
    """Loose candidates that no pattern span touches: start, end, kind, votes (as a number) and features."""
    found, taken = [], sorted((s, e) for s, _, e in known)
    starts, furthest = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    low = text.lower()
    for kind, matches in enumerate(GENERATORS):
        if kind == MAIL and not ("[at" in low or "(at" in low or "[ at" in low or "( at" in low):
            continue
        for m in matches(text):
            s, e = m.span()
            i = bisect_left(starts, e)
            if i and furthest[i - 1] > s:
                continue
            left = text[max(0, s - REACH) : s]
            before, after = [w.lower() for w in LETTERS.findall(left)], [w.lower() for w in LETTERS.findall(text, e, e + REACH)]
            if left.endswith("+"):
                before.append("+")
            v = votes(kind, m[0], before, after)
            found.append({"start": s, "end": e, "kind": kind, "votes": sum((x + 1) * 3**k for k, x in enumerate(v)), "features": features(kind, m[0], before, after)})
    return found


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans, loose) of every row."""

    def kernel():
        def run(part: dict) -> dict:
            spans, loose = [], []
            for t in part["text"].to_pylist():
                known = base_spans(t)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in known])
                loose.append(candidates(t, known))
            return {"doc_id": part["doc_id"], "spans": spans, "loose": loose}

        return run

    rows = text_or_empty(df, doc_id, text=text).toDF("doc_id", "text")
    return map_slices(rows, kernel, f"doc_id {type_of(df, doc_id)}, spans array<struct<start:int,kind:int,end:int>>, loose array<struct<start:int,end:int,kind:int,votes:int,features:array<int>>>")


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, steps: int = 100, silence: bool = False, experts: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probability of class 1 for each vote pattern (rows of -1, 0, 1), and each labeler's accuracies (class, labeler).

    Starts from the majority vote; the accuracies carry a prior of 8 right votes of 10, so that a labeler
    that rarely votes keeps its meaning. With `silence` it also counts how often a labeler votes in each class: one that
    mostly says 1 tells little by what it says, but by when it does. With `experts` the class is rare, and what none of these labelers
    votes for starts near 0.
    """
    said, yes = patterns >= 0, patterns == 1
    p = np.clip((yes.sum(1) + 0.5) / (said.sum(1) + 1), 0.02, 0.98)
    if experts is not None:
        p = np.where(yes[:, experts].any(1), p, 1e-3)
    right, speaks = np.full((2, patterns.shape[1]), 0.8), np.full((2, patterns.shape[1]), 0.5)
    overall = np.clip(counts @ said / max(counts.sum(), 1), 1e-6, 1 - 1e-6)
    for _ in range(steps):
        for c, q in ((1, p), (0, 1 - p)):
            n = (counts * q) @ said
            right[c] = ((counts * q) @ (said & (yes == bool(c))) + 8) / (n + 10)
            if silence:
                speaks[c] = ((counts * q) @ said + 10 * overall) / ((counts * q).sum() + 10)
        prior = np.clip((counts @ p + 1) / (counts.sum() + 2), 0.01, 0.99)
        log = np.log(prior / (1 - prior)) + np.where(said, np.where(yes, np.log(right[1] / (1 - right[0])), np.log((1 - right[1]) / right[0])), 0).sum(1)
        log += np.where(said, np.log(speaks[1] / speaks[0]), np.log((1 - speaks[1]) / (1 - speaks[0]))).sum(1)
        new = 1 / (1 + np.exp(-log))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, right


def soft_labels(scanned: DataFrame) -> dict[tuple[int, int], float]:
    """The probability of each sort of candidate and vote pattern."""
    rows = scanned.select(F.explode("loose").alias("c")).groupBy("c.kind", "c.votes").count().orderBy("kind", "votes").collect()
    kinds, counts = np.array([r["kind"] for r in rows]), np.array([float(r["count"]) for r in rows])
    pattern = np.array([[r["votes"] // 3**k % 3 - 1 for k in range(len(LABELERS))] for r in rows])
    found = {}
    for kind in sorted(set(kinds.tolist())):
        own = kinds == kind
        name = kind == NAME_PAIR
        p, _ = expectation_maximisation(pattern[own], counts[own], silence=name, experts=NAME_EXPERTS if name else None)
        found |= {(kind, r["votes"]): float(x) for r, x in zip([r for r, o in zip(rows, own, strict=True) if o], p, strict=True)}
    return found


def fit(scanned: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """Weights of the span classifier for every feature, and its bias; none without candidates."""
    chance = soft_labels(scanned)
    if not chance:
        return None
    known = scanned.sparkSession.createDataFrame([(k, v, p) for (k, v), p in chance.items()], "kind int, votes int, p double")  # at most 3 · 3^5 rows
    grouped = scanned.select(F.explode("loose").alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count(F.lit(1)).alias("n"))
    rows = checkpointed(grouped.orderBy(F.xxhash64("kind", "votes", "features"), "kind", "votes", "features").limit(sample).join(F.broadcast(known), ["kind", "votes"]))
    seen = [r["f"] for r in rows.select(F.explode("features").alias("f")).distinct().orderBy("f").collect()]  # at most FEATURES
    vectors = CountVectorizerModel.from_vocabulary([str(f) for f in seen], inputCol="terms", outputCol="vector").setBinary(True)
    both = F.explode(F.array(*[F.struct(F.lit(y).alias("label"), (F.col("n") * (F.col("p") if y else 1 - F.col("p"))).alias("weight")) for y in (1.0, 0.0)]))
    data = vectors.transform(rows.withColumn("terms", F.col("features").cast("array<string>"))).select("vector", both.alias("y")).select("vector", "y.label", "y.weight").filter("weight > 0")
    found = LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", regParam=1e-4, standardization=False, maxIter=100).fit(data)
    weights = np.zeros(FEATURES)
    weights[seen] = found.coefficients.toArray()
    return weights, float(found.intercept)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_pii(df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row a document: counts, the base spans' hash and all spans, pattern and weak ones alike."""
    scanned = checkpointed(scan(df, text, doc_id))
    model = fit(scanned)
    limit = np.log(threshold / (1 - threshold))
    columns = ["n_email", "n_ip", "n_card", "n_phone", "n_weak", "base_sha256", "spans"]

    def kernel():
        def run(part: dict) -> dict:
            out = []
            for spans, loose in zip(part["spans"].to_pylist(), part["loose"].to_pylist(), strict=True):
                base = [(x["start"], x["kind"], x["end"]) for x in spans]
                more = [(x["start"], 4, x["end"]) for x in loose if model[0][x["features"]].sum() + model[1] >= limit] if model else []
                out.append((*(sum(k == i for _, k, _ in base) for i in range(4)), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            return {"doc_id": part["doc_id"]} | {c: [r[k] for r in out] for k, c in enumerate(columns)}

        return run

    return map_slices(scanned, kernel, f"doc_id {type_of(df, doc_id)}, n_email long, n_ip long, n_card long, n_phone long, n_weak long, base_sha256 string, spans string")


def op7(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))
