"""Secret scans: patterns, and zstandard novelty primed with dictionaries.

Pattern spans (`assign`, `access`, `hex`) are always reported. The method adds `novel` spans: a
string next to a sensitive word (password, bearer, private key, ...) is priced by its marginal
compressed bytes, that is how much longer the surrounding code grows under zstandard when the
string is in it. The compressor is primed with a dictionary of identifiers: fixed ones from
everyday code and the most frequent ones found beside sensitive words anywhere in the corpus. A
string that the dictionary and its surroundings don't explain (bits per character at least
`MIN_BITS`, `MIN_PRICE` bits in all) is reported unless a pattern span covers it already. Only the price
decides, not length, case or digits. A reported string is sensitive surroundings itself, so the context
runs on over all lines of a private key.

One pass over the texts counts identifiers, a second one finds and prices the strings of each text. The dictionary
is top-k by counts over all documents, ties by the string, so it is bounded and the same on every run.

Null text counts as empty; an empty text has no spans. Positions are code points, end exclusive. Very long texts are scanned whole,
in linear time. Repeated rows are scanned each on their own; other columns of the input are ignored, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, table, text_or_empty, type_of

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of [0-9a-f]+ with 24 characters or more
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_WORDS = ("passw", "secret", "token", "api")

#: Words that make their surroundings sensitive, lower case, and how far they reach.
SENSITIVE = ("passw", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "api-key", "private key", "private_key", "credential", "bearer", "authorization", "access_key", "accesskey", "client_id", "connectionstring", "ssh-rsa", "akia")
SENSITIVE_RE = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE)
REACH = 80
SURROUNDING = 256
#: A candidate: a run of key characters. One of fewer than 8 can't hold `MIN_PRICE` bits.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
MIN_BITS = 4.0
MIN_PRICE = 64
#: Entries of the corpus's identifier dictionary.
DICTIONARY_SIZE = 2_000
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z_]{2,31}")

# Identifiers of everyday code.
CODE_IDENTIFIERS = """
access_key access_token account admin api api_key apikey app argument array assert async auth authorization await base64
bearer boolean bucket bytes cache callback catch char class client client_id client_secret cluster column config
connection const constructor continue cookie count credential data database datetime debug decode default delete
description dictionary double encode encoding encrypt endpoint enum environ environment error event except exception
export extends false filename final finally float format function getenv group handler hash header headers host
hostname http https import index init input insert instance int integer interface iterator json key lambda length list
localhost logger login map message method module name namespace new null number object option output override package
param parameter parse password passwd path permission port print private private_key profile property protected public
query raise range read region register request response result return role root row schema secret secret_key select self
serialize server service session set signature size source ssh static status stream string struct super table task temp
test thread throw timeout timestamp token true type undefined update upload url user username utf8 uuid value var vector
version void while write yaml
""".split()
KEY_MARKS = [f"-----{x} {kind}PRIVATE KEY-----" for kind in ("ENCRYPTED ", "DSA ", "EC ", "OPENSSH ", "RSA ", "") for x in ("END", "BEGIN")]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern spans; kind is an index into KINDS."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, known: list[tuple[int, int, int]], novel: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """(start, end) of the novel strings in sensitive context that no pattern span touches.

    Context reaches `REACH` characters to both sides of a sensitive word, and on from each string that is reported there.
    """
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return []
    words = [m.span() for m in SENSITIVE_RE.finditer(text)]
    items, at = [(s, e, True) for s, _, e in known], 0
    taken, furthest = sorted((s, e) for s, _, e in known), 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][0] < e:
            furthest = max(furthest, taken[at][1])
            at += 1
        if furthest <= s:
            items.append((s, e, False))
    items.sort()
    reported, priced = [False] * len(items), [False] * len(items)

    def reach(k: int) -> bool:
        if not priced[k]:
            s, e, is_known = items[k]
            priced[k], reported[k] = True, is_known or novel(s, e)
        return reported[k]

    until, at = -1, 0  # where the context ends that began before
    for k, (s, e, _) in enumerate(items):
        while at < len(words) and words[at][0] < e:
            until = max(until, words[at][1] + REACH)
            at += 1
        if (s <= until or (at < len(words) and e >= words[at][0] - REACH)) and reach(k):
            until = max(until, e + REACH)
    since = len(text) + 1  # where the context begins that ends after
    for k in range(len(items) - 1, -1, -1):
        if reported[k] or (items[k][1] >= since and reach(k)):
            since = min(since, items[k][0] - REACH)
    return [(s, e) for (s, e, is_known), yes in zip(items, reported, strict=True) if yes and not is_known]


def identifiers_near(text: str) -> list[str]:
    """Distinct identifiers in the surroundings of sensitive words."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return []
    found, done = set(), 0
    for word in SENSITIVE_RE.finditer(text):
        end = word.end() + SURROUNDING
        found.update(IDENTIFIER.findall(text, max(done, word.start() - SURROUNDING), end))
        done = max(done, end)
    return sorted(found)


def identifier_dictionary(df: DataFrame, size: int = DICTIONARY_SIZE, text: str = "text") -> list[str]:
    """The `size` identifiers that most documents have beside sensitive words, ties by the string."""

    def kernel():
        return lambda part: {"word": [w for t in part["text"].to_pylist() for w in identifiers_near(t)]}

    near = map_slices(text_or_empty(df, text=text), kernel, "word string")
    return [r["word"] for r in near.groupBy("word").count().filter("count > 1").orderBy(F.desc("count"), "word").limit(size).collect()]


class Novelty:
    """Marginal compressed bytes under a compressor primed with identifiers."""

    def __init__(self, identifiers: list[str]):
        # zstandard prefers what stands near the end of a dictionary, so the most frequent go last.
        words = list(dict.fromkeys([*identifiers, *CODE_IDENTIFIERS]))
        primed = zstandard.ZstdCompressionDict(" ".join([*reversed(words), *SENSITIVE, *KEY_MARKS]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=9)
        self.compress = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_checksum=False).compress

    def bits(self, before: str, own: str, after: str) -> int:
        """Bits that the string adds to its surroundings."""
        around = len(self.compress((before + after).encode("utf-8", "surrogatepass")))
        return 8 * max(0, len(self.compress((before + own + after).encode("utf-8", "surrogatepass"))) - around)

    def spans(self, text: str, known: list[tuple[int, int, int]], min_bits: float) -> list[tuple[int, int]]:
        """(start, end) of the text's novel strings."""

        def novel(s: int, e: int) -> bool:
            return self.bits(text[max(0, s - SURROUNDING) : s], text[s:e], text[e : e + SURROUNDING]) >= max(MIN_PRICE, min_bits * (e - s))

        return novel_spans(text, known, novel)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_secrets(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_bits: float = MIN_BITS, dictionary_size: int = DICTIONARY_SIZE) -> DataFrame:
    """One row a document: counts, the base spans' hash and all spans, patterns and novel strings alike."""
    words = identifier_dictionary(df, dictionary_size, text)
    columns = ["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]

    def kernel():
        novelty = Novelty(words)

        def run(part: dict) -> dict:
            out = []
            for t in part["text"].to_pylist():
                base = base_spans(t)
                new = [(s, 3, e) for s, e in novelty.spans(t, base, min_bits)]
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                out.append((*n, len(new), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + new)))
            return {"doc_id": part["doc_id"]} | {c: [r[k] for r in out] for k, c in enumerate(columns)}

        return run

    rows = text_or_empty(df, doc_id, text=text).toDF("doc_id", "text")
    return map_slices(rows, kernel, f"doc_id {type_of(df, doc_id)}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def op1(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))
