"""Cost-balanced packing of tokenised documents into training sequences.

A sequence costs what a transformer pays for it: linear in its tokens plus quadratic in the length
of each piece (attention stays within a document). Documents longer than a sequence give whole
sequences first; the pieces that are left are taken in descending length and each goes to the
lowest-cost sequence that has room for it. Where none has room, the piece is cut and fills the
lowest-cost open sequence. What is left open at the end of a split is cut into sequences of a power
of two tokens, which need no padding, so every token is kept and no padding is made.

The work is map-only: each task tokenises and packs its own split in windows of `WINDOW_TOKENS`, and
carries the last, partly filled sequence into the next window. Memory is bounded by a window and one
document; nothing is shuffled, a hot source is dealt out by Spark's file splits like any other, and
a lost executor repeats only its splits. Sequence ids hold the task's partition in the upper bits, so
they are unique without a global counter.

A null text counts as empty: its only token is the end token. Repeated rows are packed once each,
rows with a null id too. A very long text gives whole sequences. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Memo, release, table, text_or_empty, type_of

LENGTH = 2_048
END = 1
WINDOW_TOKENS = 1_000_000
#: Cost of n tokens in a piece: LINEAR * n + QUADRATIC * n².
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH


def cost(n, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * n + quadratic * n * n


@dataclass
class Packer:
    """Packs pieces (document index, start, length) into sequences; keeps the last open one between windows."""

    length: int = LENGTH
    next_id: int = 0
    open_pieces: list[tuple] = field(default_factory=list)

    def window(self, pieces: list[tuple], last: bool = False) -> list[list[tuple]]:
        """Full sequences of these pieces and those left open before; at the end, of all that is left."""
        pieces, self.open_pieces = self.open_pieces + pieces, []
        full = []
        rest = []
        for doc, start, n in pieces:
            while n >= self.length:
                full.append([(doc, start, self.length)])
                start, n = start + self.length, n - self.length
            if n:
                rest.append((doc, start, n))
        total = sum(n for *_, n in rest)
        k = total // self.length
        bins: list[list[tuple]] = [[] for _ in range(k + 1)]
        room = np.full(k + 1, self.length)
        room[k] = total - k * self.length  # the sequence that stays open takes the remainder alone
        costs = np.zeros(k + 1)
        for doc, start, n in sorted(rest, key=lambda p: -p[2]):
            while n:
                fits = room >= n
                at = int(np.argmin(np.where(fits if fits.any() else room > 0, costs, np.inf)))
                part = min(n, int(room[at]))
                bins[at].append((doc, start, part))
                room[at] -= part
                costs[at] += cost(part)
                start, n = start + part, n - part
        full += bins[:k]
        self.open_pieces = bins[k]
        return full + (self.powers() if last else [])

    def powers(self) -> list[list[tuple]]:
        """The open sequence cut into sequences of a power of two tokens."""
        pieces, self.open_pieces = self.open_pieces[::-1], []
        left = sum(n for *_, n in pieces)
        out = []
        while left:
            need = 1 << (left.bit_length() - 1)
            left -= need
            out.append([])
            while need:
                doc, start, n = pieces.pop()
                part = min(n, need)
                out[-1].append((doc, start, part))
                need -= part
                if part < n:
                    pieces.append((doc, start + part, n - part))
        return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words of printable ASCII but the apostrophe and of Latin letters, which stand for themselves before and after this tokenizer's NFC form, without the
#: beginning of an added token: its rules cut them into runs of letters, single digits, and runs of other signs.
PLAIN = re.compile(r"(?:(?!<\|)[!-&(-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF])+")
RUNS = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet as a translation: printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in same)}


class WordEncoder:
    """Token ids as little-endian 32-bit bytes.

    This tokenizer never joins what a space or line feed separates, so words are encoded once and kept. Plain words are cut
    by its rules and their runs go to its BPE model directly; all others go through the whole tokenizer.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(file), byte_letters()
        self.model = self.tokenizer.model
        self.words, self.parts = Memo(self.word, 150_000), Memo(self.part, 100_000)

    def part(self, own: str) -> bytes:
        if not own.isascii():
            own = own.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(own)])

    def word(self, own: str) -> bytes:
        if PLAIN.fullmatch(own):
            return b"".join(map(self.parts.__getitem__, RUNS.findall(own.lower())))
        return np.array(self.tokenizer.encode(own, add_special_tokens=False).ids, "<u4").tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        get = self.words.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


def pack(df: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW_TOKENS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = text_or_empty(df, doc_id, text=text).toDF("doc_id", "text")
    file = tokenizer or default_tokenizer()
    schema = f"doc_id {type_of(df, doc_id)}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(file)
        packer = Packer(length, TaskContext.get().partitionId() << 36)
        tail = np.array([end], "<u4").tobytes()
        docs: dict[int, tuple] = {}  # of documents with pieces to come: id, ids
        count, pieces, held = 0, [], 0

        def packed(last: bool) -> pa.RecordBatch:
            nonlocal pieces, held
            out = []
            for seq in packer.window(pieces, last):
                at = 0
                for d, start, n in seq:
                    own, ids = docs[d]
                    part = ids[4 * start : 4 * (start + n)]
                    out.append((own, start, n, zlib.crc32(part), len(ids) // 4, packer.next_id, at))
                    at += n
                packer.next_id += 1
            pieces, held = [], 0
            still = {d for d, *_ in packer.open_pieces}
            for d in [d for d in docs if d not in still]:
                del docs[d]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for own, ids in zip(part.column(0).to_pylist(), encoder.batch(part.column(1).to_pylist()), strict=True):
                    docs[count] = (own, ids + tail)
                    n = len(ids) // 4 + 1
                    pieces.append((count, 0, n))
                    held += n
                    count += 1
                if held >= window:
                    yield packed(False)
        yield packed(True)
        del encoder, packer, docs
        release()

    return rows.mapInArrow(run, schema)


def op10(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
