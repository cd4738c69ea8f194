"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The texts of a slice are cut where no piece of the vocabulary can reach across: letters that stand side by side in some piece are of one
class, and a word is spaces with a run of one class behind. Distinct words that aren't known yet lie in one flat NumPy array of symbols and are
merged together, round by round:

1. the segmented minimum gives each word the best rank of its pairs;
2. all pairs of that rank are merged at once, leftmost first where they overlap, up to the first merge that makes a pair of the
   same or a better rank, since that one would come next. So the order is that of one merge at a time;
3. the array is compacted, only pairs beside merged symbols are looked up again, and words without pairs leave it.

Symbols that are no piece become the pieces of their UTF-8 bytes. Decoding gathers the bytes of all ids of a slice at once, drops the space
in front, and replaces bytes that aren't UTF-8. The model file is read, never changed; models with other than normal, byte,
unknown and control pieces or with a normalizer besides the dummy prefix are an error.

A null text counts as empty, and an empty text has only the end id and decodes to an empty one. Repeated rows are encoded each,
rows with a null id too. A very long text is one more text. An empty table gives an empty result. Other columns are ignored, whatever
their names. The work is map-only, and a worker keeps at most two generations of `KEPT` words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices, table, text_or_empty, type_of

SPACE = "▁"
KEPT = 200_000
NONE = np.iinfo(np.int64).max


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Blob:
    """A byte string for every id, put together for many ids at once."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts], np.int64)
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes

    def gather(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings of all ids as one, and where each begins (and the last ends)."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.concatenate([np.zeros(1, np.int64), ends])
        take = np.repeat(self.starts[ids] - at[:-1], sizes) + np.arange(at[-1])
        return self.bytes[take].tobytes(), at


def classes(pieces: Iterable[str]) -> dict[str, str]:
    """Letters that pieces hold side by side, with a letter that stands for their class; the space sign is left out."""
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for piece in pieces:
        own = piece.lstrip(SPACE)
        if own and len(piece) > 1:
            for c in own:
                root[find(c)] = find(own[0])
    return {c: find(c) for c in root}


class PieceModel:
    """Encodes and decodes as the library does with this model."""

    def __init__(self, file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(file, "rb") as f:
            model.ParseFromString(f.read())
        kind, norm = pb.ModelProto.SentencePiece, model.normalizer_spec
        types = [p.type for p in model.pieces]
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not set(types) <= {kind.NORMAL, kind.BYTE, kind.UNKNOWN, kind.CONTROL}:
            raise ValueError("only BPE models of normal, byte, unknown and control pieces")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces) or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with a dummy prefix, byte fallback and no other normalizer")
        self.end = types_of(model.pieces, "</s>")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece holds a space behind a letter")
        surface = {kind.CONTROL: lambda p: b"", kind.UNKNOWN: lambda p: model.trainer_spec.unk_surface.encode(), kind.BYTE: lambda p: bytes([int(p.piece[3:5], 16)]), kind.NORMAL: lambda p: p.piece.replace(SPACE, " ").encode()}
        self.surfaces = Blob([surface[p.type](p) for p in model.pieces])
        self.decimals = Blob([f"{i} ".encode() for i in range(len(model.pieces))])
        self.is_byte = np.array([t == kind.BYTE for t in types])
        self.is_normal = np.array([t == kind.NORMAL for t in types])
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        scores = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.symbols = dict(normal)
        for piece in normal:
            for c in piece:  # letters that are no pieces of their own can still be merged
                self.symbols.setdefault(c, len(model.pieces) + len(self.symbols))
        pairs = {}
        for piece, number in normal.items():
            for k in range(1, len(piece)):
                if (a := self.symbols.get(piece[:k])) is not None and (b := self.symbols.get(piece[k:])) is not None:
                    pairs[a << 32 | b] = (order[scores[piece]], number)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.by_code = np.full(0x110000, -1, np.int64)
        for s, number in self.symbols.items():
            if len(s) == 1:
                self.by_code[ord(s)] = number
        self.base = max(self.symbols.values()) + 1  # letters that stand in no piece: their code points from here on
        self.letters = {number: s for s, number in self.symbols.items() if len(s) == 1}
        self.words_in = self.word_pattern(normal, scores).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def word_pattern(normal: dict[str, int], scores: dict[str, float]) -> re.Pattern:
        """Words of a text whose spaces are ASCII ones: where two of them meet no piece reaches across."""
        groups: dict[str, list[str]] = {}
        for c, top in classes(normal).items():
            groups.setdefault(top, []).append(c)
        sets = ["".join(re.escape(c) for c in sorted(own)) for own in sorted(groups.values(), key=len, reverse=True)]
        words = "|".join([f" *[{s}]+" for s in sets] + [" +", f"[^ {''.join(sets)}]+" if sets else "[^ ]+"])
        # Pieces of spaces alone, all of one score below all others: spaces are merged last and from the left, so full pieces are cut off.
        blank = [len(p) for p in normal if len(p) > 1 and not p.strip(SPACE)]
        lowest = min(scores.values())
        if blank and sorted(blank) == list(range(2, max(blank) + 1)) and {p for p in scores if scores[p] == lowest} == {SPACE * n for n in blank}:
            words = f" {{{max(blank)}}}(?= )|{words}"
        return re.compile(words)

    def ranked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; rank NONE for those that aren't merged."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def merged(self, words: list[str]) -> list[np.ndarray]:
        """The symbols of words (not empty, with the space sign) after all merges."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        symbol = self.by_code[codes]
        symbol = np.where(symbol < 0, codes + self.base, symbol)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        rank, made = self.ranked(symbol, np.append(symbol[1:], 0))
        rank[np.append(word[1:] != word[:-1], True)] = NONE
        out: list = [None] * len(words)
        while len(symbol):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[word[starts[k]]] = symbol[starts[k] : starts[k] + sizes[k]]
                stays = np.repeat(~done, sizes)
                symbol, word, rank, made = symbol[stays], word[stays], rank[stays], made[stays]
                best, sizes = best[~done], sizes[~done]
                if not len(symbol):
                    break
            own = np.repeat(np.arange(len(best)), sizes)
            at = np.flatnonzero(rank == best[own])
            # Of pairs that overlap, every second one of their run.
            head = np.append(True, np.diff(at) != 1)
            run = np.flatnonzero(head)[np.cumsum(head) - 1]
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            # New pairs to the left (perhaps with what was merged just before) and to the right.
            x, goal = made[at], best[own[at]]
            beside = np.append(False, np.diff(at) == 2)
            left = np.where(beside, np.roll(x, 1), symbol[np.maximum(at - 1, 0)])
            next_ = np.minimum(at + 2, len(symbol) - 1)
            before = np.where((at > 0) & (word[np.maximum(at - 1, 0)] == word[at]), self.ranked(left, x)[0], NONE)
            behind = np.where((at + 2 < len(symbol)) & (word[next_] == word[at]), self.ranked(x, symbol[next_])[0], NONE)
            stop = np.minimum(before, behind) <= goal
            # Merges of a word up to the first one that makes a pair as good.
            group = own[at]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            stops = np.cumsum(stop) - stop
            at = at[stops == np.repeat(stops[first], np.diff(np.append(first, len(at))))]
            symbol[at] = made[at]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            changed = np.zeros(len(symbol), bool)
            changed[at] = True
            symbol, word, rank, made, changed = symbol[stays], word[stays], rank[stays], made[stays], changed[stays]
            again = np.flatnonzero(changed | np.append(changed[1:], False))
            follow = np.minimum(again + 1, len(symbol) - 1)
            found, result = self.ranked(symbol[again], symbol[follow])
            rank[again] = np.where((again + 1 < len(symbol)) & (word[follow] == word[again]), found, NONE)
            made[again] = result
        return out

    def ids_of(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols as ids, those that are no pieces as bytes."""
        if (symbols < len(self.is_normal)).all():
            return symbols.astype("<i4")
        out: list[int] = []
        for s in symbols.tolist():
            if s < len(self.is_normal):
                out.append(s)
            else:
                out += [self.byte_ids[b] for b in (self.letters[s] if s < self.base else chr(s - self.base)).encode()]
        return np.array(out, "<i4")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of texts as little-endian 32-bit numbers, without an end id."""
        split = [self.words_in(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.known) > KEPT:
            self.known, self.older = {}, self.known
        fresh = []
        for w in set().union(*split):
            if w not in self.known:
                if (old := self.older.get(w)) is None:
                    fresh.append(w)
                else:
                    self.known[w] = old
        if fresh:
            for w, symbols in zip(fresh, self.merged([w.replace(" ", SPACE) for w in fresh]), strict=True):
                self.known[w] = self.ids_of(symbols).tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The texts of ids, as UTF-8."""
        if not ids:
            return []
        flat = np.concatenate(ids)
        joined, at = self.surfaces.gather(flat)
        edge = at[np.concatenate([[0], np.cumsum([len(x) for x in ids])])]
        out = []
        for own, a, b in zip(ids, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            text = joined[a:b]
            parted = (self.surfaces.sizes[own[1:-1]] == 0) & self.is_byte[own[:-2]]  # a control piece ends a run of bytes
            try:
                text.decode()
                whole = not parted.any()
            except UnicodeDecodeError:
                whole = False
            if not whole:
                text = self.mended(own)
            shown = own[self.surfaces.sizes[own] > 0]
            if len(shown) and self.is_normal[shown[0]] and text.startswith(b" "):
                text = text[1:]
            out.append(text)
        return out

    def mended(self, ids: np.ndarray) -> bytes:
        """The text of ids with the replacement sign for each byte that begins no UTF-8 letter of its run of bytes."""
        out, run = [], b""

        def flush(run: bytes) -> None:
            while run:
                for n in range(1, 5):
                    try:
                        run[:n].decode()
                    except UnicodeDecodeError:
                        continue
                    out.append(run[:n])
                    break
                else:
                    out.append("�".encode())
                    n = 1
                run = run[n:]

        for i in ids.tolist():
            own = self.surfaces.bytes[self.surfaces.starts[i] : self.surfaces.starts[i] + self.surfaces.sizes[i]].tobytes()
            if self.is_byte[i]:
                run += own
                continue
            flush(run)
            run = b""
            out.append(own)
        flush(run)
        return b"".join(out)


def types_of(pieces, name: str) -> int:
    """The id of a piece by its name."""
    return next(i for i, p in enumerate(pieces) if p.piece == name)


def encoded(df: DataFrame, model: str | None = None, text: str = "text", doc_id: str = "doc_id", end: bool = True) -> DataFrame:
    """(doc_id, ids)."""
    file = model or default_model()

    def start() -> Callable[[dict], dict]:
        own = PieceModel(file)
        tail = np.array([own.end] * end, "<i4").tobytes()

        def kernel(cols: dict[str, pa.Array]) -> dict:
            rows = [x + tail for x in own.encode(cols["text"].to_pylist())]
            offsets = np.cumsum([0] + [len(x) // 4 for x in rows])
            return {"doc_id": cols["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))}

        return kernel

    return map_slices(text_or_empty(df, doc_id, text=text).toDF("doc_id", "text"), start, f"doc_id {type_of(df, doc_id)}, ids array<int>")


def decoded(df: DataFrame, model: str | None = None, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give an empty text."""
    file = model or default_model()

    def start() -> Callable[[dict], dict]:
        own = PieceModel(file)

        def kernel(cols: dict[str, pa.Array]) -> dict:
            rows = [np.array(x or [], np.int64) for x in cols["ids"].to_pylist()]
            return {"doc_id": cols["doc_id"], "text": pa.array([t.decode() for t in own.decode(rows)], pa.string())}

        return kernel

    return map_slices(df.select(df[doc_id].alias("doc_id"), df[ids].alias("ids")), start, f"doc_id {type_of(df, doc_id)}, text string")


def round_trip(df: DataFrame, model: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): texts encoded with an end id, and those ids decoded."""
    file = model or default_model()

    def start() -> Callable[[dict], dict]:
        own = PieceModel(file)
        tail = np.array([own.end], "<i4").tobytes()

        def kernel(cols: dict[str, pa.Array]) -> dict:
            rows = [np.frombuffer(x + tail, "<i4") for x in own.encode(cols["text"].to_pylist())]
            digits, at = own.decimals.gather(np.concatenate(rows))
            edge = at[np.cumsum([0] + [len(x) for x in rows])].tolist()
            return {
                "doc_id": cols["doc_id"],
                "n_tokens": [len(x) for x in rows],
                "ids_sha256": [hashlib.sha256(digits[a : b - 1]).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)],
                "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in own.decode(rows)],
            }

        return kernel

    return map_slices(text_or_empty(df, doc_id, text=text).toDF("doc_id", "text"), start, f"doc_id {type_of(df, doc_id)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))
