"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Words are flattened to numpy symbol arrays. In each round every word takes the lowest rank among its neighbouring
pairs (a segmented minimum), all leftmost non-overlapping places of that rank merge at once, and the arrays are
compacted; words without a mergeable pair leave. Only the vocabulary and its scores come from the model file.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_slices
from .merge_rounds import MergeTable, merge_rounds

SPACE = "▁"
_WORD = re.compile(r"(?:^| )( *[^ ]+| *$)")


class PieceCodec:
    """Encoder and decoder over the pieces of one model file."""

    def __init__(self, model: str, cache_words: int = 200_000):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.kind_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.hidden = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kind_byte[i]}
        plain = {p: i for i, p in enumerate(self.pieces) if not (self.kind_byte[i] or i in self.hidden or i == self.unknown)}
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("a piece crosses a word start; words can't be encoded alone")
        self.char_id = np.full(0x110000, -1, dtype=np.int64)
        for p, i in plain.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        counts = np.bincount(rank)
        pairs = sorted((plain[p[:j]] * n + plain[p[j:]], int(rank[i]), i) for p, i in plain.items() for j in range(1, len(p)) if p[:j] in plain and p[j:] in plain)
        self.size = n
        left, right = ([x[0] // n for x in pairs], [x[0] % n for x in pairs])
        self.table = MergeTable(*(np.array(c, dtype=np.int64) for c in (left, right, [x[1] for x in pairs], [x[2] for x in pairs])), size=n, tied=counts > 1)
        self.tied = counts > 1
        for c in range(128):  # one byte each, which no piece joins
            if self.char_id[c] < 0 and c in self.byte_id:
                self.char_id[c] = self.byte_id[c]
        self.id_text = list(map(str, range(n)))
        own = {i: chr(b) for b, i in self.byte_id.items() if b < 128}
        self.surface = [own[i] if i in own else None if self.kind_byte[i] or i in self.hidden or i == self.unknown else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        #: Ids of words met lately, joined by commas, in two generations; and the decoding of those that don't decode to themselves.
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.cache_words = cache_words

    def _flat_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
        """(ids of all words in order, ids in each word, what the ids past the vocabulary stand for)."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        own = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        sym = self.char_id[codes]
        other, index = np.unique(codes[sym < 0], return_inverse=True)
        sym[sym < 0] = self.size + index
        unknown = {self.size + i: [self.byte_id[b] for b in chr(c).encode()] if self.byte_id else [self.unknown] for i, c in enumerate(other.tolist())}
        sym, own = merge_rounds(self.table, sym, own)
        return sym, np.bincount(own, minlength=len(words)), unknown

    def encode_words(self, words: Sequence[str]) -> list[list[int]]:
        """The ids of each word; a word starts with its spaces, written as the space mark."""
        flat, sizes, unknown = self._flat_words(words)
        ids, ends = flat.tolist(), np.cumsum(sizes).tolist()
        out = [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return [[y for x in w for y in unknown.get(x, (x,))] for w in out] if unknown else out

    def words(self, text: str) -> list[str]:
        """Splits before each space that follows another character; a space that starts a word is left out."""
        text = text.replace(SPACE, " ")
        return text.split(" ") if "  " not in text and not text.startswith(" ") else _WORD.findall(text)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for ids in self.encode_words([SPACE + w.replace(" ", SPACE) for w in self.words(text)]) for i in ids]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of the ids: byte pieces that follow one another are read as UTF-8, bad bytes as U+FFFD each."""
        out, held = [], bytearray()
        started = False
        for i in ids:
            if self.kind_byte[i]:
                held += bytes([int(self.pieces[i][3:5], 16)])
                started = True
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i in self.hidden:
                continue
            piece = " ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " ")
            if not started and i != self.unknown and piece.startswith(" "):
                piece = piece[1:]
            out.append(piece)
            started = True
        if held:
            out.append(_utf8(bytes(held)))
        return "".join(out)

    def _learn(self, words: set[str]) -> None:
        """Puts the ids of words not met lately into the young generation."""
        new = words - self.young.keys()
        if len(self.young) + len(new) > self.cache_words:
            self.old, self.young, new = self.young, {}, words
            self.odd = {w: x for w, x in self.odd.items() if w in self.old}
        for w in new & self.old.keys():
            self.young[w] = self.old[w]
        todo = list(new - self.old.keys())
        for a in range(0, len(todo), 20_000):
            part = todo[a : a + 20_000]
            flat, sizes, unknown = self._flat_words([SPACE + w.replace(" ", SPACE) for w in part])
            ids, ends = flat.tolist(), np.cumsum(sizes).tolist()
            for w, i, j in zip(part, [0, *ends], ends, strict=False):
                own = ids[i:j]
                try:
                    self.young[w] = ",".join([self.id_text[x] for x in own])
                    text = "".join([self.surface[x] for x in own])[1:]
                except (IndexError, TypeError):
                    own = [y for x in own for y in unknown.get(x, (x,))]
                    self.young[w] = ",".join(map(str, own))
                    text = self.decode(own)
                if text != w:
                    self.odd[w] = text

    def digests(self, texts: Sequence[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text; each distinct word is worked on once."""
        split = [self.words(t) if t else [] for t in texts]
        self._learn(set().union(*split))
        find, out = self.young.__getitem__, []
        for ws in split:
            ids = ",".join(map(find, ws))
            out.append((ids.count(",") + bool(ws), ids, " ".join([self.odd.get(w, w) for w in ws] if self.odd else ws)))
        return out


def _utf8(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_held: dict[str, PieceCodec] = {}


def codec(model: str) -> PieceCodec:
    """The worker's codec for a model file."""
    return _held.setdefault(model, PieceCodec(model)) if model not in _held else _held[model]


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every text. Null and empty texts have no ids; repeated rows each give a row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [codec(model).encode(t or "") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int32()))], schema=_ENCODED)

    return map_slices(docs.select(docs["doc_id"].cast("long"), "text"), run, _ENCODED)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids). Null ids give an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([codec(model).decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], schema=schema)

    return encoded.select(encoded["doc_id"].cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def encode_digest(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids of each text and of their decoding.

    Null and empty texts have no ids and decode to an empty text; no text is cut; repeated rows each give a row.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = codec(model).digests(batch.column("text").to_pylist())
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([sha(x[1]) for x in found]), pa.array([sha(x[2]) for x in found])], schema=_DIGEST)

    return map_slices(docs.select(docs["doc_id"].cast("long"), "text"), run, _DIGEST)
