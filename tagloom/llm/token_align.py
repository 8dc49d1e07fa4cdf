"""Alignment of two tokenizers' tokens of one text, and how many documents link two token ids.

The byte offsets where tokens end are two sorted lists. Their merge is cut by merge-path partitioning: a binary
search on each diagonal finds how much of both lists lies before it, so that pieces of equal work are merged
independently, all pieces of a batch side by side in numpy. Each step of a piece that consumes a new offset emits the pair of tokens that
overlap there; counts of common offsets before each piece stitch groups that cross pieces.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from tokenizers import Tokenizer

from .common import discard, map_slices, written

#: Offsets that a piece merges; pairs of ids whose counts are sent to the tasks at once.
PIECE, BLOCK_PAIRS = 512, 1_000_000
#: A pair of ids as one number: the A id times this, plus the B id.
STRIDE = 1 << 31

_SPACE = "▁"
_LONG_GAP = re.compile(r"\s{1000}")


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of byte-level entries: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Byte-level BPE of a tokenizers file, with the bytes of each id.

    The ranks of the vocabulary give the merges' results wherever ids ascend in merge order and every entry merges to
    itself, which a test checks; texts with very long runs of white space go through the file's own tokenizer.
    """

    def __init__(self, path: str, pattern: str):
        alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        special = {x["content"] for x in parts["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in s): i for s, i in parts["model"]["vocab"].items() if s not in special}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes[i] = raw
        self.sizes = np.array([len(x) for x in self.bytes], dtype=np.int64)
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        if _LONG_GAP.search(text):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceTokens:
    """Pieces of a sentencepiece model, with the bytes of each id."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(x) for x in self.bytes], dtype=np.int64)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, group) of every overlap of tokens i and j whose ends are the ascending offsets a and b, in order.

    Both lists end at the same offset; a group is a run of tokens between two common ends.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return (np.zeros(0, dtype=np.int64),) * 3
    # Diagonals: the split (i, d - i) takes all offsets of a that are at most those of b behind it.
    diagonal = np.arange(0, n + m, piece)
    low, high = np.maximum(0, diagonal - m), np.minimum(diagonal, n)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        take = open_ & (a[np.minimum(middle, n - 1)] <= b[np.clip(diagonal - middle - 1, 0, m - 1)])
        low, high = np.where(take, middle + 1, low), np.where(open_ & ~take, middle, high)
    i, j = low.copy(), diagonal - low
    stop = np.minimum(diagonal + piece, n + m)
    end = np.iinfo(np.int64).max
    a_, b_ = np.append(a, end), np.append(b, end)
    left, right = np.zeros((2, len(diagonal), piece), dtype=np.int64)
    emits, common = np.zeros((2, len(diagonal), piece), dtype=bool)
    for step in range(piece):
        live = diagonal + step < stop
        x, y = a_[i], b_[j]
        first = x <= y
        again = ~first & (i > 0) & (a_[i - 1] == y)
        left[:, step], right[:, step] = i, j
        emits[:, step], common[:, step] = live & ~again, live & first & (x == y)
        i, j = i + (live & first), j + (live & ~first)
    inside = np.cumsum(common, axis=1) - common
    before = np.concatenate([[0], np.cumsum(common.sum(1))[:-1]])
    return left[emits], right[emits], (inside + before[:, None])[emits]


class Aligner:
    def __init__(self, byte_file: str, piece_file: str, pattern: str):
        self.a, self.b = ByteTokens(byte_file, pattern), PieceTokens(piece_file)
        self.text = {(k, s): np.array([f"{x}{s}" for x in range(len(t.bytes))], dtype=object) for k, t in (("a", self.a), ("b", self.b)) for s in ",|;"}

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Both tokenizers' ids; none if either's bytes differ from a space and the text."""
        if not text:
            return [], []
        raw = f" {text}"
        want, own = raw.encode(), (self.a.encode(raw), self.b.encode(text))
        same = all(b"".join([t.bytes[x] for x in ids]) == want for t, ids in zip((self.a, self.b), own, strict=True))
        return own if same else ([], [])

    def align(self, texts: Sequence[str | None]) -> dict[str, list]:
        """Columns for the texts: counts, the groups' text, and distinct linked id pairs with their number of links."""
        both = [self.tokens(t) for t in texts]
        n_a, n_b = (np.array([len(x[k]) for x in both], dtype=np.int64) for k in (0, 1))
        ids_a, ids_b = (np.fromiter((y for x in both for y in x[k]), dtype=np.int64, count=int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
        i, j, group = merge_path(np.cumsum(self.a.sizes[ids_a]), np.cumsum(self.b.sizes[ids_b]))
        doc = np.repeat(np.arange(len(texts)), n_a)
        n_links = np.bincount(doc[i], minlength=len(texts))
        # The group of each token, and of each group its first tokens and its document.
        group_a, group_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        group_a[i], group_b[j] = group, group
        groups = int(group[-1]) + 1 if len(group) else 0
        first_a, first_b = np.searchsorted(group_a, np.arange(groups + 1)), np.searchsorted(group_b, np.arange(groups + 1))
        n_groups = np.bincount(doc[first_a[:-1]], minlength=len(texts))
        shown = np.empty(len(ids_a) + len(ids_b), dtype=object)
        place_a, place_b = np.arange(len(ids_a)) + first_b[group_a], np.arange(len(ids_b)) + first_a[group_b + 1]
        shown[place_a], shown[place_b] = self.text["a", ","][ids_a], self.text["b", ","][ids_b]
        last_a, last_b = first_a[1:] - 1, first_b[1:] - 1
        shown[place_a[last_a]], shown[place_b[last_b]] = self.text["a", "|"][ids_a[last_a]], self.text["b", ";"][ids_b[last_b]]
        # Distinct pairs of each document.
        pair = ids_a[i] * STRIDE + ids_b[j]
        by = np.lexsort((pair, doc[i]))
        pair, own = pair[by], doc[i][by]
        new = np.ones(len(pair), dtype=bool)
        new[1:] = (pair[1:] != pair[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(pair)))
        ends = np.cumsum(np.bincount(own[at], minlength=len(texts)))
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        upto = np.cumsum(n_a + n_b)
        texts_shown = ["".join(shown[s:e].tolist())[:-1] for s, e in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)] if len(texts) else []
        return {
            "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups), "n_links": pa.array(n_links), "groups": texts_shown,
            "pairs": pa.ListArray.from_arrays(offsets, pa.array(pair[at])), "times": pa.ListArray.from_arrays(offsets, pa.array(times)),
        }


_held: dict[tuple[str, str, str], Aligner] = {}


def aligner(*files: str) -> Aligner:
    """The worker's aligner of two tokenizer files."""
    if files not in _held:
        _held[files] = Aligner(*files)
    return _held[files]


_COUNTS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64())]
_LINKS = [("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]


def groups(docs: DataFrame, byte_file: str, piece_file: str, pattern: str, hashed: bool = True) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times): each text's aligned groups as `a1,a2|b1;a3|b2`, or
    their sha256 ('' without tokens), and its distinct linked id pairs with how often each is linked."""
    schema = pa.schema([("doc_id", pa.int64()), *_COUNTS, ("groups", pa.string()), *_LINKS])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = aligner(byte_file, piece_file, pattern).align(batch.column("text").to_pylist())
        shown = [hashlib.sha256(g.encode()).hexdigest() if g and hashed else g for g in made["groups"]]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(shown, pa.string()) if f.name == "groups" else made[f.name] for f in list(schema)[1:])], schema=schema)

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n_docs, best): how many documents link two ids, and whether no other pair of the A id has more.

    An A id has no more pairs than the B tokenizer has ids.
    """
    n = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    most = F.max("n_docs").over(Window.partitionBy(F.floor(F.col("pair") / STRIDE)))
    return n.select("pair", "n_docs", (F.col("n_docs") == most).alias("best"))


def aligned(docs: DataFrame, byte_file: str, piece_file: str, pattern: str, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text.

    Null and empty texts, and those that a tokenizer doesn't give back byte by byte, have no tokens: zeros and an empty
    digest. Repeated rows are documents of their own, each with a row and counted each time, without a doc_id too. An
    empty table gives no rows. Counts of pairs go to the tasks in blocks of `block_pairs`, one after the other. Other
    columns are not read.
    """
    found = written(groups(docs, byte_file, piece_file, pattern), "token-links")
    counts = written(pair_counts(found), "pair-counts")
    blocks = max(1, -(-counts.count() // block_pairs))
    block = counts.withColumn("block", F.pmod(F.xxhash64("pair"), F.lit(blocks)))
    zero = F.lit(0).cast("long")
    at = found.select("doc_id", *(n for n, _ in _COUNTS), F.col("groups").alias("groups_sha256"), "pairs", "times", zero.alias("n_best"), zero.alias("count_sum"))
    kept = [("doc_id", pa.int64()), *_COUNTS, ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())]
    for i in range(blocks):
        own = block.filter(F.col("block") == i).select("pair", "n_docs", "best").orderBy("pair").toArrow()
        sent = docs.sparkSession.sparkContext.broadcast(tuple(own.column(c).to_numpy() for c in ("pair", "n_docs", "best")))
        schema = pa.schema(kept if i == blocks - 1 else kept + _LINKS)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, schema=schema) -> Iterator[pa.RecordBatch]:
            known, n_docs, best = sent.value
            for batch in batches:
                pairs, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
                row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("pairs").offsets.to_numpy()))
                place = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
                here = known[place] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
                place, row, times = place[here], row[here], times[here]
                sums = {}
                for name, each in (("count_sum", n_docs[place] * times if len(known) else times), ("n_best", best[place] * times if len(known) else times)):
                    total = np.zeros(batch.num_rows, dtype=np.int64)
                    np.add.at(total, row, each)
                    sums[name] = pa.array(total + batch.column(name).to_numpy())
                yield pa.RecordBatch.from_arrays([sums[f.name] if f.name in sums else batch.column(f.name) for f in schema], schema=schema)

        at = at.mapInArrow(run, from_arrow_schema(schema))
    discard(counts)
    return at
