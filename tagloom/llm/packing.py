"""Best-fit packing of token pieces: configuration linear program over the length histogram.

Texts are tokenised and cut in Spark. Only the histogram (at most `capacity` rows) reaches the driver, where the
configuration LP is solved by multiplicative weights with unbounded-knapsack pricing up to a proven gap and rounded
to whole sequences; best fit chooses a pattern's last pieces and packs what is left. The plan, again bounded by the
capacity, goes back to the pieces: ranks inside each length come from salted counts, and numpy looks up each rank's
sequence and place.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_slices, written
from .merge_rounds import MergeTable, merge_rounds

CAPACITY = 4096
END = 1


#: How byte-level tokenizers write the bytes that are no visible Latin-1 characters: as the characters from U+0100 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTER, _STOP, _BREAK, _DIGIT = 1, 2, 3, 4


class WordIds:
    """Ids of texts as the tokenizer gives them. Its splits never hold a space, so each space-free run is encoded once.

    Runs of Latin letters, digits and signs, nearly all of a text, are merged together in numpy with the tokenizer's own
    vocabulary and merges; the tokenizer itself encodes all others.
    """

    def __init__(self, path: str, cache_words: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        shown = {b: chr(b) for b in _VISIBLE} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
        self.inner, self.last = (np.array([ids[shown[b] + x] for b in range(256)], dtype=np.int64) for x in ("", end))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.table = MergeTable(np.array([ids[a] for a, _ in merges]), np.array([ids[b] for _, b in merges]), np.arange(len(merges)), np.array([ids[a + b] for a, b in merges]), size=max(ids.values()) + 1)
        #: By code point below 0x100: the kind, 0 where only the tokenizer itself decides; and the lower case.
        self.kind, self.low = np.zeros(0x110000, dtype=np.int8), np.arange(0x110000, dtype=np.uint32)
        for c in range(0x100):
            self.kind[c] = _LETTER if chr(c).isalpha() and len(chr(c).lower()) == 1 and c not in (0xAA, 0xB5, 0xBA) else _DIGIT if chr(c) in "0123456789" else _BREAK if chr(c) == "\n" else _STOP if 0x20 < c < 0x7F and chr(c) not in "'<" else 0
            self.low[c] = ord(chr(c).lower())
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _merged(self, words: list[str]) -> None:
        """Puts the ids of words without spaces into the young generation."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        own, kind = np.repeat(np.arange(len(words)), sizes), self.kind[codes]
        plain = np.bincount(own[kind == 0], minlength=len(words)) == 0
        for i in np.flatnonzero(~plain):
            self.young[words[i]] = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
        part = np.cumsum(np.r_[True, (own[1:] != own[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)])
        keep = plain[own] & (kind != _BREAK)
        codes, own, part = self.low[codes[keep]], own[keep], part[keep]
        two = codes >= 0x80
        at = np.cumsum(1 + two) - 1
        raw = np.zeros(len(codes) + int(two.sum()), dtype=np.int64)
        raw[at] = np.where(two, 0x80 | (codes & 0x3F), codes)
        raw[at[two] - 1] = 0xC0 | (codes[two] >> 6)
        part, word = np.repeat(part, 1 + two), np.repeat(own, 1 + two)
        ends = np.r_[part[1:] != part[:-1], True][: len(part)]
        of = np.zeros(int(part[-1]) + 1 if len(part) else 0, dtype=np.int64)
        of[part] = word
        sym, part = merge_rounds(self.table, np.where(ends, self.last[raw], self.inner[raw]), part)
        flat = sym.astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(of[part], minlength=len(words)))).tolist()
        for w, good, a, b in zip(words, plain.tolist(), [0, *stops], stops, strict=False):
            if good:
                self.young[w] = flat[a:b]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.split(" ") if t else [] for t in texts]
        words = set().union(*split)
        new = words - self.young.keys()
        if len(self.young) + len(new) > self.cache_words:
            self.old, self.young, new = self.young, {}, words
        for w in new & self.old.keys():
            self.young[w] = self.old[w]
        todo = list(new - self.old.keys())
        for a in range(0, len(todo), 8_000):
            self._merged(todo[a : a + 8_000])
        return [b"".join(map(self.young.__getitem__, ws)) for ws in split]


_held: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _held:
        _held[path] = WordIds(path)
    return _held[path]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the end id, cut every `capacity` ids.

    Null and empty texts hold the end id alone. Repeated rows each give their pieces.
    """
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for doc, ids in zip(batch.column("doc_id").to_pylist(), word_ids(tokenizer).many(batch.column("text").to_pylist()), strict=True):
            ids += tail
            out.extend((doc, i, a // 4, len(x) // 4, zlib.crc32(x)) for i, a in enumerate(range(0, len(ids), 4 * capacity)) for x in (ids[a : a + 4 * capacity],))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return map_slices(docs.select(docs["doc_id"].cast("long"), "text"), run, _PIECES)


@dataclass
class Plan:
    """For each length, consecutive rank ranges: ranks from `rank` on go to sequences from `base` on, `each` to a sequence, at `offsets`."""

    length: np.ndarray
    rank: np.ndarray
    base: np.ndarray
    each: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of the given lengths and ranks (from 0) in their length."""
        wide = np.int64(1) << 44
        at = np.searchsorted(self.length * wide + self.rank, length * wide + rank, side="right") - 1
        inside = rank - self.rank[at]
        return self.base[at] + inside // self.each[at], self.offset[self.first[at] + inside % self.each[at]]


def _priced(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Knapsack by dynamic programming: how many of each size (any number) fill the capacity at the highest value, and that value."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        gain = value[: fits[c]] + best[c - sizes[: fits[c]]]
        took[c] = gain.argmax()
        best[c] = gain[took[c]]
    counts, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0 and took[c] >= 0:
        counts[took[c]] += 1
        c -= int(sizes[took[c]])
    return counts, float(best[capacity])


def _from_here_on(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x[::-1])[::-1]


def fractional(sizes: np.ndarray, need: np.ndarray, capacity: int, gap: float = 0.05) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Patterns and how often each is used in a solution of the configuration program, and a lower bound of its value.

    A slot may hold a smaller piece, so that the program asks, for each size, that the slots of that size or more be
    at least the pieces of that size or more. Multiplicative weights: each turn prices the pattern worth most under
    weights that fall exponentially with a demand's cover, and uses it until no demand is covered by more than
    `width` more; the weights of a turn over its pattern's worth bound the value from below. It ends when the
    solution, scaled to cover every demand, is within `gap` of the best bound, halving the width where a whole pass
    (of cover ln m / width) doesn't get there.
    """
    demand, bound, width = _from_here_on(need), 0.0, 0.5
    while True:
        cover, used, turns, reached = np.zeros(len(sizes)), {}, 0, False
        while not reached and cover.min() < np.log(len(sizes) + 1) / width:
            weight = np.exp(cover.min() - cover) / demand
            pattern, worth = _priced(np.cumsum(weight), sizes, capacity)
            bound = max(bound, float(weight @ demand) / worth)
            held = _from_here_on(pattern) / demand
            times = width / held.max()
            cover += times * held
            used[pattern.tobytes()] = used.get(pattern.tobytes(), 0.0) + times
            turns += 1
            reached = turns % 50 == 0 and cover.min() > 0 and sum(used.values()) <= cover.min() * bound * (1 + gap)
        if sum(used.values()) <= cover.min() * bound * (1 + gap):
            return [(np.frombuffer(k, dtype=np.int64), t / float(cover.min())) for k, t in used.items()], bound
        width /= 2


def _filled(lengths: np.ndarray, left: np.ndarray, capacity: int, slots: list[int]) -> np.ndarray:
    """How many pieces of each length go to one sequence: for each slot (a largest length's index) the longest that is left
    and fits, then the longest that fit what room remains."""
    full, room = np.zeros(len(lengths), dtype=np.int64), capacity
    for slot in (*slots, *([len(lengths) - 1] * capacity)):
        most = min(slot, int(np.searchsorted(lengths, room, side="right")) - 1)
        fits = np.flatnonzero(left[: most + 1] > full[: most + 1])
        if len(fits):
            full[fits[-1]] += 1
            room -= int(lengths[fits[-1]])
        elif most == len(lengths) - 1 or slot == len(lengths) - 1:
            break
    return full


def patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, bins: int = 256) -> list[tuple[np.ndarray, int, bool]]:
    """(how many of each length, how often, whether the program chose it) of patterns that use up the counts.

    The program works on lengths rounded up to one of `bins` sizes. Its patterns are rounded one after another, each
    to what keeps their sum rounded down. A pattern's slots take the longest pieces left for them, but for the last:
    best fit fills the room that rounding up lengths left. A pattern is used as often as its lengths last, then with
    the next shorter ones. Best fit packs what no pattern took.
    """
    left, out = counts.astype(np.int64).copy(), []

    def use(full: np.ndarray, most: int | None, chosen: bool) -> int:
        held = full > 0
        times = int((left[held] // full[held]).min())
        times = times if most is None else min(times, most)
        left[held] -= full[held] * times
        out.append((full, times, chosen))
        return times

    short = lengths < capacity
    if short.any():
        unit = max(1, capacity // bins)
        sizes, of = np.unique(-(-lengths[short] // unit), return_inverse=True)
        found, _ = fractional(sizes, np.bincount(of, weights=counts[short]), capacity // unit)
        largest = np.searchsorted(lengths, sizes * unit, side="right") - 1
        found.sort(key=lambda x: x[0][::-1].tolist(), reverse=True)
        whole = np.diff(np.floor(np.cumsum([0.0, *(t for _, t in found)]) + 1e-9)).astype(int)
        for (pattern, _), times in zip(found, whole.tolist(), strict=True):
            slots = [int(largest[i]) for i in np.flatnonzero(pattern)[::-1] for _ in range(pattern[i])]
            while times > 0 and (left[short] > 0).any():
                times -= use(_filled(lengths, np.where(short, left, 0), capacity, slots[:-1]), times, True)
    while (left > 0).any():
        use(_filled(lengths, left, capacity, []), None, False)
    return out


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Sequences for `counts[i]` pieces of `lengths[i]` (ascending), none over the capacity, by patterns()."""
    rows, offsets, base = [], [], 0
    given = np.zeros(len(lengths), dtype=np.int64)
    for full, times, _ in patterns(lengths, counts, capacity) if len(lengths) else ():
        place = 0
        for i in np.flatnonzero(full).tolist():
            k, n = int(full[i]), int(lengths[i])
            rows.append((n, int(given[i]), base, k, len(offsets)))
            offsets.extend(range(place, place + k * n, n))
            place += k * n
            given[i] += k * times
        base += times
    columns = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, np.array(offsets, dtype=np.int64), base)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, part_rows: int = 500_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece in one of as few sequences as found.

    Null texts count as empty and hold the end id alone; copies are packed one by one; an empty table gives no rows.
    A piece of `capacity` ids is a sequence of its own, numbered below 0, and takes no part in the rest. The pieces of
    a length are ranked in parts of about `part_rows`, or of a 512th of all pieces if that is less, so that a common
    length is no single task. The driver holds the histogram, the counts of those parts and the plan, and no documents.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, end).withColumn("spread", F.xxhash64(F.monotonically_increasing_id())), "packing-pieces")
    shorter = cut.filter(F.col("length") < capacity)
    total = {r["length"]: r["count"] for r in shorter.groupBy("length").count().collect()}
    lengths = np.array(sorted(total), dtype=np.int64)
    found = spark.sparkContext.broadcast(plan(lengths, np.array([total[x] for x in lengths.tolist()], dtype=np.int64), capacity))
    part = max(1, min(part_rows, sum(total.values()) // 512))
    parts = spark.createDataFrame([(x, -(-n // part)) for x, n in total.items()], "length long, parts long")
    salted = shorter.join(F.broadcast(parts), "length").withColumn("salt", F.pmod("spread", F.col("parts")))
    before: list[tuple[int, int, int]] = []
    given = dict.fromkeys(total, 0)
    for r in sorted(salted.groupBy("length", "salt").count().collect()):
        before.append((r["length"], r["salt"], given[r["length"]]))
        given[r["length"]] += r["count"]
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    ranked = ranked.join(spark.createDataFrame(before, "length long, salt long, before long"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") - 1 + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = found.value.place(*(batch.column(c).to_numpy() for c in ("length", "rank")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    placed = ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    own = cut.filter(F.col("length") == capacity).select(*cut.columns[:5], (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.union(own)
