"""Benchmark decontamination: windows of benchmark words sought in every text by Wu-Manber's multi-pattern search.

Windows of one length are the patterns, words the symbols, and two words a block. A shift table says, for each block
under the end of the search window, how far no pattern can end; where it says nothing the block is some pattern's
suffix, and the patterns of that suffix and of the block at the start are compared word by word. Searches run in numpy,
one lane for every 256 words of a batch. Patterns go to the tasks in blocks of bounded size, one after the other,
so that any number of benchmarks is sought without a shuffle of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_slices, written

WINDOW = 10
#: Bytes of patterns that are sent to the tasks at once, words of a lane, entries of a shift table, comparisons at once.
BLOCK_BYTES, LANE, SHIFTS, AT_ONCE = 16_000_000, 256, 1 << 20, 500_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """The words of a text in lower case: runs of digits, letters a to z and everything beyond ASCII, in UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


class Patterns:
    """Shift tables and suffix buckets of the patterns of one length."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray):
        self.length, self.block = ids.shape[1], min(2, ids.shape[1])
        m = self.length
        self.shift = np.full(SHIFTS, m - self.block + 1, dtype=np.int16)
        for end in range(self.block, m + 1):
            np.minimum.at(self.shift, self._slot(*self._pair(ids, end - 1)), np.int16(m - end))
        key = self._bucket(*self._pair(ids, m - 1), *self._pair(ids, self.block - 1))
        by = np.argsort(key, kind="stable")
        self.key, self.ids, self.numbers = key[by], ids[by], numbers[by]

    def _pair(self, ids: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        return ids[:, at - self.block + 1], ids[:, at]

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (((a.astype(np.uint64) << np.uint64(32)) ^ b.astype(np.uint64)) * _MIX >> np.uint64(44)).astype(np.int64)

    @staticmethod
    def _bucket(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) ^ b.astype(np.uint64)
        return (key * _MIX) ^ (((c.astype(np.uint64) << np.uint64(32)) ^ d.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern number) of every occurrence in a run of word ids; an id of 0 is in no pattern."""
        m, b = self.length, self.block
        end = np.minimum(np.arange(LANE, len(text) + LANE, LANE), len(text))
        at = np.maximum(np.arange(0, len(text), LANE), m - 1)
        held = []
        live = np.flatnonzero(at < end)
        while len(live):
            here = at[live]
            step = self.shift[self._slot(text[here - b + 1], text[here])].astype(np.int64)
            held.append(here[step == 0])
            at[live] = here + np.maximum(step, 1)
            live = live[at[live] < end[live]]
        ends = np.concatenate(held) if held else np.zeros(0, dtype=np.int64)
        first = ends - m + 1
        key = self._bucket(text[ends - b + 1], text[ends], text[first], text[first + b - 1])
        low, high = np.searchsorted(self.key, key), np.searchsorted(self.key, key, side="right")
        start, first, low, sizes = [], first[high > low], low[high > low], (high - low)[high > low]
        number = []
        upto = np.cumsum(sizes)
        a = 0
        while a < len(first):
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + AT_ONCE, side="right")))
            own = np.repeat(np.arange(a, z), sizes[a:z])
            pattern = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(sizes[a:z]) - sizes[a:z], sizes[a:z])
            same = (text[first[own, None] + np.arange(m)] == self.ids[pattern]).all(1)
            start.append(first[own[same]]), number.append(self.numbers[pattern[same]])
            a = z
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(start), np.concatenate(number)) if start else (none, none)


class Matcher:
    """All patterns of a block: (window in words joined by spaces, name of its item or None)."""

    def __init__(self, windows: list[bytes], items: list[str | None]):
        number, owners = {}, []
        for w, item in zip(windows, items, strict=True):
            at = number.setdefault(w, len(number))
            if at == len(owners):
                owners.append([])
            if item is not None:
                owners[at].append(item)
        self.owners, self.vocab = owners, {}
        by_length: dict[int, list[tuple[list[int], int]]] = {}
        for w, at in number.items():
            ids = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in w.split(b" ")]
            by_length.setdefault(len(ids), []).append((ids, at))
        self.lengths = [Patterns(np.array([x[0] for x in found], dtype=np.int64), np.array([x[1] for x in found], dtype=np.int64)) for _, found in sorted(by_length.items())]

    def scan(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]] | None]:
        """For each text that holds a pattern: which words are hit, and the items."""
        get, ids, begin = self.vocab.get, [], []
        for ws in texts:
            begin.append(len(ids))
            ids += [get(w, 0) for w in ws]
            ids.append(0)
        flat, begin = np.array(ids, dtype=np.int64), np.array(begin)
        out: list[tuple[np.ndarray, set[str]] | None] = [None] * len(texts)
        for patterns in self.lengths:
            start, number = patterns.find(flat)
            text = np.searchsorted(begin, start, side="right") - 1
            by = np.argsort(text, kind="stable")
            held, first = np.unique(text[by], return_index=True)
            for t, a, z in zip(held.tolist(), first.tolist(), [*first[1:].tolist(), len(by)], strict=False):
                own = by[a:z]
                hit, items = out[t] = out[t] or (np.zeros(len(texts[t]) + 1, dtype=bool), set())
                edge = np.zeros(len(hit), dtype=np.int64)
                at = start[own] - begin[t]
                np.add.at(edge, at, 1), np.add.at(edge, at + patterns.length, -1)
                hit |= edge.cumsum() > 0
                for p in np.unique(number[own]).tolist():
                    items.update(self.owners[p])
        return out


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, win) without repeats: each run of `size` words of an item, the whole item if it has fewer but some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ws = words(text)
                found = list({b" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))}) if ws else []
                for a in range(0, len(found), 10_000):
                    part = found[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary())], ["item", "win"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "item string, win binary").distinct()


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items): maximal runs of words (start, end) that windows of the benchmark hit, and its items' ids as strings, sorted.

    Null and empty texts have no words; repeated rows each give a row; no text is cut. Items without words are found nowhere, an item
    without an id hits words but isn't listed, items of one id are one. An empty benchmark hits nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    made = written(windows(benchmark, size), "benchmark-windows")
    total = made.agg(F.coalesce(F.sum(F.length("win") + F.coalesce(F.length("item"), F.lit(0)) + 8), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    block = made.withColumn("block", F.pmod(F.xxhash64("win", "item"), F.lit(blocks)))
    at = docs.select(F.col("doc_id").cast("long"), "text", F.array().cast("array<long>").alias("hits"), F.array().cast("array<string>").alias("items"))
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
    for i in range(blocks):
        own = block.filter(F.col("block") == i).select("win", "item").toArrow()
        sent, last = spark.sparkContext.broadcast(Matcher(own.column("win").to_pylist(), own.column("item").to_pylist())), i == blocks - 1
        schema = pa.schema(fields if last else [("text", pa.string()), *(f for f in fields if f[0] != "n_words")])

        def run(batch: pa.RecordBatch, sent=sent, last=last, schema=schema) -> pa.RecordBatch:
            texts = [words(t) for t in batch.column("text").to_pylist()]
            hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for t, found in enumerate(sent.value.scan(texts)):
                if found:
                    mask, named = found
                    for a, z in zip(hits[t][::2], hits[t][1::2], strict=True):
                        mask[a:z] = True
                    hits[t] = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0)).tolist()
                    items[t] = sorted(named.union(items[t]))
            made = {"doc_id": batch.column("doc_id"), "text": None if last else batch.column("text"), "n_words": pa.array([len(w) for w in texts], pa.int64()), "hits": pa.array(hits, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
            return pa.RecordBatch.from_arrays([made[f.name] for f in schema], schema=schema)

        at = map_slices(at, run, schema)
    discard(made)
    spans = F.transform(F.sequence(F.lit(0), (F.size("hits") / 2).cast("int") - 1), lambda i: F.struct(F.col("hits")[2 * i].alias("start"), F.col("hits")[2 * i + 1].alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return at.select("doc_id", "n_words", F.when(F.size("hits") > 0, spans).otherwise(none).alias("spans"), "items")


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): find() in counts and a digest of the items, joined by commas."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = find(docs, benchmark, size).withColumn("n_hit", hit)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
n AS (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
win AS MATERIALIZED (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM n),
p AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hit AS MATERIALIZED (SELECT r, i, p.m, item_id FROM p JOIN win ON p.m = win.m AND array_to_string(w[i : i + p.m - 1], ' ') = s),
k AS (SELECT r, count(DISTINCT word)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS word FROM hit) GROUP BY r),
t AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (r) LEFT JOIN t USING (r)
"""
