"""Exact repeated substrings by distributed prefix doubling over sampled suffixes.

Every 200-byte string holds a sampled position, picked by its content alone (the least hash among its 73-byte grams),
so equal strings are sampled alike. Spark sorts (rank, position) pairs: first by the 73 bytes at each sampled
position, then by ever longer strings around it (169, 197, 200 bytes), each for a shorter run of window starts; the
rank of a longer string is that of the pair of the shorter one's rank and of the bytes by which it grew. A position
whose rank is unique leaves; a run whose longest common string recurs is past the threshold as a whole; only runs at
the rims of repeated passages are divided and ranked again. Ranking every byte, not only samples, would sort 58 times
as many pairs. All rounds are dealt by ranges of the sort order, so that a rank which very many positions share is
split; where two parts meet, the positions are compared once more at the end.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import discard, map_slices, written
from .neardup import _mixed, _power

LENGTH = 200
#: Windows that share a sampled position, dealt into runs of these sizes by round.
RUNS = (128, 32, 4, 1)
_GRAM = LENGTH - RUNS[0] + 1


def sampled(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, least offset, largest offset): a window starting `offset` bytes before the position has it as its sample."""
    n = len(raw) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    data = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    power, inverse = _power(len(raw) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(data * power[: len(raw)])]
    value = _mixed((sums[_GRAM:] - sums[:-_GRAM]) * inverse[: len(raw) - _GRAM + 1])
    at = np.arange(len(value), dtype=np.int32)
    step = 1
    while step < RUNS[0]:
        later = value[step:] < value[:-step]
        at = np.where(later, at[step:], at[:-step])
        value = np.where(later, value[step:], value[:-step])
        step *= 2
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], n] - 1
    position = at[first].astype(np.int64)
    return position, position - last, position - first


_hash = xxhash.xxh3_64_intdigest
_SHIFT = 1 << 63


def _whole(raw: bytes, base: int, n: int, row: int, at: int, first: int, size: int) -> int:
    """A hash of the string that all windows of a run cover together.

    raw starts at byte `base` of a text of n bytes. A run that reaches over an end of the text has a string of its own,
    equal to no other's.
    """
    low, high = at - first - size + 1, at - first + LENGTH
    found = _hash(raw[low - base : high - base], first + 1000) if low >= 0 and high <= n else _hash(b"%d:%d" % (row, at), first + 2000)
    return found - _SHIFT


def _core(raw: bytes, base: int, at: int, first: int, size: int, rank: int, was: tuple[int, int]) -> int:
    """The rank of the string that all windows of a run share: of the pair of the `rank` of the part of it that an
    earlier run of (first, size) `was` shares, and of the bytes before and after that part."""
    own, part = ((at - f - base, at - f - n + 1 + LENGTH - base) for f, n in ((first, size), was))
    grown = b"%d:%d:%b" % (first, part[0] - own[0], raw[own[0] : part[0]] + raw[part[1] : own[1]])
    return _hash(grown + rank.to_bytes(8, "little", signed=True)) - _SHIFT


_PLACE = [("doc", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("first", pa.int16()), ("low", pa.int16()), ("high", pa.int16())]
_RANKED = pa.schema([("core", pa.int64()), ("whole", pa.int64()), *_PLACE])


def _samples(docs: DataFrame) -> DataFrame:
    """The first round's pairs: every sampled position of every text (doc, row, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in _RANKED]
        for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "text")), strict=True):
            raw = (text or "").encode()
            at, low, high = (x.tolist() for x in sampled(raw))
            cores, wholes = [_hash(raw[a : a + _GRAM]) - _SHIFT for a in at], [_whole(raw, 0, len(raw), row, a, 0, RUNS[0]) for a in at]
            for column, values in zip(out, (cores, wholes, [doc] * len(at), [row] * len(at), at, [0] * len(at), low, high), strict=True):
                column.extend(values)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _RANKED, strict=True)], schema=_RANKED)

    return map_slices(docs.select("doc", "row", "text"), run, _RANKED)


def _judged(sorted_pairs: DataFrame, size: int) -> DataFrame:
    """(core, doc, row, at, first, low, high, start, end, again) of pairs sorted by (core, whole) inside partitions.

    start and end bound the bytes of a run whose covered string recurs (else null); `again` marks runs to divide:
    those whose core recurs though their whole doesn't, and one of each recurring whole among them, which they may
    have to be compared to. What lies beyond a partition's ends is taken to have the same core.
    """

    names = ["core", *(c for c, _ in _PLACE)]

    def judge(t: dict[str, np.ndarray], head: bool, tail: bool) -> pa.RecordBatch:
        core, whole = t["core"], t["whole"]
        same = core[1:] == core[:-1]
        alike = same & (whole[1:] == whole[:-1])
        mark = np.r_[False, alike] | np.r_[alike, False]
        again = (np.r_[True, same] & ~np.r_[False, alike]) | (np.r_[same, True] & ~np.r_[alike, False])
        keep = mark | again
        keep[0] &= head
        keep[-1] &= tail
        start = t["at"].astype(np.int32) - t["first"] - (size - 1)
        columns = [pa.array(t[c][keep]) for c in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(start[keep], mask=~mark[keep]), pa.array((start + LENGTH + size - 1)[keep].astype(np.int32), mask=~mark[keep]), pa.array(again[keep])], names=[*names, "start", "end", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = None, True  # the last two rows seen; the last is still to be judged
        for batch in batches:
            if not batch.num_rows:
                continue
            t = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            t = t if held is None else {c: np.r_[held[c], t[c]] for c in t}
            if len(t["row"]) > 2:
                yield judge(t, head, False)
                held, head = {c: v[-2:] for c, v in t.items()}, False
            else:
                held = t
        if held is not None:
            yield judge(held, head, True)

    return sorted_pairs.mapInArrow(run, "core long, doc long, row long, at int, first short, low short, high short, start int, end int, again boolean")


def _segments(docs: DataFrame, todo: DataFrame) -> DataFrame:
    """(doc, row, n, starts, parts): the bytes of each text that the runs still to be divided can reach."""
    schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("starts", pa.list_(pa.int32())), ("parts", pa.list_(pa.binary()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for doc, row, text, ats in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "text", "ats")), strict=True):
            raw, starts, ends = (text or "").encode(), [], []
            for at in sorted(set(ats)):
                low, high = max(0, at - RUNS[0] + 1), min(len(raw), at + LENGTH)
                if starts and low <= ends[-1]:
                    ends[-1] = high
                else:
                    starts.append(low), ends.append(high)
            out.append((doc, row, len(raw), starts, [raw[a:b] for a, b in zip(starts, ends, strict=True)]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    # repeated rows are one text here
    wanted = todo.groupBy("doc", "row").agg(F.collect_set("at").alias("ats"))
    return map_slices(docs.join(wanted, ["doc", "row"]).select("doc", "row", "text", "ats"), run, schema)


def _divided(todo: DataFrame, segments: DataFrame, before: int, size: int) -> DataFrame:
    """The next round's pairs: runs of `before` windows cut into runs of `size` that hold a window of their position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, row, n, starts, parts, runs in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "n", "starts", "parts", "runs")), strict=True):
                bases = np.array(starts)
                for r in runs:
                    k = int(np.searchsorted(bases, max(0, r["at"] - RUNS[0] + 1), side="right")) - 1
                    raw, base = parts[k], starts[k]
                    for first in range(r["first"], r["first"] + before, size):
                        if first <= r["high"] and first + size > r["low"]:
                            core = _core(raw, base, r["at"], first, size, r["core"], (r["first"], before))
                            out.append((core, _whole(raw, base, n, row, r["at"], first, size), doc, row, r["at"], first, r["low"], r["high"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(_RANKED), _RANKED, strict=True)], schema=_RANKED)

    runs = todo.groupBy("doc", "row").agg(F.collect_list(F.struct("core", "at", "first", "low", "high")).alias("runs"))
    return segments.join(runs, ["doc", "row"]).mapInArrow(run, from_arrow_schema(_RANKED))


def repeated(docs: DataFrame) -> DataFrame:
    """(doc, row, spans): the bytes of each text (doc, row, text) that a recurring string of LENGTH bytes covers.

    spans are pairs of byte offsets, in no order and overlapping; rows without any are left out. Strings are compared
    by two 64-bit hashes together.
    """
    order = ["core", "whole", "doc", "row", "at"]
    found: list[DataFrame] = []
    for before, size in zip((0, *RUNS), RUNS, strict=False):
        pairs = written(_divided(found[-1].filter("again"), segments, before, size) if found else _samples(docs), "suffix-pairs")
        found.append(written(_judged(pairs.repartitionByRange(*order).sortWithinPartitions(*order), size), "suffix-judged"))
        discard(pairs)
        if before == 0:
            segments = written(_segments(docs, found[0].filter("again")), "suffix-segments")
    discard(segments)
    marks = functools.reduce(DataFrame.union, (f.filter(F.col("start").isNotNull()).select("doc", "row", "start", "end") for f in found))
    # single windows have one rank; what is undecided among them stands at the ends of partitions, two rows of each
    edges = found[-1].filter("again")
    twice = edges.groupBy("core").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("core")
    start = F.col("at") - F.col("first")
    met = edges.join(twice, "core", "left_semi").select("doc", "row", start.alias("start"), (start + LENGTH).alias("end"))
    return marks.union(met).groupBy("doc", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merged(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Disjoint spans in order, clipped to n bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(0, s["start"]), min(n, s["end"])) for s in (() if spans is None else spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif a < b:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame, *columns: Column) -> DataFrame:
    """The given columns of each row with text and spans; rows are told apart by two 64-bit hashes of doc_id and text."""
    keyed = docs.select(*columns, docs["text"].alias("text"), F.xxhash64(docs["doc_id"]).alias("doc"), F.xxhash64(docs["text"], docs["doc_id"]).alias("row"))
    return keyed.join(repeated(keyed.select("doc", "row", "text")), ["doc", "row"], "left").drop("doc", "row")


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every text as UTF-8 bytes.

    A byte is removed if a 200-byte string that starts anywhere else too covers it. Null texts are empty; matches
    never cross documents; repeated rows are copies of one another. Other columns are not read. An empty table gives
    no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            raw = (text or "").encode()
            gone = merged(spans, len(raw))
            out.append((doc_id, len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(b"".join([raw[a:b] for a, b in _gaps(gone, len(raw))])).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _REPORT, strict=True)], schema=_REPORT)

    return map_slices(_with_spans(docs, docs["doc_id"].cast("long").alias("doc_id")), run, _REPORT)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows without the bytes that repeated strings cover. A character that is cut apart goes whole; null texts stay null."""

    @F.pandas_udf("string")
    def cut(texts, spans):
        out = []
        for text, found in zip(texts, spans, strict=True):
            if text and found is not None and len(found):
                raw = text.encode()
                text = b"".join([raw[a:b] for a, b in _gaps(merged(found, len(raw)), len(raw))]).decode("utf-8", "ignore")
            out.append(text)
        return pd.Series(out, dtype=object)

    found = _with_spans(docs, F.struct(*(docs[c] for c in docs.columns)).alias("document"))
    return found.select(F.col("document").withField("text", cut("text", "spans")).alias("document")).select("document.*")


def _gaps(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    edges = [0, *(x for s in spans for x in s), n]
    return list(zip(edges[::2], edges[1::2], strict=True))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents
), w AS (SELECT doc_id, hx, unnest(range(0, greatest(0, len(hx) // 2 - 199))) AS i FROM d
), k AS (SELECT doc_id, i, md5(substr(hx, 2 * i + 1, 400)) AS g FROM w
), r AS (SELECT doc_id, i FROM k WHERE g IN (SELECT g FROM k GROUP BY g HAVING count(*) > 1)
), o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER v + 200 THEN 0 ELSE 1 END AS fresh FROM r WINDOW v AS (PARTITION BY doc_id ORDER BY i)
), n AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o
), s AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY 1, 2
), g AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s
), t AS (
  SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last,
    string_agg(substr(hx, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM g JOIN d USING (doc_id) GROUP BY 1
)
SELECT doc_id, (len(hx) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN hx ELSE kept || substr(hx, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
