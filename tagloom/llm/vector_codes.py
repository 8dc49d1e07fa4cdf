"""Product codes of vectors: four codebooks refined in rounds, the nearest entry found by Orchard's search.

Each codebook keeps, for every entry, all entries sorted by their distance from it. A vector's part walks the list of
its best entry so far, jumps to the list of an entry that is nearer, passes over entries it has met, and stops where the
list goes beyond twice its distance: what follows there can't be nearer. Codebooks have at most 256 entries and go
to the tasks whole; vectors never meet in one place, each task sends one sum for each entry it has used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, written

#: Scaled components are held to this size, so that distances are exact in 64 bits.
MOST = 1 << 24
#: Entries of a neighbour list that are looked at in one step, and cells of one step's arrays.
STEP, CELLS = 16, 4_000_000


class Codebook:
    """Integer entries with their distance-sorted neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = np.stack([((entries - e) ** 2).sum(1) for e in entries])
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(lowest index of a nearest entry, squared distance) of each row, and how many distances were taken."""
        lanes, met = max(1, CELLS // (STEP * max(1, x.shape[1]))), 0
        found = [self._walk(x[a : a + lanes]) for a in range(0, len(x), lanes)]
        met = sum(f[2] for f in found)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), met

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n, k = len(x), len(self.entries)
        best, at, place = (np.zeros(n, dtype=np.int64) for _ in range(3))
        d2 = ((x - self.entries[0]) ** 2).sum(1)
        seen = np.zeros((n, k), dtype=bool)
        seen[:, 0] = True
        live, met = np.arange(n), n
        while len(live):
            column = place[live, None] + np.arange(STEP)
            inside = column < k
            column = np.minimum(column, k - 1)
            entry = self.order[at[live, None], column]
            near = inside & (self.gaps[at[live, None], column] <= 4 * d2[live, None])
            lane, step = np.nonzero(near & ~seen[live[:, None], entry])
            row, new = live[lane], entry[lane, step]
            seen[row, new] = True
            met += len(row)
            dist = np.full(entry.shape, np.iinfo(np.int64).max)
            dist[lane, step] = ((x[row] - self.entries[new]) ** 2).sum(1)
            least = dist.min(1)
            index = np.where(dist == least[:, None], entry, k).min(1)
            nearer = least < d2[live]
            chosen = nearer | ((least == d2[live]) & (index < best[live]))
            best[live[chosen]] = index[chosen]
            d2[live[nearer]] = least[nearer]
            place[live] = np.where(nearer, 0, place[live] + STEP)
            at[live] = np.where(nearer, index, at[live])
            live = live[nearer | near.all(1)]
        return best, d2, met


def _whole(rows: pa.Array, scale: int, parts: int, width: int) -> np.ndarray:
    """floor(scale * x) of list rows as (rows, parts, width), with zeros behind shorter vectors."""
    sizes = np.diff(rows.offsets.to_numpy())
    flat = np.clip(np.floor(rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale), -MOST, MOST).astype(np.int64)
    out = np.zeros((len(rows), parts * width), dtype=np.int64)
    out[np.arange(parts * width) < sizes[:, None]] = flat
    return out.reshape(len(rows), parts, width)


def _slices(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, CELLS // max(1, cells))
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def codebooks(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> np.ndarray | None:
    """(parts, entries, width) whole numbers learnt from all rows of usable() vectors; None if there are none.

    The first entries are the parts of the `entries` rows of smallest vec_id (then of the smaller vector; rows without
    a vec_id come last). Each round replaces an entry by the floor of the mean of its parts; unused ones stay.
    """
    width = -(-(vectors.agg(F.max(F.size("embedding"))).first()[0] or 0) // parts)
    first = vectors.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).toArrow()
    if not first.num_rows:
        return None
    book = _whole(first.column("embedding").combine_chunks(), scale, parts, width).transpose(1, 0, 2).copy()
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    for _ in range(rounds):
        sent = vectors.sparkSession.sparkContext.broadcast(book)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            books = [Codebook(b) for b in sent.value]
            size = len(books[0].entries)
            count, total = np.zeros((parts, size), dtype=np.int64), np.zeros((parts, size, width), dtype=np.int64)
            for batch in _slices(batches, parts * width):
                x = _whole(batch.column("embedding"), scale, parts, width)
                for p, b in enumerate(books):
                    found = b.nearest(x[:, p])[0]
                    by = np.argsort(found, kind="stable")
                    used, start, n = np.unique(found[by], return_index=True, return_counts=True)
                    count[p, used] += n
                    if width and len(by):
                        total[p, used] += np.add.reduceat(x[by, p], start, axis=0)
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(count[part, entry], pa.int64()), "sums": pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))})

        made = vectors.select("embedding").mapInArrow(sums, schema)
        added = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
        for row in added.toLocalIterator():  # at most parts * entries rows
            book[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
        sent.unpersist()
    return book


def usable(vectors: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, embedding and the columns of `keep` of the vectors that are not null and hold finite components only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vectors.select("vec_id", "embedding", *keep).filter(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))


def encode(vectors: DataFrame, book: np.ndarray, scale: int = 1024, keep: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id, code, error) and the columns of `keep`: the nearest entries of all parts, and the sum of their squared distances."""
    parts, _, width = book.shape
    sent = vectors.sparkSession.sparkContext.broadcast(book)
    fields = [f for c in ("vec_id", *keep) for f in vectors.schema.fields if f.name == c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(b) for b in sent.value]
        for batch in _slices(batches, parts * width):
            x = _whole(batch.column("embedding"), scale, parts, width)
            found = [b.nearest(x[:, p]) for p, b in enumerate(books)]
            digits = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes().hex()
            code = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            own = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*own, pa.array(code, pa.string()), pa.array(sum(f[1] for f in found), pa.int64())], [*(f.name for f in fields), "code", "error"])

    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return vectors.select("embedding", *(f.name for f in fields)).mapInArrow(run, schema)


def decode(coded: DataFrame, book: np.ndarray, scale: int = 1024) -> DataFrame:
    """(vec_id, embedding): the entries that each code names, one behind the other, divided by the scale; null for a null code."""
    sent = coded.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value / scale
        for batch in batches:
            made = [None if c is None else np.concatenate([books[p, i] for p, i in enumerate(bytes.fromhex(c))]).tolist() for c in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(made, pa.list_(pa.float64()))], ["vec_id", "embedding"])

    return coded.select(F.col("vec_id").cast("long"), "code").mapInArrow(run, "vec_id long, embedding array<double>")


def digest(book: np.ndarray) -> str:
    """sha256 of all components as decimal numbers, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector; label_error sums over equal labels.

    Null vectors and those that hold a null or a component that isn't finite are left out. Shorter vectors, empty ones
    too, are filled with zeros up to the longest length, and that up to a multiple of `parts`. Components count as at
    most 2^24 in size after scaling. Rows that repeat each count and each give a row, without a vec_id too; null labels
    are one label. Fewer rows than `entries` give as many entries. An empty table gives no rows. Other columns are not read.
    """
    rows = written(usable(vectors, ("label",)), "code-vectors")
    book = codebooks(rows, parts, entries, rounds, scale)
    empty = np.zeros((parts, 1, 0), dtype=np.int64)
    coded = written(encode(rows, empty if book is None else book, scale, ("label",)), "vector-codes")
    discard(rows)
    most = (1 << 63) - 1
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(most)).cast("long").alias("label_error")).withColumnRenamed("label", "same")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("same")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(empty if book is None else book)).alias("codebooks_sha256"))


def sql(rounds: int = 4) -> str:
    """The same rows in DuckDB, every distance taken."""
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM v, (SELECT unnest(range(4)) AS part))",
        "c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= 256)",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p.part, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT * 256 + entry) AS best FROM p JOIN c{i} ON p.part = c{i}.part GROUP BY r, p.part)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT part, best % 256 AS entry, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{i})")
            steps.append(f"n{i} AS (SELECT part, entry, list(y ORDER BY i) AS c FROM (SELECT part, entry, i, floor(sum(y) / count(*))::BIGINT AS y FROM m{i} GROUP BY part, entry, i) GROUP BY part, entry)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN n{i} n ON o.part = n.part AND o.entry = n.entry)")
    steps.append(f"e AS (SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a{rounds} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN e USING (r), h"
