"""Exact top-k inner-product search: tiled matrix products, partial selection in each tile, tree merging."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..sources.shared import shared_dir, shuffles_deleted
from .common import discard, written

_TOP = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("part", pa.int64())])
_EXACT = 1 << 53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Components of a pack of vectors, and scores that a task holds at once.
_PACK, _SCORES = 1 << 19, 1 << 22


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part: not null, nor holding a null or a component that is not finite
    when scaled. An empty vector stays."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", "embedding")


def _tile(rows: pa.StructArray, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floor(scale * x) of the components, as float64, of packed rows (vec_id, embedding)."""
    flat = rows.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return rows.field("vec_id").to_numpy(), np.floor(flat * scale).reshape(len(rows), dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all pairs: as float64 while every partial sum is exact there, else by Python's integers, as int64."""
    most = [int(np.abs(x).max(initial=0.0)) for x in (a, b)]
    if a.shape[1] * most[0] * most[1] < _EXACT:
        return a @ b.T
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, _LEAST, _MOST).astype(np.int64)


def _bound(scores: np.ndarray, k: int) -> np.ndarray:
    """A number for each row that at least k of its scores reach: the k-th highest of the greatest scores of disjoint groups of columns."""
    groups = max(256, k)
    if (n := scores.shape[1]) > 2 * groups:
        scores = scores[:, : n // groups * groups].reshape(len(scores), -1, groups).max(axis=1)
    at = max(0, scores.shape[1] - k)
    return np.partition(scores, at, axis=1)[:, at]


def _best(queries: np.ndarray, q_ids: np.ndarray, vectors: np.ndarray, v_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    scores = _products(queries, vectors)
    for i in np.flatnonzero(np.isin(q_ids, v_ids)):
        scores[i, v_ids == q_ids[i]] = _LEAST if scores.dtype == np.int64 else -np.inf
    row, to = np.nonzero(scores >= _bound(scores, k)[:, None])
    other = v_ids[to] != q_ids[row]
    row, to = row[other], to[other]
    won = scores[row, to].astype(np.int64)
    order = np.lexsort((v_ids[to], ~won, row))
    order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]  # row ascends, so that its places stay after sorting
    return q_ids[row[order]], v_ids[to[order]], won[order]


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, tile: int = 512, fan_in: int = 16, wide: int = 16, share: float = 2.0, least: int = 1 << 27) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every`, the k other rows of highest integer inner product.

    Queries and candidates are packed in blocks and shards of at most about `wide` times `tile` rows, fewer where vectors are long;
    each pair of them is matrix products of bounded size with a partial selection of k rows a query, and partial lists are merged
    `fan_in` shards at a time before the last ranking. Each query goes to every shard, which is quadratic: blocks are dealt into
    rounds, one after the other, that move about `share` times the vectors' components (`least` at least) and delete their
    shuffles. Nothing is broadcast: Spark would judge the copies by the size of the queries before they are copied.

    Vectors of another length than the query's are not its candidates. Ties go to the smaller vec_id; a
    vec_id that occurs twice is two candidates of the same id, and none of a query of that id, whose rows share one
    list. Null, NaN and infinite components, also after scaling, drop the vector; scores beyond 64 bits count as the
    nearest 64-bit number. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, scale).withColumns({"dim": F.size("embedding"), "spread": F.xxhash64(F.monotonically_increasing_id())}), "topk-vectors")
    asking = rows.filter(F.col("vec_id") % every == 0)

    def sizes(df: DataFrame) -> tuple[int, int, int]:
        """Vectors, their components, and the packs of bounded size they make."""
        count, components = df.agg(F.count("*"), F.coalesce(F.sum(F.col("dim").cast("long")), F.lit(0))).first()
        return count, components, max(1, -(-count // (wide * tile)), -(-components // _PACK))

    n, size, shards = sizes(rows)
    shards = max(shards, min(-(-n // tile), 32))  # few vectors make smaller shards, so that there is work for many tasks
    rounds = max(1, -(-sizes(asking)[1] * shards // int(max(share * size, least))))

    def packed(df: DataFrame, count: int) -> DataFrame:
        return df.withColumn("part", F.pmod("spread", F.lit(count))).groupBy("part", "dim").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (part, dim) in enumerate(zip(batch.column("part").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
                (q_ids, q), (v_ids, v) = (_tile(batch.column(c)[i].values, dim, scale) for c in ("queries", "rows"))
                step = max(1, _SCORES // len(v_ids))
                for a in range(0, len(q_ids), step):
                    found = _best(q[a : a + step], q_ids[a : a + step], v, v_ids, k)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in found), pa.array(np.full(len(found[0]), part), pa.int64())], schema=_TOP)

    by_score = [F.col("score").desc(), F.col("vec_id")]
    held = packed(rows, shards).hint("merge")
    path = f"{shared_dir(spark)}/topk-{uuid.uuid4().hex}"
    for turn in range(rounds):
        own = asking.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == turn)  # all rows of an id
        sent = packed(own, sizes(own)[2]).select("dim", F.col("rows").alias("queries"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("part"))
        top = sent.hint("merge").join(held, ["part", "dim"]).select("part", "dim", "queries", "rows").mapInArrow(score, from_arrow_schema(_TOP))
        left = shards
        while left > fan_in:
            left = -(-left // fan_in)
            top = top.withColumn("part", F.floor(F.col("part") / fan_in)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*by_score))).filter(F.col("rank") <= k).drop("rank")
        ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by_score))).filter(F.col("rank") <= k)
        found = ranked.select("query_id", "rank", "vec_id", "score")
        with shuffles_deleted(spark):
            found.write.mode("append").parquet(path)
    discard(rows)
    return spark.read.schema(found.schema).parquet(path)


SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
