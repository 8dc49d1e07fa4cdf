"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema

from ..sources.shared import discard as discard
from ..sources.shared import shared_dir, shuffles_deleted

#: Characters of text a Python task works on at once.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table written in the shared folder: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_and_seen(df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, dict[str, Any]]:
    """written(), and aggregates of its rows that are taken while they are written, without a job of their own.

    Where Spark finds beforehand that there are no rows, there are no values.
    """
    seen = Observation()
    out = written(df.observe(seen, *(c.alias(k) for k, c in aggregates.items())), name)
    return out, seen.get


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in order, in pieces of about SLICE_CHARS, so that memory follows a slice and not a batch."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.binary_length(column).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            held += n or 0
            if held >= SLICE_CHARS:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: pa.Schema, text: str = "text") -> DataFrame:
    """mapInArrow over slices of bounded size; fn gets a batch and returns one with the given schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, text):
            if (out := fn(piece)) is not None:
                yield out

    return df.mapInArrow(run, from_arrow_schema(schema))
