"""Reading and writing the files of the jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.ordering import ranked_index
from .shared import holds_files, written

#: Columns of seed records.
SEED = ("id", "conversations", "label", "langdetect")


def _empty(spark: SparkSession, columns) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def _readable(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all parquet files of a folder that can be read; None if there is no such file.

    One file's columns stand for all; where that one can't be read, those of all are read.
    """
    for every in (False, True):
        try:
            return spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", every).parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return None


def read_tagged(spark: SparkSession, path: str, columns: tuple[str, ...] = ("id", "label")) -> DataFrame:
    """The given columns of all parquet files of a folder; files that can't be read are skipped, no file gives no rows."""
    rows = _readable(spark, path)
    return _empty(spark, columns) if rows is None else rows.select(*columns)


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason) of the files of a folder that read_tagged() skips because they can't be read at all.

    Files that gave no row are tried one by one, so that empty ones aren't taken for broken ones.
    """
    try:
        listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, reason string")
    rows = _readable(spark, path)
    if rows is not None:
        listed = listed.join(rows.select(F.col("_metadata.file_path").alias("file")).distinct(), "file", "left_anti")
    broken = []
    for row in listed.toLocalIterator():
        try:
            spark.read.parquet(row["file"]).count()
        except Exception as e:  # noqa: BLE001 - whatever makes a file unreadable is its reason
            broken.append((row["file"], str(e).split("\n")[0]))
    return spark.createDataFrame(broken, "file string, reason string")


def read_reported(spark: SparkSession, path: str, columns: tuple[str, ...] = ("id", "label")) -> tuple[DataFrame, DataFrame]:
    """read_tagged() and skipped_files() of a folder."""
    return read_tagged(spark, path, columns), skipped_files(spark, path)


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """read_tagged() with conversations and language."""
    return read_tagged(spark, path, SEED)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of every line that isn't blank; a missing file gives no rows."""
    try:
        return spark.read.text(path).filter(F.trim("value") != "")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "value string")
        raise


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One row a line, read by the schema; blank lines are skipped, unreadable ones give nulls."""
    return read_lines(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """(value, v): lines with their JSON as a variant, null where a line isn't JSON."""
    return read_lines(spark, path).withColumn("v", F.try_parse_json("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line in UTF-8, other scripts as they are."""
    df.write.mode("overwrite").json(path)


def write_graph(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes")


def batched(combos: DataFrame, size: int = 100) -> DataFrame:
    """Adds the batch of `size` start nodes that a row belongs to."""
    return combos.withColumn("batch", F.floor(F.col("start_id") / size).cast("int"))


def write_combos(combos: DataFrame, path: str, k: int, size: int = 100) -> None:
    """Partitioned by k and batch, so that one k can be written again alone."""
    out = batched(combos, size).withColumn("k", F.lit(k))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("k", "batch").parquet(path)


def finished_batches(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(batch) of the ledger beside the combinations of k."""
    ledger = f"{path}/_ledger/k={k}"
    return spark.read.schema("batch int").parquet(ledger) if holds_files(spark, ledger) else spark.createDataFrame([], "batch int")


def write_in_batches(starts: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, k: int, size: int = 100, at_once: int = 10) -> int:
    """Writes make(starts) as write_combos() does, `at_once` batches of `size` starts (start_id) in a job; gives the number of jobs.

    A finished batch is noted in a ledger, and a later call leaves it out: work that was stopped goes on with the first
    batch that isn't finished. A batch that was being written is written again.
    """
    spark = starts.sparkSession
    todo = batched(starts, size).join(finished_batches(spark, path, k), "batch", "left_anti")
    batches = sorted(r["batch"] for r in todo.select("batch").distinct().toLocalIterator())
    for a in range(0, len(batches), at_once):
        now = batches[a : a + at_once]
        write_combos(make(todo.filter(F.col("batch").isin(now)).drop("batch")), path, k, size)
        spark.createDataFrame([(b,) for b in now], "batch int").coalesce(1).write.mode("append").parquet(f"{path}/_ledger/k={k}")
    return -(-len(batches) // at_once)


def read_combos(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """All batches in numeric order of batch and start."""
    rows = spark.read.parquet(path)
    return (rows if k is None else rows.filter(F.col("k") == k)).orderBy("k", "batch", "start_id")


def file_k(name: Column) -> Column:
    """The number after `k=` or `k` and before the end of a file or folder name."""
    return F.regexp_extract(name, r"k[=_]?(\d+)(?:[^/\d][^/]*)?(?:/[^/]*)?$", 1)


def with_k(rows: DataFrame, of_file: Column) -> DataFrame:
    """Sets k from the file where the row has none of its own."""
    own = F.col("k").cast("int") if "k" in rows.columns else F.lit(None).cast("int")
    return rows.withColumn("k", F.coalesce(own, of_file.cast("int")))


def read_k_pools(spark: SparkSession, paths: dict[int, str], schema: str) -> DataFrame:
    """The lines of one file for each k; a k that a row has wins over its file's."""
    out = None
    for k, path in sorted(paths.items()):
        rows = with_k(read_jsonl(spark, path, schema), F.lit(k))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def numbered_lines(lines: DataFrame, order: list[str]) -> DataFrame:
    """Adds the line number (from 0) in the given order, without one task for all lines."""
    return ranked_index(lines, order, "line")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, at) of all lines of a file or folder, blank ones too: the file, where the read piece of it starts, and
    a number that ascends inside the piece. A missing file gives no rows."""
    try:
        rows = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string, file string, block long, at long")
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def in_file_order(lines: DataFrame, n: int | None = None) -> DataFrame:
    """(line, value) of file_lines(), or of the first n: numbered from 0 over the files in the order of their names.

    Pieces are counted first; of the rows only those of pieces that are wanted are numbered, each piece by itself.
    """
    counts = written(lines.groupBy("file", "block").agg(F.count("*").alias("n")), "line-counts")
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = counts.select("file", "block", before.alias("before"))  # one row a piece
    if n is not None:
        pieces = pieces.filter(F.col("before") < n)
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    rows = lines.join(pieces, ["file", "block"]).withColumn("line", F.col("before") + inside).select("line", "value")
    return rows if n is None else rows.filter(F.col("line") < n)


def head_lines(lines: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """The first n lines, in the given order or, of file_lines(), in that of the files; of those the ones that aren't blank.
    All lines if n is not above 0."""
    if n > 0:
        lines = in_file_order(lines, n) if order is None else numbered_lines(lines, order).filter(F.col("line") < n)
    return lines.filter(F.trim("value") != "")


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """(instruction, dataset, generator) of a JSON array of objects."""
    return spark.read.option("multiLine", True).json(path).select("instruction", "dataset", "generator")


def write_eval_outputs(df: DataFrame, path: str) -> None:
    write_jsonl(df.select("dataset", "instruction", "output", "generator"), path)
