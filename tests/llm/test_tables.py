"""Queries with SQL against DuckDB, and the pipeline against its stages done by hand."""

import glob
import itertools
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import neardup, pii, quality, queries, suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = queries.queries()[name](spark, SF)
    wanted = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == sorted(wanted.fetchall(), key=repr)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    left = docs.filter(docs["doc_id"].isin(*kept))
    first = {r["doc_id"] for r in neardup.near_duplicates(left).filter("kept").collect()}
    left = left.filter(left["doc_id"].isin(*first))
    texts = {r["doc_id"]: pii.redact(r["text"], pii.spans(r["text"])[1]) for r in suffix_dedup.deduplicated(left).collect()}
    after = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, after, SF)
        assert after.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()} == {i: (t, len(t)) for i, t in texts.items()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == set(texts)


def test_pipeline_of_odd_rows(spark):
    """Nulls, empty texts, repeated rows, more columns and no rows at all go through every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.limit(60)
    odd = some.union(some.limit(5)).union(some.limit(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields))).union(some.limit(2).withColumn("text", F.lit("")))
    odd = odd.withColumns({c: F.lit(1) for c in ("row", "spans", "words", "kept", "label", "text_key", "document")})
    for rows in (odd, odd.filter("false")):
        left = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, SF)
            assert left.columns == odd.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, left, SF)
        assert packed.filter("offset + length > 4096").count() == 0 and {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in left.select("doc_id").collect()}


def test_pipeline_near_duplicates_lose_no_link(spark):
    """Five-word links of the tables by brute force: one document of each component stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for r in docs.collect():
        words = (r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        if words:
            sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert left == {r["doc_id"] for r in docs.select("doc_id").collect()} - {i for i in sets if root(i) != i}
