"""Operators on nested communities, and pairs of long records, against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.operators import entropy, graph


@pytest.fixture(scope="module")
def nested(spark):
    rng = random.Random(4)
    rows, terms = [], {}
    for node in range(40):
        comm = 0
        for level in range(1, rng.choice([0, 2, 4, 4, 4]) + 1):
            comm = comm * 3 + rng.randrange(3)
            rows.append((node, level, comm))
            if rng.random() < 0.9:
                terms[level, comm] = rng.random()
    own = {i: {(level, c) for node, level, c in rows if node == i} for i in range(40)}
    return own, terms, spark.createDataFrame(rows, "node_id int, level int, comm int"), spark.createDataFrame([(*k, v) for k, v in terms.items()], "level int, comm int, se_term double")


def test_walks(spark, nested):
    own, terms, paths, tree = nested
    rng = random.Random(5)
    sets = {i: [rng.randrange(42) for _ in range(rng.randrange(1, 6))] for i in range(60)}
    rows = spark.createDataFrame(list(sets.items()), "id int, node_ids array<int>")
    held = {i: set.intersection(*(own.get(v, set()) for v in s)) for i, s in sets.items()}
    assert {tuple(r) for r in entropy.common_ancestors(paths, rows).collect()} == {(i, *c) for i, cs in held.items() for c in cs}
    total = {i: sum(terms.get(c, 0.0) for c in set().union(*(own.get(v, set()) for v in s))) for i, s in sets.items() if any(own.get(v) for v in s)}
    assert {r["id"]: r["entropy"] for r in entropy.chain_entropy(tree, paths, rows).collect()} == pytest.approx(total)
    given = spark.createDataFrame([(i, v) for i, s in sets.items() for v in s[:2]], "id int, node_id int")
    asked = {i: [rng.randrange(42) for _ in range(rng.randrange(1, 5))] for i in range(70)}
    found = entropy.conditional_entropy(tree, paths, given, spark.createDataFrame([(i, v) for i, s in asked.items() for v in s], "id int, node_id int")).collect()
    new = {i: set().union(*(own.get(v, set()) for v in s)) - set().union(*(own.get(v, set()) for v in sets.get(i, [])[:2])) for i, s in asked.items()}
    assert {r["id"]: r["entropy"] for r in found} == pytest.approx({i: sum(terms.get(c, 0.0) for c in cs) for i, cs in new.items()})


@pytest.mark.parametrize("block", [2, 5, 256])
def test_pairs_of_long_records(spark, block):
    rng = random.Random(block)
    records = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(0, 30))] for _ in range(40)] + [None, [], ["a"], ["a", None, "b"], ["z"] * 20]
    want = Counter()
    for tags in records:
        tags = [t for t in tags or [] if t is not None]
        for i, x in enumerate(tags):
            for y in tags[i + 1 :]:
                want[min(x, y), max(x, y)] += 1
    found = graph.cooccurrence(spark.createDataFrame([(t,) for t in records], "tags array<string>"), block).collect()
    assert len(found) == len(want) and {(r["a"], r["b"]): r["co"] for r in found} == want


def test_blocks_of_a_very_long_record(spark):
    """20,000 tags make 200 million pairs; no row holds more than two blocks, and rows are dealt over the tasks."""
    n, block = 20_000, 256
    record = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n + 99)), lambda i: F.concat(F.lit("t"), F.when(i < n, i).otherwise(0).cast("string"))).alias("tags"))
    blocks = graph.tag_blocks(record, block).withColumn("part", F.spark_partition_id())
    row = blocks.agg(F.count("*").alias("rows"), F.max(F.size("x")).alias("x"), F.max(F.size("y")).alias("y"), F.countDistinct("part").alias("parts"), F.max(F.aggregate("x", F.lit(0).cast("long"), lambda m, t: F.greatest(m, t["n"]))).alias("n")).first()
    k = -(-n // block)
    assert (row["rows"], row["x"], row["y"], row["n"]) == (k * (k + 1) // 2, block, block, 101) and row["parts"] > 1
    some = graph.cooccurrence(record.select(F.slice("tags", 1, 2000).alias("tags")))
    assert some.agg(F.count("*"), F.sum("co")).first() == (2000 * 1999 // 2, 2000 * 1999 // 2)
