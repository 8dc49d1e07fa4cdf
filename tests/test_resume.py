"""Work that goes on where it stopped, files in order, and files that can't be read."""

import glob
import itertools
import os

import pytest
from pyspark.sql import functions as F

from tagloom.operators import combos, synthesis, training
from tagloom.sources import files


def test_batches_go_on(spark, tmp_path):
    starts = spark.range(25).select(F.col("id").cast("int").alias("start_id"))
    path, seen = str(tmp_path / "combos"), []

    def make(rows, dies_at=None):
        own = sorted(r["start_id"] for r in rows.collect())
        if dies_at in own:
            raise RuntimeError("stopped")
        seen.extend(own)
        return rows.select("start_id", F.array("start_id").alias("y_ids"), F.lit(1.0).alias("max_conditional_se"))

    with pytest.raises(RuntimeError):
        files.write_in_batches(starts, lambda rows: make(rows, 11), path, 3, 5, 1)
    assert [r["start_id"] for r in files.read_combos(spark, path, 3).collect()] == list(range(10))
    assert files.write_in_batches(starts, make, path, 3, 5, 2) == 2
    assert sorted(seen) == list(range(25)) and [r["start_id"] for r in files.read_combos(spark, path, 3).collect()] == list(range(25))
    assert files.write_in_batches(starts, make, path, 3, 5, 2) == 0 and len(seen) == 25
    assert files.write_in_batches(starts, make, path, 4, 5, 9) == 1 and {r["k"] for r in files.read_combos(spark, path).collect()} == {3, 4}


def test_search_in_batches(spark, tmp_path):
    nodes = spark.range(12).select(F.col("id").cast("int").alias("node_id"))
    paths = nodes.select("node_id", F.lit(1).alias("level"), (F.col("node_id") % 4).alias("comm"))
    tree = paths.select("level", "comm").distinct().withColumn("se_term", F.col("comm") / 8)
    full = combos.node_paths(tree, paths, nodes)
    path = str(tmp_path / "found")
    assert combos.combos_in_batches(nodes, full, path, 3, 5, size=4, at_once=2) == 2
    want = {(r["start_id"], tuple(r["y_ids"]), r["max_conditional_se"]) for r in combos.combos_for_all_starts(nodes, full, 3, 5).collect()}
    assert {(r["start_id"], tuple(r["y_ids"]), r["max_conditional_se"]) for r in files.read_combos(spark, path, 3).collect()} == want


def test_each_prompt_is_called_once(spark, tmp_path):
    calls, store, alive = tmp_path / "calls", str(tmp_path / "store"), tmp_path / "alive"
    calls.mkdir()

    def call(prompt):
        if not alive.exists() and len(os.listdir(calls)) >= 8:
            raise SystemExit("the run dies")
        for i in itertools.count():
            if not (calls / f"{prompt}-{i}").exists():
                (calls / f"{prompt}-{i}").touch()
                return prompt.upper()

    df = spark.createDataFrame([(i, f"p{i % 30}") for i in range(90)] + [(99, None)], "id int, prompt string")
    with pytest.raises(Exception, match="dies|SystemExit|exited|crashed"):
        synthesis.generate(df, call, store=store, tasks=1, batch=1, wait=0.0).collect()
    before = len(os.listdir(calls))
    assert before == 8
    alive.touch()
    got = synthesis.generate(df, call, store=store, tasks=3, batch=12, wait=0.0).collect()
    assert sorted((r["id"], r["reply"]) for r in got) == [(i, f"P{i % 30}") for i in range(90)]
    assert len(os.listdir(calls)) == 30 and synthesis.generate(df, call, store=store).count() == 90 and len(os.listdir(calls)) == 30


def test_calls_have_a_pace(spark, tmp_path):
    import time

    df = spark.createDataFrame([(f"q{i}",) for i in range(12)], "prompt string")
    begun = time.monotonic()
    got = synthesis.generate(df, lambda p: p, store=str(tmp_path / "s"), tasks=1, per_second=8.0).collect()
    assert len(got) == 12 and time.monotonic() - begun >= 11 / 8


def test_verdicts_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["b", "a"]), (2, ["a", "b"]), (3, ["a"]), (4, ["bad"])], "combo_id int, tags array<string>")
    store = str(tmp_path / "verdicts")

    def judge(key):
        if key == ["bad"]:
            raise ValueError(key)
        return "yes" if len(key) > 1 else "no"

    assert sorted(r["combo_id"] for r in synthesis.gate_combos(rows, judge, store=store).collect()) == [1, 2, 4]
    again = lambda key: 1 / 0
    assert sorted(r["combo_id"] for r in synthesis.gate_combos(rows, again, store=store).collect()) == [1, 2, 4]
    assert sorted(r["combo_id"] for r in synthesis.gate_combos(rows, again, False, store=store).collect()) == [1, 2]
    assert sorted(r["combo_id"] for r in synthesis.gate_combos(rows, judge).collect()) == [1, 2, 4]
    assert sorted(r["combo_id"] for r in synthesis.gate_combos(rows, judge, False).collect()) == [1, 2]


@pytest.mark.parametrize("n", [0, 1, 7, 350, 5000])
def test_first_lines_of_files(spark, tmp_path, n):
    texts = {"b.txt": ["x" * (i % 50) if i % 7 else "  " for i in range(300)], "a.txt": ["", "one", "", "two"], "c.txt": [f"c{i}" for i in range(100)]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        every = [x for name in sorted(texts) for x in texts[name]]
        rows = files.file_lines(spark, str(tmp_path))
        assert rows.select("file", "block").distinct().count() > 5
        got = files.head_lines(rows, n)
        want = [(i, x) for i, x in enumerate(every) if (n <= 0 or i < n) and x.strip()]
        if n > 0:
            assert sorted((r["line"], r["value"]) for r in got.collect()) == want
        else:
            assert sorted(r["value"] for r in got.collect()) == sorted(x for _, x in want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_files_that_cannot_be_read(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(10).select(F.col("id"), F.lit("x").alias("label")).repartition(2).write.parquet(path)
    spark.range(0).select(F.col("id"), F.lit("x").alias("label")).coalesce(1).write.mode("append").parquet(path)
    (tmp_path / "in" / "broken.parquet").write_bytes(b"PAR1 no such thing")
    rows, skipped = files.read_reported(spark, path)
    assert rows.count() == 10
    found = skipped.collect()
    assert [os.path.basename(r["file"]) for r in found] == ["broken.parquet"] and found[0]["reason"]
    for good in glob.glob(f"{path}/part-*"):
        os.remove(good)
    rows, skipped = files.read_reported(spark, path)
    assert rows.count() == 0 and skipped.count() == 1
    rows, skipped = files.read_reported(spark, str(tmp_path / "none"))
    assert rows.count() == 0 and skipped.count() == 0


def test_shards_keep_the_order(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("position"), F.col("id").alias("value")).repartition(5)
    training.write_shards(rows, 3, path)
    for shard in range(3):
        want = [(p // 3, next(v for v in range(1000) if v * 37 % 1000 == p)) for p in range(shard, 1000, 3)]
        assert [(r["place"], r["value"]) for r in training.read_shard(spark, path, shard).collect()] == want
        names = sorted(glob.glob(f"{path}/shard={shard}/part-*.parquet"))
        assert [r["place"] for n in names for r in spark.read.parquet(n).collect()] == [p for p, _ in want]
