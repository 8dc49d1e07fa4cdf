"""Jobs of bounded size: contents assembled part by part, calls by job, sources without dealing combos again."""

import ast
import glob
import os

import pytest
from pyspark.sql import functions as F

from tagloom.functions import messages
from tagloom.operators import synthesis
from tagloom.plans import fixtures as fx


@pytest.fixture(scope="module")
def atomic(spark):
    rows = [(i, [("user", "x" * (i + 1)), ("assistant", "y" * 40)], "abc"[i % 3]) for i in range(12)]
    return spark.createDataFrame(rows, "id long, content array<struct<role:string,content:string>>, single_ability_tag string")


@pytest.fixture(scope="module")
def combos(spark):
    return spark.createDataFrame([(i, [["a", "b"], ["c", "a", "a"], ["b", "none"], ["a"]][i % 4]) for i in range(60)], "combo_id long, tags array<string>")


def _shuffle_files(spark):
    return glob.glob(os.path.join(spark.conf.get("spark.local.dir"), "**", "shuffle_*"), recursive=True)


def test_contents_in_jobs_equal_those_at_once(spark, atomic, combos):
    matched = synthesis.match_sources(combos, synthesis.tag_index(atomic))
    want = {r["combo_id"]: r for r in synthesis.assemble_content(matched, atomic).collect()}
    jobs, before = [], set(_shuffle_files(spark))

    def use(rows):
        jobs.append(rows)
        return rows

    found = synthesis.assembled_in_jobs(matched, atomic, use, about=combos, share=1, least=1)
    left = set(_shuffle_files(spark)) - before
    got = {r["combo_id"]: r for r in found.collect()}
    assert len(jobs) > 3 and not left
    assert {k: (r["source_sample_ids"], r["combined_content_for_llm"]) for k, r in got.items()} == {k: (r["source_sample_ids"], r["combined_content_for_llm"]) for k, r in want.items()}
    assert len(got) == 45 and got[1]["tags"] == ["c", "a", "a"]


def test_contents_of_no_combos(spark, atomic, combos):
    matched = synthesis.match_sources(combos.filter("false"), synthesis.tag_index(atomic))
    assert synthesis.assembled_in_jobs(matched, atomic, lambda rows: rows.select("combo_id")).collect() == []


def test_sources_deal_combos_once(spark, atomic, combos):
    index = synthesis.tag_index(atomic)
    for on_missing in ("drop", "substitute"):
        found = synthesis.match_sources(combos, index, on_missing=on_missing)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1


def test_calls_are_dealt_by_job(spark, tmp_path, monkeypatch):
    dealt = []

    def spy(df, name, by=None):
        dealt.append((name, by))
        return kept(df, name, by)

    kept = synthesis.written
    monkeypatch.setattr(synthesis, "written", spy)
    texts = spark.range(20).select(F.col("id").cast("string").alias("prompt"))
    found = synthesis.stored_replies(texts, lambda t: t + "!", f"file://{tmp_path}/store", batch=4)
    assert sorted(r["reply"] for r in found.collect()) == sorted(f"{i}!" for i in range(20))
    assert ("calls-by-job", "_job") in dealt


LABELS = [
    "{'ability_zh': ['a', 'b']}", "{'ability_zh': ['a','b c'], 'x': None}", "{'ability_zh': ['a\tb'], 'x': True, 'y': 'z'}",
    "{'ability_zh': ['a'], 'ability_zh': ['b']}", "{'ability_zh': ['it\\'s'], 'x': None}", "{'ability_zh': ['a\nb']}", "{'ability_zh': []}",
    "{'ability_zh': ['a'], 'x': None}\n", "{'ability_zh': ['a', None]}", "{'ability_zh': [\"a'b\"], 'x': None}", "{'ability_zh': ['a'], 'x': none}",
]


def test_plain_labels_need_no_python(spark):
    df = spark.createDataFrame(list(enumerate(LABELS)), "id int, label string")
    plain = [r[0] for r in df.orderBy("id").select(messages.plain_tags(F.col("label"))).collect()]
    assert [i for i, t in enumerate(plain) if t is not None] == [0, 1, 2]
    assert all(t == ast.literal_eval(LABELS[i])["ability_zh"] for i, t in enumerate(plain) if t is not None)
    found = {r["id"]: r["tags"] for r in messages.extract_tags(df).collect()}
    assert found[1] == ["a", "b c"] and found[4] == ["it's"] and found[9] == ["a'b"] and 5 not in found and 10 not in found


def test_graph_reads_written_records(spark, monkeypatch):
    names = []

    def spy(df, name, by=None):
        names.append(name)
        return kept(df, name, by)

    kept = fx.written
    monkeypatch.setattr(fx, "written", spy)
    records = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c", "c"])], "id long, tags array<string>")
    edges, ids = fx.indexed(spark, "", records)
    assert names[0] == "tagged-records" and edges.count() == 2 and ids.count() == 3
