"""Replies in jobs: contents are assembled once, as text that goes to the caller's function and no further."""

import ast
import hashlib
import itertools
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from tagloom.functions import messages
from tagloom.operators import synthesis
from tagloom.plans import queries as registered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def samples(spark):
    """Twelve samples; some are copies, one has null content, and roles and texts may be null."""
    rows = [(i, None if i == 11 else [("user", "x" * (1 + i % 6)), (None, None), ("system", "é\n")], "abc"[i % 3]) for i in range(12)]
    return spark.createDataFrame(rows, "id long, content array<struct<role:string,content:string>>, single_ability_tag string")


@pytest.fixture(scope="module")
def matched(spark, samples):
    combos = spark.createDataFrame([(f"k{i}", [["a", "b"], ["c", "a", "a"], ["b", "none"], ["a"], ["c"]][i % 5]) for i in range(40)], "combo_id string, tags array<string>")
    return synthesis.match_sources(combos, synthesis.tag_index(samples)).localCheckpoint()


@pytest.fixture(scope="module")
def prompts(matched, samples):
    rows = synthesis.assemble_content(matched, samples)
    return rows.select("combo_id", synthesis.render_prompt(F.col("combined_content_for_llm")).alias("prompt")).localCheckpoint()


def _rows(df):
    return sorted((r["combo_id"], r["reply"]) for r in df.collect())


def test_texts_equal_rendered_contents(matched, samples, prompts):
    bodies = samples.select("id", synthesis.render_prompt(F.col("content")).alias("body"))
    found = {r["combo_id"]: r["prompt"] for r in synthesis.prompt_texts(matched, bodies).collect()}
    assert found == {r["combo_id"]: r["prompt"] for r in prompts.collect()} and None in found.values() and len(found) == 32


def test_pieces_of_a_text_in_several_batches(spark, matched, samples, prompts):
    bodies = samples.select("id", synthesis.render_prompt(F.col("content")).alias("body"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "1")
    try:
        found = {r["combo_id"]: r["prompt"] for r in synthesis.prompt_texts(matched, bodies).collect()}
    finally:
        spark.conf.unset(name)
    assert found == {r["combo_id"]: r["prompt"] for r in prompts.collect()}


@pytest.mark.parametrize("least", [1, 1 << 29])
def test_replies_in_jobs(matched, samples, prompts, tmp_path, least):
    def call(prompt):
        if len(prompt) % 5 == 0:
            raise ValueError("no reply")
        return prompt.upper()

    want = _rows(synthesis.generate(prompts, call, tries=1))
    assert 0 < len(want) < 32
    assert _rows(synthesis.generate_in_jobs(matched, samples, call, tries=1, share=3, least=least)) == want
    assert _rows(synthesis.generate_in_jobs(matched, samples, call, tries=1, store=f"file://{tmp_path}/store", batch=3, share=3, least=least)) == want


def test_no_combos_and_no_replies(matched, samples, tmp_path):
    assert _rows(synthesis.generate_in_jobs(matched.filter("false"), samples, str.upper)) == []
    assert _rows(synthesis.generate_in_jobs(matched.filter("false"), samples, str.upper, store=f"{tmp_path}/none")) == []


def test_each_prompt_of_a_job_is_called_once(matched, samples, prompts, tmp_path):
    calls, store = tmp_path / "calls", f"{tmp_path}/store"
    calls.mkdir()

    def call(prompt):
        for i in itertools.count():
            mark = calls / f"{hashlib.md5(prompt.encode()).hexdigest()}-{i}"
            if not mark.exists():
                mark.touch()
                return prompt

    texts = {r["prompt"] for r in prompts.collect()} - {None}
    for part in (matched.filter("combo_id < 'k3'"), matched, matched):
        synthesis.generate_in_jobs(part, samples, call, store=store, batch=5, share=3, least=1).collect()
        assert len(os.listdir(calls)) == len({r["prompt"] for r in prompts.join(part, "combo_id", "left_semi").collect()} - {None})
    assert len(texts) == len(os.listdir(calls)) < prompts.count()


def test_equal_texts_have_equal_prints():
    text = "\0äb\n--- a ---\nuser: 漢😀" * 40
    for cuts in ((), (0,), (1, 2, 3), (7, 7, 500)):
        pieces = [text[a:b] for a, b in itertools.pairwise((0, *cuts, len(text)))]
        assert synthesis._joined_prints(map(synthesis._print, pieces)) == synthesis._print(text)
    others = [text[1:], text + "\0", text.replace("b", "c", 1), text[::-1], ""]
    assert len({synthesis._print(t) for t in [text, *others]}) == 6


def _plans(spark, name):
    """Plans of the query's work on parts of the combos."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert registered.queries()[name](spark, SF).count() > 0
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsCount())]
    return [p for p in plans if re.search(r"Location: InMemoryFileIndex\s*\[\S*matched-parts-", p)]


def test_stored_replies_need_contents_once(spark):
    assert len(_plans(spark, "generate_stored")) == 1


def test_texts_are_neither_grouped_nor_sent_back(spark):
    plans = _plans(spark, "generate_stub")
    assert plans and not any("collect_list" in p or "MapInPandas" in p for p in plans)


def test_plain_replies_need_no_python(spark):
    def said(*texts):
        return repr([{"role": "user", "content": t} for t in texts])

    plain = [said("a"), said("ä 漢 😀", "b\n\tc\\n", "\\"), said("")]
    others = ["[\\n{'role': 'user', 'content': 'a'}]", "[{'role': 'user', 'content': 'a\\x41'}]", "[{'ro\\nle': 'user', 'content': 'a'}]", "[{'role':'user', 'content': 'a'}]", "[{'role': 'user', 'content': 'a', }]",
              "[]", "", "no", said("x\x7f"), said("it's"), said('"'), said("a\0"), said("\x1f"), "[{'role': 'user', 'content': 'a\nb'}]", "[{'role': 'user', 'content': 'a'}]x", "[{'role': 'a', 'content': 'b', 'role': 'c'}]", said("y" * 30_000), "[{'role': 'user', 'content': 'a\\'}]", None]
    df = spark.createDataFrame(list(enumerate(plain + others)), "id int, reply string")
    found = {r["id"]: r for r in messages.parse_reply(df.withColumn("told", messages.plain_messages(F.col("reply")))).collect()}
    for i, text in enumerate(plain + others):
        try:
            want = json.dumps(ast.literal_eval(text), ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError):
            want = None
        assert (found[i]["told"] is not None) == (i < len(plain)) and found[i]["parsed"] == (want is not None)
        assert found[i]["content"] == want or want is None
