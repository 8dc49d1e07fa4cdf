"""Hand-made rows for the cases that the tables don't have."""

import pytest
from pyspark.sql import functions as F

from tagloom.functions import messages, ordering
from tagloom.operators import curriculum, graph, synthesis, training
from tagloom.sources import files


def test_labels(spark):
    rows = ["{'ability_zh': ['a','b']}", "{'ability_zh': ['a'], 'x': None}", "{'ability_zh': []}", "[1]", "not a literal", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id int, label string")
    assert {r["id"]: r["tags"] for r in messages.extract_tags(df).collect()} == {0: ["a", "b"], 1: ["a"]}


def test_counts_and_weights(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([["a", "b"], ["a"], ["a", "a"], ["a", "a", "b"]])], "id int, tags array<string>")
    assert {r["tag"]: r["n"] for r in graph.tag_counts(df).collect()} == {"a": 6, "b": 2}
    row = graph.skill_graph(df).collect()
    assert [(r["a"], r["b"], r["co"]) for r in row] == [("a", "b", 3)] and row[0]["weight"] == pytest.approx(5 / 7 / 3)
    empty = df.filter("false")
    assert graph.skill_graph(empty).count() == 0 and graph.graph_volume(graph.indexed_edges(graph.skill_graph(empty), graph.node_ids(graph.graph_nodes(graph.skill_graph(empty))))).first()["volume"] == 0


@pytest.mark.parametrize(
    ("value", "plain", "no_cjk"),
    [
        ('{"content":[{"role":"user","content":"x"}]}', "ok", "ok"),
        ('{"content":[{"role":"user","content":1}]}', "ok", "ok"),
        ('{"content":[{"role":"user","content":1.5}]}', "ok", "ok"),
        ('{"content":[{"role":"user","content":true}]}', "ok", "ok"),
        ('{"content":[{"role":"user","content":null}]}', "invalid", "invalid"),
        ('{"content":[{"role":"user"}]}', "invalid", "invalid"),
        ('{"content":[{"content":"x"}]}', "invalid", "invalid"),
        ('{"content":[{"role":"user","content":{}}]}', "invalid", "invalid"),
        ('{"content":[{"role":"user","content":[]}]}', "invalid", "invalid"),
        ('{"content":["x"]}', "invalid", "invalid"),
        ('{"content":[]}', "invalid", "invalid"),
        ('{"content":"x"}', "invalid", "invalid"),
        ('{"other":1}', "invalid", "invalid"),
        ("no json", "invalid", "invalid"),
        ('{"content":[{"role":"user","content":"中"},{"role":"user"}]}', "invalid", "chinese"),
        ('{"content":[{"role":"user"},{"role":"user","content":"中"}]}', "invalid", "invalid"),
    ],
)
def test_dialogues(spark, value, plain, no_cjk):
    df = spark.createDataFrame([(value,)], "value string").withColumn("v", F.try_parse_json("value"))
    row = df.select(messages.dialogue_reason(F.col("v")).alias("a"), messages.dialogue_reason(F.col("v"), True).alias("b")).first()
    assert (row["a"], row["b"]) == (plain, no_cjk)


def test_scalars_as_text(spark):
    df = spark.createDataFrame([('{"content":[{"role":"user","content":true},{"role":"user","content":7},{"role":"user","content":1.5}]}',)], "value string").withColumn("v", F.try_parse_json("value"))
    assert [m["content"] for m in messages.valid_dialogues(df).first()["content"]] == ["True", "7", "1.5"]


def test_replies(spark):
    said = "[{'role': 'user', 'content': 'a'}]"
    rows = [said, f"```python\n{said}\n```", f"```\n{said}\n```", "plain prose", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id int, reply string")
    got = {r["id"]: (r["parsed"], r["content"]) for r in messages.parse_reply(df).collect()}
    want = '[{"role": "user", "content": "a"}]'
    assert [got[i] for i in range(3)] == [(True, want)] * 3
    assert got[3] == (False, '"plain prose"') and got[4][0] is False and got[5][0] is False


def test_split_bounds():
    assert training.split_bounds(9, "2,4,4") == [0, 1, 5, 9]


def test_packing(spark):
    rows = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6, 7, 8]), (2, [9, 10, 11, 12])], "position long, token_ids array<int>")
    got = training.pack_sequences(rows, 5).orderBy("block").collect()
    assert [r["input_ids"] for r in got] == [[1, 2, 3, 4, 5], [6, 7, 8, 9, 10]]
    assert [r["labels"] for r in training.pack_sequences(rows.limit(1), 5).collect()] == [[1, 2, 3]]


def test_divergence(spark):
    rows = spark.createDataFrame([(0, [1, 2, 0, 0], [1, 3, 4, 0]), (1, [1, 2, 0], [1, 2, 0]), (2, [1, 2], [1, 3])], "id int, chosen_ids array<int>, rejected_ids array<int>")
    got = {r["id"]: (r["divergence"], r["end"]) for r in training.pair_divergence(rows, 0).collect()}
    assert got == {0: (1, 3), 1: (2, 3), 2: (1, 2)}


def test_missing_files(spark, tmp_path):
    assert files.read_tagged(spark, str(tmp_path / "none")).count() == 0
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    assert [r["a"] for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").orderBy("a").collect()] == [1, 2]


def test_ranked_index(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    rows = ordering.ranked_index(df, ["g", "id"], "idx", by=["g"]).collect()
    assert all(r["idx"] == r["id"] // 3 for r in rows)


def test_epochs(spark):
    pools = spark.createDataFrame([(2, i) for i in range(5)] + [(3, i) for i in range(100, 140)], "k int, id long")
    weights = {1: {2: 0.5, 3: 0.5}, 2: {2: 0.1, 3: 0.9}, 3: {2: 0.1, 3: 0.9}}
    quotas = curriculum.epoch_quotas(pools, weights, 30)
    rows = curriculum.order_epochs(curriculum.sample_epochs(pools, quotas)).collect()
    assert sorted((e, sum(r["epoch"] == e for r in rows)) for e in (1, 2, 3)) == [(1, 30), (2, 30), (3, 30)]
    three = [r["id"] for r in sorted(rows, key=lambda r: (r["epoch"], r["slot"])) if r["k"] == 3]
    assert len(set(three[:40])) == 40 and three[40:] == three[: len(three) - 40]
    assert sorted(r["position"] for r in rows if r["epoch"] == 2) == list(range(30))


def test_balanced_tags(spark):
    rows = spark.createDataFrame([(i, ["a", "b", "c"][: 1 + i % 3]) for i in range(300)], "id long, tags array<string>")
    for rounds in (1, 10):
        got = synthesis.assign_single_tag(rows, rounds=rounds)
        assert got.count() == 300
        counts = {r["single_ability_tag"]: r["count"] for r in got.groupBy("single_ability_tag").count().collect()}
        assert sum(counts.values()) == 300


def test_generate_retries(spark):
    df = spark.createDataFrame([("good",), ("bad",)], "prompt string")

    def call(prompt):
        if prompt == "bad":
            raise ValueError(prompt)
        return prompt.upper()

    assert [r["reply"] for r in synthesis.generate(df, call, wait=0.0).collect()] == ["GOOD"]


def test_tokenizer_hook(spark):
    df = spark.createDataFrame([([("a b", 0), ("c", 1)],)], "segments array<struct<text:string,mask:int>>")
    row = training.tokenize_segments(df, lambda texts: [[len(w) for w in t.split()] for t in texts]).first()
    assert row["token_ids"] == [1, 1, 1] and row["loss_mask"] == [0, 0, 1]


def test_sources_stop_at_enough_combos(spark):
    atomic = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "id long, single_ability_tag string")
    combos = spark.createDataFrame([(i, ["a", "b", "missing"]) for i in range(4)], "combo_id long, tags array<string>")
    got = synthesis.match_sources(combos, synthesis.tag_index(atomic), on_missing="substitute", most=2).collect()
    assert sorted((r["combo_id"], r["pos"]) for r in got) == [(c, p) for c in (0, 1) for p in range(3)] and all(r["tag"] in "ab" for r in got)


def test_shared_folder(spark):
    from tagloom.sources import shared

    named = spark.conf.get("spark.checkpoint.dir")
    assert shared.shared_dir(spark) == named.rstrip("/")


@pytest.mark.parametrize("master,local", [("local", True), ("local[4]", True), ("local[*]", True), ("local-cluster[3,2,1024]", False), ("yarn", False)])
def test_no_machine_folder_on_a_cluster(master, local):
    from types import SimpleNamespace

    from tagloom.sources import shared

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master=master))
    if local:
        assert shared.shared_dir(session).startswith("file://")
    else:
        with pytest.raises(ValueError):
            shared.shared_dir(session)
