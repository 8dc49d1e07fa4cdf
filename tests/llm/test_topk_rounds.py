"""Top-k search whose queries are copied to all shards: no copies in a broadcast, rounds of bounded size, whole shards."""

import numpy as np
import pytest

from tagloom.llm import topk


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    found = rng.integers(-6, 7, size=(3000, 4)).astype(float)
    found[1500:1600] = found[:100]
    return found


@pytest.fixture(scope="module")
def rows(spark, vectors):
    return spark.createDataFrame([(i % 2900, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<float>")


def _want(vectors, k):
    """Ties and rows of one id as top_k() states them."""
    ids, whole = np.arange(len(vectors)) % 2900, (256 * vectors).astype(int)
    best = {}
    for at in np.flatnonzero(ids % 50 == 0):
        best.setdefault(int(ids[at]), []).extend((-int(s), int(i)) for s, i in zip(whole @ whole[at], ids, strict=True) if i != ids[at])
    return {(q, r + 1, i, -s) for q, found in best.items() for r, (s, i) in enumerate(sorted(found)[:k])}


def test_copied_queries_are_not_broadcast(spark, rows, vectors):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert {tuple(r) for r in topk.top_k(rows, tile=32).collect()} == _want(vectors, 5)
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsCount())]
    assert plans and not any("BroadcastExchange" in p for p in plans)


@pytest.mark.parametrize("k", [5, 300])
def test_rounds_give_the_same(rows, vectors, k):
    assert {tuple(r) for r in topk.top_k(rows, k=k, tile=64, fan_in=3, wide=2, share=0.1, least=1).collect()} == _want(vectors, k)
    assert {tuple(r) for r in topk.top_k(rows, k=k, tile=4096).collect()} == _want(vectors, k)
