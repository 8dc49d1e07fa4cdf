"""A ten-node graph whose figures were worked out by hand-written formulas."""

import itertools
import math
import random

import pytest

from tagloom.operators import combos, entropy, taxonomy

EDGES = [(0, 1, 0.5), (1, 2, 0.7), (0, 2, 1.0), (2, 3, 0.43), (3, 4, 0.62), (4, 5, 0.92), (5, 6, 0.13), (6, 7, 0.05), (7, 8, 0.76), (8, 9, 0.61)]


@pytest.fixture(scope="module")
def golden(spark):
    edges = spark.createDataFrame([(*e, "related to") for e in EDGES], "src int, dst int, weight double, relation string").cache()
    nodes = spark.createDataFrame([(i,) for i in range(10)], "node_id int").cache()
    return edges, nodes, taxonomy.entropy_tree(edges, nodes, 3).cache()


def _levels(paths):
    out = {}
    for r in entropy.list_tree(paths).collect():
        out.setdefault(r["level"], set()).add(tuple(r["members"]))
    return out


def test_tree(golden):
    levels = _levels(golden[2])
    assert levels[1] == {(0, 1, 2), (3, 4, 5, 6), (7, 8, 9)}
    assert levels[2] == {(0, 2), (1,), (3, 4), (5, 6), (7,), (8, 9)}
    assert levels[3] == {(i,) for i in range(10)}


def test_rounds_give_the_same_tree(golden):
    assert _levels(taxonomy.entropy_tree(golden[0], golden[1], 3, most_rows=4)) == _levels(golden[2])


@pytest.mark.parametrize(("root", "h_tree", "ratio", "best"), [(False, 1.383103, 0.561745, 0.396444), (True, 1.505155, 0.523071, 0.462840)])
def test_entropies(spark, golden, root, h_tree, ratio, best):
    edges, nodes, paths = golden
    tree = entropy.tree_table(edges, paths, root)
    row = entropy.sweet_spot(edges, tree).first()
    assert row["h1"] == pytest.approx(3.155928, abs=1e-5) and row["h_tree"] == pytest.approx(h_tree, abs=1e-5) and row["ratio"] == pytest.approx(ratio, abs=1e-5)
    starts = spark.createDataFrame([(1, [0, 2])], "id int, node_ids array<int>")
    found = combos.beam_sets(starts, combos.node_paths(tree, paths, nodes), 2, 100).orderBy("rank").collect()
    assert sorted(found[0]["y_ids"]) == [1, 3] and found[0]["entropy"] == pytest.approx(best, abs=1e-5)
    if not root:
        want = {0: 0.225888, 1: 0.210733, 2: 0.201911, 3: 0.185711, 4: 0.167122, 5: 0.159576, 6: 0.182249, 7: 0.126334, 8: 0.096498, 9: 0.123442}
        assert {r["node_id"]: pytest.approx(r["entropy"], abs=1e-5) for r in entropy.node_entropy(tree, paths).collect()} == want
        assert [sorted(r["y_ids"]) for r in found[:4]] == [[1, 3], [1, 6], [1, 4], [1, 5]]


def test_every_parent_splits(golden):
    levels = _levels(golden[2])
    for above, below in itertools.pairwise(sorted(levels)):
        for parent in levels[above]:
            if len(parent) > 1:
                assert sum(set(c) <= set(parent) for c in levels[below]) >= 2


def test_merge_gain_is_the_difference(spark):
    rng = random.Random(5)
    edges = [(a, b, rng.random()) for a, b in itertools.combinations(range(8), 2) if rng.random() < 0.6]
    df = spark.createDataFrame(edges, "src int, dst int, weight double")
    parts = {i: i % 4 for i in range(8)}

    def two_level(part):
        total = 2 * sum(w for *_, w in edges)
        degree = {i: sum(w for a, b, w in edges if i in (a, b)) for i in range(8)}
        out = 0.0
        for c in set(part.values()):
            own = [i for i in part if part[i] == c]
            volume = sum(degree[i] for i in own)
            cut = sum(w for a, b, w in edges if (part[a] == c) != (part[b] == c))
            out += -(cut / total) * math.log2(volume / total) - sum(degree[i] / total * math.log2(degree[i] / volume) for i in own if degree[i])
        return out

    assignment = spark.createDataFrame(list(parts.items()), "node_id int, comm int")
    for r in entropy.merge_gain(df, assignment).collect():
        merged = {i: r["c1"] if c == r["c2"] else c for i, c in parts.items()}
        assert r["delta"] == pytest.approx(two_level(merged) - two_level(parts), abs=1e-9)


def test_sequences_and_paths(spark, golden):
    edges, nodes, paths = golden
    tree = combos.node_paths(entropy.tree_table(edges, paths), paths, nodes)
    starts = spark.createDataFrame([(0, [0])], "id int, node_ids array<int>")
    every = combos.all_sequences(starts, tree, 2).collect()
    assert len(every) == 72
    assert combos.beam_sequences(starts, tree, 2, 1000).orderBy("rank").first()["entropy"] == pytest.approx(max(r["entropy"] for r in every))
    assert combos.all_sequences(starts, tree, 0).first()["y_ids"] == []
    down = combos.beam_sets_local(starts, tree, 3, 10, "code").filter("rank = 1").first()
    up = combos.beam_sets_local(starts, tree, 1, 10, "bottom_up").collect()
    assert 1 <= len(down["y_ids"]) <= 3 and up == []
    found = combos.top_paths(edges, entropy.node_entropy(entropy.tree_table(edges, paths), paths), 2, 2).filter("start = 0").orderBy("rank").collect()
    assert [r["path"] for r in found][0][::2] in (["0", "1", "2"], ["0", "2", "3"])


def test_wide_search_is_exhaustive(spark, golden):
    """Sets of seven at width 100 for all starts, as in production, reach the best of all sets of a small graph."""
    edges, nodes, paths = golden
    table = entropy.tree_table(edges, paths, True)
    tree = combos.node_paths(table, paths, nodes)
    terms = {(r["level"], r["comm"]): round(r["se_term"] * 1e9) for r in table.collect()}
    own = {}
    for r in paths.collect():
        own.setdefault(r["node_id"], set()).add((r["level"], r["comm"]))
    found = {r["start_id"]: (r["y_ids"], r["max_conditional_se"]) for r in combos.combos_for_all_starts(nodes, tree, 7, 100).collect()}
    assert set(found) == set(range(10))
    for start, (ys, value) in found.items():
        score = lambda ids: sum(terms[c] for c in set().union(*(own[i] for i in ids)) - own[start])  # noqa: B023, E731
        best = max(score(ids) for ids in itertools.combinations([i for i in range(10) if i != start], 6))
        assert len(set(ys)) == 6 and start not in ys and score(ys) == best and value == pytest.approx(best / 1e9, abs=1e-12)


@pytest.mark.parametrize("cap", [12, 100_000])
def test_no_merge_is_left(spark, cap):
    """Neither way of merging leaves a pair of communities whose merge would lower the entropy."""
    rng = random.Random(6)
    edges = spark.createDataFrame([(a, b, rng.random()) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.4], "src int, dst int, weight double")
    members = spark.createDataFrame([(i, 0) for i in range(14)], "node_id int, parent int")
    found = taxonomy.min_entropy_partition(edges, members, most_rows=cap, most_pairs=20).select("node_id", "comm").cache()
    assert found.groupBy("comm").agg({"node_id": "min"}).filter("comm <> `min(node_id)`").count() == 0
    assert entropy.merge_gain(edges, found).filter("delta < -1e-9").count() == 0
    want = taxonomy.min_entropy_partition(edges, members).select("node_id", "comm")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.collect()}


def _merged(edges, n):
    """The partition by merging the best of all pairs, everything computed anew each time."""
    part = {i: i for i in range(n)}
    total = 2 * sum(w for *_, w in edges)
    while True:
        volume, cut, between = dict.fromkeys(part.values(), 0.0), dict.fromkeys(part.values(), 0.0), {}
        for a, b, w in edges:
            x, y = part[a], part[b]
            volume[x] += w
            volume[y] += w
            if x != y:
                cut[x] += w
                cut[y] += w
                between[min(x, y), max(x, y)] = between.get((min(x, y), max(x, y)), 0.0) + w
        change = {}
        for (x, y), w in between.items():
            both = volume[x] + volume[y]
            change[x, y] = round((sum((volume[c] - cut[c]) * math.log2(both / volume[c]) for c in (x, y)) + 2 * w * math.log2(both / total)) / total, 12)
        if not change or min(change.values()) >= -1e-12:
            return part
        x, y = min(change, key=lambda p: (change[p], p))
        part = {i: x if c == y else c for i, c in part.items()}


@pytest.mark.parametrize(("seed", "n", "share", "rows"), [(1, 30, 0.1, 40), (2, 30, 0.1, 100_000), (3, 24, 0.9, 200)])
def test_rounds_are_greedy(spark, seed, n, share, rows):
    """Rounds of any size give the partition of merging the best pair each time, on sparse and dense graphs, in each parent."""
    rng = random.Random(seed)
    edges = [(a, b, rng.random()) for a, b in itertools.combinations(range(n), 2) if rng.random() < share]
    more = [(a + n, b + n, w * 3) for a, b, w in edges if a < 10 and b < 10] + [(0, n, 5.0)]
    members = spark.createDataFrame([(i, 0) for i in range(n)] + [(i, n) for i in range(n, 2 * n)], "node_id int, parent int")
    found = taxonomy.min_entropy_partition(spark.createDataFrame(edges + more, "src int, dst int, weight double"), members, most_rows=rows, most_pairs=10)
    second = {i + n: c + n for i, c in _merged([(a - n, b - n, w) for a, b, w in more[:-1]], n).items()}
    assert {r["node_id"]: r["comm"] for r in found.collect()} == _merged(edges, n) | second
