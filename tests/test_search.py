"""The search over the index against a plain one that looks at every node, and paths against all paths."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import combos


def _random_tree(rng, n, levels):
    """(paths, tree): nested random communities; some nodes have no path, some share their last community."""
    paths, terms = [], {}
    for node in range(n):
        if rng.random() < 0.05:
            continue
        comm = 0
        for level in range(1, levels + 1):
            comm = comm * 3 + rng.randrange(3)
            paths.append((node, level, comm))
            terms.setdefault((level, comm), rng.choice([0.0, 0.125, 0.25, 0.375, rng.random()]))
    return paths, terms


def _plain(own, terms, n, given, size, width, dedupe, rings=None):
    """The beam that scores every node in every state; ties by the state's rank, then by id."""
    units = {c: round(t * 1e9) for c, t in terms.items()}
    base = set().union(*(own[i] for i in given)) if given else set()
    states = [([], 0)]
    for turn in range(size):
        ring = None if rings is None else rings[min(turn, len(rings) - 1)]
        found = []
        for rank, (taken, value) in enumerate(states):
            held = base.union(*(own[i] for i in taken))
            found += [(-(value + sum(units[c] for c in own[v] - held)), rank, v) for v in range(n) if v not in given and v not in taken and (ring is None or ring in own[v])]
        if not found:
            break
        kept, seen = [], set()
        for less, rank, v in sorted(found):
            taken = [*states[rank][0], v]
            if dedupe and frozenset(taken) in seen:
                continue
            seen.add(frozenset(taken))
            kept.append((taken, -less))
            if len(kept) == width:
                break
        states = kept
    return [(t, v / 1e9) for t, v in states if t]


@pytest.fixture(scope="module")
def random_tree(spark):
    rng = random.Random(12)
    n = 60
    paths, terms = _random_tree(rng, n, 4)
    own = {i: {(level, c) for node, level, c in paths if node == i} for i in range(n)}
    frames = (spark.createDataFrame([(*k, v) for k, v in terms.items()], "level int, comm int, se_term double"), spark.createDataFrame(paths, "node_id int, level int, comm int"), spark.range(n).select(F.col("id").cast("int").alias("node_id")))
    starts = {i: rng.sample(range(n), rng.randrange(1, 4)) for i in range(12)} | {12: [5, 5, 7], 13: [n + 3], 14: []}
    return combos.node_paths(*frames), own, terms, n, starts, spark.createDataFrame(list(starts.items()), "id int, node_ids array<int>")


def _of(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["y_ids"], pytest.approx(r["entropy"], abs=1e-12)))
    return out


@pytest.mark.parametrize(("size", "width"), [(1, 7), (3, 1), (3, 5), (4, 9)])
def test_beams(random_tree, size, width):
    tree, own, terms, n, starts, rows = random_tree
    known = {i: [v for v in s if v < n] for i, s in starts.items()}
    assert {i: [(t, v) for t, v in f] for i, f in _of(combos.beam_sets(rows, tree, size, width)).items()} == {i: _plain(own, terms, n, s, size, width, True) for i, s in known.items()}
    assert _of(combos.beam_sequences(rows, tree, size, width)) == {i: _plain(own, terms, n, s, size, width, False) for i, s in known.items()}


@pytest.mark.parametrize("expand", ["code", "bottom_up"])
def test_local_beams(random_tree, expand):
    tree, own, terms, n, starts, rows = random_tree
    want = {}
    for i, s in starts.items():
        given = {v for v in s if v < n}
        shared = sorted(set.intersection(*(own[v] for v in given))) if given else []
        rings = [None, *shared]
        rings = rings[::-1] if expand == "bottom_up" else rings + [None] * max(0, 3 - len(rings))
        states = _plain_ringed(own, terms, n, given, 3, 6, rings)
        if states:
            want[i] = states
    assert _of(combos.beam_sets_local(rows, tree, 3, 6, expand)) == want


def _plain_ringed(own, terms, n, given, size, width, rings):
    everything = {v: own[v] | {"root"} for v in own}
    return _plain(everything, terms | {"root": 0.0}, n, given, size, width, True, ["root" if r is None else r for r in rings])


def test_repeated_starts(random_tree, spark):
    tree, own, terms, n, _, _ = random_tree
    rows = spark.createDataFrame([(1, [0]), (1, [0]), (1, [9])], "id int, node_ids array<int>")
    got = sorted((r["rank"], r["y_ids"]) for r in combos.beam_sets(rows, tree, 2, 3).collect())
    assert got == sorted((k + 1, t) for s in ([0], [0], [9]) for k, (t, _) in enumerate(_plain(own, terms, n, s, 2, 3, True)))
    assert combos.beam_sets(rows.filter("false"), tree, 2, 3).count() == 0
    assert combos.beam_sets(rows, tree, 0, 3).count() == 0


def test_all_sequences(random_tree, spark):
    tree, own, terms, n, _, _ = random_tree
    rows = spark.createDataFrame([(4, [0, 3])], "id int, node_ids array<int>")
    got = combos.all_sequences(rows, tree, 3).orderBy("rank").collect()
    base = own[0] | own[3]
    units = {c: round(t * 1e9) for c, t in terms.items()}
    want = []
    for ys in itertools.combinations([v for v in range(n) if v not in (0, 3)], 3):
        value = sum(units[c] for c in set().union(*(own[v] for v in ys)) - base)
        want += [(-value, p) for p in itertools.permutations(ys)]
    want.sort()
    assert [tuple(r["y_ids"]) for r in got] == [p for _, p in want] and got[0]["entropy"] == pytest.approx(-want[0][0] / 1e9)
    few = spark.createDataFrame([(4, list(range(2, n)))], "id int, node_ids array<int>")
    assert sorted(r["y_ids"] for r in combos.all_sequences(few, tree, 3).collect()) == [[0, 1], [1, 0]]


def test_index_rows_are_bounded(random_tree, spark):
    """A community's row holds nodes for the beam, not all it has: a tree of 200,000 nodes, one community with most of them."""
    n = 200_000
    nodes = spark.range(n).select(F.col("id").cast("int").alias("node_id"))
    comm = F.when(F.col("node_id") % 10 < 8, 0).otherwise(F.col("node_id") % 1000)
    paths = nodes.select("node_id", F.explode(F.array(F.struct(F.lit(1).alias("level"), comm.alias("comm")), F.struct(F.lit(2).alias("level"), F.col("node_id").alias("comm")))).alias("p")).select("node_id", "p.*")
    tree = paths.select("level", "comm").distinct().withColumn("se_term", F.pmod(F.xxhash64("level", "comm"), F.lit(1000)) / 1000)
    full = combos.node_paths(tree, paths, nodes)
    index = combos.search_index(full, 10, 4)
    assert index.agg(F.max(F.size("nodes"))).first()[0] <= 5 * 24
    starts = spark.createDataFrame([(1, [7]), (2, [8, 199_999])], "id int, node_ids array<int>")
    found = combos.beam_sets(starts, full, 3, 10).filter("rank = 1").collect()
    assert len(found) == 2 and all(len(set(r["y_ids"])) == 3 for r in found)


@pytest.mark.parametrize("length", [1, 2, 4])
def test_top_paths(spark, length):
    rng = random.Random(length)
    n, k = 24, 3
    links = {(rng.randrange(n), rng.randrange(n)) for _ in range(110)}
    value = {i: rng.choice([0.5, 1.0, rng.random()]) for i in range(n)}
    edges = spark.createDataFrame([(a, b, "to") for a, b in links if a != b], "src int, dst int, relation string")
    entropy = spark.createDataFrame(list(value.items()), "node_id int, entropy double")
    want = {}
    near = {i: sorted(b for a, b in links if a == i and b != i) for i in range(n)}
    for s in range(n):
        full = [(s,)]
        for _ in range(length):
            full = [(*p, v) for p in full for v in near[p[-1]] if v not in p]
        want[s] = sorted(full, key=lambda p: (-round(sum(value[v] for v in p), 9), p))[:k]
    got = {}
    for r in combos.top_paths(edges, entropy, length, k).orderBy("start", "rank").collect():
        got.setdefault(r["start"], []).append(tuple(int(x) for x in r["path"][::2]))
    assert got == {s: p for s, p in want.items() if p}
