"""Community trees of low structural entropy.

The pair of communities whose merge lowers the entropy most is merged, again and again, until no merge lowers it. Groups
whose edges fit in one task are merged there. Of a larger group each round takes the pairs that lower the entropy most, and
all edges at their ends, into one task, which goes on while no pair outside can come before its next: so every round
carries out the next part of the same sequence of merges, and the partition is the same for every size of a round.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import top_per_group
from ..sources.shared import discard, written
from .entropy import merge_delta

LEAST_GAIN = -1e-12
#: Edges that a task takes at most, and pairs that a round starts from.
MOST_ROWS, MOST_PAIRS = 500_000, 500


class _Groups:
    """The communities of one parent that a task knows, with their edges to one another."""

    def __init__(self) -> None:
        self.volume: dict[int, float] = {}
        self.cut: dict[int, float] = {}
        self.near: dict[int, dict[int, float]] = defaultdict(dict)

    def link(self, a: int, b: int, weight: float) -> None:
        self.near[a][b] = self.near[b][a] = weight

    def delta(self, a: int, b: int, total: float) -> float:
        both = self.volume[a] + self.volume[b]
        own = sum((self.volume[c] - self.cut[c]) * math.log2(both / self.volume[c]) for c in (a, b))
        return round((own + 2 * self.near[a][b] * math.log2(both / total)) / total, 12)

    def merges(self, total: float, active: set[int], floor: float = math.inf) -> dict[int, int]:
        """Which community goes into which, in the order of least delta, then least numbers.

        Only active communities, of which all edges are known, are merged; the first pair that isn't of two of these, or
        that doesn't come before `floor`, ends the sequence. One merge at least is made if there is any.
        """
        into: dict[int, int] = {}
        version: dict[int, int] = defaultdict(int)
        heap = [(self.delta(a, b, total), a, b, 0, 0) for a in self.near for b in self.near[a] if a < b and (a in active or b in active)] if total > 0 else []
        heapq.heapify(heap)
        while heap and heap[0][0] < LEAST_GAIN:
            d, a, b, va, vb = heapq.heappop(heap)
            if a in into or b in into or version[a] != va or version[b] != vb:
                continue
            if into and d >= floor - 2e-12:
                break
            if a not in active or b not in active:
                if into:
                    break
                continue
            weight = self.near[a].pop(b)
            self.cut[a] += self.cut[b] - 2 * weight
            self.volume[a] += self.volume[b]
            into[b] = a
            version[a] += 1
            others = self.near.pop(b)
            del others[a]
            for c, w in others.items():
                del self.near[c][b]
                self.link(a, c, self.near[a].get(c, 0.0) + w)
            for c in self.near[a]:
                x, y = min(a, c), max(a, c)
                heapq.heappush(heap, (self.delta(x, y, total), x, y, version[x], version[y]))
        return into


def _rows(parent: int, into: dict[int, int]) -> pd.DataFrame:
    def root(c: int) -> int:
        while c in into:
            c = into[c]
        return c

    return pd.DataFrame({"parent": [parent] * len(into), "comm": list(into), "into": [root(c) for c in into]}, dtype="int32")


def _whole(group: pd.DataFrame) -> pd.DataFrame:
    """All merges of one parent: rows (parent, c1, c2, weight), c1 = c2 for what lies inside."""
    groups, volume, inside = _Groups(), defaultdict(float), defaultdict(float)
    for a, b, w in zip(group["c1"].tolist(), group["c2"].tolist(), group["weight"].tolist(), strict=True):
        volume[a] += w
        volume[b] += w
        if a == b:
            inside[a] += 2 * w
        else:
            groups.link(a, b, w)
    groups.volume, groups.cut = dict(volume), {c: v - inside[c] for c, v in volume.items()}
    return _rows(int(group["parent"].iloc[0]), groups.merges(sum(volume.values()), set(volume)))


def _part(group: pd.DataFrame) -> pd.DataFrame:
    """The next merges of one parent: edges of the active communities, with both ends' volume and cut."""
    groups, active = _Groups(), set()
    for r in group.itertuples(index=False):
        for c, v, g, known in ((r.c1, r.v1, r.g1, r.in1), (r.c2, r.v2, r.g2, r.in2)):
            groups.volume[c], groups.cut[c] = v, g
            if known:
                active.add(c)
        groups.link(r.c1, r.c2, r.weight)
    first = group.iloc[0]
    return _rows(int(first["parent"]), groups.merges(float(first["total"]), active, math.inf if pd.isna(first["floor"]) else float(first["floor"])))


def _contracted(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(parent, c1, c2, weight) between and inside communities of one parent; members: (node_id, parent, comm)."""
    a = members.select(F.col("node_id").alias("src"), "parent", F.col("comm").alias("x"))
    b = members.select(F.col("node_id").alias("dst"), "parent", F.col("comm").alias("y"))
    inner = edges.join(a, "src").join(b, ["dst", "parent"])
    return inner.groupBy("parent", F.least("x", "y").alias("c1"), F.greatest("x", "y").alias("c2")).agg(F.sum("weight").alias("weight"))


def _next_part(pairs: DataFrame, most_rows: int, most_pairs: int) -> DataFrame:
    """Edges (parent, c1, c2, weight, v1, g1, in1, ..., total, floor) of the communities that the next merges of each parent start from."""
    out = F.col("c1") != F.col("c2")
    ends = pairs.select("parent", F.explode(F.array(F.struct(F.col("c1").alias("comm"), "weight", out.alias("out")), F.struct(F.col("c2").alias("comm"), "weight", out.alias("out")))).alias("e")).select("parent", "e.*")
    stats = written(ends.groupBy("parent", "comm").agg(F.sum("weight").alias("v"), F.sum(F.when(F.col("out"), F.col("weight")).otherwise(0.0)).alias("g"), F.sum(F.col("out").cast("long")).alias("n")), "community-stats")
    total = stats.groupBy("parent").agg(F.sum("v").alias("total"))
    s1, s2 = (stats.select("parent", F.col("comm").alias(f"c{i}"), F.col("v").alias(f"v{i}"), F.col("g").alias(f"g{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    known = pairs.filter(out).join(s1, ["parent", "c1"]).join(s2, ["parent", "c2"]).join(total, "parent")
    known = known.withColumn("delta", F.round(merge_delta(*(F.col(c) for c in ("v1", "g1", "v2", "g2", "weight", "total"))), 12))
    least = top_per_group(known.filter(F.col("delta") < LEAST_GAIN), ["parent"], [F.col("delta"), F.col("c1"), F.col("c2")], most_pairs)
    # at most `most_pairs` rows a parent from here: those whose ends have few enough edges together
    w = Window.partitionBy("parent").orderBy("rank")
    least = written(least.withColumn("chosen", (F.col("rank") == 1) | ((F.sum(F.col("n1") + F.col("n2")).over(w) <= most_rows) & (F.col("rank") < most_pairs))), "least-pairs")
    floors = least.groupBy("parent").agg(F.min(F.when(~F.col("chosen"), F.col("delta"))).alias("floor"))
    active = least.filter("chosen").select("parent", F.explode(F.array("c1", "c2")).alias("c")).distinct()
    in1, in2 = (active.select("parent", F.col("c").alias(f"c{i}"), F.lit(True).alias(f"in{i}")) for i in (1, 2))
    joined = known.join(in1, ["parent", "c1"], "left").join(in2, ["parent", "c2"], "left").join(floors, "parent")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in1", "in2")}).filter("in1 or in2").select("parent", "c1", "c2", "weight", "v1", "g1", "in1", "v2", "g2", "in2", "total", "floor")


def min_entropy_partition(edges: DataFrame, members: DataFrame, most_rows: int = MOST_ROWS, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(node_id, parent, comm): inside each parent the partition that greedy merging gives; comm is the least member.

    members: (node_id, parent). Nodes without an edge inside their parent stay alone. The partition doesn't depend on
    most_rows, the edges that one task takes, nor on most_pairs, the pairs that a round starts from.
    """
    held = written(members.withColumn("comm", F.col("node_id")), "partition")
    kind = "parent int, comm int, into int"
    left = None
    while True:
        all_pairs = _contracted(edges, held if left is None else held.join(left, "parent", "left_semi"))
        pairs = written(all_pairs, "partition-pairs")
        large = written(pairs.groupBy("parent").agg(F.count("*").alias("n")).filter(F.col("n") > most_rows).select("parent"), "partition-large")
        more = bool(large.take(1))
        small = pairs.join(large, "parent", "left_anti") if more else pairs
        merges = small.groupBy("parent").applyInPandas(_whole, kind)
        if more:
            part = written(_next_part(pairs.join(large, "parent", "left_semi"), most_rows, most_pairs).groupBy("parent").applyInPandas(_part, kind), "partition-part")
            merges, left = merges.unionByName(part), part.select("parent").distinct()
        moved = written(merges, "partition-merges")
        held = written(held.join(moved, ["parent", "comm"], "left").select("node_id", "parent", F.coalesce("into", "comm").alias("comm")), "partition")
        discard(pairs)
        if not more or not left.take(1):
            return held


def entropy_tree(edges: DataFrame, nodes: DataFrame, levels: int = 4, most_rows: int = MOST_ROWS) -> DataFrame:
    """paths (node_id, level, comm) of a tree with `levels` levels below the root, each split by its own subgraph.

    A community of one node is carried down. levels below 2: every node in one community.
    """
    ids = nodes.select(F.col("node_id").cast("int").alias("node_id"))
    if levels <= 1:
        return ids.select("node_id", F.lit(1).alias("level"), F.lit(0).alias("comm"))
    edges = written(edges.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "weight"), "tree-edges")
    out, above = None, ids.withColumn("parent", F.lit(0))
    for level in range(1, levels + 1):
        found = min_entropy_partition(edges, above, most_rows)
        rows = found.select("node_id", F.lit(level).alias("level"), "comm")
        out = rows if out is None else out.unionByName(rows)
        above = found.select("node_id", F.col("comm").alias("parent"))
    return out
