"""Search for tag combinations of high conditional entropy over a community tree.

H(Y | X) is the sum of the terms of communities above Y that hold no node of X, so the gain of a node is the part of
its path below the deepest community that is covered already. An index holds, for each community, its nodes of largest
remaining path sum: a state looks up the communities it covers and nothing else, whatever the number of nodes. All
starts are searched in one job, a turn at a time: states are rows, joined to the index rows of the communities
that they cover. Terms count in whole units of 1e-9, so that equal gains tie in every order of addition.

Communities must be nested. Where a start (id, node_ids) names nodes that the tree doesn't have, these count for nothing.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import ranked_index, top_per_group
from ..sources.files import write_in_batches
from ..sources.shared import discard, written

#: Units of a term; the step between the numbers of two levels' communities; the root's number; parts that a community's nodes are ranked in first.
UNIT, LEVEL, ROOT, SALTS = 10**9, 1 << 32, 0, 32

_STATES = "array<struct<taken:array<int>,value:bigint,keys:array<bigint>>>"


def node_paths(tree: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, path): the communities (key, units) of all nodes (node_id), from the top; none where a node has no path."""
    key = F.col("level").cast("long") * LEVEL + F.col("comm")
    each = paths.join(tree.select("level", "comm", "se_term"), ["level", "comm"]).filter(F.col("se_term").isNotNull())
    own = each.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct(key.alias("key"), F.rint(F.col("se_term") * UNIT).cast("long").alias("units")))).alias("path"))
    found = nodes.select(F.col("node_id").cast("int").alias("node_id")).join(own, "node_id", "left")
    none = F.array().cast("array<struct<key:bigint,units:bigint>>")
    return written(found.select("node_id", F.coalesce("path", none).alias("path")), "node-paths")


def _sum(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0).cast("long"), lambda n, e: n + e["units"])


def _foremost(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n rows of largest gain of each group, ranked in parts first, so that no task takes a large group whole."""
    for group in ([*by, "salt"], by):
        rows = top_per_group(rows, group, [F.col("gain").desc(), F.col("node_id")], n).drop("rank")
    return rows


def search_index(tree: DataFrame, width: int, most: int) -> DataFrame:
    """(key, nodes, gains, children, keys): for each community of node_paths() its foremost nodes, by the sum of their
    path below it; the community below it that each is in, or -1; and all communities of each.

    A state of a beam of `width` passes on at most 2 * width nodes, and at most `most` nodes are used already. So
    that many nodes of each child are enough, and of all children that many for each child that may be covered.
    """
    each = 2 * width + most
    depth = F.explode(F.sequence(F.lit(0), F.size("path"))).alias("depth")
    rows = tree.select("node_id", "path", depth).select(
        F.when(F.col("depth") == 0, F.lit(ROOT).cast("long")).otherwise(F.get("path", F.col("depth") - 1)["key"]).alias("key"),
        "node_id",
        _sum(F.slice("path", F.col("depth") + 1, F.greatest(F.size("path"), F.lit(1)))).alias("gain"),
        F.coalesce(F.get("path", F.col("depth"))["key"], F.lit(-1)).alias("child"),
        F.col("path.key").alias("keys"),
        F.pmod(F.xxhash64("node_id"), F.lit(SALTS)).alias("salt"),
    )
    kept = _foremost(_foremost(rows, ["key", "child"], each), ["key"], (most + 1) * each)
    lists = kept.groupBy("key").agg(F.collect_list(F.struct("node_id", "gain", "child", "keys")).alias("e"))
    return written(lists.select("key", F.col("e.node_id").alias("nodes"), F.col("e.gain").alias("gains"), F.col("e.child").alias("children"), F.col("e.keys").alias("keys")), "search-index")


def _begun(starts: DataFrame, tree: DataFrame, local: str | None, size: int) -> DataFrame:
    """(row, id, given, covered, rings, states, open) before the first turn."""
    rows = written(starts.select(F.monotonically_increasing_id().alias("row"), "id", F.array_distinct("node_ids").alias("node_ids")), "search-starts")
    members = rows.select("row", F.explode("node_ids").alias("node_id")).join(tree, "node_id")
    found = members.groupBy("row").agg(F.collect_list("node_id").alias("given"), F.flatten(F.collect_list("path.key")).alias("all"))
    ints, longs = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    joined = rows.join(found, "row", "left").select("row", "id", F.coalesce("given", ints).alias("given"), F.coalesce("all", longs).alias("all"))
    covered = F.array_distinct("all")
    rings = F.array(F.lit(ROOT).cast("long"))
    if local:
        shared = F.array_sort(F.filter(covered, lambda k: F.size(F.filter("all", lambda x: x == k)) == F.size("given")))
        rings = F.concat(rings, shared)
        rings = F.reverse(rings) if local == "bottom_up" else F.concat(rings, F.array_repeat(F.lit(ROOT).cast("long"), F.greatest(F.lit(0), F.lit(size) - F.size(rings))))
    first = F.array(F.struct(ints.alias("taken"), F.lit(0).cast("long").alias("value"), longs.alias("keys")))
    return joined.select("row", "id", "given", covered.alias("covered"), rings.alias("rings"), first.cast(_STATES).alias("states"), F.lit(True).alias("open"))


def _extended(given: list[int], covered: list[int], ring: int, states: list[dict], lists: pa.Table, width: int, dedupe: bool) -> list[dict]:
    """The next turn's states, best first, from the index rows of all communities that the states cover; none if no node is left."""
    def flat(c: str) -> pa.Array:
        return pa.concat_arrays([x.flatten() for x in lists.column(c).chunks])

    node, gain, child = (flat(c).to_numpy() for c in ("nodes", "gains", "children"))
    sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists.column("nodes").chunks])
    own = np.repeat(lists.column("key").to_numpy(), sizes)
    keys = flat("keys")
    local = np.unique(np.concatenate([own, [ROOT, -1]]))
    here = lambda x: np.searchsorted(local, x)[np.isin(x, local)]  # noqa: E731  keys without an index row are covered by no state
    held = np.zeros((len(states), len(local)), dtype=bool)
    held[:, here(np.array([ROOT, *covered], dtype=np.int64))] = True
    for i, s in enumerate(states):
        held[i, here(np.array(s["keys"], dtype=np.int64))] = True
    by = np.lexsort((node, -gain))
    by = by[~np.isin(node[by], given)]
    if ring != ROOT:
        inside = np.zeros(len(node), dtype=bool)
        inside[np.repeat(np.arange(len(node)), np.diff(keys.offsets.to_numpy()))[keys.flatten().to_numpy() == ring]] = True
        by = by[inside[by]]
    at_child = np.searchsorted(local, child[by])
    at_child = np.where(local[np.minimum(at_child, len(local) - 1)] == child[by], at_child, np.searchsorted(local, -1))
    open_ = held[:, np.searchsorted(local, own[by])] & ~held[:, at_child]
    for i, s in enumerate(states):
        open_[i, np.isin(node[by], s["taken"])] = False
    open_ &= np.cumsum(open_, axis=1) <= width + len(states)
    parent, column = np.nonzero(open_)
    entry = by[column]
    total = np.array([s["value"] for s in states], dtype=np.int64)[parent] + gain[entry]
    out, seen = [], set()
    for k in np.lexsort((node[entry], parent, -total)).tolist():
        state, e = states[parent[k]], int(entry[k])
        taken = [*state["taken"], int(node[e])]
        if dedupe and (key := frozenset(taken)) in seen:
            continue
        if dedupe:
            seen.add(key)
        out.append({"taken": taken, "value": int(total[k]), "keys": sorted({*state["keys"], *keys[e].as_py()})})
        if len(out) == width:
            break
    return out


def _turn(states: DataFrame, index: DataFrame, turn: int, width: int, dedupe: bool) -> DataFrame:
    """One more node for every state; starts that have no node left keep their states."""
    wanted = F.array_distinct(F.concat(F.array(F.lit(ROOT).cast("long")), "covered", F.flatten("states.keys")))
    lists = states.filter("open").select(F.col("row").alias("of"), F.explode(wanted).alias("key")).join(index, "key")
    schema = states.schema
    names = states.columns

    def run(key: tuple, own: pa.Table, lists: pa.Table) -> pa.Table:
        rows = own.to_pylist()
        for row in rows:
            rings = row["rings"]
            found = _extended(row["given"], row["covered"], rings[min(turn, len(rings) - 1)], row["states"], lists, width, dedupe) if row["open"] and lists.num_rows else []
            row["open"] = bool(found)
            row["states"] = found or row["states"]
        return pa.Table.from_pylist(rows, schema=own.schema).select(names)

    return states.groupBy("row").cogroup(lists.groupBy("of")).applyInArrow(run, schema)


def _beam(starts: DataFrame, tree: DataFrame, size: int, width: int, dedupe: bool = True, local: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """(id, rank, y_ids, entropy): for each start the sequences that are left after `size` turns, best first."""
    states = written(_begun(starts, tree, local, size), "search-states")
    if size > 0:
        made = index is None
        if made:
            index = search_index(tree, width, (states.agg(F.max(F.size("given"))).first()[0] or 0) + size)
        for turn in range(size):
            states, before = written(_turn(states, index, turn, width, dedupe), "search-states"), states
            discard(before)
        if made:
            discard(index)
    each = states.select("id", F.posexplode("states").alias("pos", "s")).filter(F.size("s.taken") > 0)
    return each.select("id", (F.col("pos") + 1).alias("rank"), F.col("s.taken").alias("y_ids"), (F.col("s.value") / F.lit(float(UNIT))).alias("entropy"))


def beam_sets(starts: DataFrame, tree: DataFrame, size: int, width: int) -> DataFrame:
    """For each start set (id, node_ids) the best sets of `size` other nodes; one sequence is kept for a set. Ties go to the
    sequence whose beginning ranks first, then to the smaller id. tree: node_paths()."""
    return _beam(starts, tree, size, width)


def beam_sequences(starts: DataFrame, tree: DataFrame, size: int, width: int) -> DataFrame:
    """As beam_sets(), but orders of one set are different sequences."""
    return _beam(starts, tree, size, width, dedupe=False)


def greedy_set(starts: DataFrame, tree: DataFrame, size: int) -> DataFrame:
    """Adds, `size` times, the node of the highest entropy given the start; ties go to the smallest id."""
    return beam_sets(starts, tree, size, 1)


def beam_sets_local(starts: DataFrame, tree: DataFrame, size: int, width: int, expand: str = "code") -> DataFrame:
    """As beam_sets(), but turn t draws from the t-th community that holds the whole start: from the root down
    (expand='code') or from the deepest up to the root (expand='bottom_up'); beyond the last, from that again."""
    return _beam(starts, tree, size, width, local=expand)


def all_sets(starts: DataFrame, tree: DataFrame, size: int) -> DataFrame:
    """(row, id, y_ids, units): every set of `size` other nodes, or of all if there are fewer, in ascending order.

    Sets grow by nodes of a larger id, so that each is made once and rows are dealt by what they begin with.
    """
    rows = _begun(starts, tree, None, 0).select("row", "id", "given", "covered", F.array().cast("array<int>").alias("y_ids"), F.lit(0).cast("long").alias("units"))
    rows = rows.join(F.broadcast(tree.agg(F.count("*").alias("n"))))  # one row
    rows = rows.withColumn("size", F.least(F.lit(size).cast("long"), F.col("n") - F.size("given"))).drop("n")
    nodes, done = tree.select("node_id", "path"), rows.filter(F.col("size") == 0)
    for turn in range(size):
        later = (F.coalesce(F.try_element_at("y_ids", F.lit(-1)), F.lit(-1)) < F.col("node_id")) if turn else F.lit(True)
        grown = rows.filter(F.col("size") > turn).join(nodes, later & ~F.array_contains("given", F.col("node_id")))
        new = F.filter("path", lambda e: ~F.array_contains("covered", e["key"]))
        rows = grown.withColumn("units", F.col("units") + _sum(new)).select("row", "id", "given", F.array_union("covered", F.col("path.key")).alias("covered"), F.array_append("y_ids", F.col("node_id")).alias("y_ids"), "units", "size")
        done = done.unionByName(rows.filter(F.col("size") == turn + 1))
    return done.select("row", "id", "y_ids", "units")


def all_sequences(starts: DataFrame, tree: DataFrame, size: int) -> DataFrame:
    """(id, rank, y_ids, entropy): every ordered sequence of `size` other nodes, best first; one empty one for a size below 1.

    Values are those of all_sets(); orders are made of them at the end, and ranks need no task with a start's sequences.
    """
    rows = all_sets(starts, tree, max(size, 0))
    orders = None
    for n in range(max(size, 0) + 1):
        made = F.array(*(F.array(*(F.col("y_ids")[i] for i in p)) for p in itertools.permutations(range(n)))) if n else F.array(F.array().cast("array<int>"))
        orders = made if orders is None else F.when(F.size("y_ids") == n, made).otherwise(orders)
    each = rows.select("row", "id", (-F.col("units")).alias("less"), F.explode(orders).alias("y_ids"))
    ranked = ranked_index(each, ["row", "less", "y_ids"], "place", by=["row"])
    return ranked.select("id", (F.col("place") + 1).cast("int").alias("rank"), "y_ids", (-F.col("less") / F.lit(float(UNIT))).alias("entropy"))


def combos_for_all_starts(ids: DataFrame, tree: DataFrame, k: int = 7, width: int = 100, index: DataFrame | None = None) -> DataFrame:
    """(start_id, y_ids, max_conditional_se): for each node alone the best set of k - 1 others."""
    best = _beam(ids.select(F.col("node_id").alias("id"), F.array("node_id").alias("node_ids")), tree, k - 1, width, index=index).filter(F.col("rank") == 1)
    return best.select(F.col("id").alias("start_id"), "y_ids", F.col("entropy").alias("max_conditional_se"))


def combos_in_batches(ids: DataFrame, tree: DataFrame, path: str, k: int = 7, width: int = 100, size: int = 100, at_once: int = 10) -> int:
    """combos_for_all_starts(), written in batches of `size` starts, `at_once` of them in a job; stopped work goes on with what isn't
    finished. Gives the number of jobs. The index is made once."""
    index = search_index(tree, width, k)

    def make(starts: DataFrame) -> DataFrame:
        return combos_for_all_starts(starts.select(F.col("start_id").alias("node_id")), tree, k, width, index)

    jobs = write_in_batches(ids.select(F.col("node_id").alias("start_id")), make, path, k, size, at_once)
    discard(index)
    return jobs


def labelled_combos(combos: DataFrame, ids: DataFrame) -> DataFrame:
    """(start_id, start_ability, optimal_combination, max_conditional_se): ids as tags, in order."""
    at = combos.select("start_id", F.posexplode("y_ids").alias("pos", "node_id")).join(ids, "node_id")
    tags = at.groupBy("start_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("p")).select("start_id", F.col("p.tag").alias("optimal_combination"))
    first = ids.select(F.col("node_id").alias("start_id"), F.col("tag").alias("start_ability"))
    return combos.join(tags, "start_id").join(first, "start_id").select("start_id", "start_ability", "optimal_combination", "max_conditional_se")


def _hops(at: DataFrame, hop: DataFrame) -> DataFrame:
    """Paths longer by one edge to a node that they don't hold."""
    longer = at.join(hop, "src").filter(~F.array_contains("seen", F.col("dst")))
    return longer.select("start", F.col("dst").alias("src"), F.array_append("seen", F.col("dst")).alias("seen"), F.concat("path", F.array("relation", F.col("dst").cast("string"))).alias("path"), (F.col("score") + F.col("gain")).alias("score"))


def top_paths(edges: DataFrame, entropy: DataFrame, length: int, k: int, trial: int = 4) -> DataFrame:
    """(start, path, score, rank): for each start the k simple paths of `length` edges, along their stored direction,
    of the highest node entropy; path alternates node ids and relations.

    A pass backwards gives the most that the hops after a node can add. A trial keeps trial * k paths of each start at every
    hop, by score and that most; the k-th it finds is the least that counts, and paths that can't reach it go.
    """
    begun = entropy.select(F.col("node_id").alias("start"), F.col("node_id").alias("src"), F.array("node_id").alias("seen"), F.array(F.col("node_id").cast("string")).alias("path"), F.col("entropy").alias("score"))
    hop = written(edges.select("src", "dst", "relation").join(entropy.select(F.col("node_id").alias("dst"), F.col("entropy").alias("gain")), "dst"), "hops")
    ahead = [entropy.select(F.col("node_id").alias("src"), F.lit(0.0).alias("ahead"))]
    for _ in range(length - 1):
        onward = ahead[-1].select(F.col("src").alias("dst"), "ahead")
        ahead.append(written(hop.join(onward, "dst").groupBy("src").agg(F.max(F.col("gain") + F.col("ahead")).alias("ahead")), "hops-ahead"))
    at = begun
    for left in range(length - 1, -1, -1):
        best = _hops(at, hop).join(ahead[left], "src").withColumn("reach", F.col("score") + F.col("ahead"))
        at = written(top_per_group(best, ["start"], [F.col("reach").desc(), F.col("seen")], trial * k).drop("rank", "reach", "ahead"), "trial-paths")
    floor = top_per_group(at, ["start"], [F.col("score").desc()], k).filter(F.col("rank") == k).select("start", F.col("score").alias("floor"))
    at = begun.join(floor, "start", "left") if length > 0 else begun
    floors = written(at.select("start", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")), "path-floors") if length > 0 else None
    at = begun
    for left in range(length - 1, -1, -1):
        reach = _hops(at, hop).join(ahead[left], "src").join(floors, "start")
        at = written(reach.filter(F.col("score") + F.col("ahead") >= F.col("floor") - 1e-9).drop("ahead", "floor"), "reaching-paths")
    return top_per_group(at, ["start"], [F.round("score", 9).desc(), F.col("seen")], k).select("start", "path", "score", "rank")
