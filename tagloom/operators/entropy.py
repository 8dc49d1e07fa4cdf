"""Structural entropy of partitions and of fixed community trees (paths: node_id, level, comm)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import community_stats, degrees, graph_volume


def first_order_entropy(edges: DataFrame) -> DataFrame:
    """(h1): the entropy of the degrees' shares of the volume."""
    share = F.col("degree") / F.col("volume")
    rows = degrees(edges).join(F.broadcast(graph_volume(edges)))
    return rows.agg(F.coalesce(F.sum(F.when(F.col("degree") > 0, -share * F.log2(share))), F.lit(0.0)).alias("h1"))


def partition_entropy(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(comm, volume, cut, comm_term, leaf_term): their sum is the two-level entropy of the partition."""
    stats, total = community_stats(edges, assignment), F.broadcast(graph_volume(edges).withColumnRenamed("volume", "total"))
    comm = F.when(F.col("volume") > 0, -(F.col("cut") / F.col("total")) * F.log2(F.col("volume") / F.col("total"))).otherwise(0.0)
    leaves = degrees(edges).join(assignment, "node_id").join(stats.select("comm", "volume"), "comm").join(total)
    leaf = F.sum(F.when((F.col("degree") > 0) & (F.col("volume") > 0), -(F.col("degree") / F.col("total")) * F.log2(F.col("degree") / F.col("volume"))).otherwise(0.0))
    return stats.join(total).select("comm", "volume", "cut", comm.alias("comm_term")).join(leaves.groupBy("comm").agg(leaf.alias("leaf_term")), "comm")


def merge_delta(v1: Column, g1: Column, v2: Column, g2: Column, between: Column, total: Column) -> Column:
    """Change of the two-level entropy when two communities with the given weight between them become one."""
    both = v1 + v2
    return ((v1 - g1) * F.log2(both / v1) + (v2 - g2) * F.log2(both / v2) + 2 * between * F.log2(both / total)) / total


def merge_gain(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(c1, c2, between, delta) of every pair of adjacent communities, c1 < c2. Others can't lower the entropy."""
    stats, total = community_stats(edges, assignment), F.broadcast(graph_volume(edges).withColumnRenamed("volume", "total"))
    a, b = assignment.select(F.col("node_id").alias("src"), F.col("comm").alias("x")), assignment.select(F.col("node_id").alias("dst"), F.col("comm").alias("y"))
    pairs = edges.join(a, "src").join(b, "dst").filter(F.col("x") != F.col("y")).groupBy(F.least("x", "y").alias("c1"), F.greatest("x", "y").alias("c2")).agg(F.sum("weight").alias("between"))
    s1, s2 = (stats.select(F.col("comm").alias(f"c{i}"), F.col("volume").alias(f"v{i}"), F.col("cut").alias(f"g{i}")) for i in (1, 2))
    delta = merge_delta(*(F.col(c) for c in ("v1", "g1", "v2", "g2", "between", "total")))
    return pairs.join(s1, "c1").join(s2, "c2").join(total).select("c1", "c2", "between", delta.alias("delta"))


def tree_table(edges: DataFrame, paths: DataFrame, include_root_terms: bool = False) -> DataFrame:
    """(level, comm, parent, volume, cut, parent_volume, se_term) of the communities on the paths.

    Without root terms the volume above level 1 counts as 0, so that level's terms are 0.
    """
    total = F.broadcast(graph_volume(edges).withColumnRenamed("volume", "total"))
    volume = degrees(edges).join(paths, "node_id").groupBy("level", "comm").agg(F.sum("degree").alias("volume"))
    src, dst = paths.select(F.col("node_id").alias("src"), "level", "comm"), paths.select(F.col("node_id").alias("dst"), "level", "comm")
    inside = edges.join(src, "src").join(dst, ["dst", "level", "comm"]).groupBy("level", "comm").agg(F.sum("weight").alias("inside"))
    above = paths.select("node_id", (F.col("level") + 1).alias("level"), F.col("comm").alias("parent"))
    parents = paths.join(above, ["node_id", "level"], "left").groupBy("level", "comm").agg(F.coalesce(F.min("parent"), F.lit(0)).alias("parent"))
    up = volume.select((F.col("level") + 1).alias("level"), F.col("comm").alias("parent"), F.col("volume").alias("parent_volume"))
    rows = volume.join(inside, ["level", "comm"], "left").join(parents, ["level", "comm"]).join(up, ["level", "parent"], "left").join(total)
    root = F.col("total") if include_root_terms else F.lit(0.0)
    rows = rows.withColumn("parent_volume", F.when(F.col("level") == 1, root).otherwise(F.col("parent_volume"))).withColumn("cut", F.col("volume") - 2 * F.coalesce("inside", F.lit(0.0)))
    term = F.when((F.col("volume") > 0) & (F.col("parent_volume") > 0), -(F.col("cut") / F.col("total")) * F.log2(F.col("volume") / F.col("parent_volume"))).otherwise(0.0)
    return rows.select("level", "comm", "parent", "volume", "cut", "parent_volume", term.alias("se_term"))


def tree_entropy(tree: DataFrame) -> DataFrame:
    """(h_tree): the sum of all terms."""
    return tree.agg(F.coalesce(F.sum("se_term"), F.lit(0.0)).alias("h_tree"))


def sweet_spot(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """(h1, h_tree, ratio): the share of the first-order entropy that the tree removes."""
    both = first_order_entropy(edges).join(F.broadcast(tree_entropy(tree)))
    return both.withColumn("ratio", F.when(F.col("h1") != 0, 1 - F.col("h_tree") / F.col("h1")).otherwise(0.0))


def node_entropy(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """(node_id, entropy): the terms of all communities on a node's path."""
    return paths.join(tree, ["level", "comm"]).groupBy("node_id").agg(F.sum("se_term").alias("entropy"))


def set_entropy(tree: DataFrame, paths: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, entropy) of sets (id, node_ids): the sum over members, a repeated one each time; ids that are no node count nothing."""
    each = sets.select("id", F.explode("node_ids").alias("node_id"))
    return each.join(node_entropy(tree, paths), "node_id").groupBy("id").agg(F.sum("entropy").alias("entropy"))


def leaf_paths(paths: DataFrame) -> DataFrame:
    """(node_id, comm, is_mapped): the last community of each node; mapped if it holds that node alone."""
    last = paths.groupBy("node_id").agg(F.max_by("comm", "level").alias("comm"), F.max("level").alias("level"))
    size = last.groupBy("level", "comm").agg(F.count("*").alias("n"))
    return last.join(size, ["level", "comm"]).select("node_id", "comm", (F.col("n") == 1).alias("is_mapped"))


def mapped_paths(paths: DataFrame, extend_to_leaves: bool = False) -> DataFrame:
    """Paths for the search: of mapped nodes only, or of all nodes with one more level of single nodes."""
    if extend_to_leaves:
        deepest = paths.groupBy("node_id").agg((F.max("level") + 1).alias("level"))
        return paths.unionByName(deepest.select("node_id", "level", F.col("node_id").alias("comm")))
    return paths.join(leaf_paths(paths).filter("is_mapped").select("node_id"), "node_id", "left_semi")


def ordered_paths(paths: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(node_id, keys, terms): each node's communities from the top as one array, whose order is that of a walk through
    the tree, so that a community's nodes are neighbours; and their terms, 0 without one.

    Communities must be nested. Two nodes share the communities at the beginning of both arrays.
    """
    key = (F.col("level").cast("long") * (1 << 32) + F.col("comm")).alias("key")
    term = F.lit(0.0) if tree is None else F.coalesce("se_term", F.lit(0.0))
    rows = paths if tree is None else paths.join(tree.select("level", "comm", "se_term"), ["level", "comm"], "left")
    path = F.sort_array(F.collect_list(F.struct(key, term.alias("term"))))
    return rows.groupBy("node_id").agg(path.alias("path")).select("node_id", F.col("path.key").alias("keys"), F.col("path.term").alias("terms"))


def _shared(a: Column, b: Column) -> Column:
    """How many communities, from the top, two nodes share; 0 with none."""
    return F.when(b.isNotNull(), F.size(F.array_intersect(a, b))).otherwise(0)


def _below(depth: Column) -> Column:
    """The terms of a node's communities beyond a depth."""
    return F.aggregate(F.slice("terms", depth + 1, F.greatest(F.size("terms"), F.lit(1))), F.lit(0.0), lambda s, t: s + t)


def common_ancestors(paths: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, level, comm) of the communities that hold all members of each set (id, node_ids): those that its first and
    its last member in the order of the tree share. A set with a member that has no path has none."""
    each = sets.select("id", F.explode(F.array_distinct("node_ids")).alias("node_id"), F.size(F.array_distinct("node_ids")).alias("size"))
    ends = each.join(ordered_paths(paths).select("node_id", "keys"), "node_id").groupBy("id").agg(F.min("keys").alias("first"), F.max("keys").alias("last"), F.count("*").alias("n"), F.first("size").alias("size"))
    keys = ends.filter(F.col("n") == F.col("size")).select("id", F.explode(F.array_intersect("first", "last")).alias("key"))
    return keys.select("id", F.shiftright("key", 32).cast("int").alias("level"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("comm"))


def list_tree(paths: DataFrame) -> DataFrame:
    """(level, comm, members): the ids of each community in order."""
    return paths.groupBy("level", "comm").agg(F.sort_array(F.collect_list("node_id")).alias("members"))


def conditional_entropy(tree: DataFrame, paths: DataFrame, given: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, entropy): terms of the communities above `asked` nodes (id, node_id) that hold no `given` node of the id.

    In the order of the tree, what an asked node adds lies below what it shares with the asked node before it and with
    the given ones before and after it. One window an id, nothing gathered.
    """
    known = ordered_paths(paths, tree)
    both = given.select("id", "node_id", F.lit(False).alias("asked")).unionByName(asked.select("id", "node_id", F.lit(True).alias("asked")))
    rows = both.join(known, "node_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<bigint>")))
    w = Window.partitionBy("id").orderBy("keys", "asked")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    of_given, of_asked = F.when(~F.col("asked"), F.col("keys")), F.when(F.col("asked"), F.col("keys"))
    depth = F.greatest(*(_shared(F.col("keys"), F.col(c)) for c in ("g0", "g1", "a0")))
    rows = rows.select("id", "asked", "keys", "terms", F.last(of_given, True).over(before).alias("g0"), F.first(of_given, True).over(after).alias("g1"), F.last(of_asked, True).over(before).alias("a0"))
    return rows.filter("asked").groupBy("id").agg(F.sum(F.coalesce(_below(depth), F.lit(0.0))).alias("entropy"))


def chain_entropy(tree: DataFrame, paths: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, entropy): H(x1) + H(x2 | x1) + ..., the terms of all communities above any member, whatever the order: what each
    adds below the member before it in the order of the tree."""
    each = sets.select("id", F.explode("node_ids").alias("node_id")).join(ordered_paths(paths, tree), "node_id")
    before = F.lag("keys").over(Window.partitionBy("id").orderBy("keys"))
    rows = each.select("id", "terms", "keys", before.alias("before"))
    return rows.groupBy("id").agg(F.sum(_below(_shared(F.col("keys"), F.col("before")))).alias("entropy"))
