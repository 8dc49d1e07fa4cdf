"""The weighted skill graph: tag counts, co-occurrence, edge weights, node ids, degrees, community figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import ranked_index


def tag_counts(records: DataFrame) -> DataFrame:
    """(tag, n): occurrences over all records; a tag that a record repeats counts each time."""
    return records.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def _short_pairs(records: DataFrame) -> DataFrame:
    """(a, b, n): the pairs of each record's places, made inside the row."""
    later = F.transform("tags", lambda x, i: F.transform(F.slice("tags", i + 2, F.size("tags")), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))))
    return records.filter(F.size("tags") > 1).select(F.explode(F.flatten(later)).alias("p")).select("p.a", "p.b", F.lit(1).cast("long").alias("n"))


def tag_blocks(records: DataFrame, block: int) -> DataFrame:
    """(i, x, j, y): pairs i <= j of blocks of each record's distinct tags, a block being a list of at most `block` (tag, n),
    dealt over all tasks. A record makes them in two steps, so that no row holds more than its tags and one block's pairs."""
    ordered = records.select(F.array_sort("tags").alias("tags")).select("tags", F.array_distinct("tags").alias("each"))
    first = ordered.select("each", F.size("tags").alias("size"), F.transform("each", lambda t: F.array_position("tags", t)).alias("first"))
    counted = first.select(F.transform("each", lambda t, k: F.struct(t.alias("tag"), (F.coalesce(F.get("first", k + 1), F.col("size") + 1) - F.get("first", k)).cast("long").alias("n"))).alias("all"))
    last = F.floor((F.size("all") - 1) / block).cast("int")
    one = counted.select("all", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    others = F.transform(F.sequence("i", "last"), lambda j: F.slice("all", j * block + 1, F.lit(block)))
    two = one.select("i", F.slice("all", F.col("i") * block + 1, F.lit(block)).alias("x"), F.posexplode(others).alias("step", "y"))
    dealt = two.select("i", "x", (F.col("i") + F.col("step")).alias("j"), "y")
    return dealt.repartition(F.xxhash64(F.col("x")[0]["tag"], F.col("y")[0]["tag"]), "i", "j")


def _long_pairs(records: DataFrame, block: int) -> DataFrame:
    """(a, b, n) of records of many tags: repeats are multiplied, and each row makes at most block * block pairs."""
    def pair(x, y, n):
        return F.struct(F.least(x["tag"], y["tag"]).alias("a"), F.greatest(x["tag"], y["tag"]).alias("b"), n.alias("n"))

    across = F.flatten(F.transform("x", lambda x: F.transform("y", lambda y: pair(x, y, x["n"] * y["n"]))))
    own = F.flatten(F.transform("x", lambda x, k: F.concat(F.array(pair(x, x, F.floor(x["n"] * (x["n"] - 1) / 2))), F.transform(F.slice("x", k + 2, F.size("x")), lambda y: pair(x, y, x["n"] * y["n"])))))
    made = tag_blocks(records, block).select(F.explode(F.when(F.col("i") == F.col("j"), own).otherwise(across)).alias("p"))
    return made.select("p.*").filter(F.col("n") > 0)


def cooccurrence(records: DataFrame, block: int = 256) -> DataFrame:
    """(a, b, co), a <= b: one for each pair of places in a record.

    Pairs of a record of up to `block` tags are made inside its row. A longer one is cut into blocks of distinct tags with
    their counts; pairs of blocks are rows, dealt over all tasks. Null tags are in no pair.
    """
    held = records.select(F.array_compact("tags").alias("tags"))
    pairs = _short_pairs(held.filter(F.size("tags") <= block)).unionByName(_long_pairs(held.filter(F.size("tags") > block), block))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("co"))


def long_records(records: DataFrame, most: int = 200) -> DataFrame:
    """(id, tags, pairs) of the records with more than `most` tags, whose pairs grow with the square of their tags. They are
    counted like all others; this only tells where the work lies."""
    n = F.size("tags").cast("long")
    return records.filter(n > most).select("id", n.alias("tags"), (n * (n - 1) / 2).cast("long").alias("pairs"))


def edge_weights(co: DataFrame, counts: DataFrame) -> DataFrame:
    """(a, b, co, weight) of pairs of different tags: (co + 2) / (n_a + 1) / (n_b + 1)."""
    left, right = counts.select(F.col("tag").alias("a"), F.col("n").alias("n_a")), counts.select(F.col("tag").alias("b"), F.col("n").alias("n_b"))
    joined = co.filter(F.col("a") != F.col("b")).join(left, "a").join(right, "b")
    return joined.select("a", "b", "co", ((F.col("co") + 2) / (F.col("n_a") + 1) / (F.col("n_b") + 1)).alias("weight"))


def skill_graph(records: DataFrame) -> DataFrame:
    """The edges (a, b, co, weight), a < b, of the skill graph."""
    return edge_weights(cooccurrence(records), tag_counts(records))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """(tag) of every tag with an edge."""
    return edges.select(F.explode(F.array("a", "b")).alias("tag")).distinct()


def node_ids(nodes: DataFrame) -> DataFrame:
    """(tag, node_id) with ids from 0 in the order of tags, without a single sorted task."""
    return ranked_index(nodes, ["tag"], "node_id").select("tag", F.col("node_id").cast("int").alias("node_id"))


def indexed_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(src, dst, weight, relation) with ids for tags."""
    src, dst = ids.select(F.col("tag").alias("a"), F.col("node_id").alias("src")), ids.select(F.col("tag").alias("b"), F.col("node_id").alias("dst"))
    return edges.join(src, "a").join(dst, "b").select("src", "dst", "weight", F.lit("related to").alias("relation"))


def ids_of(records: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, node_ids): each record's tags as ids, in order; tags that are no node are left out."""
    at = records.select("id", F.posexplode("tags").alias("pos", "tag")).join(ids, "tag")
    return at.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("p")).select("id", F.col("p.node_id").alias("node_ids"))


def tags_of(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """(key, tags): arrays of ids back as tags, in order."""
    at = rows.select(key, F.posexplode("node_ids").alias("pos", "node_id")).join(ids, "node_id")
    return at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("p")).select(key, F.col("p.tag").alias("tags"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, degree): the weights of a node's edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"), "weight")
    return ends.groupBy("node_id").agg(F.sum("weight").alias("degree"))


def graph_volume(edges: DataFrame) -> DataFrame:
    """(volume): twice the sum of all weights, 0 without edges."""
    return edges.agg(F.coalesce(2 * F.sum("weight"), F.lit(0.0)).alias("volume"))


def community_stats(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(comm, volume, inside, cut) of an assignment (node_id, comm)."""
    a, b = assignment.select(F.col("node_id").alias("src"), F.col("comm").alias("cs")), assignment.select(F.col("node_id").alias("dst"), F.col("comm").alias("cd"))
    ends = edges.join(a, "src").join(b, "dst")
    each = ends.select(F.explode(F.array(F.struct(F.col("cs").alias("comm"), "weight", (F.col("cs") == F.col("cd")).alias("own")), F.struct(F.col("cd").alias("comm"), "weight", (F.col("cs") == F.col("cd")).alias("own")))).alias("e")).select("e.*")
    sums = each.groupBy("comm").agg(F.sum("weight").alias("volume"), F.sum(F.when(F.col("own"), F.col("weight") / 2).otherwise(0.0)).alias("inside"))
    return sums.withColumn("cut", F.col("volume") - 2 * F.col("inside"))
