"""The jobs' inputs, derived from the given tables; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entropy, graph
from ..sources.shared import discard, written

WITH_TAGS = """tagged AS (
  SELECT l_orderkey AS id, list(p_name ORDER BY l_linenumber, l_partkey) AS tags FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
), occ AS (SELECT id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM tagged
), counts AS (SELECT tag, count(*) AS n FROM occ GROUP BY 1)"""

WITH_GRAPH = (
    WITH_TAGS
    + """, co AS (
  SELECT least(x.tag, y.tag) AS a, greatest(x.tag, y.tag) AS b, count(*) AS co FROM occ x JOIN occ y ON x.id = y.id AND x.pos < y.pos GROUP BY 1, 2
), edges AS (SELECT a, b, co, (co + 2) / (na.n + 1) / (nb.n + 1) AS weight FROM co JOIN counts na ON a = na.tag JOIN counts nb ON b = nb.tag WHERE a <> b
), nodes AS (SELECT tag, (row_number() OVER (ORDER BY tag) - 1)::INTEGER AS node_id FROM (SELECT a AS tag FROM edges UNION SELECT b FROM edges)
), e AS (SELECT x.node_id AS src, y.node_id AS dst, weight FROM edges JOIN nodes x ON a = x.tag JOIN nodes y ON b = y.tag
), deg AS (SELECT node_id, sum(weight) AS degree FROM (SELECT src AS node_id, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY 1
), vol AS (SELECT 2 * sum(weight) AS v FROM e)"""
)

WITH_STATS = (
    WITH_GRAPH
    + """, member AS (SELECT node_id, node_id % 6 AS comm FROM nodes
), stats AS (
  SELECT s.comm, s.volume, s.volume - 2 * coalesce(i.inside, 0) AS cut, coalesce(i.inside, 0) AS inside
  FROM (SELECT comm, sum(degree) AS volume FROM deg JOIN member USING (node_id) GROUP BY 1) s
  LEFT JOIN (SELECT x.comm, sum(weight) AS inside FROM e JOIN member x ON src = x.node_id JOIN member y ON dst = y.node_id AND x.comm = y.comm GROUP BY 1) i USING (comm)
)"""
)

WITH_TREE = (
    WITH_GRAPH
    + """, paths AS (
  SELECT node_id, l.level, CASE l.level WHEN 1 THEN node_id % 3 WHEN 2 THEN node_id % 6 WHEN 3 THEN node_id % 12 ELSE node_id END AS comm
  FROM nodes, (VALUES (1), (2), (3), (4)) l(level)
), volumes AS (SELECT level, comm, sum(degree) AS volume FROM paths JOIN deg USING (node_id) GROUP BY 1, 2
), insides AS (SELECT p.level, p.comm, sum(weight) AS inside FROM e JOIN paths p ON src = p.node_id JOIN paths q ON dst = q.node_id AND p.level = q.level AND p.comm = q.comm GROUP BY 1, 2
), ups AS (SELECT p.level, p.comm, coalesce(min(q.comm), 0) AS parent FROM paths p LEFT JOIN paths q ON p.node_id = q.node_id AND q.level = p.level - 1 GROUP BY 1, 2
), tree AS (
  SELECT level, comm, parent, volume, cut, parent_volume, CASE WHEN volume > 0 AND parent_volume > 0 THEN -(cut / v) * log2(volume / parent_volume) ELSE 0 END AS se_term FROM (
    SELECT s.level, s.comm, u.parent, s.volume, s.volume - 2 * coalesce(i.inside, 0) AS cut, CASE WHEN s.level = 1 THEN 0 ELSE p.volume END AS parent_volume
    FROM volumes s JOIN ups u USING (level, comm) LEFT JOIN insides i USING (level, comm) LEFT JOIN volumes p ON p.level = s.level - 1 AND p.comm = u.parent
  ), vol
), terms AS (SELECT node_id, level, comm, se_term FROM paths JOIN tree USING (level, comm)
), wide AS (
  SELECT node_id, sum(se_term) AS full_term, list(comm ORDER BY level) AS c, list(round(se_term * 1e9)::BIGINT ORDER BY level) AS units FROM terms GROUP BY 1
), sets AS (SELECT id, list_distinct(list(node_id)) AS node_ids FROM occ JOIN nodes USING (tag) GROUP BY 1)"""
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged_records(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(id, tags): the names of an order's parts by line, repeated ones too. of: (l_orderkey), the orders that are needed."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    lines = lines if of is None else lines.join(of, "l_orderkey", "left_semi")
    rows = lines.join(read(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    tags = rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))).alias("p"))
    return tags.select("id", F.col("p.p_name").alias("tags"))


def indexed(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges with ids, nodes with ids) of the skill graph, written once. records: tagged_records(), where they are at hand."""
    # pairs of short and of long records and tag counts each read the records
    held = written(records or tagged_records(spark, sf_dir), "tagged-records")
    named = written(graph.skill_graph(held), "skill-graph")
    discard(held)
    ids = written(graph.node_ids(graph.graph_nodes(named)), "skill-nodes")
    return written(graph.indexed_edges(named, ids), "skill-edges"), ids


def nodes(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    """The nodes with ids of the skill graph, where its edges aren't needed: tags of a pair of two tags need no weight."""
    pairs = graph.cooccurrence(records or tagged_records(spark, sf_dir)).filter(F.col("a") != F.col("b"))
    return written(graph.node_ids(graph.graph_nodes(pairs)), "skill-nodes")


def fixed_paths(ids: DataFrame) -> DataFrame:
    """A nested tree by remainders of the node id: 3, 6 and 12 communities, then single nodes."""
    comm = F.col("node_id")
    levels = F.array(*(F.struct(F.lit(level).alias("level"), c.alias("comm")) for level, c in ((1, comm % 3), (2, comm % 6), (3, comm % 12), (4, comm))))
    return ids.select("node_id", F.explode(levels).alias("p")).select("node_id", "p.level", "p.comm")


def fixed_tree(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(tree, paths, edges, ids)."""
    edges, ids = indexed(spark, sf_dir, records)
    paths = fixed_paths(ids)
    return written(entropy.tree_table(edges, paths), "fixed-tree"), paths, edges, ids


def record_sets(records: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, node_ids): the distinct nodes of each of the tagged records."""
    return graph.ids_of(records, ids).select("id", F.array_distinct("node_ids").alias("node_ids"))


WITH_SEED = (
    WITH_TAGS
    + """, seed AS (
  SELECT doc_id AS id, tags, lang AS langdetect, [{'role': 'user', 'content': text[:200]}, {'role': 'assistant', 'content': text[201:]}] AS content
  FROM documents JOIN tagged ON doc_id = id
), atomic AS (
  SELECT id, any_value(content) AS content, arg_min(t, printf('%012d', n) || md5('2024|' || id || '|' || t)) AS single_ability_tag
  FROM (SELECT DISTINCT s.id, s.content, unnest(s.tags) AS t FROM seed s WHERE langdetect = 'en') JOIN (
    SELECT tag, count(*) AS n FROM (SELECT DISTINCT id, unnest(tags) AS tag FROM seed WHERE langdetect = 'en') GROUP BY 1) k ON t = tag GROUP BY 1
), pool AS (
  SELECT single_ability_tag AS tag, id, row_number() OVER (PARTITION BY single_ability_tag ORDER BY md5('2024|' || id), id) - 1 AS idx, count(*) OVER (PARTITION BY single_ability_tag) AS pool FROM atomic
), pools AS (SELECT DISTINCT tag, pool FROM pool
), wanted AS (SELECT id AS combo_id, tag, row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS pos FROM (SELECT id, tag, min(pos) AS p FROM occ GROUP BY 1, 2)
), combos AS (SELECT combo_id, list(tag ORDER BY pos) AS tags FROM wanted GROUP BY 1
), hit AS (
  SELECT combo_id, pos, w.tag, x.id FROM wanted w JOIN pools USING (tag) JOIN pool x ON x.tag = w.tag AND x.idx = (('0x' || substr(md5('2024|' || combo_id || '|' || w.tag), 1, 8))::BIGINT % pools.pool)
), matched AS (SELECT * FROM hit WHERE combo_id IN (SELECT combo_id FROM hit GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM wanted y WHERE y.combo_id = hit.combo_id))
)"""
)


def seed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, conversations, tags, langdetect): documents with the tags of the order of the same number."""
    docs = read(spark, sf_dir, "documents")
    docs = docs.join(tagged_records(spark, sf_dir, docs.select(F.col("doc_id").alias("l_orderkey"))).withColumnRenamed("id", "doc_id"), "doc_id")
    said = F.array(F.struct(F.lit("human").alias("from"), F.substring("text", 1, 200).alias("value")), F.struct(F.lit("gpt").alias("from"), F.expr("substring(text, 201)").alias("value")))
    return docs.select(F.col("doc_id").alias("id"), said.alias("conversations"), "tags", F.col("lang").alias("langdetect"))


def record_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(combo_id, tags): the distinct tags of each record as a combination."""
    return tagged_records(spark, sf_dir).select(F.col("id").alias("combo_id"), F.array_distinct("tags").alias("tags"))


WITH_DIALOGUES = """said AS (
  SELECT conv_id AS id, list(struct_pack(role := role, content := text) ORDER BY turn) AS content, count(*)::INTEGER AS k FROM conversations GROUP BY 1
), pools AS (SELECT * FROM said WHERE k BETWEEN 2 AND 7)"""


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content, k): the turns of each conversation in order, and their number."""
    rows = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("p"))
    content = F.transform("p", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.select("id", content.alias("content"), F.size("p").alias("k"))


def k_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues of two to seven messages."""
    return dialogues(spark, sf_dir).filter(F.col("k").between(2, 7))


def dirty_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, k, value, v): dialogues as JSON, some spoilt by the last digit of their number.

    3: a CJK character after the first message; 5: null content in it; 6: no role; 7: a number; 8: text for the list.
    """
    first, rest = F.element_at("content", 1), F.slice("content", F.lit(2), F.size("content"))
    digit = F.col("id") % 10
    said = F.when(digit == 3, F.concat(first["content"], F.lit("中"))).otherwise(first["content"])
    head = (
        F.when(digit == 5, F.lit('{"role":"user","content":null}'))
        .when(digit == 6, F.to_json(F.struct(first["content"].alias("content"))))
        .when(digit == 7, F.lit('{"role":"user","content":7}'))
        .otherwise(F.to_json(F.struct(first["role"].alias("role"), said.alias("content"))))
    )
    messages = F.concat(F.lit("["), F.array_join(F.concat(F.array(head), F.transform(rest, lambda m: F.to_json(m))), ","), F.lit("]"))
    value = F.concat(F.lit('{"content":'), F.when(digit == 8, F.to_json(F.array(first["content"]))).otherwise(messages), F.lit("}"))
    value = F.when(digit == 8, F.regexp_replace(value, r'(?s)^\{"content":\[(.*)\]\}$', r'{"content":$1}')).otherwise(value)
    return dialogues(spark, sf_dir).select("id", "k", "content", value.alias("value")).withColumn("v", F.try_parse_json("value"))


WITH_PREFERENCES = (
    WITH_DIALOGUES
    + """, firsts AS (
  SELECT id, list_filter(content, lambda m: m.role = 'user')[1].content AS prompt, list_filter(content, lambda m: m.role = 'assistant')[1].content AS chosen FROM said
), preferences AS (SELECT a.id, a.prompt, a.chosen, b.chosen AS rejected FROM firsts a LEFT JOIN firsts b ON b.id = a.id + 1)"""
)


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, prompt, chosen, rejected): first user and assistant texts; rejected is the next dialogue's answer."""
    from ..functions.messages import first_role

    rows = dialogues(spark, sf_dir).select("id", first_role(F.col("content"), "user").alias("prompt"), first_role(F.col("content"), "assistant").alias("chosen"))
    after = rows.select((F.col("id") - 1).alias("id"), F.col("chosen").alias("rejected"))
    return rows.join(after, "id", "left")


def token_lists(spark: SparkSession, sf_dir: str, last: int | None = None) -> DataFrame:
    """(id, position, token_ids): the words of each document, or the last of them, as numbers."""
    from ..operators.training import word_ids

    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("position"), word_ids(F.col("text"), last=last).alias("token_ids"))


WITH_TOKENS = """tok AS (
  SELECT doc_id AS id, list_transform(string_split(text, ' '), lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % 50000)::INTEGER) AS ids FROM documents
)"""


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, instruction, dataset, generator) of benchmark items."""
    return read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("instruction"), (F.col("item_id") % 4).cast("string").alias("dataset"), F.lit("stub").alias("generator"))
