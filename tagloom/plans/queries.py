"""Registered queries, one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages as msg
from ..functions.ordering import pick_index, ranked_index, seeded_key, top_per_group
from ..operators import combos, curriculum, entropy, graph, synthesis, taxonomy, training
from ..sources import files
from ..sources.shared import written
from ..sources.shared import shared_dir
from . import fixtures as fx

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def _joined(c: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


def _path(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# graph


@query(f"WITH {fx.WITH_TAGS} SELECT tag, n FROM counts")
def tag_counts(spark, sf):
    return graph.tag_counts(fx.tagged_records(spark, sf))


@query(f"WITH {fx.WITH_GRAPH} SELECT a, b, co FROM co")
def cooccurrence(spark, sf):
    return graph.cooccurrence(fx.tagged_records(spark, sf))


@query(f"WITH {fx.WITH_GRAPH} SELECT a, b, co, round(weight, 9) AS weight FROM edges")
def edge_weights(spark, sf):
    return graph.skill_graph(fx.tagged_records(spark, sf)).withColumn("weight", F.round("weight", 9))


@query(f"WITH {fx.WITH_GRAPH} SELECT tag, node_id FROM nodes")
def node_ids(spark, sf):
    return graph.node_ids(graph.graph_nodes(graph.skill_graph(fx.tagged_records(spark, sf))))


@query(f"WITH {fx.WITH_GRAPH} SELECT tag, node_id FROM nodes")
def node_ids_ranked(spark, sf):
    return graph.node_ids(graph.graph_nodes(graph.skill_graph(fx.tagged_records(spark, sf))))


@query(f"WITH {fx.WITH_GRAPH} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges")
def graph_size(spark, sf):
    named = graph.skill_graph(fx.tagged_records(spark, sf))
    return graph.graph_nodes(named).agg(F.count("*").alias("n_nodes")).join(F.broadcast(named.agg(F.count("*").alias("n_edges"))))


@query(f"WITH {fx.WITH_GRAPH} SELECT src, dst, round(weight, 9) AS weight, 'related to' AS relation FROM e")
def graph_round_trip(spark, sf):
    path = _path(spark, "graph")
    files.write_graph(*fx.indexed(spark, sf), path)
    edges, _ = files.read_graph(spark, path)
    return edges.withColumn("weight", F.round("weight", 9))


@query(f"WITH {fx.WITH_GRAPH} SELECT node_id, round(degree, 6) AS degree FROM deg")
def degrees(spark, sf):
    return graph.degrees(fx.indexed(spark, sf)[0]).select("node_id", _r("degree"))


@query(f"WITH {fx.WITH_GRAPH} SELECT round(v, 6) AS volume FROM vol")
def graph_volume(spark, sf):
    return graph.graph_volume(fx.indexed(spark, sf)[0]).select(_r("volume"))


def _six(ids: DataFrame) -> DataFrame:
    return ids.select("node_id", (F.col("node_id") % 6).alias("comm"))


@query(f"WITH {fx.WITH_STATS} SELECT comm, round(volume, 6) AS volume, round(inside, 6) AS inside, round(cut, 6) AS cut FROM stats")
def community_stats(spark, sf):
    edges, ids = fx.indexed(spark, sf)
    return graph.community_stats(edges, _six(ids)).select("comm", _r("volume"), _r("inside"), _r("cut"))


@query(f"""WITH {fx.WITH_GRAPH} SELECT t.id, string_agg(n.node_id::VARCHAR, ',' ORDER BY t.pos) AS node_ids FROM occ t JOIN nodes n USING (tag) GROUP BY 1""")
def record_node_ids(spark, sf):
    _, ids = fx.indexed(spark, sf)
    return graph.ids_of(fx.tagged_records(spark, sf), ids).select("id", _joined(F.col("node_ids")).alias("node_ids"))


@query(f"""WITH {fx.WITH_GRAPH} SELECT t.id, string_agg(n.tag, ',' ORDER BY t.pos) AS tags FROM occ t JOIN nodes n USING (tag) GROUP BY 1""")
def reindex_tags(spark, sf):
    _, ids = fx.indexed(spark, sf)
    coded = graph.ids_of(fx.tagged_records(spark, sf), ids)
    return graph.tags_of(coded, "id", ids).select("id", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {fx.WITH_TAGS} SELECT tag, n FROM counts ORDER BY n DESC, tag LIMIT 10")
def top_tags(spark, sf):
    return graph.tag_counts(fx.tagged_records(spark, sf)).orderBy(F.desc("n"), "tag").limit(10)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Records to tag combinations: graph, tree of four levels, best set of seven tags for each start."""
    edges, ids = fx.indexed(spark, sf)
    paths = taxonomy.entropy_tree(edges, ids, 4)
    full = entropy.mapped_paths(paths, extend_to_leaves=True)
    tree = combos.node_paths(entropy.tree_table(edges, full, include_root_terms=True), full, ids)
    best = combos.labelled_combos(combos.combos_for_all_starts(ids, tree, k=7, width=100), ids)
    return best.select("start_id", "start_ability", F.array_join("optimal_combination", ",").alias("optimal_combination"), _r("max_conditional_se"))


@query()
def combos_all_starts(spark, sf):
    return flagship(spark, sf)


# entropy


@query(f"""WITH {fx.WITH_STATS}, leaf AS (
  SELECT comm, sum(-(degree / v) * log2(degree / volume)) AS leaf_term FROM deg JOIN member USING (node_id) JOIN stats USING (comm), vol GROUP BY 1
) SELECT comm, round(-(cut / v) * log2(volume / v), 6) AS comm_term, round(leaf_term, 6) AS leaf_term FROM stats JOIN leaf USING (comm), vol""")
def partition_entropy(spark, sf):
    edges, ids = fx.indexed(spark, sf)
    return entropy.partition_entropy(edges, _six(ids)).select("comm", _r("comm_term"), _r("leaf_term"))


@query(f"""WITH {fx.WITH_STATS}, pairs AS (
  SELECT least(x.comm, y.comm) AS c1, greatest(x.comm, y.comm) AS c2, sum(weight) AS w FROM e JOIN member x ON src = x.node_id JOIN member y ON dst = y.node_id WHERE x.comm <> y.comm GROUP BY 1, 2
) SELECT c1, c2, round(w, 6) AS between, round(
    -((a.cut + b.cut - 2 * w) / v) * log2((a.volume + b.volume) / v) + (a.cut / v) * log2(a.volume / v) + (b.cut / v) * log2(b.volume / v)
    + (a.volume / v) * log2((a.volume + b.volume) / a.volume) + (b.volume / v) * log2((a.volume + b.volume) / b.volume), 6) AS delta
  FROM pairs JOIN stats a ON c1 = a.comm JOIN stats b ON c2 = b.comm, vol""")
def merge_gain(spark, sf):
    edges, ids = fx.indexed(spark, sf)
    return entropy.merge_gain(edges, _six(ids)).select("c1", "c2", _r("between"), _r("delta"))


@query(f"WITH {fx.WITH_GRAPH} SELECT round(sum(-(degree / v) * log2(degree / v)), 6) AS h1 FROM deg, vol")
def first_order_entropy(spark, sf):
    return entropy.first_order_entropy(fx.indexed(spark, sf)[0]).select(_r("h1"))


@query(f"WITH {fx.WITH_TREE} SELECT level, comm, parent, round(volume, 6) AS volume, round(cut, 6) AS cut, round(se_term, 6) AS se_term FROM tree")
def tree_table_fixed(spark, sf):
    return fx.fixed_tree(spark, sf)[0].select("level", "comm", "parent", _r("volume"), _r("cut"), _r("se_term"))


@query(f"WITH {fx.WITH_TREE} SELECT round(sum(se_term), 6) AS h_tree FROM tree")
def tree_entropy_fixed(spark, sf):
    return entropy.tree_entropy(fx.fixed_tree(spark, sf)[0]).select(_r("h_tree"))


@query(f"""WITH {fx.WITH_TREE}, h AS (SELECT sum(-(degree / v) * log2(degree / v)) AS h1 FROM deg, vol), t AS (SELECT sum(se_term) AS h_tree FROM tree)
SELECT round(h1, 6) AS h1, round(h_tree, 6) AS h_tree, round(1 - h_tree / h1, 6) AS ratio FROM h, t""")
def sweet_spot_fixed(spark, sf):
    tree, _, edges, _ = fx.fixed_tree(spark, sf)
    return entropy.sweet_spot(edges, tree).select(_r("h1"), _r("h_tree"), _r("ratio"))


@query(f"WITH {fx.WITH_TREE} SELECT node_id, round(full_term, 6) AS entropy FROM wide")
def node_entropy_fixed(spark, sf):
    tree, paths, _, _ = fx.fixed_tree(spark, sf)
    return entropy.node_entropy(tree, paths).select("node_id", _r("entropy"))


@query(f"WITH {fx.WITH_TREE} SELECT id, round(sum(full_term), 6) AS entropy FROM occ JOIN nodes USING (tag) JOIN wide USING (node_id) GROUP BY 1")
def set_entropy_fixed(spark, sf):
    tree, paths, _, ids = fx.fixed_tree(spark, sf)
    return entropy.set_entropy(tree, paths, graph.ids_of(fx.tagged_records(spark, sf), ids)).select("id", _r("entropy"))


@query(f"WITH {fx.WITH_TREE} SELECT node_id, node_id AS comm, true AS is_mapped FROM nodes")
def leaf_paths_fixed(spark, sf):
    return entropy.leaf_paths(fx.fixed_paths(fx.nodes(spark, sf)))


@query(f"""WITH {fx.WITH_TREE} SELECT id, level, comm FROM (SELECT id, unnest(node_ids) AS node_id, len(node_ids) AS size FROM sets) JOIN paths USING (node_id)
GROUP BY id, size, level, comm HAVING count(*) = size""")
def common_ancestors_fixed(spark, sf):
    records = written(fx.tagged_records(spark, sf), "tagged-records")
    ids = fx.nodes(spark, sf, records)
    return entropy.common_ancestors(fx.fixed_paths(ids), fx.record_sets(records, ids))


@query(f"WITH {fx.WITH_TREE} SELECT level, comm, string_agg(node_id::VARCHAR, ',' ORDER BY node_id) AS members FROM paths GROUP BY 1, 2")
def list_tree_fixed(spark, sf):
    return entropy.list_tree(fx.fixed_paths(fx.nodes(spark, sf))).select("level", "comm", _joined(F.col("members")).alias("members"))


@query(f"""WITH {fx.WITH_TREE}, first AS (SELECT id, arg_min(node_id, pos) AS x FROM occ JOIN nodes USING (tag) GROUP BY 1
), asked AS (SELECT DISTINCT id, t.level, t.comm, t.se_term FROM (SELECT id, unnest(node_ids) AS node_id FROM sets) s JOIN first USING (id) JOIN terms t USING (node_id) WHERE s.node_id <> x
), known AS (SELECT id, level, comm FROM first JOIN paths ON x = node_id)
SELECT id, round(coalesce(sum(se_term) FILTER (WHERE (id, level, comm) NOT IN (SELECT id, level, comm FROM known)), 0), 6) AS entropy FROM asked GROUP BY 1""")
def conditional_entropy_fixed(spark, sf):
    """A record's other tags given its first."""
    records = written(fx.tagged_records(spark, sf), "tagged-records")
    tree, paths, _, ids = fx.fixed_tree(spark, sf, records)
    sets = written(fx.record_sets(records, ids), "record-sets")
    given = sets.select("id", F.col("node_ids")[0].alias("node_id"))
    asked = sets.select("id", F.explode(F.slice("node_ids", F.lit(2), F.size("node_ids"))).alias("node_id"))
    return entropy.conditional_entropy(tree, paths, given, asked).select("id", _r("entropy"))


@query(f"WITH {fx.WITH_TREE} SELECT id, round(sum(se_term), 6) AS entropy FROM (SELECT DISTINCT id, level, comm, se_term FROM (SELECT id, unnest(node_ids) AS node_id FROM sets) JOIN terms USING (node_id)) GROUP BY 1")
def chain_entropy_fixed(spark, sf):
    records = written(fx.tagged_records(spark, sf), "tagged-records")
    tree, paths, _, ids = fx.fixed_tree(spark, sf, records)
    return entropy.chain_entropy(tree, paths, fx.record_sets(records, ids)).select("id", _r("entropy"))


# search

_GAIN = "list_sum(list_transform(range(1, 5), lambda i: CASE WHEN {y}.c[i] <> {x}.c[i] {more} THEN {y}.units[i] ELSE 0 END))"
_FIRST = f"""one AS (
  SELECT x.node_id AS s, y.node_id AS y1, {_GAIN.format(x='x', y='y', more='')} AS h1 FROM wide x JOIN wide y ON x.node_id <> y.node_id
), step AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h1 DESC, y1) AS r1 FROM one)"""
_SECOND = f"""two AS (
  SELECT s, y1, z.node_id AS y2, r1, h1 + {_GAIN.format(x='x', y='z', more='AND z.c[i] <> y.c[i]')} AS h2
  FROM step JOIN wide x ON s = x.node_id JOIN wide y ON y1 = y.node_id JOIN wide z ON z.node_id NOT IN (s, y1)
)"""


def _fixed_search(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    tree, paths, _, ids = fx.fixed_tree(spark, sf)
    starts = ids.select(F.col("node_id").alias("id"), F.array("node_id").alias("node_ids"))
    return starts, combos.node_paths(tree, paths, ids)


def _found(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("start_id"), "rank", _joined(F.col("y_ids")).alias("y_ids"), "entropy")


@query(f"WITH {fx.WITH_TREE}, {_FIRST} SELECT s AS start_id, 1 AS rank, y1::VARCHAR AS y_ids, h1 / 1e9 AS entropy FROM step WHERE r1 = 1")
def beam_k2_fixed(spark, sf):
    starts, tree = _fixed_search(spark, sf)
    return _found(combos.beam_sets(starts, tree, 1, 100).filter("rank = 1"))


@query(f"""WITH {fx.WITH_TREE}, {_FIRST}, {_SECOND}
SELECT s AS start_id, 1 AS rank, y1 || ',' || y2 AS y_ids, h2 / 1e9 AS entropy FROM two QUALIFY row_number() OVER (PARTITION BY s ORDER BY h2 DESC, r1, y2) = 1""")
def beam_k3_fixed(spark, sf):
    starts, tree = _fixed_search(spark, sf)
    return _found(combos.beam_sets(starts, tree, 2, 100).filter("rank = 1"))


@query(f"""WITH {fx.WITH_TREE}, {_FIRST}, {_SECOND.replace('FROM step JOIN', 'FROM (FROM step WHERE r1 = 1) JOIN')}
SELECT s AS start_id, 1 AS rank, y1 || ',' || y2 AS y_ids, h2 / 1e9 AS entropy FROM two QUALIFY row_number() OVER (PARTITION BY s ORDER BY h2 DESC, y2) = 1""")
def greedy_set_fixed(spark, sf):
    starts, tree = _fixed_search(spark, sf)
    return _found(combos.greedy_set(starts, tree, 2))


@query(f"""WITH {fx.WITH_TREE}, {_FIRST}, {_SECOND}
SELECT s AS start_id, (row_number() OVER (PARTITION BY s ORDER BY h2 DESC, r1, y2))::INTEGER AS rank, y1 || ',' || y2 AS y_ids, h2 / 1e9 AS entropy FROM two QUALIFY rank <= 20""")
def beam_sequences_fixed(spark, sf):
    starts, tree = _fixed_search(spark, sf)
    return _found(combos.beam_sequences(starts, tree, 2, 100).filter("rank <= 20"))


@query(f"WITH {fx.WITH_TREE}, {_FIRST}, {_SECOND} SELECT s AS start_id, y1 || ',' || y2 AS y_ids, h2 / 1e9 AS entropy FROM two")
def all_sequences_fixed(spark, sf):
    starts, tree = _fixed_search(spark, sf)
    return _found(combos.all_sequences(starts, tree, 2)).drop("rank")


@query(f"""WITH {fx.WITH_TREE}, {_FIRST}, near AS (
  SELECT s, y1, h1, r1 FROM step
), {_SECOND.replace('FROM step JOIN', 'FROM near JOIN').replace('z.node_id NOT IN (s, y1)', 'z.node_id NOT IN (s, y1) AND z.c[1] = x.c[1]')}
SELECT s AS start_id, 1 AS rank, y1 || ',' || y2 AS y_ids, h2 / 1e9 AS entropy FROM two QUALIFY row_number() OVER (PARTITION BY s ORDER BY h2 DESC, r1, y2) = 1""")
def local_beam_fixed(spark, sf):
    starts, tree = _fixed_search(spark, sf)
    return _found(combos.beam_sets_local(starts, tree, 2, 100).filter("rank = 1"))


@query(f"""WITH {fx.WITH_TREE}, hops AS (
  SELECT a.src AS start, a.src || ',related to,' || a.dst || ',related to,' || b.dst AS path, x.full_term + y.full_term + z.full_term AS score, [a.src, a.dst, b.dst] AS seen
  FROM e a JOIN e b ON a.dst = b.src AND b.dst <> a.src JOIN wide x ON a.src = x.node_id JOIN wide y ON a.dst = y.node_id JOIN wide z ON b.dst = z.node_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY round(score, 9) DESC, seen)::INTEGER AS rank FROM hops)
SELECT start, path, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5""")
def top_paths_fixed(spark, sf):
    tree, paths, edges, _ = fx.fixed_tree(spark, sf)
    return combos.top_paths(edges, entropy.node_entropy(tree, paths), 2, 5).select("start", F.array_join("path", ",").alias("path"), _r("score"), "rank")


@query(f"WITH {fx.WITH_TREE}, {_FIRST} SELECT s AS start_id, y1 AS y_id, h1 / 1e9 AS entropy, s // 100 AS batch, 2 AS k FROM step WHERE r1 = 1")
def combos_round_trip(spark, sf):
    """Best pairs written by k and batch and read back."""
    starts, tree = _fixed_search(spark, sf)
    path = _path(spark, "combos")
    found = combos.combos_for_all_starts(starts.select(F.col("id").alias("node_id")), tree, 2, 100)
    files.write_combos(found, path, 2)
    return files.read_combos(spark, path, 2).select("start_id", F.col("y_ids")[0].alias("y_id"), F.col("max_conditional_se").alias("entropy"), F.col("batch").cast("int").alias("batch"), F.col("k").cast("int").alias("k"))


# taxonomy


@query()
def entropy_partition(spark, sf):
    edges, ids = fx.indexed(spark, sf)
    return taxonomy.min_entropy_partition(edges, ids.select("node_id", F.lit(0).alias("parent"))).select("node_id", "comm")


@query()
def entropy_partition_rounds(spark, sf):
    """The same in rounds of at most 1,000 edges, as for graphs that no task holds."""
    edges, ids = fx.indexed(spark, sf)
    return taxonomy.min_entropy_partition(edges, ids.select("node_id", F.lit(0).alias("parent")), most_rows=1000).select("node_id", "comm")


@query(f"WITH {fx.WITH_GRAPH} SELECT count(*) AS nodes, 0 AS improving, 0 AS misnamed FROM nodes")
def entropy_partition_checked(spark, sf):
    """Of the partition: its nodes, adjacent pairs whose merge would still lower the entropy, communities not named by their least node."""
    edges, ids = fx.indexed(spark, sf)
    found = written(taxonomy.min_entropy_partition(edges, ids.select("node_id", F.lit(0).alias("parent"))).select("node_id", "comm"), "checked-partition")
    improving = entropy.merge_gain(edges, found).filter("delta < -1e-9").agg(F.count("*").alias("improving"))
    misnamed = found.groupBy("comm").agg(F.min("node_id").alias("least")).filter("comm <> least").agg(F.count("*").alias("misnamed"))
    return found.agg(F.count("*").alias("nodes")).join(improving).join(misnamed)


@query()
def entropy_tree(spark, sf):
    return taxonomy.entropy_tree(*fx.indexed(spark, sf), 4)


@query(f"WITH {fx.WITH_GRAPH} SELECT unnest(range(1, 5))::INTEGER AS level, (SELECT count(*) FROM nodes) AS nodes, 0 AS crossing")
def entropy_tree_checked(spark, sf):
    """Of each level of the tree: its nodes, and communities that lie in more than one of the level above."""
    paths = written(taxonomy.entropy_tree(*fx.indexed(spark, sf), 4), "checked-tree")
    above = paths.select("node_id", (F.col("level") + 1).alias("level"), F.col("comm").alias("parent"))
    crossing = paths.join(above, ["node_id", "level"]).groupBy("level", "comm").agg(F.countDistinct("parent").alias("n")).filter("n > 1").groupBy("level").agg(F.count("*").alias("crossing"))
    counts = paths.groupBy("level").agg(F.countDistinct("node_id").alias("nodes"))
    return counts.join(crossing, "level", "left").select("level", "nodes", F.coalesce("crossing", F.lit(0)).alias("crossing"))


# records and dialogues


@query("SELECT l_orderkey AS id, l_linenumber AS line FROM lineitem")
def read_tagged(spark, sf):
    return files.read_tagged(spark, f"{sf}/lineitem.parquet", ("l_orderkey", "l_linenumber")).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"))


@query(f"WITH {fx.WITH_TAGS} SELECT id, array_to_string(tags, ',') AS tags FROM tagged")
def extract_tags_struct(spark, sf):
    rows = fx.tagged_records(spark, sf).select("id", F.struct(F.col("tags").alias("ability_zh")).alias("label"))
    return msg.extract_tags(rows).select("id", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {fx.WITH_TAGS} SELECT id, array_to_string(tags, ',') AS tags FROM tagged")
def extract_tags_literal(spark, sf):
    """Labels as Python literals; those of odd ids hold None, which JSON can't read."""
    quoted = F.concat(F.lit("["), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
    more = F.when(F.col("id") % 2 == 1, F.lit(", 'x': None")).otherwise(F.lit(""))
    rows = fx.tagged_records(spark, sf).select("id", F.concat(F.lit("{'ability_zh': "), quoted, more, F.lit("}")).alias("label"))
    return msg.extract_tags(rows).select("id", F.array_join("tags", ",").alias("tags"))


@query("SELECT doc_id AS id, lang FROM documents WHERE lang = 'en'")
def language_filter(spark, sf):
    return msg.filter_language(fx.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), "en", "lang")


@query(f"WITH {fx.WITH_SEED} SELECT id, m.i AS pos, content[m.i + 1].role AS role, content[m.i + 1].content AS content FROM seed, (VALUES (0), (1)) m(i)")
def role_normalize(spark, sf):
    rows = fx.seed_records(spark, sf).select("id", F.posexplode(msg.normalize_roles(F.col("conversations"))).alias("pos", "m"))
    return rows.select("id", "pos", "m.role", "m.content")


@query("SELECT doc_id AS id, lang AS tag FROM documents WHERE lang IS NOT NULL AND lang <> ''")
def normalize_tags(spark, sf):
    rows = msg.normalize_tags(fx.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), "lang")
    return rows.select("id", F.col("tags")[0].alias("tag"))


@query("SELECT conv_id, turn, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS tag FROM conversations")
def trim_tag(spark, sf):
    return fx.read(spark, sf, "conversations").select("conv_id", "turn", msg.trim_tag(F.col("text")).alias("tag"))


_DIRTY = f"""{fx.WITH_DIALOGUES}, dirty AS (
  SELECT id, k, content, CASE id % 10 WHEN 3 THEN 'chinese' WHEN 5 THEN 'invalid' WHEN 6 THEN 'invalid' WHEN 8 THEN 'invalid' ELSE 'ok' END AS reason,
    list_transform(content, lambda m, i: CASE WHEN i = 1 AND id % 10 = 3 THEN struct_pack(role := m.role, content := m.content || chr(20013))
      WHEN i = 1 AND id % 10 = 7 THEN struct_pack(role := 'user', content := '7') ELSE m END) AS fixed FROM said
)"""


@query(f"WITH {_DIRTY} SELECT id, md5(array_to_string(list_transform(fixed, lambda m: m.role || ':' || m.content), '|')) AS content FROM dirty WHERE reason IN ('ok', 'chinese')")
def valid_dialogue(spark, sf):
    rows = msg.valid_dialogues(fx.dirty_samples(spark, sf).drop("content"))
    return rows.select("id", F.md5(F.array_join(F.transform("content", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("content"))


@query(f"WITH {_DIRTY} SELECT id, md5(array_to_string(list_transform(fixed, lambda m: m.role || ':' || m.content), '|')) AS content FROM dirty WHERE reason = 'ok'")
def cjk_filter(spark, sf):
    rows = msg.valid_dialogues(fx.dirty_samples(spark, sf).drop("content"), no_cjk=True)
    return rows.select("id", F.md5(F.array_join(F.transform("content", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("content"))


@query(f"WITH {_DIRTY} SELECT reason, count(*) AS n FROM dirty GROUP BY 1")
def filter_report(spark, sf):
    return msg.filter_report(fx.dirty_samples(spark, sf))


@query(f"WITH {_DIRTY} SELECT count(*) AS raw, count(*) FILTER (WHERE reason = 'ok') AS valid FROM dirty")
def clean_pool(spark, sf):
    return curriculum.clean_pool(fx.dirty_samples(spark, sf).drop("content"))[1]


@query(f"""WITH {fx.WITH_DIALOGUES} SELECT id, id % 4 <> 3 AS parsed, md5(CASE WHEN id % 4 = 3 THEN to_json(content[1].content)::VARCHAR
  ELSE '[' || array_to_string(list_transform(content, lambda m: '{{"role": "' || m.role || '", "content": [' || to_json(m.content)::VARCHAR || ']}}'), ', ') || ']' END) AS content FROM said""")
def parse_reply(spark, sf):
    """Dialogues as Python literals, some inside code fences, some as prose."""
    said = F.concat(F.lit("["), F.array_join(F.transform("content", lambda m: F.concat(F.lit("{'role': '"), m["role"], F.lit("', 'content': "), F.to_json(F.array(m["content"])), F.lit("}"))), ", "), F.lit("]"))
    digit = F.col("id") % 4
    reply = F.when(digit == 0, said).when(digit == 1, F.concat(F.lit("```python\n"), said, F.lit("\n```"))).when(digit == 2, F.concat(F.lit("```\n"), said, F.lit("\n```"))).otherwise(F.col("content")[0]["content"])
    return msg.parse_reply(fx.dialogues(spark, sf).select("id", reply.alias("reply"))).select("id", "parsed", F.md5("content").alias("content"))


@query("""SELECT conv_id, turn, role, text FROM conversations""")
def jsonl_round_trip(spark, sf):
    path = _path(spark, "jsonl")
    files.write_jsonl(fx.read(spark, sf, "conversations"), path)
    return files.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS line FROM conversations QUALIFY line < 100")
def head_lines(spark, sf):
    rows = fx.read(spark, sf, "conversations").withColumn("value", F.col("text"))
    return files.head_lines(rows, 100, ["conv_id", "turn"]).select("conv_id", "turn", "line")


@query("""SELECT line, text AS value FROM (SELECT text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS line FROM conversations WHERE NOT contains(text, chr(10)) AND NOT contains(text, chr(13))) WHERE line < 500 AND trim(text) <> ''""")
def head_lines_of_file(spark, sf):
    """The first 500 lines of a text file."""
    path = _path(spark, "lines")
    rows = fx.read(spark, sf, "conversations").filter(~F.col("text").contains("\n") & ~F.col("text").contains("\r"))
    rows.orderBy("conv_id", "turn").select("text").coalesce(1).write.text(path)
    return files.head_lines(files.file_lines(spark, path), 500).select("line", "value")


@query("SELECT l_orderkey AS id, l_linenumber AS line, 1 AS skipped FROM lineitem")
def read_reported(spark, sf):
    """Lines of orders in several files, with one file beside them that is no parquet."""
    path = _path(spark, "reported")
    fx.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")).repartition(4).write.parquet(path)
    spark.range(1).select(F.lit("broken").alias("value")).coalesce(1).write.mode("append").format("text").save(path)
    rows, skipped = files.read_reported(spark, path, ("id", "line"))
    return rows.join(F.broadcast(skipped.agg(F.count("*").alias("skipped"))))  # one row


@query(f"WITH {fx.WITH_SEED} SELECT id, content[1].content || content[2].content AS said, array_to_string(tags, ',') AS tags, langdetect FROM seed")
def read_seed(spark, sf):
    """Seed records written as parquet with one more column and read back."""
    path = _path(spark, "seed")
    rows = fx.seed_records(spark, sf).withColumn("label", F.struct(F.col("tags").alias("ability_zh")))
    rows.select("id", "conversations", "label", "langdetect", F.lit(1).alias("more")).write.parquet(path)
    said = F.array_join(F.transform("conversations", lambda m: m["value"]), "")
    return files.read_seed(spark, path).select("id", said.alias("said"), F.array_join("label.ability_zh", ",").alias("tags"), "langdetect")


@query(f"WITH {fx.WITH_TAGS} SELECT id, len(tags) AS tags, (len(tags) * (len(tags) - 1)) // 2 AS pairs FROM tagged WHERE len(tags) > 5")
def long_records(spark, sf):
    return graph.long_records(fx.tagged_records(spark, sf), 5)


# synthesis


@query(f"WITH {fx.WITH_SEED} SELECT id, single_ability_tag FROM atomic")
def single_tag_assign_r1(spark, sf):
    return synthesis.atomic_samples(fx.seed_records(spark, sf)).select("id", "single_ability_tag")


def _tag_rounds(rounds: int) -> str:
    """Single tags in rounds: in each, of the tags whose count is at most the least plus the sample's slack, the first by md5."""
    draw = "('0x' || substr(md5('2024|{}' || id), 1, 8))::BIGINT"
    steps = [f"""each AS MATERIALIZED (
  SELECT DISTINCT id, {draw.format('round|')} % {rounds} AS r, 15 + {draw.format('slack|')} % 11 AS slack, unnest(tags) AS tag FROM seed WHERE langdetect = 'en')"""]
    for r in range(rounds):
        used = "SELECT NULL AS tag, 0 AS n WHERE false" if not r else " UNION ALL ".join(f"SELECT single_ability_tag, count(*) FROM p{i} GROUP BY 1" for i in range(r))
        steps += [
            f"u{r}(tag, n) AS (SELECT tag, sum(n) FROM ({used}) x(tag, n) GROUP BY 1)",
            f"n{r} AS (SELECT id, each.tag, slack, coalesce(n, 0) AS n, min(coalesce(n, 0)) OVER (PARTITION BY id) AS least FROM each LEFT JOIN u{r} ON each.tag = u{r}.tag WHERE r = {r})",
            f"p{r} AS MATERIALIZED (SELECT id, arg_min(tag, md5('2024|' || id || '|' || tag)) AS single_ability_tag FROM n{r} WHERE n <= least + slack GROUP BY 1)",
        ]
    return f"WITH {fx.WITH_SEED}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT id, single_ability_tag FROM p{r}" for r in range(rounds))


@query(_tag_rounds(4))
def single_tag_assign_rounds(spark, sf):
    return synthesis.atomic_samples(fx.seed_records(spark, sf), rounds=4).select("id", "single_ability_tag")


@query(f"WITH {fx.WITH_SEED} SELECT tag, idx, id, pool FROM pool")
def tag_index(spark, sf):
    return synthesis.tag_index(_atomic(spark, sf))


def _atomic(spark: SparkSession, sf: str) -> DataFrame:
    """The atomic samples, stored once for the query."""
    return synthesis.atomic_samples(fx.seed_records(spark, sf), store=_path(spark, "atomic"))


def _matched(spark: SparkSession, sf: str, **options) -> tuple[DataFrame, DataFrame]:
    atomic = _atomic(spark, sf)
    return synthesis.match_sources(fx.record_combos(spark, sf), synthesis.tag_index(atomic), **options), atomic


@query(f"WITH {fx.WITH_SEED} SELECT id, single_ability_tag FROM atomic")
def atomic_samples_reused(spark, sf):
    """Stored samples are read again: the second call gets no records at all."""
    path, records = _path(spark, "atomic"), fx.seed_records(spark, sf)
    synthesis.atomic_samples(records, store=path)
    return synthesis.atomic_samples(records.filter("false"), store=path).select("id", "single_ability_tag")


@query(f"WITH {fx.WITH_SEED} SELECT combo_id, pos::INTEGER AS pos, tag, id FROM matched")
def match_sources(spark, sf):
    return _matched(spark, sf)[0]


@query(f"""WITH {fx.WITH_SEED}, names AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS at, count(*) OVER () AS many FROM pools
), filled AS (
  SELECT combo_id, pos, coalesce(p.tag, o.tag) AS tag FROM wanted w LEFT JOIN pools p USING (tag) LEFT JOIN names o
    ON p.tag IS NULL AND o.at = ('0x' || substr(md5('2024|other|' || combo_id || '|' || pos), 1, 8))::BIGINT % o.many
), numbered AS (SELECT *, row_number() OVER (PARTITION BY combo_id, tag ORDER BY pos) - 1 AS again FROM filled)
SELECT combo_id, pos::INTEGER AS pos, n.tag, x.id FROM numbered n JOIN pools p USING (tag) JOIN pool x ON x.tag = n.tag AND x.idx = (('0x' || substr(md5('2024|' || combo_id || '|' || n.tag), 1, 8))::BIGINT % p.pool + again) % p.pool""")
def match_sources_substitute(spark, sf):
    return _matched(spark, sf, on_missing="substitute")[0]


@query(f"""WITH {fx.WITH_SEED}
SELECT combo_id, string_agg(m.id::VARCHAR, ',' ORDER BY pos) AS source_sample_ids, (3 * count(*))::INTEGER AS n_blocks FROM matched m GROUP BY 1""")
def assemble_content(spark, sf):
    use = lambda rows: rows.select("combo_id", _joined(F.col("source_sample_ids")).alias("source_sample_ids"), F.size("combined_content_for_llm").alias("n_blocks"))
    return synthesis.assembled_in_jobs(*_matched(spark, sf), use)


def _prompts(rows: DataFrame) -> DataFrame:
    return rows.select("combo_id", synthesis.render_prompt(F.col("combined_content_for_llm")).alias("prompt"))


@query(f"""WITH {fx.WITH_SEED}
SELECT combo_id, md5(string_agg(chr(10) || '--- ' || m.tag || ' ---' || chr(10) || 'user: ' || content[1].content || chr(10) || 'assistant: ' || content[2].content || chr(10), '' ORDER BY pos)) AS prompt
FROM matched m JOIN atomic a ON m.id = a.id GROUP BY 1""")
def render_prompt(spark, sf):
    return synthesis.assembled_in_jobs(*_matched(spark, sf), lambda rows: _prompts(rows).withColumn("prompt", F.md5("prompt")))


@query(f"WITH {fx.WITH_SEED} SELECT combo_id FROM combos WHERE len(tags) >= 3")
def gate_combos(spark, sf):
    """A rule for the judge: sets of three tags or more pass."""
    rule = F.when(F.size("key") >= 3, "yes, it does").otherwise("no")
    return synthesis.gate_combos(fx.record_combos(spark, sf), rule).select("combo_id")


@query(f"WITH {fx.WITH_SEED} SELECT combo_id FROM combos WHERE len(tags) >= 3")
def gate_combos_stored(spark, sf):
    """Verdicts of a function, kept: the second gate calls nothing."""
    path = _path(spark, "verdicts")
    rows = written(fx.record_combos(spark, sf), "gate-combos")
    synthesis.gate_combos(rows, lambda key: "YES" if len(key) >= 3 else "NO", store=path, batch=100_000)
    return synthesis.gate_combos(rows, lambda key: 1 / 0, keep_errors=False, store=path, wait=0.0).select("combo_id")


@query()
def gate_combos_callable(spark, sf):
    return synthesis.gate_combos(fx.record_combos(spark, sf), lambda key: "YES" if len(key) >= 3 else "NO").select("combo_id")


def _echo(prompt: str) -> str:
    return "[{'role': 'user', 'content': %r}]" % prompt[-40:]


def _md5(prompt: str) -> str:
    return hashlib.md5(prompt.encode()).hexdigest()


@query(f"""WITH {fx.WITH_SEED}
SELECT combo_id, md5(string_agg(chr(10) || '--- ' || m.tag || ' ---' || chr(10) || 'user: ' || content[1].content || chr(10) || 'assistant: ' || content[2].content || chr(10), '' ORDER BY pos)) AS reply
FROM matched m JOIN atomic a ON m.id = a.id GROUP BY 1""")
def generate_stored(spark, sf):
    """A generator that answers with the prompt's md5, its replies kept and read again."""
    store = _path(spark, "replies")
    return synthesis.generate_in_jobs(*_matched(spark, sf), _md5, store=store, batch=100_000)


@query()
def generate_stub(spark, sf):
    """A generator that echoes the end of the prompt."""
    return msg.parse_reply(synthesis.generate_in_jobs(*_matched(spark, sf), _echo)).select("combo_id", "parsed", "content")


@query(f"""WITH {fx.WITH_SEED}, m AS (SELECT combo_id, string_agg(id::VARCHAR, ',' ORDER BY pos) AS source_ids FROM matched GROUP BY 1)
SELECT 'generated_' || row_number() OVER (ORDER BY combo_id) AS id, array_to_string(tags, ',') AS ability, source_ids, len(tags)::DOUBLE AS max_conditional_se FROM m JOIN combos USING (combo_id)""")
def build_samples(spark, sf):
    matched, atomic = _matched(spark, sf)
    matched = written(matched, "matched")
    numbers = synthesis.sample_numbers(matched.select("combo_id").distinct())

    def samples(rows: DataFrame) -> DataFrame:
        made = synthesis.build_samples(rows.withColumn("content", F.col("combined_content_for_llm")).withColumn("max_conditional_se", F.size("tags").cast("double")))
        return made.select("id", F.array_join("label.ability", ",").alias("ability"), _joined(F.col("source_info.source_ids")).alias("source_ids"), "source_info.max_conditional_se")

    return synthesis.assembled_in_jobs(matched, atomic, samples, about=fx.record_combos(spark, sf).join(numbers, "combo_id"))


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY md5('7|' || conv_id || '|' || turn), conv_id, turn) - 1 AS place FROM conversations")
def seeded_shuffle(spark, sf):
    rows = fx.read(spark, sf, "conversations").withColumn("_key", seeded_key(7, F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return ranked_index(rows, ["_key", "conv_id", "turn"], "place").select("conv_id", "turn", "place")


@query("SELECT conv_id, turn, ('0x' || substr(md5('7|' || conv_id || '|' || turn), 1, 8))::BIGINT % 97 AS drawn FROM conversations")
def seeded_pick(spark, sf):
    return fx.read(spark, sf, "conversations").select("conv_id", "turn", pick_index(F.lit(97), 7, F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("drawn"))


@query("SELECT doc_id, source, n_chars, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INTEGER AS rank FROM documents) WHERE rank <= 3")
def top_per_group_k(spark, sf):
    return top_per_group(fx.read(spark, sf, "documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3).select("doc_id", "source", "n_chars", "rank")


@query("SELECT conv_id, turn FROM conversations ORDER BY md5('7|' || conv_id || '|' || turn), conv_id, turn LIMIT 100")
def first_n(spark, sf):
    from ..functions.ordering import first_n as take

    key = seeded_key(7, F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return take(fx.read(spark, sf, "conversations").select("conv_id", "turn"), 100, key, "conv_id", "turn")


# curriculum

_QUOTAS = "(VALUES " + ", ".join(f"({e}, {k}, {q})" for e, row in ((1, (3600, 1200, 600, 300, 180, 120)), (2, (2100, 1500, 900, 600, 480, 420)), (3, (1200, 1200, 1200, 900, 780, 720))) for k, q in zip(range(2, 8), row, strict=True)) + ") q(epoch, k, quota)"
_SLOTS = f"""{fx.WITH_DIALOGUES}, sizes AS (SELECT k, count(*) AS pool FROM pools GROUP BY 1
), quotas AS (SELECT epoch, k, quota, coalesce(pool, 0) AS pool FROM {_QUOTAS} LEFT JOIN sizes USING (k)
), begun AS (SELECT *, coalesce(sum(CASE WHEN quota <= pool THEN quota ELSE 0 END) OVER (PARTITION BY k ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM quotas
), slots AS (SELECT *, unnest(range(quota)) AS slot FROM begun WHERE pool > 0
), placed AS (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY md5('2024|' || k || '|' || id), id) - 1 AS idx FROM pools
), sampled AS (
  SELECT epoch, s.k, slot, id FROM slots s JOIN placed p ON p.k = s.k AND p.idx = CASE WHEN quota <= pool THEN (taken + slot) % pool
    ELSE ('0x' || substr(md5('2024|' || epoch || '|' || s.k || '|' || slot), 1, 8))::BIGINT % pool END
)"""


@query(f"WITH {_SLOTS} SELECT epoch, k, quota::BIGINT AS quota, pool FROM quotas")
def epoch_quotas(spark, sf):
    return curriculum.epoch_quotas(fx.k_pools(spark, sf))


@query(f"WITH {_SLOTS} SELECT epoch, k, quota::BIGINT AS quota FROM quotas WHERE pool = 0 AND quota > 0")
def epoch_shortfall(spark, sf):
    return curriculum.shortfall(curriculum.epoch_quotas(fx.k_pools(spark, sf)))


@query(f"WITH {fx.WITH_DIALOGUES} SELECT k, count(*) AS n FROM pools GROUP BY ROLLUP (k)")
def pool_sizes(spark, sf):
    return curriculum.pool_sizes(fx.k_pools(spark, sf))


@query(f"WITH {_DIRTY} SELECT k, count(*) AS n FROM dirty WHERE reason <> 'invalid' GROUP BY ROLLUP (k)")
def load_and_filter_pools(spark, sf):
    return curriculum.pool_sizes(curriculum.load_and_filter_pools(fx.dirty_samples(spark, sf).drop("content")))


@query(f"WITH {fx.WITH_DIALOGUES} SELECT id, CASE WHEN id % 2 = 0 THEN 9 ELSE k END AS k FROM pools")
def k_pool_files(spark, sf):
    """Pools written one folder for each k and read back; rows of even ids hold a k of their own, which wins."""
    pools = fx.k_pools(spark, sf).select("id", "k")
    path = _path(spark, "k-pools")
    pools.select("id", F.when(F.col("id") % 2 == 0, F.lit(9)).alias("own"), "k").write.partitionBy("k").json(path)
    lines = spark.read.schema("id long, own int").option("recursiveFileLookup", True).json(path)
    of_file = files.file_k(F.regexp_replace(F.input_file_name(), r"/[^/]*$", ""))
    return files.with_k(lines.withColumnRenamed("own", "k"), of_file).select("id", "k")


@query(f"WITH {fx.WITH_DIALOGUES} SELECT id, CASE WHEN id % 2 = 0 THEN 9 ELSE k END AS k, len(content) AS n FROM pools")
def read_k_pools(spark, sf):
    """One file of lines for each k, read together; rows of even ids hold a k of their own, which wins."""
    path, paths = _path(spark, "pools"), {}
    rows = fx.k_pools(spark, sf).withColumn("own", F.when(F.col("id") % 2 == 0, 9)).select("id", "content", "k", "own")
    for k in range(2, 8):
        paths[k] = f"{path}/{k}"
        files.write_jsonl(rows.filter(F.col("k") == k).select("id", "content", F.col("own").alias("k")), paths[k])
    found = files.read_k_pools(spark, paths, f"id long, content {msg.DIALOGUE}, k int")
    return found.select("id", "k", F.size("content").cast("long").alias("n"))


@query(f"WITH {_SLOTS} SELECT epoch, k, slot, id FROM sampled")
def sample_epochs(spark, sf):
    pools = fx.k_pools(spark, sf).select("k", "id")
    return curriculum.sample_epochs(pools, curriculum.epoch_quotas(pools)).select("epoch", "k", "slot", "id")


@query(f"""WITH {_SLOTS} SELECT epoch, k, slot, id, row_number() OVER (PARTITION BY epoch ORDER BY md5('2024|' || epoch || '|' || k || '|' || slot || '|' || id), k, slot) - 1 AS position FROM sampled""")
def order_epochs(spark, sf):
    pools = fx.k_pools(spark, sf).select("k", "id")
    sampled = curriculum.sample_epochs(pools, curriculum.epoch_quotas(pools))
    return curriculum.order_epochs(sampled).select("epoch", "k", "slot", "id", "position")


@query(f"""WITH {_SLOTS}, placed_ AS (SELECT epoch, id, row_number() OVER (PARTITION BY epoch ORDER BY md5('2024|' || epoch || '|' || k || '|' || slot || '|' || id), k, slot) - 1 AS position FROM sampled)
SELECT epoch, id, position FROM placed_""")
def write_epochs(spark, sf):
    """Epochs written one folder each and read back."""
    pools, path = fx.k_pools(spark, sf).select("k", "id"), _path(spark, "epochs")
    sampled = curriculum.sample_epochs(pools, curriculum.epoch_quotas(pools))
    curriculum.write_epochs(curriculum.order_epochs(sampled), path)
    return spark.read.schema("id long, position long, epoch int").json(path).select("epoch", "id", "position")


# training


def _segments(rows: DataFrame, segments: Column) -> DataFrame:
    return rows.select("id", F.posexplode(segments).alias("pos", "s")).select("id", "pos", F.md5("s.text").alias("text"), "s.mask")


def _chat_sql(before: str, after: str, header: str, end: str) -> str:
    say = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'"
    head = f"struct_pack(text := {say(header)}, mask := 0), " if header else ""
    turn = f"CASE WHEN m.role IN ('user', 'human') THEN [struct_pack(text := {say(before)} || m.content || {say(after)}, mask := 0)] ELSE [{head}struct_pack(text := m.content || {say(end)}, mask := 1)] END"
    return f"""WITH {fx.WITH_DIALOGUES}, seg AS (SELECT id, flatten(list_transform(content, lambda m: {turn})) AS s FROM said)
SELECT id, (i - 1)::INTEGER AS pos, md5(s[i].text) AS text, s[i].mask AS mask FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM seg)"""


def _render(family: str, templates: dict, name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _segments(fx.dialogues(spark, sf), training.render_chat(F.col("content"), family, "<eos>", templates))

    run.__name__ = name
    query(_chat_sql(*(t.replace("{eos}", "<eos>") for t in templates[family])))(run)


for _family in training.TEMPLATES:
    _render(_family, training.TEMPLATES, f"render_chat_{_family}")
_render("llama", training.FIXED, "render_chat_llama_fixed")


@query(f"""WITH {fx.WITH_DIALOGUES}, whole AS (
  SELECT id, CASE WHEN len(list_filter(content, lambda m: m.role = 'system')) > 0 THEN content ELSE list_concat([struct_pack(role := 'system', content := 'You are a helpful assistant.')], content) END AS c FROM said
), seg AS (SELECT id, [array_to_string(list_transform(c[:-2], lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '') || '<|im_start|>assistant' || chr(10), c[-1].content, '<eos>'] AS s FROM whole)
SELECT id, i::INTEGER AS pos, md5(s[i + 1]) AS text, (CASE WHEN i > 0 THEN 1 ELSE 0 END)::INTEGER AS mask FROM seg, (VALUES (0), (1), (2)) v(i)""")
def render_instruct(spark, sf):
    return _segments(fx.dialogues(spark, sf), training.render_instruct(F.col("content"), True, "<eos>"))


@query(f"""WITH {fx.WITH_DIALOGUES}, seg AS (SELECT id, list_concat(flatten(list_transform(content, lambda m, i:
  CASE WHEN m.role IN ('user', 'human') THEN [struct_pack(text := '### Instruction:' || chr(10) || m.content || chr(10) || chr(10) || '### Response:' || chr(10), mask := 0)]
  WHEN m.role = 'assistant' AND i < k THEN [struct_pack(text := m.content, mask := 1), struct_pack(text := chr(10), mask := 0)]
  WHEN m.role = 'assistant' THEN [struct_pack(text := m.content, mask := 1)] ELSE [] END)), [struct_pack(text := '<eos>', mask := 1)]) AS s FROM said)
SELECT id, (i - 1)::INTEGER AS pos, md5(s[i].text) AS text, s[i].mask AS mask FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM seg)""")
def render_instruct_base(spark, sf):
    return _segments(fx.dialogues(spark, sf), training.render_instruct(F.col("content"), False, "<eos>"))


@query(f"""WITH {fx.WITH_DIALOGUES}, seg AS (SELECT id, unnest(range(1, k + 1)) AS i, content FROM said
), tok AS (SELECT id, i, (CASE WHEN content[i].role = 'assistant' THEN 1 ELSE 0 END) AS mask, list_transform(string_split(content[i].content, ' '), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 50000) AS t FROM seg)
SELECT id, md5(string_agg(array_to_string(t, ','), ',' ORDER BY i)) AS token_ids, md5(string_agg(repeat(mask::VARCHAR, len(t)), '' ORDER BY i)) AS loss_mask FROM tok GROUP BY 1""")
def tokenize_split(spark, sf):
    segments = F.transform("content", lambda m: F.struct(m["content"].alias("text"), F.when(m["role"] == "assistant", 1).otherwise(0).alias("mask")))
    rows = training.tokenize_segments(fx.dialogues(spark, sf).withColumn("segments", segments))
    return rows.select("id", F.md5(_joined(F.col("token_ids"))).alias("token_ids"), F.md5(_joined(F.col("loss_mask"), "")).alias("loss_mask"))


@query(f"WITH {fx.WITH_TOKENS} SELECT id, md5(array_to_string(ids[greatest(len(ids) - 511, 1):], ',')) AS token_ids FROM tok")
def truncate_left(spark, sf):
    return fx.token_lists(spark, sf, 512).select("id", F.md5(_joined(F.col("token_ids"))).alias("token_ids"))


#: Tokens of a training sequence, and of a prompt.
_LENGTH, _PROMPT = 1024, 512
_PLACED = f"""{fx.WITH_TOKENS}, cut AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS position, ids[greatest(len(ids) - {_LENGTH - 1}, 1):] AS ids FROM tok)"""


def _placed(spark: SparkSession, sf: str, tokens: bool = True) -> DataFrame:
    """Documents in order, with their last tokens up to the training length. Only ids are ranked."""
    at = ranked_index(fx.read(spark, sf, "documents").select(F.col("doc_id").alias("id")), ["id"], "position")
    if not tokens:
        return at
    rows = fx.token_lists(spark, sf, _LENGTH).drop("position").join(at, "id")
    return rows.withColumn("loss_mask", F.array_repeat(F.lit(1), F.size("token_ids")))


@query(f"""WITH {_PLACED}, w AS (SELECT *, max(len(ids)) OVER (PARTITION BY position // 8) AS width FROM cut)
SELECT id, position // 8 AS batch, md5(array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda x: 2)), ',')) AS token_ids,
  repeat('1', len(ids)) || repeat('0', width - len(ids)) AS loss_mask FROM w""")
def pad_batch(spark, sf):
    rows = training.pad_batch(_placed(spark, sf), 8, 2)
    return rows.select("id", "batch", F.md5(_joined(F.col("token_ids"))).alias("token_ids"), _joined(F.col("loss_mask"), "").alias("loss_mask"))


@query(f"WITH {_PLACED} SELECT id, position % 4 AS shard, position // 4 AS place FROM cut")
def shard_ordered(spark, sf):
    return training.shard_ordered(_placed(spark, sf, tokens=False), 4).select("id", "shard", "place")


@query(f"WITH {_PLACED} SELECT id, position // 4 AS place FROM cut WHERE position % 4 = 1")
def write_shards(spark, sf):
    """All rows written in four shards, and the second read back."""
    path = _path(spark, "shards")
    training.write_shards(_placed(spark, sf, tokens=False), 4, path)
    return training.read_shard(spark, path, 1).select("id", "place")


@query(f"""WITH {_PLACED}, r AS (SELECT *, list_reverse(CASE WHEN len(ids) > {_PROMPT} THEN ids[len(ids) - {_PROMPT - 2}:] ELSE ids END) AS rev FROM cut
), w AS (SELECT *, max(len(rev)) OVER (PARTITION BY position // 8) AS width FROM r)
SELECT id, md5(array_to_string(list_concat(list_transform(range(width - len(rev)), lambda x: 2), list_reverse(rev)), ',')) AS padded, md5(array_to_string(rev, ',')) AS reversed FROM w""")
def prompt_tokens(spark, sf):
    rows = _placed(spark, sf).withColumn("reversed", training.prompt_tokens(F.col("token_ids"), _PROMPT))
    return training.left_padded(rows, 8, 2).select("id", F.md5(_joined(F.col("padded"))).alias("padded"), F.md5(_joined(F.col("reversed"))).alias("reversed"))


def _preference(pieces: bool, name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = training.preference_text(fx.preferences(spark, sf), pieces, "<end>")
        return rows.select("id", *(F.md5(c).alias(c) for c in ("prompt_text", "chosen_text", "rejected_text")))

    run.__name__ = name
    asked = "'<|startofpiece|> ' || prompt || ' <|endofpiece|> '" if pieces else "prompt"
    query(f"""WITH {fx.WITH_PREFERENCES} SELECT id, md5({asked}) AS prompt_text, md5({asked} || chosen || '<end>') AS chosen_text, md5({asked} || rejected || '<end>') AS rejected_text
FROM preferences WHERE prompt IS NOT NULL AND chosen IS NOT NULL AND rejected IS NOT NULL""")(run)


_preference(False, "preference_text")
_preference(True, "preference_text_pieces")


@query("""WITH r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5('1234|' || doc_id), doc_id) - 1 AS place, count(*) OVER () AS n FROM documents
), b AS (SELECT *, round_even(0.2 * n, 0) AS p, round_even(0.4 * n, 0) AS q FROM r), d AS (SELECT *, p + q + q - n AS over FROM b)
SELECT id, place, (CASE WHEN place < p - over THEN 0 WHEN place < p + q - over THEN 1 ELSE 2 END)::INTEGER AS part FROM d""")
def phase_split(spark, sf):
    rows = fx.read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return training.phase_split(rows, "2,4,4", 1234, "id")


@query("""WITH u AS (SELECT 'd' || doc_id AS id FROM documents UNION ALL SELECT 'b' || item_id FROM benchmark UNION ALL SELECT 'c' || conv_id || '-' || turn FROM conversations)
SELECT id, row_number() OVER (ORDER BY md5('1234|' || id), id) - 1 AS place FROM u""")
def blend(spark, sf):
    docs = fx.read(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"))
    items = fx.read(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"))
    more = fx.read(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"))
    return training.blend([docs, items], 1234, "id", more=[more])


@query(f"""WITH {fx.WITH_TOKENS}, flat AS (SELECT id // 100 AS batch, id, unnest(ids) AS t, unnest(range(len(ids))) AS i FROM tok
), numbered AS (SELECT batch, t, row_number() OVER (PARTITION BY batch ORDER BY id, i) - 1 AS place, count(*) OVER (PARTITION BY batch) AS total FROM flat)
SELECT batch, place // 512 AS block, count(*)::INTEGER AS length, md5(string_agg(t::VARCHAR, ',' ORDER BY place)) AS input_ids FROM numbered WHERE total < 512 OR place < total // 512 * 512 GROUP BY 1, 2""")
def pack_sequences(spark, sf):
    rows = training.pack_sequences(fx.token_lists(spark, sf), 512, 100)
    return rows.select("batch", "block", F.size("input_ids").alias("length"), F.md5(_joined(F.col("input_ids"))).alias("input_ids"))


_EVAL = "'<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"


@query(f"SELECT item_id, {_EVAL} AS prompt FROM benchmark")
def eval_prompts(spark, sf):
    return training.eval_prompts(fx.eval_items(spark, sf)).select("item_id", "prompt")


@query("SELECT item_id, (item_id % 4)::VARCHAR AS dataset, '> ' || text AS output FROM benchmark")
def clean_outputs(spark, sf):
    """Prompts followed by the instruction as a quotation and the end marks, as a model's whole text."""
    rows = training.eval_prompts(fx.eval_items(spark, sf))
    made = rows.withColumn("generated", F.concat("prompt", F.lit("> "), "instruction", F.lit("<|im_end|>\n<|endoftext|>")))
    return training.clean_outputs(made).select("item_id", "dataset", "output")


@query("SELECT text AS instruction, (item_id % 4)::VARCHAR AS dataset, '> ' || text AS output, 'stub' AS generator FROM benchmark")
def eval_round_trip(spark, sf):
    path = _path(spark, "eval")
    files.write_eval_outputs(fx.eval_items(spark, sf).withColumn("output", F.concat(F.lit("> "), "instruction")), path)
    return files.read_jsonl(spark, path, "instruction string, dataset string, output string, generator string")


@query("SELECT text AS instruction, (item_id % 4)::VARCHAR AS dataset, 'stub' AS generator FROM benchmark")
def read_eval_set(spark, sf):
    """Items as one JSON array in a file."""
    path = _path(spark, "eval-set")
    items = fx.eval_items(spark, sf).select("instruction", "dataset", "generator", F.lit(1).alias("more"))
    one = items.agg(F.to_json(F.collect_list(F.struct(*items.columns))).alias("value"))  # the benchmark's items are a bounded set
    one.coalesce(1).write.text(path)
    return files.read_eval_set(spark, path)


@query("""WITH p AS (
  SELECT a.doc_id AS id, list_transform(string_split(a.text, ' '), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 50000) AS x, list_transform(string_split(b.text, ' '), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 50000) AS y
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
), w AS (SELECT *, greatest(len(x), len(y)) + 1 AS n FROM p
), d AS (SELECT *, list_filter(range(0, n - 1), lambda i: coalesce(x[i + 1], -1) <> coalesce(y[i + 1], -1))[1] AS differ FROM w)
SELECT id, (coalesce(differ, n - 1))::INTEGER AS divergence, (CASE WHEN differ IS NULL THEN n ELSE greatest(len(x), len(y)) END)::INTEGER AS "end" FROM d""")
def pair_divergence(spark, sf):
    """Each document against the next, both padded with -1 to one more than the longer."""
    rows = written(fx.token_lists(spark, sf).select("id", "token_ids"), "token-lists")
    pairs = rows.withColumnRenamed("token_ids", "x").join(rows.select((F.col("id") - 1).alias("id"), F.col("token_ids").alias("y")), "id")
    width = F.greatest(F.size("x"), F.size("y")) + 1
    pad = lambda c: F.concat(c, F.array_repeat(F.lit(-1), width - F.size(c)))
    return training.pair_divergence(pairs.select("id", pad("x").alias("chosen_ids"), pad("y").alias("rejected_ids")), -1).select("id", "divergence", "end")
