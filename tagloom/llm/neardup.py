"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Documents of equal shingle sets are one class, and only one document of it goes on. The signature is read in several
orders (trees). A region is a set of documents that agree in the first columns of an order; one that is too large is
read deeper, each part as deep as it takes. Documents are sorted in each order, and each takes as a candidate the
sorted neighbour with the longest common prefix, and the document that most of its regions, as deep as they were read,
begin with. Then all pairs of the shallow regions are compared whose documents are not joined yet, so that reading
deeper loses none. Links are confirmed on full sets: to the candidates first, and then all pairs across the components
that a cluster still holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_slices, written
from .components import components

COLUMNS, TREES = 128, 32
WIDTH = COLUMNS // TREES
#: Columns of an order that sorting looks at, and that regions are read to where more than LARGE documents share fewer.
DEEPEST = 16
DEPTHS = (WIDTH, 6, 8, 12, DEEPEST)
LARGE = 512
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_seeds = np.random.default_rng(20240607)
_FACTOR = (_seeds.integers(1, 1 << 31, COLUMNS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _seeds.integers(0, 1 << 32, COLUMNS, dtype=np.uint32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((0x100000001B3 * 0x2545F4914F6CDD1D % (1 << 64), pow(0x100000001B3 * 0x2545F4914F6CDD1D, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, dtype=np.uint64)])
    return _powers[0][:n], _powers[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of `size` words, A-Z lower-cased; of the whole text if it has fewer words."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    gap = _SPACE[raw]
    edge = np.diff(np.r_[True, gap, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _power(len(raw) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(_LOWER[raw] * power[: len(raw)])]
    words = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    size = min(size, len(words))
    out = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        out = _mixed(out * _MULTIPLIER + np.uint64(k)) + words[k : len(words) - size + 1 + k]
    return np.unique(_mixed(out + np.uint64(size)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of COLUMNS hash functions over the set."""
    low = np.full(COLUMNS, np.iinfo(np.uint32).max, dtype=np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(x), 2048):
        y = x[a : a + 2048, None] * _FACTOR
        y += _ADD
        np.minimum(low, y.min(axis=0), out=low)
    return low


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary())])


def signed(docs: DataFrame, size: int = 2) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, signature) of every text; the signature's columns are big-endian."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([signature(s).astype(">u4").tobytes() if len(s) else None for s in sets], pa.binary())], schema=_SIGNED)

    return map_slices(docs.select(docs["doc_id"].cast("long"), docs["text"], F.xxhash64(docs["text"]).alias("text_key")), run, _SIGNED)


def _sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(node, hashes) of classes (node, first, set_key): first is the doc_id of a document of the class."""
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, out = [], []
        for node, key, text in zip(*(batch.column(c).to_pylist() for c in ("node", "set_key", "text")), strict=True):
            hashes = shingles(text, size).tobytes()
            if xxhash.xxh3_128_digest(hashes) == key:  # another document may have the same doc_id
                nodes.append(node), out.append(hashes)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], schema=schema)

    some = docs.select(docs["doc_id"].cast("long").alias("own"), docs["text"].alias("text")).join(classes, F.col("own").eqNullSafe(F.col("first")))
    return map_slices(some.select("node", "set_key", "text"), run, schema).dropDuplicates(["node"])


def _agree(pairs: DataFrame, signatures: DataFrame, least: int) -> DataFrame:
    """Of pairs (a, b) those whose signatures agree in `least` columns at least."""
    a, b = (signatures.select(F.col("node").alias(x), F.col("signature").alias(f"s{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, COLUMNS) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def _neighbours(rows: DataFrame) -> DataFrame:
    """(a, b): each document and the neighbour with the longest common prefix over all sorted orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_tree = last_order = last_doc = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, doc = batch.column("tree").to_numpy(), batch.column("node").to_numpy()
            order = np.frombuffer(b"".join(batch.column("order").to_pylist()), dtype=np.uint32).reshape(-1, DEEPEST)
            if last_doc is not None:
                tree, doc, order = np.r_[last_tree, tree], np.r_[last_doc, doc], np.vstack([last_order, order])
            depth = np.cumprod(order[1:] == order[:-1], axis=1).sum(axis=1)
            at = np.flatnonzero((tree[1:] == tree[:-1]) & (depth >= WIDTH) & (doc[1:] != doc[:-1]))
            last_tree, last_doc, last_order = tree[-1:], doc[-1:], order[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(doc[at + 1]), pa.array(doc[at]), pa.array(depth[at].astype(np.int32))], names=["a", "b", "depth"])

    near = rows.repartitionByRange("tree", "order", "node").sortWithinPartitions("tree", "order", "node").mapInArrow(run, "a long, b long, depth int")
    return near.groupBy("a").agg(F.max(F.struct("depth", "b"))["b"].alias("b"))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key in turn; the batches must be sorted by the keys (integers)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if last is not None and (values[a] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = values[a]
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, COLUMNS)


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    same = np.zeros((len(x), len(y)), dtype=np.uint8)
    for c in range(COLUMNS):
        same += x[:, c, None] == y[None, :, c]
    return same


class _Forest:
    """Which labels a tile has joined so far; only joins that are new to it are worth reporting."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _tiles(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Deals each group's rows (key, node, label, ...) out as tiles: blocks of all but its largest label (side 0)
    against blocks of all its rows (side 1). Groups of one label have none. The groups' sizes are a table of their own,
    so that the joins can split a group of very many rows."""
    sizes = rows.groupBy(key, "label").agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("m"), F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main"))
    mixed = rows.join(written(sizes.filter(F.col("labels") > 1), "neardup-sizes"), key).withColumn("of", F.ceil(F.col("m") / block).cast("int"))
    own = mixed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    minor = own.filter(F.col("label") != F.col("main"))
    held = written(minor.select(key, F.col("part").alias("i")).distinct(), "neardup-held")
    left = minor.withColumn("i", F.col("part")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).withColumn("side", F.lit(0))
    right = own.withColumn("j", F.col("part")).join(held, key).withColumn("side", F.lit(1))
    columns = [key, "i", "j", "side", *(c for c in rows.columns if c != key)]
    return left.select(*columns).union(right.select(*columns))


def _labelled(groups: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """(key, node, label) of the groups (key, node) that hold more than one label; a node without one is its own."""
    rows = groups.select(key, "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = rows.groupBy(key).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter(F.col("low") < F.col("high")).select(key)
    return written(rows.join(written(mixed, "neardup-mixed"), key, "left_semi").select(key, "node", "label"), "neardup-labelled")


def _joined_labels(regions: DataFrame, labels: DataFrame, signatures: DataFrame, agree: int, block: int = LARGE) -> DataFrame:
    """(a, b): labels that pairs of one region (key, node) connect, whose signatures agree in enough columns.

    Every pair across labels is compared, in tiles; a tile reports no connection twice, so that what it reports is
    no more than its labels.
    """
    tiles = _tiles(_labelled(regions, "key", labels), "key", block).join(signatures, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for tile in _groups(batches, ["key", "i", "j"]):
            side, label, marks = tile["side"].to_numpy(), tile["label"].to_numpy(), _matrix(tile["signature"])
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(x) or not len(y):
                continue
            hit = (_agreement(marks[x], marks[y]) >= agree) & (label[x][:, None] != label[y][None, :])
            forest = _Forest()
            for i, j in np.unique(np.stack([label[x][hit.nonzero()[0]], label[y][hit.nonzero()[1]]], axis=1), axis=0).tolist():
                if forest.join(i, j):
                    a.append(i), b.append(j)
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(run, "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    least, most = min(len(x), len(y)), max(len(x), len(y))
    if 100 * least < percent * most:
        return False
    shared = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _stars(pairs: DataFrame, sets: DataFrame, percent: int, salts: int = 64) -> DataFrame:
    """Of pairs (a, b), many with the same b, those whose full sets reach the similarity. A set of b is sent once for
    each salt, one of a once for each pair."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)))
    own = dealt.select("b", "salt", F.lit(1).alias("side"), F.col("a").alias("node"))
    centre = dealt.select("b", "salt").distinct().select("b", "salt", F.lit(0).alias("side"), F.col("b").alias("node"))
    rows = own.union(centre).join(sets.select("node", "hashes"), "node").repartition("b", "salt").sortWithinPartitions("b", "salt", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            a, b = [], []
            for centre_, side, node, hashes in zip(*(batch.column(c).to_pylist() for c in ("b", "side", "node", "hashes")), strict=True):
                if side == 0:
                    at, held = centre_, np.frombuffer(hashes, dtype=np.uint64)
                elif at == centre_ and _similar(np.frombuffer(hashes, dtype=np.uint64), held, percent):
                    a.append(node), b.append(centre_)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.select("b", "side", "node", "hashes").mapInArrow(run, "a long, b long")


def _remaining(clusters: DataFrame, labels: DataFrame, sets: DataFrame, signatures: DataFrame, agree: int, percent: int, block: int = 256) -> DataFrame:
    """(a, b): links across the labels of a cluster (node, cluster), confirmed on full sets.

    All pairs across labels whose signatures agree in enough columns are confirmed, but for those whose labels an
    earlier link of the tile already joins.
    """
    tiles = _tiles(_labelled(clusters, "cluster", labels), "cluster", block).join(signatures, "node").join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _groups(batches, ["cluster", "i", "j"]):
            side, node, label, marks = tile["side"].to_numpy(), tile["node"].to_numpy(), tile["label"].to_numpy(), _matrix(tile["signature"])
            sets_ = [np.frombuffer(h, dtype=np.uint64) for h in tile["hashes"].to_pylist()]
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(x) or not len(y):
                continue
            same = _agreement(marks[x], marks[y])
            i, j = np.nonzero((same >= agree) & (label[x][:, None] != label[y][None, :]))
            forest, a, b = _Forest(), [], []
            for k in np.argsort(-same[i, j].astype(np.int32), kind="stable").tolist():  # the likeliest first
                p, q = x[i[k]], y[j[k]]
                if forest.root(label[p]) != forest.root(label[q]) and _similar(sets_[p], sets_[q], percent):
                    forest.join(label[p], label[q])
                    a.append(node[p]), b.append(node[q])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return tiles.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side").mapInArrow(run, "a long, b long")


def _prefix(tree: int | Column, depth: int) -> Column:
    """The first `depth` columns of the signature in a tree's order."""
    start = 4 * WIDTH * tree + 1 if isinstance(tree, int) else tree * (4 * WIDTH) + 1
    return F.substring(F.concat("signature", "signature"), start, F.lit(4 * depth) if isinstance(tree, Column) else 4 * depth)


def _regions(rows: DataFrame) -> DataFrame:
    """(node, tree, key, n, centre) of rows (node, tree, key) in regions of two documents or more; n is a region's size and
    centre its least node."""
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre")).filter(F.col("n") >= 2)
    return written(rows.join(written(shared, "neardup-shared"), "key").select("node", "tree", "key", "n", "centre"), "neardup-regions")


def _shallow(signatures: DataFrame) -> DataFrame:
    trees = F.explode(F.array(*(F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), _prefix(t, WIDTH)).alias("key")) for t in range(TREES))))
    return _regions(signatures.select("node", trees.alias("r")).select("node", "r.tree", "r.key"))


def _deeper(signatures: DataFrame, wide: DataFrame, large: int) -> DataFrame:
    """The regions (node, tree, ...) of more than `large` documents read at the greater DEPTHS: the parts that are small
    enough, and at the last depth all."""
    rows = wide.select("node", "tree").join(signatures, "node")
    keys = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.xxhash64("tree", F.lit(d), _prefix(F.col("tree"), d)).alias("key")) for d in DEPTHS[1:])))
    deep = rows.select("node", "tree", keys.alias("r")).select("node", "tree", "r.depth", "r.key")
    shared = deep.groupBy("key", "depth").agg(F.count("*").alias("n"), F.min("node").alias("centre")).filter((F.col("n") >= 2) & ((F.col("n") <= large) | (F.col("depth") == DEEPEST)))
    return deep.select("node", "tree", "key").join(written(shared.drop("depth"), "neardup-shared"), "key").select("node", "tree", "key", "n", "centre")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after further links (a, b) between nodes, or labels of nodes."""
    if not links.take(1):
        return labels
    at = [links.select("a", "b")]
    for end in "ab":  # as links between labels; a node without one is its own
        own = labels.select(F.col("node").alias(end), F.col("label").alias("to"))
        at.append(at[-1].join(own, end, "left").withColumn(end, F.coalesce("to", end)).select("a", "b"))
    joined = written(components(at[-1]).withColumnRenamed("label", "to"), "neardup-merged")
    known = labels.join(joined.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    new = joined.join(labels.select("node"), "node", "left_anti").select("node", F.col("to").alias("label"))
    return written(known.union(new), "neardup-labels")


def _grouped(docs: DataFrame, size: int, percent: int, agree: int, large: int) -> DataFrame:
    """near_duplicates() with text_key, a hash of the row's text."""
    marks = written(signed(docs, size).withColumn("mark", F.monotonically_increasing_id()), "neardup-signatures")
    classes = written(marks.filter(F.col("n_shingles") > 0).groupBy("set_key").agg(F.min("mark").alias("node"), F.min("doc_id").alias("first")), "neardup-classes")
    signatures = written(classes.select("node").join(marks.select(F.col("mark").alias("node"), "signature"), "node"), "neardup-first")

    shallow = _shallow(signatures)
    regions, wide = shallow.filter(F.col("n") <= large), shallow.filter(F.col("n") > large)
    if wide.take(1):
        regions = regions.union(_deeper(signatures, wide, large))

    # candidates: sorted neighbours, and the document that most often is the first of a document's regions
    sorted_rows = written(shallow.select("node", "tree").join(signatures, "node").select("node", "tree", _prefix(F.col("tree"), DEEPEST).alias("order")), "neardup-orders")
    near = _neighbours(sorted_rows)
    often = regions.filter(F.col("node") != F.col("centre")).groupBy("node", "centre").agg(F.count("*").alias("n"))
    star = often.groupBy(F.col("node").alias("a")).agg(F.max(F.struct("n", (-F.col("centre")).alias("c"))).alias("m")).select("a", (-F.col("m.c")).alias("b"))
    candidates = written(_agree(near.select("a", "b").union(star).distinct(), signatures, agree), "neardup-candidates")
    discard(sorted_rows)
    clusters = written(components(candidates), "neardup-clusters")
    more = written(_joined_labels(shallow, clusters, signatures, agree), "neardup-joined")
    clusters = _merged(clusters, more)
    members = clusters.select("node", F.col("label").alias("cluster"))

    sets = written(_sets(docs, classes.join(members.select("node"), "node", "left_semi"), size), "neardup-sets")
    links = written(_stars(candidates, sets, percent), "neardup-links")
    labels = written(components(links), "neardup-labels")
    labels = _merged(labels, written(_remaining(members, labels, sets, signatures, agree, percent), "neardup-links"))

    least = classes.join(labels, "node").groupBy("label").agg(F.min("first").alias("component"))
    of = written(classes.join(labels.join(least, "label"), "node", "left").select("set_key", F.coalesce("component", "first").alias("component")), "neardup-components")
    for t in (shallow, sets, signatures):
        discard(t)
    member = marks.select("doc_id", "text_key", "n_shingles", "set_key").join(of, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return member.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, agree: int = 79, large: int = LARGE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of documents linked at `percent` similarity of their sets of `size`-word shingles.

    Only pairs whose signatures agree in `agree` of 128 columns are confirmed; a pair at 80 % fails that, or shares
    no region, about once in a million. Regions of more than `large` documents are read deeper first. Null texts and
    texts without words have no shingles and link with nothing, not even with one another. Each row is a document, also
    where several have one doc_id; component_id is the least doc_id that its row reaches, null where none has one.
    Other columns are not read. An empty table gives no rows.
    """
    return _grouped(docs, size, percent, agree, large).drop("text_key")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows without those that near_duplicates() doesn't keep; rows without a doc_id stay, as do all rows that
    repeat a kept one with its doc_id."""
    rows = _grouped(docs, size, percent, 79, LARGE).filter(~F.col("kept"))
    gone = written(rows.select("doc_id", "text_key").distinct(), "neardup-gone")
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_key"]), "left_anti")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS grams FROM w
), e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS g FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, c.b FROM r JOIN c ON r.other = c.a
), m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(grams)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""
