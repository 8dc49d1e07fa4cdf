"""From combinations and samples to prompts and generated samples."""

from __future__ import annotations

import functools
import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.messages import filter_language, normalize_roles, normalize_tags
from ..functions.ordering import pick_index, ranked_index, seeded_key
from ..sources.shared import discard, exists, holds_files, shared_dir, shuffles_deleted, written

#: A job of assembled_in_jobs() moves texts of so many times the samples' bytes, and of so many bytes at least.
JOB_SHARE, JOB_BYTES = 2, 1 << 29

#: A prime of 128 bits, by which texts are told apart before they are joined.
_PRIME = 0xf1e5b48d92ec3112070e84e78a2a8407


def assign_single_tag(samples: DataFrame, seed: int = 2024, rounds: int = 1, slack: tuple[int, int] = (15, 25)) -> DataFrame:
    """Adds single_ability_tag, one of each sample's tags, so that tags are used evenly.

    Samples are dealt into `rounds` by md5. In a round each takes, by md5, one of its tags whose count so far is at
    most the least of its tags' counts plus a slack drawn for it; the counts are then renewed. One round chooses
    among the tags by how often they occur at all, the rarest, ties by md5.
    """
    rows = samples.withColumn("_round", pick_index(F.lit(rounds), seed, F.lit("round"), F.col("id").cast("string")))
    # with several rounds, a folder each, so that a round reads its own samples alone
    each = written(rows.select("id", "_round", F.explode(F.array_distinct("tags")).alias("tag")), "single-tags", by="_round" if rounds > 1 else None)
    draw = seeded_key(seed, F.col("id").cast("string"), "tag")
    if rounds == 1:
        counts = each.groupBy("tag").agg(F.count("*").alias("n"))
        chosen = each.join(counts, "tag").groupBy("id").agg(F.min_by("tag", F.struct("n", draw)).alias("single_ability_tag"))
        return samples.join(chosen, "id")
    used, done = None, None
    for r in range(rounds):
        now = each.filter(F.col("_round") == r)
        now = now.withColumn("n", F.lit(0)) if used is None else now.join(used, "tag", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        spread = F.lit(slack[0]) + pick_index(F.lit(slack[1] - slack[0] + 1), seed, F.lit("slack"), F.col("id").cast("string"))
        open_ = now.withColumn("least", F.min("n").over(Window.partitionBy("id"))).filter(F.col("n") <= F.col("least") + spread)
        picked = written(open_.groupBy("id").agg(F.min_by("tag", draw).alias("single_ability_tag")), "single-picked")
        more = picked.groupBy(F.col("single_ability_tag").alias("tag")).agg(F.count("*").alias("n"))
        used = more if used is None else used.union(more).groupBy("tag").agg(F.sum("n").alias("n"))
        used = written(used, "single-counts")
        done = picked if done is None else done.union(picked)
    return samples.join(done, "id")


def tag_index(atomic: DataFrame, seed: int = 2024, salts: int = 16) -> DataFrame:
    """(tag, idx, id, pool): the samples of each tag in an order drawn by md5, numbered from 0, and their number.

    A tag that most samples have is numbered in `salts` parts of its md5 range, shifted by the parts before.
    """
    rows = atomic.select(F.col("single_ability_tag").alias("tag"), "id").withColumn("_key", seeded_key(seed, F.col("id").cast("string")))
    rows = rows.withColumn("_salt", F.floor(F.conv(F.substring("_key", 1, 4), 16, 10).cast("long") * salts / 65536).cast("int"))
    parts = rows.groupBy("tag", "_salt").agg(F.count("*").alias("n"))
    w = Window.partitionBy("tag")
    parts = parts.withColumn("_before", F.coalesce(F.sum("n").over(w.orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("pool", F.sum("n").over(w)).drop("n")
    inner = F.row_number().over(Window.partitionBy("tag", "_salt").orderBy("_key", "id"))
    return rows.withColumn("_in", inner).join(parts, ["tag", "_salt"]).select("tag", (F.col("_before") + F.col("_in") - 1).alias("idx"), "id", "pool")


def combo_tags(combos: DataFrame) -> DataFrame:
    """(combo_id, pos, tag) of combos (combo_id, tags): the start tag and the others, in order."""
    return combos.select("combo_id", F.posexplode("tags").alias("pos", "tag"))


def match_sources(combos: DataFrame, index: DataFrame, seed: int = 2024, on_missing: str = "drop", most: int | None = None) -> DataFrame:
    """(combo_id, pos, tag, id): a sample for each tag of each combo (combo_id, tags).

    A repeated tag takes the samples after the first drawn, all of its pool before one again. A combo with a tag
    that has no sample is dropped, or, with on_missing='substitute', that tag is replaced by one drawn from those
    that have some. most: so many combos, the first by combo_id, are enough. Only ids are moved here.
    """
    if most is not None:
        combos = combos.orderBy("combo_id").limit(most)
    # written, so that Spark knows their sizes and joins small ones without dealing the combos again
    index = written(index, "tag-index")
    pools = written(index.select("tag", "pool").distinct(), "tag-pools")
    wanted = combo_tags(combos) if on_missing == "substitute" else combos.select("combo_id", F.size("tags").alias("size"), F.posexplode("tags").alias("pos", "tag"))
    if on_missing == "substitute":
        names = written(ranked_index(pools.select("tag"), ["tag"], "at").select(F.col("tag").alias("other"), "at"), "tag-names")
        many = pools.agg(F.count("*").alias("many"))
        wanted = wanted.withColumn("tag", F.trim("tag")).join(pools, "tag", "left").join(F.broadcast(many))  # one row
        drawn = pick_index(F.col("many"), seed, F.lit("other"), F.col("combo_id").cast("string"), F.col("pos").cast("string"))
        wanted = wanted.withColumn("at", F.when(F.col("pool").isNull(), drawn)).join(names, "at", "left")
        wanted = wanted.select("combo_id", "pos", F.when(F.col("pool").isNull(), F.col("other")).otherwise(F.col("tag")).alias("tag"))
    repeat = F.row_number().over(Window.partitionBy("combo_id", "tag").orderBy("pos")) - 1
    picked = wanted.join(pools, "tag").withColumn("repeat", repeat)
    if on_missing != "substitute":
        # each tag that has a pool has a sample, so that whole combos are told before samples are looked up
        picked = picked.withColumn("n", F.count("*").over(Window.partitionBy("combo_id"))).filter(F.col("n") == F.col("size"))
    idx = F.pmod(pick_index(F.col("pool"), seed, F.col("combo_id").cast("string"), "tag") + F.col("repeat"), F.col("pool"))
    return picked.withColumn("idx", idx).join(index.select("tag", "idx", "id"), ["tag", "idx"]).select("combo_id", "pos", "tag", "id")


def assemble_content(matched: DataFrame, samples: DataFrame) -> DataFrame:
    """(combo_id, source_sample_ids, combined_content_for_llm): per tag a skill_tag block, then its sample's messages.

    Samples (id, content) are joined only now, when incomplete combos are gone.
    """
    block = F.concat(F.array(F.struct(F.lit("skill_tag").alias("role"), F.col("tag").alias("content"))), F.col("content"))
    rows = matched.join(samples.select("id", "content"), "id").select("combo_id", F.struct("pos", "id", block.alias("blocks")).alias("p"))
    ordered = rows.groupBy("combo_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return ordered.select("combo_id", F.col("p.id").alias("source_sample_ids"), F.flatten("p.blocks").alias("combined_content_for_llm"))


def matched_in_jobs(matched: DataFrame, sizes: DataFrame, about: DataFrame | None = None, share: float = JOB_SHARE, least: int = JOB_BYTES, few: int = 1) -> Iterator[tuple[DataFrame, DataFrame | None]]:
    """Parts of matched, and of `about` (combo_id, ...): whole combos, `few` parts at least, to be worked on one after the other.

    A sample's text is moved once for each combo that has it, which can be a hundred times the samples. A part moves about
    `share` times the samples' bytes (`least` at least), so that disk grows with the samples, and parts with the number of
    combos for each sample. sizes: (id, octets) of the samples.
    """
    spark = matched.sparkSession
    held = written(matched, "matched")
    with shuffles_deleted(spark):
        moved, own = held.groupBy("id").agg(F.count("*").alias("n")).join(sizes, "id").agg(F.sum(F.col("n") * F.col("octets")), F.sum("octets")).first()
    jobs = max(few, -(-(moved or 0) // int(max(share * (own or 0), least))))

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        job = F.pmod(F.xxhash64("combo_id"), F.lit(jobs)).cast("int")
        return written(rows.withColumn("_job", job).repartition("_job", F.pmod(F.xxhash64("combo_id", F.lit(1)), F.lit(4))), name, by="_job")

    parts = dealt(held, "matched-parts")
    more = dealt(about, "about-parts") if about is not None else None
    discard(held)
    for job in range(jobs):
        own = lambda rows: rows.filter(F.col("_job") == job).drop("_job")  # noqa: B023, E731
        yield own(parts), None if more is None else own(more)
    discard(parts)
    if more is not None:
        discard(more)


def assembled_in_jobs(matched: DataFrame, samples: DataFrame, use: Callable[[DataFrame], DataFrame], about: DataFrame | None = None, share: float = JOB_SHARE, least: int = JOB_BYTES) -> DataFrame:
    """The rows of use(assemble_content(...)) of all combos, made in the jobs of matched_in_jobs(), one after the other.

    A job's shuffles are deleted when it ends; what stays is what `use` returns. about: (combo_id, ...), columns of combos that
    `use` gets too.
    """
    spark = matched.sparkSession
    octets = F.aggregate("content", F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.octet_length(m["content"]), F.lit(0)))
    path = f"{shared_dir(spark)}/assembled-{uuid.uuid4().hex}"
    for part, more in matched_in_jobs(matched, samples.select("id", octets.alias("octets")), about, share, least):
        rows = assemble_content(part, samples)
        made = use(rows if more is None else rows.join(more, "combo_id"))
        with shuffles_deleted(spark):
            made.write.mode("append").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def render_prompt(blocks: Column, upper_roles: bool = True) -> Column:
    """The blocks as text; roles other than user, assistant and skill_tag in capitals or as they are."""

    def line(b: Column) -> Column:
        role, said = F.coalesce(b["role"], F.lit("unknown")), F.coalesce(b["content"], F.lit(""))
        other = F.when(role.isin("user", "assistant"), role).otherwise(F.upper(role)) if upper_roles else role
        return F.when(role == "skill_tag", F.concat(F.lit("\n--- "), said, F.lit(" ---\n"))).otherwise(F.concat(other, F.lit(": "), said, F.lit("\n")))

    return F.array_join(F.transform(blocks, line), "")


def _tried(call: Callable[[str], str | None], tries: int, wait: float, gap: float = 0.0) -> Callable[[str], str | None]:
    """call, tried again after a doubling wait; None where all tries failed. gap: seconds from one text to the next."""
    free = None  # set where the calls are made, as each machine has its own clock

    def reply(prompt: str) -> str | None:
        nonlocal free
        if gap:
            if free is not None:
                time.sleep(max(0.0, free - time.monotonic()))
            free = max(free or 0.0, time.monotonic()) + gap
        for attempt in range(tries):
            try:
                return call(prompt)
            except Exception:  # noqa: BLE001 - any failure of the caller's function counts as a failed try
                if attempt + 1 < tries:
                    time.sleep(wait * 2**attempt)
        return None

    return reply


def _replies(call: Callable[[str], str | None], column: str, tries: int, wait: float, gap: float = 0.0):
    """The function for mapInPandas that adds reply, and leaves out rows whose calls all failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reply = _tried(call, tries, wait, gap)
        for batch in batches:
            batch["reply"] = [reply(prompt) for prompt in batch[column]]
            yield batch[batch["reply"].notna()]

    return run


def stored_replies(df: DataFrame, call: Callable[[str], str | None], store: str, column: str = "prompt", tries: int = 3, wait: float = 1.0, tasks: int = 8, per_second: float | None = None, batch: int = 1000) -> DataFrame:
    """(key, reply) for the texts of a column, key being their sha256: each distinct text is called once, now or earlier.

    store: a folder of earlier replies. What it lacks is called in jobs of about `batch` texts, each added to it as a whole
    when it is done, so that a run that dies loses the calls of one job. tasks: calls at once; per_second: calls a second
    of all tasks together. Texts whose calls all failed have no row and are called again by the next run.
    """
    spark = df.sparkSession
    schema = "key string, reply string"
    known = spark.read.schema(schema).parquet(store) if holds_files(spark, store) else spark.createDataFrame([], schema)
    texts = df.select(F.sha2(column, 256).alias("key"), F.col(column).alias("text")).filter("key is not null").dropDuplicates(["key"])
    todo = written(texts.join(known.select("key"), "key", "left_anti"), "calls")
    jobs = -(-todo.count() // batch)
    if jobs > 1:  # a folder for each job, so that a job reads its own texts alone
        dealt = written(todo.withColumn("_job", F.pmod(F.xxhash64("key"), F.lit(jobs)).cast("int")).repartition("_job"), "calls-by-job", by="_job")
        discard(todo)
        todo = dealt
    run = _replies(call, "text", tries, wait, tasks / per_second if per_second else 0.0)
    for job in range(jobs):
        own = todo.filter(F.col("_job") == job).drop("_job") if jobs > 1 else todo
        made = own.repartition(tasks, "key").mapInPandas(run, "key string, text string, reply string")
        with shuffles_deleted(spark):
            made.select("key", "reply").write.mode("append").parquet(store)
    discard(todo)
    return spark.read.schema(schema).parquet(store) if holds_files(spark, store) else known


def generate(df: DataFrame, call: Callable[[str], str | None], column: str = "prompt", tries: int = 3, wait: float = 1.0, tasks: int | None = None, store: str | None = None, **limits) -> DataFrame:
    """Adds reply, from `call` for each row; a failed call is tried again after a doubling wait, then its row is dropped.

    tasks: how many calls run at once. store: a folder of replies, see stored_replies(), so that a text is called once;
    without it a task that is repeated calls again.
    """
    if store:
        replies = stored_replies(df, call, store, column, tries, wait, tasks or 8, **limits)
        return df.withColumn("key", F.sha2(column, 256)).join(replies, "key").drop("key")
    schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType())])
    return (df.repartition(tasks) if tasks else df).mapInPandas(_replies(call, column, tries, wait), schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(key, rows) of batches (key, ...) where a key's rows follow one another, also over the end of a batch."""
    key, held = None, []
    for batch in batches:
        found = []
        for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and k != key:
                found.append((key, held))
                held = []
            key = k
            held.append(row)
        yield found
    if held:
        yield [(key, held)]


def _in_runs(rows: DataFrame, columns: dict[str, T.DataType], made: Callable[[list], tuple | None], tasks: int | None = None) -> DataFrame:
    """(combo_id, columns) made of each combo's rows (combo_id, pos, ...) in order of pos; a combo of which None is made goes."""
    schema = T.StructType([rows.schema["combo_id"], *(T.StructField(c, t) for c, t in columns.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow_type(f.dataType) for f in schema]
        for combos in _runs(batches):
            found = [(key, *out) for key, held in combos if (out := made(held)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], names=schema.names)

    dealt = rows.repartition(tasks, "combo_id") if tasks else rows.repartition("combo_id")
    return dealt.sortWithinPartitions("combo_id", "pos").drop("pos").mapInArrow(run, schema)


def _head(tag: Column) -> Column:
    return render_prompt(F.array(F.struct(F.lit("skill_tag").alias("role"), tag.alias("content"))))


def prompt_texts(matched: DataFrame, bodies: DataFrame, made: Callable[[str | None], tuple | None] = lambda text: (text,), columns: dict[str, T.DataType] | None = None, tasks: int | None = None) -> DataFrame:
    """(combo_id, prompt), equal to render_prompt() of assemble_content(): texts are joined where they arrive, in order.

    bodies: (id, body), samples rendered once. made: called in the same tasks with each prompt, gives the values of `columns`,
    which take the prompt's place, or None, and the combo goes. tasks: how many of them run at once.
    """
    pieces = matched.join(bodies, "id").select("combo_id", "pos", F.concat(_head(F.col("tag")), "body").alias("piece"))

    def joined(held: list) -> tuple | None:
        texts = [piece for (piece,) in held]
        return made(None if None in texts else "".join(texts))

    return _in_runs(pieces, columns or {"prompt": T.StringType()}, joined, tasks)


@functools.lru_cache(1 << 16)
def _shift(octets: int) -> int:
    return pow(256, octets, _PRIME)


@functools.lru_cache(1 << 12)
def _print(text: str) -> tuple[int, int]:
    """Length in UTF-8 and value, as a number, by the prime."""
    octets = text.encode()
    return len(octets), int.from_bytes(octets, "big") % _PRIME


def _joined_prints(prints: Iterable[tuple[int, int]]) -> tuple[int, int]:
    """The print of joined texts from that of each."""
    length, value = 0, 0
    for n, v in prints:
        length, value = length + n, (value * _shift(n) + v) % _PRIME
    return length, value


def text_prints(matched: DataFrame, bodies: DataFrame) -> DataFrame:
    """(combo_id, print) of the prompts of prompt_texts(), null ones left out: equal texts have equal prints, made without moving a text.

    Different texts have equal prints about as seldom as equal 128-bit hashes.
    """

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(None, None) if t is None else _print.__wrapped__(t) for t in batch.column(1).to_pylist()]
            values = [None if v is None else v.to_bytes(16, "big") for _, v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(values, pa.binary())], names=["id", "octets", "value"])

    kinds = T.StructType([bodies.schema["id"], T.StructField("octets", T.LongType()), T.StructField("value", T.BinaryType())])
    prints = written(bodies.select("id", "body").mapInArrow(samples, kinds), "prints")
    pieces = matched.join(prints, "id").select("combo_id", "pos", _head(F.col("tag")).alias("head"), "octets", "value")

    def joined(held: list) -> tuple | None:
        if any(value is None for _, _, value in held):
            return None
        n, value = _joined_prints(p for head, octets, v in held for p in (_print(head), (octets, int.from_bytes(v, "big"))))
        return (n.to_bytes(8, "big") + value.to_bytes(16, "big"),)

    return _in_runs(pieces, {"print": T.BinaryType()}, joined)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _stored_in_jobs(matched: DataFrame, bodies: DataFrame, sizes: DataFrame, call: Callable[[str], str | None], store: str, tasks: int, batch: int, **job) -> DataFrame:
    """generate_in_jobs() with a store."""
    spark = matched.sparkSession
    matched = written(matched, "matched")
    texts = written(text_prints(matched, bodies), "texts")
    one = written(texts.groupBy("print").agg(F.min("combo_id").alias("combo_id")), "distinct-texts")

    def work(part_of: DataFrame, columns: tuple[str, ...], made: Callable[[str | None], tuple | None], each: Callable[[DataFrame], None] = lambda rows: None, **few) -> DataFrame:
        """(combo_id, key) of the combos of part_of, whose columns are written job by job; each: called with every job's rows."""
        path, kinds = f"{shared_dir(spark)}/worked-{uuid.uuid4().hex}", {c: T.StringType() for c in columns}
        for part, _ in matched_in_jobs(matched.join(part_of.select("combo_id"), "combo_id", "left_semi"), sizes, **job, **few):
            rows, own = prompt_texts(part, bodies, made, kinds, **({"tasks": tasks} if few else {})), f"{path}/part={uuid.uuid4().hex}"
            with shuffles_deleted(spark):
                rows.write.parquet(own)
            each(spark.read.schema(rows.schema).parquet(own))
        return spark.read.schema(rows.schema).parquet(path).select("combo_id", "key")

    keys = None
    if holds_files(spark, store):  # what earlier runs have is told by the texts' own keys
        keys = work(one, ("key",), lambda text: (_sha(text),))
        known = spark.read.schema("key string").parquet(store)
        keys = written(keys.join(known, "key", "left_semi"), "known-texts")
    todo = one if keys is None else written(one.join(keys.select("combo_id"), "combo_id", "left_anti"), "new-texts")

    def answered(text: str) -> tuple | None:
        return None if (said := call(text)) is None else (_sha(text), said)

    add = lambda rows: rows.select("key", "reply").write.mode("append").parquet(store)
    if n := todo.count():
        made = work(todo, ("key", "reply"), answered, add, few=-(-n // batch))
        keys = made if keys is None else keys.unionByName(made)
    discard(matched)
    if keys is None or not holds_files(spark, store):
        return texts.select("combo_id", F.lit(None).cast("string").alias("reply")).filter("false")
    replies = written(keys.join(spark.read.schema("key string, reply string").parquet(store), "key").select("combo_id", "reply"), "replies")
    return texts.join(one.join(replies, "combo_id").select("print", "reply"), "print").select("combo_id", "reply")


def generate_in_jobs(
    matched: DataFrame, samples: DataFrame, call: Callable[[str], str | None], tries: int = 3, wait: float = 1.0, store: str | None = None,
    tasks: int = 8, per_second: float | None = None, batch: int = 1000, share: float = JOB_SHARE, least: int = JOB_BYTES,
) -> DataFrame:
    """(combo_id, reply) of the prompts of all combos, as generate() gives them, in the jobs of matched_in_jobs().

    Prompts are answered in the tasks that join them, and neither written nor sent back. store: see stored_replies(); equal
    prompts are told beforehand by text_prints(), so that each distinct one is joined and called once, in jobs of `batch` at
    most or about, of `tasks` tasks. A store that isn't empty is compared with the prompts' keys, made by joining them once more.
    """
    spark = matched.sparkSession
    bodies = written(samples.select("id", render_prompt(F.col("content")).alias("body")), "bodies")
    sizes, job = bodies.select("id", F.octet_length("body").alias("octets")), {"share": share, "least": least}
    if store:
        found = _stored_in_jobs(matched, bodies, sizes, _tried(call, tries, wait, tasks / per_second if per_second else 0.0), store, tasks, batch, **job)
    else:
        path = f"{shared_dir(spark)}/generated-{uuid.uuid4().hex}"
        reply = _tried(call, tries, wait)
        for part, _ in matched_in_jobs(matched, sizes, **job):
            made = prompt_texts(part, bodies, lambda text: None if (said := reply(text)) is None else (said,), {"reply": T.StringType()})
            with shuffles_deleted(spark):
                made.write.mode("append").parquet(path)
        found = spark.read.schema(made.schema).parquet(path)
    discard(bodies)
    return found


def gate_combos(combos: DataFrame, judge: Callable[[list[str]], str] | Column, keep_errors: bool = True, store: str | None = None, **limits) -> DataFrame:
    """The combos (combo_id, tags) whose tags, sorted, are judged YES; each distinct set is judged once.

    judge: a function of the sorted tags, or a string column over `key`. A failed call keeps the combo, or drops it without
    keep_errors. store: a folder of verdicts, see stored_replies(), that later jobs use again; failed calls aren't in it.
    """
    keyed = combos.withColumn("key", F.array_sort("tags"))
    if isinstance(judge, Column):
        verdicts = keyed.select("key").distinct().withColumn("reply", judge)
    else:
        asked = keyed.select("key").distinct().withColumn("prompt", F.to_json("key"))
        call = lambda text: judge(json.loads(text))
        if store:
            found = stored_replies(asked, call, store, **({"tries": 1} | limits))
            verdicts = asked.withColumn("at", F.sha2("prompt", 256)).join(found.withColumnRenamed("key", "at"), "at", "left")
        else:
            texts = asked.select("prompt")
            verdicts = asked.join(texts.mapInPandas(_replies(call, "prompt", 1, 0.0), "prompt string, reply string"), "prompt", "left")
    passed = verdicts.filter(F.coalesce(F.upper("reply").contains("YES"), F.lit(keep_errors))).select("key")
    return keyed.join(passed, "key", "left_semi").drop("key")


def sample_numbers(replies: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(combo_id, _number): the place, from 0, of each combo in the order."""
    order = order or ["combo_id"]
    return ranked_index(replies.select("combo_id", *(c for c in order if c != "combo_id")), order, "_number").select("combo_id", "_number")


def build_samples(replies: DataFrame, order: list[str] | None = None, with_combination: bool = True) -> DataFrame:
    """(id, label, content, source_info) of rows (combo_id, tags, content, source_sample_ids, max_conditional_se), one for
    each combo_id, numbered from 1 in the given order; rows that hold a _number of sample_numbers() keep it."""
    # only the keys are ranked; the dialogues are joined afterwards
    numbered = replies if "_number" in replies.columns else replies.join(sample_numbers(replies, order), "combo_id")
    source = [F.col("tags").alias("optimal_combination")] if with_combination else []
    return numbered.select(
        F.concat(F.lit("generated_"), (F.col("_number") + 1).cast("string")).alias("id"),
        F.struct(F.col("tags").alias("ability")).alias("label"),
        "content",
        F.struct(*source, F.col("source_sample_ids").alias("source_ids"), "max_conditional_se").alias("source_info"),
    )


def atomic_samples(seed_records: DataFrame, language: str = "en", seed: int = 2024, rounds: int = 1, store: str | None = None) -> DataFrame:
    """(id, content, tags, single_ability_tag): seed records of a language with roles, tags and one tag each.

    store: a path where they are written, and read from where they already stand.
    """
    spark = seed_records.sparkSession
    if store and exists(spark, store):
        return spark.read.parquet(store)
    rows = normalize_tags(filter_language(seed_records, language), "tags")
    found = assign_single_tag(rows.select("id", normalize_roles(F.col("conversations")).alias("content"), "tags"), seed, rounds)
    if not store:
        return found
    found.write.mode("overwrite").parquet(store)
    return spark.read.parquet(store)
