"""Rendering, masking, truncating, padding, packing and splitting for training."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import ranked_index, seeded_key

#: What stands around the turns of each family: before and after a user turn, the assistant's header,
#: what follows a reply. {eos} is the tokenizer's own end mark.
TEMPLATES = {
    "qwen": ("<|im_start|>user\n", "<|im_end|>\n", "<|im_start|>assistant\n", "<|im_end|>\n{eos}\n"),
    "llama": ("<|start_header_id|>user|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>{eos}\n"),
    "mistral": ("[INST] ", " [/INST]\n", "", "</s>"),
    "baichuan": ("<|start_header_id|>user|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>{eos}\n"),
}
#: The same with the bracket that the user header above lacks.
FIXED = TEMPLATES | {f: ("<|start_header_id|>user<|end_header_id|>\n\n", *TEMPLATES[f][1:]) for f in ("llama", "baichuan")}
DEFAULT_SYSTEM = "You are a helpful assistant."
PIECES = ("<|startofpiece|> ", " <|endofpiece|> ")


def _segment(text: Column, mask: int) -> Column:
    return F.struct(text.alias("text"), F.lit(mask).alias("mask"))


def _is_user(m: Column) -> Column:
    return F.lower(m["role"]).isin("user", "human")


def render_chat(messages: Column, family: str, eos: str = "", templates: dict = TEMPLATES) -> Column:
    """Segments (text, mask) of a dialogue: user turns and headers 0, replies and what follows them 1.

    Every role but user and human, system too, is the assistant's.
    """
    before, after, header, end = (t.replace("{eos}", eos) for t in templates[family])

    def turn(m: Column) -> Column:
        reply = [_segment(F.concat(m["content"], F.lit(end)), 1)]
        head = [_segment(F.lit(header), 0)] if header else []
        return F.when(_is_user(m), F.array(_segment(F.concat(F.lit(before), m["content"], F.lit(after)), 0))).otherwise(F.array(*head, *reply))

    return F.flatten(F.transform(messages, turn))


def render_instruct(messages: Column, chat: bool, eos: str = "", header: tuple[str, str, str] = ("<|im_start|>", "\n", "<|im_end|>\n")) -> Column:
    """Segments with the loss on the last message only (chat), or on all replies (base form).

    Chat puts a default system message first if there is none; header holds the marks before a role, between role and
    content, and after the content.
    """
    if chat:
        has = F.exists(messages, lambda m: F.lower(m["role"]) == "system")
        system = F.array(F.struct(F.lit("system").alias("role"), F.lit(DEFAULT_SYSTEM).alias("content")))
        all_ = F.when(has, messages).otherwise(F.concat(system, messages))
        start, mid, end = header
        prompt = F.array_join(F.transform(F.slice(all_, F.lit(1), F.size(all_) - 1), lambda m: F.concat(F.lit(start), m["role"], F.lit(mid), m["content"], F.lit(end))), "")
        return F.array(_segment(F.concat(prompt, F.lit(f"{start}assistant{mid}")), 0), _segment(F.element_at(all_, -1)["content"], 1), _segment(F.lit(eos), 1))

    n = F.size(messages)

    def turn(m: Column, i: Column) -> Column:
        asked = F.array(_segment(F.concat(F.lit("### Instruction:\n"), m["content"], F.lit("\n\n### Response:\n")), 0))
        last, reply = F.array(_segment(m["content"], 1)), F.array(_segment(m["content"], 1), _segment(F.lit("\n"), 0))
        none = F.filter(asked, lambda s: F.lit(False))
        return F.when(_is_user(m), asked).when(F.lower(m["role"]) == "assistant", F.when(i < n - 1, reply).otherwise(last)).otherwise(none)

    return F.concat(F.flatten(F.transform(messages, turn)), F.array(_segment(F.lit(eos), 1)))


def word_ids(text: Column, vocabulary: int = 50_000, last: int | None = None) -> Column:
    """Numbers of the words between single spaces, or of the `last` of them: the first eight hex digits of md5, modulo the vocabulary."""
    words = F.split(text, " ", -1)
    return F.transform(truncate_left(words, last) if last else words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(vocabulary)).cast("int"))


def tokenize_segments(df: DataFrame, encode: Callable[[list[str]], list[list[int]]] | None = None, column: str = "segments", drop_first: bool = False) -> DataFrame:
    """Adds token_ids and loss_mask, of one length. encode: the caller's tokenizer over many texts; without it words
    are numbered by md5, in Spark."""
    skip = 1 if drop_first else 0
    if encode is None:
        parts = F.transform(column, lambda s: F.struct(F.slice(word_ids(s["text"]), F.lit(1 + skip), F.lit(1 << 30)).alias("ids"), s["mask"].alias("mask")))
    else:

        @F.pandas_udf("array<array<int>>")
        def tokens(texts: pd.Series) -> pd.Series:
            flat = [t for ts in texts for t in ts]
            ids = iter(encode(flat))
            return pd.Series([[list(next(ids))[skip:] for _ in ts] for ts in texts])

        parts = F.arrays_zip(tokens(F.transform(column, lambda s: s["text"])).alias("ids"), F.transform(column, lambda s: s["mask"]).alias("mask"))
    out = df.withColumn("_parts", parts)
    mask = F.flatten(F.transform("_parts", lambda p: F.array_repeat(p["mask"], F.size(p["ids"]))))
    return out.withColumn("token_ids", F.flatten(F.transform("_parts", lambda p: p["ids"]))).withColumn("loss_mask", mask).drop("_parts")


def truncate_left(tokens: Column, most: int) -> Column:
    """The last `most` tokens."""
    return F.slice(tokens, F.greatest(F.size(tokens) - most + 1, F.lit(1)), F.lit(most))


def pad_batch(rows: DataFrame, batch_size: int, pad: int, fixed: int | None = None, position: str = "position") -> DataFrame:
    """Pads token_ids with `pad` and loss_mask with 0 on the right, to the batch's longest or to `fixed`."""
    batch = F.floor(F.col(position) / batch_size)
    width = F.lit(fixed) if fixed else F.max(F.size("token_ids")).over(Window.partitionBy("batch"))
    out = rows.withColumn("batch", batch).withColumn("_width", width)
    more = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), F.greatest(F.col("_width") - F.size(c), F.lit(0))))
    return out.withColumns({"token_ids": more("token_ids", pad), "loss_mask": more("loss_mask", 0)}).drop("_width")


def shard_ordered(rows: DataFrame, world: int, position: str = "position") -> DataFrame:
    """Adds shard and the place in it: every world-th row, so that each shard keeps the order."""
    return rows.withColumn("shard", F.pmod(F.col(position), F.lit(world))).withColumn("place", F.floor(F.col(position) / world))


def write_shards(rows: DataFrame, world: int, path: str, position: str = "position") -> None:
    """shard_ordered() rows with a folder for each shard, whose files, in the order of their names, hold it in order.

    Rows are dealt by ranges of shard and place, so that a shard larger than a task becomes several files.
    """
    out = shard_ordered(rows, world, position)
    out.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """The rows of one shard in order."""
    return spark.read.parquet(path).filter(F.col("shard") == shard).orderBy("place")


def preference_text(rows: DataFrame, pieces: bool = False, end: str = "") -> DataFrame:
    """Adds prompt_text, chosen_text, rejected_text of rows (prompt, chosen, rejected); rows with a null side go."""
    before, after = PIECES if pieces else ("", "")
    asked = F.concat(F.lit(before), F.col("prompt"), F.lit(after))
    out = rows.withColumns({"prompt_text": asked, "chosen_text": F.concat(asked, "chosen", F.lit(end)), "rejected_text": F.concat(asked, "rejected", F.lit(end))})
    return out.filter(F.col("chosen_text").isNotNull() & F.col("rejected_text").isNotNull())


def prompt_tokens(tokens: Column, most: int) -> Column:
    """Reversed for padding on the left: of more than `most` tokens the last most - 1."""
    return F.reverse(F.when(F.size(tokens) > most, truncate_left(tokens, most - 1)).otherwise(tokens))


def left_padded(rows: DataFrame, batch_size: int, pad: int, column: str = "reversed", position: str = "position") -> DataFrame:
    """Pads reversed prompts to their batch's longest and turns them around again."""
    out = rows.withColumn("batch", F.floor(F.col(position) / batch_size)).withColumn("_width", F.max(F.size(column)).over(Window.partitionBy("batch")))
    return out.withColumn("padded", F.reverse(F.concat(column, F.array_repeat(F.lit(pad), F.col("_width") - F.size(column))))).drop("_width")


def split_bounds(n: int, proportions: str) -> list[int]:
    """Bounds of the parts of n rows: rounded shares added up, an overshoot taken from every bound but the first."""
    parts = np.array(proportions.split(","), dtype=float)
    ends = np.rint(n * parts / parts.sum()).astype(int).cumsum()
    return [0, *(ends + n - ends[-1]).tolist()]


def phase_split(rows: DataFrame, proportions: str, seed: int, *keys: str) -> DataFrame:
    """Adds place (by md5) and part, from 0."""
    ranked = ranked_index(rows.withColumn("_key", seeded_key(seed, *keys)), ["_key", *keys], "place").drop("_key")
    bounds = split_bounds(ranked.count(), proportions)
    part = F.lit(len(bounds) - 2)
    for i in range(len(bounds) - 3, -1, -1):
        part = F.when(F.col("place") < bounds[i + 1], i).otherwise(part)
    return ranked.withColumn("part", part)


def blend(frames: list[DataFrame], seed: int, *keys: str, more: list[DataFrame] | None = None) -> DataFrame:
    """All rows of the frames with place, an order by md5; `more` are appended to the shuffled and all shuffled again."""
    out = frames[0]
    for f in [*frames[1:], *(more or [])]:
        out = out.unionByName(f)
    return ranked_index(out.withColumn("_key", seeded_key(seed, *keys)), ["_key", *keys], "place").drop("_key")


def pack_sequences(rows: DataFrame, block: int, batch_rows: int = 1000, position: str = "position") -> DataFrame:
    """(batch, block, input_ids, labels): token lists joined in order and cut into blocks, for each batch of rows.

    What is left over is dropped, unless a batch has less than one block. A row is sent to the blocks it touches, as
    a slice for each, and never token by token.
    """
    at = Window.partitionBy("batch").orderBy(position)
    sized = rows.withColumn("batch", F.floor(F.col(position) / batch_rows)).withColumn("n", F.size("token_ids").cast("long"))
    sized = sized.withColumn("start", F.coalesce(F.sum("n").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("batch"))).filter(F.col("n") > 0)
    touched = sized.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n") - 1) / block))))
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * block)
    parts = touched.filter((F.col("total") < block) | ((F.col("block") + 1) * block <= F.col("total"))).withColumn("part", F.slice("token_ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")))
    joined = parts.groupBy("batch", "block").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("p"))
    ids = F.flatten(F.col("p.part"))
    return joined.select("batch", "block", ids.alias("input_ids"), ids.alias("labels"))


def eval_prompts(items: DataFrame) -> DataFrame:
    """Adds prompt around the instruction."""
    before, after = "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"
    return items.withColumn("prompt", F.concat(F.lit(before), F.col("instruction"), F.lit(after)))


def clean_outputs(df: DataFrame, text: str = "generated", prompt: str = "prompt") -> DataFrame:
    """Adds output: what follows the prompt's length, without end marks."""
    rest = F.substring(F.col(text), F.length(prompt) + 1, F.length(text))
    return df.withColumn("output", F.regexp_replace(rest, r"<\|im_end\|>\n<\|endoftext\|>", ""))


def pair_divergence(rows: DataFrame, pad: int, padding_at_beginning: int = 0) -> DataFrame:
    """Adds divergence, c_end, r_end, end for equally long chosen_ids and rejected_ids, places from 0.

    A side ends at the first pad after those that every sequence begins with, or at its length; end is the later one.
    Without a difference end is the length, r_end is c_end, and divergence is the last place.
    """

    def side(ids: str) -> Column:
        pads = F.filter(F.transform(ids, lambda x, i: F.when(x == pad, i)), lambda i: i.isNotNull())
        return F.coalesce(F.get(pads, F.lit(padding_at_beginning)), F.size(ids))

    differ = F.array_position(F.zip_with("chosen_ids", "rejected_ids", lambda a, b: ~a.eqNullSafe(b)), True)
    out = rows.withColumn("_at", differ).withColumn("c_end", side("chosen_ids"))
    out = out.withColumn("r_end", F.when(F.col("_at") > 0, side("rejected_ids")).otherwise(F.col("c_end")))
    out = out.withColumn("end", F.when(F.col("_at") > 0, F.greatest("c_end", "r_end")).otherwise(F.size("rejected_ids")))
    return out.withColumn("divergence", F.when(F.col("_at") > 0, (F.col("_at") - 1).cast("int")).otherwise(F.col("end") - 1)).drop("_at")
