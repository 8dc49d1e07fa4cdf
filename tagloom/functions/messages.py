"""Tags, roles and dialogues: extraction, checks and normal forms."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIALOGUE = "array<struct<role:string,content:string>>"
SCALARS = ("STRING", "BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "BOOLEAN")


_QUOTED = r"'[^'\\\n\r\x00]*'"
_PLAIN_VALUE = rf"(?:None|True|False|{_QUOTED})"
#: Literals of quoted words without escapes: a list of tags first, then keys with simple values, none of them ability_zh again.
_PLAIN = rf"^\{{'ability_zh': ?\[({_QUOTED}(?:, ?{_QUOTED})*)\](?:, ?(?!'ability_zh'){_QUOTED}: ?{_PLAIN_VALUE})*\}}\z"


def plain_tags(label: Column) -> Column:
    """The tags of a literal of the plain form above, null for all others; no Python is needed."""
    return F.when(label.rlike(_PLAIN), F.regexp_extract_all(F.regexp_extract(label, _PLAIN, 1), F.lit(r"'([^']*)'"), F.lit(1)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal_tags(labels: pd.Series) -> pd.Series:
    """Tags of Python literals that JSON can't read."""

    def tags(label: str | None) -> list[str] | None:
        if label is None:
            return None
        try:
            found = ast.literal_eval(label)["ability_zh"]
        except (ValueError, SyntaxError, TypeError, KeyError, MemoryError, RecursionError):
            return None
        return [str(t) for t in found] if isinstance(found, (list, tuple)) and found else None

    return labels.map(tags)


def extract_tags(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds tags, from a struct or from a literal in a string; rows without a non-empty list of tags go.

    Strings of the plain form are cut by a pattern, others are read as JSON with single quotes; only those that fail go through Python.
    """
    if df.schema[label].dataType.typeName() == "struct":
        found = F.col(f"{label}.ability_zh")
    else:
        read = F.from_json(label, "struct<ability_zh:array<string>>", {"allowSingleQuotes": "true"})["ability_zh"]
        df = df.withColumn("_plain", plain_tags(F.col(label)))
        df = df.withColumn("_quick", F.when(F.col("_plain").isNotNull(), F.col("_plain")).otherwise(read)).drop("_plain")
        slow = F.when(F.col("_quick").isNull() & F.col(label).isNotNull(), F.col(label))
        found = F.coalesce("_quick", _literal_tags(slow))
    return df.withColumn("tags", found).drop("_quick").filter(F.size("tags") > 0)


def filter_language(df: DataFrame, language: str = "en", column: str = "langdetect") -> DataFrame:
    return df.filter(F.col(column) == language)


def normalize_roles(conversations: Column) -> Column:
    """{from, value} as {role, content}: human is user, all others assistant; no value is an empty one."""
    role = lambda x: F.when(x["from"] == "human", "user").otherwise("assistant")
    return F.transform(conversations, lambda x: F.struct(role(x).alias("role"), F.coalesce(x["value"], F.lit("")).alias("content")))


def normalize_tags(df: DataFrame, column: str, out: str = "tags") -> DataFrame:
    """An array as it is, one tag as an array of one; rows without a tag go."""
    kind = df.schema[column].dataType.typeName()
    tags = F.col(column) if kind == "array" else F.when(F.col(column).isNotNull() & (F.col(column) != ""), F.array(F.col(column)))
    return df.withColumn(out, tags).filter(F.size(out) > 0)


def trim_tag(tag: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(tag, r"^\s+|\s+$", "")


def _messages(v: Column) -> Column:
    return F.try_variant_get(v, "$.content", "array<variant>")


def _kind(m: Column, path: str) -> Column:
    """The type of a message's field: null where it is missing, VOID for JSON null."""
    return F.schema_of_variant(F.try_variant_get(m, path, "variant"))


def _bad(m: Column) -> Column:
    kind = _kind(m, "$.content")
    scalar = kind.isin(*SCALARS) | kind.startswith("DECIMAL")
    return ~(F.coalesce(_kind(m, "$.role").isNotNull(), F.lit(False)) & F.coalesce(scalar, F.lit(False)))


def _text(m: Column) -> Column:
    """A message's content as Python's str() gives it: booleans with a capital."""
    said = F.try_variant_get(m, "$.content", "string")
    return F.when(_kind(m, "$.content") == "BOOLEAN", F.initcap(said)).otherwise(said)


def dialogue_reason(v: Column, no_cjk: bool = False) -> Column:
    """'ok', 'invalid' or, with no_cjk, 'chinese' for a sample as a variant. The first offending message decides."""
    found = _messages(v)
    bad = F.array_position(F.transform(found, _bad), True)
    usable = found.isNotNull() & (F.size(found) > 0)
    if not no_cjk:
        return F.when(usable & (bad == 0), "ok").otherwise("invalid")
    cjk = F.array_position(F.transform(found, lambda m: ~_bad(m) & F.coalesce(_text(m).rlike("[\\u4e00-\\u9fff]"), F.lit(False))), True)
    return F.when(~usable, "invalid").when((cjk > 0) & ((bad == 0) | (cjk < bad)), "chinese").when(bad > 0, "invalid").otherwise("ok")


def dialogue(v: Column) -> Column:
    """A sample's messages {role, content} with numbers and booleans as text."""
    return F.transform(_messages(v), lambda m: F.struct(F.try_variant_get(m, "$.role", "string").alias("role"), _text(m).alias("content")))


def valid_dialogues(samples: DataFrame, no_cjk: bool = False, column: str = "v") -> DataFrame:
    """Valid samples only, with their messages as `content`."""
    return samples.filter(dialogue_reason(F.col(column), no_cjk) == "ok").withColumn("content", dialogue(F.col(column)))


def filter_report(samples: DataFrame, no_cjk: bool = True, column: str = "v") -> DataFrame:
    """(reason, n) over all samples."""
    return samples.groupBy(dialogue_reason(F.col(column), no_cjk).alias("reason")).agg(F.count("*").alias("n"))


def without_fences(text: Column) -> Column:
    """A reply's text inside its code fence: the opening mark and the last three characters go."""
    bare = trim_tag(text)
    inside = lambda skip: trim_tag(F.substring(bare, F.lit(skip + 1), F.greatest(F.length(bare) - (skip + 3), F.lit(0))))
    return F.when(F.startswith(bare, F.lit("```python")), inside(9)).when(F.startswith(bare, F.lit("```")), inside(3)).otherwise(bare)


@F.pandas_udf(T.StringType())
def _literal_json(texts: pd.Series) -> pd.Series:
    """Python literals as JSON, null where the text is none."""

    def read(text: str | None) -> str | None:
        try:
            return json.dumps(ast.literal_eval(text), ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return texts.map(read)


_SAID = r"'[^'\"\\\x00-\x1f]*+'"
_MESSAGE = rf"\{{'role': {_SAID}, 'content': {_SAID}\}}"
#: Literals of messages whose texts hold no quotes, and of escapes only those that JSON writes alike, each put as an x before.
_MESSAGES = rf"^\[{_MESSAGE}(?:, {_MESSAGE})*+\]\z"


def plain_messages(text: Column) -> Column:
    """The JSON of a literal of the plain form above, null for all others and for long ones; no Python is needed."""
    told = (F.length(text) < 20_000) & F.regexp_replace(text, r"\\[nrt\\]", "x").rlike(_MESSAGES)
    return F.when(told, F.translate(text, "'", '"'))


def parse_reply(df: DataFrame, column: str = "reply", strip_fences: bool = True) -> DataFrame:
    """Adds parsed and content (JSON): the reply as a Python literal, or the reply itself as a JSON string."""
    read = df.withColumn("_text", without_fences(F.col(column)) if strip_fences else trim_tag(F.col(column)))
    read = read.withColumn("_plain", plain_messages(F.col("_text")))
    slow = F.when(F.col("_plain").isNull() & (F.col("_text") != ""), F.col("_text"))
    read = read.withColumn("_json", F.coalesce("_plain", _literal_json(slow))).drop("_text", "_plain")
    kept = F.to_json(F.struct(F.col(column).alias("s")))
    return read.withColumn("parsed", F.col("_json").isNotNull()).withColumn("content", F.coalesce("_json", F.regexp_extract(kept, r"(?s)^\{\"s\":(.*)\}$", 1))).drop("_json")


def first_role(content: Column, role: str) -> Column:
    """The content of the first message of a role, or null."""
    return F.get(F.filter(content, lambda m: m["role"] == role), F.lit(0))["content"]
