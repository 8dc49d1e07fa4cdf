"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are windows over a text's words, whatever its lines: twice as long as the template's words rounded up to a
power of two, at half their length, so that every run of the template's length lies whole in one. Tokens are ordered
by how many documents hold them, rarest first. A block and a template can only reach the containment threshold if they
share a token of both prefixes, at positions that leave enough tokens, and if the block is long enough; all pairs that
pass these filters are joined on prefix tokens and checked. Short templates have words that prose holds too: a text must
also hold them in the template's order, with at most one other word between two.
"""

from __future__ import annotations

import itertools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .license_texts import NOTICES, STATEMENTS

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = STATEMENTS + NOTICES
THRESHOLD = 0.9
#: Templates of at most so many words must stand in order.
SHORT = 16
#: The least stride of windows.
LEAST_STRIDE = 8

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_text(text: Column) -> Column:
    """The words in lower case with one space between, before and after them; a single space if there are none."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), _GAP, " ")


def template_words(text: str) -> list[str]:
    """A template's words, in order, as words_text() gives them."""
    return [w for w in re.split(_GAP, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def stride(words: list[str]) -> int:
    """The distance of the windows that a template of these words is sought in; they are twice as long."""
    return max(LEAST_STRIDE, 1 << (len(words) - 1).bit_length())


def in_order(words: list[str], need: int, short: int = SHORT) -> str | None:
    """A pattern over words with single spaces that finds a short template: its words in order, at most one other between
    two, without as many of them as the threshold lets be absent; None for longer templates."""
    if len(words) > short:
        return None
    absent = len(set(words)) - need
    lines = (tuple(w for i, w in enumerate(words) if i not in out) for out in itertools.combinations(range(len(words)), absent))
    return "(^| )(" + "|".join("( [^ ]+)? ".join(line) for line in dict.fromkeys(lines)) + ")( |$)"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def base(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """Columns words, n_words, n_base, first_word, last_word and found (labels) beside doc_id."""
    with_words = docs.select("doc_id", words_text(F.col("text")).alias("words"))
    hot = F.greatest(*(F.col("words").contains(f" {p} ").cast("int") for p, _ in phrases)) == 1
    count, first, last, labels = F.lit(0), [], [], []
    for phrase, label in phrases:
        padded = f" {phrase} "
        held = F.col("words").contains(padded)
        count = count + F.when(held, F.regexp_count("words", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0)
        start = F.when(held, F.locate(padded, F.col("words")))
        back = F.when(held, F.length("words") - F.locate(padded[::-1], F.reverse("words")) - len(padded) + 2)
        first.append(_spaces(F.substring(F.col("words"), F.lit(1), start)) - 1)
        last.append(_spaces(F.substring(F.col("words"), F.lit(1), back)) - 1)
        labels.append(F.when(held, F.lit(label)))
    none = F.lit(None).cast("long")
    return with_words.select(
        "doc_id",
        "words",
        (_spaces(F.col("words")) - 1).cast("long").alias("n_words"),
        F.when(hot, count).otherwise(0).cast("long").alias("n_base"),
        F.when(hot, F.least(*first, none)).cast("long").alias("first_word"),
        F.when(hot, F.greatest(*last, none)).cast("long").alias("last_word"),
        F.when(hot, F.array_compact(F.array(*labels))).otherwise(F.array().cast("array<string>")).alias("found"),
    )


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES, short: int = SHORT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every whole text.

    Containment is the share of a template's distinct words that a window holds; the score is the largest that reaches
    the threshold, in order where the template is short, 1 where a phrase stands, else 0. Null and empty texts have no words; repeated rows each give a
    row; other columns are not read. Only texts that hold enough words of a template at all are cut into windows. The
    driver holds the counts of the templates' own words and nothing else.
    """
    known = [(k, label, template_words(text)) for k, (text, label) in enumerate(templates)]
    need = {k: math.ceil(threshold * len(set(words)) - 1e-9) for k, _, words in known}
    vocabulary = sorted({w for _, _, words in known for w in words})
    counted = base(docs, phrases).withColumn("held", F.array_intersect(F.split("words", " "), F.lit(vocabulary)))
    enough = F.lit(False)
    for least in sorted(set(need.values())):
        own = F.array(*(F.lit(sorted(set(words))) for k, _, words in known if need[k] == least))
        enough |= (F.size("held") >= least) & (F.array_max(F.transform(own, lambda t: F.size(F.array_intersect("held", t)))) >= least)
    # words are written only where some template may stand, so that the table stays small
    rows = counted.select(F.monotonically_increasing_id().alias("row"), *(c for c in counted.columns if c != "words"), F.when(enough, F.col("words")).alias("words"))
    based = written(rows, "license-words")

    counts = {r["w"]: r["n"] for r in based.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    prefixes, strides = [], {}
    for k, label, words in known:
        own = sorted(set(words), key=place.__getitem__)
        strides.setdefault(stride(words), set()).update(own)
        prefixes += [(stride(words), k, label, own, need[k], w, i) for i, w in enumerate(own[: len(own) - need[k] + 1])]
    known_rows = docs.sparkSession.createDataFrame(prefixes, "stride int, template int, label string, own array<string>, need int, token string, at int")

    def windows(n: int, own: set[str]) -> Column:
        """The windows' tokens in global order, for the templates with this stride."""
        ordered = F.lit(sorted(own, key=place.__getitem__))
        last = F.greatest(F.floor((F.size("split") - 1) / n), F.lit(0)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_intersect(ordered, F.slice("split", i * n + 1, F.lit(2 * n))))
        least = min(need[k] for k, _, words in known if stride(words) == n)
        return F.transform(F.filter(cut, lambda t: F.size(t) >= least), lambda t: F.struct(F.lit(n).alias("stride"), t.alias("tokens")))

    split = based.filter(F.col("words").isNotNull()).select("row", F.split(F.trim("words"), " ").alias("split"))
    blocks = split.select("row", F.explode(F.array_distinct(F.concat(*(windows(n, own) for n, own in sorted(strides.items()))))).alias("b")).select("row", "b.*")
    probes = blocks.select("row", "stride", "tokens", F.posexplode("tokens").alias("pos", "token"))
    size = F.size("tokens")
    fits = (size >= F.col("need")) & (F.col("pos") <= size - F.col("need")) & (F.least(size - F.col("pos"), F.size("own") - F.col("at")) >= F.col("need"))
    shared = F.size(F.array_intersect("tokens", "own"))
    pairs = probes.join(known_rows, ["stride", "token"]).filter(fits).withColumn("shared", shared).filter(F.col("shared") >= F.col("need"))
    reached = pairs.groupBy("row", "template", "label").agg(F.max(F.col("shared") / F.size("own")).alias("share"))
    # texts that hold a short template in order, told on the text itself, where all its words are at hand
    orders = {k: pattern for k, _, words in known if (pattern := in_order(words, need[k], short))}
    stands = [F.when(F.col("words").rlike(pattern), F.lit(k)) for k, pattern in orders.items()] or [F.lit(None).cast("int")]
    ordered = based.filter(F.col("words").isNotNull()).select("row", F.array_compact(F.array(*stands)).alias("ordered"))
    confirmed = reached.join(ordered, "row").filter(~F.col("template").isin(list(orders)) | F.array_contains("ordered", F.col("template")))
    matched = confirmed.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    both = based.drop("words", "held").join(matched, "row", "left")
    nothing = F.array().cast("array<string>")
    return both.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", F.array_sort(F.array_distinct("found"))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("found", F.coalesce("more", nothing)))).alias("labels"),
        F.when(F.size("found") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def sql(templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> str:
    """The same for DuckDB, each window against each template."""
    gap = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    low = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    words = [(template_words(t), label) for t, label in templates]
    needs = [math.ceil(threshold * len(set(w)) - 1e-9) for w, _ in words]
    known = ", ".join(f"({sorted(set(w))!r}, '{label}', {n}, {stride(w)}, '{in_order(w, n) or ''}')" for (w, label), n in zip(words, needs, strict=True))
    said = ", ".join(f"('{p}', '{label}')" for p, label in phrases)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, trim(regexp_replace({low.format("coalesce(text, '')")}, '{gap}', ' ', 'g')) AS norm FROM documents
), w AS (SELECT *, CASE WHEN norm = '' THEN [] ELSE string_split(norm, ' ') END AS words FROM d
), known(tokens, label, need, stride, pattern) AS (VALUES {known}
), said(phrase, label) AS (VALUES {said}
), places AS (
  SELECT doc_id, s.label, i.i - 1 AS pos FROM w, said s, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i) i
  WHERE contains(norm, s.phrase) AND array_to_string(words[i.i:i.i + len(string_split(s.phrase, ' ')) - 1], ' ') = s.phrase
), b AS (
  SELECT doc_id, count(*) AS n, min(pos) AS first, max(pos) AS last, list(DISTINCT label) AS found FROM places GROUP BY 1
), blocks AS (
  SELECT doc_id, norm, stride, list_distinct(words[i * stride + 1:(i + 2) * stride]) AS tokens
  FROM (SELECT doc_id, norm, words, stride, unnest(range(0, greatest((len(words) - 1) // stride, 0) + 1)) AS i FROM w, (SELECT DISTINCT stride FROM known))
), m AS (
  SELECT doc_id, list(DISTINCT label) AS more, max(shared / len(own)) AS share FROM (
    SELECT b.doc_id, b.norm, k.pattern, k.label, k.tokens AS own, k.need, len(list_intersect(b.tokens, k.tokens)) AS shared FROM blocks b JOIN known k USING (stride) WHERE len(b.tokens) >= k.need
  ) WHERE shared >= need AND (pattern = '' OR regexp_matches(norm, pattern)) GROUP BY 1
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(found), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(found, []), coalesce(more, [])))), ','), '') AS labels,
  (CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END)::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""
