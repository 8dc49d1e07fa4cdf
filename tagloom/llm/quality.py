"""Quality rules in DataFrame operations: fixed limits, then robust multivariate outliers.

The statistics are mean word length and the numbers of marks and of upper-case letters for each word. All three vary in
every group of documents, so that each has a scatter of its own; as they are means over a text's words, their
differences from the group's medians are multiplied by the root of the number of words, which gives short and long texts
the same spread. Repeated lines don't vary in most groups and have a limit of their own beside the estimate.

For each language and source a minimum-covariance-determinant estimate of location and scatter is sought from several
starts: the documents nearest to the present estimate (a fixed share) give the next one, until its determinant stops
falling, and the start that ends with the least determinant is kept. Documents far from its estimate by Mahalanobis
distance are rejected. Statistics enter as whole numbers on a fine grid, so that sums are exact and the result doesn't
depend on how rows are dealt.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written, written_and_seen

#: Grid points to a unit of a statistic, and of its weighted difference from the median; bins to a unit of log distance.
GRID, FINE, BINS = 1024, 128, 64
#: The least fall of a log determinant that counts as one; bins make distances as coarse as 1/BINS.
TOLERANCE = 1e-3
#: The chi-square median with as many degrees of freedom as there are statistics (3).
_MEDIAN = 2.3660
#: The 0.999 quantile of that chi-square variable: the least squared distance of an outlier.
CUTOFF = 16.2662
#: From so many words on a text's weight stays: there, texts differ by more than their words' chance.
MOST_WORDS = 1024
#: The least spread of each weighted difference: one mark or capital more in 50 words lies inside the cutoff. The spreads
#: of the given tables are about four times as large, so that the estimate decides.
RIDGES = (0.1, *(math.sqrt(50 / CUTOFF) * math.log1p(10 / 50),) * 2)
#: What small groups' scatter is drawn towards, with the weight of so many rows.
PRIOR, PRIOR_ROWS = (0.4, 1.2, 1.2), 8
#: Starts of the search beside the medians: the estimates of so many subsets, dealt by a hash of the statistics.
SUBSETS = 3
RAW = ("z0", "z1", "z2")
STATISTICS = ("u0", "u1", "u2")
_P = len(STATISTICS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
#: The counts that a document's row shows.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(docs: DataFrame, *carried: str | Column) -> DataFrame:
    """doc_id, lang, source, the carried columns, the COUNTS, n_marks and n_upper of every whole text.

    Marks are characters that are no letter, digit or white space. Null and empty texts have no words. Windows of three words are compared by a 64-bit hash inside one text.
    """
    text = F.coalesce("text", F.lit(""))
    words = docs.select("doc_id", "lang", "source", text.alias("text"), *carried).withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    n = F.size("words")
    own = [c for c in words.columns if c not in ("text", "words")]
    hashed = words.select(
        *own,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[^\p{L}\p{M}\p{N}\s]+", ""))).cast("long").alias("n_marks"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        lines.alias("lines"),
        F.when(n >= 3, F.slice(window, F.lit(1), n - 2)).alias("windows"),
    )
    again = F.size("windows") > F.size(F.array_distinct("windows"))
    ordered = hashed.select(
        *own, "n_words", "word_chars", "n_symbols", "n_marks", "n_upper",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(again, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ordered"),
    )
    twice = F.transform("ordered", lambda e, j: F.when((e["h"] == F.get("ordered", j - 1)["h"]) | F.coalesce(e["h"] == F.get("ordered", j + 1)["h"], F.lit(False)), e["i"]))
    starts = F.array_sort(F.array_compact(twice))
    start = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(starts, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    return ordered.withColumn("n_repeat_words", F.coalesce(F.when(F.col("ordered").isNotNull(), covered), F.lit(0)).cast("long")).drop("ordered")


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _grid(x: Column) -> Column:
    return F.round(x * GRID).cast("long")


def _repeats_lines() -> Column:
    """The limit of repeated lines: more than one to ten words."""
    return 10 * F.col("n_dup_lines") > F.col("n_words")


def transformed(stats: DataFrame) -> DataFrame:
    """Adds z0 to z2: logs of word length, and of marks and upper-case letters in ten words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: _grid(F.log1p(10.0 * F.col(c) / n))
    return stats.withColumns({"z0": _grid(F.log1p(F.col("word_chars") / n)), "z1": share("n_marks"), "z2": share("n_upper")})


def _medians(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, o0, o1, ...): each group's medians, exact; a group has few values, as they lie on a grid."""
    return rows.groupBy(*by).agg(*(F.round(F.percentile(z, F.lit(0.5))).cast("long").alias(f"o{i}") for i, z in enumerate(RAW)))


def _weighted() -> dict[str, Column]:
    """u0, u1, ...: differences from the medians o0, o1, ... times the root of the number of words, on their grid."""
    weight = F.sqrt(F.least(F.col("n_words"), F.lit(MOST_WORDS))) * (FINE / GRID)
    return {u: F.round((F.col(z) - F.col(f"o{i}")) * weight).cast("long") for i, (u, z) in enumerate(zip(STATISTICS, RAW, strict=True))}


def _plus(terms: Iterable[str]) -> str:
    return " + ".join(["0.0D", *terms])


def _estimate(sums: DataFrame, by: list[str], ridges: tuple[float, ...]) -> DataFrame:
    """Location m_i, inverse p_i_j of the scatter and log determinant, from sums.

    The scatter is drawn towards PRIOR as if PRIOR_ROWS rows had it, and has the squared ridges on its diagonal.
    """
    seen = {(i, j): f"(q{i}{j} / n - s{i} / n * s{j} / n) / {FINE * FINE}" for i, j in _PAIRS}
    prior = {(i, j): f"{PRIOR_ROWS * PRIOR[i] ** 2!r}D / (n + {PRIOR_ROWS}) + {ridges[i] ** 2!r}D" if i == j else "0.0D" for i, j in _PAIRS}
    steps = {f"c{i}{j}": f"{v} * (n / (n + {PRIOR_ROWS})) + {prior[i, j]}" for (i, j), v in seen.items()}
    for j in range(_P):
        steps[f"l{j}{j}"] = f"sqrt(greatest(c{j}{j} - ({_plus(f'l{j}{k} * l{j}{k}' for k in range(j))}), {ridges[j] ** 2 / 4!r}D))"
        for i in range(j + 1, _P):
            steps[f"l{i}{j}"] = f"(c{i}{j} - ({_plus(f'l{i}{k} * l{j}{k}' for k in range(j))})) / l{j}{j}"
    for j in range(_P):
        steps[f"a{j}{j}"] = f"1.0D / l{j}{j}"
        for i in range(j + 1, _P):
            steps[f"a{i}{j}"] = f"-({_plus(f'l{i}{k} * a{k}{j}' for k in range(j, i))}) / l{i}{i}"
    # in one select a step may refer to those before it; as text, because each operation on columns costs the driver a call and a stack trace, every turn
    out = sums.select(*by, *(F.expr(f"s{i} / n").alias(f"m{i}") for i in range(_P)), *(F.expr(v).alias(k) for k, v in steps.items()))
    inverse = (F.expr(_plus(f"a{k}{i} * a{k}{j}" for k in range(i, _P))).alias(f"p{i}{j}") for i, j in _PAIRS)
    log_det = F.expr(_plus(f"2.0D * ln(l{i}{i})" for i in range(_P))).alias("log_det")
    return out.select(*(F.col(c).alias(f"_{c}") for c in by), *(f"m{i}" for i in range(_P)), *inverse, log_det)


def _same(by: list[str]) -> Column:
    """The group columns equal those of an estimate, where null is equal to null."""
    return functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))


def _with(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The rows with the columns of their group's row."""
    return rows.join(groups, _same(by)).drop(*(f"_{c}" for c in by))


def _distances(rows: DataFrame, estimate: DataFrame, by: list[str]) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance from the row's group estimate, and keeps the estimate's start and scale if it has them."""
    u = [f"((u{i} - m{i}) / {FINE})" for i in range(_P)]
    d2 = F.expr(_plus(f"{1.0 if i == j else 2.0}D * p{i}{j} * {u[i]} * {u[j]}" for i, j in _PAIRS))
    joined = rows.join(estimate, _same(by), "left")
    return joined.withColumn("d2", F.when(F.col("m0").isNotNull(), F.greatest(d2, F.lit(0.0)))).drop(*(c for c in estimate.columns if c not in ("start", "scale")))


def _sums() -> list[Column]:
    first = [F.sum(f"u{i}").alias(f"s{i}") for i in range(_P)]
    return [F.count("*").alias("n"), *first, *(F.expr(f"sum(u{i} * u{j})").alias(f"q{i}{j}") for i, j in _PAIRS)]


def _below(binned: DataFrame, by: list[str], share: float) -> DataFrame:
    """Of bins (by, bin, n, ...) those up to the one at which the share of the group's rows is reached, and the part of each that belongs to it."""
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = binned.withColumn("before", before).withColumn("all", F.sum("n").over(w)).filter(F.col("before") < share * F.col("all"))
    return reached.withColumn("part", F.least(F.lit(1.0), (share * F.col("all") - F.col("before")) / F.col("n")))


def _nearest(binned: DataFrame, by: list[str], share: float) -> DataFrame:
    """Sums over the share of each group's rows with the least distance; the last bin counts with the part that makes the share exact.

    Whole bins add up as whole numbers and the last is one row, so that the order of rows changes nothing.
    """
    total = lambda c: F.expr(f"coalesce(sum(CASE WHEN part >= 1 THEN {c} END), 0) + coalesce(max(CASE WHEN part < 1 THEN part * {c} END), 0.0D)")
    names = ["n", *(f"s{i}" for i in range(_P)), *(f"q{i}{j}" for i, j in _PAIRS)]
    return _below(binned, by, share).groupBy(*by).agg(*(total(c).alias(c) for c in names))


def _bin() -> Column:
    return F.floor(F.log1p("d2") * BINS).cast("int")


def _starts(usable: DataFrame, by: list[str]) -> DataFrame:
    """Sums (by, start, n, s_i, q_i_j) that give the first estimates: start 0 from medians and spreads, the others from subsets."""
    quartiles = (F.percentile(u, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i, u in enumerate(STATISTICS))
    middle = usable.groupBy(*by).agg(F.count("*").alias("n"), *quartiles)
    square = lambda i, j: F.col(f"p{i}")[1] * F.col(f"p{j}")[1] + (F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2) if i == j else 0.0)
    sums = (*((F.col("n") * F.col(f"p{i}")[1]).alias(f"s{i}") for i in range(_P)), *((F.col("n") * square(i, j)).alias(f"q{i}{j}") for i, j in _PAIRS))
    subset = (F.pmod(F.xxhash64(*STATISTICS), F.lit(SUBSETS)) + 1).cast("int").alias("start")
    subsets = usable.groupBy(*by, subset).agg(*_sums()).filter(F.col("n") > _P)
    return middle.select(*by, F.lit(0).alias("start"), "n", *sums).unionByName(subsets)


def concentrated(usable: DataFrame, by: list[str], share: float, ridges: tuple[float, ...]) -> DataFrame:
    """The estimate of each group, of all starts the one that ends with the least determinant.

    A turn is kept where it lowers the log determinant of a start by more than TOLERANCE; a start that a turn doesn't
    lower takes no further part, as it would only meet the same estimate again, and turns end when none is left. As the
    ridges bound determinants from below, they do end. Each turn is one query that reads and writes tables, so that
    neither plans nor what the driver keeps of them grow with the turns.
    """
    keys = [*by, "start"]
    first = _estimate(_starts(usable, by), keys, ridges).withColumn("log_det", F.lit(float("inf"))).withColumn("fell", F.lit(True))
    estimate = written(first, "mcd-estimate")
    left = None
    values = [c for c in estimate.columns if c not in {"fell", *(f"_{c}" for c in keys)}]
    while left != 0:
        now = estimate.filter("fell").withColumnRenamed("_start", "start")
        binned = _distances(usable, now, by).filter(F.col("d2").isNotNull()).groupBy(*keys, _bin().alias("bin")).agg(*_sums())
        after = _estimate(_nearest(binned, keys, share), keys, ridges).select(*(F.col(f"_{c}").alias(c) for c in keys), F.struct(*values).alias("after"))
        fell = F.coalesce(F.col("after.log_det") < F.col("log_det") - TOLERANCE, F.lit(False))
        both = estimate.drop("fell").join(after, _same(keys), "left")
        turned = both.select(*(f"_{c}" for c in keys), *(F.when(fell, F.col(f"after.{c}")).otherwise(F.col(c)).alias(c) for c in values), fell.alias("fell"))
        before = estimate
        estimate, seen = written_and_seen(turned, "mcd-estimate", left=F.count_if("fell"))
        left = seen.get("left") or 0
        discard(before)
    least = F.row_number().over(Window.partitionBy(*(f"_{c}" for c in by)).orderBy(F.round("log_det", 9), "_start"))
    return estimate.withColumn("least", least).filter(F.col("least") == 1).drop("least", "fell", "_start")


def _pools(usable: DataFrame, by: list[str], least_rows: int) -> DataFrame:
    """For each group the rows that give its estimate: its own, or those that share fewer group columns until there are `least_rows`.

    `level` is the number of group columns given up, and pool0, pool1, ... hold the others' values; if the whole table
    has fewer rows, all of them are the pool.
    """
    counts = usable.groupBy(*by).agg(F.count("*").alias("n0"))
    level = F.when(F.col("n0") >= least_rows, 0)
    for k in range(1, len(by) + 1):
        keys = by[: len(by) - k]
        wider = counts.groupBy(*(F.col(c).alias(f"_{c}") for c in keys)).agg(F.sum("n0").alias(f"n{k}"))
        counts = counts.join(wider, _same(keys)).drop(*(f"_{c}" for c in keys)) if keys else counts.crossJoin(F.broadcast(wider))
        level = level.when(F.col(f"n{k}") >= least_rows, k)
    return counts.withColumn("level", level.otherwise(len(by))).select(*by, "level", *(F.when(i < len(by) - F.col("level"), F.col(c)).alias(f"pool{i}") for i, c in enumerate(by)))


def judged(stats: DataFrame, by: tuple[str, str] = ("lang", "source"), share: float = 0.75, ridges: tuple[float, ...] = RIDGES, cutoff: float = CUTOFF, least_rows: int = 60) -> DataFrame:
    """Adds base_failed and kept to counted() rows, which must come from a written table.

    The estimate of a group is that of the `share` of its rows that concentrated() ends with; rows that fail the fixed
    limits take no part. Distances are scaled so that their median is that of a chi-square variable, unless that would
    narrow them. A group with fewer than `least_rows` usable rows is judged by the estimate of its language, or else of
    all rows, however few; a language that no usable row has is judged by the limits alone. Nulls in lang or source are a
    group of their own. Spark broadcasts the groups' tables only where their files are small; a document also goes if
    more than one of its lines to ten words repeat an earlier one.
    """
    by = list(by)
    rows = transformed(stats).withColumn("base_failed", _failed())
    narrow = rows.filter(~F.col("base_failed")).select(*by, *RAW, "n_words")
    pools = written(_pools(narrow, by, least_rows), "quality-pools")
    keys = ["level", *(f"pool{i}" for i in range(len(by)))]
    needed = written(pools.select(*(F.col(c).alias(f"_{c}") for c in keys)).distinct(), "quality-needed")
    levels = narrow.withColumn("level", F.explode(F.array(*map(F.lit, range(len(by) + 1)))))
    dealt = levels.select("level", *(F.when(i < len(by) - F.col("level"), F.col(c)).alias(f"pool{i}") for i, c in enumerate(by)), *RAW, "n_words")
    pooled = dealt.join(needed, _same(keys), "left_semi")
    middles = written(_medians(pooled, keys).withColumnsRenamed({c: f"_{c}" for c in keys}), "quality-medians")
    usable = written(pooled.join(middles, _same(keys)).withColumns(_weighted()).select(*keys, *STATISTICS), "quality-usable")
    estimate = written(concentrated(usable, keys, share, ridges), "mcd-least")
    binned = _distances(usable, estimate, keys).groupBy(*keys, _bin().alias("bin")).agg(F.count("*").alias("n"))
    scale = _below(binned, keys, 0.5).groupBy(*keys).agg(F.greatest(F.lit(1.0), F.expm1((F.max("bin") + 1) / BINS) / _MEDIAN).alias("scale"))
    found = _with(_with(scale, estimate, keys), middles, keys)
    own = _with(pools, found.withColumnsRenamed({c: f"_{c}" for c in keys}), keys).drop(*keys).withColumnsRenamed({c: f"_{c}" for c in by})
    final = written(own, "mcd-estimate")
    for done in (usable, pools, needed, middles, estimate):
        discard(done)
    u = [F.coalesce(c, F.lit(0)).alias(n) for n, c in _weighted().items()]
    centres = [f"o{i}" for i in range(_P)]
    centred = rows.join(final.select(*(f"_{c}" for c in by), *centres), _same(by), "left").select(*rows.columns, *u)
    outlier = F.coalesce(F.col("d2") > cutoff * F.col("scale"), F.lit(False)) | _repeats_lines()
    return _distances(centred, final.drop(*centres), by).withColumn("kept", ~F.col("base_failed") & ~outlier).drop("scale", *RAW, *STATISTICS)


def judge(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, the COUNTS, base_failed, kept, d2) of every document.

    Null texts have no words and fail. Repeated rows each give a row; columns other than doc_id, text, lang and
    source are not read. An empty table gives no rows.
    """
    found = judged(written(counted(docs), "quality-statistics"), **limits)
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "d2")


def filtered(docs: DataFrame, **limits) -> DataFrame:
    """The rows that judge() keeps, with all their columns."""
    rows = written(counted(docs, F.struct(*(docs[c] for c in docs.columns)).alias("document")), "quality-documents")
    return judged(rows, **limits).filter("kept").select("document.*")
