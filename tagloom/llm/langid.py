"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (1 to 3 characters of lower-cased words, with word
borders). A document's own list is compared to each profile by out-of-place distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_slices, text_slices

UNKNOWN = "und"
_BITS = np.uint64(21)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram numbers ascending, counts). Letters only; anything else is a word border, written 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    codes = np.where(_is_letter()[codes], codes, 0).astype(np.uint64)
    codes = np.r_[np.uint64(0), codes, np.uint64(0)]
    codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
    one = codes[codes != 0]
    two = (codes[:-1] << _BITS) | codes[1:]
    three = ((codes[:-2] << _BITS | codes[1:-1]) << _BITS | codes[2:])[codes[1:-1] != 0]
    return np.unique(np.r_[one, two + (np.uint64(1) << np.uint64(42)), three + (np.uint64(2) << np.uint64(61))] if len(one) else one, return_counts=True)


def _ranked(ids: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent ids, ties to the smaller id."""
    if len(ids) > size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= floor
        ids, counts = ids[keep], counts[keep]
    return ids[np.argsort(-counts, kind="stable")][:size]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (text, lang); rows with a null in either are left out. Counts are added up in
    each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in text_slices(batches):
            found: dict[str, list] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found.setdefault(lang, []).append(grams(text))
            for lang, parts in found.items():
                parts += [held[lang]] if lang in held else []
                ids, index = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                held[lang] = (ids, np.bincount(index, weights=np.concatenate([p[1] for p in parts]), minlength=len(ids)).astype(np.int64))
        for lang, (ids, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    known = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    return known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(labelled: DataFrame, size: int = 400, salts: int = 16) -> dict[str, np.ndarray]:
    """For each language its `size` most frequent n-grams in order; bounded by size times the number of languages."""
    by = [F.col("n").desc(), F.col("gram")]
    part = gram_counts(labelled).withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(salts)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).filter(F.col("r") <= size)
    top = part.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("r") <= size)
    out: dict[str, list] = {}
    for row in top.select("lang", "gram", "r").collect():
        out.setdefault(row["lang"], []).append((row["r"], row["gram"]))
    return {lang: np.array([g for _, g in sorted(rows)], dtype=np.int64).astype(np.uint64) for lang, rows in sorted(out.items())}


class Profiles:
    """All profiles as one table: n-gram to its rank in each language."""

    def __init__(self, known: dict[str, np.ndarray], size: int):
        self.langs, self.size = list(known), size
        self.ids = np.unique(np.concatenate(list(known.values()))) if known else np.zeros(0, dtype=np.uint64)
        self.rank = np.full((len(self.ids) + 1, len(self.langs)), size, dtype=np.int64)
        for k, ids in enumerate(known.values()):
            self.rank[np.searchsorted(self.ids, ids), k] = np.arange(len(ids))

    def predict(self, text: str | None) -> tuple[str, float]:
        ids, counts = grams(text or "")
        if not len(ids) or not self.langs:
            return UNKNOWN, 0.0
        own = _ranked(ids, counts, self.size)
        at = np.minimum(np.searchsorted(self.ids, own), len(self.ids) - 1)
        rank = self.rank[np.where(self.ids[at] == own, at, len(self.ids))]
        distance = np.where(rank == self.size, self.size, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.size * len(own))


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, known: dict[str, np.ndarray], size: int = 400) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text: the language at the least out-of-place distance (ties: the
    first by name) and one minus the distance's share of the largest possible.

    Null texts, texts without a letter, and all texts where no language is known give `und` and 0. Repeated rows
    each give a row; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Profiles(known, size))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sent.value.predict(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], schema=_OUT)

    return map_slices(docs.select(docs["doc_id"].cast("long"), "text"), run, _OUT)


def held_out() -> F.Column:
    """Documents kept from learning: crc32 of the decimal doc_id leaves 2 by 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
