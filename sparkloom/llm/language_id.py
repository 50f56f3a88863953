"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent 1- to 3-grams. A document's
own list is compared with each profile by the out-of-place distance: the sum
over its n-grams of how far the ranks lie apart, ``size`` for missing ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.scratch import bound_batches

#: n-grams in a profile and in a document's list.
PROFILE_SIZE = 400
#: Characters of a text that are worked on at once, and codes of a language that a task holds (about).
STRETCH, HELD = 1 << 16, 500_000
_LETTERS: list[np.ndarray] = []
_SALTS = 64


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str) -> Iterator[np.ndarray]:
    """Codes of all 1- to 3-grams, stretch by stretch; runs of non-letters are one separator, code point 1.

    Non-letters at the ends of the text count as one separator each.
    """
    lower = text.lower()
    before = np.array([1], np.int64)  # the last two points so far, or the one
    letters = False
    for at in range(0, len(lower), STRETCH):
        points = np.frombuffer(lower[at : at + STRETCH].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        letters |= bool(letter.any())
        points = np.concatenate([before, np.where(letter, points, 1), [1] if at + STRETCH >= len(lower) else []]).astype(np.int64)
        old = len(before)
        keep = np.concatenate([[True], (points[1:] != 1) | (points[:-1] != 1)])
        keep[:old] = True
        points = points[keep]
        if letters:
            new = points[old:]
            two = points[old - 1 : -1] << 21 | new
            three = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
            yield np.concatenate([new[new != 1], two, three[max(0, old - 2) :]])
        before = points[-2:]


def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) in ascending order of codes, of several such."""
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    values, which = np.unique(codes, return_inverse=True)
    return values, np.bincount(which, counts, len(values)).astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of a text; memory follows its distinct codes and STRETCH, not its length."""
    parts = []
    for codes in grams(text):
        parts.append(np.unique(codes, return_counts=True))
        if len(parts) > 16:
            parts = [counted(parts)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return parts[0] if len(parts) == 1 else counted(parts)


def ranked(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, ties by code."""
    if len(values) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    return values[np.lexsort((values, -counts))][:size]


class Profiles:
    """Learned rank lists, by language in alphabetical order."""

    def __init__(self, ranks: dict[str, list[int]], size: int = PROFILE_SIZE):
        self.names, self.size = sorted(ranks), size
        self.tables = []
        for name in self.names:
            codes = np.array(ranks[name], np.int64)
            order = np.argsort(codes)
            self.tables.append((codes[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); score is 1 less the distance's share of its maximum."""
        own = ranked(*gram_counts(text or ""), self.size)
        if not len(own) or not self.names:
            return "und", 0.0
        rank = np.arange(len(own))
        best, found = None, ""
        for name, (codes, order) in zip(self.names, self.tables, strict=True):
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            out = np.where(codes[at] == own, np.minimum(np.abs(order[at] - rank), self.size), self.size)
            distance = int(out.sum())
            if best is None or distance < best:
                best, found = distance, name
        return found, 1.0 - best / (self.size * len(own))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> Profiles:
    """Profiles from all rows of ``docs`` with text and language.

    Every text counts in full, whatever its length. n-grams are summed per batch, then by Spark; the
    driver gets ``size`` n-grams per language only. Rows without text or
    language add nothing; a language without letters has no profile.
    """

    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            held: dict[str, int] = {}

            def summed(name: str) -> pa.RecordBatch:
                values, n = counted(waiting.pop(name))
                held.pop(name)
                return pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values), pa.array(n)], ["lang", "gram", "n"])

            for row, name in enumerate(batch.column(0).to_pylist()):
                own = gram_counts(batch.column(1)[row].as_py())
                if len(own[0]):
                    waiting.setdefault(name, []).append(own)
                    held[name] = held.get(name, 0) + len(own[0])
                    if held[name] > HELD:  # merge; send on what does not shrink
                        waiting[name] = [counted(waiting[name])]
                        held[name] = len(waiting[name][0][0])
                        if held[name] > HELD // 2:
                            yield summed(name)
            for name in list(waiting):
                yield summed(name)

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    total = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    salted = total.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(_SALTS)))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("r") <= size)
    top = first.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= size)
    ranks: dict[str, list[int]] = {}
    for r in top.select("lang", "gram", "r").collect():
        ranks.setdefault(r["lang"], []).append((r["r"], r["gram"]))
    return Profiles({k: [g for _, g in sorted(v)] for k, v in ranks.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of every row, then lang_pred and score, which replace columns of those names.

    Null, empty and letterless texts get ``und`` and 0; so does every text if
    nothing was learned. Equal distances go to the alphabetically first
    language. Repeated rows and all other columns pass through.
    """
    bound_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    chosen = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("text"))
    schema = chosen.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["row", "lang_pred", "score"])

    return chosen.mapInArrow(judge, schema).select("row.*", "lang_pred", "score")
