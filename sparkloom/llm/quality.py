"""Document quality by Bradley-Terry pairwise ranking.

A document's latent score is a weighted sum of text features. Every labelled
row is fitted: rows are dealt into blocks of bounded size, and random pairs of
a good and a bad document are drawn in each block, so that every row is in at
least one. The weights minimise the logistic loss of all blocks' feature
differences, by Newton steps that sum up what the blocks contribute. A quantile
of the latent scores of all labelled rows is the threshold, which ``score``
puts at ``CUT``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import kernels as K
from sparkloom.llm.scratch import Scratch, bound_batches

#: Rows of the label with more rows that a block has on average; the other label's are dealt likewise.
BLOCK_ROWS = 10_000
#: Random preference pairs of a block.
PAIRS = 200_000
#: Rows of each label that a block has on average at least; those of a rarer label are in several blocks.
LEAST_ROWS = 64
#: Distinct latent scores that a task ranks, about.
RANKED = 100_000
#: The score at the threshold.
CUT = 0.7
FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "stops", "marks", "symbols", "lines", "high", "distinct", "capital", "short_lines", "words_per_stop", "shouted", "doubled", "distinct_lines")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT, _STOP = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(".!?")
_MARK, _SYMBOL = _class(",;:'\"()-!?"), _class("@#$%^&*_+=|~<>{}[]\\/`")


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    n, size = len(off) - 1, np.diff(off)
    starts, ends, first = K.words(data, off)
    count = np.diff(first)
    row = K.row_of(first, len(starts))
    safe, some = np.maximum(size, 1), np.maximum(count, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[off[1:]] - total[off[:-1]]

    def per_row(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, values, n)

    def distinct(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, rows))
        h, r = hashes[order], rows[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        return np.bincount(r[new], minlength=n)

    hashes = K.word_hashes(data, starts, ends)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    shouted = (upper[ends] - upper[starts] > 0.6 * (ends - starts)) & (ends - starts > 2) if len(starts) else np.empty(0)
    stops, breaks = share(_STOP[data]), share(data == 10)
    doubled = np.zeros(len(data), bool)
    if len(data) > 1:
        doubled[1:] = (data[1:] == data[:-1]) & (_MARK | _SYMBOL | _STOP)[data[1:]]
    edge = np.unique(np.concatenate([off, np.flatnonzero(data == 10) + 1]))
    line_start, line_end = edge[:-1], edge[1:]
    line_row = np.searchsorted(off, line_start, "right") - 1
    line_hash = K.Rolling(data.astype(K.U) + K.U(1)).runs(line_start, line_end) if len(line_start) else np.empty(0, K.U)
    lines = np.maximum(np.bincount(line_row, minlength=n), 1)
    short = np.bincount(line_row, (line_end - line_start) < 30, n)
    table = [
        np.log1p(size), np.log1p(count), per_row(ends - starts) / some, share(_UPPER[data]) / safe, share(_DIGIT[data]) / safe,
        stops / some, share(_MARK[data]) / some, share(_SYMBOL[data]) / some, breaks / some, share(data >= 128) / safe,
        distinct(hashes, row) / some, per_row(_UPPER[data[starts]]) / some if len(starts) else np.zeros(n), short / lines,
        np.log1p(count / np.maximum(stops, 1)), per_row(shouted) / some, share(doubled) / some, distinct(line_hash, line_row) / lines,
    ]
    return np.where(size[:, None] > 0, np.stack(table, 1), 0.0)


@dataclass
class Ranker:
    """A fitted model; ``score`` rises with the latent score and is CUT at the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.latent(x) - self.threshold + np.log(CUT / (1 - CUT)), -50, 50)
        return 1 / (1 + np.exp(-z))


def _differences(model: Ranker, good: np.ndarray, bad: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    """Differences of ``pairs`` random (good, bad) pairs, and of a pair for each row that none of those has."""
    rng = np.random.default_rng(seed)
    i, j = rng.integers(len(good), size=pairs), rng.integers(len(bad), size=pairs)
    lone, other = np.flatnonzero(np.bincount(i, minlength=len(good)) == 0), np.flatnonzero(np.bincount(j, minlength=len(bad)) == 0)
    i, j = np.concatenate([i, lone, rng.integers(len(good), size=len(other))]), np.concatenate([j, rng.integers(len(bad), size=len(lone)), other])
    z = lambda x: np.clip((x - model.mean) / model.scale, -6, 6)
    return z(good)[i] - z(bad)[j]


def _slopes(d: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Second and first derivatives of the pairs' loss (the first negated), and how many pairs there are."""
    p = 1 / (1 + np.exp(-np.clip(d @ weights, -30, 30)))
    return (d * (p * (1 - p))[:, None]).T @ d, d.T @ (1 - p), len(d)


def _descend(slopes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """The weights of least loss, by Newton steps."""
    weights = np.zeros(len(FEATURES))
    for _ in range(25):
        curve, slope, n = slopes(weights)
        ridge = 1e-3 * n * np.eye(len(weights))
        step = np.linalg.solve(curve + ridge, slope - ridge @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _between(low: float | None, high: float | None) -> float:
    """The threshold of a cut between two latent scores that follow each other; none below or above: at the ends."""
    return high if low is None else low + 1e-6 if high is None else (low + high) / 2


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Ranker:
    """What ``fit`` does with one block, from arrays; without either label all scores are CUT."""
    both = np.concatenate([good, bad])
    width = len(FEATURES)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    model = Ranker(both.mean(0), np.maximum(both.std(0), 1e-6), np.zeros(width), 0.0)
    d = _differences(model, good, bad, pairs, seed)
    model.weights = _descend(lambda w: _slopes(d, w))
    latent, at = np.unique(np.concatenate([model.latent(good), model.latent(bad)]), return_inverse=True)
    # right decisions if the lowest i distinct scores are called bad
    right = len(good) + np.concatenate([[0], np.cumsum(np.bincount(at[len(good) :], minlength=len(latent)) - np.bincount(at[: len(good)], minlength=len(latent)))])
    best = np.flatnonzero(right == right.max())
    i = int(best[len(best) // 2])
    model.threshold = _between(float(latent[i - 1]) if i else None, float(latent[i]) if i < len(latent) else None)
    return model


def _features_of(docs: DataFrame, keep: list[str], text: str, model: Ranker | None) -> DataFrame:
    """Columns ``keep`` and the score, or without a model the features."""
    bound_batches(docs.sparkSession)
    name, kind = ("score", pa.float64()) if model else ("features", pa.list_(pa.float64()))
    chosen = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    schema = chosen.select("row", (F.lit(0.0) if model else F.array(F.lit(0.0))).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column(1))
            for first, last, part, at in K.chunks(data, off):
                x = features(part, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(model.score(x) if model else list(x), kind)], ["row", name])

    return chosen.mapInArrow(run, schema).select("row.*", name)


def _table(batch: pa.RecordBatch) -> np.ndarray:
    """The features column of a batch as rows."""
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _blocks(found: DataFrame, n: dict[int, int], rows: int, scratch: Scratch) -> DataFrame:
    """A row per block: its good and bad rows' features, flat, in the order of keys."""
    blocks = max(1, -(-max(n.values()) // rows))
    # a rarer label's rows go to several blocks, so that no block lacks it
    copies = {y: min(blocks, -(-LEAST_ROWS * blocks // n[y])) for y in n}
    turns = F.when(F.col("_y") == 1, copies[1]).otherwise(copies[0])
    dealt = found.withColumn("_turn", F.explode(F.sequence(F.lit(0), turns - 1)))
    dealt = dealt.select(F.pmod(F.pmod(F.xxhash64("_key"), F.lit(blocks)) + F.col("_turn"), F.lit(blocks)).cast("int").alias("_block"), "_key", "_y", "features")

    def gather(part: pa.Table) -> pa.Table:
        part = part.sort_by("_key")
        x, y = [np.concatenate(c) for c in ([_table(b) for b in part.to_batches()], [b.column("_y").to_numpy() for b in part.to_batches()])]
        flat = [pa.array([x[y == label].ravel()], pa.list_(pa.float64())) for label in (1, 0)]
        return pa.table([part["_block"].combine_chunks().slice(0, 1), *flat], ["_block", "good", "bad"])

    return scratch.put(dealt.repartition(blocks, "_block").groupBy("_block").applyInArrow(gather, "_block int, good array<double>, bad array<double>"), "blocks")


def _block_slopes(blocks: DataFrame, model: Ranker, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The blocks' derivatives, summed up; each block draws the same pairs every time."""
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                good, bad = [batch.column(c)[at].values.to_numpy().reshape(-1, width) for c in ("good", "bad")]
                if len(good) and len(bad):
                    curve, slope, n = _slopes(_differences(model, good, bad, pairs, seed + batch.column("_block")[at].as_py()), model.weights)
                    yield pa.RecordBatch.from_arrays([batch.column("_block").slice(at, 1), pa.array([np.concatenate([curve.ravel(), slope])], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["_block", "sums", "n"])

    found = blocks.mapInArrow(run, "_block int, sums array<double>, n long").orderBy("_block").collect()  # some 2 KB for each BLOCK_ROWS rows
    total = np.sum([r["sums"] for r in found], axis=0)
    return total[: width * width].reshape(width, width), total[width * width :], sum(r["n"] for r in found)


def _threshold(found: DataFrame, model: Ranker, n: dict[int, int], scratch: Scratch) -> float:
    """Where most labelled rows are decided rightly; of several such cuts between distinct latent scores, the middle one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.latent(_table(batch)), pa.float64()), batch.column("_y")], ["_z", "_y"])

    parts = -(-(n[0] + n[1]) // RANKED)
    values = found.select("_y", "features").mapInArrow(run, "_z double, _y double").groupBy("_z").agg(F.sum(F.lit(1) - 2 * F.col("_y").cast("long")).alias("_gain"))
    values = scratch.put(values.repartitionByRange(parts, "_z").withColumn("_part", F.spark_partition_id()), "values")
    # right decisions if all up to a value are called bad: the good rows, and the gains so far
    starts, so_far = {}, n[1]
    for r in values.groupBy("_part").agg(F.sum("_gain").alias("gain")).orderBy("_part").collect():
        starts[r["_part"]], so_far = so_far, so_far + r["gain"]
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair]), F.col("_part").cast("long"))
    right = scratch.put(values.select("_z", (start + F.sum("_gain").over(Window.partitionBy("_part").orderBy("_z"))).alias("_right")), "right")
    top = max(n[1], right.agg(F.max("_right")).first()[0])  # with no value called bad, the good ones are right
    best = right.where(F.col("_right") == top)
    first = int(top == n[1])
    i = (best.count() + first) // 2 - first
    low = best.orderBy("_z").offset(i).limit(1).first()["_z"] if i >= 0 else None
    high = right.where(F.lit(True) if low is None else F.col("_z") > low).agg(F.min("_z")).first()[0]
    return _between(low, high)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", rows: int = BLOCK_ROWS, pairs: int = PAIRS, seed: int = 7) -> Ranker:
    """A ranker from all texts of ``docs`` whose ``key`` has a label (1 good, 0 bad) in ``labels``.

    Means, scales, weights and threshold come from every labelled row; all good
    rows times all bad ones would be a square, so each block of about ``rows``
    rows of a label draws ``pairs`` pairs, and more for rows that those leave
    out. The driver gets sums only. Null and other labels are ignored, and so
    are keys that have both labels. Of documents that repeat a key, the text
    with the least hash is fitted. Features are worked out before the join, so
    that no text is shuffled.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    clean = labels.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_y")).where("_key is not null and _y in (0, 1)")
    clean = clean.groupBy("_key").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").select("_key", "_y")
    named = docs.select(F.col(key).alias("_key"), F.col(text).alias("_t")).where("_key is not null").withColumn("_n", F.xxhash64("_t"))
    described = _features_of(named, ["_key", "_n"], "_t", None).groupBy("_key").agg(F.min_by("features", "_n").alias("features"))
    found = scratch.put(described.join(clean, "_key").select("_key", "_y", "features"), "features")

    each = [F.col("features")[i] for i in range(len(FEATURES))]
    facts = found.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("good"), F.array(*[F.avg(x) for x in each]).alias("mean"), F.array(*[F.stddev_pop(x) for x in each]).alias("scale")).first()
    good = int(facts["good"] or 0)
    n = {1: good, 0: facts["n"] - good}
    if not all(n.values()):
        return fit_pairs(np.zeros((0, len(FEATURES))), np.zeros((0, len(FEATURES))))
    model = Ranker(np.array(facts["mean"]), np.maximum(facts["scale"], 1e-6), np.zeros(len(FEATURES)), 0.0)
    blocks = _blocks(found, n, rows, scratch)

    def slopes(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        model.weights = weights
        return _block_slopes(blocks, model, pairs, seed)

    model.weights = _descend(slopes)
    model.threshold = _threshold(found, model, n, scratch)
    scratch.drop("features", "blocks", "values", "right")
    return model


def rate(docs: DataFrame, model: Ranker, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of every row and ``score``, which replaces a column of that name.

    Null and empty texts have zero features and are scored like any other.
    Texts of any length are read whole; a task's memory follows the longest.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    return _features_of(docs, kept, text, model)
