"""Where texts repeat: the exact filter that both repeat finders share.

A repeat of ``size`` symbols contains ``size - k + 1`` k-grams, and the least
of their hashes, the window's anchor, depends on the window alone. Two equal
windows share their anchor, so a window whose anchor occurs in one document
only cannot repeat across documents. Anchors are few (about 2 / (size - k + 2)
of all positions), and only documents' distinct ones are exchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import kernels as K
from sparkloom.llm.scratch import Scratch

#: symbols(bytes, offsets) -> (64-bit symbols, each text's first symbol, and the end)
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def byte_symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return K.BYTE_SYMBOLS[data], off


def word_symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = K.words(data, off)
    return K.word_hashes(data, starts, ends), first


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (a, b), sorted by a, then b."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _anchors(docs: DataFrame, symbols: Symbols, size: int, k: int) -> DataFrame:
    """(anchor, doc, known): distinct anchors of each document.

    Of documents that share an anchor within a chunk one is sent on to meet
    other chunks, and all are sent with ``known``, as the anchor repeats
    already. So a very common passage costs a row per chunk and anchor there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            data, off = K.utf8(batch.column(1))
            for lo, _, part, at in K.chunks(data, off, 4 * K.CHUNK):
                anchors, owners = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for first, _, piece, cut in K.chunks(part, at):
                    s, begin = symbols(piece, cut)
                    starts, least, _ = K.window_minima(s, begin, size, k)
                    row = np.searchsorted(begin, starts, "right") - 1
                    change = np.ones(len(least), bool)
                    change[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                    anchors.append(K.signed(least[change]))
                    owners.append(doc[lo + first + row[change]])
                a, d = distinct_pairs(np.concatenate(anchors), np.concatenate(owners))
                lead = np.ones(len(a), bool)
                lead[1:] = a[1:] != a[:-1]
                begin = np.flatnonzero(lead)
                many = np.repeat(np.diff(np.append(begin, len(a))) > 1, np.diff(np.append(begin, len(a))))
                known = np.concatenate([np.zeros(len(begin), bool), np.ones(int(many.sum()), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[begin], a[many]])), pa.array(np.concatenate([d[begin], d[many]])), pa.array(known)], ["anchor", "doc", "known"])

    return docs.mapInArrow(run, "anchor long, doc long, known boolean")


def _shared(anchors: DataFrame) -> DataFrame:
    """(doc, anchor) of anchors in two documents or more; streams over sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        for batch in batches:
            a, d, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            out = [(d[known], a[known])]
            a, d = a[~known], d[~known]
            if len(a):
                if last is not None:
                    a, d = np.append(last[0], a), np.append(last[1], d)
                pair = np.flatnonzero((a[1:] == a[:-1]) & (d[1:] != d[:-1]))
                out += [(d[pair], a[pair]), (d[pair + 1], a[pair + 1])]
                last = (a[-1], d[-1])
            doc, anchor = distinct_pairs(*(np.concatenate(x) for x in zip(*out, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(anchor)], ["doc", "anchor"])

    spread = F.when(F.col("known"), F.xxhash64("doc", "anchor")).otherwise(F.col("anchor"))
    return anchors.repartition(spread).sortWithinPartitions("anchor", "doc").mapInArrow(run, "doc long, anchor long")


def units(docs: DataFrame) -> DataFrame:
    """(sha, unit, name): each distinct text's SHA-256, least key and 64-bit name; of (doc, text). Equal texts are looked at once."""
    named = docs.where("doc is not null").select("doc", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("name"))
    return named.groupBy("sha").agg(F.min("doc").alias("unit"), F.min("name").alias("name"))


def suspects(docs: DataFrame, unit: DataFrame, symbols: Symbols, size: int, k: int, hot_texts: int, scratch: Scratch) -> DataFrame:
    """(doc, name, text, anchors, hot): distinct texts with anchors that other texts have too; as packed longs.

    docs: (doc long, text), no null. hot: those of the anchors that more than ``hot_texts`` texts have.
    """
    named = docs.select(F.xxhash64("text").alias("name"), "text")
    shared = scratch.put(_shared(_anchors(named, symbols, size, k)), "anchors")  # a row may come twice
    hot = shared.groupBy("anchor").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > hot_texts).select("anchor", F.col("anchor").alias("hot"))
    hot = scratch.put(hot, "hot")
    lists = shared.join(hot, "anchor", "left").groupBy(F.col("doc").alias("name")).agg(F.collect_list("anchor").alias("anchors"), F.collect_list("hot").alias("hot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column(0)]
            for lists in batch.columns[1:]:
                first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                out.append(K.packed(lists.flatten().to_numpy(), first))
            yield pa.RecordBatch.from_arrays(out, ["name", "anchors", "hot"])

    packed = lists.mapInArrow(run, "name long, anchors binary, hot binary").join(unit.select("unit", "name"), "name")
    texts = docs.select("doc", F.xxhash64("text").alias("name"), "text")
    return texts.join(packed.withColumnRenamed("unit", "doc").hint("shuffle_hash"), ["doc", "name"]).select("doc", "name", "text", "anchors", "hot")


class Windows:
    """The windows of a chunk of texts that have repeated anchors: start, row, anchor, whether it is hot, rolling hashes, each row's first symbol."""

    def __init__(self, data: np.ndarray, off: np.ndarray, anchors: list[np.ndarray], hot: list[np.ndarray], symbols: Symbols, size: int, k: int):
        s, self.first = symbols(data, off)
        start, least, self.rolling = K.window_minima(s, self.first, size, k)
        row = np.searchsorted(self.first, start, "right") - 1
        least = K.signed(least)
        keep, warm = np.zeros(len(start), bool), np.zeros(len(start), bool)
        bounds = np.searchsorted(row, np.arange(len(off)))
        for i in range(len(off) - 1):
            mine = slice(bounds[i], bounds[i + 1])
            keep[mine] = _among(least[mine], anchors[i])
            if len(hot[i]):
                warm[mine] = _among(least[mine], hot[i])
        self.start, self.row, self.anchor, self.hot = start[keep], row[keep], least[keep], warm[keep]


def _among(values: np.ndarray, own: np.ndarray) -> np.ndarray:
    if not len(own):
        return np.zeros(len(values), bool)
    own = np.sort(own)
    return own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values


def longs(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int64) for x in column]


def runs_of(doc: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal covered runs (doc, start, end) of windows of ``size`` at (doc, at), in any order."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + size)
    first = np.flatnonzero(new)
    return doc[first], at[first], at[np.append(first[1:], len(doc)) - 1] + size if len(doc) else at


def covered(spans: DataFrame) -> DataFrame:
    """(unit, name, spans): overlapping or touching runs (doc, name, start, stop) of each text merged, as packed (start, stop) longs."""
    grouped = spans.groupBy("doc", "name").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(2):
                flat = parts.values
                start, stop = flat.field(0).to_numpy(), np.maximum.accumulate(flat.field(1).to_numpy())
                new = np.flatnonzero(np.append(True, start[1:] > stop[:-1]))
                out.append(np.stack([start[new], stop[np.append(new[1:], len(start)) - 1]], 1).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["unit", "name", "spans"])

    return grouped.mapInArrow(run, "unit long, name long, spans binary")


def decided(docs: DataFrame, key: str, text: str, unit: DataFrame, spans: DataFrame, scratch: Scratch) -> DataFrame:
    """Every row's (key, text, spans, copy): copy, if a row with a smaller key has the same text; else its own spans."""
    of_text = scratch.put(unit.join(covered(spans), ["unit", "name"], "left").select("sha", "unit", "spans"), "spans")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    joined = rows.withColumn("sha", F.when(F.col("key").isNotNull(), F.sha2(F.coalesce("text", F.lit("")), 256))).join(of_text.hint("shuffle_hash"), "sha", "left")
    return joined.select("key", "text", "spans", F.coalesce(F.col("unit") < F.col("key"), F.lit(False)).alias("copy"))
