"""Repeated word sequences, found by prefix-partitioned suffix trees.

A word is removed if a window of ``size`` words that covers it also starts in
a document with a smaller key. ``repeats`` leaves the suffixes whose anchor
other texts have too. Suffixes are split into groups by a prefix of variable
length: the one that reaches through the anchor gram, wherever in the window
that stands, or the whole window where more than ``HOT_TEXTS`` texts have the
anchor. So a group fits a task's memory, and equal windows are in one group.

A task takes groups of some ``HELD`` bytes at once and grows their subtrees
from the root down: the nodes of depth 1 are equal words, and a node of depth
2d is a pair of nodes of depth d, of suffixes that stand d words apart. Leaves
that are alone at a depth leave. The internal nodes ``size`` words deep that
are left are the repeats; of each, the leaves in the first document stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import kernels as K
from sparkloom.llm import repeats as R
from sparkloom.llm.scratch import Scratch

SIZE = 50
#: Words of an anchor's gram.
GRAM = 20
#: Texts with the same anchor, beyond which a suffix's prefix is its whole window.
HOT_TEXTS = 20_000
#: Bytes of word runs whose subtrees a task grows at once (about; one group's at least).
HELD = 2 << 20

_RUNS = "key long, doc long, name long, at long, stop long, hot boolean, bytes binary"
_SPANS = ["doc", "name", "start", "stop"]


def _word_runs(texts: DataFrame, size: int, k: int) -> DataFrame:
    """Runs of neighbouring suffixes of one group, with their words, and, with ``stop``, runs known to be repeated.

    Of runs with equal words in a chunk, the first document's are sent on; the others repeat them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, name = (batch.column(i).to_numpy() for i in range(2))
            data, off = K.utf8(batch.column(2))
            for lo, hi, part, cut in K.chunks(data, off):
                w = R.Windows(part, cut, R.longs(batch.column(3).slice(lo, hi - lo)), R.longs(batch.column(4).slice(lo, hi - lo)), R.word_symbols, size, k)
                if not len(w.start):
                    continue
                word, word_end, _ = K.words(part, cut)
                new = np.ones(len(w.start), bool)
                new[1:] = (w.start[1:] != w.start[:-1] + 1) | (w.anchor[1:] != w.anchor[:-1]) | (w.row[1:] != w.row[:-1]) | w.hot[1:] | w.hot[:-1]
                first = np.flatnonzero(new)
                start, end = w.start[first], w.start[np.append(first[1:], len(new)) - 1] + size
                row, hot = w.row[first], w.hot[first]
                whole = w.rolling.runs(start, end)
                key = np.where(hot, K.signed(whole), w.anchor[first])
                owner, at = doc[lo + row], start - w.first[row]
                later = _later(part, word, word_end, start, end, whole, owner)
                sent, known = np.flatnonzero(~later), np.flatnonzero(later)
                raw, raw_off = K.gather(part, word[start[sent]], word_end[end[sent] - 1])
                n = len(sent)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (key[sent], owner[sent], name[lo + row[sent]], at[sent])), pa.nulls(n, pa.int64()), pa.array(hot[sent]), K.binary(raw, raw_off)], [x.split()[0] for x in _RUNS.split(", ")])
                if len(known):
                    at_row, begin, stop = _merged(row[known], at[known], at[known] + (end - start)[known])
                    of = name[lo + at_row]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (of, doc[lo + at_row], of, begin, stop)), pa.nulls(len(of), pa.bool_()), pa.nulls(len(of), pa.binary())], [x.split()[0] for x in _RUNS.split(", ")])

    return texts.mapInArrow(run, _RUNS)


def _later(data: np.ndarray, word: np.ndarray, word_end: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Runs whose words an earlier document's run here has, too; hashes propose, words confirm."""
    size = end - start
    order = np.lexsort((owner, size, whole))
    same = np.zeros(len(order), bool)
    same[1:] = (whole[order][1:] == whole[order][:-1]) & (size[order][1:] == size[order][:-1])
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    ask = owner[order] > owner[lead]
    mine, first = order[ask], lead[ask]
    off = np.concatenate([[0], np.cumsum(size[mine])]).astype(np.int64)
    step = np.arange(off[-1]) - np.repeat(off[:-1], size[mine])
    a, b = np.repeat(start[mine], size[mine]) + step, np.repeat(start[first], size[mine]) + step
    wrong = np.concatenate([[0], np.cumsum(~K.same_bytes(data, word[a], word_end[a], word[b], word_end[b]))])
    out = np.zeros(len(order), bool)
    out[mine[wrong[off[1:]] == wrong[off[:-1]]]] = True
    return out


def _merged(row: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching runs of each row as one."""
    order = np.lexsort((at, row))
    row, at, stop = row[order], at[order], stop[order]
    # behind what the row's runs before reach: rows apart by more than any place
    wide = int(stop.max()) + 1
    reach = np.maximum.accumulate(row * wide + stop)
    new = np.ones(len(row), bool)
    new[1:] = row[1:] * wide + at[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return row[first], at[first], np.maximum.reduceat(stop, first)


def deep_nodes(symbols: np.ndarray, first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, node): suffixes of each sequence, by their place in ``symbols``, and the internal node ``depth`` deep that each is below.

    Grown by doubling; a suffix whose node has no other leaf is dropped on the way. Nodes are in the order of their paths.
    """
    n = len(symbols)
    at = np.arange(n)
    room = first[1:][K.row_of(first, n)] - at if n else at
    have = 1
    node = np.full(n + 1, -1, np.int64)  # of every suffix that is left, by its place; -1: alone or too short
    _, node[:n] = np.unique(symbols, return_inverse=True)
    node[:n][room < 1] = -1
    while have < depth:
        step = min(have, depth - have)
        left = at[(room >= have + step) & (node[:n] >= 0)]
        left = left[node[left + step] >= 0]
        width = int(node.max(initial=0)) + 1
        _, rank, count = np.unique(node[left] * width + node[left + step], return_inverse=True, return_counts=True)
        node[:] = -1
        shared = count[rank] > 1
        node[left[shared]] = rank[shared]
        have += step
    found = np.flatnonzero(node[:n] >= 0)
    return found, node[found]


def _repeated(runs: DataFrame, size: int) -> DataFrame:
    """(doc, name, start, stop) of repeated words; streams over partitions that are sorted by key and document."""

    def resolve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        doc, name, at = (table.column(x).to_numpy() for x in ("doc", "name", "at"))
        data, off = K.utf8(table.column("bytes"))
        word, word_end, first = K.words(data, off)
        place, node = deep_nodes(K.exact_ranks(data, word, word_end), first, size)
        run = np.searchsorted(first, place, "right") - 1
        order = np.lexsort((doc[run], node))
        place, node, run = place[order], node[order], run[order]
        new = np.ones(len(node), bool)
        new[1:] = node[1:] != node[:-1]
        least = doc[run][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(node) else node
        gone = doc[run] > least
        run, place = run[gone], at[run[gone]] + place[gone] - first[run[gone]]
        # runs of one text: texts are told apart by (doc, name)
        owner, other = doc[run], name[run]
        order = np.lexsort((place, other, owner))
        owner, other, place = owner[order], other[order], place[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1]) | (place[1:] > place[:-1] + size)
        begin = np.flatnonzero(new)
        stop = place[np.append(begin[1:], len(owner)) - 1] + size if len(owner) else place
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (owner[begin], other[begin], place[begin], stop)], _SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight, key = [], 0, None
        for batch in batches:
            known = batch.column(4).is_valid()
            if known.true_count:
                done = batch.filter(known)
                yield pa.RecordBatch.from_arrays([done.column(i) for i in (1, 2, 3, 4)], _SPANS)
                batch = batch.filter(batch.column(4).is_null())
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            if weight > HELD:
                change = np.flatnonzero(keys != key)
                if len(change):  # close what is held where the key changes
                    at = int(change[0])
                    held.append(batch.slice(0, at))
                    yield resolve(held)
                    batch, held, weight = batch.slice(at), [], 0
                elif held[-1].column(5)[-1].as_py():  # windows that are all equal: their first document's goes on
                    yield resolve(held)
                    every = pa.Table.from_batches(held)
                    at = int(np.flatnonzero(every.column(0).to_numpy() == key)[0])
                    held, weight = every.slice(at, 1).combine_chunks().to_batches(), 0
            held.append(batch)
            weight += batch.nbytes
            key = keys[-1]
        if held:
            yield resolve(held)

    return runs.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(run, "doc long, name long, start long, stop long")


def repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """One row per row of ``docs``: key, n_words, spans (array of start, stop in words, maximal), kept (string).

    Words are runs of anything but space and U+0009 to U+000D; kept words are
    joined by one space. Null texts have none. Rows of one key never remove
    each other's words; of equal texts, that of the least key stays. A row with
    a null key is kept whole and removes nothing. Texts of any length are
    handled whole. No rows give no rows; other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "subtrees")
    plain = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc is not null")
    unit = scratch.put(R.units(plain), "units")
    texts = R.suspects(plain, unit, R.word_symbols, size, gram, hot_texts, scratch)
    spans = scratch.put(_repeated(_word_runs(texts, size, gram), size), "runs")
    scratch.drop("anchors")
    rows = R.decided(docs, key, text, unit, spans, scratch)
    schema = rows.select("key", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<struct<start:bigint,stop:bigint>>").alias("spans"), F.lit("").alias("kept")).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy, packed = batch.column(3).to_pylist(), batch.column(2)
            data, off = K.utf8(batch.column(1))
            for lo, hi, part, at in K.chunks(data, off):
                starts, ends, first = K.words(part, at)
                count = np.diff(first)
                spans, gone = [], np.zeros(len(starts) + 1, np.int64)
                for i in range(hi - lo):
                    if copy[lo + i]:
                        own = np.array([[0, count[i]]] if count[i] >= size else [], np.int64).reshape(-1, 2)
                    else:
                        own = np.frombuffer(packed[lo + i].as_buffer(), np.int64).reshape(-1, 2) if packed[lo + i].is_valid else np.empty((0, 2), np.int64)
                    np.add.at(gone, first[i] + own[:, 0], 1)
                    np.add.at(gone, first[i] + own[:, 1], -1)
                    spans.append([{"start": int(a), "stop": int(b)} for a, b in own])
                stay = np.cumsum(gone)[:-1] == 0
                row = K.row_of(first, len(starts))[stay]
                begin, end = starts[stay], ends[stay]
                kept = []
                bounds = np.searchsorted(row, np.arange(hi - lo + 1))
                raw = part.tobytes()
                for i in range(hi - lo):
                    mine = range(bounds[i], bounds[i + 1])
                    kept.append(" ".join([raw[begin[j] : end[j]].decode() for j in mine]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(count), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.string())], schema.names)

    return rows.mapInArrow(cut, schema).withColumnRenamed("key", key)
