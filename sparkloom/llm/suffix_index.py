"""Byte-level repeats, found by a logarithmic family of suffix arrays.

A document's byte is removed if a string of ``size`` bytes that covers it also
starts in a document with a smaller key. ``repeats`` leaves the suffixes whose
anchor other texts have too. They are dealt out by anchor, so that equal
strings meet, in runs of neighbouring suffixes that share an anchor. Within a
task, suffixes enter in ascending order of their documents, batch by batch:
each batch gets a sorted suffix array, is merge-scanned against the existing
levels for matches, and becomes a level; levels of like size merge.

An anchor that very many texts have would fill one task: its suffixes are
dealt out singly, by their whole string.
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
#: Bytes of an anchor's gram.
GRAM = 20
#: Texts with the same anchor, beyond which its suffixes are dealt out singly.
HOT_TEXTS = 20_000
#: Suffixes in a batch, and bytes of suffix runs that a task holds at once (about; one anchor's at least).
BATCH, HELD = 1 << 16, 4 << 20


class Levels:
    """Sorted suffix arrays of geometrically growing size, each with the first document of every suffix."""

    def __init__(self) -> None:
        self.arrays: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, suffixes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Adds a batch; returns each suffix's earliest document, in this batch or before."""
        order = np.argsort(docs, kind="stable")
        keys, first, inverse = np.unique(suffixes[order], return_index=True, return_inverse=True)
        least = docs[order][first]
        seen = least.copy()
        for level, owner in self.arrays:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            hit = level[at] == keys
            seen[hit] = np.minimum(seen[hit], owner[at[hit]])
        if len(keys):
            self.arrays.append((keys, least))
        while len(self.arrays) > 1 and 2 * len(self.arrays[-1][0]) > len(self.arrays[-2][0]):
            self._merge()
        out = np.empty(len(docs), docs.dtype)
        out[order] = seen[inverse]
        return out

    def _merge(self) -> None:
        """Merges the two smallest levels by their order; of a suffix in both, the earlier document counts."""
        (a, b), (c, d) = self.arrays.pop(), self.arrays.pop()
        at = np.searchsorted(c, a)
        inside = np.minimum(at, len(c) - 1)
        both = c[inside] == a
        d[inside[both]] = np.minimum(d[inside[both]], b[both])
        a, b, at = a[~both], b[~both], at[~both]
        keys, owner = np.empty(len(a) + len(c), c.dtype), np.empty(len(a) + len(c), d.dtype)
        new = at + np.arange(len(a))
        old = np.ones(len(keys), bool)
        old[new] = False
        keys[new], owner[new], keys[old], owner[old] = a, b, c, d
        self.arrays.append((keys, owner))


def first_owners(data: np.ndarray, off: np.ndarray, docs: np.ndarray, size: int, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, place in it, earliest document) of every suffix of the byte runs at ``off``, each run of at least ``size`` bytes."""
    many = np.diff(off) - size + 1
    order = np.argsort(docs, kind="stable")
    levels, out = Levels(), []
    # no UTF-8 text has byte 255, so one more than a byte is never 0, which fixed-width strings can't end with
    strings = np.lib.stride_tricks.sliding_window_view(data + np.uint8(1), size)
    total = np.cumsum(many[order])
    begin = 0
    while begin < len(order):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + batch, "right")))
        runs = order[begin:end]
        n = many[runs]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        run = np.repeat(runs, n)
        suffixes = np.ascontiguousarray(strings[off[run] + place]).view(f"S{size}").ravel()
        out.append((run, place, levels.add(suffixes, docs[run])))
        begin = end
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_RUNS = "key long, doc long, name long, at long, stop long, bytes binary"


def _suffix_runs(texts: DataFrame, size: int, k: int) -> DataFrame:
    """Runs of neighbouring suffixes with one anchor (with their bytes), and, with ``stop``, runs known to be repeated.

    Of equal runs in a chunk, the first document's are sent on; the others repeat them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, name = (batch.column(i).to_numpy() for i in range(2))
            data, off = K.utf8(batch.column(2))
            for lo, hi, part, cut in K.chunks(data, off):
                w = R.Windows(part, cut, R.longs(batch.column(3).slice(lo, hi - lo)), R.longs(batch.column(4).slice(lo, hi - lo)), R.byte_symbols, size, k)
                if not len(w.start):
                    continue
                new = np.ones(len(w.start), bool)
                new[1:] = (w.start[1:] != w.start[:-1] + 1) | (w.anchor[1:] != w.anchor[:-1]) | (w.row[1:] != w.row[:-1]) | w.hot[1:]
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(new)) - 1
                start, end = w.start[first], w.start[last] + size
                row = w.row[first]
                whole = w.rolling.runs(start, end)
                key = np.where(w.hot[first], K.signed(whole), w.anchor[first])
                owner, at = doc[lo + row], start - w.first[row]
                order = np.lexsort((owner, end - start, whole))
                same = np.zeros(len(order), bool)
                same[1:] = (whole[order][1:] == whole[order][:-1]) & ((end - start)[order][1:] == (end - start)[order][:-1])
                lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                later = np.empty(len(order), bool)
                later[order] = owner[order] > owner[order][lead]
                ask, first_of = order[later[order]], order[lead][later[order]]
                later[ask] = K.same_bytes(part, start[ask], end[ask], start[first_of], end[first_of])  # hashes propose, bytes confirm
                sent, known = np.flatnonzero(~later), np.flatnonzero(later)
                raw, raw_off = K.gather(part, start[sent], end[sent])
                yield _rows(key[sent], owner[sent], name[lo + row[sent]], at[sent], None, K.binary(raw, raw_off))
                if len(known):
                    d, i, a, b = _merge_runs(owner[known], row[known], at[known], (end - start)[known])
                    yield _rows(name[lo + i], d, name[lo + i], a, b, None)

    return texts.mapInArrow(run, _RUNS)


def _merge_runs(owner, row, at, size):
    order = np.lexsort((at, row))
    owner, row, at, stop = owner[order], row[order], at[order], (at + size)[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] > stop[:-1])
    first = np.flatnonzero(new)
    return owner[first], row[first], at[first], np.maximum.reduceat(stop, first)


def _rows(key, doc, name, at, stop, raw) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(name, pa.int64()), pa.array(at, pa.int64()), pa.nulls(n, pa.int64()) if stop is None else pa.array(stop, pa.int64()), pa.nulls(n, pa.binary()) if raw is None else raw], ["key", "doc", "name", "at", "stop", "bytes"])


def _repeated(runs: DataFrame, size: int) -> DataFrame:
    """(doc, name, start, stop) of repeated bytes; streams over partitions that are sorted by key."""

    def resolve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        doc, name, at = (table.column(x).to_numpy() for x in ("doc", "name", "at"))
        data, off = K.utf8(table.column("bytes"))
        i, place, least = first_owners(data, off, doc, size)
        gone = least < doc[i]
        i, place = i[gone], place[gone]
        # neighbouring suffixes of a run come one after the other
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (place[1:] > place[:-1] + size)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(i)) - 1
        return pa.RecordBatch.from_arrays([pa.array(doc[i[first]]), pa.array(name[i[first]]), pa.array(at[i[first]] + place[first]), pa.array(at[i[first]] + place[last] + size) if len(i) else pa.array([], pa.int64())], ["doc", "name", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight, key = [], 0, None
        for batch in batches:
            known = batch.column(4).is_valid()
            if known.true_count:
                done = batch.filter(known)
                yield pa.RecordBatch.from_arrays([done.column(i) for i in (1, 2, 3, 4)], ["doc", "name", "start", "stop"])
                batch = batch.filter(batch.column(4).is_null())
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            if weight > HELD:  # close what is held where the key changes
                change = np.flatnonzero(keys != key)
                if len(change):
                    at = int(change[0])
                    held.append(batch.slice(0, at))
                    yield resolve(held)
                    batch, held, weight = batch.slice(at), [], 0
            held.append(batch)
            weight += batch.nbytes
            key = keys[-1]
        if held:
            yield resolve(held)

    return runs.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(run, "doc long, name long, start long, stop long")


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, spans (array of start, stop in bytes, maximal), kept (binary).

    Texts count as UTF-8, null as empty. Rows of one key never remove each
    other's bytes; of equal texts, that of the least key stays. A row with a
    null key is kept whole and removes nothing. Texts of any length are handled
    whole. No rows give no rows; other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    plain = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc is not null")
    unit = scratch.put(R.units(plain), "units")
    texts = R.suspects(plain, unit, R.byte_symbols, size, gram, hot_texts, scratch)
    spans = scratch.put(_repeated(_suffix_runs(texts, size, gram), size), "runs")
    scratch.drop("anchors")
    rows = R.decided(docs, key, text, unit, spans, scratch)
    schema = rows.select("key", F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("array<struct<start:bigint,stop:bigint>>").alias("spans"), F.lit(b"").alias("kept")).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column(1))
            copy = batch.column(3).to_pylist()
            n = np.diff(off)
            spans, kept = [], []
            for i, packed in enumerate(batch.column(2)):
                if copy[i]:
                    own = np.array([[0, n[i]]] if n[i] >= size else [], np.int64).reshape(-1, 2)
                else:
                    own = np.frombuffer(packed.as_buffer(), np.int64).reshape(-1, 2) if packed.is_valid else np.empty((0, 2), np.int64)
                raw = data[off[i] : off[i + 1]]
                gone = np.zeros(n[i] + 1, np.int64)
                np.add.at(gone, own[:, 0], 1)
                np.add.at(gone, own[:, 1], -1)
                kept.append(raw[np.cumsum(gone)[:-1] == 0].tobytes())
                spans.append([{"start": int(a), "stop": int(b)} for a, b in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], schema.names)

    return rows.mapInArrow(cut, schema).withColumnRenamed("key", key)
