"""Benchmark decontamination by spaced seeds.

A seed hashes the tokens at a mask's positions and ignores those between them.
Test seeds and training seeds that agree give a diagonal, along which the test
item and the document are compared token by token: a document is contaminated
by an item if a window of ``WINDOW`` tokens agrees in all but ``SUBSTITUTED``.
Every such window holds a seed of MASKS, wherever its substitutions are.

Items of under ``WINDOW`` tokens must agree in full, and items of under
``LEAST`` tokens contaminate nothing.

A document and an item that share a token many times over, as a repeated one,
have a hit for each pair of its places. These are counted first; where they are
many more than the tokens of both, all diagonals are compared at once, row by
row of the item, in memory that follows the document's length alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import kernels as K
from sparkloom.llm.scratch import Scratch, bound_batches

MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 3, 4, 6))
WINDOW, SUBSTITUTED, LEAST = 13, 2, 5
#: Bytes of test items that are broadcast at once; a larger benchmark is taken in parts, one after the other.
PART_BYTES = 4 << 20
#: Hits per token of a document and an item, beyond which all their diagonals are compared.
DENSE = 4
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_WEIGHTS = K.mix(np.arange(1, 1 + max(map(len, MASKS)), dtype=K.U) * K.U(0xA0761D6478BD642F)) | K.U(1)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, each text's first): runs of letters and digits, A-Z lower-cased, all non-ASCII bytes counting as letters."""
    starts, ends, first = K.words(np.where(_TOKEN[data], K.LOWER[data], 0x20).astype(np.uint8), off)
    return K.word_hashes(K.LOWER[data], starts, ends), first


def seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed at each position where the mask fits."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.empty(0, K.U)
    total = np.zeros(n, K.U)
    for place, weight in zip(mask, _WEIGHTS, strict=False):
        total += hashes[place : place + n] * weight
    return K.mix(total)


class Items:
    """Test items with their seeds in one sorted table for each mask."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, off = K.utf8(pa.array(texts, pa.string()))
        self.hashes, self.first = tokens(data, off)
        self.ids = np.array(ids, np.int64)
        self.tables = []
        self.bloom = np.zeros(1 << 22, bool)
        row = K.row_of(self.first, len(self.hashes))
        end = self.first[1:][row] if len(row) else row
        for mask in MASKS:
            found = seeds(self.hashes, mask)
            at = np.flatnonzero(np.arange(len(found)) + mask[-1] < end[: len(found)])
            order = np.lexsort((row[at], found[at]))
            keys, at = found[at][order], at[order]
            # places of one seed in one item stand together: (seed, item) groups
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (row[at[1:]] != row[at[:-1]])
            group = np.flatnonzero(new)
            self.tables.append((keys[group], row[at[group]], np.append(group, len(keys)), at))
            self.bloom[(keys >> K.U(42)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item, token of the text at which the item would begin), distinct; and (row, item) with more hits than that is good for."""
        row = K.row_of(first, len(hashes))
        end = first[1:][row] if len(row) else row
        known, pairs, weights = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        many_items = len(self.ids)
        for mask, (keys, item, bounds, places) in zip(MASKS, self.tables, strict=True):
            found = seeds(hashes, mask)
            if not len(keys) or not len(found):
                continue
            at = np.flatnonzero(self.bloom[(found >> K.U(42)).astype(np.int64)])
            at = at[at + mask[-1] < end[at]]
            lo = np.searchsorted(keys, found[at])
            some = keys[np.minimum(lo, len(keys) - 1)] == found[at]
            at, lo = at[some], lo[some]
            if not len(at):
                continue
            # once for each seed of a row, with its places in the row
            order = np.lexsort((lo, row[at]))
            at, lo = at[order], lo[order]
            new = np.ones(len(at), bool)
            new[1:] = (lo[1:] != lo[:-1]) | (row[at[1:]] != row[at[:-1]])
            lead = np.flatnonzero(new)
            count = np.diff(np.append(lead, len(at)))
            groups = np.searchsorted(keys, keys[lo[lead]], "right") - lo[lead]
            which = np.repeat(np.arange(len(lead)), groups)
            group = np.repeat(lo[lead] - np.cumsum(groups) + groups, groups) + np.arange(groups.sum())
            pair = row[at[lead[which]]] * many_items + item[group]
            known.append((at, lead, count, which, group, pair, bounds, places))
            pairs.append(pair)
            weights.append(count[which] * (bounds[group + 1] - bounds[group]))
        pair, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
        weight = np.bincount(inverse, np.concatenate(weights), len(pair))
        tokens_of = np.diff(first)[pair // many_items] + np.diff(self.first)[pair % many_items] if len(pair) else weight
        dense = pair[weight > DENSE * tokens_of]
        out = [np.empty((0, 3), np.int64)]
        for at, lead, count, which, group, pair, bounds, places in known:
            keep = ~np.isin(pair, dense)
            which, group, pair = which[keep], group[keep], pair[keep]
            inside = bounds[group + 1] - bounds[group]
            # each place in the row with each place in the item
            n = count[which] * inside
            i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(inside, n)
            mine = at[np.repeat(lead[which], n) + i // wide]
            theirs = places[np.repeat(bounds[group], n) + i % wide]
            pair = np.repeat(pair, n)
            own = pair // many_items
            out.append(np.stack([own, pair % many_items, mine - first[own] - (theirs - self.first[pair % many_items])], 1))
        return np.unique(np.concatenate(out), axis=0), np.stack([dense // many_items, dense % many_items], 1)

    def size(self, item: int) -> int:
        """Tokens of the windows by which an item is compared; 0 if it contaminates nothing."""
        size = min(WINDOW, int(self.first[item + 1] - self.first[item]))
        return size if size >= LEAST else 0

    def overlap(self, own: np.ndarray, item: int, begin: int) -> np.ndarray:
        """Where good windows start in a text, if the item begins at ``begin``."""
        theirs, size = self.hashes[self.first[item] : self.first[item + 1]], self.size(item)
        lo, hi = max(0, begin), min(len(own), begin + len(theirs))
        if not size or hi - lo < size:
            return np.empty(0, np.int64)
        wrong = np.concatenate([[0], np.cumsum(own[lo:hi] != theirs[lo - begin : hi - begin])])
        return lo + np.flatnonzero(wrong[size:] - wrong[:-size] <= (SUBSTITUTED if size == WINDOW else 0))

    def overlaps(self, own: np.ndarray, item: int) -> np.ndarray:
        """Where good windows start in a text, on any diagonal."""
        theirs, size = self.hashes[self.first[item] : self.first[item + 1]], self.size(item)
        places = len(own) - size + 1
        if not size or places <= 0:
            return np.empty(0, np.int64)
        allowed = SUBSTITUTED if size == WINDOW else 0
        good = np.zeros(places, bool)
        # wrong tokens of the windows at each place of the text, against the item's window at q
        wrong = sum((own[t : t + places] != theirs[t]).astype(np.int16) for t in range(size))
        good |= wrong <= allowed
        for q in range(1, len(theirs) - size + 1):
            first = int((own[:size] != theirs[q : q + size]).sum())
            wrong[1:] = wrong[:-1] - (own[: places - 1] != theirs[q - 1]) + (own[size : size + places - 1] != theirs[q + size - 1])
            wrong[0] = first
            good |= wrong <= allowed
        return np.flatnonzero(good)

    def spans(self, hashes: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """(item id, start, stop) for each text: the runs of tokens that good windows cover."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
        starts: dict[tuple[int, int], list[np.ndarray]] = {}
        single, dense = self.hits(hashes, first)
        for row, item, begin in single:
            good = self.overlap(hashes[first[row] : first[row + 1]], item, begin)
            if len(good):
                starts.setdefault((int(row), int(item)), []).append(good)
        for row, item in dense:
            good = self.overlaps(hashes[first[row] : first[row + 1]], item)
            if len(good):
                starts.setdefault((int(row), int(item)), []).append(good)
        for (row, item), found in starts.items():
            at, size = np.unique(np.concatenate(found)), self.size(item)
            new = np.flatnonzero(np.append(True, at[1:] > at[:-1] + size))
            out[row] += [(int(self.ids[item]), int(a), int(b) + size) for a, b in zip(at[new], at[np.append(new[1:], len(at)) - 1], strict=True)]
        return [sorted(x) for x in out]


_SPANS = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))


def _listed(spans: list[list[tuple[int, int, int]]]) -> tuple[pa.Array, pa.Array]:
    items = pa.array([sorted({x[0] for x in s}) for s in spans], pa.list_(pa.int64()))
    return items, pa.array([[dict(zip(("item", "start", "stop"), x, strict=True)) for x in s] for s in spans], _SPANS)


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of ``docs`` and column of it, plus items (sorted ids) and spans (item, start, stop in tokens).

    The two replace columns of those names. A span is a run of tokens that
    good windows of one item cover. Null and empty texts have neither; neither
    does anything if there are no items. Items with a null id or text are
    ignored; items may repeat. Texts of any length are searched whole; a
    document that many items hit carries them all. A benchmark of one part
    needs one pass; of a larger one, each part is held by itself in a pass of
    its own, which writes down contaminated texts, and the parts' findings
    meet the documents by 128 bits of the text's hash.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kept = [c for c in docs.columns if c not in ("items", "spans")]
    told = benchmark.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("t")).where("id is not null and t is not null")
    size = told.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    parts = -(-size // part_bytes)
    empty = F.array().cast("array<bigint>").alias("items")
    no_spans = F.array().cast("array<struct<item:bigint,start:bigint,stop:bigint>>").alias("spans")
    rows = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row"), F.col(text).alias("text"))
    if not parts:
        return docs.select(*kept, empty, no_spans)

    def held(part: int):
        mine = told.where(F.pmod(F.xxhash64("id", "t"), F.lit(parts)) == part).orderBy("id", "t").collect()  # part_bytes, about
        return spark.sparkContext.broadcast(Items([r["id"] for r in mine], [r["t"] for r in mine]))

    def search(chosen: DataFrame, items, every: bool) -> DataFrame:
        """items and spans beside the columns that ``chosen`` has before its last, the text; rows without any only with ``every``."""
        schema = chosen.drop("text").select("*", empty, no_spans).schema
        names = schema.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, off = K.utf8(batch.column(len(names) - 2))
                for lo, hi, piece, cut in K.chunks(data, off):
                    spans = items.value.spans(*tokens(piece, cut))
                    take = [i for i, s in enumerate(spans) if every or s]
                    if take:
                        here = batch.slice(lo, hi - lo) if every else batch.slice(lo, hi - lo).take(pa.array(take))
                        yield pa.RecordBatch.from_arrays([*here.columns[: len(names) - 2], *_listed([spans[i] for i in take])], names)

        return chosen.mapInArrow(run, schema)

    columns = [F.col("row")[c].alias(c) for c in kept]
    if parts == 1:
        return search(rows, held(0), True).select(*columns, "items", "spans")
    scratch = Scratch(spark, "benchmark")
    named = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    found = None
    for part in range(parts):
        items = held(part)
        one = scratch.put(search(rows.where("text is not null").select(*named, "text"), items, False).dropDuplicates(["h1", "h2"]), f"part-{part}")
        items.destroy()
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("h1", "h2").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    merged = scratch.put(merged, "found")
    joined = rows.select("row", *named).join(merged, ["h1", "h2"], "left")
    return joined.select(*columns, F.coalesce("items", empty).alias("items"), F.coalesce("spans", no_spans).alias("spans"))
