"""Self-join of documents on the Jaccard similarity of their word n-gram sets.

1. Equal sets become one class; classes are joined, copies never are.
2. The global n-gram order (by hash) is cut into fragments, more of them than
   n-grams in which two similar sets of such sizes can differ. So similar sets
   agree on a whole fragment. Classes that agree with none leave here; that is
   most of them.
3. Of the rest, n-grams are ordered by document frequency, rarest first. Two
   sets of similarity t share one of their first |x| - ceil(t |x|) + 1 n-grams;
   classes that do form candidate groups (connected components).
4. A group's n-grams, in their global order, are cut into fragments of some
   ``FRAGMENT_GRAMS``, and its classes into blocks. A task gets one fragment of
   two blocks and counts the partial overlaps of their pairs, as a matrix; a
   second shuffle, by pair of blocks, sums the fragments' matrices.

Every pair of a group is tested, none is emitted: what leaves the sums is each
class's number of links and a spanning forest of them. To count links exactly,
a class meets each block of its group, so its n-grams are sent once per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import kernels as K
from sparkloom.llm.components import components
from sparkloom.llm.scratch import Scratch

#: Classes, and n-grams, that a block holds at most (about).
BLOCK_CLASSES, BLOCK_GRAMS = 512, 2_000_000
#: n-grams of a group, or of two blocks of it, in a fragment (about), and columns of a task's incidence matrix.
FRAGMENT_GRAMS, COLUMNS = 250_000, 2048


def gram_sets(data: np.ndarray, off: np.ndarray, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after the other, and each text's first.

    A text with fewer words than ``width`` has its whole sequence as its one n-gram, a text without words none.
    """
    if lower:
        data = K.LOWER[data]
    n = len(off) - 1
    starts, ends, first = K.words(data, off)
    hashes = K.word_hashes(data, starts, ends)
    if not len(hashes):
        return np.empty(0, K.U), np.zeros(n + 1, np.int64)
    rolling = K.Rolling(hashes, K.BASES[1])
    count = np.diff(first)
    row = K.row_of(first, len(hashes))
    at = np.arange(len(hashes))
    whole = at + width <= first[1:][row]
    short = np.flatnonzero((count > 0) & (count < width))
    values = np.concatenate([rolling.runs(at[whole], at[whole] + width), rolling.runs(first[short], first[short + 1])])
    rows = np.concatenate([row[whole], short])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(n + 1))


def set_hashes(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set, as two signed columns."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.concatenate([[K.U(0)], np.cumsum(K.mix(values ^ K.U(salt)), dtype=K.U)])
        out.append(K.signed(K.mix(total[first[1:]] - total[first[:-1]])))
    return out[0], out[1]


def prefix_length(size, num: int, den: int):
    """size - ceil(size * num / den) + 1"""
    return size + (-size * num) // den + 1


def _describe(docs: DataFrame, key: str, text: str, width: int, lower: bool) -> DataFrame:
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = chosen.select("key", *(F.lit(0).cast("long").alias(x) for x in ("n", "h1", "h2"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column(1))
            for lo, hi, part, at in K.chunks(data, off):
                values, first = gram_sets(part, at, width, lower)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), *map(pa.array, set_hashes(values, first))], schema.names)

    return chosen.mapInArrow(run, schema)


def size_classes(most: int, num: int, den: int) -> np.ndarray:
    """The largest size of each class, up to ``most`` and two beyond: similar sets are in one class or in neighbours."""
    out = [1]
    while out[-1] < most or len(out) < 3 or out[-3] < most:
        out.append(max(out[-1] + 1, (out[-1] + 1) * den // num))
    return np.array(out, np.int64)


def signatures(values: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of the fragments of each set, under its own size class and the next larger one.

    Similar sets meet in the larger class of the two. If it allows d
    differences, it has d + 1 + e fragments, so 1 + e at least are equal. A set
    with e empty fragments or fewer thus has an equal one that isn't empty, and
    sends no empty ones; others send those, too.
    """
    size = np.diff(first)
    some = np.flatnonzero(size)
    bounds = size_classes(int(size.max(initial=1)), num, den)
    own = np.searchsorted(bounds, size)
    total = np.concatenate([[K.U(0)], np.cumsum(K.mix(values ^ K.U(0x5851F42D4C957F2D)), dtype=K.U)])
    row = np.repeat(np.arange(len(size)), size)
    out, rows = [], []
    for step in (0, 1):
        top = bounds[own + step]
        d = 2 * top * (den - num) // (den + num)
        spare = 1 + d // 8
        count = d + 1 + spare
        part = ((values >> K.U(32)) * count[row].astype(K.U) >> K.U(32)).astype(np.int64)
        new = np.ones(len(values), bool)
        new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(values))
        label = ((own + step).astype(K.U) << K.U(40))[row[begin]] + part[begin].astype(K.U)
        out.append(K.mix(total[end] - total[begin] + K.mix(label)))
        rows.append(row[begin])
        full = np.bincount(row[begin], minlength=len(size))
        for i in some[count[some] - full[some] > spare[some]]:
            lo, hi = np.searchsorted(row[begin], [i, i + 1])
            empty = np.setdiff1d(np.arange(count[i]), part[begin[lo:hi]])
            out.append(K.mix(K.mix((K.U(own[i] + step) << K.U(40)) + empty.astype(K.U))))
            rows.append(np.full(len(empty), i))
    return np.concatenate(out), np.concatenate(rows)


def _signed_fragments(docs: DataFrame, text: str, width: int, lower: bool, num: int, den: int) -> DataFrame:
    """(signature, h1, known): a class's fragments.

    Of the classes that share one within a chunk a single row is sent on to
    meet other chunks; all of them are sent with ``known`` as having company.
    So a very common fragment costs a row per chunk, not one per document.
    """
    chosen = docs.select(F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column(0))
            for _, _, part, at in K.chunks(data, off, 16 * K.CHUNK):
                marks, names = [], []
                for _, _, piece, cut in K.chunks(part, at):
                    values, first = gram_sets(piece, cut, width, lower)
                    mark, row = signatures(values, first, num, den)
                    marks.append(mark)
                    names.append(set_hashes(values, first)[0][row])
                g, h = np.concatenate(marks), np.concatenate(names)
                order = np.lexsort((h, g))
                g, h = g[order], h[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
                g, h = g[new], h[new]
                lead = np.ones(len(g), bool)
                lead[1:] = g[1:] != g[:-1]
                begin = np.flatnonzero(lead)
                many = np.diff(np.append(begin, len(g)))
                company = np.unique(h[np.repeat(many > 1, many)])
                out_g, out_h = np.concatenate([K.signed(g[begin]), company]), np.concatenate([h[begin], company])
                yield pa.RecordBatch.from_arrays([pa.array(out_g), pa.array(out_h), pa.array(np.arange(len(out_g)) >= len(begin))], ["signature", "h1", "known"])

    return chosen.mapInArrow(run, "signature long, h1 long, known boolean")


def _company(fragments: DataFrame) -> DataFrame:
    """h1 of every class that agrees with another class on a fragment; streams over sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        for batch in batches:
            g, h, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            out = [h[known]]
            g, h = g[~known], h[~known]
            if len(g):
                if last is not None:
                    g, h = np.append(last[0], g), np.append(last[1], h)
                pair = (g[1:] == g[:-1]) & (h[1:] != h[:-1])
                out += [h[1:][pair], h[:-1][pair]]
                last = (g[-1], h[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], ["h1"])

    return fragments.repartition("signature").sortWithinPartitions("signature", "h1").mapInArrow(run, "h1 long").distinct()


def _grams(texts: DataFrame, width: int, lower: bool) -> DataFrame:
    """(cid, gram) of each class, from (cid, h1, h2, text); texts of another set (repeated keys) drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.utf8(batch.column(3))
            for lo, hi, part, at in K.chunks(data, off):
                values, first = gram_sets(part, at, width, lower)
                cid, h1, h2 = (batch.column(i).slice(lo, hi - lo).to_numpy() for i in range(3))
                a, b = set_hashes(values, first)
                take = np.repeat((a == h1) & (b == h2), np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cid, np.diff(first))[take]), pa.array(K.signed(values[take]))], ["cid", "gram"])

    return texts.select("cid", "h1", "h2", "text").mapInArrow(run, "cid long, gram long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = COLUMNS) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    m, sizes = len(left), [len(x) for x in (*left, *right)]
    every = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, rank, count = np.unique(every, return_inverse=True, return_counts=True)
    keep = count[rank] > 1
    shared = np.cumsum(count > 1) - 1
    rank, owner = shared[rank[keep]], owner[keep]
    total = np.zeros((m, len(right)), np.int64)
    order = np.argsort(rank, kind="stable")
    rank, owner = rank[order], owner[order]
    for base in range(0, int(rank[-1]) + 1 if len(rank) else 0, columns):
        lo, hi = np.searchsorted(rank, [base, base + columns])
        cells = np.zeros((len(sizes), min(columns, int(rank[-1]) + 1 - base)), np.float32)
        cells[owner[lo:hi], rank[lo:hi] - base] = 1
        total += (cells[:m] @ cells[m:].T).astype(np.int64)
    return total


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric link matrix."""
    n = len(linked)
    seen, out = np.zeros(n, bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root], waiting = True, [root]
        while waiting:
            v = waiting.pop()
            for w in np.flatnonzero(linked[v] & ~seen):
                seen[w] = True
                out.append((v, int(w)))
                waiting.append(int(w))
    return out


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each combination of the first ``keys`` columns, longs, in which partitions are sorted."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if batch.num_rows:
            new[0] = last is not None and last != tuple(int(c[0]) for c in columns)
            last = tuple(int(c[-1]) for c in columns)
        begin = 0
        for at in np.flatnonzero(new):
            held.append(batch.slice(begin, at - begin))
            yield pa.Table.from_batches(held)
            held, begin = [], int(at)
        held.append(batch.slice(begin))
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


_DEALT = "label long, i long, j long, fragment long, block long, cid long, n long, members long, grams binary"


def _dealt(classes: DataFrame) -> DataFrame:
    """Each class's part of every fragment, once for each block that its own one meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _DEALT.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for label, block, blocks, fragments, cid, n, members, raw in zip(*(batch.column(x).to_pylist() for x in ("label", "block", "blocks", "fragments", "cid", "n", "members", "grams")), strict=True):
                grams = np.frombuffer(raw, np.int64)
                part = (grams.view(K.U) >> K.U(32)) * K.U(fragments) >> K.U(32)
                for f in range(fragments):
                    own = raw if fragments == 1 else grams[part == f].tobytes()
                    for other in range(blocks):
                        rows.append((label, min(block, other), max(block, other), f, block, cid, n, members, own))
                        size += len(own) + 64
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)

    return classes.select("label", "block", "blocks", "fragments", "cid", "n", "members", "grams").mapInArrow(run, _DEALT)


_PARTIAL = "label long, i long, j long, fragment long, counts binary, facts binary"


def partial_overlaps(dealt: DataFrame) -> DataFrame:
    """A matrix (32-bit) of the pairs' overlaps in one fragment for each pair of blocks; facts: (cid, n, members) of the left classes, then of the right ones, after the number of the left ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PARTIAL.split(", ")]
        rows: list[tuple] = []
        size = 0
        for group in groups_of(batches, 4):
            label, i, j, f = (group.column(c)[0].as_py() for c in range(4))
            block, cid, n, members = (group.column(x).to_numpy() for x in ("block", "cid", "n", "members"))
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in group.column("grams")]
            sides = []
            for own in (i, j):  # in the same order in every fragment
                at = np.flatnonzero(block == own)
                sides.append(at[np.argsort(cid[at], kind="stable")])
            counts = overlaps(*([sets[x] for x in side] for side in sides)).astype("<u4").tobytes()
            facts = np.concatenate([[len(sides[0])], *(np.stack([cid[x], n[x], members[x]], 1).ravel() for x in sides)]).astype("<i8").tobytes() if f == 0 else None
            rows.append((label, i, j, f, counts, facts))
            size += len(counts)
            if size > 4 << 20 or len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in list(zip(*rows, strict=True))[:4]), *(pa.array(x, pa.binary()) for x in list(zip(*rows, strict=True))[4:])], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in list(zip(*rows, strict=True))[:4]), *(pa.array(x, pa.binary()) for x in list(zip(*rows, strict=True))[4:])], names)

    # dealt out by fragment and pair of blocks: by group alone, one task would get all pairs of a large one
    return dealt.repartition("label", "i", "j", "fragment").sortWithinPartitions("label", "i", "j", "fragment").mapInArrow(run, _PARTIAL)


def summed_links(partial: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, links): forest edges, and with null b a class's number of linked documents, by the sums of the fragments' matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        links: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            heads, tails, numbers = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b, links))
            a.clear(), b.clear(), links.clear()
            return pa.RecordBatch.from_arrays([pa.array(heads), pa.array(tails, mask=numbers > 0), pa.array(numbers, mask=numbers == 0)], ["a", "b", "links"])

        for group in groups_of(batches, 3):
            facts = np.frombuffer(next(x for x in group.column("facts").to_pylist() if x is not None), "<i8")
            m, facts = int(facts[0]), facts[1:].reshape(-1, 3)
            cid, size, members = facts[:, 0], facts[:, 1], facts[:, 2]
            shared = sum(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in group.column("counts")).reshape(m, -1)
            i, j = (group.column(x)[0].as_py() for x in ("i", "j"))
            linked = (shared > 0) & (shared * (num + den) >= num * (size[:m][:, None] + size[m:][None, :]))
            if i == j:
                np.fill_diagonal(linked, False)
                edges = forest(linked)
                counted = [(cid[:m], linked @ members[:m])]
            else:
                both = np.zeros((len(cid),) * 2, bool)
                both[:m, m:], both[m:, :m] = linked, linked.T
                edges = forest(both)
                counted = [(cid[:m], linked @ members[m:]), (cid[m:], linked.T @ members[:m])]
            if edges:
                v, w = np.array(edges, np.int64).T
                a.append(cid[v]), b.append(cid[w]), links.append(np.zeros(len(v), np.int64))
            for own, number in counted:
                some = np.flatnonzero(number)
                a.append(own[some]), b.append(np.zeros(len(some), np.int64)), links.append(number[some])
            if len(a) > 4096:
                yield sent()
        yield sent()

    return partial.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "fragment").mapInArrow(run, "a long, b long, links long")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 4, den: int = 5, lower: bool = True) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, n_links.

    Two documents link if the Jaccard similarity of their n-gram sets is num /
    den or more; n_links counts a document's links, exact copies included.
    component_id is the least key that links reach. Texts without words, empty
    or null, link with nothing and are their own component. Repeated rows and
    keys link like other documents; a null key is never a component_id but
    where all keys of a component are null. No rows give no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    sets = scratch.put(_describe(docs, key, text, width, lower), "sets")
    classes = sets.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("members"))
    classes = scratch.put(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    company = scratch.put(_company(_signed_fragments(docs, text, width, lower, num, den)), "company")
    near = classes.join(company, "h1")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = _grams(texts.join(near, F.col("key").eqNullSafe(F.col("rep"))), width, lower)
    rows = scratch.put(rows, "grams")
    common = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = scratch.put(rows.join(common, "gram").select("cid", "gram", "df"), "shared")
    scratch.drop("grams")
    packed = scratch.put(_with_sizes(shared, classes), "packed")
    scratch.drop("shared")
    edges = _bucket_edges(packed, num, den)
    label = components(edges, scratch, "groups").select(F.col("node").alias("cid"), F.col("component").alias("label"))
    label = scratch.put(label, "labels")
    grouped = packed.join(label, "cid").join(classes.select("cid", "members"), "cid")
    weight = grouped.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("g"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_CLASSES), F.ceil(F.col("g") / BLOCK_GRAMS))
    weight = weight.select("label", blocks.cast("long").alias("blocks"), F.ceil(F.least(F.col("g"), F.lit(2 * BLOCK_GRAMS)) / FRAGMENT_GRAMS).cast("long").alias("fragments"))
    placed = grouped.join(weight, "label").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    partial = scratch.put(partial_overlaps(_dealt(placed)), "partial")
    found = scratch.put(summed_links(partial, num, den), "links")
    merged = components(found.where("b is not null").select("a", "b"), scratch, "merged")
    merged = scratch.put(merged.select(F.col("node").alias("cid"), F.col("component").alias("joint")), "joints")
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("more")).withColumnRenamed("a", "cid")
    of_class = classes.join(merged, "cid", "left").withColumn("joint", F.coalesce("joint", "cid")).join(counts, "cid", "left")
    least = of_class.groupBy("joint").agg(F.min("rep").alias("component_id"))
    answer = of_class.join(least, "joint").select("h1", "h2", "n", "component_id", (F.col("members") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    answer = scratch.put(answer, "answer")
    scratch.drop("packed", "labels", "partial", "links", "joints", "company", "classes")
    return sets.join(answer, ["h1", "h2", "n"], "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def _with_sizes(shared: DataFrame, classes: DataFrame) -> DataFrame:
    sizes = classes.select("cid", "n")
    grouped = shared.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    packed = grouped.join(sizes, "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            gram = flat.field(1).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), K.packed(gram, first)], ["cid", "n", "grams"])

    return packed.select("cid", "n", "grams").mapInArrow(run, "cid long, n long, grams binary")


def _bucket_edges(packed: DataFrame, num: int, den: int) -> DataFrame:
    """Edges between classes that share an n-gram of their prefixes by document frequency.

    n-grams of one class alone come first in that order, so they shorten what is left of the prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            gram, owner = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, raw in enumerate(batch.column(2)):
                own = np.frombuffer(raw.as_buffer(), np.int64)
                take = int(prefix_length(n[i], num, den)) - int(n[i] - len(own))
                if take > 0:
                    gram.append(own[:take])
                    owner.append(np.full(min(take, len(own)), cid[i]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(gram)), pa.array(np.concatenate(owner))], ["gram", "cid"])

    rows = packed.mapInArrow(run, "gram long, cid long")
    lead = rows.groupBy("gram").agg(F.min("cid").alias("b"))
    return rows.join(lead, "gram").where("cid <> b").select(F.col("cid").alias("a"), "b")
