"""Best-fit packing of token sequences.

Texts are encoded to token ids with an end id each, and texts longer than a
sequence are cut. Best-fit decreasing needs only how many pieces there are of
each length, so the driver plans on a histogram of ``capacity`` numbers and
returns ranges: pieces of a length, by rank, to sequences and offsets. Ranks
and the plan's ranges then meet in Spark. The plan is the one that placing the
pieces one by one would give; equal open sequences are handled as one run.
A piece as long as a sequence needs no plan: it is one.

The plan does not grow with the corpus for ever: a length splits one run of
open sequences at most, so there are some thousands of runs, and a step fills
a run or ends a length. It is written to the shared folder and joined there.
"""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import kernels as K
from sparkloom.llm.scratch import Scratch

CAPACITY = 2048
END_ID = 0
#: Pieces of a length that are numbered in one task (about), and ranks that meet the plan together.
NUMBERED, RANKS = 1000, 256
#: Bytes of text that are encoded at once; longer texts are cut where the pre-tokenizer cuts anyway.
CHUNK = 1 << 20
_PLAIN = np.zeros(256, bool)
_PLAIN[[0x0A, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC2, 0xC9)]] = True


class Encoder:
    """Token ids of whole texts, equal to ``tokenizers``' ``encode(text, add_special_tokens=False).ids``.

    The byte-level pre-tokenizer always cuts before a space that stands alone.
    So a chunk of texts is cut there, and each distinct part is encoded once,
    by ``tiktoken`` from the vocabulary in the very same file; tests hold the
    ids against ``tokenizers``. ``tokenizers`` itself encodes the texts with
    other characters than line ends and Latin script, with a space next to
    white space or at the end, or with a special token's string, which has the
    special token's id, as by default.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
        self.special = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        for token in self.special:
            ranks.pop(token, None)
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each worker process."""
        held = sys.modules.setdefault("_sparkloom_encoders", ModuleType("_sparkloom_encoders")).__dict__
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's first) for UTF-8 texts at ``off``."""
        n, size = len(off) - 1, np.diff(off)
        plain = self._plain(data, off)
        edge = off[:-1][plain & (size > 0)]
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = (data == 0x20) & np.repeat(plain, size)
        cut[edge] = True
        cut[off[1:][plain]] = True
        start = np.flatnonzero(cut[:-1])
        inside = np.repeat(plain, size)[start] if len(data) else np.empty(0, bool)
        start = start[inside]
        row = np.searchsorted(off, start, "right") - 1
        end = np.minimum(np.append(start[1:], len(data)), off[row + 1]) if len(start) else start
        hashes = K.word_hashes(data, start, end)
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        raw, raw_off = K.gather(data, start[one], end[one])
        spaced = data[start[one]] == 0x20 if len(one) else np.empty(0, bool)
        made = self._parts(raw, raw_off, spaced)
        ids, got = gather_runs(*made, which)
        per_row = np.zeros(n, np.int64)
        np.add.at(per_row, row, got)
        slow = {i: np.array(self.tokenizer.encode(data[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(~plain)}
        if not slow:
            return ids, np.concatenate([[0], np.cumsum(per_row)])
        fast_first = np.concatenate([[0], np.cumsum(per_row)])
        rows = [slow[i] if i in slow else ids[fast_first[i] : fast_first[i + 1]] for i in range(n)]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])

    def _plain(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts of line ends, printable ASCII and U+00A1 to U+023F, all spaces alone and none at the end."""
        blank, space = (data == 0x0A) | (data == 0x20), data == 0x20
        bad = ~_PLAIN[data]
        if len(data):
            bad[:-1] |= (data[:-1] == 0xC2) & (data[1:] < 0xA1) | space[:-1] & blank[1:] | blank[:-1] & space[1:]
            last = off[1:][off[1:] > off[:-1]] - 1
            bad[last] |= space[last]
            raw = data.tobytes()
            for token in self.special:
                at = raw.find(token)
                while at >= 0:
                    bad[at] = True
                    at = raw.find(token, at + 1)
        total = np.concatenate([[0], np.cumsum(bad)])
        return total[off[1:]] == total[off[:-1]]

    def _parts(self, raw: np.ndarray, off: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each part). Parts with a leading space are cut apart by the pre-tokenizer anyway, so they are encoded as one text."""
        order = np.argsort(~spaced, kind="stable")
        text, at = K.gather(raw, off[order], off[order + 1]) if len(order) else (raw, off)
        many = int(spaced.sum())
        joined = np.array(self.fast(text[: at[many]].tobytes().decode()), np.int64)
        ends = np.searchsorted(np.cumsum(self.sizes[joined]), at[1 : many + 1]) + 1
        ids, sizes = [joined], list(np.diff(np.concatenate([[0], ends])))
        for i in range(many, len(order)):
            ids.append(np.array(self.fast(text[at[i] : at[i + 1]].tobytes().decode()), np.int64))
            sizes.append(len(ids[-1]))
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        flat = np.concatenate(ids).astype(np.uint32)
        return flat, np.stack([first[:-1][back], first[1:][back]], 1) if len(order) else np.empty((0, 2), np.int64)


def cut_places(data: np.ndarray, most: int) -> list[int]:
    """Places at most ``most`` bytes apart, where there are such, at which a text can be cut without a change of its ids.

    The pre-tokenizer always cuts before a space that follows a visible ASCII
    character. A text without such places is not cut.
    """
    out, at = [], 0
    while len(data) - at > most:
        view = data[at + 1 : at + most + 1]
        places = np.flatnonzero((view == 0x20) & (data[at : at + most] > 0x20) & (data[at : at + most] < 0x7F))
        if len(places):
            at += 1 + int(places[-1])
            out.append(at)
        else:  # on to the first place behind
            view, before = data[at + most + 1 :], data[at + most : -1]
            found = 0
            for begin in range(0, len(view), most):
                here = np.flatnonzero((view[begin : begin + most] == 0x20) & (before[begin : begin + most] > 0x20) & (before[begin : begin + most] < 0x7F))
                if len(here):
                    found = at + most + 1 + begin + int(here[0])
                    break
            if not found:
                break
            at = found
            out.append(at)
    return out


def gather_runs(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start:end] for the bounds of each of ``which``, one behind the other, and their lengths."""
    start, size = bounds[which, 0], bounds[which, 1] - bounds[which, 0]
    before = np.concatenate([[0], np.cumsum(size)])
    return values[np.arange(before[-1]) + np.repeat(start - before[:-1], size)], size


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def pieces(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(_key, piece, start, length, ids_crc32) of every text, cut to at most ``capacity`` ids.

    The first piece takes what is left over. A null text counts as empty and
    has the end id alone.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    chosen = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = chosen.select("_key", F.lit(0).alias("piece"), *(F.lit(0).cast("long").alias(x) for x in ("start", "length", "ids_crc32"))).schema

    end_bytes = int(end_id).to_bytes(4, "little")

    def cut(row: int, own: bytes) -> Iterator[tuple[int, int, int, int, int]]:
        total, start = len(own) // 4, 0
        for j, n in enumerate([total % capacity or capacity] + [capacity] * ((total - 1) // capacity)):
            yield row, j, start, n, zlib.crc32(own[4 * start : 4 * (start + n)])
            start += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            data, off = K.utf8(batch.column(1))
            # stretches of texts, each text's last one marked by its row
            stops, ends = [], []
            for i in range(len(off) - 1):
                places = cut_places(data[off[i] : off[i + 1]], CHUNK) if off[i + 1] - off[i] > CHUNK else []
                stops += [off[i] + x for x in places] + [off[i + 1]]
                ends += [-1] * len(places) + [i]
            waiting: list[bytes] = []
            for first, last, part, at in K.chunks(data, np.array([0, *stops], np.int64), CHUNK):
                ids, begin = encoder.encode(part, at)
                rows = []
                for i in range(last - first):
                    waiting.append(ids[begin[i] : begin[i + 1]].astype("<u4").tobytes())
                    if ends[first + i] >= 0:
                        rows += cut(ends[first + i], b"".join([*waiting, end_bytes]))
                        waiting = []
                if rows:
                    table = np.array(rows, np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), *(pa.array(table[:, c].copy()) for c in (2, 3, 4))], schema.names)

    return chosen.mapInArrow(run, schema)


class Tightest:
    """A segment tree over remaining capacities: the least non-empty one that is at least n, in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)

    def set(self, at: int, some: bool) -> None:
        at += self.leaves
        self.some[at] = some
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def find(self, least: int) -> int | None:
        at = least + self.leaves
        if not self.some[at]:
            while at > 1 and not (at % 2 == 0 and self.some[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at + (not self.some[2 * at])
        return at - self.leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges (length, first rank, ranks, first sequence, each, offset): from ``first rank`` on, ``each`` pieces go to every sequence from ``first sequence`` on, at ``offset`` and behind.

    Open sequences that are alike and stand together are one run (first sequence, how many); a step splits one run at most.
    """
    tree, open_runs = Tightest(capacity), {}
    plan, used = [], 0

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            open_runs.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.find(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = used, -(-left // each)
                used += n
            else:
                each = room // length
                first, n = open_runs[room].pop()
                if not open_runs[room]:
                    tree.set(room, False)
            full = min(n, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, capacity - room))
                keep(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # the last sequence gets fewer
                plan.append((length, rank, left, first + full, left, capacity - room))
                keep(room - left * length, first + full, 1)
                keep(room, first + full + 1, n - full - 1)
                left = 0
            elif full < n:
                keep(room, first + full, n - full)
    return plan


def pack(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences hold at most ``capacity`` ids and have no gaps. Null and empty
    texts are one end id; repeated rows are packed each; no rows give no rows.
    Only the key column of ``docs`` is kept, under its own name; where that is
    one of the other six, the key comes first and keeps it, and the other one
    has an underscore behind. Texts of any length are encoded whole, by
    stretches; a task holds the ids of one text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    made = scratch.put(pieces(docs, tokenizer, key, text, capacity, end_id).withColumn("_id", F.monotonically_increasing_id()), "pieces")
    facts = ["_key", "piece", "start", "length", "ids_crc32"]
    whole = made.where(F.col("length") == capacity).select(*facts, (-1 - F.col("_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = made.where(F.col("length") < capacity)
    bound = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # fewer rows than ``capacity``
    if not bound:
        return _renamed(whole, key)
    plan = np.array(best_fit_decreasing(bound, capacity), np.int64)
    names = ["length", "_rank", "_n", "_first", "_each", "_offset"]
    steps = scratch.put(spark.createDataFrame(pa.table({x: plan[:, i] for i, x in enumerate(names)})), "plan")
    # ranks of a length: salted parts are numbered by themselves, behind those before them
    salts = spark.createDataFrame(pa.table({"length": pa.array(list(bound), pa.int64()), "_salts": pa.array([-(-n // NUMBERED) for n in bound.values()], pa.int64())}))
    salted = rest.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts")))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_in"))
    before = counts.select("length", "_salt", (F.sum("_in").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_in")).alias("_before"))
    numbered = salted.withColumn("_at", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_id")) - 1)
    ranked = numbered.join(before, ["length", "_salt"]).withColumn("_r", F.col("_at") + F.col("_before")).withColumn("_block", F.floor(F.col("_r") / RANKS))
    spread = steps.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_rank") / RANKS), F.floor((F.col("_rank") + F.col("_n") - 1) / RANKS))))
    inside = F.col("_r") - F.col("_rank")
    met = ranked.join(spread, ["length", "_block"]).where((inside >= 0) & (inside < F.col("_n")))
    placed = met.select(*facts, (F.col("_first") + F.floor(inside / F.col("_each"))).alias("sequence_id"), (F.col("_offset") + inside % F.col("_each") * F.col("length")).alias("offset"))
    return _renamed(whole.unionByName(placed), key)


def _renamed(found: DataFrame, key: str) -> DataFrame:
    clash = [c for c in found.columns if c == key]
    return found.withColumnsRenamed({c: f"{c}_" for c in clash}).withColumnRenamed("_key", key)
