"""Fuzzy line deduplication, with DataFrame functions only.

Lines are normalised and collapsed to distinct ones. A line's SimHash has 63
majority bits over its distinct words, so that a word that prevails in a line
does not decide it. Distinct lines meet under pigeonhole blocks:

* of the bits: cut into ``BLOCKS`` blocks, two hashes that differ in at most
  ``DISTANCE`` bits agree in ``BLOCKS - DISTANCE`` blocks, so there is a key for
  each choice of that many blocks;
* of the words: a changed word or two moves more than that in a line of usual
  length, but leaves most of its 8, 4 or 2 segments as they are (half of them
  counted from either end, so that an added word shifts no others), so there is
  a key for each segment of ``SEGMENT`` words or more.

Pairs that meet, differ in at most ``FAR`` bits and are about as long have
their edit similarity computed. Of every connected group of lines the first
occurrence in the corpus stays.

Every pair of a bucket counts, but not all are made. Most buckets hold two lines
that agree on a key by chance and go at once, as their bits or lengths differ
too much; so do lines of a larger bucket that are like no other line of it in
bits and length. The rest meet the bucket's first and last line, and only where
a bucket's lines are not connected by then, those of different groups are
compared with each other, in the first bucket that they share, inside a join
that emits similar pairs alone.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import components
from sparkloom.llm.scratch import Scratch

#: Differing bits for which the blocks miss nothing, and blocks that the 63 bits are cut into.
DISTANCE, BLOCKS = 3, 5
#: Words of a segment at least, and bits in which lines that meet may differ.
SEGMENT, FAR = 5, 13
#: The least edit similarity: 1 - distance / the longer length.
SIMILARITY = 0.9
#: Words that pieces of two lines are looked for ahead, and the longest text between pieces whose own edits are counted.
AHEAD, BETWEEN = 16, 256
#: Block keys that are dealt out at once; the fewer, the smaller is a shuffle.
TURN = 5
#: Shorter normalised lines are never removed; empty ones never are.
MIN_CHARS = 1
#: Words that are summed in 3-bit lanes, and in 9-bit lanes.
_FEW, _MANY = 7, 252
_THIN, _WIDE = sum(1 << 3 * k for k in range(21)), sum(7 << 9 * k for k in range(7))


def plain(text: Column) -> Column:
    """Lower case, with spaces for other white space within a line and for no-break spaces."""
    for blank in ("\t", "\r", "\x0b", "\x0c", "\u00a0"):
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.lower(text)


def words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def simhash(hashes: str) -> Column:
    """The 63 majority bits of an array column of distinct 64-bit hashes; 0 for an empty one.

    Counters are lanes of longs: 3 longs of 21 lanes count 7 words, 9 longs of
    7 lanes sum up to 36 such. Longer arrays are counted by slices, whose lanes
    are then unpacked.
    """
    longs = range(9)
    thin = ", ".join("'g%d', %s" % (j, " + ".join(f"(shiftrightunsigned(c[{t}], {j}) & {_THIN}L)" for t in range(_FEW))) for j in range(3))
    zero = "named_struct(" + ", ".join(f"'c{j}', 0L" for j in longs) + ")"
    step = "named_struct(" + ", ".join(f"'c{j}', u.c{j} + (shiftrightunsigned(x.g{j % 3}, {j // 3 * 3}) & {_WIDE}L)" for j in longs) + ")"

    def count(of: str, then: str) -> str:
        sevens = f"transform(sequence(1, size({of}), {_FEW}), at -> slice(concat({of}, array_repeat(0L, {_FEW - 1})), at, {_FEW}))"
        return f"aggregate(transform({sevens}, c -> named_struct({thin})), {zero}, (u, x) -> {step}, u -> {then})"

    # what a lane lacks to its highest bit is added to it, so that bit says whether it counts over half
    ones = sum(1 << 9 * k for k in range(7))
    lack = f"(255 - size({hashes}) div 2) * {ones}L"
    short = count(hashes, " | ".join(f"shiftleft(shiftrightunsigned(u.c{j} + {lack}, 8) & {ones}L, {j})" for j in longs))
    lanes = "transform(sequence(0, 62), b -> shiftrightunsigned(array(" + ", ".join(f"u.c{j}" for j in longs) + ")[b % 9], 9 * cast(b div 9 as int)) & 511L)"
    slices = f"transform(sequence(1, size({hashes}), {_MANY}), i -> slice({hashes}, i, {_MANY}))"
    majority = f"aggregate(sequence(0, 62), 0L, (n, b) -> if(t[b] * 2 > size({hashes}), n | shiftleft(1L, b), n))"
    long = f"aggregate({slices}, array_repeat(0L, 63), (t, part) -> zip_with(t, {count('part', lanes)}, (v, w) -> v + w), t -> {majority})"
    return F.expr(f"case when size({hashes}) = 0 then 0L when size({hashes}) <= {_MANY} then {short} else {long} end")


def segment_scale(hashes: str) -> Column:
    """The least number on a scale of steps of a quarter that an array column has elements for; most lines with a word more or less have the same."""
    steps = F.floor(F.log(F.greatest(F.size(hashes), F.lit(1))) / F.log(F.lit(1.25)) + F.lit(1e-9))
    return F.floor(F.pow(F.lit(1.25), steps)).cast("int")


def segment_parts(scale: str) -> Column:
    """How many segments a line of such a scale is cut into."""
    return F.when(F.col(scale) >= 8 * SEGMENT, 8).when(F.col(scale) >= 4 * SEGMENT, 4).otherwise(2)


def segment_keys(hashes: str, parts: str, size: str) -> list[Column]:
    """Keys of the 8, 4 or 2 segments of an array column of word hashes, null for those that a line does not have.

    ``parts`` and ``size`` are columns, as Java methods that compute them again
    for each key grow past what is compiled.
    """
    out = []
    for i in range(4):
        fits = (2 * i < F.col(parts)) & (F.col(size) >= SEGMENT)
        for side, start in ((0, F.col(size) * i + 1), (1, F.size(hashes) - F.col(size) * (i + 1) + 1)):
            out.append(F.when(fits, F.xxhash64(F.lit(2 * i + side), size, F.slice(F.col(hashes), F.greatest(start, F.lit(1)), F.col(size)))))
    return out


def _alike(p: str, q: str) -> Column:
    """How many words two arrays begin with alike."""
    n = F.least(F.size(p), F.size(q))
    at = F.array_position(F.zip_with(F.slice(p, F.lit(1), n), F.slice(q, F.lit(1), n), lambda u, v: u == v), False)
    return F.when(at == 0, n).otherwise(at - 1).cast("int")


def middles(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Replaces two columns of lines by what is left without the words that they begin and end with alike; the edit distance is the same.

    Each word that is left has a space before it. ``_aligned`` is the edits
    that turn one into the other word by word, never fewer than the edit
    distance; null if they have not as many words. Columns stand step by step,
    for an expression that is used twice would be evaluated twice.
    """
    others = [c for c in pairs.columns if c not in (x, y)]
    now = pairs.select(*others, F.split(x, " ").alias("_a"), F.split(y, " ").alias("_b"))
    now = now.withColumn("_n", _alike("_a", "_b"))
    now = now.select(*others, *[F.reverse(F.slice(c, F.col("_n") + 1, F.size(c) - F.col("_n"))).alias(c) for c in ("_a", "_b")])
    now = now.withColumn("_n", _alike("_a", "_b"))
    now = now.select(*others, *[F.reverse(F.slice(c, F.col("_n") + 1, F.size(c) - F.col("_n"))).alias(c) for c in ("_a", "_b")])
    each = F.zip_with("_a", "_b", lambda u, v: F.when(u == v, 0).otherwise(F.levenshtein(u, v)))
    aligned = F.when(F.size("_a") == F.size("_b"), F.aggregate(each, F.lit(0), lambda n, d: n + d))
    return now.select(*others, *[F.concat_ws("", F.transform(c, lambda w: F.concat(F.lit(" "), w))).alias(n) for c, n in zip(("_a", "_b"), (x, y), strict=True)], aligned.alias("_aligned"))


def block_masks() -> list[int]:
    """The bits of each choice of BLOCKS - DISTANCE blocks."""
    edges = [63 * i // BLOCKS for i in range(BLOCKS + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(masks, BLOCKS - DISTANCE)]


def block_keys(bits: Column) -> list[Column]:
    """A key for each choice of BLOCKS - DISTANCE blocks."""
    return [F.xxhash64(F.lit(100 + i), bits.bitwiseAND(F.lit(mask))) for i, mask in enumerate(block_masks())]


def first_block(x: str, y: str) -> Column:
    """Which block key two hashes agree on first; the number of block keys if on none."""
    apart, masks = F.col(x).bitwiseXOR(F.col(y)), block_masks()
    out = F.lit(len(masks))
    for i in range(len(masks) - 1, -1, -1):
        out = F.when(apart.bitwiseAND(F.lit(masks[i])) == 0, i).otherwise(out)
    return out


def edits(length: Column, similarity: float) -> Column:
    """The edits that a pair may differ in, given the longer length."""
    return F.floor(length * F.lit(round(1 - similarity, 6)) + F.lit(1e-9)).cast("int")


def within(x: str, y: str, most: str) -> Column:
    """Whether two lines are ``most`` edits apart at most. The function's time follows the product of the lengths, for few edits as well."""
    return F.expr(f"levenshtein({x}, {y}, {most}) >= 0")


def piecewise(x: str, y: str, most: str) -> Column:
    """Edits that turn one into the other of two columns of ``middles``, in time that follows their lengths; never fewer than the edit distance.

    Going through the words of one line, each pair of neighbours is looked for
    among the next ``AHEAD`` of the other; what lies between pieces so found is
    compared by itself, or counted in full if long. Null if a line is empty;
    past ``most`` the count ends.
    """
    pairs = "zip_with({0}, slice({0}, 2, size({0})), (u, v) -> concat(u, ' ', coalesce(v, '')))"
    a, b = (f"split(substr({c}, 2), ' ')" for c in (x, y))

    def cost(gap: str, other: str) -> str:
        each = f"case when o.g = '' or o.h = '' or greatest(length(o.g), length(o.h)) > {BETWEEN} then greatest(length(o.g), length(o.h)) else levenshtein(o.g, o.h) end"
        return f"get(transform(array(named_struct('g', {gap}, 'h', {other})), o -> {each}), 0)"

    def between(start: str, n: str) -> str:
        return f"case when {n} > 0 then concat(' ', array_join(slice(w.b, {start} + 1, {n}), ' ')) else '' end"

    met = f"named_struct('at', s.at + f, 'cost', s.cost + {cost('s.gap', between('s.at', 'f - 1'))}, 'gap', '')"
    unmet = "named_struct('at', s.at, 'cost', s.cost, 'gap', concat(s.gap, ' ', get(w.a, i)))"
    look = f"cast(array_position(slice(w.q, s.at + 1, {AHEAD}), get(w.p, i)) as int)"
    step = f"case when s.cost > {most} then s when s.gap = '' and get(w.q, s.at) = get(w.p, i) then named_struct('at', s.at + 1, 'cost', s.cost, 'gap', '') else get(transform(array({look}), f -> case when f = 0 then {unmet} else {met} end), 0) end"
    walk = f"aggregate(sequence(0, size(w.p) - 1), named_struct('at', 0, 'cost', 0, 'gap', ''), (s, i) -> {step}, s -> s.cost + {cost('s.gap', between('s.at', 'size(w.b) - s.at'))})"
    words_of = f"named_struct('a', t.a, 'b', t.b, 'p', {pairs.format('t.a')}, 'q', {pairs.format('t.b')})"
    return F.expr(f"case when {x} <> '' and {y} <> '' then get(transform(transform(array(named_struct('a', {a}, 'b', {b})), t -> {words_of}), w -> {walk}), 0) end")


def with_bits(lines: DataFrame, hashes: str) -> DataFrame:
    """Lines with ``_bits``, the SimHash of an array column, in its place; the same as ``simhash``.

    Up to ``_MANY`` hashes are a row for every seven, summed in lanes by a
    hash aggregate, which Spark compiles, unlike functions of array elements.
    """
    others = [c for c in lines.columns if c != hashes]
    one = lines.select(F.monotonically_increasing_id().alias("_id"), *others, hashes, F.size(hashes).alias("_n"), F.when(F.size(hashes) > _MANY, simhash(hashes)).alias("_long"))
    sevens = F.when(F.col("_long").isNull(), F.greatest((F.col("_n") - 1) / _FEW, F.lit(0)).cast("int")).otherwise(0)
    each = one.select("*", F.explode(F.sequence(F.lit(0), sevens)).alias("_seven"))
    taken = [F.coalesce(F.get(hashes, F.col("_seven") * _FEW + t), F.lit(0)).alias(f"_w{t}") for t in range(_FEW)]
    held = ["_id", *others, "_n", "_long"]
    thin = each.select(*held, *taken).select(*held, *[sum((F.shiftrightunsigned(f"_w{t}", j).bitwiseAND(F.lit(_THIN)) for t in range(1, _FEW)), F.shiftrightunsigned("_w0", j).bitwiseAND(F.lit(_THIN))).alias(f"_g{j}") for j in range(3)])
    sums = thin.groupBy(*held).agg(*[F.sum(F.shiftrightunsigned(f"_g{j % 3}", j // 3 * 3).bitwiseAND(F.lit(_WIDE))).alias(f"_c{j}") for j in range(9)])
    ones = sum(1 << 9 * k for k in range(7))
    lack = (F.lit(255) - F.floor(F.col("_n") / 2).cast("long")) * F.lit(ones)
    bits = [F.shiftleft(F.shiftrightunsigned(F.col(f"_c{j}") + lack, 8).bitwiseAND(F.lit(ones)), j) for j in range(9)]
    return sums.select(*others, F.coalesce("_long", reduce(Column.bitwiseOR, bits)).alias("_bits"))


def described(texts: DataFrame, text: str) -> DataFrame:
    """The other columns of texts, and for each line that is not blank _at, _sha, _len, _bits and _s0 to _s7, the segment keys."""
    others = [c for c in texts.columns if c != text]
    lines = texts.select(*others, F.posexplode(F.split(plain(F.col(text)), "\n")).alias("_at", "_raw")).where("trim(_raw) <> ''")
    keys = [*others, "_at"]
    split = lines.select(*keys, words(F.col("_raw")).alias("_words"))
    split = split.select(*keys, F.array_join("_words", " ").alias("_line"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    split = split.select(*keys, F.unhex(F.substring(F.sha2("_line", 256), 1, 32)).alias("_sha"), F.length("_line").alias("_len"), "_hashes", F.array_distinct("_hashes").alias("_set"), segment_scale("_hashes").alias("_scale"))
    split = split.select("*", segment_parts("_scale").alias("_parts")).select("*", F.floor(F.col("_scale") / F.col("_parts")).cast("int").alias("_size"))
    segments = [f"_s{i}" for i in range(8)]
    found = with_bits(split.select(*keys, "_sha", "_len", "_set", *[k.alias(s) for k, s in zip(segment_keys("_hashes", "_parts", "_size"), segments, strict=True)]), "_set")
    return found.select(*keys, "_sha", "_len", "_bits", *segments)


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of ``docs``; ``text`` without removed lines, and n_lines, n_removed and removed (line numbers from 0).

    The three replace columns of those names. Lines end at ``\\n``. Occurrences
    are ordered by key, nulls last, then line number. Lines under ``min_chars``
    characters once normalised stay, and so do empty ones. Null texts stay null
    with 0 lines, empty ones have one line. Lines and texts may have any length.
    Rows that repeat key and text are one document: they lose the same lines.
    Rows of one key with different texts go by the text's hash. No rows give no
    rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("_doc"), F.xxhash64(text).alias("_name"), F.col(text).alias("_text"))
    texts = rows.where("_text is not null").select("_doc", "_name", "_text")
    segments = [f"_s{i}" for i in range(8)]
    seen = scratch.put(described(texts, "_text"), "lines").where(F.col("_len") >= min_chars)
    place = F.struct("_doc", "_name", "_at")
    distinct = seen.repartition("_sha").groupBy("_sha").agg(F.min(place).alias("_first"), F.max(place).alias("_last"), *[F.max(c).alias(c) for c in ("_len", "_bits", *segments)])
    distinct = scratch.put(distinct.withColumn("_cid", F.monotonically_increasing_id()), "distinct")

    def near(p: str, q: str) -> Column:
        """What tells most pairs apart without their lines."""
        close = F.abs(F.col(f"{p}_len") - F.col(f"{q}_len")) <= edits(F.greatest(f"{p}_len", f"{q}_len"), similarity)
        return close & (F.bit_count(F.col(f"{p}_bits").bitwiseXOR(F.col(f"{q}_bits"))) <= FAR)

    def sided(of: DataFrame, p: str, *more: str) -> DataFrame:
        return of.select("_key", *[F.col(c).alias(f"{p}{c}") for c in ("_cid", "_bits", "_len", *more)])

    # buckets of two lines or more; a key ends in its slot, and the bits and lengths of two lines are the least and the greatest of their bucket
    keys = [*block_keys(F.col("_bits")), *[F.col(c) for c in segments]]
    slots = len(keys) - len(segments)
    turns = [range(i, min(i + TURN, slots)) for i in range(0, slots, TURN)] + [range(slots, len(keys))]
    of_turn = []
    for i, turn in enumerate(turns):
        marked = F.array(*[F.shiftleft(keys[slot], 5).bitwiseOR(F.lit(slot)) for slot in turn])
        met = distinct.select("_cid", "_bits", "_len", F.explode(marked).alias("_key")).where("_key is not null").repartition("_key")
        ends = [f(c).alias(f"{p}{c}") for c in ("_cid", "_bits", "_len") for p, f in (("lo", F.min), ("hi", F.max))]
        buckets = met.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), *ends).where((F.col("_n") > 2) | ((F.col("_n") == 2) & near("lo", "hi")))
        of_turn.append(scratch.put(met.join(buckets.select("_key", "_n", F.col("lo_cid").alias("_lo"), F.col("hi_cid").alias("_hi")).hint("shuffle_hash"), "_key"), f"members-{i}"))
    members = reduce(DataFrame.union, of_turn)
    hubs = sided(members.where("_cid = _lo or _cid = _hi"), "h")
    meet = (members["_key"] == hubs["_key"]) & (F.col("_cid") != F.col("h_cid")) & near("", "h")
    pairs = members.join(hubs.hint("merge"), meet).select(F.least("_cid", "h_cid").alias("a"), F.greatest("_cid", "h_cid").alias("b"))
    pairs = scratch.put(pairs.distinct(), "pairs")
    # lines of larger buckets that are near another one; a semi join ends with the first that it finds
    large, others = members.where("_n > 3").select("_key", "_cid", "_bits", "_len"), sided(members.where("_n > 3"), "o")
    some = (large["_key"] == others["_key"]) & (F.col("_cid") != F.col("o_cid")) & near("", "o")
    close = scratch.put(large.join(others.hint("merge"), some, "left_semi"), "close")

    # the lines that are compared
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_cid")).union(close.select("_cid")).distinct()
    at = wanted.join(distinct, "_cid").select("_cid", "_first._doc", "_first._name", "_first._at")
    at = at.groupBy("_doc", "_name").agg(F.collect_list(F.struct("_at", "_cid")).alias("_wanted"))
    holders = texts.join(at.hint("shuffle_hash"), ["_doc", "_name"])
    split = holders.select(F.split("_text", "\n").alias("_lines"), F.explode("_wanted").alias("_w"))
    line = F.array_join(words(plain(F.expr("_lines[_w._at]"))), " ")
    found = scratch.put(split.select(F.col("_w._cid").alias("_cid"), line.alias("_line")).dropDuplicates(["_cid"]), "compared")

    sides = pairs.join(found.select(F.col("_cid").alias("a"), F.col("_line").alias("_x")), "a").join(found.select(F.col("_cid").alias("b"), F.col("_line").alias("_y")), "b")
    most = edits(F.greatest(F.length("_x"), F.length("_y")), similarity)
    # written, as a filter on what is left would be pushed below the steps that make it
    left = scratch.put(middles(sides.select("a", "b", "_x", "_y", most.alias("_most")), "_x", "_y"), "middles")
    few = [F.coalesce(n <= F.col("_most"), F.lit(False)) for n in (F.col("_aligned"), piecewise("_x", "_y", "_most"))]
    links = scratch.put(left.where(few[0] | few[1] | within("_x", "_y", "_most")).select("a", "b"), "links")
    groups = components(links, scratch, "groups")

    # buckets whose lines are in several groups yet
    grouped = close.join(groups.select(F.col("node").alias("_cid"), F.col("component").alias("_group")), "_cid", "left").withColumn("_group", F.coalesce("_group", "_cid"))
    grouped = scratch.put(grouped, "grouped")
    apart = grouped.groupBy("_key").agg(F.min("_group").alias("_a"), F.max("_group").alias("_b")).where("_a < _b").select("_key")
    open_lines = scratch.put(grouped.join(apart, "_key").join(found, "_cid"), "open")
    if not open_lines.isEmpty():
        one, two = sided(open_lines, "a", "_group", "_line"), sided(open_lines, "b", "_group", "_line")
        alike = within("a_line", "b_line", f"cast(floor(greatest(a_len, b_len) * {round(1 - similarity, 6)}D + 1e-9D) as int)")
        once = F.least(one["_key"].bitwiseAND(F.lit(31)), F.lit(slots)) == first_block("a_bits", "b_bits")
        same = (one["_key"] == two["_key"]) & (F.col("a_cid") < F.col("b_cid")) & (F.col("a_group") != F.col("b_group")) & near("a", "b") & once & alike
        more = one.hint("merge").join(two.hint("merge"), same).select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")).distinct()
        more = scratch.put(more, "more")
        groups = components(links.union(more), scratch, "all-groups")
    groups = scratch.put(groups.select(F.col("node").alias("_cid"), F.col("component").alias("_group")), "joined")

    of_line = distinct.select("_sha", "_cid", "_first", "_last").join(groups, "_cid", "left").where("_group is not null or _first < _last").withColumn("_group", F.coalesce("_group", "_cid"))
    keep = of_line.groupBy("_group").agg(F.min("_first").alias("_keep"), F.max("_last").alias("_end")).where("_keep < _end")  # the rest occur once
    keeper = scratch.put(of_line.join(keep, "_group").select("_sha", "_keep"), "keepers")
    gone = seen.select("_sha", "_doc", "_name", "_at").join(keeper, "_sha").where(place != F.col("_keep")).groupBy("_doc", "_name").agg(F.sort_array(F.collect_set("_at")).alias("_gone"))
    gone = scratch.put(gone, "gone")
    scratch.drop("lines", "distinct", *[f"members-{i}" for i in range(len(turns))], "pairs", "close", "compared", "middles", "links", "grouped", "open", "more", "joined", "keepers")

    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    joined = rows.select("_row", "_doc", "_name").join(gone.hint("shuffle_hash"), ["_doc", "_name"], "left").withColumn("_text", F.col("_row")[text])
    lines_of, out = F.split("_text", "\n"), F.coalesce("_gone", F.array().cast("array<int>"))
    member = F.map_from_arrays(out, F.transform(out, lambda _: F.lit(True)))
    rest = F.array_join(F.filter(lines_of, lambda _, i: ~F.map_contains_key(member, i)), "\n")
    new_text = F.when(F.size(out) > 0, rest).otherwise(F.col("_text"))
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines_of)).cast("long")
    return joined.select(*[new_text.alias(c) if c == text else F.col("_row")[c].alias(c) for c in kept], n_lines.alias("n_lines"), F.size(out).cast("long").alias("n_removed"), out.alias("removed"))
