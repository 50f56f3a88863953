"""I-Match fingerprints with randomised lexicons, with DataFrame functions only.

Terms whose share of the documents lies within a band, that is whose inverse
document frequency does, make up the lexicon. A fingerprint sorts a document's
distinct lexicon terms and hashes them, once for each of several randomised
subsets of the lexicon. Subsets come in levels, each half as dense as the one
before, of which every text takes ``LEVELS``: those that hold from some four of
its terms down to next to none, whatever its length. An edit changes the hashes
of the subsets that it touches.

Which subsets hold a term is drawn once per lexicon term: a ``depth`` for each
of ``SUBSETS`` salts, 5 bits each, in one long.

The band's lower end bounds the lexicon whatever the corpus: there are at most
(mean distinct terms of a document) / ``LOW`` terms that frequent, which is
checked before the lexicon is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.scratch import Scratch, settings

#: The band: shares of the documents that have a term. log2(1 / share) is its inverse document frequency.
LOW, HIGH = 0.0005, 0.2
#: Levels of a text, and randomised subsets of the lexicon in each.
LEVELS, SUBSETS = 6, 12
#: A text's first level is so many below the base-2 logarithm of its lexicon terms: a subset there holds 2 to 4 of them on average.
DENSER = 2
#: Lexicon terms that are broadcast at most; a larger lexicon is joined by shuffling.
BROADCAST_TERMS = 2_000_000
_DEEPEST = 31
_NONE = -1


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-case runs of letters and digits, in ascending order."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, depths) of the terms whose document frequency, over all rows, is within the band, and at least 2.

    The depth for a salt is the number of zero bits that a hash of term and salt ends in; a subset of level l holds the deeper ones than l.
    """
    rows = docs.count()
    found = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = found.where((F.col("df") >= max(2.0, low * rows)) & (F.col("df") <= high * rows)).select("term")
    depths = F.lit(0).cast("long")
    for s in range(SUBSETS):
        low_bits = F.xxhash64("term", F.lit(s)).bitwiseAND(F.lit((1 << _DEEPEST) - 1))
        zeros = F.least(F.bit_count(F.bitwise_not(low_bits).bitwiseAND(low_bits - 1)), F.lit(_DEEPEST))
        depths = depths.bitwiseOR(F.shiftleft(zeros.cast("long"), 5 * s))
    return kept.select("term", depths.alias("depths"))


def hashes(found: str, first: str) -> Column:
    """SUBSETS x LEVELS hashes of 16 bits of a sorted array of (term, depths), subset by subset, each from level ``first`` on; -1 where a subset holds no term."""
    held = f"transform(filter({found}, x -> (shiftright(x.depths, 5 * s) & 31) > {first}), x -> struct(x.term as term, shiftright(x.depths, 5 * s) & 31 as depth))"
    kept = f"transform(filter(h, y -> y.depth > {first} + j), y -> y.term)"
    one = f"transform(sequence(0, {LEVELS - 1}), j -> {kept})"
    lists = f"flatten(transform(sequence(0, {SUBSETS - 1}), s -> transform(array({held}), h -> {one})[0]))"
    return F.expr(f"transform({lists}, t -> if(size(t) = 0, {_NONE}, cast(xxhash64(t) & 65535 as int)))")


def with_likeness(rows: DataFrame, name: str, a: str, b: str, same: Column) -> DataFrame:
    """Adds how alike two prints (columns a, b, and their first levels a_first, b_first) are, from 0 to 1; 1 where ``same``.

    Of the subsets in which either text has terms, the share that agrees: in
    the least dense common level in which at least half of the subsets have
    some, and in all common levels less dense than it. No such level: in all common ones.
    """
    counts = {}
    for level in range(LEVELS):
        other = f"({a}_first + {level} - {b}_first)"
        x, y = f"{a}[i * {LEVELS} + {level}]", f"{b}[i * {LEVELS} + {other}]"
        # agreeing subsets in hundreds, all that have terms in ones
        count = f"aggregate(sequence(0, {SUBSETS - 1}), 0, (n, i) -> n + case when {x} = {_NONE} and {y} = {_NONE} then 0 when {x} = {y} then 101 else 1 end)"
        counts[f"_l{level}"] = F.expr(f"if({other} between 0 and {LEVELS - 1}, {count}, 0)")
    rows = rows.withColumns(counts)
    some, equal = F.lit(0), F.lit(0)
    for level in range(LEVELS):
        n = F.col(f"_l{level}")
        here, agree = n % 100, F.floor(n / 100).cast("int")
        dense = here * 2 >= SUBSETS
        some, equal = F.when(dense, here).otherwise(some + here), F.when(dense, agree).otherwise(equal + agree)
    found = rows.withColumns({"_some": some, "_equal": equal}).drop(*counts)
    share = F.coalesce(F.try_divide(F.col("_equal").cast("double"), F.col("_some").cast("double")), F.lit(0.0))
    return found.withColumn(name, F.when(same, F.lit(1.0)).otherwise(share)).drop("_some", "_equal")


def in_order(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(k1, k2, id, n, m, n1, n2, p1, p2, need) of (k1, k2, id, n): a row for each distinct (k1, k2), m of which there are, with the keys of the next and previous one and a quarter of the previous one's n.

    By ascending id, nulls last, then k2; the last one's next is the first.
    Ids are cut into ranges of about as many rows (whatever their values), so
    that only the ends of ranges are put in order in one task.
    """
    single = keyed.groupBy("k1", "k2").agg(F.max("id").alias("id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("m")).withColumn("last", F.col("id").isNull())
    # no adaptive split or merge may come between the ranges and their numbers
    ranged = scratch.put(single.repartitionByRange("last", "id", "k2").withColumn("range", F.spark_partition_id()), "ranges")
    fact = F.struct("last", "id", "k2", "k1", "n")
    ends = ranged.groupBy("range").agg(F.min(fact).alias("head"), F.max(fact).alias("tail"))  # a row for each range
    every = Window.orderBy("range")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("range", F.coalesce(F.lead("head").over(every), F.first("head").over(whole)).alias("after"), F.coalesce(F.lag("tail").over(every), F.last("tail").over(whole)).alias("ahead"))
    own = Window.partitionBy("range").orderBy("last", "id", "k2")
    near = ranged.withColumn("next", F.lead(fact).over(own)).withColumn("prev", F.lag(fact).over(own)).join(F.broadcast(ends), "range")
    near = near.withColumn("next", F.coalesce("next", "after")).withColumn("prev", F.coalesce("prev", "ahead"))
    return near.select("k1", "k2", "id", "n", "m", F.col("next.k1").alias("n1"), F.col("next.k2").alias("n2"), F.col("prev.k1").alias("p1"), F.col("prev.k2").alias("p2"), F.floor(F.col("prev.n") / 4).cast("int").alias("need"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    edited is the SHA-256 of the text whose last quarter is replaced by the
    start of the next document's, in ascending order of key (nulls last, ties
    by the text's hash; after the last comes the first, which for a single one
    is itself). Rows that repeat key and text are one document in that order
    and have equal results. Texts count as empty if null. A fingerprint is the
    first level, two digits, and subset by subset the hashes of its levels, four
    digits each, dots where none of the terms is held. A text without lexicon terms, as an empty
    one, is fingerprinted by its own hash: such fingerprints are alike (1) if
    equal, else not (0). Equal texts have equal fingerprints. Texts may have
    any length. No rows give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "imatch")
    plain = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = scratch.put(lexicon(plain), "lexicon")
    words = F.broadcast(words) if words.count() <= BROADCAST_TERMS else words
    keyed = plain.select(F.coalesce("id", F.lit(0)).alias("k1"), F.xxhash64("text", F.col("id").isNull()).alias("k2"), "id", "text")
    order = scratch.put(in_order(keyed.select("k1", "k2", "id", F.length("text").alias("n")), scratch), "order")
    single = keyed.select("k1", "k2", "text").dropDuplicates(["k1", "k2"])
    given = single.join(order.hint("merge"), ["k1", "k2"])
    starts = given.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.expr("substring(text, 1, need)").alias("start"))
    rows = given.join(starts.hint("merge"), ["k1", "k2"])
    edited = F.concat(F.expr("substring(text, 1, n - cast(floor(n / 4) as int))"), F.col("start"))
    rows = rows.select("k1", "k2", "text", edited.alias("edited"))
    # the digest as four longs, and a hash of either text for those without terms
    sha = F.sha2("edited", 256)
    quarters = [F.conv(F.substring(sha, 1 + 16 * i, 16), 16, -10).cast("bigint") for i in range(4)]
    facts = F.array(*quarters, F.xxhash64("text"), F.xxhash64("edited"))
    both = rows.select("k1", "k2", facts.alias("facts"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("x"))
    both = both.select("k1", "k2", "x.which", F.when(F.col("x.which") == 0, F.col("facts")).alias("facts"), terms(F.col("x.text")).alias("terms"))
    spread = both.select("k1", "k2", "which", F.posexplode_outer("terms").alias("at", "term"), "facts")
    spread = spread.select("k1", "k2", "which", "term", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("facts")).alias("facts"))
    known = spread.join(words, "term", "left").where("depths is not null or facts is not null")
    of = lambda i: F.sort_array(F.collect_list(F.when((F.col("which") == i) & F.col("depths").isNotNull(), F.struct("term", "depths"))))
    sets = known.groupBy("k1", "k2").agg(of(0).alias("a"), of(1).alias("b"), F.max("facts").alias("facts"))
    level = lambda c: F.greatest(F.lit(0), F.length(F.bin(F.size(c))) - 1 - DENSER)
    sets = sets.withColumns({"a_first": level("a"), "b_first": level("b")})
    printed = sets.select("k1", "k2", "facts", F.size("a").alias("a_terms"), F.size("b").alias("b_terms"), "a_first", "b_first", hashes("a", "a_first").alias("a"), hashes("b", "b_first").alias("b"))
    # rows of a text are neighbours already, so that sorted aggregation needs no sort
    with settings(spark, {"spark.sql.execution.useObjectHashAggregateExec": "false"}):
        printed = scratch.put(printed, "prints")
    scratch.drop("ranges")
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    four = lambda x: F.when(x == _NONE, F.lit("....")).otherwise(F.lower(F.lpad(F.hex(x), 4, "0")))
    line = lambda c, at: F.when(F.col(f"{c}_terms") == 0, digits(F.col("facts")[at])).otherwise(F.concat(F.lpad(F.col(f"{c}_first").cast("string"), 2, "0"), F.array_join(F.transform(c, four), "")))
    printed = printed.withColumns({"fingerprint": line("a", 4), "edited_fingerprint": line("b", 5)})
    nexts = printed.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("a").alias("c"), F.col("a_first").alias("c_first"), F.col("fingerprint").alias("next_print"))
    own = printed.join(order.select("k1", "k2", "id", "n", "m", "n1", "n2"), ["k1", "k2"]).join(nexts, ["n1", "n2"])
    own = with_likeness(own, "near_edited", "a", "b", F.col("fingerprint") == F.col("edited_fingerprint"))
    own = with_likeness(own, "near_next", "a", "c", F.col("fingerprint") == F.col("next_print"))
    edited_sha = F.concat(*[digits(F.col("facts")[i]) for i in range(4)])
    own = own.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_chars"), edited_sha.alias("edited"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.col("m").alias("_m"))
    return own.withColumn("_m", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m")))).drop("_m")
