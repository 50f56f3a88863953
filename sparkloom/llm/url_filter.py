"""URL filters: host-suffix and path-prefix rules, found by short hash prefixes.

Each URL is expanded into the expressions ``host suffix + path prefix`` that
have the shape (labels, path length) of some rule. Expressions meet rules in an
equi-join on the first 32 bits of their SHA-256; the full digest confirms.
Of the rules that fit, the longest wins, then the one that blocks.

Only DataFrame functions are used. URLs are expanded once per distinct URL; the
join's size is |URLs| times |shapes|, whatever the number of rules, and Spark
broadcasts the rules only while their measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest that the join compares.
PREFIX_DIGITS = 8
#: Keys over which rows without a host are dealt out.
SPREAD = 4096


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """A rule table from (verdict, rule); a rule is host + path, such as ``example.org/a/``."""
    return spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of ``pages`` plus host, path, rule and verdict (they replace columns of those names).

    rules: columns rule (host + path) and verdict (``allow`` or ``block``); rows
    with a null are ignored, of repeated rules the one that blocks holds. A
    rule without ``/`` has an empty path. A URL that is null or has no ``://``
    gets empty host and path; no rule with a host fits it. Repeated pages are
    judged alike and all kept; no pages give no rows; no rules give ``default``.
    """
    known = (
        rules.select("rule", "verdict").where("rule is not null and verdict is not null")
        .groupBy("rule").agg(F.max("verdict").alias("verdict"))  # block > allow
        .withColumn("_host", F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER))
        .withColumn("_path", F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)"))
        .withColumn("_labels", F.size(F.split("_host", r"\.")))
        .withColumn("_length", F.length("_path"))
    )
    # at most (labels of a host) x (length of a path) shapes, however many rules there are
    shapes = [(r["_labels"], r["_length"]) for r in known.select("_labels", "_length").distinct().collect()]
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.select(F.struct(*kept).alias("_row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    columns = [F.col("_row")[c].alias(c) for c in kept]
    if not shapes:
        return judged.select(*columns, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.size(F.split("host", r"\."))
    expressions = F.array_compact(F.array(*[
        F.when((labels >= n) & (F.length("path") >= m) & (F.col("host") != ""), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, m)))
        for n, m in sorted(shapes)
    ]))
    digest = F.sha2(F.col("_expression"), 256)
    asked = judged.select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(expressions)).alias("_expression")).select("host", "path", digest.alias("_digest")).withColumn("_prefix", F.substring("_digest", 1, PREFIX_DIGITS))
    listed = known.select(F.concat("_host", "_path").alias("_expression"), "rule", F.col("verdict")).withColumn("_full", digest).select(F.substring("_full", 1, PREFIX_DIGITS).alias("_prefix"), "_full", "rule", "verdict")
    rank = F.struct(F.length("rule"), (F.col("verdict") == "block").cast("int"), F.col("rule"))
    found = (
        asked.join(listed, "_prefix").where("_digest = _full")
        .groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("_best"))
        .select(F.col("host").alias("_h"), F.col("path").alias("_p"), "_best")
    )
    # rows without a host, which no rule fits, are dealt out over many keys
    spread = F.when(F.col("host") == "", 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))
    found = found.withColumn("_z", F.lit(0).cast("long"))
    return (
        judged.withColumn("_spread", spread).join(found, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")) & (F.col("_spread") == F.col("_z")), "left")
        .select(*columns, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))
    )
