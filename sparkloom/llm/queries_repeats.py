"""Queries that remove what repeats across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import substring_dedup, suffix_index
from sparkloom.llm.queries import query, table


@query("""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM b, LATERAL (SELECT unnest(range(0, n - 49)) AS i)),
f AS (SELECT w, min(doc_id) AS m FROM s GROUP BY w HAVING min(doc_id) < max(doc_id)),
r AS (SELECT s.doc_id, s.i FROM s JOIN f USING (w) WHERE f.m < s.doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, LATERAL (SELECT unnest(range(0, 50)) AS j)),
q AS (SELECT doc_id, list(p) AS ps, count(*) AS n_removed, count(*) FILTER (p <> coalesce(before, -2) + 1) AS n_spans
      FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM c) GROUP BY doc_id),
k AS (SELECT b.doc_id, string_agg(substr(h, 2 * x + 1, 2), '' ORDER BY x) AS kept FROM (SELECT b.* FROM b JOIN q USING (doc_id)) b, LATERAL (SELECT unnest(range(0, n)) AS x) LEFT JOIN c ON c.doc_id = b.doc_id AND c.p = x WHERE c.p IS NULL GROUP BY b.doc_id)
SELECT b.doc_id, b.n AS n_bytes, coalesce(q.n_removed, 0) AS n_removed, coalesce(q.n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN q.doc_id IS NULL THEN b.h ELSE coalesce(k.kept, '') END)) AS kept_sha256
FROM b LEFT JOIN q USING (doc_id) LEFT JOIN k USING (doc_id)
""")
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_index.repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 50], ' ') AS w FROM d, LATERAL (SELECT unnest(range(0, len(ws) - 49)) AS i)),
f AS (SELECT w, min(doc_id) AS m FROM s GROUP BY w HAVING min(doc_id) < max(doc_id)),
r AS (SELECT s.doc_id, s.i FROM s JOIN f USING (w) WHERE f.m < s.doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, LATERAL (SELECT unnest(range(0, 50)) AS j)),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, string_agg(ws[x + 1], ' ' ORDER BY x) AS kept FROM d, LATERAL (SELECT unnest(range(0, len(ws))) AS x) LEFT JOIN c ON c.doc_id = d.doc_id AND c.p = x WHERE c.p IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
""")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
