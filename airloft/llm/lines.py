"""Line dedup: keep a repeated line only in the smallest doc_id that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, cut, hash_pair, shielded, table

MIN_CHARS = 10
MIN_DOCS = 2
#: Stands for a null doc_id, which sorts after all others.
LAST = 2**63 - 1


@shielded("doc_id", "text")
def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Adds n_lines, n_dropped and kept_text to docs (doc_id, text, ...).

    A line's key is the line stripped of ASCII white space with A-Z lowered.
    Lines whose key has min_chars code points or more and occurs in min_docs
    documents or more are dropped, except in the smallest doc_id holding it.
    Null or empty text is one empty line. Null doc_ids count as one document
    after all others; rows with one doc_id and different texts are one
    document for keeping a line; identical rows get identical results.

    Only hashes of distinct lines are shuffled. A hash is counted with a
    map-side partial sum, so a line found everywhere costs one row a task;
    the join back is a plain shuffled join whose skewed keys AQE splits.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    t1, t2 = hash_pair(text)
    owner = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    based = docs.withColumn("_own", owner).withColumn("_t1", t1).withColumn("_t2", t2)

    lines = based.select("_own", "_t1", "_t2", F.posexplode(F.split(text, "\n")).alias("_pos", "_line"))
    key = ascii_lower(F.btrim(F.col("_line"), F.lit(BLANKS)))
    h1, h2 = hash_pair(key)
    keyed = lines.where(F.char_length(key) >= min_chars).select("_own", "_t1", "_t2", "_pos", h1.alias("_h1"), h2.alias("_h2"))
    if min_docs == 2:
        counted = keyed.groupBy("_h1", "_h2").agg(F.min("_own").alias("_first"), F.max("_own").alias("_last")).where("_first < _last")
    else:
        once = keyed.groupBy("_h1", "_h2", "_own").agg(F.lit(1).alias("_one"))
        counted = once.groupBy("_h1", "_h2").agg(F.min("_own").alias("_first"), F.count("_one").alias("_n")).where(F.col("_n") >= min_docs)
    counted = cut(counted.select("_h1", "_h2", "_first"))  # so that the join shuffles both sides and can split a hot key
    dropped = (
        keyed.join(counted, ["_h1", "_h2"])
        .where("_own > _first")
        .groupBy("_own", "_t1", "_t2")
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    n = F.size("_lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_drop"))
    merged = (
        based.join(dropped, ["_own", "_t1", "_t2"], "left")
        .withColumn("_lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
        .withColumn("n_lines", n.cast("long"))
        .withColumn("n_dropped", F.size("_drop").cast("long"))
        .withColumn("n_dropped", F.when(F.col("_drop").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_dropped")))
    )
    whole = F.coalesce(F.col("text"), F.lit(""))
    joined = F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n")
    return merged.withColumn("kept_text", F.when(F.col("_drop").isNull(), whole).otherwise(joined)).drop("_own", "_t1", "_t2", "_drop", "_lines")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, c.first IS NOT NULL AND k.doc_id > c.first AS dropped FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
