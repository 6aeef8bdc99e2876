"""Line dedup: lines that several documents share stay only in the first document that has them.

Line keys are hashed to 128 bits and the (hash, document, position) rows are range-partitioned by hash; a secondary sort by
document and position lets a window stream the first occurrence of each hash. What comes back is a keep bitmap for each
document, gap-coded, not text. A hash that a third of all lines share is dealt by a salt of its document over many
partitions: first occurrences are streamed within each salt, then among the few that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravec.llm.common import SPACE, ascii_lower, boxed, cut, partitions, quoted, table, unboxed

MIN_KEY_CHARS = 10
SALTS = 64


def lines_of(text: Column) -> Column:
    """The \\n-split lines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per line whose key has min_chars code points: hash (two longs), document, text hash, position."""
    key = lambda x: ascii_lower(F.btrim(x, F.lit(SPACE)))
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    keyed = lines.filter(F.char_length("line") >= min_chars).withColumn("key", key(F.col("line")))
    return keyed.filter(F.char_length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc", "text_hash", "pos")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_KEY_CHARS, salts: int = SALTS) -> DataFrame:
    """(doc, text_hash, pos) of each line that an earlier document (the smaller id) also has."""
    rows = cut(line_rows(docs, id_col, text_col, min_chars))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), "h1", "h2", "salt")
    order = [F.asc_nulls_first("doc"), F.asc("pos")]
    streamed = ranged.withColumn("first_doc", F.first("doc").over(Window.partitionBy("h1", "h2", "salt").orderBy(*order)))
    streamed = streamed.withColumn("repeat", ~F.col("doc").eqNullSafe(F.col("first_doc")))
    # what is left of a hash has one document for each salt
    left = streamed.filter(~F.col("repeat")).withColumn("first_doc", F.first("doc").over(Window.partitionBy("h1", "h2").orderBy(*order)))
    again = left.filter(~F.col("doc").eqNullSafe(F.col("first_doc")))
    return streamed.filter("repeat").select("doc", "text_hash", "pos").unionByName(again.select("doc", "text_hash", "pos"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_KEY_CHARS, salts: int = SALTS) -> DataFrame:
    """One row per document that loses a line: doc, text_hash and dropped, the ascending positions of its 0 bits."""
    dropped = dropped_lines(docs, id_col, text_col, min_chars, salts)
    return dropped.groupBy("doc", "text_hash").agg(F.sort_array(F.array_distinct(F.collect_list("pos"))).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_KEY_CHARS, salts: int = SALTS) -> DataFrame:
    """Each document with n_lines, n_dropped, keep_gaps and kept_text beside its own columns (own columns of these names are replaced).

    keep_gaps is the bitmap: the number of kept lines before the first dropped one, between each two, and after the last.
    A null text is one empty line, and its kept_text is empty; a text of any length is split whole; null ids count as one
    document that comes before all others; rows of one id are one document, and each gets its own bitmap, repeated rows equal
    ones; a line repeated within its first document stays there; an empty table gives an empty result. Other columns pass
    through, whatever their names.
    """
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, salts)
    id_, text = F.col(f"_row.{quoted(id_col)}"), F.col(f"_row.{quoted(text_col)}")
    own = boxed(docs).withColumns({"_id": id_, "_hash": F.xxhash64(text)})
    met = own.join(maps, own["_id"].eqNullSafe(maps["doc"]) & (own["_hash"] == maps["text_hash"]), "left").drop("_id", "_hash", "doc", "text_hash")
    met = met.withColumn("lines", lines_of(text))
    met = met.withColumns({"n_lines": F.size("lines").cast("long"), "n_dropped": F.coalesce(F.size("dropped"), F.lit(0)).cast("long"), "ends": F.concat(F.coalesce("dropped", F.array().cast("array<int>")), F.array(F.size("lines")))})
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(F.col("ends"), k - 1))
    met = met.withColumn("keep_gaps", F.transform("ends", lambda end, k: end - before(k) - 1))
    kept = F.flatten(F.transform("ends", lambda end, k: F.slice(F.col("lines"), before(k) + 2, end - before(k) - 1)))
    kept = F.when(F.col("n_dropped") == 0, F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return unboxed(met.withColumn("kept_text", kept), docs.columns, "n_lines", "n_dropped", "keep_gaps", "kept_text")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), "keep_gaps")


OP1_SQL = """
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
d AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, d.first_doc IS NOT NULL AND d.first_doc <> k.doc_id AS gone FROM k LEFT JOIN d USING (key)),
g AS (SELECT doc_id, pos, line, gone, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS kept_before FROM m),
ends AS (
  SELECT doc_id, pos, kept_before - coalesce(lag(kept_before) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS gap
  FROM (SELECT doc_id, pos, kept_before FROM g WHERE gone UNION ALL SELECT doc_id, max(pos) + 1, max(kept_before) FROM g GROUP BY doc_id)),
gaps AS (SELECT doc_id, list(CAST(gap AS INTEGER) ORDER BY pos) AS keep_gaps FROM ends GROUP BY doc_id)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256, any_value(keep_gaps) AS keep_gaps
FROM m JOIN gaps USING (doc_id) GROUP BY doc_id
"""
