"""A corpus from raw documents to packed sequences, in five stages; each works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Other columns, whatever
their names, pass through. Rows that share a doc_id and text stand or fall together, but for the near-duplicate stage, which
keeps one of them. Null and empty texts and empty tables go through every stage. SQL can't express the toxicity, SimHash and
packing stages, so there is no ORACLE_SQL; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravec.llm import line_dedup, packing, quality, simhash, toxicity
from terravec.llm.common import quoted, stored, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the flagging score of a model of all labelled rows.

    Null, empty and letterless texts stay; equal texts stand or fall together. A table without labelled rows loses nothing.
    """
    score = unused("_toxicity", docs.columns)
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, score_col=score).filter(F.col(score) < toxicity.FLAG_AT).drop(score)


def _among(docs: DataFrame, kept: DataFrame, keys: dict[str, str]) -> DataFrame:
    """The rows of docs whose hashes are those of a row of kept, by keys: columns of both that hold hashes (never null)."""
    right = kept.select(*(F.col(k).alias(f"{k}_kept") for k in keys.values())).distinct()
    same = F.lit(True)
    for left, k in keys.items():
        same = same & (docs[left] == right[f"{k}_kept"])
    return docs.join(right, same, "left_semi")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their language and source.

    Null and empty texts go, for they have too few words. Rows of equal doc_id, text, lang and source stand or fall together.
    """
    a, b = unused("_id", docs.columns), unused("_row", docs.columns)
    keyed = docs.withColumns({a: F.xxhash64("doc_id"), b: F.xxhash64("text", "lang", "source")})
    good = quality.judged(keyed.select("text", "lang", "source", F.col(a).alias("k1"), F.col(b).alias("k2")), keep=["k1", "k2"]).filter("kept")
    return _among(keyed, good, {a: "k1", b: "k2"}).drop(a, b)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one has; n_chars follows the text.

    A null text becomes an empty one. A document that loses all its lines stays, with an empty text.
    """
    own = docs.columns
    done = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(*(F.col(quoted(c)) for c in own)).alias("own")))
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}
    return done.select(*(new[c].alias(c) if c in new else F.col(f"own.{quoted(c)}") for c in own))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id.

    Of rows that repeat a doc_id and text one stays, the first by a hash of its other columns. Rows without a doc_id are never
    the smallest; where a group has no other, one of each text stays. Texts without a word are a group.
    """
    a, b, n = (unused(x, docs.columns) for x in ("_id", "_text", "_n"))
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    first = found.filter(F.col("doc").eqNullSafe(F.col("component"))).select(F.xxhash64("doc").alias("k1"), F.col("text_hash").alias("k2"))
    keyed = docs.withColumns({a: F.xxhash64("doc_id"), b: F.xxhash64("text")})
    others = [F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    of_row = Window.partitionBy(a, b).orderBy(F.xxhash64(*others) if others else F.lit(0))
    return _among(keyed, first, {a: "k1", b: "k2"}).withColumn(n, F.row_number().over(of_row)).filter(F.col(n) == 1).drop(a, b, n)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a null or empty text is one piece of the separator alone."""
    return packing.pack_documents(docs.select("doc_id", "text")).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("line_dedup", dedup_lines),
    ("simhash", drop_near_duplicates),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
