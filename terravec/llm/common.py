"""What several operators of this package share: tables, lineage cuts, tiles and components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravec.operators.graph import components
from terravec.operators.shared import cut, shared_dir

__all__ = ["ascii_lower", "boxed", "components", "cut", "dealt_to_tiles", "partitions", "shared_dir", "stored", "table", "tile_pairs", "unboxed", "unused", "words"]

#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def boxed(df: DataFrame) -> DataFrame:
    """df with all its columns in one struct _row, so that no column of an operator's own can clash with them."""
    return df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("_row"))


def unboxed(df: DataFrame, columns: list[str], *added: str) -> DataFrame:
    """The boxed columns and then added ones, which take the place of columns of their names."""
    names = {a.lower() for a in added}
    return df.select(*(F.col(f"_row.{quoted(c)}") for c in columns if c.lower() not in names), *added)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else untouched. Spark's lower() does just that on pure ASCII, and is far cheaper."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(text: Column) -> Column:
    """array<string> of the words [^\\x20\\x09-\\x0D]+; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tile_pairs(rows: DataFrame, cell: list[str], row_id: str, per_tile: int) -> DataFrame:
    """Deals the rows of each cell to tile pairs (tile_i <= tile_j), so that every two rows of a cell meet in exactly one pair of tiles.

    A cell of up to ``per_tile`` rows is one tile; a larger one is split by a hash of ``row_id`` into m tiles, and each row goes
    to its m pairs. So no task holds more than two tiles, however large a cell is. Adds tile, tile_i, tile_j.
    """
    sizes = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("cell_rows")).filter(F.col("cell_rows") > per_tile)
    return dealt_to_tiles(rows, sizes, cell, row_id, per_tile)


def dealt_to_tiles(rows: DataFrame, sizes: DataFrame, cell: list[str], row_id: str, per_tile: int) -> DataFrame:
    """The same by given sizes: (cell, cell_rows) of the cells that need several tiles; all others are one."""
    m = F.coalesce(F.ceil(F.col("cell_rows") / F.lit(per_tile)).cast("int"), F.lit(1))
    dealt = rows.join(sizes, cell, "left").withColumn("tiles", m).withColumn("tile", F.pmod(F.xxhash64(row_id), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    return dealt.select("*", other).withColumns({"tile_i": F.least("tile", "other"), "tile_j": F.greatest("tile", "other")}).drop("cell_rows", "tiles", "other")
