"""Readers and writers of points, places, vocabularies, reports and activations.

Paths are Spark paths; what exists is asked of Spark's file system, never of the local one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravec.functions.text import format_prompt
from terravec.operators.points import split_train_val_test


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_points(spark: SparkSession, path: str, id_col: str | None = None, lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """point_id (if id_col is given), lat, lon of a CSV file with a header; what is no number is null."""
    raw = spark.read.csv(path, header=True)
    ids = [F.col(id_col).alias("point_id")] if id_col else []
    return raw.select(*ids, F.col(lat_col).try_cast("double").alias("lat"), F.col(lon_col).try_cast("double").alias("lon"))


def read_places(spark: SparkSession, root: str) -> DataFrame:
    """place, id, lon, lat of root/<place>/index.csv, by place."""
    raw = spark.read.csv(f"{root}/*/index.csv", header=True, schema="id string, lon double, lat double")
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/index\.csv$", 1).alias("place"), "id", "lon", "lat").orderBy("place", "id")


def read_geotext(spark: SparkSession, root: str, split: str, val_fraction: float = 0.1, test_fraction: float = 0.1) -> DataFrame:
    """root/<split>.parquet, else .csv; else data.parquet or data.csv, split by a hash of its rows; else an error."""
    for name, read in ((f"{split}.parquet", spark.read.parquet), (f"{split}.csv", lambda p: spark.read.csv(p, header=True, inferSchema=True))):
        if exists(spark, f"{root}/{name}"):
            return read(f"{root}/{name}")
    for name, read in (("data.parquet", spark.read.parquet), ("data.csv", lambda p: spark.read.csv(p, header=True, inferSchema=True))):
        if exists(spark, f"{root}/{name}"):
            whole = read(f"{root}/{name}")
            keyed = whole.withColumn("_key", F.xxhash64(*whole.columns))
            return split_train_val_test(keyed, val_fraction, test_fraction, "_key").filter(F.col("split") == split).drop("_key", "split")
    raise FileNotFoundError(f"no {split} or data file in {root}")


def read_vocab(spark: SparkSession, path: str, size: int = 0) -> DataFrame:
    """(idx, concept): stripped lines in order; with a size only the last ``size`` lines. One file, read whole (a vocabulary)."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("idx", "concept"))
    lines = lines.select("idx", F.trim("concept").alias("concept"))
    if size <= 0:
        return lines
    n = lines.count()
    return lines.filter(F.col("idx") >= n - size).select((F.col("idx") - max(0, n - size)).alias("idx"), "concept")


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(concept_id, concept, prompt) of a JSON array of strings."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("concept_id", "concept"))
    return whole.withColumn("prompt", format_prompt(F.col("concept")))


REPORT = "l1_penalty double, n_samples bigint, mse double, cosine_sim double, mean_active_concepts double, mse_mean double, mse_std double, cosine_sim_mean double, cosine_sim_std double, mean_active_concepts_mean double, mean_active_concepts_std double"


def read_reports(spark: SparkSession, root: str, models: list[str], datasets: list[str], suffix: str = "") -> DataFrame:
    """model, dataset and metrics of root/<model>__<dataset><suffix>.json; an error names a pair that is missing."""
    raw = spark.read.json(f"{root}/*__*{suffix}.json", schema=REPORT, multiLine=True).withColumn("_name", F.col("_metadata.file_name"))
    name = r"^(.*?)__(.*)" + suffix.replace(".", r"\.") + r"\.json$"
    got = raw.select(F.regexp_extract("_name", name, 1).alias("model"), F.regexp_extract("_name", name, 2).alias("dataset"), *[c for c in raw.columns if c != "_name"])
    got = got.filter(F.col("model").isin(models) & F.col("dataset").isin(datasets))
    wanted = spark.createDataFrame([(m, ds) for m in models for ds in datasets], "model string, dataset string")
    missing = wanted.join(got, ["model", "dataset"], "left_anti").orderBy("model", "dataset").limit(1).collect()
    if missing:
        raise FileNotFoundError(f"no report of {missing[0]['model']} on {missing[0]['dataset']}")
    return got


def read_file_listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length); contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")


def activations_schema(n: int) -> str:
    return "filename string, lon double, lat double, " + ", ".join(f"act{i + 1} double" for i in range(n))


def read_activations(spark: SparkSession, path: str, n: int) -> DataFrame:
    return spark.read.csv(path, header=True, schema=activations_schema(n))


def write_points(df: DataFrame, path: str) -> None:
    df.select("lat", "lon").write.mode("overwrite").csv(path, header=True)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder for each value of split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_activations_wide(wide: DataFrame, path: str, n: int) -> None:
    """Header filename, lon, lat, act1 to actn; what is missing is zero."""
    have = set(wide.columns)
    acts = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) if (c := f"act{i + 1}") in have else F.lit(0.0).alias(c) for i in range(n)]
    wide.select("filename", "lon", "lat", *acts).write.mode("overwrite").csv(path, header=True)


def write_scores(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def one_file(spark: SparkSession, folder: str, path: str) -> None:
    """Moves the one part file of a folder to a path, and the folder away."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = src.getFileSystem(conf)
    parts = [f.getPath() for f in fs.listStatus(src) if f.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{len(parts)} part files in {folder}")
    fs.mkdirs(dst.getParent())
    fs.delete(dst, False)
    fs.rename(parts[0], dst)
    fs.delete(src, True)


def write_report(df: DataFrame, path: str) -> None:
    """A report of one row as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(f"{path}.parts")
    one_file(df.sparkSession, f"{path}.parts", path)


def write_places(df: DataFrame, root: str, places: list[str]) -> None:
    """root/<place>/index.csv (id, lon, lat) of each of a short list of places."""
    for place in places:
        folder = f"{root}/{place}/parts"
        df.filter(F.col("place") == place).select("id", "lon", "lat").coalesce(1).write.mode("overwrite").csv(folder, header=True)
        one_file(df.sparkSession, folder, f"{root}/{place}/index.csv")
