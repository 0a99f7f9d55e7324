"""Readers and writers: explicit schemas, fail-fast scans, exclusive sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than half the cores is dealt out anew, since what follows is costly per row; a scan of
    many files or row groups stays as it is. Only the columns that are used later are moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


#: Rows that a task takes at most, on the average, of what is dealt out for sorting or grouping (fixed value).
PER_TASK = 500_000


def slots(*frames: DataFrame) -> int:
    """Partitions for the largest of the frames: their number grows with its rows, so that no task does. Frames that are dealt out
    by the same keys into the same number of them are joined and grouped by these keys where they lie."""
    return max([f.sparkSession.sparkContext.defaultParallelism for f in frames] + [-(-f.count() // PER_TASK) for f in frames])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, a broken line fails the scan."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Strict: missing, repeated or other headings and short or long rows fail; lenient: all columns as text."""
    if not strict:
        return spark.read.option("header", True).csv(path)
    head = spark.read.text(path).first()
    names = [c.strip().strip('"') for c in (head[0] if head else "").lstrip("\ufeff").split(",")]
    want = T.StructType.fromDDL(schema).fieldNames()
    if names != want:
        raise ValueError(f"headings {names} instead of {want}")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def write_json(spark: SparkSession, path: str, value: object, overwrite: bool = False) -> None:
    """One document of a small value, indented, in a file that every file system of the session can hold. NaN and infinite
    numbers raise ValueError, and so does a path that exists, unless it may be overwritten."""
    text = json.dumps(value, indent=2, ensure_ascii=False, allow_nan=False) + "\n"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not overwrite and system.exists(target):
        raise ValueError(f"{path} exists")
    out = system.create(target, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Nested cells are written as JSON in one cell."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    cells = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    df.select(cells).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def scan_logs(spark: SparkSession, folder: str, schema: str, name: str = "metadata.json", without: str = "archiv") -> DataFrame:
    """All files of one name under a folder, with their paths."""
    logs = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).json(folder)
    return logs.withColumn("path", F.col("_metadata.file_path")).where(~F.contains(F.lower("path"), F.lit(without)))


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small report table; pipes and line breaks are escaped."""
    cell = lambda x: "N/A" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")
    rows = [df.columns, ["---"] * len(df.columns), *[[cell(x) for x in r] for r in df.limit(limit).collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
