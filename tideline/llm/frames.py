"""Reading tables, and cutting lineage through tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import copy
import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of ``documents`` that the operators here know; others pass through untouched.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir, deleted when the driver ends.

    Where the setting is missing, a local master gets a folder of its own; a cluster must name one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tideline-")
        context.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/tideline-{context.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(_delete, context._jvm, context._jsc.hadoopConfiguration(), path)
    return path


_FOLDERS: set[str] = set()


def _delete(jvm, configuration, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(configuration).delete(where, True)


def send(spark: SparkSession, value):
    """A broadcast of the value, pickled with the code of its classes, so executors need no repository on their path."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent):
    return pickle.loads(sent.value)


def text_hash(text: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def at_most(rows: DataFrame, place: F.Column, most: int, of: int) -> DataFrame:
    """About ``most`` different rows and no more, of ``of``: those whose ``place``, evenly spread over 32 bits, lies under a
    threshold. ``rows`` are narrow."""
    if of > most:
        rows = rows.where(place < F.lit(int((most - 5 * most**0.5) / of * (1 << 32))))
    return rows.distinct().limit(most)


class Settled:
    """A DataFrame written to the shared folder and read back: later jobs start from files that outlive executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; nothing may read ``df`` afterwards."""
        context = self.spark.sparkContext
        _delete(context._jvm, context._jsc.hadoopConfiguration(), self.path)


def unclashing(df: DataFrame, *names: str) -> list[str]:
    """The names, or others after them, that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hashed(*columns) -> F.Column:
    """First 32 bits of the md5 of the columns' text, joined by ``|``; nulls count as empty. SQL can say the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in columns])), 1, 8), 16, 10).cast("long")


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def buckets_for(rows: int, least: int, most: int, each: int = 50_000) -> int:
    """A power of two from ``least`` to ``most``: the buckets in which ``rows`` rows are about ``each``."""
    n = least
    while n < most and rows > n * each:
        n *= 2
    return n


class Spread:
    """Equi-joins whose left side has hot keys: rows of a key with more than a thousandth of all rows (so at most 1,000
    keys, which are broadcast) are dealt over parts by a salt, and the right side's row is copied to each part."""

    SHARE, LEAST = 1000, 256

    def __init__(self, df: DataFrame, keys: list[str], count: str | None = None):
        """``count``: the column of ``df`` with a key's number of rows, if they are counted already."""
        self.keys = keys
        counts = df.groupBy(*keys).agg(F.count("*").alias("rows_of_key")) if count is None else df.select(*keys, F.col(count).alias("rows_of_key"))
        total = (df.count() if count is None else df.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0])
        limit = max(self.LEAST, total // self.SHARE)
        hot = counts.where(F.col("rows_of_key") > limit).select(*keys, F.ceil(F.col("rows_of_key") / limit).cast("int").alias("parts"))
        # at most SHARE keys: a filter of a written table where they are counted already, else collected once
        if count is not None:
            self.hot = None if hot.isEmpty() else hot
            return
        rows = hot.collect()
        self.hot = df.sparkSession.createDataFrame(rows, hot.schema) if rows else None

    def named(self, key: str) -> Spread:
        """The same with its only key column under another name."""
        out = copy.copy(self)
        out.keys = [key]
        out.hot = None if self.hot is None else self.hot.withColumnRenamed(self.keys[0], key)
        return out

    def salted(self, df: DataFrame, tag: str) -> DataFrame:
        """``df`` with the part of each row, by the hash of its column ``tag``."""
        if self.hot is None:
            return df.withColumn("salt", F.lit(0))
        rows = df.join(F.broadcast(self.hot), self.keys, "left")
        return rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(tag), F.col("parts")).cast("int"), F.lit(0))).drop("parts")

    def copied(self, df: DataFrame) -> DataFrame:
        """``df`` with one row per part of its key."""
        if self.hot is None:
            return df.withColumn("salt", F.lit(0))
        rows = df.join(F.broadcast(self.hot), self.keys, "left")
        return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    def join(self, left: DataFrame, right: DataFrame, tag: str, how: str = "inner") -> DataFrame:
        if self.hot is None:
            return left.join(right, self.keys, how)
        return self.salted(left, tag).join(self.copied(right), [*self.keys, "salt"], how).drop("salt")
