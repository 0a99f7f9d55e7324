"""Releases: tables written to a staging folder, a manifest of all files with a hash tree over it, and one atomic publish.

A release is a folder with its tables and ``freeze``: the manifest (name, bytes, sha256 of every file) and one row with the
release id, counts and stated facts. It appears by a single rename that fails if the folder exists, so there is a whole release or
none; what a crash leaves is a staging folder that nothing reads, and a failed run deletes its own.

Names in the manifest are paths under the folder, without what writers put at random into file names. The release id is
the root of a hash tree: leaves are sha256(name, digest); nodes, named by leading hexadecimal digits of the names' hashes,
hash their children in order, 16 at most above the leaves, so that no task sees the whole manifest. A file is hashed as a stream,
by one task, whatever its size; only a single line must be one value.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import checks
from tideline.sources.records import Rejected, exists
from tideline.sources.shared import delete, filesystem, settled

#: Leaves under one node of the lowest level, about.
LEAVES = 64
#: Statuses that a source manifest may state (fixed values).
DOWNLOADED, ABSENT = "downloaded", "absent_at_source"


def _absolute(spark: SparkSession, folder: str) -> str:
    system, target = filesystem(spark, folder.rstrip("/"))
    return system.makeQualified(target).toUri().getPath()


def line_digests(rows: DataFrame) -> DataFrame:
    """(at, sha256) of files from their lines (at, size, line), which lie together and in order in a partition; no file is one value.

    Who reads lines drops a byte order mark before the first, and the end of the last isn't told; the size in bytes tells both.
    Where it is null, there is no mark and each line is ended."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        at = None
        for batch in batches:
            names, start = pc.run_end_encode(batch.column(0)), 0
            for name, end in zip(names.values.to_pylist(), names.run_ends.to_pylist(), strict=True):
                if name != at:
                    if at is not None:
                        yield told(at, size, n, own)
                    at, size, n, own = name, batch.column(1)[start].as_py(), 0, (hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf"))
                lines = batch.column(2).slice(start, end - start)
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), pa.scalar(b"\n", lines.type))[0].as_buffer()
                for h in own:
                    h.update(b"\n" * (n > 0))
                    h.update(text)
                n, start = n + text.size + 1, end
        if at is not None:
            yield told(at, size, n, own)

    def told(at, size, n, own):
        """``n``: the bytes if each line is ended and there is no mark."""
        rest = 0 if size is None else size - n
        if rest not in (-1, 0, 2, 3):
            raise ValueError(f"{at} has {size} bytes, its lines {n}")
        found = own[rest >= 2]
        if rest in (0, 3):
            found.update(b"\n")
        return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([found.hexdigest()])], ["at", "sha256"])

    return rows.select("at", F.col("size").cast("long"), F.col("line").cast("binary")).mapInArrow(run, "at string, sha256 string")


def files(spark: SparkSession, folder: str, without: str = "freeze") -> DataFrame:
    """(name, bytes, sha256) of the files under a folder, of any size; the folder ``without`` is left out, and so are
    empty files, which Spark doesn't list. The bytes are read as lines."""
    root = _absolute(spark, folder)
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    # a path may have a scheme and a host before the folder
    inside = F.substring("path", F.locate(f"{root}/", F.col("path")) + len(root) + 1, 1 << 20)
    name = F.regexp_replace(inside, r"part-(\d{5})-[0-9a-f-]{36}(?:-c\d+|\.c\d+)*", "part-$1")
    kind = lambda c: F.regexp_extract(c, r"\.[A-Za-z0-9]+$", 0)
    there = own.select(name.alias("name"), F.col("length").alias("bytes"), F.col("_metadata.file_path").alias("at"), kind("path").alias("kind")).where(~F.startswith("name", F.lit(f"{without}/")))
    found = spark.createDataFrame([], "at string, sha256 string")
    codec = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    for (one,) in there.select("kind").distinct().collect():  # endings of names
        # the pass-through codec keeps files of this ending as they are, compressed or not, and whole in a partition
        text = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").option("io.compression.codecs", codec.CLASSNAME).option(codec.OPT_EXTENSION, one or codec.DEFAULT_EXTENSION).text(folder)
        lines = text.where(kind("_metadata.file_name") == one).select(F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("k"))
        found = found.union(line_digests(lines if one else lines.repartition("at").sortWithinPartitions("at", "start", "k")))
    bare = F.sha2(F.when(F.col("bytes") == 3, F.lit(b"\xef\xbb\xbf")), 256)  # of a mark alone there is no line
    return settled(there.join(found, "at", "left").select("name", "bytes", F.coalesce("sha256", bare).alias("sha256")), "files")


def release_id(manifest: DataFrame) -> str:
    """The root of the hash tree over (name, sha256); that of no files is the hash of nothing."""
    leaf = F.sha2(F.concat_ws("\0", "name", "sha256"), 256)
    rows = manifest.select(F.sha2("name", 256).alias("at"), leaf.alias("node"))
    depth = 0
    while LEAVES << (4 * depth) < manifest.count():
        depth += 1
    for level in range(depth, -1, -1):
        rows = rows.groupBy(F.substring("at", 1, level).alias("at")).agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(F.col("at").alias("k"), "node"))), lambda x: x["node"])), 256).alias("node"))
    found = rows.first()
    return found["node"] if found else hashlib.sha256().hexdigest()


def write_lines(spark: SparkSession, rows: DataFrame, path: str, parts: list[str], order: list[str], kind: str = "text") -> None:
    """One sorted file for each value of ``parts``, in folders named by them, under the same name wherever its task ran; columns of
    ``order`` that begin with _ aren't written."""
    rows = rows.repartition(*parts).sortWithinPartitions(*parts, *order).drop(*[c for c in order if c.startswith("_")])
    rows.write.partitionBy(*parts).option("ignoreNullFields", False).format(kind).save(path)
    system, folder = filesystem(spark, path)
    found = system.listFiles(folder, True)  # as many as there are values
    while found.hasNext():
        file = found.next().getPath()
        if (name := file.getName()).startswith("part-"):
            target = spark._jvm.org.apache.hadoop.fs.Path(file.getParent(), re.sub(r"^part-\d{5}", "part-00000", name))
            if name != target.getName() and not system.rename(file, target):
                raise OSError(f"{file} can't be renamed")


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], facts: dict | None = None, by: dict[str, list[str]] | None = None, order: dict[str, list[str]] | None = None) -> DataFrame:
    """Writes a release and returns its manifest. Each table becomes lines of JSON, or of text if it has but one column, a text, besides
    those in ``by``, whose values name its folders (a file each, part-00000); ``order`` sorts the lines of a file."""
    if exists(spark, folder):
        raise Rejected(f"{folder} exists; choose a new version")
    staging = f"{folder.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            parts, keys = (by or {}).get(name, []), (order or {}).get(name, [])
            lines = df.drop(*[c for c in keys if c.startswith("_")])
            kind = "text" if [lines.schema[c].dataType.simpleString() for c in lines.columns if c not in parts] == ["string"] else "json"
            if parts:
                write_lines(spark, df, f"{staging}/{name}", parts, keys, kind)
                continue
            if keys:
                lines = df.sortWithinPartitions(*keys).drop(*[c for c in keys if c.startswith("_")])
            lines.write.option("ignoreNullFields", False).format(kind).save(f"{staging}/{name}")
        manifest = files(spark, staging)
        manifest.write.json(f"{staging}/freeze/files")
        stored = spark.read.schema(manifest.schema).json(f"{staging}/freeze/files")
        n, size = stored.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        row = (release_id(stored), n, size, json.dumps(facts or {}, sort_keys=True, allow_nan=False))
        spark.createDataFrame([row], "release_id string, files long, bytes long, facts string").coalesce(1).write.json(f"{staging}/freeze/release")
        _rename(spark, staging, folder)
    except BaseException:
        delete(spark, staging)
        raise
    return frozen(spark, folder)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """Atomic, and fails if the target exists."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    (_, a), (_, b) = filesystem(spark, source), filesystem(spark, target)
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(option, 1)
    options[0] = option.NONE
    system, _ = filesystem(spark, source)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(a, b, options)


def frozen(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest that a release states."""
    return spark.read.schema("name string, bytes long, sha256 string").json(f"{folder}/freeze/files")


def violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (rule, key, detail) for files that are changed, missing, surplus or there twice, and for a manifest that isn't the
    one the release id names."""
    if not exists(spark, f"{folder}/freeze/release"):
        raise Rejected(f"{folder} is no release")
    stated, there = frozen(spark, folder), files(spark, folder)
    both = stated.select("name", F.col("sha256").alias("x"), F.lit(1).alias("l")).join(there.select("name", F.col("sha256").alias("y"), F.lit(1).alias("r")), "name", "full_outer")
    rule = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "surplus").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    out = both.select(rule.alias("rule"), F.col("name").alias("key"), F.coalesce("y", F.lit("none")).alias("detail")).where("rule IS NOT NULL")
    said = spark.read.schema("release_id string, facts string").json(f"{folder}/freeze/release")
    root = checks.holds(said, "release id", ["release_id"], F.col("release_id") == release_id(stated), F.col("release_id"))
    return out.unionByName(checks.duplicates(there, ["name"])).unionByName(root)


def source_violations(spark: SparkSession, manifest: DataFrame, folder: str, expected: DataFrame, origin: str) -> DataFrame:
    """What a manifest of sources (path, status, url, sha256) breaks: other statuses, paths that leave the folder, addresses of
    another origin, files that are changed or absent, or there though stated as absent, and another inventory than ``expected`` (path)."""
    there = files(spark, folder).select(F.col("name").alias("path"), F.col("sha256").alias("found"))
    both = manifest.join(there, "path", "left")
    got, gone = F.col("status") == DOWNLOADED, F.col("status") == ABSENT
    safe = ~F.startswith("path", F.lit("/")) & ~F.array_contains(F.split("path", "/"), "..")
    rows = lambda rule, condition, detail: checks.holds(both, rule, ["path"], condition, F.coalesce(F.col(detail).cast("string"), F.lit("none")))
    return reduce(DataFrame.unionByName, [
        rows("status", got | gone, "status"), rows("path", safe, "path"), rows("origin", ~got | F.startswith("url", F.lit(origin)), "url"),
        rows("changed", ~got | F.col("found").isNull() | (F.col("found") == F.col("sha256")), "found"), rows("absent", ~got | F.col("found").isNotNull(), "found"),
        rows("present", ~gone | F.col("found").isNull(), "found"),
        checks.missing(manifest, expected, ["path"]), checks.unexpected(manifest, expected, ["path"]), checks.duplicates(manifest, ["path"]),
    ])
