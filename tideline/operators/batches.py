"""Resumable work in batches: each batch is made once, failures are rows, and a run that was stopped goes on where it was.

Under ``root``, attempt k has a plan (the batches still to do, as files), a stream checkpoint, results by micro-batch, and a
mark that all of its plan was handled:

    root/plan/attempt=k   root/checkpoint/k   root/results/attempt=k/part=<micro-batch>   root/handled/k

- Batches are ``size`` items in the order of md5(seed, key). Those with an item whose last status isn't terminal are pending.
- A plan is read as a stream of files with ``availableNow``; a file holds whole batches of about ``per_file`` items, and each
  micro-batch takes ``files`` of them, or more where an attempt would have more than PARTS micro-batches: each has a fixed cost. Its batches are made side by side, each by one call of ``make``. What a micro-batch writes replaces what it may have
  written before, so one that is run again after a crash gives each item once. The stream's checkpoint knows which were handled.
- A call that raises, or answers with other keys than it was given (missing, repeated or unknown), gives its items a row with the status
  ``failed`` and the error; other batches go on. After all results are written, the run raises if any batch of the attempt
  failed; the next run makes those only, as a new attempt.
- The latest attempt of a key counts. If an input differs from the one that a stored result was made from, nothing is run.

An item with a null key is an error. Where no item is pending, nothing is run. ``make`` gets a pandas frame of one batch
(at most ``size`` rows) and returns one with the key and the output columns; an item is ``completed``, or
``empty_output`` if ``required`` (a text) is blank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators import checks, records
from tideline.sources.records import exists, require_none
from tideline.sources.shared import filesystem

TERMINAL = ("completed", "empty_output")
#: Micro-batches of an attempt, at most (fixed value).
PARTS = 16


class BatchesFailed(RuntimeError):
    """Some batches failed; all results are stored, and the same call makes the failed ones again."""


def numbered_batches(items: DataFrame, key: str, size: int, seed: str) -> DataFrame:
    """The items with batch and place, in a seeded order."""
    placed = records.numbered(items, [], seed, key)
    return placed.withColumn("batch", F.expr(f"place div {size}"))


class Run:
    """One folder of attempts over the same items."""

    def __init__(self, items: DataFrame, key: str, root: str, outputs: str, size: int = 4, seed: str = "batches", required: str | None = None, files: int = 8, per_file: int = 1000):
        self.spark, self.key, self.root, self.size, self.required, self.files, self.per_file = items.sparkSession, key, root.rstrip("/"), size, required, files, per_file
        self.outputs = T.StructType.fromDDL(outputs)
        inputs = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(items.columns)]
        self.items = numbered_batches(items.withColumn("input_sha256", F.sha2(F.concat_ws("\x1f", *inputs), 256)), key, size, seed)
        kind = items.schema[key].dataType
        self.schema = T.StructType([T.StructField(key, kind), T.StructField("batch", T.LongType()), T.StructField("input_sha256", T.StringType()), *self.outputs, T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])

    def attempts(self) -> list[int]:
        system, folder = filesystem(self.spark, f"{self.root}/plan")
        if not system.exists(folder):
            return []
        return sorted(int(f.getPath().getName().split("=")[1]) for f in system.listStatus(folder))

    def results(self) -> DataFrame:
        """The latest result of each key, with its attempt."""
        path = f"{self.root}/results"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], self.schema).withColumn("attempt", F.lit(0))
        # parts of a micro-batch that is being written again are whole or absent
        rows = self.spark.read.schema(T.StructType([*self.schema, T.StructField("attempt", T.IntegerType())])).option("basePath", path).parquet(path).drop("part")
        w = W.partitionBy(self.key).orderBy(F.desc("attempt"))
        return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")

    def pending(self) -> DataFrame:
        """The items of batches that aren't finished."""
        done = self.results().select(self.key, "status")
        both = self.items.join(done, self.key, "left")
        open_ = both.where(~F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False))).select("batch").distinct()
        return self.items.join(open_, "batch", "left_semi")

    def _checked(self) -> None:
        require_none(checks.holds(self.items, "key", [self.key], F.col(self.key).isNotNull(), F.col(self.key)).unionByName(checks.duplicates(self.items, [self.key])))
        old = self.results().select(self.key, F.col("input_sha256").alias("was")).join(self.items, self.key)
        require_none(checks.holds(old, "input changed", [self.key], F.col("was") == F.col("input_sha256"), F.col("was")))

    def _plan(self, attempt: int) -> int:
        """Writes the attempt's plan, whole batches a file; the number of its batches."""
        todo = self.pending()
        batches = todo.select("batch").distinct().count()
        if batches:
            files = min(batches, -(-batches * self.size // self.per_file))
            todo.repartition(files, "batch").write.mode("overwrite").parquet(f"{self.root}/plan/attempt={attempt}")
        return batches

    def _files(self, plan: str) -> int:
        """Files of a micro-batch."""
        system, folder = filesystem(self.spark, plan)
        written = sum(f.getPath().getName().startswith("part-") for f in system.listStatus(folder))
        return max(self.files, -(-written // PARTS))

    def _made(self, todo: DataFrame, make: Callable) -> DataFrame:
        key, names, required = self.key, [f.name for f in self.outputs], self.required
        order = [f.name for f in self.schema]

        def one(batch):
            import pandas as pd

            frame = batch[[key, "batch", "input_sha256"]].reset_index(drop=True)
            try:
                got = make(batch)
                if sorted(got[key]) != sorted(batch[key]):
                    raise ValueError("missing, repeated or unknown keys in the answer")
                frame = frame.merge(got[[key, *names]], on=key)
                blank = frame[required].fillna("").str.strip() == "" if required else pd.Series(False, frame.index)
                frame["status"], frame["error"] = blank.map({True: "empty_output", False: "completed"}), None
            except Exception as e:  # noqa: BLE001  whatever a call raises is a row; the others go on
                for n in names:
                    frame[n] = None
                frame["status"], frame["error"] = "failed", f"{type(e).__name__}: {e}"
            return frame[order]

        return todo.groupBy("batch").applyInPandas(one, self.schema)

    def resume(self, make: Callable, stop_after: int | None = None) -> DataFrame:
        """The results of all items, after what is pending was made. ``stop_after``: micro-batches after which the run ends as if
        it were killed (for tests)."""
        self._checked()
        last = (self.attempts() or [0])[-1]
        attempt = last
        if not last or exists(self.spark, f"{self.root}/handled/{last}"):
            attempt = last + 1
            if not self._plan(attempt):
                return self.results()
        elif not exists(self.spark, f"{self.root}/plan/attempt={last}/_SUCCESS"):
            self._plan(attempt)  # it was stopped while it was planning
        plan = f"{self.root}/plan/attempt={attempt}"
        stream = self.spark.readStream.schema(self.spark.read.parquet(plan).schema).option("maxFilesPerTrigger", self._files(plan)).parquet(plan)

        def handle(rows: DataFrame, part: int) -> None:
            if stop_after is not None and part >= stop_after:
                raise RuntimeError("stopped")
            self._made(rows, make).write.mode("overwrite").parquet(f"{self.root}/results/attempt={attempt}/part={part}")

        query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{self.root}/checkpoint/{attempt}").trigger(availableNow=True).start()
        query.awaitTermination()
        self.spark.createDataFrame([(attempt,)], "attempt int").write.mode("overwrite").parquet(f"{self.root}/handled/{attempt}")
        found = self.results()
        require_none(checks.missing(found, self.items, [self.key]))
        failed = found.where((F.col("attempt") == attempt) & (F.col("status") == "failed")).select("batch").distinct().count()
        if failed:
            raise BatchesFailed(f"{failed} batches of attempt {attempt} failed; all results are stored")
        return found
