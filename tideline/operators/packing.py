"""Batches under a ceiling in a given order (next fit), as a fold whose parts can be made apart and joined.

An item joins the open batch if the batch's size stays within the limit; else it opens a new one; an item above the
limit is a batch of its own. What a run of consecutive items does depends on one number, the size that is open before it. Up to
the first item that no longer fits, sizes only add up; from there on all is fixed. So a part of a scope is summed up as steps:
for each place where the open batch may end, the number of batches begun and the size left open. Places after which the same is
left open share a step, and few steps remain, as batches that begin at different places soon fall together.

1. Items are dealt out by ranges of (scope, order). Each part's steps are computed where it lies.
2. A scope's parts are joined in order: a sorted stream of steps, in constant memory, gives the size open before each part.
3. Each part numbers its items' batches from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.sources.shared import settled


def _ends(sizes, limit: int):
    """For each item that opens a batch: the batches begun from there on, and the size left open after the last item."""
    import numpy as np

    n, total = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    following = np.maximum(np.searchsorted(total, total[:-1] + limit, side="right") - 1, np.arange(n) + 1)
    begun, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(n - 1, -1, -1):
        j = following[k]
        begun[k], left[k] = (1, total[n] - total[k]) if j >= n else (1 + begun[j], left[j])
    return total, begun, left


def next_fit(df: DataFrame, scope: str, order: list[str], size: str, limit: int) -> DataFrame:
    """(scope, order, batch from 0). Order is unique in a scope; sizes are whole and not negative, and a null size counts as 0."""
    import numpy as np
    import pyarrow as pa

    rows = df.select(scope, *order, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    rows = rows.repartitionByRange(scope, *order).sortWithinPartitions(scope, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = settled(rows, "parts").withColumn("_part", F.shiftright("_at", 33).cast("long"))
    kind = df.schema[scope].dataType.simpleString()

    def steps(key, table):
        table = table.sort_by("_at")
        total, begun, left = _ends(table.column("_size").to_numpy(), limit)
        new = np.ones(len(begun), bool)
        new[:-1] = (begun[1:] != begun[:-1]) | (left[1:] != left[:-1])  # the last place of each step
        k = np.flatnonzero(new)
        # the batch that is open ends at item k if it can take what lies before it, but not the item
        out = {scope: pa.array([key[0].as_py()] * (len(k) + 1), table.schema.field(scope).type), "_part": np.full(len(k) + 1, key[1].as_py()), "before": np.append(total[k + 1], -1), "begun": np.append(begun[k], 0), "left": np.append(left[k], total[-1])}
        return pa.table(out)

    summed = rows.select(scope, "_part", "_at", "_size").groupBy(scope, "_part").applyInArrow(steps, f"{scope} {kind}, _part long, before long, begun long, left long")

    def join(batches):
        now, part, fill, done, best = object(), None, 0, 0, None
        for batch in batches:
            names, parts, fills, numbers = [], [], [], []
            for name, p, before, begun, left in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if name != now:
                    now, part, fill, done, best = name, None, 0, -1, None
                if p != part:
                    if best is not None:
                        fill, done = best
                    part, best = p, None
                    names.append(name)
                    parts.append(p)
                    fills.append(fill)
                    numbers.append(done)
                # steps come by falling ``before``; the last that the open batch can't take whole decides, -1 says that it takes all
                if before < 0:
                    if best is None:
                        best = (fill + left, done) if done >= 0 else (left, 0)
                elif done < 0 or fill + before > limit:
                    best = (left, done + begun)
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.column(0).type), pa.array(parts, pa.int64()), pa.array(fills, pa.int64()), pa.array(numbers, pa.int64())], [scope, "_part", "_fill", "_done"])

    ordered = summed.repartition(F.col(scope)).sortWithinPartitions(F.col(scope), "_part", F.desc("before"))
    # a part's row is written when its first step comes, with what the parts before left open
    entries = ordered.mapInArrow(join, f"{scope} {kind}, _part long, _fill long, _done long")
    both = rows.join(entries, [scope, "_part"])
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (scope, *order))

    def number(key, table):
        table = table.sort_by("_at")
        sizes, fill, batch = table.column("_size").to_pylist(), table.column("_fill")[0].as_py(), table.column("_done")[0].as_py()
        out = []
        for s in sizes:
            if batch < 0 or fill + s > limit:
                batch, fill = batch + 1, s
            else:
                fill += s
            out.append(batch)
        return table.select([scope, *order]).append_column("batch", pa.array(out, pa.int64()))

    return both.groupBy(scope, "_part").applyInArrow(number, f"{fields}, batch long")
