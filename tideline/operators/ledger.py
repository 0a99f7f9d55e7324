"""Budgets that requests are reserved against before they are sent: an ordered fold in which a refused request takes nothing.

A request names its ledger, a digest of what is asked, the cost to reserve and, once known, what it was charged. In the order
of a ledger's requests:

- a digest that was reserved before is ``cached``: it costs nothing and is no attempt;
- else, if the ledger has fewer attempts than ``calls`` and what is used, with this cost, stays within ``cap``, it is
  ``reserved``: it becomes the next attempt, and uses what it was charged, or its cost while that isn't known;
- else it is ``refused`` and nothing changes, so a cheaper request after it may still pass.

No running sum can say this, as what a row uses depends on which rows before it passed. In batch, a ledger's requests pass one
task as a sorted stream; on a stream of requests, the same fold keeps its state between micro-batches. Either holds at most
``calls`` digests a ledger in memory, however many requests there are; the stream also holds what one micro-batch brings for a
ledger, which the source's limits bound.

Amounts are whole numbers of a small unit. A null cost is refused, a null digest is never cached; ties of the order are
broken by the digest, then the cost. Requests with a null ledger share one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "status string, attempt long, used long"


class Ledger:
    """What one ledger has used, and the digests that were reserved."""

    def __init__(self, cap: int, calls: int, used: int = 0, seen: dict | None = None):
        self.cap, self.calls, self.used, self.seen = cap, calls, used, {} if seen is None else seen

    def offer(self, request: str | None, cost: int | None, charged: int | None) -> tuple[str, int | None]:
        """(status, number of the attempt, of the first one if cached)."""
        if request is not None and request in self.seen:
            return "cached", self.seen[request]
        if cost is None or len(self.seen) >= self.calls or self.used + cost > self.cap:
            return "refused", None
        attempt = len(self.seen)
        self.seen[request if request is not None else ("", attempt)] = attempt
        self.used += cost if charged is None else charged
        return "reserved", attempt


def reservations(requests: DataFrame, ledger: str, order: list[str], request: str, cost: str, charged: str, cap: int, calls: int) -> DataFrame:
    """The requests with status, attempt (from 0) and what the ledger has used after them."""
    import pyarrow as pa

    names = requests.columns
    rows = requests.repartition(F.col(ledger)).sortWithinPartitions(ledger, *order, request, cost)
    place = {n: names.index(n) for n in (ledger, request, cost, charged)}

    def run(batches: Iterator) -> Iterator:
        now, own = object(), Ledger(cap, calls)
        for batch in batches:
            status, attempt, used = [], [], []
            for name, *asked in zip(*(batch.column(place[n]).to_pylist() for n in (ledger, request, cost, charged)), strict=True):
                if name != now:
                    now, own = name, Ledger(cap, calls)
                s, a = own.offer(*asked)
                status.append(s)
                attempt.append(a)
                used.append(own.used)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(status, pa.string()), pa.array(attempt, pa.int64()), pa.array(used, pa.int64())], [*names, "status", "attempt", "used"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return rows.mapInArrow(run, f"{kinds}, {OUT}")


class _Processor(StatefulProcessor):
    """The fold of one ledger over micro-batches: what is used, and the digests with their attempts."""

    def __init__(self, order: list[str], asked: list[str], cap: int, calls: int):
        self.order, self.asked, self.cap, self.calls = order, asked, cap, calls

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "used long")
        self.seen = handle.getMapState("seen", "request string", "attempt long")
        self.unnamed = handle.getValueState("unnamed", "attempts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        frame = pd.concat(list(rows))
        frame = frame.sort_values([*self.order, *self.asked[:2]], kind="stable").reset_index(drop=True)
        known = {k[0]: v[0] for k, v in self.seen.iterator()}
        unnamed = self.unnamed.get()[0] if self.unnamed.exists() else 0
        known.update({("", -k - 1): -1 for k in range(unnamed)})
        before = set(known)
        own = Ledger(self.cap, self.calls, self.used.get()[0] if self.used.exists() else 0, known)
        out = []
        for asked in frame[self.asked].itertuples(index=False):
            out.append((*own.offer(*(None if pd.isna(x) else x for x in asked)), own.used))
        for request, attempt in own.seen.items():
            if request not in before:
                if isinstance(request, str):
                    self.seen.updateValue((request,), (attempt,))
                else:
                    unnamed += 1
        self.unnamed.update((unnamed,))
        self.used.update((int(own.used),))
        frame["status"], frame["attempt"], frame["used"] = (pd.Series(x, dtype=t) for x, t in zip(zip(*out, strict=True), ("object", "Int64", "int64"), strict=True))
        yield frame

    def close(self) -> None:
        pass


def reserved_stream(requests: DataFrame, ledger: str, order: list[str], request: str, cost: str, charged: str, cap: int, calls: int) -> DataFrame:
    """The same on a stream of requests, in the order of micro-batches, and in ``order`` within each. The session needs a
    state store provider with several states a key (``spark.sql.streaming.stateStore.providerClass``)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    processor = _Processor(order, [request, cost, charged], cap, calls)
    return requests.groupBy(ledger).transformWithStateInPandas(processor, f"{kinds}, {OUT}", "append", "none")
