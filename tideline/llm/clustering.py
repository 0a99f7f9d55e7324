"""Centroid clustering of integer vectors by Lloyd's rounds with exponion bounds.

Vectors with exactly ``size`` components, none null or non-finite, are kept; component x becomes floor(scale * x), as double.
All distances are exact squared integers; a vector belongs to the nearest centroid, to the smaller number if several are
equally near. A centroid becomes floor(sum / count) of its vectors, component by component; an empty one stays.

Each vector carries its cluster, an upper bound of its distance to that centroid and a lower bound of the distance to all
others. A round moves the bounds by how far centroids have moved. Where upper < lower, or upper < half the distance from
the centroid to its nearest other one, nothing is computed. Else the upper bound is made exact, and if that does not settle
it, only centroids in the ball around the current one are scanned, of radius twice the distance plus the distance to the
nearest other centroid: those of a prefix of a list sorted by distance between centroids. The radius is inclusive and all
comparisons that skip are strict, so equally near centroids are always seen. Upper bounds are rounded up, lower ones down.

Centroids (at most MOST of them) and the lists between them are all that is broadcast. Vectors never move between tasks:
each round writes them with their bounds to the shared folder, and sums are grouped with map-side totals into one row a cluster.

Cases: a component beyond +-``limit(size)`` (2^27 for 64 components) counts as that bound: then every squared distance fits in
a long. Inertias beyond a long count as its largest value. Fewer vectors than ``k``: as many centroids as vectors. A null id counts as empty text in the hash and
stays null; rows that repeat an id are vectors of their own, and where their hashes tie the smaller vector comes first. No
vectors: an empty result. Other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.frames import Settled, received, send

MOST, LONG = 1024, (1 << 63) - 1
#: Relative room for the rounding of square roots and of sums of bounds.
ROOM = 1e-12


def limit(size: int) -> int:
    """The largest component for which a squared distance of ``size`` components is at most 2^62."""
    return math.isqrt((1 << 62) // size) // 2


class Centroids:
    """Centroids as integers, their exact distances from one another, and how far each has moved."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at
        gaps = np.sqrt(np.array([squared(at, c) for c in at], dtype=np.float64).reshape(len(at), len(at)))
        self.order = np.argsort(gaps, axis=1, kind="stable")
        #: Rounded down: a centroid counts as in a ball if it may be.
        self.gaps = np.take_along_axis(gaps, self.order, axis=1) * (1 - ROOM)
        np.fill_diagonal(gaps, np.inf)
        self.nearest = gaps.min(axis=1, initial=np.inf)
        moved = np.zeros(len(at)) if before is None else np.sqrt(np.array([squared(a[None, :], b)[0] for a, b in zip(at, before, strict=True)], dtype=np.float64)) * (1 + ROOM)
        self.moved = moved
        #: For each centroid, how far any other one has moved.
        self.others = np.array([np.delete(moved, a).max(initial=0.0) for a in range(len(at))])


def squared(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one centroid."""
    gap = rows - centroid
    return np.einsum("ij,ij->i", gap, gap)


def first_assigned(rows: np.ndarray, cents: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper and lower bound of each row, by distances to all centroids."""
    best, second = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), np.inf)
    own = np.zeros(len(rows), dtype=np.int64)
    for c, centroid in enumerate(cents.at):
        d = squared(rows, centroid)
        less = d < best
        second = np.where(less, best if c else np.inf, np.minimum(second, d))
        own[less], best = c, np.minimum(best, d)
    return own, np.sqrt(best.astype(np.float64)) * (1 + ROOM), np.sqrt(second) * (1 - ROOM)


def reassigned(rows: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, cents: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the centroids have moved, and how many distances were computed."""
    own, upper, lower = own.copy(), (upper + cents.moved[own]) * (1 + ROOM), lower - cents.others[own]
    lower *= np.where(lower > 0, 1 - ROOM, 1 + ROOM)
    floor = np.maximum(lower, cents.nearest[own] / 2 * (1 - ROOM))
    loose = np.flatnonzero(~(upper < floor))
    computed = len(loose)
    if not computed:
        return own, upper, lower, 0
    exact = np.zeros(len(rows), dtype=np.int64)
    exact[loose] = squared(rows[loose], cents.at[own[loose]])
    upper[loose] = np.sqrt(exact[loose].astype(np.float64)) * (1 + ROOM)
    loose = loose[~(upper[loose] < floor[loose])]
    for a in np.unique(own[loose]):
        mine = loose[own[loose] == a]
        reach = np.searchsorted(cents.gaps[a], 2 * upper[mine] + cents.nearest[a], side="right")
        mine, reach = mine[np.argsort(-reach, kind="stable")], -np.sort(-reach)
        best, number = np.full(len(mine), np.iinfo(np.int64).max), np.full(len(mine), len(cents.at))
        second = np.full(len(mine), np.inf)
        for k in range(int(reach[0])):  # the first n rows reach the k-th nearest centroid
            n = int(np.searchsorted(-reach, -k, side="left"))
            c = int(cents.order[a, k])
            d = squared(rows[mine[:n]], cents.at[c])
            computed += n
            less = (d < best[:n]) | ((d == best[:n]) & (c < number[:n]))
            was = np.where(number[:n] < len(cents.at), best[:n].astype(np.float64), np.inf)
            second[:n] = np.where(less, was, np.minimum(second[:n], d))
            best[:n], number[:n] = np.where(less, d, best[:n]), np.where(less, c, number[:n])
        own[mine] = number
        upper[mine], lower[mine] = np.sqrt(best.astype(np.float64)) * (1 + ROOM), np.sqrt(second) * (1 - ROOM)
    return own, upper, lower, computed


def integer_vectors(df: DataFrame, vector: str, key: str, size: int, scale: int) -> DataFrame:
    """(vec_id, v) of the vectors that are kept."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(limit(size))), F.lit(-limit(size))).cast("long"))
    return df.where((F.size(vector) == size) & ~bad).select(F.col(key).alias("vec_id"), whole.alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    found = rows.orderBy(F.sha2(named.cast("binary"), 256), "v").limit(k).select("v").collect()  # k rows
    return np.array([r["v"] for r in found], dtype=np.int64)


def _assigned(state: DataFrame, cents: Centroids, size: int) -> DataFrame:
    """vec_id, v, cluster, upper, lower of the vectors; ``state`` has bounds of the round before, or none."""
    import pyarrow as pa

    sent = send(state.sparkSession, cents)

    def run(batches):
        cents = received(sent)
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(-1, size)
            if batch.num_columns == 2:
                own, upper, lower = first_assigned(rows, cents)
            else:
                own, upper, lower, _ = reassigned(rows, batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy(), batch.column(4).to_numpy(), cents)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower)], ["vec_id", "v", "cluster", "upper", "lower"])

    return state.mapInArrow(run, f"vec_id {state.schema['vec_id'].dataType.simpleString()}, v array<bigint>, cluster int, upper double, lower double")


def _moved(state: DataFrame, cents: Centroids, size: int, wide: bool) -> Centroids:
    """The centroids after the vectors' sums: one row a cluster comes to the driver."""
    kind = "decimal(38,0)" if wide else "long"
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast(kind)).alias(f"s{i}") for i in range(size)])
    at = cents.at.copy()
    for r in sums.collect():
        at[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]
    return Centroids(at, cents.at)


def clusters(df: DataFrame, vector: str = "embedding", key: str = "vec_id", size: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    if not 1 <= k <= MOST:
        raise ValueError(f"k must lie between 1 and {MOST}")
    spark = df.sparkSession
    state = Settled(integer_vectors(df, vector, key, size, scale), "vectors")
    total, largest = state.df.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x))))).first()
    cents = Centroids(first_centroids(state.df, k, seed).reshape(-1, size))
    for turn in range(rounds + 1):
        after = Settled(_assigned(state.df, cents, size), "assigned")
        state.drop()
        state = after
        if turn < rounds:
            cents = _moved(state.df, cents, size, wide=total * (largest or 0) > LONG)
    at = cents.at.tolist()
    known = [(c, x, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(at)]
    known = spark.createDataFrame(known, "cluster int, centroid array<bigint>, centroid_sha256 string")
    square = F.aggregate(F.zip_with("v", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    far = Settled(state.df.join(F.broadcast(known), "cluster").select("vec_id", "cluster", square.alias("distance"), "centroid_sha256"), "distances").df
    state.drop()
    sums = {r["cluster"]: int(r["s"]) for r in far.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a cluster
    inertia = spark.createDataFrame([(c, min(s, LONG)) for c, s in sums.items()], "cluster int, cluster_inertia long")
    inertia_of_all = F.lit(min(sum(sums.values()), LONG)).cast("long")
    return far.join(F.broadcast(inertia), "cluster").select(F.col("vec_id").alias(key), "cluster", "distance", "cluster_inertia", inertia_of_all.alias("inertia"), "centroid_sha256")
