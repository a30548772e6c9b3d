"""Lloyd's k-means over integer vectors, exact to the last unit, with float32 products as a screen only.

A component x becomes the integer floor(scale * x). A round multiplies a block of vectors with all centroids in float32. The product's
rounding error has a proven bound (any order of summation, conversions included), so each approximate distance is the middle of
an interval that holds the exact one. Centroids whose interval begins beyond the least end are out; where one is left, it
is the nearest; where intervals overlap, the distances of those left are computed in integers and the least (distance, number)
wins. Distances that are returned are always computed in integers. Vectors whose integers pass LARGE, and those to which a centroid that passes it
may be the nearest, are compared with every centroid in Python's unbounded integers.

A round's sums leave a task as digits of base 2^32 for each centroid and component (so JVM sums of them can't overflow), are summed by
Spark, and only k x dimensions sums reach the driver: nothing that grows with the vectors is collected, broadcast or
shuffled.

Defined results: vectors that are null, of another length or with a null or non-finite component are left out; repeated ids are vectors
of their own; a null id hashes as the empty text; equal hashes at the start are ordered by the vectors' components; fewer vectors
than centroids give as many centroids as vectors; empty centroids stay where they are; an empty table gives no row; further columns are ignored.
A distance or a sum of distances that a long can't hold is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import cut

#: Integers up to this give squared distances and products that int64 holds, for up to 64 components.
LARGE = 1 << 27
#: Vectors of one matrix product.
BLOCK = 8192
DIGIT = 32
_LONG = (1 << 63) - 1
_U32 = 2.0**-24  # unit roundoff of float32


def kept(vectors: DataFrame, size: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, x (array of doubles) of the vectors with exactly `size` components, all of them finite."""
    x = F.col("x")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where((F.size(x) == size) & finite)


def whole(x: float, scale: int) -> int:
    """floor(scale * x) of a finite double, exactly."""
    return math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale


def integers(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(int64 integers of the rows that keep to LARGE, else zeros; which rows pass it). scale is a power of two, so that scale * x is exact."""
    with np.errstate(over="ignore"):
        floors = np.floor(x * float(scale))
    wide = (np.abs(floors) > LARGE).any(axis=1)
    return np.where(wide[:, None], 0.0, floors).astype(np.int64), wide


class Nearest:
    """Nearest centroids of vectors; ties go to the smaller number."""

    def __init__(self, centroids: list[list[int]]) -> None:
        self.exact = centroids
        fits = [all(abs(v) <= LARGE for v in c) for c in centroids]
        self.numbers = np.flatnonzero(fits)
        self.table = np.array([c for c, fit in zip(centroids, fits, strict=True) if fit], dtype=np.int64).reshape(len(self.numbers), len(centroids[0]))
        #: Of each centroid that passes LARGE, its largest component.
        self.far = [min(max(map(abs, c)), 1 << 500) for c, fit in zip(centroids, fits, strict=True) if not fit]
        self.table32 = self.table.astype(np.float32)
        # Squared lengths are integers below 2^63: one rounding each.
        self.square = (self.table**2).sum(axis=1).astype(np.float64)
        self.length = np.sqrt(self.square) * (1 + 1e-12)
        n = self.table.shape[1] + 2  # roundings on the way of any one product into the sum: two conversions, the product and all sums but one
        self.gamma = n * _U32 / (1 - n * _U32)
        self.recomputed = 0

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in table, squared distance) of the nearest for int64 rows within LARGE."""
        product = (rows.astype(np.float32) @ self.table32.T).astype(np.float64)
        length = np.sqrt((rows**2).sum(axis=1).astype(np.float64)) * (1 + 1e-12)
        # |v|^2 is left out: it is the same for all centroids. The second term covers the roundings of this float64 arithmetic.
        middle = self.square[None, :] - 2.0 * product
        error = 2.0 * self.gamma * length[:, None] * self.length[None, :] * (1 + 1e-9) + 4 * 2.0**-52 * (self.square[None, :] + 2.0 * np.abs(product))
        end = (middle + error).min(axis=1)
        left = middle - error <= end[:, None]
        best = left.argmax(axis=1)
        unsure = np.flatnonzero(left.sum(axis=1) > 1)
        self.recomputed += len(unsure)
        distance = ((rows - self.table[best]) ** 2).sum(axis=1)
        if len(unsure):
            at, number = np.nonzero(left[unsure])
            exact = ((rows[unsure[at]] - self.table[number]) ** 2).sum(axis=1)
            order = np.lexsort((number, exact, at))
            first = order[np.r_[True, np.diff(at[order]) != 0]]
            best[unsure], distance[unsure] = number[first], exact[first]
        return best, distance

    def of_wide(self, row: list[int]) -> tuple[int, int]:
        """(number, squared distance) for one row of unbounded integers."""
        distance, number = min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), j) for j, c in enumerate(self.exact))
        return number, distance

    def blocks(self, x: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, list[int]]], list[int]]]:
        """For each BLOCK of rows: (numbers, int64 rows with zeros for those that pass LARGE, the latter by place, distances as unbounded integers)."""
        for start in range(0, len(x), BLOCK):
            part = x[start : start + BLOCK]
            rows, wide = integers(part, scale)
            best, distance = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
            one_by_one = wide.copy()
            if len(self.numbers):
                place, distance = self.of(rows)
                best = self.numbers[place]
                # A centroid that passes LARGE is nearer only if its largest component is no farther than that.
                for reach in self.far:
                    least = np.maximum(float(reach) - np.abs(rows).max(axis=1), 0.0) * (1 - 1e-9)
                    one_by_one |= least <= np.sqrt(distance.astype(np.float64))
            else:
                one_by_one[:] = True
            exact, large = distance.tolist(), []
            for i in np.flatnonzero(one_by_one):
                values = [whole(v, scale) for v in part[i].tolist()]
                best[i], exact[i] = self.of_wide(values)
                if wide[i]:
                    large.append((int(i), values))
            yield best, rows, large, exact


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of an Arrow list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def digits(value: int) -> list[int]:
    """Digits of base 2^DIGIT, the least first; only the last may be negative."""
    found = []
    while not -(1 << DIGIT) <= value < 1 << DIGIT:
        found.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*found, value]


def _sums(rows: DataFrame, nearest: Nearest, size: int, scale: int) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """(vectors of each centroid, sum of each centroid's components)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            for best, ints, large, _ in nearest.blocks(matrix(batch.column(0), size), scale):
                counts = np.bincount(best, minlength=len(nearest.exact))
                for j in np.flatnonzero(counts):
                    total[int(j), -1] = total.get((int(j), -1), 0) + int(counts[j])
                    for at, v in enumerate(ints[best == j].sum(axis=0).tolist()):
                        total[int(j), at] = total.get((int(j), at), 0) + v
                for i, values in large:
                    for at, v in enumerate(values):
                        total[int(best[i]), at] = total.get((int(best[i]), at), 0) + v
        out = [(j, at, place, digit) for (j, at), v in total.items() for place, digit in enumerate(digits(v))]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["number", "at", "place", "digit"])

    counts: dict[int, int] = {}
    sums: dict[tuple[int, int], int] = {}
    for r in rows.select("x").mapInArrow(summed, "number int, at int, place int, digit long").groupBy("number", "at", "place").agg(F.sum("digit").alias("digit")).collect():
        if r["at"] < 0:
            counts[r["number"]] = counts.get(r["number"], 0) + (r["digit"] << DIGIT * r["place"])
        else:
            sums[r["number"], r["at"]] = sums.get((r["number"], r["at"]), 0) + (r["digit"] << DIGIT * r["place"])
    return counts, sums


def start(rows: DataFrame, k: int, scale: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:id`, in that order."""
    hashed = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("hash"), "x")
    return [[whole(v, scale) for v in r["x"]] for r in hashed.orderBy("hash", "x").limit(k).collect()]


def fit(rows: DataFrame, k: int, rounds: int, size: int, scale: int, seed: str) -> list[list[int]]:
    """Centroids after so many rounds over kept() rows."""
    centroids = start(rows, k, scale, seed)
    for _ in range(rounds if centroids else 0):
        counts, sums = _sums(rows, Nearest(centroids), size, scale)
        centroids = [[sums[j, at] // counts[j] for at in range(size)] if counts.get(j) else c for j, c in enumerate(centroids)]
    return centroids


def assign(rows: DataFrame, centroids: list[list[int]], size: int, scale: int) -> DataFrame:
    """id, cluster, distance of kept() rows."""
    nearest = Nearest(centroids) if centroids else None

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, distances = [], []
            for best, _, _, exact in nearest.blocks(matrix(batch.column(1), size), scale) if nearest else ():
                numbers += best.tolist()
                distances += [d if d <= _LONG else None for d in exact]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int32()), pa.array(distances, pa.int64())], ["id", "cluster", "distance"])

    return rows.mapInArrow(assigned, T.StructType([rows.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for every kept vector. scale must be a power of two, size at most 64."""
    if scale & (scale - 1) or not 0 < size <= 64:
        raise ValueError("scale must be a power of two and size at most 64")
    rows = kept(vectors, size, id_col, vector_col)
    centroids = fit(rows, k, rounds, size, scale, seed)
    found = cut(assign(rows, centroids, size, scale))
    # Sums of longs as decimals; null where a distance is null or the sum passes a long.
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(total.alias("total")).collect()}
    every = None if None in sums.values() else sum(map(int, sums.values()))
    known = [(j, None if sums[j] is None or sums[j] > _LONG else int(sums[j]), None if every is None or every > _LONG else every, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids) if j in sums]
    table = vectors.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
