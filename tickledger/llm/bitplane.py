"""Centroid clustering of 64-component vectors on packed bit planes.

A component x becomes the integer floor(scale * x). Bit i of all 64 components of a vector, in two's complement,
is packed into one 64-bit word: the vector's plane i, of weight 2^i (the topmost plane: -2^i). The dot product of two
vectors is then exact and needs no multiplication of components:

    x . c = sum over planes i of x and j of c:  weight i * weight j * popcount(x_i & c_j)

and the squared distance is x . x - 2 x . c + c . c. The sums behind new centroids come from the planes too: how many
members have a bit set at each position. A vector carries as many planes as its largest component needs; shorter
ones are extended by their topmost plane.

On Spark: one pass packs the table and writes it, one narrow pass per round adds up each task's members by
cluster (k rows a task), and only the k centroids, 64 integers each, ever come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickledger.workspace import pin

COMPONENTS = 64
#: With more planes than this, products of 64 components may pass 64 bits; such batches use unbounded integers.
NARROW_PLANES = 27
LARGEST = 2**63 - 1


@dataclass(frozen=True)
class Settings:
    """k centroids, `rounds` of assigning and averaging, components scaled by `scale`; `seed` draws the first centroids."""

    k: int = 8
    rounds: int = 10
    scale: int = 1024
    seed: int = 3


# ---------------------------------------------------------------- planes


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, exact also where it passes 64 bits."""
    with np.errstate(over="ignore"):
        made = np.floor(vectors * scale)
    if np.abs(made).max(initial=0) < 2.0**53:
        return made.astype(np.int64)
    return np.array([[math.floor(x * scale) if abs(x) < 2.0**40 else int(x) * scale for x in row] for row in vectors.tolist()], object)


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes (n, b) of integer rows (n, 64); b fits the largest of them and its sign."""
    top = max((int(v) if v >= 0 else ~int(v)).bit_length() for v in (values.max(), values.min())) + 1
    bits = np.stack([((values >> i) & 1).astype(bool) for i in range(top)], axis=1)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights(b: int, narrow: bool) -> np.ndarray:
    out = [1 << i for i in range(b - 1)] + [-(1 << (b - 1))]
    return np.array(out, np.int64 if narrow else object)


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of all vectors (n, bx) with one vector (bc,), both as planes."""
    narrow = max(x.shape[1], len(c)) <= NARROW_PLANES
    by_plane = np.zeros(x.shape, np.int64 if narrow else object)
    for plane, weight in zip(c, weights(len(c), narrow), strict=True):
        by_plane += np.bitwise_count(x & plane).astype(by_plane.dtype) * weight
    return by_plane @ weights(x.shape[1], narrow)


def norms(x: np.ndarray) -> np.ndarray:
    """Dot product of each vector with itself."""
    narrow = x.shape[1] <= NARROW_PLANES
    weight = weights(x.shape[1], narrow)
    by_plane = np.zeros(x.shape, weight.dtype)
    for i in range(x.shape[1]):
        by_plane += np.bitwise_count(x & x[:, i : i + 1]).astype(weight.dtype) * weight[i]
    return by_plane @ weight


def position_sums(x: np.ndarray) -> list[int]:
    """Sum of each of the 64 components over all vectors, from the bits set at each position of each plane."""
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8), axis=2, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64)
    return [sum(int(n) * int(w) for n, w in zip(counts[:, p], weights(x.shape[1], False), strict=True)) for p in range(COMPONENTS)]


def nearest(x: np.ndarray, centroids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of equals) and the squared distance to it."""
    own = norms(x)
    best, distance = np.zeros(len(x), np.int64), None
    for number, c in enumerate(centroids):
        d = own - 2 * dots(x, c) + norms(c[None, :])[0]
        if distance is None:
            distance = d
            continue
        closer = (d < distance).astype(bool)
        best[closer] = number
        distance = np.where(closer, d, distance)
    return best, distance


# ---------------------------------------------------------------- Spark


def usable(vector: Column) -> Column:
    """Exactly 64 components, none of them null or non-finite."""
    unusable = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return F.coalesce((F.size(vector) == COMPONENTS) & ~unusable, F.lit(False))


def _unpacked(batch: pa.RecordBatch) -> np.ndarray:
    """Planes (n, b) of a batch's `planes`, all with as many as the longest."""
    held = [np.frombuffer(p, "<u8") for p in batch.column("planes").to_pylist()]
    b = max(map(len, held))
    if all(len(p) == b for p in held):
        return np.stack(held)
    return np.stack([np.concatenate([p, np.full(b - len(p), p[-1])]) for p in held])


def packed(vectors: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """`key, planes` of the usable rows: planes as little-endian 64-bit words, as many as the row needs."""
    doubles = F.col(vector).cast("array<double>")
    plain = vectors.select(vectors[key].alias("key"), vectors[vector].alias(vector)).where(usable(doubles)).select("key", doubles.alias("value"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = scaled(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS), scale)
            small = values.dtype != object
            planes = planes_of(values) if small else None
            made = [p.tobytes() for p in planes] if small else [planes_of(values[i : i + 1])[0].tobytes() for i in range(len(values))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["key", "planes"])

    return plain.mapInArrow(run, f"key {plain.schema['key'].dataType.simpleString()}, planes binary")


def _first_centroids(table: DataFrame, settings: Settings) -> list[list[int]]:
    """The vectors with the smallest hashes of `seed:key`; equal keys by their planes, null keys last."""
    drawn = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("key").cast("string")), 256)
    rows = table.orderBy(drawn.asc_nulls_last(), "planes").select("planes").limit(settings.k).collect()
    return [position_sums(np.frombuffer(r["planes"], "<u8")[None, :]) for r in rows]


def _moved(table: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floor(sum / count) of their members, as they were where they have none."""
    planes = [planes_of(np.array([c], object))[0] for c in centroids]

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = [0] * len(planes), [[0] * COMPONENTS for _ in planes]
        for batch in batches:
            if batch.num_rows:
                x = _unpacked(batch)
                cluster, _ = nearest(x, planes)
                for c in np.unique(cluster).tolist():
                    members = x[cluster == c]
                    count[c] += len(members)
                    sums[c] = [a + b for a, b in zip(sums[c], position_sums(members), strict=True)]
        yield _rows(count, sums)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = [0] * len(planes), [[0] * COMPONENTS for _ in planes]
        for batch in batches:
            for row in batch.to_pylist():
                count[row["cluster"]] += row["n"]
                sums[row["cluster"]] = [a + int(b) for a, b in zip(sums[row["cluster"]], row["sums"], strict=True)]
        yield _rows(count, sums)

    form = "cluster int, n long, sums array<string>"
    found = table.mapInArrow(tally, form).repartition(len(planes), "cluster").mapInArrow(add, form)
    out = list(centroids)
    for row in found.collect():
        out[row["cluster"]] = [int(s) // row["n"] for s in row["sums"]]
    return out


def _rows(count: list[int], sums: list[list[int]]) -> pa.RecordBatch:
    held = [c for c, n in enumerate(count) if n]
    columns = [
        pa.array(held, pa.int32()),
        pa.array([count[c] for c in held], pa.int64()),
        pa.array([[str(s) for s in sums[c]] for c in held], pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums"])


def clustered(vectors: DataFrame, settings: Settings = Settings(), key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """`key, cluster, distance` of each usable row, and the final centroids.

    Rows whose vector is null, has not 64 components or holds a null or non-finite one take no part. Repeated
    rows count each for itself; null keys are drawn last as first centroids. With fewer rows than k there are as many
    clusters as rows, an empty table gives no rows. A distance beyond a long is given as the largest long. Other
    columns are not read.
    """
    table = pin(packed(vectors, settings.scale, key, vector), "bit-planes")
    centroids = _first_centroids(table, settings)
    for _ in range(settings.rounds if centroids else 0):
        moved = _moved(table, centroids)
        if moved == centroids:
            break  # no later round can differ
        centroids = moved
    planes = [planes_of(np.array([c], object))[0] for c in centroids]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = nearest(_unpacked(batch), planes)
                shown = pa.array([min(int(d), LARGEST) for d in distance], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(cluster, pa.int32()), shown], names=["key", "cluster", "distance"])

    kind = table.schema["key"].dataType.simpleString()
    return pin(table.mapInArrow(assign, f"key {kind}, cluster int, distance long").withColumnRenamed("key", key), "clusters"), centroids


def inertia(assigned: DataFrame) -> dict[int, int]:
    """Sum of the distances in each cluster (k numbers)."""
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    return {row["cluster"]: int(row["sum"]) for row in sums.collect()}
