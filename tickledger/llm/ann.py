"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut into two halves, each quantised by its own k-means; a pair of centroids is a cell. A query
visits the cells in the order of the summed distance of its halves to the two centroids. Both
distances are sorted, so a heap yields the pairs in order without looking at all of them; the walk
ends when the visited cells hold the wanted share of the index, and enough entries for a whole result. All entries of those cells are reranked by
the exact inner product.

For inner products of vectors of unequal length each entry gets one more coordinate that brings all to the
largest length, and a query gets a zero there: then the largest inner product is the smallest distance.

The work is cut into blocks: entries of a few cells (a heavy cell makes several blocks) times a
bounded number of queries that visit them, so no task grows with a popular cell or vector. Equal vectors are
one entry with their smallest ids, as many as a result can hold.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickledger.workspace import pin

BLOCK_ENTRIES = 8192
BLOCK_QUERIES = 2048


@dataclass(frozen=True)
class Settings:
    """`centroids` for each half; `share` of the index that a query looks at; about `fitted` vectors train the centroids.

    A query looks at k + 1 entries at least, its own among them, whatever the share.

    The share fits vectors without structure, where near ones lie in cells of any distance; clustered ones reach the
    same recall with far less.
    """

    centroids: int = 32
    share: float = 0.7
    fitted: int = 20_000
    rounds: int = 12
    seed: int = 7


def usable(vector: Column) -> Column:
    """Not null, not all zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def centroids_of(sample: np.ndarray, settings: Settings) -> np.ndarray:
    """k-means of one half's sample, from k-means++ starts, deterministic."""
    random = np.random.default_rng(settings.seed)
    k = min(settings.centroids, len(np.unique(sample, axis=0)))
    centres = sample[:1].copy()
    nearest = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        chosen = sample[random.choice(len(sample), p=nearest / nearest.sum())]
        centres = np.vstack([centres, chosen])
        nearest = np.minimum(nearest, ((sample - chosen) ** 2).sum(axis=1))
    for _ in range(settings.rounds):
        cell = distances(sample, centres).argmin(axis=1)
        for c in range(k):
            if (own := cell == c).any():
                centres[c] = sample[own].mean(axis=0)
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres."""
    return np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1), 0)


def visited(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in the order of summed distance until they hold `wanted` entries; cells are row * columns + column."""
    order_a, order_b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[order_a].tolist(), second[order_b].tolist()
    columns = len(second)
    heap, out, held = [(a[0] + b[0], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(order_a[i]) * columns + int(order_b[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        if j + 1 < columns:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def search(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k nearest found for each row of `vectors` where `queries` holds.

    A query is no candidate of itself; ties go to the smaller id; fewer than k candidates give all. Null ids and
    vectors that are null, zero, or hold null or non-finite components take no part; rows that repeat id and
    vector count once. An empty table gives no rows. All vectors must have one length.
    """
    values = F.transform(vector, lambda x: x.cast("double"))
    good = vectors.where(F.col(key).isNotNull() & usable(F.col(vector)))
    rows = pin(good.select(F.col(key).cast("long").alias("id"), values.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).distinct(), "vectors")
    entries = pin(_entries(rows, k), "entries")
    facts = entries.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts[0]:
        return vectors.sparkSession.createDataFrame([], schema)
    n, largest, size = facts
    # a power of two that brings all components into [-1, 1]: exact, and no square passes the range of doubles
    scale = 2.0 ** max(-1022, min(1022, -math.frexp(largest)[1]))
    longest = entries.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x * scale) * (x * scale))))).first()[0]
    # the query's own entry is among those held
    wanted = max(int(np.ceil(settings.share * n)), min(n, k + 1))

    # a share of the hash range, so the sample holds about `fitted` vectors whatever the table's size
    drawn = entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(np.ceil((1 << 30) * min(1, settings.fitted / n)))).select("v").toArrow()
    fitted = _augmented(_matrix(drawn.column("v"), size) * scale, longest)
    fitted = fitted[np.lexsort(fitted.T)]
    half = (size + 1) // 2
    centres = centroids_of(fitted[:, :half], settings), centroids_of(fitted[:, half:], settings)

    placed = pin(entries.mapInArrow(_placing(centres, half, size, longest, scale), "ids array<long>, v array<double>, cell int"), "placed")
    counts = np.zeros(len(centres[0]) * len(centres[1]), np.int64)
    for cell, count in placed.groupBy("cell").count().collect():
        counts[cell] = count
    first_block, blocks_of = _blocks(counts)

    # a heavy cell's entries spread over its blocks by hash; small cells share a block
    block = F.get(F.lit(first_block.tolist()), F.col("cell")) + F.pmod(F.xxhash64("v"), F.get(F.lit(blocks_of.tolist()), F.col("cell"))).cast("int")
    index = placed.select(block.alias("block"), "cell", "ids", "v")

    asked = rows.where("asks").select("id", "v")
    probes = pin(asked.mapInArrow(_probing(centres, half, size, counts, wanted, first_block, blocks_of, scale), "block int, cells array<int>, id long, v array<double>"), "probes")
    parts = probes.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("parts"))
    # queries of a block are dealt to parts, its entries go to each part
    probed = probes.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    entered = index.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    near = (
        probed.select("block", "part", "cells", "id", "v")
        .groupBy("block", "part")
        .cogroup(entered.select("block", "part", "cell", "ids", "v").groupBy("block", "part"))
        .applyInPandas(_reranking(k, scale), "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """`ids, v`: each vector once with its k + 1 smallest ids; one more since a query skips itself.

    Ids beyond those cannot be in any result. They are cut before the shuffle, so a vector that fills a third of
    the table sends k + 1 rows per task.
    """
    smallest = Window.partitionBy("v").orderBy("id")
    few = rows.select("id", "v").withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("ids", "v")


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell, blocks of about BLOCK_ENTRIES entries."""
    first, number = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    block = held = 0
    for cell, count in enumerate(counts.tolist()):
        if held and held + count > BLOCK_ENTRIES:
            block, held = block + 1, 0
        first[cell], number[cell] = block, max(1, -(-count // BLOCK_ENTRIES))
        held += count
        if number[cell] > 1:
            block, held = block + int(number[cell]), 0
    return first, number


def _matrix(column, size: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != size * len(lists):
        raise ValueError("vectors have different lengths")
    return flat.reshape(-1, size)


def _augmented(points: np.ndarray, longest: float) -> np.ndarray:
    missing = np.sqrt(np.maximum(longest**2 - (points**2).sum(axis=1), 0))
    return np.hstack([points, missing[:, None]])


def _placing(centres, half: int, size: int, longest: float, scale: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _augmented(_matrix(batch.column("v"), size) * scale, longest)
            a = distances(points[:, :half], centres[0]).argmin(axis=1)
            b = distances(points[:, half:], centres[1]).argmin(axis=1)
            cell = pa.array((a * len(centres[1]) + b).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("v"), cell], names=["ids", "v", "cell"])

    return run


def _probing(centres, half: int, size: int, counts, wanted: int, first_block, blocks_of, scale: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                points = np.hstack([_matrix(batch.column("v"), size) * scale, np.zeros((batch.num_rows, 1))])
                first, second = distances(points[:, :half], centres[0]), distances(points[:, half:], centres[1])
                blocks, cells, rows = [], [], []
                for i in range(batch.num_rows):
                    by_block: dict[int, list[int]] = {}
                    for cell in visited(first[i], second[i], counts, wanted):
                        for b in range(first_block[cell], first_block[cell] + blocks_of[cell]):
                            by_block.setdefault(b, []).append(cell)
                    for b, own in by_block.items():
                        blocks.append(b)
                        cells.append(own)
                        rows.append(i)
                taken = pa.array(rows, pa.int32())
                columns = [pa.array(blocks, pa.int32()), pa.array(cells, pa.list_(pa.int32())), batch.column("id").take(taken), batch.column("v").take(taken)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "cells", "id", "v"])

    return run


def _reranking(k: int, scale: float):
    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(queries) and len(entries):
            asked, points = np.stack(queries["v"].to_numpy()), np.stack(entries["v"].to_numpy())
            cell_of = entries["cell"].to_numpy()
            order = np.argsort(cell_of, kind="stable")
            ids = entries["ids"].to_numpy()
            for start in range(0, len(asked), 256):
                scores = (asked[start : start + 256] * scale) @ (points * scale).T
                for i, row in enumerate(scores):
                    own = np.concatenate([order[slice(*np.searchsorted(cell_of[order], [c, c + 1]))] for c in queries["cells"].iloc[start + i]])
                    found = own[np.argpartition(-row[own], k)[: k + 1]] if len(own) > k + 1 else own
                    # scores equal to the last one kept may stand for smaller ids
                    found = own[row[own] >= row[found].min() - 1e-9] if len(own) > k + 1 else own
                    out.append(_exact(queries["id"].iloc[start + i], asked[start + i], points[found], ids[found], k))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    return run


def _exact(query_id: int, query: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of a few entries, scored one component after the other in double precision."""
    score = np.zeros(len(points))
    with np.errstate(over="ignore", invalid="ignore"):
        for c in range(points.shape[1]):
            score += query[c] * points[:, c]
    each = np.repeat(score, [len(x) for x in ids])
    all_ids = np.concatenate(ids)
    other = all_ids != query_id
    each, all_ids = each[other], all_ids[other]
    best = np.lexsort((all_ids, -each))[:k]
    return pd.DataFrame({"query_id": query_id, "vec_id": all_ids[best], "score": each[best]})
