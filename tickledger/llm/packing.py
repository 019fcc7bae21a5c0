"""Packing of token pieces into sequences by vector best fit.

`pieces` cuts documents, `pack` places pieces. A sequence has three capacities: tokens, documents
and attention cost (the sum of squared lengths, what attention within documents costs). A piece goes
to an open sequence that can take it under every capacity, chosen by one of two rules:

* `norm`: the smallest weighted norm of what remains free afterwards;
* `dot`: the largest weighted dot product of the piece's needs and the free capacities.

Pieces are dealt out evenly to tasks of about `group` pieces and packed there from the longest to the
shortest, in groups where a task gets more. So a task's memory is bounded and each group leaves about one sequence half empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickledger.llm.base import rebatched
from tickledger.llm.bpe import BATCH_ROWS, Encoder, automaton
from tickledger.workspace import pin


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds; the defaults bind by tokens alone."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1 / 16, 1 / 16)
    rule: str = "norm"


PIECE_FIELDS = "piece int, start long, length long, ids_crc32 long"
#: Bytes of text per token, rather too few than too many, so that tasks get no more pieces than they should.
TOKEN_BYTES = 3


def pieces(docs: DataFrame, path: str, tokens: int = 2048, end_id: int = 0, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Tokenize whole texts, end each document with `end_id`, cut those longer than `tokens`.

    Returns the columns `keep`, `piece`, `start`, `length`, `ids_crc32` and, where asked for, `ids`
    (little-endian 32-bit). Every piece but the first of a cut document is full. A null or empty text is
    one piece of the end id alone; rows that repeat are separate documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton(path))
    carried = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text].alias("value"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Encoder(shared.value)
        for batch in rebatched(batches, BATCH_ROWS):
            of, cut = [], []
            texts = [value or "" for value in batch.column(1).to_pylist()]
            for i, coded in enumerate(tool.encode_all(texts)):
                ids = coded + end
                n = len(ids) // 4
                first = n % tokens or tokens
                for k, start in enumerate([0, *range(first, n, tokens)]):
                    part = ids[4 * start : 4 * (start + tokens if start else first)]
                    of.append(i)
                    cut.append((k, start, len(part) // 4, zlib.crc32(part), part))
            columns = [pa.array([x[c] for x in cut], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if with_ids:
                columns.append(pa.array([x[4] for x in cut], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int32())), *columns], names=["row", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    row_type = carried.schema["row"].dataType.simpleString()
    cut = carried.mapInArrow(run, f"row {row_type}, {PIECE_FIELDS}" + ", ids binary" * with_ids)
    return cut.select("row.*", *[c for c in cut.columns if c != "row"])


def expected(docs: DataFrame, tokens: int = 2048, text: str = "text") -> int:
    """About how many rows `pieces` gives, by the lengths of the texts: to deal them out, not to count them."""
    size = F.coalesce(F.octet_length(docs[text]), F.lit(0))
    return docs.agg(F.sum(1 + F.floor(size / (TOKEN_BYTES * tokens)))).first()[0] or 0


def pack(parts: DataFrame, capacity: Capacity = Capacity(), length: str = "length", group: int = 20_000, rows: int | None = None) -> DataFrame:
    """All columns of `parts` with `sequence_id` (unique, no meaning) and `offset` of each piece in its sequence.

    Pieces must not be longer than a sequence; null lengths are an error. An empty table gives no rows.
    Columns already named `sequence_id` or `offset` are replaced.

    With `rows`, about how many there are, they are dealt out as they are made and move once, which is all that is
    stored of them. Without it they are written and counted first; wide rows then take twice the disk.
    """
    if capacity.rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {capacity.rule}")
    table = parts.drop("sequence_id", "offset")
    if rows is None:
        table = pin(table, "pieces")
        rows = table.count()
    tasks = max(1, -(-rows // group))
    carried = table.repartition(tasks).select(F.struct(*[table[c] for c in table.columns]).alias("row"), F.col(length).cast("long").alias("value"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for taken in grouped(batches, group):
            sequence, offset = best_fit(taken.column("value").to_numpy(), capacity)
            out = pa.table([taken.column("row"), pa.array(sequence + first, pa.int64()), pa.array(offset, pa.int64())], names=["row", "sequence_id", "offset"])
            yield from out.to_batches(max_chunksize=1000)
            first += int(sequence.max()) + 1

    row_type = carried.schema["row"].dataType.simpleString()
    placed = carried.mapInArrow(run, f"row {row_type}, sequence_id long, offset long")
    return placed.select("row.*", "sequence_id", "offset")


def grouped(batches: Iterable[pa.RecordBatch], group: int) -> Iterator[pa.Table]:
    """All rows in groups of `group`; the last has a quarter of that to five quarters, or all where there are fewer."""
    held, n, most = [], 0, group + -(-group // 4)
    for batch in rebatched(batches, group):
        held.append(batch)
        n += batch.num_rows
        while n > most:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield rows.slice(0, group).combine_chunks()
            held, n = rows.slice(group).to_batches(), n - group
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, longest first, ties in the given order."""
    lengths = lengths.astype(np.int64)
    sizes = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.array(capacity.weights) / sizes**2
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free = np.empty((3, max(1, len(lengths))))
    number = np.empty(max(1, len(lengths)), np.int64)
    n_open = n_made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = np.array([lengths[i], 1, lengths[i] ** 2], float)
        if (need > sizes).any():
            raise ValueError(f"a piece of {lengths[i]} tokens fits into no sequence")
        left = free[:, :n_open] - need[:, None]
        fits = np.flatnonzero((left >= 0).all(axis=0))
        if len(fits):
            if capacity.rule == "norm":
                bin_ = fits[np.argmin(weights @ left[:, fits] ** 2)]
            else:
                bin_ = fits[np.argmax((weights * need) @ free[:, fits])]
        else:
            bin_ = n_open
            free[:, bin_], number[bin_] = sizes, n_made
            n_open, n_made = n_open + 1, n_made + 1
        sequence[i], offset[i] = number[bin_], capacity.tokens - free[0, bin_]
        free[:, bin_] -= need
        if free[:, bin_].min() < 1:  # nothing fits any more: the last open one takes its place
            n_open -= 1
            free[:, bin_], number[bin_] = free[:, n_open], number[n_open]
    return sequence, offset
