"""Removal of byte strings that an earlier document holds already, by a sparse suffix array.

Each byte covered by a string of LENGTH bytes that also starts in a document with a smaller id goes. A suffix array over
all positions would move every suffix through a shuffle, so only anchors are sorted: of the 16-byte grams that start in
a window of LENGTH bytes the one with the least hash (the leftmost of equals) is the window's anchor. Equal windows have
equal anchors at equal places, so nothing is missed; about one position in 18 is an anchor, and it stands for the
run of windows that chose it.

1. Exact copies: of documents with one text only the smallest goes on, the others go as a whole.
2. Anchor hashes meet in buckets; those of a single document are dropped there.
3. The others come back to their texts and send the bytes around them, 34 to the left and 50 to the right.
4. Per bucket two suffix arrays are built, of the strings that begin at the anchors and of the reversed strings that end before them,
   by deep-shallow sorting: multikey quicksort on words of eight bytes down to a shallow depth, then a blind trie for each group that is still
   equal. The window that starts o bytes before an anchor equals another one's if the first share 50 - o bytes and
   the second o bytes; classes of both, cut from the arrays' common prefix lengths, give each window's smallest id.
5. Windows with a smaller id elsewhere are merged into spans, and spans cut from the texts.

Anchors in very many different documents (found in a bounded sample of documents, which moves them to another path and
changes no result) would fill one bucket. Their windows are compared by a 128-bit hash: batches of documents ask once for each different
window, so a window is asked for once per batch, however many documents hold it, and the smallest id comes back.

What shuffles and tables on the way take on disk is given up as soon as nothing reads it; blobs pass the shuffles compressed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickledger.llm.base import rebatched
from tickledger.llm.url_filter import filter_of, probe
from tickledger.workspace import pin, pin_alone, shuffles_dropped

LENGTH = 50
GRAM = 16
REACH = LENGTH - GRAM  # an anchor lies at most so far behind its window's start
WIDTH = REACH + LENGTH
#: Null ids count as larger than all others.
NO_ID = 2**63 - 1
#: Bytes that one numpy step works on, and anchors that a task gathers before it sends them.
STEP_BYTES = 1 << 18
#: Bits of a position within a step, of twice STEP_BYTES at most.
PLACE_BITS = 23
SENT_ANCHORS = 400_000
#: Anchors (or half as many contexts) in a row of a shuffle, so that no row is large for the JVM's heap.
ROW_ANCHORS = 4096
#: Entries of a bucket that are compared at a time; those of one hash stay together, however many they are.
SLICE = 16_384
BATCH_ROWS = 256
#: Words of eight bytes that the quicksort looks at before tries take over, also where so few strings are left.
SHALLOW_WORDS = 2
SMALL = 32


@dataclass(frozen=True)
class Settings:
    """How work is dealt out; results depend on none of these."""

    bucket_anchors: int = 500_000
    bucket_contexts: int = 125_000
    sampled_documents: int = 20_000
    hot_documents: int = 4096  # an anchor in so many documents, by the sample's estimate, takes the path of windows
    least_seen: int = 10  # and it must be in so many documents of the sample


# ---------------------------------------------------------------- anchors


def _mix(x: np.ndarray) -> np.ndarray:
    # The constants of a published 64-bit finaliser.
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of the `size` bytes from each position on, put together from those of 1, 2, 4, ... bytes."""
    if len(data) < size:
        return np.empty(0, np.uint64)
    table = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed))
    step = 0xD1342543DE82EF95
    part, width, out, done = table[data], 1, None, 0
    count = len(data) - size + 1
    while True:
        if size & width:
            here = part[done : done + count]
            out = here if out is None else out * np.uint64(pow(step, width, 1 << 64)) + here
            done += width
        if 2 * width > size:
            return _mix(out)
        part = part[:-width] * np.uint64(pow(step, width, 1 << 64)) + part[width:]
        width *= 2


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows within each stretch [start, end) of `data`: hash, position, first and last window."""
    hashes = gram_hashes(data, GRAM)
    width = REACH + 1
    if len(hashes) < width:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    # the hash's high bits before the position: the least of them is the leftmost of the least hashes
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, n = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), 1
    while n < width:
        shift = min(n, width - n)
        least = np.minimum(least[:-shift], least[shift:])
        n += shift
    place = (least & low).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int8)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[: len(place)], dtype=np.int8))
    chosen = place[windows]
    cut = np.ones(len(windows), bool)
    cut[1:] = (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(windows)) - 1
    at = chosen[first]
    return hashes[at], at, windows[first], windows[last]


def _packed(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Position and how far before it its first and last window start, in one number."""
    return (at << 12) | ((at - last) << 6) | (at - first)


def _stretches(texts: Iterable[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts of STEP_BYTES in all at a time as (document number, offset, bytes); longer texts in overlapping parts."""
    of, offset, held, size = [], [], [], 0
    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text) - LENGTH + 1), STEP_BYTES):
            part = text[start : start + STEP_BYTES + LENGTH - 1]
            of.append(i)
            offset.append(start)
            held.append(part)
            size += len(part)
            if size >= STEP_BYTES:
                yield of, offset, held
                of, offset, held, size = [], [], [], 0
    if held:
        yield of, offset, held


def anchors_of(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For a stretch of texts at a time: anchor hashes, document numbers, packed places."""
    for of, offset, held in _stretches(texts):
        ends = np.cumsum([len(x) for x in held])
        starts = ends - np.array([len(x) for x in held])
        hashes, at, first, last = anchors(np.frombuffer(b"".join(held), np.uint8), starts, ends)
        which = np.searchsorted(ends, at, side="right")
        shift = np.array(offset, np.int64)[which] - starts[which]
        yield hashes, np.array(of, np.int64)[which], _packed(at + shift, first + shift, last + shift)


# ---------------------------------------------------------------- deep-shallow sorting


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Order of the strings. A node holds the depth at which its strings differ and a child for each byte there (-1: end).

    A string goes down by the bytes at those depths alone, is compared once, with the string at the leaf, and enters at the depth
    where the two differ.
    """
    leaves: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        leaves.setdefault(s, []).append(i)
    width = 8 * max(map(len, leaves), default=0)
    root = None  # a leaf is the list of its equal strings, a node is (depth, children)
    for s, leaf in leaves.items():
        if root is None:
            root = leaf
            continue
        node, n = root, len(s)
        while type(node) is tuple:
            depth, children = node
            node = children.get(s[depth] if depth < n else -1) or next(iter(children.values()))
        other = strings[node[0]]
        m = len(other)
        differ = (int.from_bytes(s, "big") << (width - 8 * n)) ^ (int.from_bytes(other, "big") << (width - 8 * m))
        common = min((width - differ.bit_length()) >> 3, n, m)
        above, node = None, root
        while type(node) is tuple and node[0] < common:
            above, node = node, node[1][s[node[0]]]
        own = s[common] if common < n else -1
        if type(node) is tuple and node[0] == common:
            node[1][own] = leaf
            continue
        made = (common, {other[common] if common < m else -1: node, own: leaf})
        if above is None:
            root = made
        else:
            above[1][s[above[0]]] = made
    out, stack = [], [root] if leaves else []
    while stack:
        node = stack.pop()
        if type(node) is tuple:
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow_order(rows: np.ndarray, lengths: np.ndarray, shallow: int = SHALLOW_WORDS) -> np.ndarray:
    """Order of the strings in the zero-padded rows of a byte matrix; a string that begins another comes first."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.arange(n)
    stack = [(0, n, 0)] if n > 1 else []

    def deep(low: int, high: int) -> None:
        group = order[low:high]
        if (words[group] == words[group[0]]).all() and (lengths[group] == lengths[group[0]]).all():
            return
        data = rows[group].tobytes()
        order[low:high] = group[blind_trie_order([data[i : i + n] for i, n in zip(range(0, len(data), width), lengths[group].tolist(), strict=True)])]

    while stack:
        low, high, depth = stack.pop()
        if high - low < 2:
            continue
        if depth >= min(shallow, words.shape[1]) or high - low <= SMALL:
            deep(low, high)
            continue
        group = order[low:high]
        key = words[group, depth]
        some = np.sort(key[:: max(1, len(key) // 9)])
        pivot = some[len(some) // 2]
        smaller, larger = key < pivot, key > pivot
        a, b = int(smaller.sum()), len(key) - int(larger.sum())
        order[low:high] = np.concatenate([group[smaller], group[~(smaller | larger)], group[larger]])
        stack += [(low, low + a, depth), (low + a, low + b, depth + 1), (low + b, high, depth)]
    return order


def common_lengths(rows: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each string and the one before it in `order` (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for start in range(1, len(order), 100_000):
        here, before = order[start : start + 100_000], order[start - 1 : min(start + 100_000, len(order)) - 1]
        differ = rows[here] != rows[before]
        found = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[start : start + len(here)] = np.minimum(found, np.minimum(lengths[here], lengths[before]))
    return out


class SuffixArray:
    """Strings in order, with common prefix lengths; `classes(d)` numbers the strings by their first d bytes."""

    def __init__(self, rows: np.ndarray, lengths: np.ndarray):
        self.order = deep_shallow_order(rows, lengths)
        self.common = common_lengths(rows, lengths, self.order)

    def classes(self, depth: int) -> np.ndarray:
        """Meaningful for strings of at least `depth` bytes."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < depth)
        return out


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rows that stand for all equal ones, and for each row which of them is its own."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    words = padded.view("<u8")
    hashes = np.zeros(len(rows), np.uint64)
    for column in words.T:
        hashes = _mix(hashes * np.uint64(0xD1342543DE82EF95) + column)
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate([[True], (words[order[1:]] != words[order[:-1]]).any(axis=1)])
    of = np.empty(len(rows), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def _by_value(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct value and the places that have it, in order."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], values[order][1:] != values[order][:-1]]))
    for group in np.split(order, cuts[1:]):
        yield int(values[group[0]]), group


def _slices(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """All places, about SLICE at a time, those of one hash together."""
    for _, here in _by_value((_mix(hashes) % np.uint64(-(-len(hashes) // SLICE))).astype(np.int32)):
        yield here


def _anchor_hashes(contexts: np.ndarray) -> np.ndarray:
    """Hashes of the anchors' bytes."""
    grams = np.ascontiguousarray(contexts[:, REACH : REACH + GRAM]).view("<u8")
    return _mix(_mix(grams[:, 0]) * np.uint64(0xD1342543DE82EF95) + grams[:, 1])


def held_before(contexts: np.ndarray, near: np.ndarray, far: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Context number and distance o of each window that also starts in a document with a smaller id, a slice of the contexts at a time.

    A context has WIDTH bytes, its anchor behind the first REACH; its windows start `near` to `far` bytes before the anchor.
    Equal windows have equal anchors, so a slice has all contexts of some anchors.
    """
    for here in _slices(_anchor_hashes(contexts)):
        which, distance = _held_before(contexts[here], near[here], far[here], ids[here])
        yield here[which], distance


def _held_before(contexts: np.ndarray, near: np.ndarray, far: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`held_before` at one go. Equal contexts are sorted once."""
    first, of = distinct_rows(np.column_stack([contexts, near.astype(np.uint8), far.astype(np.uint8)]))
    contexts, near, far = contexts[first], near[first], far[first]
    smallest = np.full(len(first), NO_ID)
    np.minimum.at(smallest, of, ids)
    right = SuffixArray(contexts[:, REACH:], LENGTH - near)
    left = SuffixArray(np.ascontiguousarray(contexts[:, REACH - 1 :: -1]), far)
    found, distances = [], []
    for o in range(REACH + 1):
        here = np.flatnonzero((near <= o) & (o <= far))
        if not len(here):
            continue
        both = right.classes(LENGTH - o)[here] * (len(first) + 1) + left.classes(o)[here]
        order = np.argsort(both, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], both[order][1:] != both[order][:-1]]))
        least = np.full(len(first), NO_ID)
        least[here[order]] = np.repeat(np.minimum.reduceat(smallest[here][order], starts), np.diff(np.append(starts, len(order))))
        late = np.flatnonzero(ids > least[of])
        found.append(late)
        distances.append(np.full(len(late), o))
    return np.concatenate(found), np.concatenate(distances)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch put together."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(order) else ends
    cut = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]])) if len(starts) else np.empty(0, np.int64)
    return starts[cut], ends[np.append(cut[1:], len(ends)) - 1] if len(cut) else ends


# ---------------------------------------------------------------- Spark


#: Bytes of a number in the blobs; those of equal significance are compressed together. Others are compressed as they are.
_NUMBER_BYTES = dict.fromkeys(["places", "ids", "firsts", "seconds", "numbers", "least", "starts"], 8)


def _squeezed(blob: bytes, number_bytes: int) -> bytes:
    """The blob compressed, behind the size of its numbers and its own (0 where it stays as it is, as random numbers do)."""
    planes = np.frombuffer(blob, np.uint8).reshape(-1, number_bytes).T.tobytes() if number_bytes > 1 else blob
    small = pa.compress(planes, codec="zstd", asbytes=True)
    head = bytes([number_bytes])
    return head + len(blob).to_bytes(4, "little") + small if len(small) < len(blob) else head + bytes(4) + planes


def _unsqueezed(blob: bytes) -> bytes:
    number_bytes, size, rest = blob[0], int.from_bytes(blob[1:5], "little"), blob[5:]
    planes = pa.decompress(rest, size, codec="zstd", asbytes=True) if size else rest
    return np.frombuffer(planes, np.uint8).reshape(number_bytes, -1).T.tobytes() if number_bytes > 1 and planes else planes


def _to_send(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch as it passes a shuffle: `_numbers` reads its blobs."""
    columns = [
        pa.array([b if b is None else _squeezed(b, _NUMBER_BYTES.get(name, 1)) for b in column.to_pylist()], pa.binary()) if column.type == pa.binary() else column
        for name, column in zip(batch.schema.names, batch.columns, strict=True)
    ]
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _numbers(row: dict, name: str, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(_unsqueezed(row[name]), kind)


def _groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one `key` after the other of a partition sorted by it; who has read them may clear the list."""
    held: list[dict] = []
    for batch in rebatched(batches, 8):
        for row in batch.to_pylist():
            if held and row[key] != held[0][key]:
                yield held[0][key], held
                held = []
            held.append(row)
    if held:
        yield held[0][key], held


def _rows_of(values: np.ndarray, most: int = ROW_ANCHORS) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct value and the places that have it, `most` at a time."""
    for value, group in _by_value(values):
        for start in range(0, len(group), most):
            yield value, group[start : start + most]


def _emitted(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


_SPARK = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}


def _form(fields: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"`{name}` {_SPARK[kind]}" for name, kind in fields)


def _dealt(table: DataFrame, column: str, buckets: int) -> DataFrame:
    """Buckets dealt to half as many tasks at least, sorted in each."""
    return table.repartition(max(1, buckets // 2), column).sortWithinPartitions(column)


_ANCHORS = [("bucket", pa.int32()), ("hot", pa.bool_()), ("hashes", pa.binary()), ("places", pa.binary()), ("docs", pa.binary()), ("ids", pa.binary()), ("prints", pa.binary())]
#: What a bucket sends back: `firsts` and `seconds` of documents, a blob for each group of documents.
_REPLIES = [("group", pa.int32()), ("hot", pa.bool_()), ("ids", pa.binary()), ("prints", pa.binary()), ("firsts", pa.binary()), ("seconds", pa.binary())]
_PER_DOCUMENT = [("id", pa.int64()), ("print", pa.int64()), ("hot", pa.bool_()), ("firsts", pa.binary()), ("seconds", pa.binary())]


def _texts_of(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    return batch.column("text").cast(pa.binary()).to_pylist(), batch.column("id").to_numpy(), batch.column("print").to_numpy()


def _documents(of: np.ndarray, ids: np.ndarray, prints: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Of rising document numbers a byte each, 1 where a document begins, and the ids and prints of those documents."""
    new = np.concatenate([[True], of[1:] != of[:-1]])
    return new.tobytes(), ids[of[new]].astype("<i8").tobytes(), prints[of[new]].astype("<i8").tobytes()


def _holders(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Id and print of the document of each entry of the rows that `_documents` made."""
    docs = [np.cumsum(_numbers(r, "docs", np.uint8), dtype=np.int64) - 1 for r in rows]
    ids, prints = (np.concatenate([_numbers(r, name)[d] for r, d in zip(rows, docs, strict=True)]) for name in ("ids", "prints"))
    return ids, prints


def _in_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """32 bits of each hash, without what all of a bucket share. Different hashes that agree in them cost a comparison of contexts."""
    return (hashes // np.uint64(buckets)).astype("<u4")


def _sent_anchors(texts: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Anchors of all texts, a blob for each bucket and some hundred thousand anchors; hot ones apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_sent = TaskContext.get().partitionId(), 0

        def flushed(held, ids, prints) -> pa.RecordBatch:
            nonlocal n_sent
            hashes, of, places = (np.concatenate([h[i] for h in held]) for i in range(3))
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            n_sent += 1
            if len(hot):
                bucket[np.isin(hashes, hot)] = buckets + (part * 31 + n_sent) % buckets  # known to be shared: any task will do
            rows = []
            for b, group in _rows_of(bucket):
                sent = b"" if b >= buckets else _in_bucket(hashes[group], buckets).tobytes()
                rows.append((b % buckets, b >= buckets, sent, places[group].tobytes(), *_documents(of[group], ids, prints)))
            return _to_send(_emitted(rows, _ANCHORS))

        held, tables, count = [], [], 0
        for batch in rebatched(batches, BATCH_ROWS):
            data, ids, prints = _texts_of(batch)
            tables.append((ids, prints))
            for hashes, of, places in anchors_of(data):
                held.append((hashes, of + sum(len(t[0]) for t in tables[:-1]), places))
                count += len(hashes)
                if count >= SENT_ANCHORS:
                    yield flushed(held, *map(np.concatenate, zip(*tables, strict=True)))
                    held, tables, count = [], [(ids, prints)], 0
        if count:
            yield flushed(held, *map(np.concatenate, zip(*tables, strict=True)))

    return texts.mapInArrow(run, _form(_ANCHORS))


def _by_document(ids: np.ndarray, prints: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple]:
    """(id, print, values...) of each document."""
    order = np.lexsort((prints, ids))
    ids, prints = ids[order], prints[order]
    cuts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])]))
    for group, at in zip(np.split(order, cuts[1:]), cuts, strict=True):
        yield int(ids[at]), int(prints[at]), *[v[group] for v in values]


def _replies(groups: int, hot: bool, ids: np.ndarray, prints: np.ndarray, firsts: np.ndarray, seconds: np.ndarray) -> pa.RecordBatch:
    group = (_mix(ids.astype(np.uint64) ^ _mix(prints.astype(np.uint64))) % np.uint64(groups)).astype(np.int64)
    columns = [x.astype("<i8") for x in (ids, prints, firsts, seconds)]
    return _emitted([(g, hot, *[c[here].tobytes() for c in columns]) for g, here in _rows_of(group)], _REPLIES)


def _per_document(replies: DataFrame, groups: int) -> DataFrame:
    """The replies put together, one row for each document (and for hot and other anchors)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "group"):
            for hot in (False, True):
                held = [r for r in rows if r["hot"] == hot]
                if held:
                    ids, prints, firsts, seconds = (np.concatenate([_numbers(r, c) for r in held]) for c in ("ids", "prints", "firsts", "seconds"))
                    made = [(i, p, hot, a.tobytes(), b.tobytes()) for i, p, a, b in _by_document(ids, prints, [firsts, seconds])]
                    for start in range(0, len(made), 1000):
                        yield _emitted(made[start : start + 1000], _PER_DOCUMENT)

    return _dealt(replies, "group", groups).mapInArrow(run, _form(_PER_DOCUMENT))


def in_several(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the hashes that come with more than one id."""
    found = []
    for here in _slices(hashes):
        order = here[np.argsort(hashes[here], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
        shared = np.minimum.reduceat(ids[order], cuts) < np.maximum.reduceat(ids[order], cuts)
        found.append(order[np.repeat(shared, np.diff(np.append(cuts, len(order))))])
    return np.concatenate(found)


def _shared_anchors(sent: DataFrame, buckets: int) -> DataFrame:
    """Places of the anchors that more than one document has, as replies."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "bucket"):
            for hot in (False, True):
                held = [r for r in rows if r["hot"] == hot]
                if not held:
                    continue
                ids, prints = _holders(held)
                places = np.concatenate([_numbers(r, "places") for r in held])
                if not hot:
                    hashes = np.concatenate([_numbers(r, "hashes", "<u4") for r in held])
                    kept = np.sort(in_several(hashes.astype(np.uint64), ids))  # a document's places together
                    ids, prints, places = ids[kept], prints[kept], places[kept]
                if len(ids):
                    yield _to_send(_replies(buckets, hot, ids, prints, places, np.zeros(len(ids), np.int64)))

    return _dealt(sent, "bucket", buckets).mapInArrow(run, _form(_REPLIES))


def _hot_hashes(texts: DataFrame, documents: int, settings: Settings) -> np.ndarray:
    """Hashes of anchors in very many documents, by a sample of documents. What is found is at most the sample's anchors."""
    one_in = -(-documents // settings.sampled_documents)
    sample = texts.where(F.pmod(F.xxhash64("id", "print"), F.lit(one_in)) == 0)
    least = max(settings.least_seen, -(-settings.hot_documents // one_in))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, BATCH_ROWS):
            data, _, _ = _texts_of(batch)
            found = [np.empty(0, np.uint64)]
            for hashes, of, _ in anchors_of(data):
                order = np.lexsort((of, hashes))
                again = (hashes[order][1:] == hashes[order][:-1]) & (of[order][1:] == of[order][:-1])
                found.append(hashes[order][np.concatenate([[True], ~again])] if len(order) else hashes)
            hashes, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["hash", "n"])

    counted = sample.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return np.array([r["hash"] for r in counted.where(F.col("n") >= least).select("hash").collect()], np.int64).view(np.uint64)


_CONTEXTS = [("bucket", pa.int32()), ("contexts", pa.binary()), ("places", pa.binary()), ("docs", pa.binary()), ("ids", pa.binary()), ("prints", pa.binary())]


def _unpacked(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, distance to the last and to the first window."""
    return places >> 12, (places >> 6) & 63, places & 63


def _around(text: np.ndarray, at: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The bytes around each anchor that its windows cover, others as zero."""
    shift = np.arange(-REACH, LENGTH)
    rows = text[np.clip(at[:, None] + shift, 0, len(text) - 1)]
    rows[(shift < -far[:, None]) | (shift >= LENGTH - near[:, None])] = 0
    return rows


def _sent_contexts(spotted: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(held, ids, prints) -> pa.RecordBatch:
            contexts, of, places = (np.concatenate([h[i] for h in held]) for i in range(3))
            bucket = (_anchor_hashes(contexts) % np.uint64(buckets)).astype(np.int64)
            rows = [(b, contexts[group].tobytes(), places[group].tobytes(), *_documents(of[group], ids, prints)) for b, group in _rows_of(bucket, ROW_ANCHORS // 2)]
            return _to_send(_emitted(rows, _CONTEXTS))

        held, tables, count = [], [], 0
        for batch in rebatched(batches, 32):
            data, ids, prints = _texts_of(batch)
            tables.append((ids, prints))
            for i, (text, blob) in enumerate(zip(data, batch.column("places").to_pylist(), strict=True)):
                all_places = np.frombuffer(blob, "<i8")
                for start in range(0, len(all_places), ROW_ANCHORS):
                    places = all_places[start : start + ROW_ANCHORS]
                    number = i + sum(len(t[0]) for t in tables[:-1])
                    held.append((_around(np.frombuffer(text, np.uint8), *_unpacked(places)), np.full(len(places), number), places))
                    count += len(places)
                    if count >= SENT_ANCHORS // 4:
                        yield flushed(held, *map(np.concatenate, zip(*tables, strict=True)))
                        held, tables, count = [], [(ids, prints)], 0
        if count:
            yield flushed(held, *map(np.concatenate, zip(*tables, strict=True)))

    return spotted.mapInArrow(run, _form(_CONTEXTS))


def _window_spans(ids: np.ndarray, prints: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The spans of windows, put together for each document: ids, prints, starts, ends."""
    order = np.lexsort((starts, prints, ids))
    ids, prints, starts = ids[order], prints[order], starts[order]
    other = (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])
    cut = np.flatnonzero(np.concatenate([[True], other | (starts[1:] > starts[:-1] + LENGTH)]))
    ends = starts[np.append(cut[1:], len(starts)) - 1] + LENGTH
    return ids[cut], prints[cut], starts[cut], ends


def _spans_of_contexts(sent: DataFrame, buckets: int, groups: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "bucket"):
            contexts = np.concatenate([_numbers(r, "contexts", np.uint8).reshape(-1, WIDTH) for r in rows])
            ids, prints = _holders(rows)
            at, near, far = _unpacked(np.concatenate([_numbers(r, "places") for r in rows]))
            rows.clear()
            spans = [_window_spans(ids[w], prints[w], at[w] - distance) for w, distance in held_before(contexts, near, far, ids) if len(w)]
            if spans:
                yield _to_send(_replies(groups, False, *map(np.concatenate, zip(*spans, strict=True))))

    return _dealt(sent, "bucket", buckets).mapInArrow(run, _form(_REPLIES))


# ---------------------------------------------------------------- windows of hot anchors

_ASKED = [("bucket", pa.int32()), ("batch", pa.int64()), ("numbers", pa.binary()), ("keys", pa.binary()), ("least", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()), ("ids", pa.binary()), ("prints", pa.binary())]
_ANSWERED = [("batch", pa.int64()), ("numbers", pa.binary()), ("least", pa.binary())]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of two words, and for each row the number of its own."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]).any(axis=1)])
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    return keys[order[new]], of


def _asked_windows(spotted: DataFrame, buckets: int) -> DataFrame:
    """Per batch of documents: what it asks each bucket for, and (bucket -1) its windows by the number of their key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in rebatched(batches, BATCH_ROWS):
            data, ids, prints = _texts_of(batch)
            keys, docs, starts = [], [], []
            for i, (text, blob) in enumerate(zip(data, batch.column("places").to_pylist(), strict=True)):
                at, near, far = _unpacked(np.frombuffer(blob, "<i8"))
                many = far - near + 1
                first = np.repeat(at - far, many)
                here = np.unique(first + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many))
                for low in range(0, len(here), STEP_BYTES):
                    some = here[low : low + STEP_BYTES]
                    stretch = np.frombuffer(text, np.uint8)[some[0] : some[-1] + LENGTH]
                    keys.append(np.stack([gram_hashes(stretch, LENGTH, seed)[some - some[0]] for seed in (1, 2)], axis=1))
                    starts.append(some)
                    docs.append(np.full(len(some), i))
            if not keys:
                continue
            keys, docs, starts = np.concatenate(keys), np.concatenate(docs), np.concatenate(starts)
            distinct, of = _distinct(keys)
            least = np.full(len(distinct), NO_ID)
            np.minimum.at(least, of, ids[docs])
            name = (part << 32) | number
            number += 1
            nothing = b""
            out = [(-1, name, of.astype("<i8").tobytes(), nothing, nothing, docs.astype("<i4").tobytes(), starts.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), prints.astype("<i8").tobytes())]
            bucket = (distinct[:, 0] % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(bucket).tolist():
                mine = np.flatnonzero(bucket == b)
                out.append((b, name, mine.astype("<i8").tobytes(), distinct[mine].tobytes(), least[mine].tobytes(), nothing, nothing, nothing, nothing))
            yield _to_send(_emitted(out, _ASKED))

    return spotted.mapInArrow(run, _form(_ASKED))


def _answered(asked: DataFrame, buckets: int) -> DataFrame:
    """For each batch and key the smallest id of all batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "bucket"):
            keys = np.concatenate([_numbers(r, "keys", "<u8").reshape(-1, 2) for r in rows])
            distinct, of = _distinct(keys)
            least = np.full(len(distinct), NO_ID)
            np.minimum.at(least, of, np.concatenate([_numbers(r, "least") for r in rows]))
            numbers = [_numbers(r, "numbers") for r in rows]
            cut = np.cumsum([len(n) for n in numbers])
            made = [(r["batch"], n.tobytes(), least[mine].tobytes()) for r, n, mine in zip(rows, numbers, np.split(of, cut[:-1]), strict=True)]
            for start in range(0, len(made), 64):
                yield _to_send(_emitted(made[start : start + 64], _ANSWERED))

    return _dealt(asked.where("bucket >= 0"), "bucket", buckets).mapInArrow(run, _form(_ANSWERED))


def _spans_of_windows(asked: DataFrame, answered: DataFrame, groups: int) -> DataFrame:
    """Each batch with its answers."""
    together = asked.where("bucket < 0").unionByName(answered, allowMissingColumns=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "batch"):
            own = next(r for r in rows if r["bucket"] is not None)
            of = _numbers(own, "numbers")
            least = np.full(of.max() + 1, NO_ID)
            for r in rows:
                if r["bucket"] is None:
                    least[_numbers(r, "numbers")] = _numbers(r, "least")
            docs, starts = _numbers(own, "docs", "<i4"), _numbers(own, "starts")
            ids, prints = _numbers(own, "ids")[docs], _numbers(own, "prints")[docs]
            late = ids > least[of]
            if late.any():
                yield _to_send(_replies(groups, False, *_window_spans(ids[late], prints[late], starts[late])))

    return together.repartition("batch").sortWithinPartitions("batch").mapInArrow(run, _form(_REPLIES))


# ---------------------------------------------------------------- the operator


def _node(id_: Column, print_: Column) -> Column:
    return F.concat_ws(":", id_.cast("string"), print_.cast("string"))


def looked_up(rows: DataFrame, column: str, table: DataFrame, payload: str) -> DataFrame:
    """All rows with `payload` of `table` (column `node`) where `column` is in it, else null.

    Rows that a blocked Bloom filter of the table stops stay where they are; the others meet it in a join.
    """
    filter_, blocks = filter_of(table, "node")
    probed = probe(rows, column, filter_, blocks, "may_be")
    passed = probed.where("may_be").drop("may_be").join(table.select(F.col("node").alias(column), payload), column, "left")
    return passed.unionByName(probed.where("not may_be").drop("may_be").withColumn(payload, F.lit(None).cast(table.schema[payload].dataType)))


def repeats(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """`id, print, firsts, seconds` of documents that lose bytes, one row each; both null for those that go as copies.

    `print` is a hash of the text; starts and ends of spans in bytes, as little-endian 64-bit numbers, may overlap.
    """
    plain = docs.select(F.coalesce(docs[key].cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    plain = plain.where(F.octet_length("text") >= LENGTH).withColumn("print", F.xxhash64("text"))
    named = pin(plain.select("id", "print", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("bytes")), "documents")
    firsts = named.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = named.join(firsts, "sha").where("id > first").select("id", "print").distinct()
    copies = pin(copies.select("id", "print", _node(F.col("id"), F.col("print")).alias("node"), F.lit(True).alias("copy")), "copies")
    noded = plain.withColumn("own_node", _node(F.col("id"), F.col("print")))
    texts = looked_up(noded, "own_node", copies.select("node", "copy"), "copy").where("copy is null").drop("copy")

    size = named.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")).first()
    buckets = max(2, -(-(size["bytes"] or 0) // (18 * settings.bucket_anchors)))
    narrow = texts.select("id", "print", "text")
    hot = _hot_hashes(narrow, size["rows"], settings) if size["rows"] else np.empty(0, np.uint64)
    found = _per_document(_shared_anchors(_sent_anchors(narrow, buckets, hot), buckets), buckets)
    spots = pin(found.select("id", "print", "hot", F.col("firsts").alias("places"), _node(F.col("id"), F.col("print")).alias("node")), "shared-anchors")

    def spotted(hot_ones: bool) -> DataFrame:
        wanted = spots.where(F.col("hot") == hot_ones).select("node", "places")
        # no copy is among them, so copies need not be taken out again
        return looked_up(noded, "own_node", wanted, "places").where("places is not null").select("id", "print", "text", "places")

    counts = {r["hot"]: r["n"] for r in spots.groupBy("hot").agg(F.sum(F.expr("octet_length(places) div 8")).alias("n")).collect()}
    spans = None

    def of_windows() -> DataFrame:
        many = max(2, -(-17 * counts[True] // settings.bucket_anchors))
        asked = pin(_asked_windows(spotted(True), many), "asked-windows")
        return _spans_of_windows(asked, _answered(asked, many), buckets)

    if counts.get(True):
        spans = pin_alone(docs.sparkSession, of_windows, "spans-of-windows")
    if counts.get(False) or spans is None:
        many = max(2, -(-counts.get(False, 0) // settings.bucket_contexts))
        cold = _spans_of_contexts(_sent_contexts(spotted(False), many), many, buckets)
        spans = cold if spans is None else spans.unionByName(cold)
    gathered = pin(_per_document(spans, buckets), "spans")
    nothing = F.lit(None).cast("binary")
    return gathered.select("id", "print", "firsts", "seconds").unionByName(copies.select("id", "print", nothing.alias("firsts"), nothing.alias("seconds")))


def cut(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of `docs`: the column `key`, `n_bytes`, `spans` (start, end) in bytes that go, and `kept`, the bytes that stay.

    Null texts count as empty, null ids as larger than every id. Rows that repeat an id are one document: they are
    compared with smaller ids only, never with each other. Texts below LENGTH bytes stay whole; of an empty table
    there are no rows. Other columns are not read.
    """
    def found() -> DataFrame:
        return repeats(docs, settings, key, text).select(_node(F.col("id"), F.col("print")).alias("node"), F.struct("firsts", "seconds").alias("found"))

    value = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[key].alias("key"), value.alias("text"), _node(F.coalesce(docs[key].cast("long"), F.lit(NO_ID)), F.xxhash64(value)).alias("own_node"))
    with shuffles_dropped(docs.sparkSession):
        listed = pin_alone(docs.sparkSession, found, "repeats")
        # short texts are in no table: their node is not looked up
        marked = looked_up(rows.withColumn("own_node", F.when(F.octet_length("text") >= LENGTH, F.col("own_node"))), "own_node", listed, "found")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 32):
            out = []
            for data, firsts, seconds in zip(batch.column("text").cast(pa.binary()).to_pylist(), *[batch.column(c).to_pylist() for c in ("firsts", "seconds")], strict=True):
                starts, ends = merged(np.frombuffer(firsts, "<i8"), np.frombuffer(seconds, "<i8"))
                kept = b"".join(data[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True))
                out.append(([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], kept, len(data)))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [pa.array([r[2] for r in out], pa.int64()), pa.array([r[0] for r in out], span), pa.array([r[1] for r in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=["key", "n_bytes", "spans", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    form = "array<struct<start:bigint,end:bigint>>"
    partly = marked.where("found.firsts is not null").select("key", "text", "found.firsts", "found.seconds")
    partly = partly.mapInArrow(run, f"key {kind}, n_bytes long, spans {form}, kept binary")
    size = F.octet_length("text").cast("long")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end")))
    gone = F.col("found").isNotNull()
    others = marked.where("found is null or found.firsts is null").select(
        "key", size.alias("n_bytes"), F.when(gone, whole).otherwise(F.array().cast(form)).alias("spans"), F.when(gone, F.lit(b"")).otherwise(F.encode("text", "utf-8")).alias("kept")
    )
    return partly.unionByName(others).withColumnRenamed("key", key)
