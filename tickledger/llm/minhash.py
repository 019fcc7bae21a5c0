"""Near duplicates by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of `words` words (white space splits, A-Z in lower case). Its
sketch has t coordinates, filled by hashed bin placement: in each of the first t rounds every element
draws a bin and a value in [round, round + 1); a bin keeps its smallest value. In round t + i every element
also goes to bin i, so after 2t rounds no coordinate is empty. Early rounds fill almost all bins of any
set of some size, so the work is near t log t + n instead of t n; the coordinates agree between two sets with
the probability of their similarity, and their share is as concentrated as with t independent hashes.

From sketches to components:

1. Copies of one word sequence form a class; only its smallest document goes on.
2. Documents that agree in all coordinates of a band share a bucket.
3. Each member of a bucket is verified against the bucket's smallest, by sketch and then by whole set;
   components of those links follow.
4. In buckets whose members still lie in several components all pairs are compared inside the task, block by
   block: by sketches at first, which leaves the members that have a partner in reach in another component,
   then by their whole sets. A task returns only links that join components.

Step 4 leaves out no pair of a bucket, so a link is missed only if no band agrees or its sketches differ by
more than seven standard deviations (one pair in 10^8 at the limit, whatever it is). No pairs within a group are ever written out: links between members that
are connected already are not needed for components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tickledger.llm.base import rebatched
from tickledger.llm.url_filter import possible_hits
from tickledger.workspace import pin, pin_alone

BATCH_ROWS = 128
#: Null ids get numbers from here on, so that they are never the smallest of a component.
NO_ID = 1 << 62


@dataclass(frozen=True)
class Settings:
    """Links need 100 * intersection >= percent * union; sketches have bands * rows coordinates.

    Both follow from `percent`: as many bands as it takes to miss a pair at the limit with less than `miss`, and
    the longest bands with which that needs no more than `most_coordinates`.
    """

    words: int = 5
    percent: int = 80
    miss: float = 1e-8
    most_coordinates: int = 256
    partners: int = 1000  # partners of one document that a verification task takes at most
    block_shingles: int = 400_000  # shingles of a bucket that one side of a block holds
    block_sketches: int = 1024  # and how many sketches

    def _bands_of(self, rows: int) -> int:
        share = min(self.percent / 100, 0.999)
        return max(1, math.ceil(math.log(self.miss) / math.log1p(-(share**rows))))

    @property
    def rows(self) -> int:
        return max((r for r in range(1, 17) if r * self._bands_of(r) <= self.most_coordinates), default=1)

    @property
    def bands(self) -> int:
        return self._bands_of(self.rows)

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> float:
        """Equal coordinates that a link has but for one in 10^11: seven standard deviations below the mean."""
        share = self.percent / 100
        return self.coordinates * share - 7 * (self.coordinates * share * (1 - share)) ** 0.5


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit with probability one half."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD1342543DE82EF95)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than `size` make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths) - lengths
    # each byte is mixed with its place in the word before the sum, so no two words collide by their pattern
    place = (np.arange(len(joined)) - np.repeat(starts, lengths)).astype(np.uint64)
    hashed = _mix(np.add.reduceat(_mix(_BYTE[joined] + place * _STEP), starts) + lengths.astype(np.uint64))
    n = max(1, len(words) - size + 1)
    width = min(size, len(words))
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n])
    return np.unique(out)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of a set with at least one element; equal where two sets have the same smallest value in a bin."""
    out = np.full(t, np.uint64(0xFFFFFFFFFFFFFFFF))
    filled = np.zeros(t, bool)
    for number in range(2 * t):
        drawn = _mix(elements + _mix(np.uint64([number + 1]) * np.uint64(0x9E3779B97F4A7C15)))
        if number < t:
            # bin from the high half, value from the low half; a bin filled in an earlier round holds less already
            bins = ((drawn >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
            values = (np.uint64(number) << np.uint64(32)) | (drawn & np.uint64(0xFFFFFFFF))
            np.minimum.at(out, bins, values)
            filled[bins] = True
        else:
            place = number - t
            if not filled[place]:
                out[place] = (np.uint64(number) << np.uint64(32)) | (drawn.min() & np.uint64(0xFFFFFFFF))
                filled[place] = True
        if filled.all():
            break
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band, different from band to band."""
    out = _mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    for column in coordinates.reshape(bands, rows).T:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def own_id(key: Column, text: Column) -> Column:
    """The id, or a number from NO_ID on that follows from the text where the id is null."""
    return F.coalesce(key.cast("long"), F.lit(NO_ID).bitwiseOR(F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(NO_ID - 1))))


def sketched(docs: DataFrame, settings: Settings) -> DataFrame:
    """`id, own, h1, h2, n, bands, sketch` for rows `id, own, text`: fingerprint, set size, band keys, sketch bytes."""
    t, bands, rows = settings.coordinates, settings.bands, settings.rows
    kinds = [("id", pa.int64()), ("own", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, BATCH_ROWS):
            known: dict[bytes, tuple] = {}  # copies within a batch are sketched once
            out = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                print_ = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                if print_ not in known:
                    elements = shingles(words, settings.words)
                    made = sketch(elements, t) if len(elements) else np.empty(0, np.uint64)
                    keys = band_keys(made, bands, rows) if len(elements) else []
                    known[print_] = len(elements), keys, made.astype(np.uint8).tobytes()
                out.append((*(int.from_bytes(print_[i : i + 8], "little", signed=True) for i in (0, 8)), *known[print_]))
            columns = [pa.array([r[c] for r in out], kind) for c, (_, kind) in enumerate(kinds[2:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("own"), *columns], schema=pa.schema(kinds))

    return docs.mapInArrow(run, "id long, own long, h1 long, h2 long, n long, bands array<long>, sketch binary")


def components(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """`id, own, n_shingles, label, component_id` for each row of `docs`.

    component_id is the smallest id that links reach, null where all ids of a component are null; `label` is the
    same with the number `own_id` in place of null ids. Null or wordless texts are linked with nothing. Ids should
    be unique: a row that repeats an id with another text counts with its own text, and texts whose smallest id is the
    same count as one. Other columns are not read; an empty table gives no rows.
    """
    plain = docs.select(docs[key].cast("long").alias("id"), own_id(docs[key], docs[text]).alias("own"), docs[text].alias("text"))
    member = pin_alone(docs.sparkSession, lambda: _members(plain, settings), "members")
    keyed = member.where("bands is not null").select("node", F.explode("bands").alias("bucket"))
    ends = [F.min("node").alias("leader"), F.max("node").alias("last"), F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("print")]
    shared = keyed.groupBy("bucket").agg(*ends).where("leader < last")
    # of buckets with the same members, as bands of close copies make them, one is enough
    shared = shared.groupBy("leader", "last", "size", "print").agg(F.min("bucket").alias("bucket"))
    buckets = pin(keyed.join(shared.select("bucket", "leader"), "bucket").distinct(), "buckets")

    wanted = buckets.select("node").distinct()
    sketches = pin(member.where("bands is not null").select("node", "sketch").join(wanted, "node", "left_semi").distinct(), "candidate-sketches")
    pairs = buckets.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    likely = pin(_compared(pin(pairs, "pairs"), sketches, "sketch", alike(settings), settings), "likely-pairs")
    sets = _sets(plain, likely.select(F.explode(F.array("a", "b")).alias("node")), settings)
    links = pin(_compared(likely, sets, "elements", similar(settings), settings), "links")
    labels = connected(links)

    # buckets that those links leave in several components
    placed = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sums = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
    split = pin(placed.join(sums.where("low < high and size > 2").select("bucket"), "bucket").select("bucket", "node", "label"), "split-buckets")
    across = None if split.isEmpty() else pin(_across(split, sketches, plain, settings), "more-links")
    final = labels if across is None or across.isEmpty() else connected(links.unionByName(across))

    named = member.join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return named.select("id", "own", F.col("n").alias("n_shingles"), "label", F.when(F.col("label") < NO_ID, F.col("label")).alias("component_id"))


def _members(plain: DataFrame, settings: Settings) -> DataFrame:
    """`id, own, n, node, bands, sketch`: each row and its class, which only the class's smallest row has a sketch for."""
    rows = pin(sketched(plain, settings), "sketches")
    # one class for each word sequence; texts without words stay alone
    classes = pin(rows.where("n > 0").groupBy("h1", "h2").agg(F.min("own").alias("node")), "classes")
    joined = rows.join(classes, ["h1", "h2"], "left")
    return joined.select("id", "own", "n", F.coalesce("node", "own").alias("node"), *[F.when(F.col("own") == F.col("node"), F.col(c)).alias(c) for c in ("bands", "sketch")])


def _sets(plain: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """`node, n, elements`: the sets of the whole texts of the documents `wanted`.

    A blocked Bloom filter keeps the texts of most other documents from being moved to the exact join.
    """
    keys = pin(wanted.distinct(), "wanted")
    candidates = possible_hits(plain, "own", keys, "node").join(keys, F.col("own") == F.col("node"), "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, BATCH_ROWS):
            made = [shingles(words_of(x), settings.words) for x in batch.column("text").to_pylist()]
            columns = [batch.column("own"), pa.array([len(x) for x in made], pa.int64()), pa.array([x.tobytes() for x in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "elements"])

    return pin(candidates.select("own", "text").distinct().mapInArrow(run, "node long, n long, elements binary"), "candidate-sets")


def linked(common: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n + m - common)


def _groups(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[dict]]:
    """Consecutive rows with equal `columns` of a sorted partition."""
    held: list[dict] = []
    for batch in rebatched(batches, BATCH_ROWS):
        for row in batch.to_pylist():
            if held and any(row[c] != held[-1][c] for c in columns):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def alike(settings: Settings):
    """Whether two sketches agree well enough for a link."""
    least = settings.least_equal
    return lambda x, y: (np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum() >= least


def similar(settings: Settings):
    """Whether two whole sets are linked."""

    def test(x: bytes, y: bytes) -> bool:
        first, second = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        return linked(_common(first, second), len(first), len(second), settings.percent)

    return test


def _compared(pairs: DataFrame, sides: DataFrame, payload: str, test, settings: Settings) -> DataFrame:
    """The pairs `a, b` whose payloads pass the test. Partners of one `a` are dealt to several tasks."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / settings.partners).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    partners = dealt.join(sides, F.col("b") == F.col("node")).select("a", "part", "b", payload)
    leaders = parts.join(sides, F.col("a") == F.col("node")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), payload)
    together = leaders.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in rebatched(batches, BATCH_ROWS):
            out = []
            for row in batch.to_pylist():
                if row["b"] is None:
                    held = [*(held if at == (row["a"], row["part"]) else []), row[payload]]
                    at = row["a"], row["part"]
                elif any(test(x, row[payload]) for x in held):
                    out.append((row["a"], row["b"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return together.mapInArrow(run, "a long, b long").distinct()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    places = np.searchsorted(y, x)
    return int((y[np.minimum(places, len(y) - 1)] == x).sum())


def _across(split: DataFrame, sketches: DataFrame, plain: DataFrame, settings: Settings) -> DataFrame:
    """Links `a, b` between components within buckets, as many as join what can be joined."""
    unit = ("bucket", "low", "high")

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, unit):
            found = in_reach(group, settings.least_equal)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], pa.int64()) for c in ("bucket", "node")], names=["bucket", "node"])

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, unit):
            found = join_components(group, settings.percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    sketched_ = split.join(sketches, "node")
    members = pin(_blocks(sketched_, F.count("*") / settings.block_sketches, "sketch").mapInArrow(near, "bucket long, node long").distinct(), "in-reach")
    sets = _sets(plain, members.select("node"), settings)
    left = split.join(members, ["bucket", "node"]).join(sets, "node")
    return _blocks(left, F.sum(F.col("n") + 64) / settings.block_shingles, "elements").mapInArrow(exact, "a long, b long").distinct()


def _blocks(members: DataFrame, weight: Column, payload: str) -> DataFrame:
    """Members dealt to the units of their bucket, sorted by unit: its blocks, about `weight` of them, in pairs."""
    blocks = members.groupBy("bucket").agg(F.ceil(weight).cast("int").alias("blocks"))
    cut = members.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = paired.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "label", payload)
    return dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")


def in_reach(group: list[dict], least_equal: float) -> list[dict]:
    """The members of a unit whose sketch agrees well enough with one of another component."""
    sketches = np.array([np.frombuffer(r["sketch"], np.uint8) for r in group])
    labels = np.array([r["label"] for r in group])
    found = np.zeros(len(group), bool)
    for i in range(len(group) - 1):
        others = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
        close = others[(sketches[others] == sketches[i]).sum(axis=1) >= least_equal]
        found[close] = True
        found[i] |= len(close) > 0
    return [r for r, keep in zip(group, found, strict=True) if keep]


def join_components(group: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between different components, from the exact similarity of all pairs of a unit."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sets = [np.frombuffer(r["elements"], np.uint64) for r in group]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    marks = np.zeros(codes.max() + 1, np.int64)
    out = []
    for i in range(len(group) - 1):
        own = find(group[i]["label"])
        if all(find(r["label"]) == own for r in group[i + 1 :]):
            continue
        mine = codes[starts[i] : starts[i] + sizes[i]]
        marks[mine] = 1
        rest = starts[i + 1]
        common = np.add.reduceat(marks[codes[rest:]], starts[i + 1 :] - rest)
        marks[mine] = 0
        for j in np.flatnonzero(linked(common, sizes[i], sizes[i + 1 :], percent)) + i + 1:
            a, b = find(group[i]["label"]), find(group[j]["label"])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((group[i]["node"], group[j]["node"]))
    return out


def connected(links: DataFrame) -> DataFrame:
    """`node, label` for every node of `links`: the smallest node of its component.

    Each round takes the smallest label among the neighbours, passes it on to the former label, and jumps to
    the label's label; the number of rounds grows with the logarithm of the longest path. Every round is
    written to the shared folder. A node is its own neighbour too, so one pass over the edges gives both its label and
    the smallest around it.
    """
    ends = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")])
    edges = pin(links.select(F.explode(ends).alias("edge")).select("edge.*").distinct(), "edges")
    labels, now = _with_sum(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    before = None
    while before != now:
        met = edges.join(labels, F.col("b") == F.col("node")).groupBy("a")
        step = met.agg(F.min("label").alias("near"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("label"))
        told = step.select(F.explode(F.array("a", "label")).alias("node"), "near")
        hooked = told.groupBy("node").agg(F.min("near").alias("label"))
        jump = hooked.select(F.col("node").alias("at"), F.col("label").alias("further"))
        before = now
        labels, now = _with_sum(hooked.join(jump, F.col("label") == F.col("at")).select("node", F.col("further").alias("label")))
    return labels


def _with_sum(labels: DataFrame) -> tuple[DataFrame, object]:
    """The labels, written, and their sum, which is taken while they are written: labels only fall, so an equal sum is the end."""
    seen = Observation()
    written = pin(labels.observe(seen, F.sum(F.col("label").cast("decimal(38,0)")).alias("total")), "labels")
    return written, seen.get["total"]


def one_of_each(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, of which one stands for each component: the one with the smallest id.

    Rows that share an id but not the text are documents of their own, told apart by text like rows without an id; of rows
    equal in both, one stays. What joins the documents is the ids that go, the ids that repeat and the shared ids; all
    are written before, so texts are moved only where those lists are long.
    """
    by_id = docs.select(docs[key].cast("long").alias("shared_id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("hash")).where("shared_id is not null")
    shared = pin(by_id.groupBy("shared_id").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("low < high").select("shared_id"), "shared-ids")
    plain = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc_row"), docs[key].cast("long").alias("doc_key"), docs[text].alias("doc_text"))
    told = plain.join(shared, F.col("doc_key") == F.col("shared_id"), "left").withColumn("doc_key", F.when(F.col("shared_id").isNull(), F.col("doc_key"))).drop("shared_id")

    def judged() -> DataFrame:
        counts = components(told, settings, "doc_key", "doc_text").groupBy("own").agg(F.max(F.col("own") == F.col("label")).alias("kept"), F.count("*").alias("rows"))
        return counts.where("not kept or rows > 1")

    counts = pin_alone(docs.sparkSession, judged, "kept-ids")
    gone = counts.where("not kept").select(F.col("own").alias("kept_id"))
    repeated = counts.where("kept").select(F.col("own").alias("kept_id"))
    left = told.withColumn("kept_id", own_id(F.col("doc_key"), F.col("doc_text"))).join(gone, "kept_id", "left_anti")
    first = Window.partitionBy("kept_id").orderBy("doc_text")
    smallest = left.join(repeated, "kept_id", "left_semi").withColumn("doc_place", F.row_number().over(first)).where("doc_place = 1")
    return left.join(repeated, "kept_id", "left_anti").select("doc_row.*").unionByName(smallest.select("doc_row.*"))
