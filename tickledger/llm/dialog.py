"""Repair of conversation structure by Hirschberg's divide and conquer over a four-state automaton.

The roles of a repaired conversation read `(s?(ua)+)?` by their initials. The automaton has the states
0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 accept. Each row is kept (cost 0), given the role that may come
next (`R`, 2) or deleted (`D`, 3; required for blank and repeated rows), empty rows may be inserted anywhere (`I`, 2),
and a row left truncated costs 1 more. Of all cheapest edit strings the ASCII-least one is the audit.

Forward cost vectors (four states) from the left and backward ones from the right meet in the middle of a conversation;
the cheapest crossing state splits it into two independent halves, and so on. That needs memory for two vectors at
a time instead of a table. Ties are broken by the forward side: beside its cost each state carries the rank of its least edit
string among the four. Strings that end in different states at one row never begin with one another, so ranks decide
all later comparisons.

On Spark: equal rows of a turn become one row with a count before any shuffle, one range sort brings the rows into order,
and a pass over it solves what lies in one piece. A conversation that reaches over a border of a sort task, or is longer than a
piece, is cut into pieces; each gives its 4 x 4 table of costs, the same divide and conquer over those tables finds the states
at the borders, and then every piece is solved by itself. No task holds more than one piece of a conversation's text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickledger.llm.base import rebatched
from tickledger.workspace import pin

WHITE = " \t\n\x0b\x0c\r"
BATCH_ROWS = 1024
#: A piece of a conversation ends after so many rows or characters.
PIECE_ROWS = 4096
PIECE_CHARS = 1 << 22
LARGEST = 2**63 - 1
#: What may come next in each state, and where it leads.
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (2, 2, 3, 2)
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
LEGAL = {"su", "ua", "au"}
#: Cost and edits from each state to the end.
ENDINGS = ((0, ""), (4, "II"), (2, "I"), (0, ""))

# ---------------------------------------------------------------- the automaton

#: A step from each state to each: None or (cost, order key). The key of a row is its edit string, that of a piece a rank.
Table = tuple[tuple[tuple | None, ...], ...]
#: Per state None or (cost, rank of the least edit string that leads there).
Vector = tuple[tuple[int, int] | None, ...]


@lru_cache(maxsize=None)
def row_table(kind: str) -> Table:
    """Steps over one row: `x` must go, else its initial (`o` for others), upper case where it is truncated."""
    table = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        at = state
        for inserts in range(3):
            ways = [(at, 3, "D")]
            if kind != "x":
                late = kind.isupper()
                ways.append((NEXT_STATE[at], 2 + late, "R"))
                if (at, kind.lower()) in KEEPS:
                    ways.append((KEEPS[at, kind.lower()], 0 + late, "K"))
            for to, cost, edit in ways:
                best[to] = min(best.get(to, (LARGEST, "")), (2 * inserts + cost, "I" * inserts + edit))
            at = NEXT_STATE[at]
        table.append(tuple(best.get(q) for q in range(4)))
    return tuple(table)


def _forward(vector: Vector, table: Table) -> Vector:
    best: list = [None] * 4
    for p, reached in enumerate(vector):
        if reached is not None:
            for q, step in enumerate(table[p]):
                if step is not None:
                    way = (reached[0] + step[0], (reached[1], step[1]))
                    if best[q] is None or way < best[q]:
                        best[q] = way
    order = sorted(x[1] for x in best if x is not None)
    return tuple(None if x is None else (x[0], order.index(x[1])) for x in best)


def _backward(costs: tuple, table: Table) -> tuple:
    """Cost to the target from each state before `table`, from the costs after it."""
    return tuple(min((step[0] + costs[q] for q, step in enumerate(table[p]) if step is not None and costs[q] is not None), default=None) for p in range(4))


@lru_cache(maxsize=65536)
def _row_forward(vector: Vector, kind: str) -> tuple[int, Vector]:
    """One row, from costs relative to the least one; those recur, so almost every step is looked up."""
    made = _forward(vector, row_table(kind))
    least = min(x[0] for x in made if x is not None)
    return least, tuple(None if x is None else (x[0] - least, x[1]) for x in made)


@lru_cache(maxsize=65536)
def _row_backward(costs: tuple, kind: str) -> tuple[int, tuple]:
    made = _backward(costs, row_table(kind))
    least = min(x for x in made if x is not None)
    return least, tuple(None if x is None else x - least for x in made)


def _run(step, vector, kind: str, n: int) -> tuple[int, tuple]:
    """`n` equal rows; once a step only adds to all costs, the rest is a product."""
    total = 0
    while n:
        added, after = step(vector, kind)
        if after == vector:
            return total + n * added, vector
        total, vector, n = total + added, after, n - 1
    return total, vector


def start_at(state: int) -> Vector:
    return tuple((0, 0) if s == state else None for s in range(4))


def end_at(state: int) -> tuple:
    return tuple(0 if s == state else None for s in range(4))


class Rows:
    """Rows of a piece as (kind, how many equal ones)."""

    def __init__(self, items: Sequence[tuple[str, int]]):
        self.items = items

    def __len__(self) -> int:
        return len(self.items)

    def forward(self, vector: Vector, low: int, high: int) -> tuple[int, Vector]:
        total = 0
        for kind, n in self.items[low:high]:
            added, vector = _run(_row_forward, vector, kind, n)
            total += added
        return total, vector

    def backward(self, costs: tuple, low: int, high: int) -> tuple:
        for kind, n in reversed(self.items[low:high]):
            _, costs = _run(_row_backward, costs, kind, n)
        return costs

    def table(self) -> Table:
        """Steps over all rows, from each state."""
        out = []
        for state in range(4):
            total, vector = self.forward(start_at(state), 0, len(self.items))
            out.append(tuple(None if x is None else (x[0] + total, x[1]) for x in vector))
        return tuple(out)


class Pieces(Rows):
    """Pieces of a conversation, by their tables."""

    def forward(self, vector: Vector, low: int, high: int) -> tuple[int, Vector]:
        for table in self.items[low:high]:
            vector = _forward(vector, table)
        return 0, vector

    def backward(self, costs: tuple, low: int, high: int) -> tuple:
        for table in reversed(self.items[low:high]):
            costs = _backward(costs, table)
        return costs


def crossings(line: Rows, first: int, last: int) -> list[int]:
    """States before each item and after the last one on the cheapest, ASCII-least way from `first` to `last`."""
    states = [first] * (len(line) + 1)
    states[-1] = last
    open_ = [(0, len(line))]
    while open_:
        low, high = open_.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        _, ahead = line.forward(start_at(states[low]), low, middle)
        behind = line.backward(end_at(states[high]), middle, high)
        states[middle] = min((a[0] + b, a[1], s) for s, (a, b) in enumerate(zip(ahead, behind, strict=True)) if a is not None and b is not None)[2]
        open_ += [(low, middle), (middle, high)]
    return states


def last_state(line: Rows) -> tuple[int, int]:
    """State after the last item and the cost of the whole conversation."""
    total, vector = line.forward(start_at(0), 0, len(line))
    cost, _, state = min((x[0] + ENDINGS[s][0], x[1], s) for s, x in enumerate(vector) if x is not None)
    return state, total + cost


def edits(items: Sequence[tuple[str, int]], first: int, last: int) -> list[str]:
    """Edit string of each item of a piece on the way from state `first` to `last`."""
    states = crossings(Rows(items), first, last)
    return ["D" * (n - 1) + row_table(kind)[p][q][1] for (kind, n), p, q in zip(items, states, states[1:], strict=False)]


@lru_cache(maxsize=100_000)
def _whole(items: tuple[tuple[str, int], ...]) -> tuple[int, tuple[str, ...]]:
    state, cost = last_state(Rows(items))
    return cost, (*edits(items, 0, state), ENDINGS[state][1])


# ---------------------------------------------------------------- pieces


class Piece:
    """Consecutive rows of one conversation and what is counted of them."""

    def __init__(self, conv, part: int, chunk: int, most_rows: int):
        self.conv, self.part, self.chunk, self.most_rows = conv, part, chunk, most_rows
        self.kinds: list[tuple[str, int]] = []
        self.lines: list[tuple[str, str]] = []  # role and text of rows that may stay
        self.chars = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, copies: int, new: bool) -> None:
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += copies - 1  # a pair of equal initials is never legal
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        seen = text.rstrip(WHITE)
        if not seen:
            self.blank += copies
            self._must_go(copies)
            return
        if new:
            late = seen[-1] not in ".!?"
            self.truncated += late
            kind = initial if initial in ("s", "u", "a") else "o"
            self.kinds.append((kind.upper() if late else kind, 1))
            self.lines.append((role, text))
            self.chars += len(role) + len(text)
        self.duplicate += copies - new
        self._must_go(copies - new)

    def _must_go(self, n: int) -> None:
        if n:
            self.kinds.append(("x", n))

    def full(self) -> bool:
        return len(self.kinds) >= self.most_rows or self.chars >= PIECE_CHARS

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, LARGEST)


def repaired_text(kinds: Sequence[tuple[str, int]], lines: Sequence[tuple[str, str]], steps: Sequence[str], state: int) -> str:
    """The rows that the edits leave or make, `role:text`, one after the other."""
    out, at = [], 0
    for (kind, _), step in zip([*kinds, ("x", 0)], steps, strict=False):
        for edit in step:
            if edit == "I":
                out.append(f"{NEXT_ROLE[state]}:")
                state = NEXT_STATE[state]
            elif edit == "R":
                out.append(f"{NEXT_ROLE[state]}:{lines[at][1]}")
                state = NEXT_STATE[state]
            elif edit == "K":
                out.append(":".join(lines[at]))
                state = KEEPS[state, kind.lower()]
        at += kind != "x"
    return "\n".join(out)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SUMMARY = [("n_blank", pa.int64()), ("n_duplicate", pa.int64()), ("n_truncated", pa.int64()), ("n_illegal", pa.int64()), ("n_turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("steps", pa.list_(pa.int64()))]
_BODY = [("kinds", pa.string()), ("runs", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
_RESULT = [*[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired", pa.string())]
_SPARK = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}


def _form(fields) -> str:
    return ", ".join(f"`{name}` {_SPARK[kind]}" for name, kind in fields)


def _batch(rows: list[dict], conv: pa.DataType, *fields: list) -> pa.RecordBatch:
    kinds = [("conv", conv), ("part", pa.int32()), ("chunk", pa.int32()), ("whole", pa.bool_()), *[f for group in fields for f in group]]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kind) for name, kind in kinds], schema=pa.schema(kinds))


def _finished(piece: Piece) -> dict:
    cost, steps = _whole(tuple(piece.kinds))
    counts = {"gaps": piece.gaps(), "blank": piece.blank, "duplicate": piece.duplicate, "truncated": piece.truncated, "illegal": piece.illegal, "cost": cost}
    return {"conv": piece.conv, "part": piece.part, "chunk": piece.chunk, "whole": True, **counts, "audit": "".join(steps), "repaired": repaired_text(piece.kinds, piece.lines, steps, 0)}


def _unfinished(piece: Piece) -> dict:
    steps = [x for row in Rows(piece.kinds).table() for step in row for x in (step or (-1, -1))]
    counted = {f"n_{c}": getattr(piece, c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    body = {"kinds": "".join(k for k, _ in piece.kinds), "runs": [n for _, n in piece.kinds], "roles": [r for r, _ in piece.lines], "texts": [t for _, t in piece.lines]}
    edges = {c: getattr(piece, c) for c in ("low", "high", "first", "last")}
    return {"conv": piece.conv, "part": piece.part, "chunk": piece.chunk, "whole": False, "steps": steps, **counted, **edges, **body}


def _ordered(rows: DataFrame, every: DataFrame) -> DataFrame:
    """Rows of all conversations in order: for each a first row of its own, then its rows, each behind its mark if it is new."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumn("digest", digest)
    # the digest follows from role and text, so grouping by the three is grouping by the texts
    merged = rows.groupBy("conv", "turn", "role", "digest", "text").agg(F.sum("copies").alias("copies"))
    here = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    marks = rows.groupBy("conv", "role", "digest").agg(F.min(here).alias("at")).select("conv", F.col("at.turn").alias("turn"), "role", "digest")

    def shaped(part: DataFrame, rank: int, kind: int) -> DataFrame:
        made = {"turn": "long", "role": "string", "digest": "binary", "text": "string", "copies": "long"}
        columns = [F.col(c).cast(t).alias(c) if c in part.columns else F.lit(None).cast(t).alias(c) for c, t in made.items()]
        return part.select("conv", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), *columns)

    together = shaped(every.distinct(), 0, 0).unionByName(shaped(marks, 1, 1)).unionByName(shaped(merged, 1, 2))
    place = ["conv", "rank", "turn", "role", "digest"]
    return together.repartitionByRange(*place).sortWithinPartitions(*place, "kind").drop("digest", "rank")


def _cut(rows: DataFrame, piece_rows: int) -> DataFrame:
    """One row for each conversation that lies in one piece, and one for each piece of the others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk = TaskContext.get().partitionId(), 0
        piece, alone, new = None, False, False
        out, conv_type = [], None
        for batch in rebatched(batches, BATCH_ROWS):
            conv_type = batch.schema.field("conv").type
            for row in batch.to_pylist():
                if piece is None or row["conv"] != piece.conv:
                    if piece is not None:
                        out.append(_finished(piece) if alone else _unfinished(piece))
                        alone = True  # only the first conversation of a task may have begun before it
                        chunk += 1
                    piece = Piece(row["conv"], part, chunk, piece_rows)
                elif piece.full():
                    out.append(_unfinished(piece))
                    alone = False
                    chunk += 1
                    piece = Piece(row["conv"], part, chunk, piece_rows)
                if row["kind"] == 1:
                    new = True
                elif row["kind"] == 2:
                    piece.add(row["turn"], row["role"], row["text"], row["copies"], new)
                    new = False
            yield _batch(out, conv_type, _SUMMARY, _BODY, _RESULT)
            out = []
        if piece is not None:
            yield _batch([_unfinished(piece)], conv_type, _SUMMARY, _BODY, _RESULT)

    conv = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv {conv}, part int, chunk int, whole boolean, {_form([*_SUMMARY, *_BODY, *_RESULT])}")


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Runs of rows with one `conv`, each to be read before the next."""

    def rows() -> Iterator[dict]:
        for batch in rebatched(batches, BATCH_ROWS):
            yield from batch.to_pylist()

    ahead = rows()
    row = next(ahead, None)
    while row is not None:
        conv = row["conv"]

        def members() -> Iterator[dict]:
            nonlocal row
            while row is not None and row["conv"] == conv:
                yield row
                row = next(ahead, None)

        yield conv, members()


def _by_conversation(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("conv").sortWithinPartitions("conv", "part", "chunk")


def _bordered(pieces: DataFrame) -> DataFrame:
    """For each piece the states at its two ends, whether it is the last one, and its conversation's counts."""
    fields = [("before", pa.int64()), ("after", pa.int64()), ("ending", pa.string()), *[(c, pa.int64()) for c in COUNTS]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type = None

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal conv_type
            for batch in batches:
                conv_type = batch.schema.field("conv").type
                yield batch

        for _, members in _groups(noted()):
            held = list(members)
            tables = [tuple(tuple(None if m["steps"][8 * p + 2 * q] < 0 else (m["steps"][8 * p + 2 * q], m["steps"][8 * p + 2 * q + 1]) for q in range(4)) for p in range(4)) for m in held]
            line = Pieces(tables)
            last, cost = last_state(line)
            states = crossings(line, 0, last)
            illegal, end, turns, high = sum(m["n_illegal"] for m in held), None, 0, None
            for m in held:
                if m["first"] is not None:
                    illegal += end is not None and end + m["first"] not in LEGAL
                    end = m["last"]
                turns += m["n_turns"] - (high is not None and m["low"] == high)
                high = m["high"] if m["high"] is not None else high
            low = next((m["low"] for m in held if m["low"] is not None), None)
            counts = {"gaps": 0 if low is None else min(high - low + 1 - turns, LARGEST), "illegal": illegal, "cost": cost}
            counts |= {c: sum(m[f"n_{c}"] for m in held) for c in ("blank", "duplicate", "truncated")}
            found = [{"conv": m["conv"], "part": m["part"], "chunk": m["chunk"], "whole": False, "before": p, "after": q, **counts, "ending": ""} for m, p, q in zip(held, states, states[1:], strict=False)]
            found[-1]["ending"] = ENDINGS[last][1]
            for start in range(0, len(found), BATCH_ROWS):
                yield _batch(found[start : start + BATCH_ROWS], conv_type, fields)

    conv = pieces.schema["conv"].dataType.simpleString()
    return _by_conversation(pieces).mapInArrow(run, f"conv {conv}, part int, chunk int, whole boolean, {_form(fields)}")


def _solved(pieces: DataFrame) -> DataFrame:
    """The pieces of cut conversations with their audit and repaired rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 1):
            m = batch.to_pylist()[0]
            kinds = list(zip(m["kinds"], m["runs"], strict=True))
            steps = [*edits(kinds, m["before"], m["after"]), m["ending"]]
            text = repaired_text(kinds, list(zip(m["roles"], m["texts"], strict=True)), steps, m["before"])
            row = {c: m[c] for c in ("conv", "part", "chunk", "whole", *COUNTS)} | {"audit": "".join(steps), "repaired": text}
            yield _batch([row], batch.schema.field("conv").type, _RESULT)

    conv = pieces.schema["conv"].dataType.simpleString()
    return pieces.mapInArrow(run, f"conv {conv}, part int, chunk int, whole boolean, {_form(_RESULT)}")


def repair(rows: DataFrame, every: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """`conv, part, chunk, whole`, the counts of the conversation, and `audit, repaired` of the piece.

    `rows` are (conv, turn, role, text, copies) of any conversations, `every` lists (conv) all ids that are to have a
    result; one without rows gets zeros and an empty audit. A conversation is one row with `whole`, or its pieces in the order of
    (part, chunk), with the counts in each. `repaired` holds its rows as `role:text`, joined by line feeds. Null ids
    are one conversation, null turns come first, rows of one turn are ordered by role and by SHA-256 of role and text,
    nulls in role and text must have been replaced. A later row with the same role and text counts as repeated, a text without anything but white
    space as blank, whatever its length. Empty tables give no rows.
    """
    cut = pin(_cut(_ordered(rows, every), piece_rows), "conversations")
    result = ["conv", "part", "chunk", "whole", *COUNTS, "audit", "repaired"]
    pieces = cut.where("not whole")
    borders = pin(_bordered(pieces.select("conv", "part", "chunk", *[name for name, _ in _SUMMARY])), "conversation-borders")
    bodies = pieces.select("part", "chunk", *[name for name, _ in _BODY])
    solved = _solved(borders.join(bodies, ["part", "chunk"]))
    return cut.where("whole").select(*result).unionByName(solved.select(*result))


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation: its counts, whole audit, and SHA-256 of its repaired rows.

    The pieces of a cut conversation pass through one task in order, one after the other, as the hash needs them.
    """
    counts = list(COUNTS)
    pieces = pin(pieces, "conversation-pieces")
    whole = pieces.where("whole").select("conv", *counts, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))
    fields = [*[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type = None

        def small() -> Iterator[pa.RecordBatch]:
            nonlocal conv_type
            for batch in rebatched(batches, 1):
                conv_type = batch.schema.field("conv").type
                yield batch

        for _, members in _groups(small()):
            sha, audit, row, begun = hashlib.sha256(), [], None, False
            for row in members:
                if row["repaired"]:
                    sha.update(("\n" if begun else "").encode() + row["repaired"].encode("utf-8"))
                    begun = True
                audit.append(row["audit"])
                last = row
            yield _batch([{**last, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], conv_type, fields)

    conv = pieces.schema["conv"].dataType.simpleString()
    joined = _by_conversation(pieces.where("not whole")).mapInArrow(run, f"conv {conv}, part int, chunk int, whole boolean, {_form(fields)}")
    return whole.unionByName(joined.select(*whole.columns))


def _or_space(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, copies) of `conversations` with faults drawn by a hash of id and turn; nulls are one space."""
    key = F.concat(_or_space(F.col("conv_id")), F.lit(":"), _or_space(F.col("turn")))
    rows = conversations.select(
        F.col("conv_id").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        _or_space(F.col("role")).alias("role"),
        _or_space(F.col("text")).alias("text"),
        (F.crc32(F.encode(key, "utf-8")) % 20).alias("fault"),
    ).where("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"))
