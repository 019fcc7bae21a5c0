"""Conversation repair against a plain version: a table of cheapest edit strings, row by row."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tickledger.llm import dialog

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def after_damage(rows):
    """conv -> its rows after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        show = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        fault = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20
        role, text = show[2], show[3]
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        held.extend([(turn, role, text)] * (2 if fault == 3 else 1))
    for held in out.values():
        held.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    return out


def allowed(state, initial):
    return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, initial))


def plain(held):
    """Counts, cost, audit and repaired text of one conversation."""
    seen, kinds = set(), []
    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in held:
        last = text.rstrip(WHITE)[-1:]
        kind = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        if kind:
            counts[kind] += 1
        kinds.append(kind)
        seen.add((role, text))
    # state -> (cost, edits, lines): all ways over one row after the other, the least of each state
    ways = {0: (0, "", ())}

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for state, (cost, edits, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    to = allowed(state, role[0])
                    if to is not None:
                        way = (cost + 2, edits + "I", (*lines, f"{role}:"))
                        out[to] = min(out.get(to, way), way, key=lambda w: w[:2])
        return out

    for (_, role, text), kind in zip(held, kinds, strict=True):
        after = {}

        def take(to, way, after=after):
            if to is not None:
                after[to] = min(after.get(to, way), way, key=lambda w: w[:2])

        for state, (cost, edits, lines) in inserted(ways).items():
            take(state, (cost + 3, edits + "D", lines))
            if kind not in ("blank", "duplicate"):
                late = kind == "truncated"
                take(allowed(state, role[:1]), (cost + late, edits + "K", (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    take(allowed(state, new[0]), (cost + 2 + late, edits + "R", (*lines, f"{new}:{text}")))
        ways = after
    cost, edits, lines = min((w for s, w in inserted(ways).items() if s in (0, 3)), key=lambda w: w[:2])
    turns = [t for t, _, _ in held if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(held)]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **counts,
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": edits,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def found(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    pieces = dialog.repair(dialog.damaged(df), df.select(F.col("conv_id").alias("conv")))
    return {r["conv"]: {k: v for k, v in r.asDict().items() if k != "conv"} for r in dialog.digests(pieces).collect()}


def expected(rows):
    return {conv: plain(held) for conv, held in after_damage(rows).items()}


def made(rng, conversations, longest):
    out = []
    for conv in conversations:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", ""])
            text = rng.choice(["Yes.", "No!", "So it", "", " \t\n", "Why?", f"Number {rng.randrange(9)}.", "é" * rng.randrange(1, 5) + "."])
            out.append((conv, turn if rng.random() < 0.9 else None, role, text))
    return out


def test_random_conversations(spark):
    rows = made(random.Random(5), range(400), 12)
    assert found(spark, rows) == expected(rows)


@pytest.mark.parametrize("size", [1, 2, 7])
def test_pieces_of_any_size_give_the_same(spark, size):
    """Conversations cut into pieces: the same audits as in one piece."""
    rows = made(random.Random(6), [1, 2, 2, 2, 3, None], 40)
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = dialog.repair(dialog.damaged(df), df.select(F.col("conv_id").alias("conv")), piece_rows=size)
    assert pieces.where("not whole").count() > 60 / size
    got = {r["conv"]: {k: v for k, v in r.asDict().items() if k != "conv"} for r in dialog.digests(pieces).collect()}
    assert got == expected(rows)


def test_divide_and_conquer_finds_the_least_of_all_edit_strings():
    """Against every edit string, for short rows of every kind."""
    kinds = "xsuaoSUAO"
    rng = random.Random(1)
    lines = [tuple(rng.choice(kinds) for _ in range(rng.randrange(0, 5))) for _ in range(300)]

    def all_ways(line):
        best = None
        stack = [(0, 0, 0, "")]
        while stack:
            at, state, cost, edits = stack.pop()
            if best is not None and (cost, edits) > best:
                continue
            if at == len(line) and state in (0, 3):
                best = (cost, edits) if best is None else min(best, (cost, edits))
            if len(edits) - at < 6:
                for initial in "ua":
                    if allowed(state, initial) is not None:
                        stack.append((at, allowed(state, initial), cost + 2, edits + "I"))
            if at < len(line):
                kind = line[at]
                stack.append((at + 1, state, cost + 3, edits + "D"))
                if kind != "x":
                    late = kind.isupper()
                    if allowed(state, kind.lower()) is not None:
                        stack.append((at + 1, allowed(state, kind.lower()), cost + late, edits + "K"))
                    for initial in "ua":
                        if allowed(state, initial) is not None:
                            stack.append((at + 1, allowed(state, initial), cost + 2 + late, edits + "R"))
        return best

    for line in lines:
        cost, steps = dialog._whole(tuple((k, 1) for k in line))
        assert (cost, "".join(steps)) == all_ways(line), line


def test_one_conversation_with_most_rows_and_copies(spark):
    """A hot conversation, one row of it repeated thousands of times."""
    rng = random.Random(7)
    rows = [(9, 3, "user", "Same.")] * 5000 + [(9, t, rng.choice(["user", "assistant"]), f"Row {t}.") for t in range(5, 3000)]
    rows += made(rng, range(20, 60), 6)
    assert found(spark, rows) == expected(rows)


def test_edge_cases(spark):
    rows = [(None, None, None, None), (1, None, "user", None), (2, 5, "user", "x" * 300_000), (2, 2**62, "assistant", "."), (3, 0, "system", "Only.")]
    assert found(spark, rows) == expected(rows)
    assert found(spark, []) == {}
    dropped = next((7, t, "user", "Gone.") for t in range(99) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = found(spark, [dropped])[7]
    assert got["audit"] == "" and got["cost"] == 0 and got["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_clashing_columns_are_not_read(spark):
    rows = [(1, 1, "user", "Hi.", "x", 3), (1, 2, "assistant", "Ho.", "y", 4)]
    got = found(spark, rows, SCHEMA + ", conv string, copies long")
    assert got == expected([r[:4] for r in rows])
