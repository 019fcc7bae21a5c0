"""Byte-level BPE by a deterministic tokenization automaton.

The automaton reads tokens. It starts as one state with an arc for each byte. Every merge x y -> z,
in rank order, then adds one gadget:

* the state after z starts as the state after y, and whatever may be followed by x may be followed by z;
* the state after x loses its arc for y (it is split off first where other tokens share it).

When all merges are in, the automaton accepts exactly the token sequences that merging produces, and of all
ways to cut a word into tokens only one is accepted. States and arcs are shared by classes of tokens, so
the whole table is a bit matrix of some ten thousand rows and columns: its size follows the
vocabulary, not the data.

Encoding runs a word through the tables from left to right. What precedes a position has one accepted
cut, of which only the last token matters; a token that begins there and that this last token has an arc for
ends the one accepted cut of a longer prefix. So each position gets its last token once, nothing is
taken back, and the tokens are read off from the end. New words of a batch take these steps together.
Decoding writes out the bytes that label each arc.
"""

from __future__ import annotations

import json
import random
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickledger.llm.base import rebatched

# Fixed value: the pre-split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of words and ids that a task remembers, Python's own cost included.
MEMORY = 64 << 20
#: Words up to this length in bytes run together, this many at once; longer ones run alone.
SHORT_WORD, WORDS_AT_ONCE = 64, 4096
#: Characters of texts that are split before their new words are encoded.
TEXT_AT_ONCE = 1 << 20
BATCH_ROWS = 256


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Automaton:
    """Tables of the compiled automaton: row `state_of[t]` of `bits` has a bit for each token class that may follow t.

    The labels of its arcs are a trie: from `node`, byte b leads to `target[base[node] + b]` where `owner` there is `node`.
    """

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], added: dict[str, int]):
        self.labels, self.added = labels, added
        row, column, self.bits, live = _compile(len(labels), merges, [len(x) for x in labels], set(added.values()))
        self.state_of, self.class_of = np.array(row, np.int32), np.array(column, np.int32)
        self.lengths = np.array([len(x) for x in labels], np.int32)
        self.base, self.owner, self.target, self.token = _trie({labels[t]: t for t in live})

    def encode_word(self, word: bytes) -> np.ndarray:
        """The accepted tokens of one pre-split word; time is linear in its length, for the longest label at most."""
        base, owner, target, token = (memoryview(x) for x in (self.base, self.owner, self.target, self.token))
        state_of, class_of, bits = memoryview(self.state_of), memoryview(self.class_of), memoryview(self.bits)
        n = len(word)
        last = array("i", [-1]) * (n + 1)
        for start in range(n):
            before, node, end = last[start], 0, start
            if start and before < 0:
                continue
            state = state_of[before] if start else 0
            while end < n:
                slot = base[node] + word[end]
                if owner[slot] != node:
                    break
                node, end = target[slot], end + 1
                found = token[node]
                if found >= 0 and (not start or bits[state, class_of[found] >> 3] >> (class_of[found] & 7) & 1):
                    last[end] = found
        out, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError("the vocabulary has no tokens for some part of the text")
            out.append(last[at])
            at -= len(self.labels[last[at]])
        return np.array(out[::-1], "<u4")

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers; short ones run through the tables together."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        short = sum(len(word) <= SHORT_WORD for word in words)
        for i in order[short:]:
            out[i] = self.encode_word(words[i]).tobytes()
        for at in range(0, short, WORDS_AT_ONCE):
            taken = order[at : min(short, at + WORDS_AT_ONCE)]
            tokens = self._run([words[i] for i in taken])
            used = tokens >= 0
            ids, ends = tokens[used].astype("<u4").tobytes(), (4 * np.cumsum(used.sum(axis=1))).tolist()
            for i, start, end in zip(taken, [0, *ends], ends):
                out[i] = ids[start:end]
        return out

    def _run(self, words: list[bytes]) -> np.ndarray:
        """For words from the shortest to the longest, a row each: the token that starts at each byte, -1 inside tokens."""
        sizes = np.array([len(word) for word in words])
        n, width = len(words), int(sizes[-1])
        text = np.frombuffer(b"".join([word.ljust(width, b"\0") for word in words]), np.uint8).reshape(n, width)
        columns = np.ascontiguousarray(text.T)
        # last[e]: the last token of the accepted cut of each word's first e bytes
        last = np.full((width + 1, n), -1, np.int32)
        for start in range(width):
            rows = np.arange(np.searchsorted(sizes, start, "right"), n)
            if start:
                rows = rows[last[start][rows] >= 0]
            states = self.state_of[last[start][rows]]
            nodes = np.zeros(len(rows), np.int32)
            for end in range(start, width):
                slots = self.base[nodes] + columns[end][rows]
                on = np.flatnonzero(self.owner[slots] == nodes)
                if not len(on):
                    break
                if len(on) < len(rows):
                    rows, states, slots = rows[on], states[on], slots[on]
                nodes = self.target[slots]
                found = self.token[nodes]
                fits = found >= 0
                if start:
                    kinds = self.class_of[found]
                    fits &= (self.bits[states, kinds >> 3] >> (kinds & 7) & 1).astype(bool)
                last[end + 1][rows[fits]] = found[fits]
        tokens = np.full((n, width), -1, np.int32)
        rows, ends = np.flatnonzero(sizes), sizes[sizes > 0]
        while len(rows):
            found = last[ends, rows]
            if (found < 0).any():
                raise ValueError("the vocabulary has no tokens for some part of the text")
            ends = ends - self.lengths[found]
            tokens[rows, ends] = found
            rows, ends = rows[ends > 0], ends[ends > 0]
        return tokens


def _trie(token_of: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All labels as one table: every node gets a place at which the slots of all its bytes are free."""
    node_of, children = {b"": 0}, [[]]
    for label in token_of:
        for i in range(1, len(label) + 1):
            if label[:i] not in node_of:
                node_of[label[:i]] = len(children)
                children[node_of[label[: i - 1]]].append((label[i - 1], len(children)))
                children.append([])
    size = 4 * len(children) + 256
    base, token = np.zeros(len(children), np.int32), np.full(len(children), -1, np.int32)
    owner, target = np.full(size + 256, -1, np.int32), np.zeros(size + 256, np.int32)
    for label, t in token_of.items():
        token[node_of[label]] = t
    taken = bytearray(size + 256)
    draw = random.Random(len(children))
    for node in sorted(range(len(children)), key=lambda i: -len(children[i])):
        place = draw.randrange(size)
        while any(taken[place + byte] for byte, _ in children[node]):
            place = draw.randrange(size)
        base[node] = place
        for byte, child in children[node]:
            taken[place + byte], owner[place + byte], target[place + byte] = 1, node, child
    return base, owner, target, token


def decode_ids(labels: list[bytes], ids: bytes) -> str:
    """Text of little-endian 32-bit ids, the labels of their arcs; bytes that are no UTF-8 become U+FFFD."""
    return b"".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _compile(size: int, merges: list, lengths: list[int], added: set[int]):
    """Add the merges' gadgets one by one; returns state and arc class of each token, the bit matrix, live tokens."""
    bytes_ = [t for t in range(size) if lengths[t] == 1 and t not in added]
    rows, columns = 1 + _splits(bytes_, merges, 0), 1 + _splits(bytes_, merges, 1)
    bits = np.zeros((rows, (columns + 7) // 8), np.uint8)
    state_of, class_of = [0] * size, [0] * size
    bits[0, 0] = 1
    in_state, in_class = Counter({0: len(bytes_)}), Counter({0: len(bytes_)})
    n_states = n_classes = 1
    live = set(bytes_)
    for x, y, z in merges:
        state, kind = state_of[x], class_of[y]
        if x not in live or y not in live or not bits[state, kind >> 3] >> (kind & 7) & 1:
            continue  # no sequence has x before y at this rank, so the merge never applies
        live.add(z)
        state_of[z], class_of[z] = state_of[y], class_of[x]
        in_state[state_of[z]] += 1
        in_class[class_of[z]] += 1
        if in_state[state_of[x]] > 1:
            in_state[state_of[x]] -= 1
            bits[n_states] = bits[state_of[x]]
            state_of[x] = n_states
            in_state[n_states] = 1
            n_states += 1
        for token in (y, z) if x == y else (y,):
            kind = class_of[token]
            if in_class[kind] > 1:
                in_class[kind] -= 1
                copied = bits[:n_states, kind >> 3] >> (kind & 7) & 1
                bits[:n_states, n_classes >> 3] |= copied << (n_classes & 7)
                class_of[token] = n_classes
                in_class[n_classes] = 1
                n_classes += 1
            # x y is now z; and of x x x the first two merge, so z does not follow x
            kind = class_of[token]
            bits[state_of[x], kind >> 3] &= ~np.uint8(1 << (kind & 7))
    return state_of, class_of, bits[:n_states, : (n_classes + 7) // 8].copy(), live


def _splits(bytes_: list[int], merges: list, side: int) -> int:
    """An upper bound of the splits: one for each merge's left (or right) part, twice where both parts are one."""
    return len({m[side] for m in merges}) + sum(m[0] == m[1] for m in merges) + _reshared(merges, side)


def _reshared(merges: list, side: int) -> int:
    """How often a part is split off anew because a token made meanwhile joined it."""
    shared: set[int] = set()
    n = 0
    for m in merges:
        if m[side] in shared:
            n += 1
            shared.discard(m[side])
        shared.add(m[1 - side])
        shared.add(m[side] if m[0] == m[1] else m[1 - side])
    return n


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """Compile a tokenizer file of byte-level BPE (a few seconds, on the driver, once)."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, splitter = spec["model"], spec["pre_tokenizer"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    if not plain or spec["normalizer"] or splitter["type"] != "ByteLevel" or splitter["add_prefix_space"] or not splitter["use_regex"]:
        raise ValueError(f"{path} is no plain byte-level BPE")
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    as_byte, vocabulary = byte_characters(), model["vocab"]
    labels = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
    for text, token in vocabulary.items():
        labels[token] = text.encode() if text in added else bytes(as_byte[c] for c in text)
    for text, token in added.items():
        labels[token] = text.encode()
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
    return Automaton(labels, merges, added)


class Encoder:
    """Encodes texts; words already seen are remembered, up to MEMORY bytes of them."""

    def __init__(self, tables: Automaton):
        self.tables = tables
        self.any = regex.compile(PATTERN)
        self.narrow = re.compile(_narrow_pattern())
        added = sorted(tables.added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.ids: dict[str, bytes] = {}
        self.held = 0

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text; strings of added tokens in it become those tokens."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """`encode` of each text, in order."""
        at = 0
        while at < len(texts):
            size, split = 0, []
            while at < len(texts) and (not split or size + len(texts[at]) <= TEXT_AT_ONCE):
                split.append(self._words(texts[at]))
                size += len(texts[at])
                at += 1
            self._learn(split)
            for words in split:
                yield b"".join(map(self.ids.__getitem__, words))

    def _words(self, text: str) -> list[str]:
        """Pre-split words and added tokens of a text."""
        parts = self.added.split(text) if self.added and any(x in text for x in self.tables.added) else [text]
        out: list[str] = []
        for part in parts:
            if part in self.tables.added:
                out.append(part)
            elif part:
                try:
                    part.encode("latin-1")
                    out.extend(self.narrow.findall(part))
                except UnicodeEncodeError:
                    out.extend(self.any.findall(part))
        return out

    def _learn(self, split: list[list[str]]) -> None:
        new = set().union(*split).difference(self.ids)
        if self.held > MEMORY:
            self.ids, self.held = {}, 0
            new = set().union(*split)
        words = [w for w in new if w not in self.tables.added]
        ids = self.tables.encode_words([w.encode("utf-8") for w in words])
        self.ids.update(zip(words, ids))
        self.ids.update((w, self.tables.added[w].to_bytes(4, "little")) for w in new if w in self.tables.added)
        self.held += 200 * len(new) + sum(map(len, words)) + sum(map(len, ids))


def _narrow_pattern() -> str:
    """PATTERN for texts below U+0100, with its classes spelled out for the faster engine."""
    def members(kind: str) -> str:
        test = regex.compile(kind)
        return "".join(f"\\x{i:02x}" for i in range(256) if test.match(chr(i)))

    letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    return f" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all by default) and `ids`, the token ids of the whole text as little-endian 32-bit integers.

    No shuffle. A null text counts as empty and gives empty ids; a column already named like `ids` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton(path))

    def coder():
        # one for each task: a worker that goes on to other work holds no words
        tool = Encoder(shared.value)
        return lambda texts: tool.encode_all([x or "" for x in texts])

    return _mapped(docs, text, ids, pa.binary(), "binary", coder, keep)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all by default) and `text`, decoded from `ids`; null ids give an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton(path).labels)
    return _mapped(docs, ids, text, pa.string(), "string", lambda: lambda coded: (decode_ids(shared.value, x or b"") for x in coded), keep)


def _mapped(docs: DataFrame, source: str, target: str, arrow: pa.DataType, kind: str, make, keep: tuple[str, ...] | None) -> DataFrame:
    carried = docs.select(F.struct(*[docs[c] for c in keep or docs.columns if c != target]).alias("row"), docs[source].alias("value"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in rebatched(batches, BATCH_ROWS):
            out = pa.array(list(function(batch.column(1).to_pylist())), arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["row", "value"])

    row_type = carried.schema["row"].dataType.simpleString()
    made = carried.mapInArrow(run, f"row {row_type}, value {kind}")
    return made.select("row.*", F.col("value").alias(target))
