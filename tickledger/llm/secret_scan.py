"""Secrets in whole texts: keyword, key id and hex rules, and multipart credentials linked by position.

Three strong rules stand alone (`assign`, `access`, `hex`). Three weak kinds are only candidates: an access
identifier (`weak_id`), a secret-like string (`weak_secret`) and a service endpoint (`endpoint`).
A scope of SCOPE code points to both sides of a span makes an interval; candidates join with the intervals of
the complementary parts of their own text, and one is reported only where

* an identifier has a secret in reach,
* a secret has an identifier or an endpoint in reach,
* an endpoint has an identifier or a secret in reach.

Strong spans count as parts too: `access` as identifier, `assign` and `hex` as secrets. Two parts link only
if they lie apart, so that no string is both. An endpoint's part is its host and path: a user or parameter in the same
URL may link with it, and nothing within host and path is a secret. The join
merges sorted intervals by their nearest neighbours, so no pairs are formed, however many parts a text has.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickledger.llm.base import rebatched

SCOPE = 200
BATCH_ROWS = 256
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "weak_id", "weak_secret", "endpoint")
SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint>>"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# Keywords and patterns of the strong rules.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(f"(?:{'|'.join(map(_either_case, KEYWORDS))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WEAK_ID = re.compile(r"(?<![A-Za-z0-9])A[A-Z]{3}[A-Z0-9]{12,124}", re.ASCII)
NAMED_ID = re.compile(r"(?<![A-Za-z0-9])(?i:client|account|user|key)[_-]?(?i:id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}", re.ASCII)
ID_NAMES = ("client", "account", "user", "key")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]+", re.ASCII)
#: Host and path of a URL, after the user that may stand before the host; URLs may hold others as parameters.
LOCATION = re.compile(r"://(?:[^\s\"'<>/?#@]*@)*([^\s\"'<>?#]*)")
INNER_LOCATION = re.compile(r"://([^\s\"'<>?#&]*)")
#: Pieces of names: a file path or a branch consists of them, of random characters about a third lies in one.
WORD = re.compile(r"[A-Z]?[a-z]{2,}")
MOST_IN_WORDS = 0.8
MIXED = (re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]"))


def find(text: str) -> list[tuple[int, int, int]]:
    """Strong spans and linked weak ones as (start, kind, end), in that order; kinds count as in KINDS."""
    spans: list[tuple[int, int, int]] = []
    folded = text.lower()
    if any(h in folded for h in HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += linked(spans, weak(text, folded, spans), place=lambda x: location(text, x) if x[1] == 5 else (x[0], x[2]))
    return sorted(spans)


def location(text: str, endpoint: tuple[int, int, int]) -> tuple[int, int]:
    """Where the scheme, host and path of an endpoint lie; the host and path alone if a user stands before them."""
    start, _, end = endpoint
    found = LOCATION.search(text, start, end)
    return (found.start(1) if found.start(1) > found.start() + 3 else start), found.end(1)


def weak(text: str, folded: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates outside the strong spans."""
    out = []
    if "://" in text:
        out += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    out += [(m.start(), 3, m.end()) for m in WEAK_ID.finditer(text)]
    if ("=" in text or ":" in text) and any(name in folded for name in ID_NAMES):
        out += [(m.start(), 3, m.end()) for m in NAMED_ID.finditer(text)]
    if out or any(kind == 1 for _, kind, _ in strong):  # a secret with neither identifier nor endpoint is never reported
        paths = sorted(p for x in out if x[1] == 5 for p in locations(text, x))
        ends = [e for _, e in paths]

        def in_path(start: int, end: int) -> bool:
            k = bisect_right(ends, start)
            return k < len(paths) and paths[k][0] < end

        out += [(m.start(), 4, m.end()) for m in WEAK_SECRET.finditer(text) if looks_random(m[0]) and not in_path(m.start(), m.end())]
    covered = sorted((s, e) for s, _, e in strong)
    starts = [s for s, _ in covered]
    reach = []  # the furthest end of all strong spans up to each
    for _, e in covered:
        reach.append(max(e, reach[-1] if reach else 0))

    def free(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return not k or reach[k - 1] <= start

    return [x for x in out if free(x[0], x[2])]


def looks_random(found: str) -> bool:
    """Three kinds of characters, and letters and digits that are not mostly words."""
    letters = sum(map(str.isalnum, found))
    return all(x.search(found) for x in MIXED) and sum(map(len, WORD.findall(found))) < MOST_IN_WORDS * letters


def locations(text: str, endpoint: tuple[int, int, int]) -> list[tuple[int, int]]:
    """Hosts and paths of an endpoint and of the URLs among its parameters; they do not overlap."""
    start, end = location(text, endpoint)
    return [(start, end), *[m.span(1) for m in INNER_LOCATION.finditer(text, end, endpoint[2])]]


def linked(strong: list[tuple[int, int, int]], candidates: list[tuple[int, int, int]], scope: int = SCOPE, place: Callable[[tuple[int, int, int]], tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """The candidates that have a complementary part within `scope` code points.

    With `place`, a part lies where that says, and parts that overlap do not link.
    """
    role = {0: "secret", 1: "id", 2: "secret", 3: "id", 4: "secret", 5: "endpoint"}
    needs = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("id", "secret")}
    parts: dict[str, list[tuple[int, int]]] = {"id": [], "secret": [], "endpoint": []}
    where = place or (lambda x: (x[0], x[2]))
    for x in {*strong, *candidates}:
        parts[role[x[1]]].append(where(x))
    furthest, last = {}, {}
    for name, found in parts.items():
        found.sort()
        last[name] = sorted(end for _, end in found)
        ends, most = [], 0
        for _, end in found:
            most = max(most, end)
            ends.append(most)
        furthest[name] = ends

    def meets(name: str, start: int, end: int) -> bool:
        """Of the parts that begin before the scope's end, does one end within or after its start?"""
        k = bisect_left(parts[name], (end + scope, -1))
        return bool(k) and furthest[name][k - 1] > start - scope

    def beside(name: str, start: int, end: int) -> bool:
        """Does the nearest part that ends before the start, or that begins after the end, lie within the scope?"""
        before, after = bisect_right(last[name], start), bisect_left(parts[name], (end, -1))
        return (before > 0 and last[name][before - 1] > start - scope) or (after < len(parts[name]) and parts[name][after][0] < end + scope)

    holds = beside if place else meets
    return [x for x in candidates if any(holds(n, *where(x)) for n in needs[role[x[1]]])]


def scan(docs: DataFrame, text: str = "text", secrets: str = "secrets") -> DataFrame:
    """All columns of `docs` and `secrets`, the spans of the whole text by start, then kind.

    Code points, end exclusive. A null text counts as empty; a text without secrets has an empty array; rows
    that repeat are scanned each. A column already named like `secrets` is replaced. No shuffle.
    """
    carried = docs.select(F.struct(*[docs[c] for c in docs.columns if c != secrets]).alias("row"), docs[text].alias("value"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, BATCH_ROWS):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(x or "")] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], names=["row", "value"])

    row_type = carried.schema["row"].dataType.simpleString()
    return carried.mapInArrow(run, f"row {row_type}, value {SPAN_TYPE}").select("row.*", F.col("value").alias(secrets))


def redact(scanned: DataFrame, text: str = "text", secrets: str = "secrets", mark: str = "[secret]") -> DataFrame:
    """`scanned` with every span replaced by `mark` in its text (overlapping spans by one), without `secrets`.

    Built from SQL functions: the spans are merged from left to right and the text between them is kept.
    """
    merged = F.aggregate(
        secrets,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substr(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
    )
    changed = F.when(F.size(secrets) > 0, F.concat(merged["out"], F.substr(F.col(text), (merged["at"] + 1).cast("int"), F.length(text)))).otherwise(F.col(text))
    return scanned.select(*[changed.alias(c) if c == text else F.col(c) for c in scanned.columns if c != secrets])

