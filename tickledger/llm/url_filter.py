"""URL verdicts: host rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter has one row per block of 256 bits (eight 32-bit words); a URL sets one bit in each word
of the block that its hash picks, so a test touches a single row. Its number of blocks follows the list up
to MAX_BLOCKS, which bounds what is broadcast to 16 MB; a longer list lets more false candidates pass and
changes no result, because every candidate goes through an exact join with the list.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickledger.llm.base import ascii_lower
from tickledger.workspace import pin

KEYS_PER_BLOCK = 16
MAX_BLOCKS = 1 << 18
WORDS = 8

# Odd multipliers of the split-block Bloom filter, one for each word.
MULTIPLIERS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)

#: Query parameters that do not choose content, and host labels of the same site.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
SAME_SITE = "^(www|m)[.]"


@dataclass(frozen=True)
class Rule:
    """Applies to `host` and its subdomains where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """Up to `/`, `?`, `#` or the end, A-Z in lower case; empty for a null URL or one without `://`."""
    return ascii_lower(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; empty for a null URL or one without `://`."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for the addresses of one page; null where there is no host.

    Scheme, fragment, tracking parameters, `www.` or `m.`, a last `/` and `.html` go; what is left of
    the query is sorted.
    """
    host = F.regexp_replace(host_of(url), SAME_SITE, "")
    path = F.regexp_replace(path_of(url), r"(/|[.]html?)$", "")
    query = F.split(F.regexp_extract(_rest(url), r"^[^?#]*[?]([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules: Sequence[Rule], field: str = "name") -> Column:
    """The field of the longest rule that fits, the first of the given ones among equals; null without any."""
    found = None
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.lit(getattr(rule, field))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("string") if found is None else found


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 32), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """The bit that a key sets in one word."""
    low = key.bitwiseAND(F.lit(0x7FFFFFFF))  # the product stays within 63 bits
    product = (low * F.lit(MULTIPLIERS[word])).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(product, 27).cast("int"))


def blocks_of(listed: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter as rows `block, w0 .. w7`; partial aggregates hold one row per block and task."""
    key = F.xxhash64(column)
    words = listed.select(_block(key, blocks).alias("block"), *[_bit(key, w).alias(f"w{w}") for w in range(WORDS)])
    return words.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])


def filter_of(keys: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The filter of the distinct values of `column`, broadcast-sized, and its number of blocks."""
    blocks = min(MAX_BLOCKS, max(1, -(-keys.count() // KEYS_PER_BLOCK)))
    return F.broadcast(pin(blocks_of(keys, column, blocks), "bloom-filter")), blocks


def possible_hits(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose `column` may be among `keys`: all that are, and few others while the filter is below its bound."""
    filter_, blocks = filter_of(keys, key)
    hashed = F.xxhash64(column)
    hit = F.lit(True)
    for w in range(WORDS):
        hit = hit & (F.col(f"w{w}").bitwiseAND(_bit(hashed, w)) != 0)
    return rows.withColumn("probe_block", _block(hashed, blocks)).join(filter_, (F.col("probe_block") == F.col("block")) & hit).select(*rows.columns)


def probe(rows: DataFrame, column: str, filter_: DataFrame, blocks: int, name: str) -> DataFrame:
    """All rows and `name`, whether `column` passes the filter; a null never does."""
    hashed = F.xxhash64(column)
    hit = F.col(column).isNotNull()
    for w in range(WORDS):
        hit = hit & F.coalesce(F.col(f"w{w}").bitwiseAND(_bit(hashed, w)) != 0, F.lit(False))
    probed = rows.withColumn("probe_block", _block(hashed, blocks)).join(filter_, F.col("probe_block") == F.col("block"), "left")
    return probed.select(*[rows[c] for c in rows.columns], hit.alias(name))


def listed_in(pages: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """All rows and columns of `pages` and `listed`, whether `column` is in the one-column table `listed`.

    Rows that repeat stay; a null is never listed.
    """
    name = "listed_key"
    keys = pin(listed.select(F.col(listed.columns[0]).alias(name)).dropna().distinct(), "url-list")
    filter_, blocks = filter_of(keys, name)
    key = F.xxhash64(column)
    probed = pages.withColumn("probe_block", _block(key, blocks)).join(filter_, F.col("probe_block") == F.col("block"), "left")
    hit = F.col(column).isNotNull()
    for w in range(WORDS):
        hit = hit & F.coalesce(F.col(f"w{w}").bitwiseAND(_bit(key, w)) != 0, F.lit(False))
    probed = probed.select(*[pages[c] for c in pages.columns], F.when(hit, F.col(column)).alias("candidate"))
    # rows that the filter stops have no key to look up: they stay where they are and skip the join
    passed = probed.where("candidate is not null").join(keys, F.col("candidate") == F.col(name), "left")
    stopped = probed.where("candidate is null").select(*pages.columns, F.lit(False).alias("listed"))
    return passed.select(*pages.columns, F.col(name).isNotNull().alias("listed")).unionByName(stopped)


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """All columns of `pages` and `host`, `path`, `rule`, `verdict`.

    `listed` has one column of canonical URLs to block. A rule's verdict goes before the list's; without either
    a URL is allowed, so also a null, empty or malformed one. Rows that repeat are judged each; an empty list
    blocks nothing. Columns already named like a result are replaced.
    """
    made = ["host", "path", "rule", "verdict"]
    row = F.struct(*[pages[c] for c in pages.columns if c not in made]).alias("page_row")
    parts = pages.select(row, canonical(pages[url]).alias("page_key"), host_of(pages[url]).alias("page_host"), path_of(pages[url]).alias("page_path"))
    host, path = F.col("page_host"), F.col("page_path")
    verdict = F.coalesce(rule_of(host, path, rules, "verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return listed_in(parts, listed, "page_key").select("page_row.*", host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("rule"), verdict.alias("verdict"))
