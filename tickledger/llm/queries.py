"""The registered query of each operator and, where SQL can state its result, that SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickledger.llm import ann, bitplane, bpe, dialog, html_text, langid, minhash, packing, quality, secret_scan, suffix_dedup, url_filter, warc
from tickledger.llm.base import table
from tickledger.workspace import fresh_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


@query("op1_secret_scan")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))

    def text_of(spans) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count_of(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    counts = [count_of(kind).alias(f"n_{kind}") for kind in secret_scan.BASE]
    base = F.filter("secrets", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select("doc_id", *counts, F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("secrets")).alias("spans"))


@query("op2_vector_best_fit")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    cut = packing.pieces(table(spark, folder, "documents").select("doc_id", "text"), TOKENIZER, with_ids=False)
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op4_bpe_automaton")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(table(spark, folder, "documents"), TOKENIZER, keep=("doc_id",)), TOKENIZER)
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


#: Host rules of the URL query.
RULES = (
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
)

OP3_SQL = """
WITH parts AS (
  SELECT page_id, url,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), hosts AS (
  SELECT page_id, rest,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    list_filter(string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'),
      lambda p : p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)')) AS query
  FROM parts
), keys AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '(/|[.]html?)$', '')
    || CASE WHEN len(query) > 0 THEN '?' || array_to_string(list_sort(query), '&') ELSE '' END END AS key
  FROM hosts
), listed AS (
  SELECT DISTINCT key FROM keys JOIN labels ON try_cast(regexp_extract(path, '^/[a-z]+/([0-9]+)(/|[.]html)?$', 1) AS bigint) = doc_id
  WHERE toxic = 1 AND key IS NOT NULL
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM keys
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query("op3_blocked_bloom", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """The list: canonical addresses of pages whose document (the number in the path) is labelled toxic."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    number = F.regexp_extract(url_filter.path_of(F.col("url")), "^/[a-z]+/([0-9]+)(/|[.]html)?$", 1)
    toxic = table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    numbered = pages.select(url_filter.canonical(F.col("url")).alias("key"), number.alias("digits"))
    numbered = numbered.selectExpr("key", "try_cast(digits as bigint) as doc_id")
    listed = numbered.join(toxic, "doc_id", "left_semi").select("key")
    return url_filter.judge(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


#: Five hexadecimal digits of a SHA-1 are four digits in base 32.
OP5_SQL = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), last_of AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS last_id FROM payloads
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i : substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM last_of"""


@query("op5_warc_shards", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    root = fresh_path(spark, "warc")
    warc.write(table(spark, folder, "pages").select("page_id", "url", "html"), root)
    back = warc.read(spark, root, with_payload=False)
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_layout_text")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages").select("page_id", "html")).select("page_id", "text")


@query("op7_hierarchical_language")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    hidden = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~hidden).select("text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", hidden.alias("held_out"), "lang_pred", "score")


@query("op8_covariance_outliers")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.judged(docs, keep=("doc_id",))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_inverted_multi_index")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w : w <> '') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), lowest AS (
  SELECT a, min(b) AS low FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.a = d.doc_id
"""


@query("op10_fast_similarity", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = minhash.components(docs, minhash.Settings(percent=85))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _op13_sql(rounds: int = 10) -> str:
    """The rounds written out one after the other; integer division by a floor, as sums may be negative."""
    distance = "list_sum(list_transform(range(1, 65), lambda i : (v[i] - c[i]) * (v[i] - c[i])))"
    parts = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x : CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS n, v AS c FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), v) <= 8)""",
    ]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (
  SELECT r, vec_id, v, n, d FROM (SELECT r, vec_id, v, n, {distance} AS d FROM kept, c{t})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, n) = 1)""")
        if t < rounds:
            parts.append(f"""s{t} AS MATERIALIZED (
  SELECT n, list((s - ((s % m) + m) % m) // m ORDER BY i) AS c
  FROM (SELECT n, i, sum(v[i]) AS s, CAST(count(*) AS HUGEINT) AS m FROM a{t}, range(1, 65) AS g(i) GROUP BY n, i) GROUP BY n),
c{t + 1} AS MATERIALIZED (SELECT n, coalesce(s.c, c{t}.c) AS c FROM c{t} LEFT JOIN s{t} AS s USING (n))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(n AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x : CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (n)"""


@query("op13_bit_plane_clusters", _op13_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found, centroids = bitplane.clustered(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    sums = bitplane.inertia(found)
    shown = {c: min(n, bitplane.LARGEST) for c, n in sums.items()}
    digests = {c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest() for c in sums}

    def looked_up(values: dict, kind: str) -> Column:
        pairs = [F.lit(x) for pair in values.items() for x in pair]
        return (F.create_map(*pairs)[F.col("cluster")] if pairs else F.lit(None)).cast(kind)

    return found.select(
        "vec_id",
        "cluster",
        "distance",
        looked_up(shown, "long").alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), bitplane.LARGEST)).cast("long").alias("inertia"),
        looked_up(digests, "string").alias("centroid_sha256"),
    )


@query("op11_conversation_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    pieces = dialog.repair(dialog.damaged(rows), rows.select(F.col("conv_id").alias("conv")))
    return dialog.digests(pieces).withColumnRenamed("conv", "conv_id")


@query("op12_suffix_array_dedup")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.cut(table(spark, folder, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
