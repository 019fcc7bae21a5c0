"""WARC archives written in deterministic shards and read back.

Records are cut into shards by ranges of their key: exact byte counts per cell of the key's range,
refined where a cell is heavy, give the borders, so they depend on the data and not on how it is stored or
sampled. A task sorts its shards, rolls to a new file when a file's compressed size is reached, and writes
headers and digests anew. One gzip member per record with a fixed time makes files equal bit by bit.

Commit: tasks write under temporary names that are unique per attempt and return one manifest row for
each file; Spark commits that table once per task, so files of lost or repeated attempts are in no
manifest. Then the listed files are renamed (again by tasks; repeating it is harmless) and the final manifest
is written. Readers open only what a committed manifest lists.

Of equal payloads the record with the largest key is the response, the others are revisits without payload.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickledger.llm.base import rebatched
from tickledger.workspace import pin

SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
CELLS = 1024
BATCH_ROWS = 64
DATE = datetime(2021, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, part int, name string, records long, bytes long, sha256 string"
RECORD = "key long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _normal(path: str) -> str:
    """`file:/x` as `file:///x`, other addresses as they are."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def shard_borders(sized: DataFrame, key: str, size: str, target: int) -> np.ndarray:
    """Lower borders of all shards but the first: each shard has `target` bytes at most, or a single key.

    Counts every row. The driver gets sums per cell only: CELLS at first, and as many again for each cell
    that alone is heavier than a shard.
    """
    low, high = sized.agg(F.min(key), F.max(key)).first()
    if low is None:
        return np.empty(0, np.int64)
    cells = _cell_sums(sized, key, size, [(low, high)])
    heavy = [c for c in cells if c[2] > target and c[1] > c[0]]
    while heavy:
        finer = _cell_sums(sized, key, size, [c[:2] for c in heavy])
        cells = sorted([c for c in cells if c not in heavy] + finer)
        heavy = [c for c in finer if c[2] > target and c[1] > c[0]]
    borders, held = [], 0
    for first, _, total in cells:
        if held and held + total > target:
            borders.append(first)
            held = 0
        held += total
    return np.array(borders, np.int64)


def _cell_sums(sized: DataFrame, key: str, size: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first key, last key, bytes) of the cells that hold rows, each range cut into CELLS."""
    cell = number = None
    for i, (low, high) in enumerate(ranges):
        width = (high - low) // CELLS + 1
        inside = F.col(key).between(low, high)
        at = F.expr(f"(`{key}` - ({low})) div {width}")
        cell = F.when(inside, at) if cell is None else cell.when(inside, at)
        number = F.when(inside, i) if number is None else number.when(inside, i)
    sums = sized.where(number.isNotNull()).groupBy(number.alias("i"), cell.alias("cell")).agg(F.sum(size).alias("total"))
    out = []
    for i, at, total in sums.collect():
        low, high = ranges[i]
        width = (high - low) // CELLS + 1
        out.append((low + at * width, min(high, low + (at + 1) * width - 1), total))
    return sorted(out)


def _plain(pages: DataFrame, key: str, uri: str, payload: str) -> DataFrame:
    body = F.coalesce(pages[payload].cast("binary"), F.lit(b""))
    return pages.select(pages[key].cast("long").alias("key"), pages[uri].cast("string").alias("uri"), body.alias("payload"))


def revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """`key, digest, refers_to` of every record that repeats a payload of at least `min_bytes`.

    Sums up per payload before it shuffles. Rows that share the largest key of a payload are all responses, and
    so are rows with a null key.
    """
    digests = records.where(F.octet_length("payload") >= min_bytes).select("key", F.sha1("payload").alias("digest"))
    last = digests.groupBy("digest").agg(F.max("key").alias("refers_to"), F.min("key").alias("first")).where("first < refers_to")
    return digests.join(last.drop("first"), "digest").where("key < refers_to").select("key", "digest", "refers_to").distinct()


def write(pages: DataFrame, root: str, key: str = "page_id", uri: str = "url", payload: str = "html", min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write one record per row of `pages` below `root`, a new folder that all machines see; returns the manifest.

    A null or empty payload makes a record of no bytes; a null URI an empty target, a null key the first
    shard and no key in the headers. Rows that repeat make records of their own. An empty table makes an empty
    manifest. Other columns are not read.
    """
    spark = pages.sparkSession
    root = _normal(root)
    records = _plain(pages, key, uri, payload)
    sized = pin(records.select("key", F.octet_length("payload").alias("size")), "warc-sizes")
    borders = shard_borders(sized, "key", "size", shard_bytes)
    known = pin(revisits(records, min_bytes), "warc-revisits")
    # one shuffle of payloads; a decision travels to the shard of its record and is sorted before it
    both = records.select("key", "uri", "payload", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    both = both.unionByName(known.select("key", F.lit(None).cast("string").alias("uri"), F.lit(None).cast("binary").alias("payload"), F.lit(0).alias("kind"), "digest", "refers_to"))

    def with_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            shards = np.searchsorted(borders, keys, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards)], names=[*batch.schema.names, "shard"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema.fields)
    sharded = both.mapInArrow(with_shard, f"{kinds}, shard int")
    ordered = sharded.repartitionById(len(borders) + 1, "shard").sortWithinPartitions("shard", "key", "kind", "uri", F.sha1("payload"))
    temporary = f"{root}/_temporary"
    _open(root)[0].create_dir(_open(temporary)[1], recursive=True)

    def write_files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _write_shards(batches, temporary, roll_bytes)

    written = pin(ordered.mapInArrow(write_files, MANIFEST), "warc-manifest")

    def rename(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _open(root)
        for batch in batches:
            final = [f"shard-{s:06d}-{p:04d}.warc.gz" for s, p in zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist(), strict=True)]
            for name, to in zip(batch.column("name").to_pylist(), final, strict=True):
                if files.get_file_info(source := posixpath.join(folder, "_temporary", name)).type != pyarrow.fs.FileType.NotFound:
                    files.move(source, posixpath.join(folder, to))
            yield batch.set_column(2, "name", pa.array(final, pa.string()))

    written.mapInArrow(rename, MANIFEST).write.parquet(f"{root}/_manifest")
    return spark.read.parquet(f"{root}/_manifest")


def _write_shards(batches: Iterable[pa.RecordBatch], folder_uri: str, roll_bytes: int) -> Iterator[pa.RecordBatch]:
    files, folder = _open(folder_uri)
    attempt = uuid.uuid4().hex
    out, shard, part, name, count, size, seen = None, None, 0, "", 0, 0, hashlib.sha256()
    of_key, refers_to = None, {}

    def closed() -> pa.RecordBatch:
        out.close()
        row = {"shard": [shard], "part": [part], "name": [name], "records": [count], "bytes": [size], "sha256": [seen.hexdigest()]}
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    for batch in rebatched(batches, BATCH_ROWS):
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if row["key"] != of_key:
                    of_key, refers_to = row["key"], {}
                refers_to[row["digest"]] = row["refers_to"]
                continue
            raw = hashlib.sha1(row["payload"])
            refers = refers_to.get(raw.hexdigest()) if row["key"] is not None and row["key"] == of_key else None
            record = _record(row["key"], row["uri"] or "", row["payload"], base64.b32encode(raw.digest()).decode(), refers)
            if out is not None and (row["shard"] != shard or size + len(record) > roll_bytes):
                yield closed()
                part = part + 1 if row["shard"] == shard else 0
                out = None
            if out is None:
                shard, count, size, seen = row["shard"], 0, 0, hashlib.sha256()
                name = f"{shard:06d}-{part:04d}-{attempt}"
                out = files.open_output_stream(posixpath.join(folder, name), compression=None)
            out.write(record)
            seen.update(record)
            count, size = count + 1, size + len(record)
    if out is not None:
        yield closed()


def _record(key: int | None, uri: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member; ids follow from key, type and digest alone, so writing again gives the same bytes."""
    kind = "response" if refers_to is None else "revisit"
    made = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind}:{key}:{digest}")
    block = payload if refers_to is None else b""
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{made}>",
        "WARC-Date": DATE.strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": " ".join(uri.split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
        "X-Payload-Length": str(len(payload)),
    }
    if key is not None:
        headers["X-Record-Key"] = str(key)
    if refers_to is not None:
        headers["WARC-Profile"] = PROFILE
        headers["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response:{refers_to}:{digest}')}>"
        headers["X-Refers-To-Key"] = str(refers_to)
    headers["Content-Type"] = "text/html"
    headers["Content-Length"] = str(len(block))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def read(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """Records of all files in the committed manifest of `root`, streamed, with every digest checked.

    `payload` is null for revisits and where it is not asked for.
    """
    root = _normal(root)
    listed = spark.read.parquet(f"{root}/_manifest").select("name", "sha256")
    spread = listed.repartition(max(1, listed.count()), "name")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _open(root)
        for batch in batches:
            for name, digest in zip(batch.column("name").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                held: list[dict] = []
                size = 0
                with files.open_input_stream(posixpath.join(folder, name), compression=None) as stream:
                    for record in _records(stream, digest):
                        size += len(record["payload"] or b"")
                        held.append(record if with_payload else record | {"payload": None})
                        if len(held) == 1000 or size > 4 << 20:
                            yield _rows(held)
                            held, size = [], 0
                if held:
                    yield _rows(held)

    return spread.mapInArrow(run, RECORD)


def _rows(held: list[dict]) -> pa.RecordBatch:
    kinds = [("key", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    return pa.RecordBatch.from_pylist(held, schema=pa.schema(kinds))


def _records(stream, digest: str) -> Iterator[dict]:
    """Parse gzip members one by one; raises where a length or a digest differs from what was written."""
    whole, rest, end = hashlib.sha256(), b"", False
    while True:
        packer, inflated = zlib.decompressobj(31), []
        while not packer.eof:
            if not rest and not end:
                rest = stream.read(1 << 16)
                whole.update(rest)
                end = not rest
            if not rest:
                if inflated:
                    raise ValueError("an archive ends within a record")
                break
            inflated.append(packer.decompress(rest))
            rest = packer.unused_data
        if not packer.eof:
            break
        head, _, body = b"".join(inflated).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        length = int(fields["Content-Length"])
        block, tail = body[:length], body[length:]
        if tail != b"\r\n\r\n" or "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"]:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
        response = fields["WARC-Type"] == "response"
        if response and fields["WARC-Block-Digest"] != fields["WARC-Payload-Digest"]:
            raise ValueError(f"record {fields['WARC-Record-ID']} has another payload")
        yield {
            "key": int(fields["X-Record-Key"]) if "X-Record-Key" in fields else None,
            "uri": fields.get("WARC-Target-URI", ""),
            "record_type": fields["WARC-Type"],
            "payload_bytes": int(fields["X-Payload-Length"]),
            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "refers_to": int(fields["X-Refers-To-Key"]) if "X-Refers-To-Key" in fields else None,
            "payload": block if response else None,
        }
    if whole.hexdigest() != digest:
        raise ValueError("an archive differs from its manifest")

