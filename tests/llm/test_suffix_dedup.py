"""Suffix-array dedup against a plain version that looks up every 50-byte string."""

from __future__ import annotations

import hashlib
import os
import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickledger.llm import suffix_dedup as S
from tickledger.workspace import shared_folder

SCHEMA = "doc_id long, text string"


def plain(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha of the rest) of each row."""
    least: dict[bytes, float] = {}
    data = [(float("inf") if i is None else i, i, (t or "").encode()) for i, t in rows]
    for order, _, text in data:
        for at in range(len(text) - 49):
            piece = text[at : at + 50]
            least[piece] = min(least.get(piece, order), order)
    out = []
    for order, i, text in data:
        gone = np.zeros(len(text) + 1, bool)
        for at in range(len(text) - 49):
            if least[text[at : at + 50]] < order:
                gone[at : at + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(text, np.uint8)[~gone[: len(text)]])
        out.append((i, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, settings=S.Settings(), schema=SCHEMA):
    cut = S.cut(spark.createDataFrame(rows, schema), settings)
    got = cut.select("doc_id", "n_bytes", "spans", "kept").collect()
    out = []
    for r in got:
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        assert removed + len(r["kept"]) == r["n_bytes"]
        out.append((r["doc_id"], r["n_bytes"], removed, len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()))
    return sorted(out, key=str)


def corpus(rng, n):
    words = ["été", "über", *["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(120)]]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [prose(30) for _ in range(5)]
    out = []
    for i in range(n):
        text = prose(rng.randrange(1, 120))
        if rng.random() < 0.5:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(passages)[rng.randrange(40) :] + text[at:]
        if out and rng.random() < 0.3:
            text = rng.choice(out)[1] or ""
            if rng.random() < 0.7 and text:
                at = rng.randrange(len(text))
                text = text[:at] + rng.choice(["x", "", "yz", prose(3)]) + text[at + 1 :]
        out.append((rng.randrange(3 * n), text if rng.random() < 0.97 else None))
    return out


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(3)
    rows = corpus(rng, 250)
    rows += [(5000, "a" * 700), (5001, "b" + "a" * 300), (5002, "ab" * 200), (None, "ab" * 100), (None, "c" * 60), (None, "d" * 70), (5003, "\0" * 120 + "q"), (5004, "\0" * 90)]
    return rows


def test_random_documents(spark, mixed):
    assert found(spark, mixed) == plain(mixed)


@pytest.mark.parametrize("settings", [S.Settings(hot_documents=3, least_seen=2), S.Settings(bucket_anchors=300, bucket_contexts=100, hot_documents=8, least_seen=2, sampled_documents=60)])
def test_dealing_changes_no_result(spark, mixed, settings):
    """Hot anchors take the path of windows, buckets are small."""
    assert found(spark, mixed, settings) == plain(mixed)


def test_a_passage_in_every_document(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("klmnop") for _ in range(5)) for _ in range(500)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, " ".join(rng.choice(words) for _ in range(10)) + " " + passage + " " + " ".join(rng.choice(words) for _ in range(10))) for i in range(400)]
    got = found(spark, rows, S.Settings(hot_documents=50))
    assert got == plain(rows)
    assert sum(r[2] >= len(passage.encode()) for r in got) == 399


def test_long_texts(spark):
    rng = random.Random(4)
    block = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    long = "".join(rng.choice("abcdefghij ") for _ in range(60_000))
    rows = [(1, block), (2, long[:30_000] + block + long[30_000:]), (3, long), (4, long[100:200] + "Z" + long[59_000:])]
    assert found(spark, rows) == plain(rows)


def test_long_texts_are_read_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 100, 5000, dtype=np.uint8))
    whole = list(S.anchors_of([text, text[7:400]]))
    monkeypatch.setattr(S, "STEP_BYTES", 300)
    parts = list(S.anchors_of([text, text[7:400]]))
    assert len(parts) > 10

    def windows(found):
        out = set()
        for hashes, of, places in found:
            for h, d, at, near, far in zip(hashes.tolist(), of.tolist(), *(x.tolist() for x in S._unpacked(places)), strict=True):
                out |= {(h, d, at, w) for w in range(at - far, at - near + 1)}
        return out

    assert windows(whole) == windows(parts)
    assert len(windows(whole)) == (len(text) - 49) + (393 - 49)


def test_edge_cases(spark):
    assert found(spark, []) == []
    rows = [(None, None), (1, ""), (2, "short"), (3, "s" * 49), (4, "s" * 49), (5, "t" * 50), (6, "t" * 50), (6, "t" * 50), (6, "t" * 51)]
    assert found(spark, rows) == plain(rows)
    clashing = [(1, "t" * 60, "x", 1, "p"), (2, "t" * 60, "y", 2, "q")]
    got = found(spark, clashing, schema=SCHEMA + ", node string, print long, spans string")
    assert got == plain([r[:2] for r in clashing])


@pytest.mark.parametrize("alphabet", ["ab", "\0a", "abcdefgh"])
def test_deep_shallow_sorting(alphabet):
    """Order and common prefixes against sorted()."""
    rng = random.Random(2)
    for n, shallow in ((1, 2), (2, 2), (40, 1), (900, 2), (900, 0)):
        stems = ["".join(rng.choice(alphabet) for _ in range(30)) for _ in range(6)]
        strings = [(rng.choice(stems)[: rng.randrange(31)] + "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))).encode()[:40] for _ in range(n)]
        rows = np.zeros((n, 40), np.uint8)
        for i, s in enumerate(strings):
            rows[i, : len(s)] = list(s)
        lengths = np.array([len(s) for s in strings])
        order = S.deep_shallow_order(rows, lengths, shallow)
        assert [strings[i] for i in order] == sorted(strings)
        assert sorted(S.blind_trie_order(strings)) == list(range(n))
        assert [strings[i] for i in S.blind_trie_order(strings)] == sorted(strings)
        common = S.common_lengths(rows, lengths, order)
        for k in range(1, n):
            a, b = strings[order[k - 1]], strings[order[k]]
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert common[k] == same


def test_spans_are_byte_ranges(spark):
    rows = [(1, "é" * 40), (2, "x" + "é" * 40 + "y")]
    cut = S.cut(spark.createDataFrame(rows, SCHEMA)).where("doc_id = 2").select(F.get("spans", F.lit(0)), "kept").first()
    assert (cut[0]["start"], cut[0]["end"], bytes(cut[1])) == (1, 81, b"xy")


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_anchors_take_little_memory():
    data = np.random.default_rng(5).integers(97, 123, 6_000_000, dtype=np.uint8).tobytes()
    texts = [data[i : i + 3000] for i in range(0, len(data), 3000)]
    assert peak_mb(lambda: [None for _ in S.anchors_of(texts)]) < 40


def test_contexts_are_compared_by_slices():
    """Little memory beside the bucket's own, and the windows found at one go."""
    rng = np.random.default_rng(6)
    contexts = np.tile(rng.integers(97, 101, (20_000, S.WIDTH), dtype=np.uint8), (4, 1))
    contexts[:, -4:] = rng.integers(97, 101, (len(contexts), 4))
    near, far = rng.integers(0, 5, len(contexts)), rng.integers(5, 35, len(contexts))
    ids = rng.integers(0, 5000, len(contexts))
    parts = [set(zip(w.tolist(), o.tolist(), strict=True)) for w, o in S.held_before(contexts, near, far, ids)]
    whole = set(zip(*(x.tolist() for x in S._held_before(contexts, near, far, ids)), strict=True))
    assert len(parts) > 3
    assert set().union(*parts) == whole
    assert sum(map(len, parts)) == len(whole) > 100_000
    assert peak_mb(lambda: [None for _ in S.held_before(contexts, near, far, ids)]) < 25


def test_shared_hashes_are_found_by_slices():
    rng = np.random.default_rng(7)
    hashes, ids = rng.integers(0, 30_000, 60_000).astype(np.uint64), rng.integers(0, 3, 60_000)
    holders = {}
    for h, i in zip(hashes.tolist(), ids.tolist(), strict=True):
        holders.setdefault(h, set()).add(i)
    assert sorted(S.in_several(hashes, ids).tolist()) == [k for k, h in enumerate(hashes.tolist()) if len(holders[h]) > 1]


def test_replies_go_in_small_rows():
    rng = np.random.default_rng(8)
    columns = [rng.integers(0, 1000, 50_000) for _ in range(4)]
    rows = S._replies(2, False, *columns).to_pylist()
    assert max(len(r["ids"]) for r in rows) <= 8 * 4096
    got = [np.concatenate([np.frombuffer(r[c], "<i8") for r in rows]).tolist() for c in ("ids", "prints", "firsts", "seconds")]
    assert sorted(zip(*got, strict=True)) == sorted(zip(*(c.tolist() for c in columns), strict=True))


def prose_of(rng, n):
    words = ["".join(rng.choice("klmnop") for _ in range(5)) for _ in range(500)]
    return [(i, i * 2654435761 - 2**62, " ".join(rng.choice(words) for _ in range(120))) for i in range(n)]


def test_blobs_come_back_from_a_shuffle():
    rng = np.random.default_rng(9)
    for blob in (b"", bytes(80), rng.bytes(8000), np.arange(1000, dtype="<i8").tobytes()):
        for number_bytes in (1, 8):
            sent = S._squeezed(blob, number_bytes)
            assert S._unsqueezed(sent) == blob
            assert len(sent) <= len(blob) + 5
    assert len(S._squeezed(np.arange(1000, dtype="<i8").tobytes(), 8)) < 1500


def test_anchors_take_few_bytes_in_the_shuffle(spark):
    """Within a bucket 32 bits of a hash are enough, and places and documents of neighbours are much alike."""
    rows = prose_of(random.Random(5), 600)
    texts = spark.createDataFrame(rows, "id long, print long, text string").coalesce(1)
    count = sum(len(h) for h, _, _ in S.anchors_of(r[2].encode() for r in rows))
    blobs = ["hashes", "places", "docs", "ids", "prints"]
    sent = sum(len(r[c]) for r in S._sent_anchors(texts, 2, np.empty(0, np.uint64)).collect() for c in blobs)
    assert sent < 12 * count


def test_contexts_take_few_bytes_in_the_shuffle(spark):
    rows = prose_of(random.Random(6), 200)
    places = [np.concatenate([p for _, _, p in S.anchors_of([r[2].encode()])]) for r in rows]
    spotted = spark.createDataFrame([(*r, p.astype("<i8").tobytes()) for r, p in zip(rows, places, strict=True)], "id long, print long, text string, places binary")
    sent = sum(len(r[c]) for r in S._sent_contexts(spotted.coalesce(1), 2).collect() for c in ("contexts", "places", "docs", "ids", "prints"))
    assert sent < 60 * sum(map(len, places))


def test_disk_is_given_up_on_the_way(spark, mixed):
    """Neither shuffle files nor tables that nothing reads any more stay, and the session's setting is as before."""

    def shuffled():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for top in disk.localDirsString() for _, _, files in os.walk(top) for f in files if f.startswith("shuffle_")}

    def tables():
        folder = f"{shared_folder(spark)}/tickledger"
        return set(os.listdir(folder)) if os.path.isdir(folder) else set()

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(setting, None) is None
    docs = spark.createDataFrame(mixed, SCHEMA)
    files, before = shuffled(), tables()
    cut = S.cut(docs, S.Settings(hot_documents=3, least_seen=2))
    for _ in range(50):  # Spark deletes them in the background
        if shuffled() <= files:
            break
        time.sleep(0.2)
    assert shuffled() <= files
    assert sorted(t.rsplit("-", 1)[0] for t in tables() - before) == ["bloom-filter", "repeats"]
    assert spark.conf.get(setting, None) is None
    assert cut.count() == len(mixed)
