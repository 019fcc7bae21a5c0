"""URL filter, WARC, quality, nearest neighbours, near duplicates and the pipeline against plain versions."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from check_against_sql import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from tickledger.llm import ann, minhash, quality, url_filter, warc
from tickledger.llm.queries import QUERIES, RULES, SQL
from tickledger.workspace import fresh_path, pin, pin_alone, shared_folder

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name) is None


# --- URL filter


def test_urls_without_host_and_hot_ones(spark):
    urls = [None, "", "no scheme", "https://", "HTTP://WWW.X.org/fr/a?utm_source=q#f", "http://sub.example.net/en/1", "x://a.net", "x://a.net/", "http://bad.org/p/?b=2&a=1"]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)] + [(100 + i, "http://bad.org/p?a=1&b=2&ref=9", "h", "x") for i in range(200)], "page_id long, url string, host string, listed string")
    listed = spark.createDataFrame([("bad.org/p?a=1&b=2",), (None,), ("bad.org/p?a=1&b=2",)], "url string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages, listed, RULES).collect()}
    assert len(rows) == len(urls) + 200
    assert (rows[0]["host"], rows[0]["path"], rows[0]["verdict"]) == ("", "", "allow") and rows[3]["host"] == ""
    assert (rows[4]["host"], rows[4]["rule"]) == ("www.x.org", "org/fr/")
    assert (rows[5]["rule"], rows[5]["verdict"]) == ("example.net/en/", "allow")
    assert rows[6]["rule"] is None and rows[7]["verdict"] == "block"
    assert {rows[k]["verdict"] for k in rows if k == 8 or k >= 100} == {"block"}
    assert rows[8]["listed"] == "x"
    assert url_filter.judge(pages.limit(0), listed, RULES).count() == 0
    assert url_filter.judge(pages, listed.limit(0), RULES).where("verdict = 'block' and rule is null").count() == 0


def test_filter_has_no_false_negatives_and_the_join_no_false_positives(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 2)  # far too small: nearly all pass the filter
    keys = spark.range(3000).selectExpr("concat('k', id) as k")
    rows = url_filter.listed_in(keys, keys.where("substr(k, 2) % 7 = 0"), "k")
    assert rows.where("listed <> (substr(k, 2) % 7 = 0)").count() == 0 and rows.count() == 3000


# --- WARC


def test_warc_round_trip_and_revisits(spark):
    rows = [(i, f"http://h/{i}", None if i % 50 == 0 else ("same" if i % 3 == 0 else f"body {i} é\r\n\r\nWARC/1.1")) for i in range(300)]
    rows += [(None, None, "same"), (299, "http://h/other", "body 7 é\r\n\r\nWARC/1.1"), (7, "x", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("shard", F.lit(1))
    root = fresh_path(spark, "warc")
    manifest = warc.write(pages, root, shard_bytes=2000, roll_bytes=1500)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    back = warc.read(spark, root).collect()
    assert len(back) == len(rows)
    most: dict[bytes, int] = {}
    for key, _, body in rows:
        data = (body or "").encode()
        most[data] = max(most.get(data, -1), -1 if key is None else key)
    expected, got = Counter(), Counter()
    for key, url, body in rows:
        data = (body or "").encode()
        known = key is not None and key < most[data]
        expected[key, " ".join((url or "").split()), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if known else "response", most[data] if known else None, None if known else data] += 1
    for r in back:
        got[r["key"], r["uri"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])] += 1
    assert got == expected
    again = fresh_path(spark, "warc")
    second = warc.write(pages.repartition(7), again, shard_bytes=2000, roll_bytes=1500)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, second.collect()))  # same files bit by bit


def test_warc_of_nothing_and_of_short_payloads(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    root = fresh_path(spark, "warc")
    warc.write(pages, root, min_bytes=3)
    assert {r["key"]: r["record_type"] for r in warc.read(spark, root, with_payload=False).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    empty = fresh_path(spark, "warc")
    assert warc.write(pages.limit(0), empty).count() == 0 and warc.read(spark, empty).count() == 0


def test_shards_follow_bytes_where_keys_are_uneven(spark):
    keys = [*range(100), 10**12, 10**15] + [10**15 + i for i in range(50)]
    sized = spark.createDataFrame([(k, 100) for k in keys], "key long, size long")
    borders = warc.shard_borders(sized, "key", "size", 1000).tolist()
    counts = Counter(np.searchsorted(borders, keys, side="right").tolist())
    assert max(counts.values()) <= 10 and len(counts) <= 2 * len(keys) / 10 + 1


# --- quality


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


def test_base_counts_of_all_texts(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    texts += [None, "", "\n\n \n", "a b c a b c a", "x x x x", "a b c", "é\x0b字 \x1c|", "l\nl\nl\n\n", " ".join(["w"] * 30_000)]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    for r in quality.base_counts(docs).collect():
        assert tuple(r[c] for c in quality.BASE) == plain_counts(texts[r["doc_id"]])


def plain_estimate(x, settings):
    """Mean and covariance of the most concentrated rows: two starts, concentration steps, the smaller determinant."""
    floors = np.diag(np.square(settings.floors))
    middle = lambda v: np.sort(np.floor(v * 512 + 0.5), axis=0)[math.ceil(0.5 * len(v)) - 1] / 512
    centre = middle(x)
    found = []
    for mean, cov in ((centre, np.diag((1.4826 * middle(np.abs(x - centre))) ** 2) + floors), (x.mean(axis=0), np.cov(x.T, bias=True) + floors)):
        for _ in range(settings.steps):
            dist = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            cells = np.floor(np.log(dist + 1e-6) * 100)
            near = x[cells <= np.sort(cells)[math.ceil(settings.share * len(x)) - 1]]
            mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * settings.consistency + floors
        found.append((round(np.linalg.slogdet(cov)[1] / 2, 9), len(found), mean, cov))
    best = min(found, key=lambda f: f[:2])
    return len(x), best[2], best[3]


def test_verdicts_against_numpy(spark):
    """The same with numpy, for the stored sources, most of which are small."""
    settings = quality.Settings()
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", F.lit(1).alias("kept"))
    judged = quality.judged(rows, settings).toPandas()
    n = judged["n_words"].clip(lower=1)
    x = np.column_stack([np.log1p(judged["n_words"]), np.log1p(judged["word_chars"] / n), np.log1p(100 * judged["n_symbols"] / n), np.log1p(100 * judged["n_dup_lines"] / n), np.sqrt(judged["n_repeat_words"] / n)])
    fine = ~judged["base_failed"].to_numpy()
    lang, source = judged["lang"].fillna("").to_numpy(), judged["source"].fillna("").to_numpy()
    all_ = plain_estimate(x[fine], settings)
    expected = np.zeros(len(judged), bool)
    for one in set(lang[fine]):
        of_lang = plain_estimate(x[fine & (lang == one)], settings)
        for part in set(source[fine & (lang == one)]):
            own = (lang == one) & (source == part)
            size, *estimate = plain_estimate(x[fine & own], settings)
            wide, near = of_lang[0] / (of_lang[0] + settings.prior), size / (size + settings.prior)
            mean, cov = (near * e + (1 - near) * (wide * of_lang[i] + (1 - wide) * all_[i]) for i, e in enumerate(estimate, 1))
            dist = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            expected |= own & fine & (dist <= settings.cutoff)
    assert (judged["kept"].to_numpy() == expected).all() and 0 < expected.sum() < fine.sum()


def test_good_documents_stay(spark):
    judged = QUERIES["op8_covariance_outliers"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    good = judged.where("quality = 1 and not base_failed")
    assert good.where("kept").count() > 0.99 * good.count()
    assert judged.where("quality = 0 and kept").count() < 0.1 * judged.where("quality = 0").count()


def test_quality_of_awkward_tables(spark):
    schema = "doc_id long, text string, lang string, source string, group long, kept string"
    rows = [(None, None, None, None, 1, "x"), (1, "", "en", None, 1, "x"), (2, "w " * 60, None, "s", 1, "x"), (2, "w " * 60, None, "s", 1, "x")]
    out = quality.judged(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 4 and not any(r["kept"] for r in out) and {r["group"] for r in out} == {1}
    assert quality.judged(spark.createDataFrame([], schema)).count() == 0


def test_small_groups_are_judged(spark):
    """A small source mostly by its language, a small language mostly by all documents."""
    random.seed(12)
    plain = lambda: " ".join(f"word{random.randint(0, 9999)}" for _ in range(random.randint(150, 400)))
    odd = " ".join(f"#*$%{i}" for i in range(300))
    rows = [(i, plain(), "en", "hot") for i in range(150)] + [(200 + i, plain(), "en", "small") for i in range(6)] + [(300 + i, plain(), "fi", "s") for i in range(5)] + [(400 + i, plain(), None, "s") for i in range(3)]
    rows += [(900, odd, "en", "small"), (901, odd, "fi", "s"), (902, odd, None, "s"), (903, odd, "et", None)]
    judged = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), keep=("doc_id",)).collect()
    assert len(judged) == len(rows) and not any(r["base_failed"] for r in judged)
    assert {r["doc_id"] for r in judged if not r["kept"]} == {900, 901, 902, 903}


# --- nearest neighbours


def plain_search(vectors, queries, k):
    good = {i: np.array(v, float) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    return {q: sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))[:k] for q in queries if q in good}


def test_nearest_with_ties_copies_and_bad_vectors(spark):
    random.seed(1)
    vectors = [(i, [random.gauss(0, 1 + (i % 3)) for _ in range(6)]) for i in range(400)]
    vectors += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(300)]
    vectors += [(2000, None), (2020, [0.0] * 6), (2040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2060, [float("nan")] * 6), (2080, [float("inf")] * 6), (None, [1.0] * 6)]
    vectors += vectors[:5]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("block", F.lit(1)).withColumn("cell", F.lit(1))
    everything = ann.Settings(centroids=8, share=1.0)
    rows = ann.search(df, F.col("vec_id") % 20 == 0, settings=everything).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    expected = plain_search(vectors, [i for i, _ in dict.fromkeys((v[0], None) for v in vectors) if i is not None and i % 20 == 0], 20)
    assert got.keys() == expected.keys()
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21))
        assert [f[1] for f in found] == [i for _, i in expected[q]]
        assert np.allclose([f[2] for f in found], [-s for s, _ in expected[q]], rtol=1e-12)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in rows} == {(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)}
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [4, 10, 25, 30])
def test_small_tables_give_whole_results(spark, n):
    random.seed(n)
    vectors = [(20 * i if i < 2 else 1000 + 20 * i + 1, [random.gauss(0, 1) for _ in range(8)]) for i in range(n)]
    rows = ann.search(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    got = {q: [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20)}
    assert got == {q: [i for _, i in found] for q, found in plain_search(vectors, [0, 20], 20).items()}


def test_heap_walk_visits_cells_by_summed_distance():
    random.seed(2)
    a, b = np.array([random.random() for _ in range(7)]), np.array([random.random() for _ in range(9)])
    order = ann.visited(a, b, np.ones(63, int), 63)
    sums = [a[c // 9] + b[c % 9] for c in order]
    assert len(set(order)) == 63 and sums == sorted(sums)
    assert ann.visited(a, b, np.ones(63, int), 5) == order[:5]


def test_recall_on_stored_vectors(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op9_inverted_multi_index"](spark, folder).collect()
    stored = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in stored]), np.array([r["embedding"] for r in stored], float)
    found: dict[int, set] = {}
    for r in rows:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, got in found.items():
        scores = x @ x[ids == q][0]
        scores[ids == q] = -np.inf
        hits += len(got & set(ids[np.argsort(-scores, kind="stable")[:20]].tolist()))
    assert len(found) == (ids % 20 == 0).sum() and hits >= 0.9 * 20 * len(found)


# --- near duplicates


def plain_components(texts, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(seed, n, edits):
    """Copies of copies, each with a few words changed: links form chains, not cliques."""
    random.seed(seed)
    texts = [[f"w{random.randint(0, 9999)}" for _ in range(120)]]
    for _ in range(n - 1):
        words = list(random.choice(texts))
        for _ in range(edits):
            words[random.randrange(len(words))] = f"w{random.randint(0, 9999)}"
        texts.append(words)
    return [" ".join(w) for w in texts]


@pytest.mark.parametrize("settings", [minhash.Settings(percent=85), minhash.Settings(percent=80, partners=3, block_shingles=2000)])
def test_components_against_all_pairs(spark, settings):
    texts = family(1, 60, 2) + family(2, 40, 1) + family(3, 30, 4) + ["One two three"] * 5 + ["ONE two\tthree", "one two", "", None, "  \n", "x"]
    texts += [f"{i} unlike " * 3 + f"{i * 7}" for i in range(30)]
    random.seed(9)
    order = list(range(len(texts)))
    random.shuffle(order)
    docs = spark.createDataFrame([(k, texts[k], "n") for k in order], "doc_id long, text string, node string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.components(docs, settings).collect()}
    assert got == plain_components(list(enumerate(texts)), settings.percent)


def test_one_of_each_with_nulls_and_repeats(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (3, base), (None, base + " x"), (None, "alone " * 9), (None, "alone " * 9), (7, None), (8, ""), (None, None), (9, "other text of six words here"), (9, "other text of six words here")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept_id string")
    kept = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), (r["text"] or "")[:5]) for r in minhash.one_of_each(docs).collect())
    assert kept == [(-1, ""), (-1, "alone"), (3, "w0 w1"), (7, ""), (8, ""), (9, "other")]
    assert minhash.one_of_each(docs.limit(0)).count() == 0


def test_texts_that_share_an_id_all_stay(spark):
    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in "abc"]
    rows = [(4, texts[0]), (4, texts[1]), (4, texts[1]), (6, texts[0]), (8, texts[2]), (8, None)]
    kept = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["text"] or "")[:2] for r in kept) == ["", "a0", "b0", "c0"]
    assert {r["doc_id"] for r in kept if r["text"] == texts[0]} == {6}


def test_sketches_estimate_similarity_and_fill_every_coordinate():
    random.seed(4)
    shared = np.array([random.getrandbits(64) for _ in range(300)], np.uint64)
    left, right = (np.concatenate([shared, np.array([random.getrandbits(64) for _ in range(60)], np.uint64)]) for _ in range(2))
    t = 2000
    same = (minhash.sketch(left, t) == minhash.sketch(right, t)).mean()
    assert abs(same - 300 / 420) < 5 * math.sqrt(0.25 / t)
    for n in (1, 2, 5, 1000):
        few = np.array([random.getrandbits(64) for _ in range(n)], np.uint64)
        assert (minhash.sketch(few, 240) < np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_long_chains_connect(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 2000), (2000, 3000)], "a long, b long")
    labels = {r["node"]: r["label"] for r in minhash.connected(links).collect()}
    assert {labels[i] for i in range(501)} == {0} and labels[3000] == 1000


# --- pipeline


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[name] = docs.count()
        if name != "best_fit_packing":
            assert docs.columns == before.columns
        if name == "language_id":
            assert seen[name] >= 0.99 * before.count()
        if name == "quality_rules":
            gone = before.select("doc_id", "text").subtract(docs.select("doc_id", "text")).collect()
            good = [r for r in gone if labels.get(r["doc_id"]) == 1 and not (lambda c: c[0] < 50 or 2 * c[4] > c[0])(plain_counts(r["text"]))]
            assert len(good) <= 0.01 * before.count()
        if name == "near_dedup":
            texts = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in docs.collect()} == {c for _, c in plain_components(texts, 80).values()}
        if name == "secret_scan":
            assert docs.where("text rlike 'AKIA[A-Z0-9]{12}|[0-9a-f]{32}'").count() == 0
    assert docs.agg(F.countDistinct("doc_id")).first()[0] == seen["near_dedup"]


def stored(spark):
    return {p.name for p in Path(shared_folder(spark), "tickledger").iterdir()}


def test_stages_leave_no_table_that_is_not_read_again(spark, tmp_path):
    """Pieces are dealt out without being written before; what components are made from goes when they are known."""
    words = [[f"{chr(97 + d)}{i}" for i in range(120)] for d in range(6)]
    rows = [(d, " ".join(w)) for d, w in enumerate(words)] + [(10 + d, " ".join([*w[:-1], "end"])) for d, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pin(docs, "before")
    before = stored(spark)
    corpus_pipeline.near_dedup(spark, docs, FOLDER).write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(6))
    left = stored(spark) - before
    assert {re.sub("-[0-9a-f]{32}$", "", name) for name in left} == {"shared-ids", "kept-ids"}
    corpus_pipeline.best_fit_packing(spark, kept, FOLDER).write.parquet(f"{tmp_path}/packed")
    assert stored(spark) - before == left
    assert spark.read.parquet(f"{tmp_path}/packed").count() == 6


def test_tables_on_the_way_are_deleted(spark):
    def outer():
        first = pin(spark.range(5), "first")
        second = pin_alone(spark, lambda: pin(first.where("id > 1"), "third").where("id > 2"), "second")
        return first.join(second, "id")

    pin(spark.range(1), "other")
    before = stored(spark)
    assert sorted(r["id"] for r in pin_alone(spark, outer, "result").collect()) == [3, 4]
    assert {name.split("-")[0] for name in stored(spark) - before} == {"result"}
    pin(spark.range(1), "other")
    assert len(stored(spark) - before) == 2


def test_a_round_of_labels_reads_two_tables_twice(spark, monkeypatch):
    """Plans cost the driver memory: before, a round had twelve scans in its plan."""
    leaves = []

    def noted(df, label):
        if label == "labels":
            leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return pin(df, label)

    monkeypatch.setattr(minhash, "pin", noted)
    labels = minhash.connected(spark.createDataFrame([(1, 2), (3, 2), (7, 9), (8, 8)], "a long, b long")).collect()
    assert sorted((r["node"], r["label"]) for r in labels) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 8), (9, 7)]
    assert len(leaves) > 1 and max(leaves) <= 4


def test_buckets_in_one_component_are_not_compared_again(spark, monkeypatch):
    monkeypatch.setattr(minhash, "_across", None)
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"end{i}"])) for i in range(4)], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.components(docs).collect()} == {0}


def test_unlearned_languages_and_junk_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    random.seed(13)
    strange = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        *["".join(random.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (100, 300, 1000, 5000) for _ in range(5)],
    ]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(strange)], docs.schema)
    kept = [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(more), FOLDER).select("doc_id").collect()]
    assert min(kept) >= 0 and len(kept) >= 0.99 * docs.count()


def test_pipeline_stages_on_awkward_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, secrets string, kept string, own string"
    rows = [(None, None, None, None, None, None, None, None, None), (1, "", "en", "s", 0, "x", "y", "z", "w"), (2, "word " * 80, None, "s", 5, "x", "y", "z", "w"), (2, "word " * 80, None, "s", 5, "x", "y", "z", "w"), (3, " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(3000)), "en", None, 1, "x", "y", "z", "w")]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, FOLDER).columns == table.columns
            stage(spark, table, FOLDER).collect()
        corpus_pipeline.STAGES[-1][1](spark, table, FOLDER).collect()


def test_components_without_links(spark):
    """No rows, one row, and rows that share nothing: every document is its own component."""
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.components(empty).collect() == [] and minhash.connected(empty.selectExpr("doc_id as a", "doc_id as b")).collect() == []
    apart = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n"), (3, None)], "doc_id long, text string")
    assert sorted((r["id"], r["component_id"]) for r in minhash.components(apart).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_bands_follow_the_similarity():
    for percent in (50, 80, 85, 95, 100):
        s = minhash.Settings(percent=percent)
        assert (1 - min(percent / 100, 0.999) ** s.rows) ** s.bands < s.miss and s.coordinates <= s.most_coordinates
