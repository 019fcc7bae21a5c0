"""Cases that earlier forms of the nearest-neighbour search and the word hashes got wrong."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickledger.llm import ann, langid, minhash


def brute(rows, queries, k):
    vectors = {i: np.array(v) for i, v in rows}
    out = {}
    for q in queries:
        with np.errstate(over="ignore", invalid="ignore"):
            scores = [(-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q]
        out[q] = [i for _, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("size", [1.0, 1e-160, 1e155, 1e300])
def test_walk_over_few_vectors_of_any_length(spark, size):
    """200 vectors go through the heap walk; squares of huge and tiny ones leave the range of doubles."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=16) * size).tolist()) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(table, F.col("vec_id") % 20 == 0)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    wanted = brute([(i, (np.array(v) / size).tolist()) for i, v in rows], range(0, 200, 20), 20)
    assert set(got) == set(wanted) and all(len(x) == 20 for x in got.values())
    recall = np.mean([len(set(got[q]) & set(wanted[q])) / 20 for q in wanted])
    if size < 1e155:  # scores beyond the range of doubles tie, so smaller ids win
        assert recall >= 0.9


def test_words_that_fool_polynomials_modulo_a_power_of_two():
    """The two halves of a Thue-Morse word collide under any polynomial modulo 2^64."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    one, other = word[:1024].encode(), word[1024:].encode()
    assert one != other and len(one) == len(other)
    assert minhash.shingles([one], 5) != minhash.shingles([other], 5)


def test_unlike_documents_with_such_words_are_not_linked(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"p q {word[:1024]} r s"), (2, f"p q {word[1024:]} r s"), (3, f"p q {word[1024:]} r s")], "doc_id long, text string")
    found = {r["id"]: r["component_id"] for r in minhash.components(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 2}


def test_equal_words_hash_alike_at_any_place():
    words = [b"alpha", b"be", b"c", b"alpha", b"be", b"c", b"\xc3\xa9t\xc3\xa9"]
    assert len(minhash.shingles(words, 1)) == 4
    assert len(minhash.shingles(words, 3)) == 4


def test_language_takes_the_text_out_of_its_row(spark):
    """A text passes to Python once, also where it is a field of a struct."""
    data = [(1, "the cat and the dog", "en"), (2, None, "en"), (3, "der Hund und die Katze", "de"), (4, "1 2", None), (5, "die Katze", "de")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(docs.select("text", "lang"))
    flat = langid.predict(docs, model, margin="margin")
    nested = langid.predict(docs.select(F.struct("*").alias("doc")), model, text="doc.text", margin="margin")
    beside = langid.predict(docs, model, text="TEXT", margin="margin")
    wanted = sorted(map(tuple, flat.collect()), key=str)
    assert sorted((*r["doc"], *r[1:]) for r in nested.collect()) == sorted(wanted, key=lambda r: r[0])
    assert sorted(map(tuple, beside.collect()), key=str) == wanted
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (flat, nested)]
    assert not any("AS value#" in p for p in plans)
