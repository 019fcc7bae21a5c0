"""Centroid clustering on bit planes against plain integers."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tickledger.llm import bitplane as B

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, settings=B.Settings()):
    """(vec_id, cluster, distance) of each usable row and the centroids."""
    kept = [(i, [math.floor(Fraction(x) * settings.scale) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{settings.seed}:{r[0]}".encode()).hexdigest()))
    centroids = [v for _, v in drawn[: settings.k]]

    def assigned():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(settings.rounds):
        found = assigned() if centroids else []
        for c in range(len(centroids)):
            members = [v for (_, v), (_, own, _) in zip(kept, found, strict=True) if own == c]
            if members:
                centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = assigned() if centroids else []
    return sorted(((i, c, min(d, B.LARGEST)) for i, c, d in found), key=str), centroids


def found(spark, rows, settings=B.Settings(), schema=SCHEMA):
    table, centroids = B.clustered(spark.createDataFrame(rows, schema), settings)
    return sorted((tuple(r) for r in table.collect()), key=str), centroids


def vectors(rng, n, size=1.0):
    return [(i, [rng.gauss(0, size) for _ in range(64)]) for i in range(n)]


def test_random_vectors(spark):
    rows = vectors(random.Random(1), 300, 0.2)
    assert found(spark, rows) == plain(rows)


def test_unusable_rows_take_no_part(spark):
    rows = vectors(random.Random(2), 40)
    rows += [(100, None), (101, [1.0] * 63), (102, [1.0] * 63 + [None]), (103, [float("nan")] + [1.0] * 63), (104, [float("inf")] * 64), (105, []), (None, [0.5] * 64)]
    got, centroids = found(spark, rows)
    assert (got, centroids) == plain(rows)
    assert len(got) == 41


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_rows_than_clusters(spark, n):
    rows = vectors(random.Random(3), n)
    assert found(spark, rows) == plain(rows)


def test_ties_copies_and_repeated_ids(spark):
    rows = [(i % 7, [float(i % 3)] * 64) for i in range(60)]
    got, _ = found(spark, rows)
    assert len(got) == 60
    rows = [(i, [0.0] * 64) for i in range(30)]
    assert found(spark, rows) == plain(rows)
    assert {c for _, c, _ in found(spark, rows)[0]} == {0}


def test_huge_and_tiny_components(spark):
    """Sums and products beyond 64 bits stay exact; distances beyond a long are the largest long."""
    rng = random.Random(4)
    rows = vectors(rng, 20) + [(50 + i, [rng.choice([1e300, -1e300, 5e-324, 1e9, -0.0]) for _ in range(64)]) for i in range(10)]
    rows += [(90, [1.7e308] * 64), (91, [-1.7e308] * 64)]
    assert found(spark, rows) == plain(rows)


def test_dot_products_from_planes():
    rng = np.random.default_rng(1)
    for high in (2, 1000, 2**26, 2**40):
        x = rng.integers(-high, high, (50, 64))
        c = rng.integers(-high * 3, high, 64)
        planes, own = B.planes_of(x), B.planes_of(c[None, :])[0]
        wide = x.astype(object)
        assert B.dots(planes, own).tolist() == (wide @ c.astype(object)).tolist()
        assert B.norms(planes).tolist() == (wide * wide).sum(axis=1).tolist()
        assert B.position_sums(planes) == wide.sum(axis=0).tolist()


def test_clashing_columns_are_not_read(spark):
    rows = [(i, v, "a", 1) for i, v in vectors(random.Random(5), 20)]
    assert found(spark, rows, schema=SCHEMA + ", cluster string, key int") == plain([r[:2] for r in rows])
