"""Yinyang grouping against Lloyd's algorithm in whole numbers."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tideline.llm import yinyang


def _seeds():
    return F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)


def _lloyd(rows, k, rounds):
    """rows: (id, whole-number vector)."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    centres = [r[1] for r in ordered[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        held = [[] for _ in centres]
        for _, v in rows:
            held[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(h) for x in zip(*h, strict=True)] if h else c for h, c in zip(held, centres, strict=True)]
    return sorted((str(i), nearest(v)[1], nearest(v)[0]) for i, v in rows), centres


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, Embedding_ int").withColumnRenamed("Embedding_", "EMBEDDING")


def _check(spark, rows, k, rounds, dims, scale=256, group=2):
    got, centres = yinyang.cluster_vectors(_frame(spark, rows), k=k, rounds=rounds, dims=dims, seeds=_seeds(), scale=scale, group=group)
    got = got.collect()
    whole = [(i, [int(scale * x // 1) for x in v]) for i, v in rows]
    want, want_centres = _lloyd(whole, k, rounds)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == want
    assert centres == want_centres
    return got


@pytest.mark.parametrize("seed", range(3))
def test_equals_lloyd(spark, seed):
    rng = random.Random(seed)
    spots = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(7)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in spots[i % 7]]) for i in range(300)]
    _check(spark, rows, 12, 5, 5)


def test_ties_repeats_and_null_ids(spark):
    """Vectors on a small grid: most distances tie; a third of the rows are one vector, ids repeat and are missing."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(3)), float(rng.randrange(3))]) for i in range(60)] + [(7, [1.0, 1.0])] * 30 + [(None, [2.0, 0.0])] * 5
    _check(spark, rows, 9, 4, 2, scale=1)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5, 0.25]), (2, [-0.5, 0.25])]
    _check(spark, rows, 40, 3, 2)
    out, centres = yinyang.cluster_vectors(_frame(spark, []), k=3, rounds=2, dims=2, seeds=_seeds())
    assert out.collect() == [] and centres == []


def test_what_takes_no_part(spark):
    rows = [(1, [0.5, 0.25]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [None, 0.0]), (7, [])]
    out, _ = yinyang.cluster_vectors(_frame(spark, rows), k=3, rounds=2, dims=2, seeds=_seeds())
    assert [r.vec_id for r in out.collect()] == [1]


def test_large_components(spark):
    """Distances beyond 2**53 stay exact; beyond 2**63 they are refused."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-(1 << 29), 1 << 29)) for _ in range(2)]) for i in range(50)]
    _check(spark, rows, 4, 3, 2, scale=1)
    for big in (2.0**31, 1e300, -1e300):
        with pytest.raises(ValueError, match="2\\*\\*63"):
            yinyang.cluster_vectors(_frame(spark, [(1, [big, 0.0])]), k=1, rounds=1, dims=2, seeds=_seeds(), scale=1)


def test_bounds_spare_distances(spark):
    rng = random.Random(6)
    spots = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in spots[i % 20]]) for i in range(2000)]
    out, _ = yinyang.cluster_vectors(_frame(spark, rows), k=20, rounds=6, dims=8, seeds=_seeds(), group=4)
    cost = out.agg(F.sum("scanned")).collect()[0][0]
    assert cost < 0.5 * 2000 * 20 * 7
