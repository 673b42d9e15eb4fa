"""Suffix arrays, features, weights and draws against their definitions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NASTY = [None, "", "   ", "!?.-_", "Ünï CODE Éa", "a\x00b\x7fc", "don't stop 42nd", "日本語 テキスト", "x" * 3000, "same same same same", "É é", "\x85 \xa0 　z", "\U0001f9ff😀"]


def _features(text, most):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_suffix_array(depth):
    rng = random.Random(depth)
    words = np.array([rng.choice([-1, 0, 1, 2]) for _ in range(200)])
    order, lcp = resampling.suffix_array(words, depth)
    ends = iter(range(-1, -300, -1))
    key = [next(ends) if w < 0 else int(w) for w in words]
    heads = [key[i : i + depth] for i in order]
    assert sorted(order.tolist()) == list(range(200))
    groups = [tuple(h) for h in heads]
    assert all(len({j for j, g in enumerate(groups) if g == h}) == max(j for j, g in enumerate(groups) if g == h) - min(j for j, g in enumerate(groups) if g == h) + 1 for h in set(groups))
    for a, b, n in zip(heads, heads[1:], lcp[1:].tolist(), strict=False):
        assert n == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("most", [1, 2, 3])
def test_buckets_of_features(most):
    rng = random.Random(9)
    texts = NASTY + [" ".join(rng.choice(["red", "Green", "blue7", "ñandú", "x"]) for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    flat, edges, n_words = resampling.gram_buckets(pa.array([None if t is None else t.encode() for t in texts], pa.binary()), most, 997)
    for i, t in enumerate(texts):
        want = Counter(zlib.crc32(f.encode()) % 997 for f in _features(t, most))
        assert Counter(flat[edges[i] : edges[i + 1]].tolist()) == want, t
        assert n_words[i] == len(_features(t, 1))


def _brute(docs, target, share, most, buckets, least):
    s, t = (Counter(zlib.crc32(f.encode()) % buckets for text in texts for f in _features(text, most)) for texts in ([x[1] for x in docs], target))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    out = []
    for i, text in docs:
        own = [gain(zlib.crc32(f.encode()) % buckets) for f in _features(text, most)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(_features(text, 1)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {r: k for k, r in enumerate(fit, 1) if k <= share * len(fit) // 100}
    return Counter((*r, rank.get(r)) for r in out)


@pytest.mark.parametrize("most", [1, 2])
def test_draw(spark, most):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = list(enumerate(NASTY + [" ".join(rng.choices(vocabulary, weights=range(1, 301), k=rng.randrange(5, 80))) for _ in range(250)]))
    docs += [(None, "w1 " * 30)]
    target = ["w1 w2 w3 w4 " * 5, None, "w250 w1"]
    frame = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, TEXT_ int").withColumnRenamed("TEXT_", "TEXT").repartition(5)
    aims = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = resampling.resampled(frame, aims, share=10, most=most, buckets=500)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == _brute(docs, target, 10, most, 500, 20)


def test_repeated_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    aims = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resampling.resampled(none, aims, share=10).collect() == []
    docs = spark.createDataFrame([(5, "a b c " * 10)] * 40, "doc_id long, text string")
    rows = resampling.resampled(docs, aims.where("false"), share=10).collect()
    assert sorted(r.rank for r in rows if r.rank) == [1, 2, 3, 4] and len(rows) == 40


def test_a_long_text(monkeypatch):
    """Two megabytes of one word, and a chunk of one text alone."""
    text = b"word " * 400_000
    flat, edges, n_words = resampling.gram_buckets(pa.array([b"x", text], pa.binary()), 1, 10_000)
    assert n_words.tolist() == [1, 400_000] and set(flat[1:].tolist()) == {zlib.crc32(b"word") % 10_000}
