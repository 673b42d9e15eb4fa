"""The mixture's targets are met by the sample itself, not by the weights alone."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import mixing


def _docs(spark, n=3000):
    """A hot source of long texts beside two small ones, in two languages."""
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 200))), rng.choices(["en", "fr"], [8, 2])[0], rng.choices(["hot", "a", "b"], [90, 7, 3])[0]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)


@pytest.mark.parametrize("share,source", [(0.2, {"hot": 0.72, "a": 0.14, "b": 0.14}), (0.5, {"hot": 0.5, "a": 0.3, "b": 0.2})])
def test_sample_meets_its_targets(spark, share, source):
    targets = {"source": source, "lang": {"en": 0.7, "fr": 0.3}}
    rows = mixing.mixed(_docs(spark), share=share, targets=targets).collect()
    total = sum(r.n_tokens for r in rows)
    expected = {r.doc_id: share * r.weight for r in rows}
    for d, target in targets.items():
        mean, real, variance = Counter(), Counter(), Counter()
        for r in rows:
            mean[r[d]] += r.n_tokens * expected[r.doc_id] / (share * total)
            real[r[d]] += r.n_tokens * r.copies / (share * total)
            part = expected[r.doc_id] % 1
            variance[r[d]] += part * (1 - part) * (r.n_tokens / (share * total)) ** 2
        for k, v in target.items():
            assert mean[k] == pytest.approx(v, abs=1e-5) and real[k] == pytest.approx(v, abs=4 * variance[k] ** 0.5)
    assert all(r.probability == pytest.approx(min(1, expected[r.doc_id])) and r.taken == (r.copies > 0) for r in rows)
    assert all(abs(r.copies - expected[r.doc_id]) < 1 for r in rows)
    if share == 0.2:  # no source asks for more than it has
        assert max(r.copies for r in rows) == 1 and sum(r.n_tokens * r.probability for r in rows) == pytest.approx(share * total, rel=1e-5)
    else:
        assert max(r.copies for r in rows) > 1


def test_targets_by_brute_force(spark):
    """Weights are those of a plain loop that fits one dimension after the other; the sample's shares are those reported."""
    docs = _docs(spark, 800)
    targets = {"source": {"hot": 0.6, "a": 0.3, "b": 0.1}, "lang": {"en": 0.5, "fr": 0.5}, "topic": {"note": 0.4, "article": 0.6}}
    mixture = mixing.mixed(docs, share=0.05, targets=targets).cache()
    rows = mixture.collect()
    total = sum(r.n_tokens for r in rows)
    cells = Counter()
    for r in rows:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    x = {k: v / total for k, v in cells.items()}
    for _ in range(500):
        for d, name in enumerate(("source", "lang", "topic")):
            now = Counter()
            for k, v in x.items():
                now[k[d]] += v
            x = {k: v * targets[name].get(k[d], 0) / now[k[d]] if now[k[d]] else 0.0 for k, v in x.items()}
    for r in rows:
        key = r.source, r.lang, r.topic
        assert r.weight == pytest.approx(x[key] * total / cells[key], rel=1e-5)
        assert r.probability == pytest.approx(min(1, 0.05 * r.weight), rel=1e-5)
    sampled = Counter()
    for r in rows:
        sampled["source", r.source] += r.n_tokens * r.copies / sum(q.n_tokens * q.copies for q in rows)
    got = {(r.dimension, r.value): r.sampled for r in mixing.realised(mixture).collect()}
    assert all(got[k] == pytest.approx(v) for k, v in sampled.items()) and len(got) == 7


@pytest.mark.parametrize("by_joins", [False, True])
def test_targets_of_absent_values(spark, monkeypatch, by_joins):
    if by_joins:
        monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
        monkeypatch.setattr(mixing, "ROUNDS", 2)
    rows = mixing.mixed(_docs(spark, 30), targets={"source": {"gone": 1.0}}).collect()
    assert len(rows) == 30 and all((r.weight, r.probability, r.copies, r.taken) == (0, 0, 0, False) for r in rows)


def test_contradicting_targets_warn(spark):
    docs = spark.createDataFrame([(1, "w w", "x", "a"), (2, "w w", "y", "b")], "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="contradict"):
        mixing.mixed(docs, targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}})


def test_columns_of_any_name_stay(spark):
    names = ["_source", "_lang", "_topic", "_tokens", "_form", "c0", "SOURCE", "tokens", "form", "raked"]
    docs = _docs(spark, 40).select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    rows = mixing.mixed(docs).collect()
    assert len(rows) == 40 and all(r[n] == f"own {n}" for r in rows for n in names)
    themed = mixing.mixed(_docs(spark, 40).withColumn("topic", F.when(F.col("doc_id") % 2 == 0, "even")), targets={"topic": {"even": 1.0}}).collect()
    assert all(r.topic == ("even" if r.doc_id % 2 == 0 else None) and (r.doc_id % 2 == 0 or not r.taken) for r in themed)


def test_pipeline_repeats_what_the_mixture_repeats(spark):
    docs = _docs(spark, 600)
    mixed = mixing.mixed(docs, share=corpus_pipeline.MIX_SHARE).where("copies > 0").collect()
    out = corpus_pipeline.mixture(spark, docs, "")
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == {r.doc_id: r.copies for r in mixed}


def test_fit_by_joins_watches_all_dimensions(spark, monkeypatch):
    """Sources meet their targets from the start, languages don't; one source has a target but no documents."""
    rows = [(i, "w " * n, lang, source) for i, (n, lang, source) in enumerate([(40, "x", "a"), (10, "y", "a"), (15, "x", "b"), (35, "y", "b")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    targets = {"source": {"a": 0.4, "b": 0.4, "gone": 0.2}, "lang": {"x": 0.7, "y": 0.3}}
    want = {r.doc_id: r.weight for r in mixing.mixed(docs, share=0.1, targets=targets).collect()}
    rounds, stage = [], mixing.stage
    monkeypatch.setattr(mixing, "stage", lambda df, name: (rounds.append(name), stage(df, name))[1])
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-3)
    monkeypatch.setattr(mixing, "ROUNDS", 12)
    got = {r.doc_id: r.weight for r in mixing.mixed(docs, share=0.1, targets=targets).collect()}
    assert got == {k: pytest.approx(v, abs=0.01) for k, v in want.items()}
    assert 1 < rounds.count("raked") < 12


@pytest.mark.parametrize("cells", [0, 100_000])
def test_weights_need_no_python_on_executors(spark, monkeypatch, cells):
    """The driver's own rows get to the executors without Python workers, which would stay beside those of the other stages."""
    monkeypatch.setattr(mixing, "DRIVER_CELLS", cells)
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('some words ', id) AS text", "concat('s', id % 3) AS source", "concat('l', id % 2) AS lang")
    made = []
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, f=type(spark).createDataFrame, **b: (made.append(f(self, *a, **b)), made[-1])[1])
    out = mixing.mixed(docs, targets={"source": {"s0": 0.5, "s1": 0.3, "s2": 0.2}})
    assert made and not any("ExistingRDD" in df._jdf.queryExecution().toString() for df in made)
    assert {r.source for r in out.where("taken").collect()} == {"s0", "s1", "s2"}
