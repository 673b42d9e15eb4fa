"""The Parzen search: deterministic, in large spaces, better than chance; batches are scored by one job each."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import search as S

SPACE = {"a": S.Real(1e-4, 10, log=True), "b": S.Real(-5, 5), "n": S.Real(1, 500, log=True, whole=True), "c": S.Choice(("p", "q", "r"))}


def _smooth(batch):
    return [-((math.log10(s["a"]) + 2) ** 2) - (s["b"] - 1.5) ** 2 - (math.log(s["n"]) - 3) ** 2 - (s["c"] != "q") for s in batch]


def test_settings_lie_in_the_space_and_repeat():
    one, two = (S.parzen_batches(SPACE, _smooth, 60, seed=3) for _ in range(2))
    assert one == two and len(one) == 60
    for s, _ in one:
        assert 1e-4 <= s["a"] <= 10 and -5 <= s["b"] <= 5 and 1 <= s["n"] <= 500 and s["n"] == int(s["n"]) and s["c"] in "pqr"
    assert len({tuple(s.values()) for s, _ in one}) > 55


def test_better_than_random_search():
    wins, learnt, chance = 0, [], []
    for seed in range(12):
        learnt.append(S.best_of(S.parzen_batches(SPACE, _smooth, 80, seed=seed))[1])
        chance.append(S.best_of(S.random_batches(SPACE, _smooth, 80, seed=seed))[1])
        wins += learnt[-1] > chance[-1]
    assert wins >= 9 and sum(learnt) / 12 > 0.5 * sum(chance) / 12


def test_density_is_one():
    for dim, values in ((S.Real(1e-3, 10, log=True), [0.01, 0.02, 5.0]), (S.Real(-1, 3), [0.0]), (S.Real(-1, 3), [-1.0, 3.0, 3.0, 2.5])):
        steps = 4000
        assert sum(dim.density(values, dim.value((i + 0.5) / steps)) for i in range(steps)) / steps == pytest.approx(1, abs=1e-3)
    choice = S.Choice(("x", "y", "z"))
    assert sum(choice.density(["x", "x", "y"], v) for v in choice.values) == pytest.approx(1)
    with pytest.raises(ValueError):
        S.Real(0, 1, log=True)


def test_scores_that_are_missing_count_as_worst():
    tried = S.parzen_batches({"b": S.Real(0, 1)}, lambda batch: [math.nan if s["b"] < 0.5 else s["b"] for s in batch], 40)
    assert S.best_of(tried)[1] > 0.9


def test_a_batch_is_one_job(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), i, float(rng.randrange(-20, 20))) for i in range(300)]
    frame = spark.createDataFrame(rows, "team int, i int, margin double")
    settings = [{"window": float(w), "shrink": s, "edge": e} for w, s, e in ((1, 0.5, 0.0), (7, 20.0, 3.0), (60, 1.0, -2.0), (500, 5.0, 1.0))]
    calls = []
    plain = S.last_n_errors(frame, "team", ("i",), "margin")
    scores = S.scored_together(spark, "window double, shrink double, edge double", lambda df: (calls.append(1), plain(df))[1])(settings)
    assert len(calls) == 1
    for s, got in zip(settings, scores, strict=True):
        error = 0.0
        for t, i, v in rows:
            last = [x for u, j, x in rows if u == t and j < i][-int(s["window"]) :]
            n = len(last)
            guess = s["edge"] + (n / (n + s["shrink"]) * sum(last) / n if n else 0.0)
            error += abs(v - guess)
        assert got == pytest.approx(-error / len(rows))
    none = S.scored_together(spark, "window double", lambda df: df.where("window > 5").select("setting", F.lit(1.0).alias("score")))([{"window": 1.0}, {"window": 9.0}])
    assert math.isnan(none[0]) and none[1] == 1.0


def test_search_over_jobs_equals_the_plain_search(spark):
    """Trials by Spark jobs are those of the same search with a scorer in plain Python."""
    rng = random.Random(6)
    rows = [(rng.randrange(3), i, float(rng.randrange(-20, 20))) for i in range(120)]
    frame = spark.createDataFrame(rows, "team int, i int, margin double")
    space = {"window": S.Real(2, 40, log=True, whole=True), "shrink": S.Real(0.5, 100, log=True), "edge": S.Real(-10, 10)}

    def plain(batch):
        out = []
        for s in batch:
            error = 0.0
            for t, i, v in rows:
                last = [x for u, j, x in rows if u == t and j < i][-int(s["window"]) :]
                error += abs(v - s["edge"] - (sum(last) / (len(last) + s["shrink"]) if last else 0.0))
            out.append(-error / len(rows))
        return out

    jobs = S.parzen_batches(space, S.scored_together(spark, "window double, shrink double, edge double", S.last_n_errors(frame, "team", ("i",), "margin")), 24, first=8)
    same = S.parzen_batches(space, plain, 24, first=8)
    assert [s for s, _ in jobs] == [s for s, _ in same]
    assert [v for _, v in jobs] == pytest.approx([v for _, v in same])
