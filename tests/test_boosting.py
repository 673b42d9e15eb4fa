"""Boosted trees against a plain search over every split, and family errors by their definition."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import boosting as B
from tideline.operators import evaluate

NAMES = ["a", "b", "c"]


def _data(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.choice([None, *range(12)])
        b, c = rng.gauss(0, 1), rng.randrange(4) / 2
        y = (3.0 if a is None else a / 2) + (2 if b > 0.3 else 0)
        rows.append((i, None if a is None else float(a), b, c, round(y + rng.gauss(0, 0.2), 3), round(c - y, 3)))
    return rows


def _draw(key, seed):
    return int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)


def _plain(rows, role, rules):
    """The same model in plain Python; role: key -> role. Returns predictions in units and the errors after each number of trees."""
    units = {r[0]: [math.floor(y / rules.unit + 0.5) for y in r[4:6]] for r in rows}
    x = {r[0]: r[1:4] for r in rows}
    train = [k for k in x if role(k) == B.TRAIN]
    borders = []
    for j in range(3):
        v = sorted(x[k][j] for k in train if x[k][j] is not None)
        borders.append(sorted({v[-(-q * len(v) // rules.bins) - 1] for q in range(1, rules.bins)}) if v else [])
    bins = {k: [None if v is None else sum(b < v for b in borders[j]) for j, v in enumerate(x[k])] for k in x}
    base = [sum(units[k][t] for k in train) // len(train) for t in range(2)]
    pred = {k: list(base) for k in x}
    history, errors = [{k: list(v) for k, v in pred.items()}], []

    def right(k, s):
        b = bins[k][s[0]]
        return s[2] if b is None else b > s[1]

    def part(keys):
        if not keys:
            return 0.0
        s = [float(sum(units[k][t] - pred[k][t] for k in keys)) for t in range(2)]
        return s[0] * s[0] / (len(keys) + rules.l2) + s[1] * s[1] / (len(keys) + rules.l2)

    for tree in range(rules.trees):
        seen = [k for k in train if (_draw(k, rules.seed) + tree * B._STEP) % B._WORD * B._TURN % B._WORD < int(rules.subsample * B._WORD)]
        splits, leaf = [], {k: 0 for k in x}
        for level in range(rules.depth):
            groups = [[k for k in seen if leaf[k] == n] for n in range(1 << level)]
            best = None
            for j in rules.features_of(tree, level, 3):
                for k in range(len(borders[j])):
                    for side in (False, True):
                        s = (j, k, side)
                        left = [sum((part([r for r in g if right(r, s) == way]) for way in (False,)), 0.0) for g in groups]
                        score = sum(le + part([r for r in g if right(r, s)]) for le, g in zip(left, groups, strict=True))
                        if best is None or score > best[0]:
                            best = (score, s)
            splits.append(best[1])
            for k in x:
                leaf[k] += right(k, best[1]) << level
        for n in range(1 << rules.depth):
            own = [k for k in seen if leaf[k] == n]
            value = [math.floor(rules.rate * float(sum(units[k][t] - pred[k][t] for k in own)) / (len(own) + rules.l2) + 0.5) if own else 0 for t in range(2)]
            history_pred = [k for k in x if leaf[k] == n]
            for k in history_pred:
                pred[k] = pred[k] if not own else [p + v for p, v in zip(pred[k], value, strict=True)]
        history.append({k: list(v) for k, v in pred.items()})
    for h in history:
        errors.append(sum((units[k][t] - h[k][t]) ** 2 for k in x if role(k) == B.VALIDATION for t in range(2)))
    return history, errors, units


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, z double").repartition(5)


def _roles():
    i = F.col("id")
    return [F.when(i < 120, B.TRAIN).when(i < 160, B.VALIDATION).when(i < 200, B.TEST), F.when(i < 60, B.TRAIN).when(i.between(60, 99), B.VALIDATION)]


def _role_of(fold):
    return (lambda k: B.TRAIN if k < 120 else B.VALIDATION if k < 160 else B.TEST) if fold == 0 else (lambda k: B.TRAIN if k < 60 else B.VALIDATION if k < 100 else None)


@pytest.mark.parametrize("rules", [B.BoostingRules(trees=3, depth=2, rate=0.4, bins=8, patience=None, checkpoint=2), B.BoostingRules(trees=2, depth=1, rate=1.0, bins=4, subsample=0.5, colsample=0.5, l2=1.0, patience=None)])
def test_equals_a_plain_search(spark, rules):
    rows = _data(200, 1)
    state, forests = B.fit_boosted(_frame(spark, rows), "id", NAMES, ["y", "z"], _roles(), rules)
    got = {(r.fold, r.key): (r.pred_y, r.pred_z, r.y, r.z) for r in B.predict_boosted(state, forests, ["y", "z"], rules.unit).collect()}
    assert len(got) == 300
    for fold in (0, 1):
        history, _, units = _plain(rows, _role_of(fold), rules)
        for k in range(200):
            if _role_of(fold)(k):
                assert got[fold, k] == pytest.approx([v * rules.unit for v in (*history[-1][k], *units[k])], abs=1e-9)


def test_stops_and_keeps_the_best(spark):
    """Noise as the second target: after a few trees the validation error rises."""
    rng = random.Random(2)
    rows = [(*r[:5], rng.gauss(0, 5)) for r in _data(200, 3)]
    rules = B.BoostingRules(trees=12, depth=2, rate=0.8, bins=8, subsample=1.0, colsample=1.0, patience=2, checkpoint=3)
    _, forests = B.fit_boosted(_frame(spark, rows), "id", NAMES, ["y", "z"], _roles(), rules)
    for fold, forest in enumerate(forests):
        _, errors, _ = _plain(rows, _role_of(fold), rules)
        assert forest.errors == errors[: len(forest.errors)]
        assert forest.best == min(range(len(forest.errors)), key=forest.errors.__getitem__)
        assert len(forest.errors) == min(13, next((i for i in range(13) if i - min(range(i + 1), key=errors.__getitem__) >= 2), 12) + 1)


def test_missing_values_choose_their_side(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 7), 0.0, 0.0, 10.0 if i % 3 == 0 else 0.0, 0.0) for i in range(120)]
    rules = B.BoostingRules(trees=1, depth=1, rate=1.0, bins=8, l2=1e-9, subsample=1.0, colsample=1.0, patience=None)
    state, forests = B.fit_boosted(_frame(spark, rows), "id", NAMES, ["y", "z"], [F.lit(B.TRAIN)], rules)
    assert forests[0].trees[0][0][0][0] == 0
    p = {r.key: r.pred_y for r in B.predict_boosted(state, forests, ["y", "z"], rules.unit).collect()}
    assert min(p[k] for k in range(0, 120, 3)) > max(p[k] for k in range(120) if k % 3)


def test_nothing_to_learn_from(spark):
    rules = B.BoostingRules(trees=2, depth=2, bins=8, patience=None)
    flat = [(i, 1.0, None, 2.0, 5.0, float("nan") if i == 3 else None if i == 4 else 1.0) for i in range(20)]
    state, forests = B.fit_boosted(_frame(spark, flat), "id", NAMES, ["y", "z"], [F.lit(B.TRAIN), F.lit(B.VALIDATION)], rules)
    assert not forests[1].trees
    assert {round(r.pred_y, 6) for r in B.predict_boosted(state, forests, ["y", "z"], rules.unit).where("fold = 0").collect()} == {5.0}
    empty, forests = B.fit_boosted(_frame(spark, flat).where("false"), "id", NAMES, ["y", "z"], [F.lit(B.TRAIN)], rules)
    assert B.predict_boosted(empty, forests, ["y", "z"]).collect() == []


def test_family_errors(spark):
    rows = _data(200, 5)
    rules = B.BoostingRules(trees=3, depth=2, rate=0.5, bins=8, patience=None)
    state, forests = B.fit_boosted(_frame(spark, rows), "id", NAMES, ["y", "z"], _roles(), rules)
    donors = evaluate.donors(state.where(F.col("role") == B.VALIDATION), "key", 9, ["fold"])
    lent = {(r.fold, r.key): r.donor for r in donors.collect()}
    for fold, keys in ((0, range(120, 160)), (1, range(60, 100))):
        shuffled = sorted(keys, key=lambda k: hashlib.sha256(f"9:{fold}:{k}".encode()).hexdigest())
        assert {k: lent[fold, k] for k in keys} == dict(zip(keys, shuffled, strict=True))
    got = {(r.fold, r.family): (r.n, r.diff_mae, r.total_mae) for r in B.family_errors(state, forests, donors, {"ab": [0, 1], "c": [2]}, rules.unit).collect()}
    held = {(r.fold, r.key): r for r in state.collect()}
    for (fold, family), (n, diff, total) in got.items():
        own = {"none": [], "ab": [0, 1], "c": [2]}[family]
        keys = range(120, 160) if fold == 0 else range(60, 100)
        d = t = 0
        for k in keys:
            bins = list(held[fold, k].bins)
            for j in own:
                bins[j] = held[fold, lent[fold, k]].bins[j]
            p = list(forests[fold].base)
            for splits, _, leaves in forests[fold].trees:
                leaf = sum((side if bins[f] == B.MISSING else bins[f] > b) << v for v, (f, b, side) in enumerate(splits))
                p = [x + v for x, v in zip(p, leaves[leaf], strict=True)]
            y = [int.from_bytes(held[fold, k].y[8 * i : 8 * i + 8], "little", signed=True) for i in range(2)]
            d += abs((y[0] - p[0]) - (y[1] - p[1]))
            t += abs(sum(y) - sum(p))
        assert n == 40 and diff == pytest.approx(d / 40 * rules.unit) and total == pytest.approx(t / 40 * rules.unit)
