"""Inputs that once broke an operator: labels without documents, long runs and pages, large components, many ranges, empty targets."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideline.llm import language, mixing, toxicity, vector_topk, winnowing


def _talk(rng, toxic):
    clean = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(1, 6))]
    if toxic:
        clean.insert(rng.randrange(len(clean) + 1), f"you are {rng.choice(['vile', 'stink'])} w{rng.randrange(60)}")
    return ". ".join(clean) + "."


def test_labels_of_absent_documents_change_nothing(spark):
    rng = random.Random(1)
    rows = [(i, _talk(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    absent = spark.range(2_000_000).select((F.col("id") + 10**9).alias("doc_id"), F.lit(1).alias("toxic"))
    one, two = (toxicity.fit_toxicity(docs, x, F.lit(True)) for x in (labels, labels.unionByName(absent)))
    assert len(one.weights) > 3 and one == two


def _plain_fit(texts, labels):
    """The same noisy-or fit by plain loops."""
    y, n = labels, len(labels)
    feats = lambda run: toxicity.features(b) if (b := re.sub(r"^[\W_]+|[\W_]+$", "", run)) else []
    seen, positive = Counter(), Counter()
    for t, label in zip(texts, y, strict=True):
        own = {f for run in t.lower().split() for f in feats(run)}
        seen.update(own)
        positive.update(own if label else ())
    rate = sum(y) / n
    z = {f: (positive[f] - c * rate) / math.sqrt(c * rate * (1 - rate)) for f, c in seen.items() if c >= toxicity.LEAST_DOCS}
    chosen = sorted((f for f, v in z.items() if abs(v) >= toxicity.LEAST_Z), key=lambda f: (-abs(z[f]), f))
    bags = []
    for d, t in enumerate(texts):
        for s in re.split(r"[.!?\n]+", t):
            runs = set(s.lower().split())
            if runs:
                bags.append((d, Counter(f for run in runs for f in feats(run) if f in set(chosen))))
    w, bias = dict.fromkeys(chosen, 0.0), -6.0
    m1, m2, b1, b2 = dict(w), dict(w), 0.0, 0.0
    for step in range(1, toxicity.ROUNDS + 1):
        none = [0.0] * n
        zs = []
        for d, bag in bags:
            v = bias + sum(w[f] * c for f, c in bag.items())
            zs.append(v)
            none[d] += math.log1p(math.exp(v))
        gw, gb = {f: 0.0 for f in w}, 0.0
        for (d, bag), v in zip(bags, zs, strict=True):
            slope = 1 / (1 + math.exp(-v)) * (-math.exp(-none[d]) / max(1 - math.exp(-none[d]), 1e-12) if y[d] else 1.0)
            gb += slope / n
            for f, c in bag.items():
                gw[f] += slope * c / n
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        for f in w:
            g = gw[f] + toxicity.DECAY * w[f]
            m1[f], m2[f] = 0.9 * m1[f] + 0.1 * g, 0.99 * m2[f] + 0.01 * g * g
            w[f] -= 0.1 * (m1[f] / c1) / (math.sqrt(m2[f] / c2) + 1e-8)
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        bias -= 0.1 * (b1 / c1) / (math.sqrt(b2 / c2) + 1e-8)
    return bias, {f: x for f, x in w.items() if abs(x) > 1e-4}


def test_noisy_or_fit_by_plain_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", 40)
    rng = random.Random(2)
    texts = [_talk(rng, i % 3 == 0) + rng.choice(["", " --x--", " (w1)"]) for i in range(90)]
    labels = [int(i % 3 == 0) for i in range(90)]
    model = toxicity.fit(texts, labels)
    bias, weights = _plain_fit(texts, labels)
    assert model.bias == pytest.approx(bias, abs=1e-6) and set(model.weights) == set(weights)
    assert all(model.weights[f] == pytest.approx(x, abs=1e-6) for f, x in weights.items())


def test_edges_are_those_of_the_pattern_and_linear():
    rng = random.Random(3)
    for _ in range(2000):
        run = "".join(rng.choice("aZ9é_-.،٣'ß") for _ in range(rng.randrange(0, 9)))
        assert toxicity.bare(run) == re.sub(r"^[\W_]+|[\W_]+$", "", run)
    scorer = toxicity.Scorer(toxicity.Model(-2.0, {"a": 1.0}))
    for run in ("a" + "-" * (4 << 20) + "b", "-" * (4 << 20)):
        began = time.perf_counter()
        scorer.sentences(run)
        assert time.perf_counter() - began < 3
    assert not scorer.known or max(map(len, scorer.known)) <= toxicity.LONGEST


_BY_PATTERN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.ASCII | re.IGNORECASE | re.DOTALL)


def test_page_text_is_that_of_the_pattern():
    rng = random.Random(4)
    parts = ["<", ">", "<!--", "-->", "<script", "</script >", "<STYLE>", "</style\n>", "</SCRIPT>", "scripts", " text ", "&amp;", "&#1234;", "é", "<p a='x'>", "-", "!", "<scripted>"]
    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))
        assert language.page_text(page) == re.sub(r"&#?\w{1,31};", " ", _BY_PATTERN.sub(" ", page), flags=re.ASCII), page


@pytest.mark.parametrize("part", ["<", "<!--", "<script>", "<style ", "</script", "<script></style>", "&", "<html lang"])
def test_long_pages_take_linear_time(spark, part):
    page = part * ((4 << 20) // len(part))
    began = time.perf_counter()
    language.page_text(page)
    assert time.perf_counter() - began < 2
    if part in ("<html lang", "<"):
        model = language.fit_text(["the and ing the"], ["en"])
        pages = spark.createDataFrame([(1, "http://" + "a" * 100_000, page[: 1 << 20])], "page_id long, url string, html string")
        assert language.identify_pages(pages, model).count() == 1


@pytest.mark.parametrize("big", [4e9, 1e300, -1e300])
def test_products_never_wrap(spark, big):
    rows = [(7, [big, 1.0]), (8, [1.0, 2.0]), (9, [0.5, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="vector 7 .*2\\*\\*63"):
        vector_topk.voronoi_topk(frame, F.col("id") > 0, scale=1)


def test_products_up_to_the_bound_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-(1 << 30), 1 << 30)) for _ in range(2)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vector_topk.voronoi_topk(frame, F.col("id") % 4 == 0, k=3, scale=1).collect()}
    for i, v in rows:
        if i % 4 == 0:
            best = sorted((-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i)[:3]
            assert [got[i, n + 1] for n in range(3)] == [(j, -s) for s, j in best]


def test_bounds_of_ranges_stay_out_of_the_rows(spark):
    source = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    took = {}
    for ranges in (20, 5000):
        laid = winnowing._laid_out(source, ranges, 20_000)
        assert "bounds" not in {c for c in laid.columns} and laid.where("place = 0").count() == 20_000
        times = []
        for _ in range(3):
            began = time.perf_counter()
            laid.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[ranges] = min(times)
    assert took[5000] < 2 * took[20] + 1
    plan = laid._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("cells", [0, 100_000])
def test_empty_targets_take_nothing(spark, monkeypatch, cells):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", cells)
    docs = spark.createDataFrame([(i, "w w w", "x", "a") for i in range(6)], "doc_id long, text string, lang string, source string").coalesce(1)
    assert {r.copies for r in mixing.mixed(docs, targets={"lang": {}}).collect()} == {0}


def test_fitting_ends_where_it_gains_no_more(spark, monkeypatch):
    """Targets that contradict each other: both ways of fitting stop by the same rule, long before ROUNDS."""
    docs = spark.createDataFrame([(1, "w w", "x", "a"), (2, "w w", "y", "b")], "doc_id long, text string, lang string, source string").coalesce(1)
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}
    rounds, ends = [], mixing._Progress.ends
    monkeypatch.setattr(mixing._Progress, "ends", lambda self, off: (rounds.append(off), ends(self, off))[1])
    monkeypatch.setattr(mixing, "STALLED", 2)
    for cells in (100_000, 0):
        monkeypatch.setattr(mixing, "DRIVER_CELLS", cells)
        with pytest.warns(UserWarning, match="contradict"):
            mixing.mixed(docs, share=0.1, targets=targets)
    assert rounds[: len(rounds) // 2] == pytest.approx(rounds[len(rounds) // 2 :]) and len(rounds) <= 20
