"""Near-duplicates, components, fingerprints, lines and vectors against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import _common, _graph, line_dedup, near_dups, vector_topk, winnowing
from tideline.llm._common import pick
from tideline.llm._graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def _edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def _brute(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def _corpus():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "ONE", "one two three", "One Two  Three", "é è", "É è", "a b c d", "a b c d e"]
    for _ in range(12):
        base = _prose(rng, rng.randrange(20, 200))
        texts += [base, base.upper(), *[_edited(rng, base, e) for e in (1, 2, 4, 8, 12)]]
    family = _prose(rng, 150)
    texts += [_edited(rng, family, rng.randrange(0, 12)) for _ in range(120)] + [family] * 30
    passage = _prose(rng, 60)
    texts += [f"{_prose(rng, rng.randrange(5, 60))}\n{passage}\n{_prose(rng, 10)}" for _ in range(60)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("size", "percent"), [(4, 80), (5, 80), (3, 60)])
def test_near_duplicates(spark, size, percent):
    docs = _corpus()
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, node int, label string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(table, shingle=size, percent=percent).collect()}
    want = _brute(docs, size, percent)
    if percent == 80:
        assert got == want
    else:  # below the design point links may be missed, never invented
        assert all(got[i][0] == want[i][0] and want[got[i][1]][1] == want[i][1] for i in got)
        linked = [i for i in got if sum(want[j][1] == want[i][1] for j in want) > 1]
        assert sum(got[i][1] == want[i][1] for i in linked) >= 0.9 * len(linked)


def _templates(rng, n):
    """A crowd around one long passage: under the threshold, but for a few pairs that are linked."""
    passage = _prose(rng, 300, 10**6)
    pool = [f"p{k}" for k in range(60)]
    texts = [f"{passage} {' '.join(rng.choice(pool) for _ in range(100))}" for _ in range(n)]
    return list(enumerate([*texts, *[_edited(rng, texts[k], 3) for k in range(0, n, 25)]]))


def test_crowd_that_is_not_linked(spark):
    docs = _templates(random.Random(5), 150)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4).collect()}
    assert got == _brute(docs, 4, 80)
    assert 0 < sum(not k for _, _, k in got.values()) < 20
    with pytest.raises(ValueError, match="60"):
        near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=50)


def _alike(rng, n):
    """A crowd without rare shingles: documents of 45 of 60 common passages, hardly a link among them, but for some near copies."""
    passages = [_prose(rng, 20, 10**6) for _ in range(60)]
    texts = [" ".join(passages[k] for k in sorted(rng.sample(range(60), 45))) for _ in range(n)]
    return list(enumerate([*texts, *[_edited(rng, texts[k], 5) for k in range(0, n, 20)]]))


def test_crowd_without_rare_shingles(spark, monkeypatch):
    """Links are those of brute force, and what is confirmed on full sets grows with the crowd, not with its square."""
    docs = _alike(random.Random(6), 300)
    counted, confirmed = [], near_dups._confirmed
    monkeypatch.setattr(near_dups, "_confirmed", lambda pairs, sets, percent: (counted.append(pairs.count()), confirmed(pairs, sets, percent))[1])
    monkeypatch.setattr(near_dups, "BLOCK", 16)  # several blocks a bucket
    monkeypatch.setattr(near_dups, "SMALL", 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4).collect()}
    assert got == _brute(docs, 4, 80)
    assert counted[-1] < 3 * len(docs) < len(docs) ** 2 / 10


def test_wide_sketch_is_near_the_truth():
    rng = np.random.default_rng(2)
    for j in (0.6, 0.8, 0.9):
        n = 900
        common = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64) << np.uint64(1)
        a, b = near_dups.wide_sketches([np.unique(pool[:n]), np.unique(np.concatenate([pool[:common], pool[n : 2 * n - common]]))])
        share = ((a == b).mean() - 1 / 256) / (1 - 1 / 256)
        assert abs(share - j) < near_dups.WIDE_MARGIN


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None), (None, None)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == [(-1, 0, -1, True), (-1, 3, 5, False), (-1, 3, 5, False), (5, 3, 5, True), (5, 3, 5, True), (7, 0, 7, True)]
    assert near_dups.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.8, 0.9):
        n = 2000
        common = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        sets = [np.unique(pool[:n]), np.unique(np.concatenate([pool[:common], pool[n : 2 * n - common]]))]
        regs = near_dups.registers(sets, near_dups.BANDS * near_dups.ROWS)
        est = near_dups.estimated_jaccard(regs[:1], regs[1:], np.array([n]), np.array([n]))[0]
        assert abs(est - j) < near_dups.MARGIN
    far = near_dups.registers([np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64)) for _ in range(2)], 4096)
    assert 0 < near_dups.accidental(np.array([500]), np.array([500]))[0] < 0.002
    assert near_dups.estimated_jaccard(far[:1], far[1:], np.array([500]), np.array([500]))[0] < 0.002


def test_registers_hold_zeros_and_mantissa():
    regs = near_dups.registers([np.array([1 << 63], np.uint64)], 8)
    assert regs.shape == (1, 8) and (regs >> near_dups.MANTISSA).max() <= 32


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(40)] + [(200, k) for k in range(201, 260)] + [(7, 7)]
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- winnowing -----------------------------------------------------------------------------------------------------------


def _winnow(text):
    """Positions by definition: rightmost smallest hash of every window."""
    h = [hash_of(text[i : i + winnowing.K]) for i in range(len(text) - winnowing.K + 1)]
    if not h:
        return [(hash_of(text), 0)] if text else []
    out = []
    for s in range(max(1, len(h) - winnowing.WINDOW + 1)):
        window = h[s : s + winnowing.WINDOW]
        least = min(window)
        at = s + max(k for k, x in enumerate(window) if x == least)
        if (least, at) not in out[-1:]:
            out.append((least, at))
    return out


HASHES: dict[str, int] = {}


def hash_of(gram):
    return HASHES[gram]


def _parse(fingerprint):
    at, out = -1, []
    for i in range(0, len(fingerprint), 8):
        at += int(fingerprint[i + 7], 16) + 1
        out.append((int(fingerprint[i : i + 7], 16), at))
    return out


def _learn(spark, texts):
    grams = {t[i : i + winnowing.K] for t in texts for i in range(max(1, len(t) - winnowing.K + 1))}
    rows = spark.createDataFrame([(g,) for g in grams], "g string").select("g", winnowing._hash(F.col("g")).alias("h")).collect()
    HASHES.update({r.g: r.h for r in rows})


def test_winnowing_by_definition(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "SEGMENT", 40)
    rng = random.Random(4)
    texts = ["", "a", "abcdefg", "abcdefgh", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "é\nñ" * 30, *["".join(rng.choice("abc \n") for _ in range(rng.randrange(400))) for _ in range(30)]]
    texts += ["😀", "😀" * 7, "😀😁" * 40, "a😀" * 100, *["".join(rng.choice("ab\u0301é語😀🧑\U0001d54f\U0010fffd") for _ in range(rng.randrange(300))) for _ in range(30)]]
    _learn(spark, texts)
    got = winnowing.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert _parse(r.fingerprint) == _winnow(texts[r.doc_id]), texts[r.doc_id]


def test_edit_report(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "RANGE_BYTES", 500)
    rng = random.Random(6)
    texts = {i * 2: "".join(rng.choice(rng.choice(["abcd e\n", "é語😀🧑\U0001d54f"])) for _ in range(rng.choice([0, 1, 5, 20, 60, 120, 400]))) for i in range(120)}
    texts[6] = None
    texts |= {10**12: "far from all others, " * 9, -(1 << 63): "the least id 😀", (1 << 63) - 1: "the greatest id"}
    rows = [(i, t, "x") for i, t in texts.items()] + [(None, "lonely text without an id", "x")]
    got = {r.doc_id: r for r in winnowing.edit_report(spark.createDataFrame(rows, "doc_id long, text string, place string").repartition(5)).collect()}
    assert len(got) == len(rows)
    ids = sorted(texts, reverse=True)
    edited = {}
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        x, y = texts[a] or "", texts[b] or ""
        edited[a] = x[: len(x) - len(x) // 3] + y[: len(x) // 3]
        assert got[a].n_chars == len(x)
        assert got[a].edited_sha256 == hashlib.sha256(edited[a].encode()).hexdigest()
    whole = {r.doc_id: r.fingerprint for r in winnowing.fingerprints(spark.createDataFrame(list(edited.items()), "doc_id long, text string")).collect()}
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        assert got[a].edited_fingerprint == whole[a]
        sets = [{h for h, _ in _parse(f)} for f in (got[a].fingerprint, got[a].edited_fingerprint, got[b].fingerprint)]
        for value, other in ((got[a].near_edited, sets[1]), (got[a].near_next, sets[2])):
            assert value == pytest.approx(len(sets[0] & other) / len(sets[0] | other) if sets[0] | other else 1.0)
    assert got[None].n_chars == 25 and got[None].near_next == 0
    assert winnowing.edit_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = winnowing.edit_report(spark.createDataFrame([(1, "abcdefghijkl")], "doc_id long, text string")).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abcdefghabcd").hexdigest() and one.near_next == 1


def test_ranges_split_whatever_the_ids(spark, monkeypatch):
    """One id far off and one id with a third of the rows: no range holds much more than its share."""
    monkeypatch.setattr(winnowing, "RANGE_BYTES", 1000)
    rows = [(i, f"text {i} of its own") for i in range(2000)] + [(10**12, "far")] + [(77, f"{i} of one id") for i in range(1000)]
    laid = winnowing._with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in laid if r.place == 0) == Counter(rows)
    sizes = Counter(r.range for r in laid if r.place == 0)
    assert len(sizes) > 20 and max(sizes.values()) < 400
    assert {r.range for r in laid if r.place} == set(sizes)


def test_long_texts_take_linear_time(spark):
    """A text in one piece is cut and chosen without starting over: 8 times the text takes nowhere near 64 times as long."""
    words = [f"{k * 2654435761 % 1000003}" for k in range(100_000)]

    def seconds(n):
        docs = spark.createDataFrame([(1, " ".join(words * n))], "doc_id long, text string")
        begin = time.monotonic()
        assert winnowing.edit_report(docs).select("near_next").collect()[0].near_next == 1
        return time.monotonic() - begin

    seconds(1)
    assert seconds(8) < 25 * max(1.0, seconds(1))


def test_repeated_ids_follow_each_other(spark):
    got = winnowing.edit_report(spark.createDataFrame([(1, "bbbbbb"), (1, "aaaaaa"), (0, "cccccc")], "doc_id long, text string")).collect()
    assert {r.edited_sha256 for r in got} == {hashlib.sha256(t).hexdigest() for t in (b"aaaabb", b"bbbbcc", b"ccccaa")}


# --- lines ---------------------------------------------------------------------------------------------------------------


def test_lines(spark):
    body = lambda i: f"line {i} of its own that is long enough to be the text\nmore of {i} which is also rather long"
    rows = [(i, f"Cookie notice  \n{body(i)}\nnear {'x' if i < 9 else 'y'}\n", f"s{i % 12}", i) for i in range(40)]
    rows += [(100 + i, "whole copy\nsecond line of it", f"s{i}", 0) for i in range(12)]
    rows += [(200, None, "s1", 0), (201, "", None, 0), (202, "Cookie notice\nx", None, 0), (None, "z", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, N_LINES int").repartition(5)
    got = {r.doc_id: r for r in line_dedup.strip_boilerplate(docs).collect()}
    assert len(got) == len(rows)
    for i in range(40):  # 'near x' is on 9 sites, 'near y' on 12
        kept = f"{body(i)}\nnear x\n" if i < 9 else f"{body(i)}\n"
        assert (got[i].text, got[i].n_lines, got[i].n_removed) == (kept, 5, 1 if i < 9 else 2)
    assert got[100].text == "whole copy\nsecond line of it" and got[100].n_removed == 0
    assert (got[200].text, got[200].n_lines, got[201].text, got[201].n_lines) == (None, 0, "", 1)
    assert (got[202].text, got[202].n_removed) == ("x", 1)
    lenient = {r.doc_id: r for r in line_dedup.strip_boilerplate(docs, max_share=0.5).collect()}
    assert lenient[202].n_removed == 0 and all(lenient[i].text == got[i].text for i in range(40))
    many = "\n".join(["Cookie notice", "own"] * 50_000)
    long = line_dedup.strip_boilerplate(docs.union(spark.createDataFrame([(900, many, "s1", 0)], docs.schema))).where("doc_id = 900").collect()[0]
    assert (long.n_removed, long.text) == (50_000, "\n".join(["own"] * 50_000))
    assert line_dedup.strip_boilerplate(docs.limit(0)).count() == 0


def test_staged_lines_are_few_files(spark, monkeypatch):
    """Where shuffle partitions aren't coalesced, staged tables don't have a file for each; results are as ever."""
    rows = [(100 * i + j, "\n".join(f"common {j} {k}" for k in range(8)) + f"\nown {i} {j}", f"s{i}") for i in range(9) for j in range(100)]
    rows += [(100 * i + j, f"common {j} 3\nown {i} {j}", f"s{i}") for i in range(9, 14) for j in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    files = []

    def counted(df, name, stage=line_dedup.stage):
        files.append(len((out := stage(df, name)).inputFiles()))
        return out

    monkeypatch.setattr(line_dedup, "stage", counted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r for r in line_dedup.strip_boilerplate(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files and max(files) <= max(16, spark.sparkContext.defaultParallelism)
    for i, text, _ in rows:  # the fourth line is on 14 sites, the other common ones on 9
        kept = [x for x in text.split("\n") if not x.endswith(" 3") or x.startswith("own")]
        assert (got[i].text, got[i].n_removed) == ("\n".join(kept), 1)


def test_staged_groups_are_few_files(spark, monkeypatch):
    """Near-duplicates alike, through every stage of theirs; rounds of components too."""
    rng = random.Random(5)
    rows = []
    for g in range(60):
        text = _prose(rng, 60)
        rows += [(10 * g + k, _edited(rng, text, k % 3)) for k in range(6)]
    rows += [(1000 + i, _prose(rng, 40)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs).collect()}
    files = []

    def counted(df, name, stage=near_dups.stage):
        files.append((len((out := stage(df, name)).inputFiles()), name))
        return out

    for module in (near_dups, _graph, _common):
        monkeypatch.setattr(module, "stage", counted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"sketches", "nodes", "buckets", "sets", "links", "known", "groups"} <= {name for _, name in files}
    assert max(files)[0] <= max(16, spark.sparkContext.defaultParallelism)
    assert got == expected and len(set(got.values())) < len(got)


# --- vectors -------------------------------------------------------------------------------------------------------------


def _brute_topk(rows, is_query, k):
    v = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            v.setdefault(i, set()).add(tuple(int(np.floor(256 * float(x))) for x in e))
    out = []
    for q in sorted(v):
        if is_query(q):
            best = sorted({(-sum(a * b for a, b in zip(x, y, strict=True)), i) for x in v[q] for i in v if i != q for y in v[i]})[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("settings", [{}, {"sample": 20, "group_queries": 3, "block_rows": 17}])
def test_topk(spark, settings):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(150)]
    common = rows[10][1]
    rows += [(i, common) for i in range(200, 260)] + [(i, [0.0] * 8) for i in range(300, 310)]
    rows += [(400, None), (410, [None] + [1.0] * 7), (420, [float("nan")] * 8), (430, [float("inf")] * 8), (None, common), (200, common)]
    table = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, id int").repartition(4)
    got = sorted(map(tuple, vector_topk.voronoi_topk(table, F.col("id") % 10 == 0, **settings).collect()))
    assert got == _brute_topk(rows, lambda q: q % 10 == 0, 5)


def test_topk_of_clusters_replicates_little(spark, monkeypatch):
    """Vectors in clusters: a group needs few of them, so far fewer rows than groups x vectors are dealt; results stay exact."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(24, 8)) * 3
    rows = [(i, [float(x) for x in (centres[i % 24] + 0.05 * rng.normal(size=8)).astype(np.float32)]) for i in range(960)]
    counts, count = [], vector_topk._counts
    monkeypatch.setattr(vector_topk, "_counts", lambda data, bounds: counts.extend(count(data, bounds)) or counts)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = sorted(map(tuple, vector_topk.voronoi_topk(table, F.col("id") % 10 == 0, group_queries=4, block_rows=100).collect()))
    assert got == _brute_topk(rows, lambda q: q % 10 == 0, 5)
    assert len(counts) >= 12 and sum(counts) < 0.3 * len(counts) * len(rows)


def test_units_share_and_split():
    assert vector_topk._units([90, 10, 80], [5, 5, 5], 100) == [(0, 1, 100), (1, 1, 10), (0, 1, 100)]
    n = vector_topk.UNIT_QUERIES
    assert vector_topk._units([90, 90, 100], [n, 1, 2 * n + 1], 100) == [(0, 1, 100), (1, 1, 100), (2, 3, 100)]


def test_topk_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert vector_topk.voronoi_topk(spark.createDataFrame([], schema), F.col("id") >= 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.5, 0.5])], schema)
    assert sorted(map(tuple, vector_topk.voronoi_topk(two, F.col("id") % 50 == 0).collect())) == [(0, 1, 50, 32768), (50, 1, 0, 32768)]
    with pytest.raises(ValueError, match="unequal"):
        vector_topk.voronoi_topk(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], schema), F.col("id") == 0)


def test_pick_is_exact(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, other string").toDF("doc_id", "text", "TEXT")
    assert pick(df, "TEXT", "doc_id").collect()[0].asDict() == {"TEXT": "b", "doc_id": 1}
    with pytest.raises(ValueError, match="no column"):
        pick(df, "missing")
