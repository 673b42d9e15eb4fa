"""Language, toxicity, mixing and the pipeline on small corpora, by brute force or held-out accuracy."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import _common, language, mixing, toxicity
from tideline.llm.queries import ORACLE_SQL, QUERIES

SYLLABLES = {"en": ["the", "ing", "and", "tion", "er", "wh"], "de": ["sch", "ich", "der", "ung", "ein", "ü"], "fr": ["eau", "ou", "qu", "é", "ment", "les"]}


def _words(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def _labelled(rng, n):
    langs = rng.choices(list(SYLLABLES), k=n)
    return [(i, _words(rng, l, rng.randrange(5, 60)), l, f"site{i % 4}", None) for i, l in enumerate(langs)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_of_text_alone():
    rng = random.Random(1)
    train, test = _labelled(rng, 300), _labelled(rng, 200)
    model = language.fit_text([r[1] for r in train], [r[2] for r in train])
    table = model.table()
    right = 0
    for r in test:
        scores = table[language._grams(r[1])].sum(0)
        right += model.languages[int(scores.argmax())] == r[2]
    assert right >= 198


def _fused(model, rows):
    """The same evidence by plain loops. rows: text, declared, suffix, host, domain."""
    n, table = len(model.languages), model.table()
    logs = []
    for r in rows:
        g = language._grams(r[0] or "")
        logs.append([float(table[g, k].astype("float64").sum()) * min(1, language.EFFECTIVE / len(g)) if len(g) else 0.0 for k in range(n)])

    def soft(x):
        top = max(x)
        e = [math.exp(v - top) for v in x]
        return [v / sum(e) for v in e]

    s = [soft(x) for x in logs]
    norm = [((r[1] or "").lower()[:2], (r[2] or "").lower(), r[3] or "", r[4] or "") for r in rows]
    total = [max(sum(x[k] for x in s), 1e-9) for k in range(n)]
    prior = [(total[k] + 1) / (len(rows) + n) for k in range(n)]
    count, sums = defaultdict(int), defaultdict(lambda: [0.0] * n)
    for x, (d, f, h, m) in zip(s, norm, strict=True):
        for key in (("d", d), ("f", f), ("m", m), ("h", m, h)):
            count[key] += 1
            sums[key] = [a + b for a, b in zip(sums[key], x, strict=True)]
    a, out = language.SMOOTH, []
    for x, soft_x, (d, f, h, m), r in zip(logs, s, norm, rows, strict=True):
        post = list(x)
        for kind, v in (("d", d), ("f", f)):
            if v:
                post = [p + math.log((sums[kind, v][k] + a * count[kind, v] / len(rows)) / (total[k] + a)) for k, p in enumerate(post)]
        share = [(sums["m", m][k] + a * prior[k]) / (count["m", m] + a) for k in range(n)]
        if h:
            post = [p + math.log((max(sums["h", m, h][k] - soft_x[k], 0) + a * share[k]) / (count["h", m, h] - 1 + a)) for k, p in enumerate(post)]
        else:
            post = [p + math.log(prior[k]) for k, p in enumerate(post)]
        post = soft(post)
        best = max(post)
        out.append((language.UND, 1.0) if all(v == 0 for v in x) else (model.languages[post.index(best)], best))
    return out


def test_language_fuses_all_evidence(spark):
    rng = random.Random(2)
    train = _labelled(rng, 300)
    model = language.fit_text([r[1] for r in train], [r[2] for r in train])
    rows = []
    for i in range(120):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, rng.choice([_words(rng, lang, rng.choice([1, 3, 30])), None, "", "1234 ###", "zz"]), rng.choice([lang, lang.upper() + "-x", "en", None, ""]), rng.choice([lang, "com", None]), rng.choice([f"{lang}.site", "a.mixed", None]), rng.choice(["site", None])))
    df = spark.createDataFrame([(*r, "old") for r in rows], "id long, text string, declared string, suffix string, host string, domain string, language string").repartition(3)
    got = language.identify(df, model, text=F.col("text"), declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host"), domain=F.col("domain"))
    assert got.columns == ["id", "text", "declared", "suffix", "host", "domain", "language", "posterior", "accepted"]
    found = {r.id: r for r in got.collect()}
    assert len(found) == len(rows)
    for r, (name, p) in zip(rows, _fused(model, [x[1:] for x in rows]), strict=True):
        assert found[r[0]].posterior == pytest.approx(p, abs=1e-6), r
        assert found[r[0]].language == name, r
        assert found[r[0]].accepted == (name != language.UND and p >= language.LEAST)


def test_language_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert language.fit_language(empty).languages == ["und"]
    none = F.lit(None).cast("string")
    model = language.fit_text(["the and"], ["en"])
    for m in (model, language.fit_language(empty)):
        assert language.identify(empty, m, text=F.col("text"), declared=none, suffix=none, host=none, domain=none).count() == 0


def test_samples_never_vanish(spark, monkeypatch):
    """Whatever the number of rows, there is something to learn from; repeats and long texts don't enlarge the sample."""
    rng = random.Random(3)
    docs = spark.createDataFrame(_labelled(rng, 300) * 3, SCHEMA)
    some = lambda most, room: _common.bounded_sample(docs, ["doc_id", "text", "lang"], most, room, "text")
    assert len(some(1000, 1 << 30)) == 300 and len(some(50, 1 << 30)) == 50 and len(some(50, 1)) == 1
    assert sum(len(r.text.encode()) for r in some(50, 2000)) <= 2000
    assert some(50, 1 << 30) == some(50, 1 << 30)
    monkeypatch.setattr(_common, "_about_distinct", lambda hashed: 10**19)
    assert len(some(50, 1 << 30)) == 50
    assert set(language.fit_language(docs).languages) == {*SYLLABLES, "und"}
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    assert toxicity.fit_toxicity(docs, labels, F.lit(True)).bias > -30
    assert some(0, 1) == [] and _common.bounded_sample(docs.limit(0), ["text"], 5, 5, "text") == []


def test_pages(spark):
    html = '<html LANG=fr-FR><head><script>var the = "and";</script><style>p{}</style></head><!-- the --><p>eau &amp; ou</p></html>'
    row = spark.createDataFrame([(html,)], "html string").select(language.visible_text(F.col("html")).alias("t")).collect()[0]
    assert row.t.split() == ["eau", "ou"]
    pages = spark.createDataFrame([(1, "http://www.a.fr/x", html), (2, None, None), (3, "nonsense", "<p>the and the</p>")], "page_id long, url string, html string")
    model = language.fit_text(["eau ou eau les qu", "the and ing the"], ["fr", "en"])
    got = {r.page_id: (r.language, r.accepted) for r in language.identify_pages(pages, model).collect()}
    assert got == {1: ("fr", True), 2: ("und", False), 3: ("en", True)}


# --- toxicity ------------------------------------------------------------------------------------------------------------


def _talk(rng, toxic):
    clean = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 12))) for _ in range(rng.randrange(2, 12))]
    if toxic:
        clean.insert(rng.randrange(len(clean) + 1), f"You are {rng.choice(['vilest', 'vilers', 'fool', 'stink'])} w{rng.randrange(300)}")
    return ". ".join(clean) + "."


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(9)
    rows = [(i, _talk(rng, y := int(rng.random() < 0.2)), y) for i in range(1200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (5002, " .\n. ")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (7000, 1, 1), (0, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit_toxicity(docs, labels, F.col("doc_id") < 800)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    assert len(got) == len(rows) + 3
    held = [(got[i].score, y) for i, _, y in rows if i >= 800]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum(p > n for p in pos for n in neg) / (len(pos) * len(neg)) > 0.99
    located = [(t, o) for i, t, y in rows if i >= 800 and y for o in got[i].offending]
    assert len(located) > 0.8 * len(pos)
    assert sum("You are" in t[o.start : o.end] for t, o in located) > 0.95 * len(located)
    assert [got[i].score for i in (5000, 5001, 5002)] == [0, 0, 0]


def test_noisy_or():
    scorer = toxicity.Scorer(toxicity.Model(-2.0, {"bad": 3.0, "wor*": 1.0}))
    found = scorer.sentences("Bad, world! Fine.\n\n Worst?")
    assert [("Bad, world! Fine.\n\n Worst?"[i:j].strip(), round(z, 6)) for i, j, z in found] == [("Bad, world", 2.0), ("Fine", -2.0), ("Worst", -1.0)]
    p = [1 / (1 + math.exp(-z)) for _, _, z in found]
    assert scorer.fused(found) == pytest.approx(1 - (1 - p[0]) * (1 - p[1]) * (1 - p[2]))
    assert scorer.fused([]) == 0 and scorer.fused([(0, 1, 800.0)]) == 1


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for rows in (labels, labels.limit(0)):
        model = toxicity.fit_toxicity(docs, rows, F.lit(True))
        assert toxicity.toxicity(docs, model).collect()[0].score < 1e-6
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


# --- mixing --------------------------------------------------------------------------------------------------------------


def test_rake_meets_its_targets():
    rng = random.Random(4)
    cells = {(s, l, t): rng.randrange(1, 500) for s in "abc" for l in "xy" for t in "pq" if (s, l) != ("c", "y")}
    targets = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"x": 0.6, "y": 0.4}, {"p": 0.7, "q": 0.3}]
    raked = mixing.rake(cells, targets)
    for d, target in enumerate(targets):
        for k, v in target.items():
            assert sum(x for key, x in raked.items() if key[d] == k) == pytest.approx(v, abs=1e-6)


def _mix_docs(spark, n=4000):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 300))), rng.choices(["en", "fr", None], [6, 3, 1])[0], rng.choices(["hot", "a", "b"], [6, 2, 1])[0]) for i in range(n)]
    rows += [(-1, None, "en", "hot"), (None, "w w w", "en", "a"), (-2, "  \n", "fr", "b")]
    return spark.createDataFrame([(*r, "kept", 9.0) for r in rows], "doc_id long, text string, lang string, source string, WEIGHT string, weight double").repartition(5)


@pytest.mark.parametrize("by_joins", [False, True])
def test_mixture(spark, monkeypatch, by_joins):
    if by_joins:
        monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
        monkeypatch.setattr(mixing, "ROUNDS", 12)
    docs = _mix_docs(spark).drop("WEIGHT", "weight") if by_joins else _mix_docs(spark).select("doc_id", "text", "lang", "source")
    targets = {"source": {"hot": 0.4, "a": 0.3, "b": 0.3}}
    rows = mixing.mixed(docs, share=0.3, targets=targets).collect()
    assert len(rows) == 4003
    total = sum(r.n_tokens for r in rows)
    by = Counter()
    for r in rows:
        by[r.source] += r.n_tokens * r.weight / total
    for k, v in targets["source"].items():
        assert by[k] == pytest.approx(v, abs=1e-4)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(0.3 * total, rel=1e-3)
    assert sum(r.n_tokens for r in rows if r.taken) == pytest.approx(0.3 * total, rel=0.1)
    assert all(0 <= r.probability <= 1 and (r.n_tokens > 0 or not r.taken) for r in rows)
    again = {r.doc_id for r in mixing.mixed(docs.repartition(2), share=0.3, targets=targets).where("taken").collect()}
    assert again == {r.doc_id for r in rows if r.taken}


def test_mixture_of_little(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert mixing.mixed(spark.createDataFrame([], schema)).count() == 0
    blank = mixing.mixed(spark.createDataFrame([(1, "", "en", "a"), (2, None, None, None)], schema)).collect()
    assert [r.taken for r in blank] == [False, False]
    only = mixing.mixed(spark.createDataFrame([(1, "a b", "en", "a")], schema), share=1.0).collect()[0]
    assert only.taken and only.probability == pytest.approx(1) and only.n_tokens == 2
    counts = spark.createDataFrame([(" a\t\nb  c ",), ("",), (None,), ("a",)], "t string").select(mixing.words_in(F.col("t")).alias("n")).collect()
    assert [r.n for r in counts] == [3, 0, 0, 1]


# --- pipeline and queries ------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    rows = _labelled(rng, 80)
    rows = [(i, f"{t}\nthe shared footer", l, f"site{i % 12}", len(t)) for i, t, l, _, _ in rows]
    rows += [(200 + i, rows[3][1], rows[3][2], "site1", 1) for i in range(5)]
    rows += [(300, "#### 1234 ----", "en", "site1", 14), (301, None, "en", "site2", None), (None, rows[5][1], rows[5][2], "site3", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {}
    for name, apply in corpus_pipeline.STAGES:
        out = apply(spark, docs, "").cache()
        if name != "bpe":
            assert out.columns == docs.columns
        kept[name] = out.collect()
        docs = out
    ids = {n: {r.doc_id for r in rows} for n, rows in kept.items()}
    assert not ids["language_id"] & {300, 301} and set(range(80)) <= ids["language_id"]
    assert ids["line_dedup"] == ids["language_id"]
    assert not any("footer" in r.text for r in kept["line_dedup"] if len(r.text) > 60 and r.doc_id is not None and r.doc_id < 80 and r.doc_id != 3)
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"] if r.doc_id is not None and r.doc_id < 80 and "footer" not in r.text)
    assert 3 in ids["near_dups"] and not ids["near_dups"] & set(range(200, 205))
    assert kept["bpe"] and all(r.round_trip and r.n_tokens == len(r.ids) for r in kept["bpe"])
    assert ids["bpe"] <= ids["near_dups"]


def test_near_copies_are_judged_by_row(spark):
    """Ids that repeat or are missing: each group keeps one row, and no other row goes."""
    rng = random.Random(7)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    near = lambda t: t.rsplit(" ", 2)[0]
    rows = [(3, a), (5, near(a)), (5, b), (None, c), (None, near(c)), (None, near(b)), (9, d), (9, d), (11, None), (12, ""), (12, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ROW string").repartition(3)
    kept = corpus_pipeline.near_dups(spark, docs, "")
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got - Counter([(None, c), (None, near(c))]) == Counter([(3, a), (5, b), (9, d), (11, None), (12, ""), (12, "")])
    assert sum(got[None, t] for t in (c, near(c))) == 1


def test_stages_keep_columns_of_any_name(spark):
    rng = random.Random(21)
    names = ["language", "posterior", "accepted", "n_lines", "n_removed", "topic", "n_tokens", "weight", "probability", "taken", "copies", "copy", "c1", "row", "kept", "component_id", "_h"]
    rows = [(i, t, l, s, n, *[f"{k} of {i}" for k in names]) for i, t, l, s, n in _labelled(rng, 60)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {', '.join(f'`{k}` string' for k in names)}")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = apply(spark, docs, "")
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found and all(r[k] == f"{k} of {r.doc_id}" for r in found for k in names), name
        assert apply(spark, docs.limit(0), "").count() == 0


def test_run_writes_and_rereads(spark, tmp_path):
    rng = random.Random(13)
    spark.createDataFrame(_labelled(rng, 40), SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").columns == ["doc_id", "n_tokens", "ids", "round_trip"]


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
