"""Boosted models under rolling folds, importance of feature families, and walk-forward runs of the neighbour methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.columns import safe_div
from tideline.operators import boosting as B
from tideline.operators import evaluate as O
from tideline.operators import pairs as P
from tideline.operators import style as S
from tideline.operators import walkforward as W
from tideline.operators.windows import by, lagged, r6
from tideline.plans import query
from tideline.plans.evaluation import _metrics_sql
from tideline.plans.style import _RAW
from tideline.sources.sinks import staged
from tideline.sources.views import STYLE, games, perspective, with_views

_FOLDS = (O.Fold("f1", "2016-12-31", "2017-01-01", "2017-01-31", "2017-02-01", "2017-03-31"), O.Fold("f2", "2017-12-31", "2018-01-01", "2018-03-31", "2018-04-01", "2018-06-30"))
_FEATURES = {"form": ("form_home", "form_away"), "pace": ("pace_home",), "shooting": ("fg_home",)}
_NAMES = [c for v in _FEATURES.values() for c in v]
_RULES = B.BoostingRules(trees=3, depth=2, rate=0.3, bins=8, subsample=0.8, colsample=0.75, patience=None, accuracy=1_000_000)
_SEED = 42


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Games with features of both sides' last ten games in the same role, and the scores to predict."""
    h, a = lagged(by("home"), 10), lagged(by("away"), 10)
    margin = F.col("pts_home") - F.col("pts_away")
    return games(spark, sf).select(
        "game_id", "game_date", "pts_home", "pts_away",
        F.avg(margin).over(h).alias("form_home"), F.avg(-margin).over(a).alias("form_away"), F.avg(F.col("pts_home") + F.col("pts_away")).over(h).alias("pace_home"), safe_div(F.sum("fgm_home").over(h), F.sum("fga_home").over(h)).alias("fg_home"),
    )


def _fitted(spark: SparkSession, sf: str):
    O.check_folds(_FOLDS)
    d = F.col("game_date")
    roles = [F.when(d <= f.train_end, B.TRAIN).when(d.between(f.val_start, f.val_end), B.VALIDATION).when(d.between(f.test_start, f.test_end), B.TEST) for f in _FOLDS]
    return B.fit_boosted(_rows(spark, sf), "game_id", _NAMES, ["pts_home", "pts_away"], roles, _RULES)


_ROWS_SQL = """rows AS MATERIALIZED (SELECT game_id, game_date, pts_home, pts_away, avg(pts_home - pts_away) OVER h AS f0, avg(pts_away - pts_home) OVER a AS f1, avg(pts_home + pts_away) OVER h AS f2,
  sum(fgm_home) OVER h / CAST(nullif(sum(fga_home) OVER h, 0) AS DOUBLE) AS f3,
  CAST('0x' || substr(sha256('{seed}:' || game_id), 1, 8) AS BIGINT) AS draw FROM games WINDOW h AS (PARTITION BY home ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY away ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"""


def _right(bin_: str, split: str) -> str:
    """Whether a row goes right at a split; a missing value has bin -1."""
    return f"CASE WHEN {bin_} = -1 THEN {split}.side = 1 ELSE {bin_} > {split}.k END"


def _fold_sql(f: O.Fold, r: B.BoostingRules) -> str:
    """One fold's trees by exact search over all splits, as CTEs named after the fold: {f}t, the rows, and {f}s<tree>_<level>, {f}l<tree>."""
    n, x = len(_NAMES), f.name
    role = f"CASE WHEN game_date <= DATE '{f.train_end}' THEN 1 WHEN game_date BETWEEN DATE '{f.val_start}' AND DATE '{f.val_end}' THEN 2 WHEN game_date BETWEEN DATE '{f.test_start}' AND DATE '{f.test_end}' THEN 3 END"
    out = [f"{x}r AS MATERIALIZED (SELECT *, {role} AS role FROM rows WHERE {role} IS NOT NULL)"]
    for j in range(n):
        out.append(
            f"{x}q{j} AS MATERIALIZED (SELECT coalesce(list_sort(list(DISTINCT v)), []) AS q FROM (SELECT f{j} AS v, row_number() OVER (ORDER BY f{j}) AS rn, count(*) OVER () AS n FROM {x}r WHERE role = 1 AND f{j} IS NOT NULL), range(1, {r.bins}) t(k) WHERE rn = (k * n + {r.bins - 1}) // {r.bins})"
        )
    bins = ", ".join(f"CASE WHEN f{j} IS NULL THEN -1 ELSE len(list_filter(q{j}.q, lambda b: b < f{j})) END" for j in range(n))
    units = round(1 / r.unit)
    out.append(f"{x}b AS (SELECT CAST(sum(pts_home * {units}) AS BIGINT) // count(*) AS b1, CAST(sum(pts_away * {units}) AS BIGINT) // count(*) AS b2 FROM {x}r WHERE role = 1)")
    out.append(f"{x}p0 AS MATERIALIZED (SELECT game_id, role, draw, pts_home * {units} AS y1, pts_away * {units} AS y2, [{bins}] AS u, b1 AS p1, b2 AS p2 FROM {x}r, {x}b, {', '.join(f'{x}q{j} q{j}' for j in range(n))})")
    widths = f"(SELECT unnest([{', '.join(f'len((SELECT q FROM {x}q{j}))' for j in range(n))}]) AS w, unnest(range({n})) AS f)"
    for t in range(r.trees):
        seen = f"role = 1 AND ((draw + {t * B._STEP % B._WORD}) % {B._WORD}) * {B._TURN} % {B._WORD} < {int(r.subsample * B._WORD)}"
        out.append(f"{x}g{t}_0 AS (SELECT *, 0 AS leaf FROM {x}p{t})")
        for level in range(r.depth):
            allowed = r.features_of(t, level, n)
            part = lambda side, e=f"{r.l2}": f"CASE WHEN n{side} > 0 THEN s1{side} * s1{side} / (n{side} + CAST({e} AS DOUBLE)) + s2{side} * s2{side} / (n{side} + CAST({e} AS DOUBLE)) ELSE 0.0 END"
            out.append(f"{x}h{t}_{level} AS MATERIALIZED (SELECT leaf, f, u[f + 1] AS b, count(*) AS n, CAST(sum(y1 - p1) AS DOUBLE) AS s1, CAST(sum(y2 - p2) AS DOUBLE) AS s2 FROM {x}g{t}_{level}, (SELECT unnest({allowed}) AS f) WHERE {seen} GROUP BY 1, 2, 3)")
            out.append(
                f"{x}c{t}_{level} AS (SELECT f, k, side, {', '.join(f'coalesce(sum({v}) FILTER (WHERE {cond}), 0) AS {v}{s}' for v in ('n', 's1', 's2') for s, cond in (('l', 'NOT r'), ('r', 'r'), ('a', 'true')))} "
                f"FROM (SELECT h.*, c.k, c.side, {_right('b', 'c')} AS r FROM {x}h{t}_{level} h JOIN (SELECT f, unnest(range(w)) AS k, s.side FROM {widths}, (VALUES (0), (1)) s(side)) c ON c.f = h.f) GROUP BY f, k, side, leaf)"
            )
            out.append(f"{x}s{t}_{level} AS MATERIALIZED (SELECT f, k, side, sum({part('l')} + {part('r')}) - sum({part('a')}) AS gain FROM {x}c{t}_{level} GROUP BY f, k, side ORDER BY sum({part('l')} + {part('r')}) DESC, f, k, side LIMIT 1)")
            out.append(f"{x}g{t}_{level + 1} AS MATERIALIZED (SELECT g.*, g.leaf + CASE WHEN {_right('u[s.f + 1]', 's')} THEN {1 << level} ELSE 0 END AS leaf2 FROM {x}g{t}_{level} g, {x}s{t}_{level} s)".replace("g.*, g.leaf +", "g.* EXCLUDE (leaf), g.leaf +").replace("AS leaf2", "AS leaf"))
        value = lambda y: f"CAST(floor({r.rate} * CAST(sum({y}) AS DOUBLE) / (count(*) + CAST({r.l2} AS DOUBLE)) + 0.5) AS BIGINT)"
        out.append(f"{x}l{t} AS MATERIALIZED (SELECT leaf, {value('y1 - p1')} AS v1, {value('y2 - p2')} AS v2 FROM {x}g{t}_{r.depth} WHERE {seen} GROUP BY 1)")
        out.append(f"{x}p{t + 1} AS MATERIALIZED (SELECT g.* EXCLUDE (leaf, p1, p2), p1 + coalesce(v1, 0) AS p1, p2 + coalesce(v2, 0) AS p2 FROM {x}g{t}_{r.depth} g LEFT JOIN {x}l{t} l ON l.leaf = g.leaf)")
    return ",\n".join(out)


_TREES_SQL = f"{with_views('games')},\n{_ROWS_SQL.format(seed=_RULES.seed)},\n" + ",\n".join(_fold_sql(f, _RULES) for f in _FOLDS)
_SCORED_SQL = " UNION ALL ".join(f"SELECT '{f.name} ' || CASE role WHEN 2 THEN 'val' ELSE 'test' END AS k, (y1 - y2) * {_RULES.unit} AS diff, (y1 + y2) * {_RULES.unit} AS total, (p1 - p2) * {_RULES.unit} AS pred_diff, (p1 + p2) * {_RULES.unit} AS pred_total FROM {f.name}p{_RULES.trees} WHERE role > 1" for f in _FOLDS)


@query("E1, E4, E5, E6, A17", f"WITH {_TREES_SQL}, n AS ({_SCORED_SQL}), {_metrics_sql('k')} SELECT string_split(k, ' ')[1] AS fold, string_split(k, ' ')[2] AS part, met.* EXCLUDE (k) FROM met")
def boosted_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Error metrics per fold and part of a boosted model of both scores; all folds are fitted together."""
    state, forests = _fitted(spark, sf)
    p = B.predict_boosted(state.where(F.col("role") > B.TRAIN), forests, ["h", "a"], _RULES.unit)
    named = p.select(F.get(F.array(*[F.lit(f.name) for f in _FOLDS]), F.col("fold")).alias("fold"), F.when(F.col("role") == B.VALIDATION, "val").otherwise("test").alias("part"), "h", "a", "pred_h", "pred_a")
    c = F.col
    scored = named.select("fold", "part", (c("h") - c("a")).alias("diff"), (c("h") + c("a")).alias("total"), (c("pred_h") - c("pred_a")).alias("pred_diff"), (c("pred_h") + c("pred_a")).alias("pred_total"))
    return O.error_metrics(scored, ["fold", "part"])


def _donors_sql(rows: str, key: str, seed: int, within: str | None = None) -> str:
    """key, donor: rows in the order of the key beside rows in the order of a hash."""
    text = f"'{seed}:' || " + (f"{within} || ':' || " if within else "") + key
    by_ = f"PARTITION BY {within} " if within else ""
    w = f"{within}, " if within else ""
    on = f"USING ({w}i)"
    return f"SELECT {w}{key}, donor FROM (SELECT {w}{key}, row_number() OVER ({by_}ORDER BY {key}) AS i FROM {rows}) JOIN (SELECT {w}{key} AS donor, row_number() OVER ({by_}ORDER BY sha256({text}), {key}) AS i FROM {rows}) {on}"


def _tried_sql(f: O.Fold, i: int, r: B.BoostingRules) -> str:
    """Per family the validation rows' predictions with that family's bins from the donor."""
    x, at = f.name, {c: j for j, c in enumerate(_NAMES)}
    n = len(_NAMES)
    lists = {"none": [f"v.u[{j + 1}]" for j in range(n)]} | {fam: [f"{'d' if c in columns else 'v'}.u[{at[c] + 1}]" for c in _NAMES] for fam, columns in _FEATURES.items()}
    rows = f"(SELECT *, {i} AS fold FROM {x}p{r.trees} WHERE role = 2)"
    tried = " UNION ALL ".join(f"SELECT '{fam}' AS family, v.y1, v.y2, [{', '.join(u)}] AS u FROM {rows} v JOIN ({_donors_sql(rows, 'game_id', _SEED, 'fold')}) m ON m.game_id = v.game_id JOIN {rows} d ON d.game_id = m.donor" for fam, u in lists.items())
    leaf = lambda t: " + ".join(f"CASE WHEN {_right(f'u[s{t}_{v}.f + 1]', f's{t}_{v}')} THEN {1 << v} ELSE 0 END" for v in range(r.depth))
    splits = ", ".join(f"{x}s{t}_{v} s{t}_{v}" for t in range(r.trees) for v in range(r.depth))
    leaves = " ".join(f"LEFT JOIN {x}l{t} l{t} ON l{t}.leaf = z{t}" for t in range(r.trees))
    total = lambda c: f"b{c} + " + " + ".join(f"coalesce(l{t}.v{c}, 0)" for t in range(r.trees))
    return (
        f"{x}z AS (SELECT family, y1, y2, b1, b2, {', '.join(f'{leaf(t)} AS z{t}' for t in range(r.trees))} FROM ({tried}), {x}b, {splits}),\n"
        f"{x}e AS (SELECT '{x}' AS fold, family, avg(abs((y1 - ({total(1)})) - (y2 - ({total(2)})))) * {r.unit} AS d, avg(abs((y1 - ({total(1)})) + (y2 - ({total(2)})))) * {r.unit} AS t FROM {x}z {leaves} GROUP BY family)"
    )


_NAIVE_DIFF, _NAIVE_TOTAL = 15.0, 20.0
_FAMILY_OF = f"([{', '.join(repr(fam) for fam, v in _FEATURES.items() for _ in v)}])[f + 1]"
_SHARE_SQL = " UNION ALL ".join(
    f"SELECT '{x.name}' AS fold, {_FAMILY_OF} AS family, sum(gain) / sum(sum(gain)) OVER () AS share FROM ({' UNION ALL '.join(f'SELECT f, gain FROM {x.name}s{t}_{v}' for t in range(_RULES.trees) for v in range(_RULES.depth))}) GROUP BY 2" for x in _FOLDS
)


@query(
    "A21, E7",
    f"""WITH {_TREES_SQL},
{', '.join(_tried_sql(f, i, _RULES) for i, f in enumerate(_FOLDS))}, e AS ({' UNION ALL '.join(f'SELECT * FROM {f.name}e' for f in _FOLDS)}), c AS (SELECT fold, family, d / {_NAIVE_DIFF} + 0.5 * (t / {_NAIVE_TOTAL}) AS c FROM e),
s AS ({_SHARE_SQL}), o AS (SELECT c.fold, c.family, coalesce(s.share, 0) AS share, c.c - z.c AS delta FROM c JOIN c z ON z.fold = c.fold AND z.family = 'none' LEFT JOIN s ON s.fold = c.fold AND s.family = c.family WHERE c.family <> 'none')
SELECT family, round(avg(share), 6) AS share, round(avg(delta), 6) AS delta, round(avg(share) FILTER (WHERE fold = 'f1'), 6) AS first_share, round(avg(share) FILTER (WHERE fold <> 'f1'), 6) AS later_share FROM o GROUP BY 1""",
)
def family_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the trees' gain, and what the composite score loses where a family's features are shuffled together, per family."""
    state, forests = _fitted(spark, sf)
    families, at = {}, 0
    for name, columns in _FEATURES.items():
        families[name], at = range(at, at + len(columns)), at + len(columns)
    donors = O.donors(state.where(F.col("role") == B.VALIDATION), "key", _SEED, ["fold"])
    errors = B.family_errors(state, forests, donors, families, _RULES.unit)
    c = errors.select("fold", "family", O.composite(F.col("diff_mae"), F.col("total_mae"), F.lit(_NAIVE_DIFF), F.lit(_NAIVE_TOTAL)).alias("c"))
    base = c.where("family = 'none'").select("fold", F.col("c").alias("base"))
    shares = []
    for f, forest in enumerate(forests):
        gains = forest.gains()
        shares += [(f, name, sum(gains[i] for i in own) / sum(gains) if sum(gains) else 0.0) for name, own in families.items()]
    share = spark.createDataFrame(shares, "fold int, family string, share double")  # a row a fold and family
    scores = c.where("family <> 'none'").join(base, "fold").join(share, ["fold", "family"]).select(F.get(F.array(*[F.lit(f.name) for f in _FOLDS]), F.col("fold")).alias("fold"), "family", "share", (F.col("c") - F.col("base")).alias("delta"))
    return O.importance(scores, _FOLDS[0].name)


@query("E7", f"WITH {with_views('games')}, d AS ({_donors_sql('games', 'game_id', 7)}) SELECT g.game_id, g.pts_home, x.fgm_home, x.fga_home FROM games g JOIN d ON d.game_id = g.game_id JOIN games x ON x.game_id = d.donor")
def block_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """Every game with its score and the shooting block of the game that the permutation names."""
    return O.permuted(games(spark, sf).select("game_id", "pts_home", "fgm_home", "fga_home"), ["fgm_home", "fga_home"], "game_id", 7)


_SEASONS = (W.Season("w1", "2017-02-01", "2017-03-31"), W.Season("w2", "2018-01-01", "2018-02-28"), W.Season("w3", "2019-01-01", "2019-02-28"))
_METHODS = (
    W.Method("threshold", 20, 5.0, 10, 50, threshold=0.7),
    W.Method("nearest", 37, 13.2, 21, 82, k=81),
    W.Method("nearest_floor", 37, 13.2, 21, 82, k=81, floor=0.4),
)


def _walk_sql() -> str:
    names = S.METRICS
    out = []
    settings = list(dict.fromkeys((m.window, m.halflife) for m in _METHODS))
    for i, (n, h) in enumerate(settings):
        age = f"pow(0.5, (len({{m}}) - i) / {h})"
        mean = lambda m: f"list_sum(list_transform({m}, lambda x, i: x * {age.format(m=m)})) / list_sum(list_transform({m}, lambda x, i: {age.format(m=m)})) AS {m}"
        out.append(f"w{i} AS (SELECT game_id, game_date, team, count(*) OVER p AS n_games, {', '.join(f'list({m}) OVER p AS {m}' for m in names)} FROM raw WINDOW p AS (PARTITION BY team ORDER BY game_date, game_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))")
        out.append(f"fp{i} AS MATERIALIZED (SELECT game_id, game_date, team, {', '.join(map(mean, names))} FROM w{i} WHERE n_games >= 5)")
    parts = []
    for i in range(len(settings)):
        for j, f in enumerate(_SEASONS):
            z = ", ".join(f"avg({m}) AS {m}_m, CASE WHEN stddev_samp({m}) >= 1e-9 THEN stddev_samp({m}) ELSE 1 END AS {m}_s" for m in names)
            vec = ", ".join(f"({s}.{m} - {m}_m) / {m}_s" for s in ("h", "a") for m in names)
            parts.append(f"SELECT {i} AS setting, {j} AS fold, g.game_id, g.game_date, g.game_date >= DATE '{f.start}' AS asked, CAST(g.pts_home - g.pts_away AS DOUBLE) AS margin, [{vec}] AS v FROM games g JOIN fp{i} h ON h.game_id = g.game_id AND h.team = g.home JOIN fp{i} a ON a.game_id = g.game_id AND a.team = g.away, (SELECT {z} FROM fp{i} WHERE game_date < DATE '{f.start}') WHERE g.game_date <= DATE '{f.end}' AND {names[0]}_m IS NOT NULL")
    out.append(f"v AS MATERIALIZED (SELECT *, CASE WHEN list_inner_product(v, v) = 0 THEN 1e-9 ELSE sqrt(list_inner_product(v, v)) END AS norm FROM ({' UNION ALL '.join(parts)}))")
    out.append("sims AS MATERIALIZED (SELECT t.setting, t.fold, t.game_id, p.margin, list_inner_product(t.v, p.v) / (t.norm * p.norm) AS sim, row_number() OVER (PARTITION BY t.setting, t.fold, t.game_id ORDER BY list_inner_product(t.v, p.v) / (t.norm * p.norm) DESC, p.game_id) AS rn FROM v t JOIN v p ON p.setting = t.setting AND p.fold = t.fold AND p.game_date < t.game_date WHERE t.asked)")
    judged = []
    for m in _METHODS:
        keep = f"sim >= {m.threshold}" if m.threshold is not None else f"rn <= {m.k}" + (f" AND sim >= {m.floor}" if m.floor is not None else "")
        at = settings.index((m.window, m.halflife))
        judged.append(f"SELECT '{m.name}' AS method, t.fold, t.margin, coalesce(n, 0) < {m.least} AS fell, least(coalesce(n, 0) / CAST({m.full} AS DOUBLE), 1.0) AS confidence, CASE WHEN coalesce(n, 0) < {m.least} THEN coalesce(a2, 0) ELSE mean END AS guess FROM v t LEFT JOIN (SELECT setting, fold, game_id, sum(margin) / count(*) AS mean, count(*) AS n FROM sims WHERE {keep} GROUP BY 1, 2, 3) k ON k.setting = t.setting AND k.fold = t.fold AND k.game_id = t.game_id LEFT JOIN h2h ON h2h.game_id = t.game_id WHERE t.asked AND t.setting = {at}")
    names_of = ", ".join(f"'{f.name}'" for f in _SEASONS)
    return f"""WITH {with_views('tg', 'games')}, {_RAW}, {', '.join(out)},
h2h AS (SELECT game_id, avg(CASE WHEN home < away THEN pts_home - pts_away ELSE pts_away - pts_home END) OVER (PARTITION BY least(home, away), greatest(home, away) ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * CASE WHEN home < away THEN 1 ELSE -1 END AS a2 FROM games),
j AS ({' UNION ALL '.join(judged)})
SELECT method, ([{names_of}])[fold + 1] AS fold, count(*) AS n_games, round(CASE WHEN min(guess) < max(guess) AND min(margin) < max(margin) THEN corr(guess, margin) ELSE 0 END, 6) AS corr, round(avg(CAST(fell AS INTEGER)), 6) AS fallback_rate, round(avg(confidence), 6) AS mean_confidence FROM j GROUP BY 1, 2"""


@query("M9, M3, A22, J13", _walk_sql())
def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Three ways to choose neighbours on each fold, z-scored by what lies before the fold."""
    g = games(spark, sf)
    metrics = S.raw_metrics(perspective(g, *STYLE))
    prints = {(n, h): staged(S.fingerprints(metrics, n, h, 5), "fingerprints") for n, h in dict.fromkeys((m.window, m.halflife) for m in _METHODS)}
    margins = g.select("game_id", "game_date", "home", "away", (F.col("pts_home") - F.col("pts_away")).alias("margin"))
    out = W.walk_forward(margins, P.head_to_head(g).select("game_id", F.col("a2_score").alias("score")), prints, _SEASONS, _METHODS)
    return out.select("method", "fold", "n_games", *[r6(F.col(c)).alias(c) for c in ("corr", "fallback_rate", "mean_confidence")])
