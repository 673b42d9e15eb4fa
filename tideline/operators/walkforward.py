"""Walk-forward comparison of neighbour methods: all folds and methods in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.neighbours import ranked, search_earlier
from tideline.operators.style import METRICS
from tideline.sources.sinks import staged


@dataclass(frozen=True)
class Season:
    """A fold: games from start to end are judged; what is fitted sees only what lies before start."""

    name: str
    start: str
    end: str


@dataclass(frozen=True)
class Method:
    """threshold: all earlier games at least so similar; else the k most similar, with floor only those at least so similar.
    With fewer than `least` neighbours the fallback counts; confidence is n / full, 1 at most."""

    name: str
    window: int
    halflife: float
    least: int
    full: int
    k: int | None = None
    floor: float | None = None
    threshold: float | None = None


def fold_moments(fp: DataFrame, folds: Sequence[Season], names: Sequence[str] = METRICS) -> DataFrame:
    """One row: per fold and metric the mean and sample deviation of the rows before the fold's start, by one aggregation."""
    made = []
    for i, f in enumerate(folds):
        for m in names:
            x = F.when(F.col("game_date") < F.lit(f.start).cast("date"), F.col(m))
            made += [F.avg(x).alias(f"m{i}_{m}"), F.coalesce(F.when(F.stddev_samp(x) >= 1e-9, F.stddev_samp(x)), F.lit(1.0)).alias(f"s{i}_{m}")]
    return fp.agg(*made)


def fold_vectors(games: DataFrame, fp: DataFrame, folds: Sequence[Season], offset: int, names: Sequence[str] = METRICS) -> DataFrame:
    """grp (offset + fold), game_id, game_date, vec of the games up to each fold's end that have both sides' fingerprints: z-scored
    by the fold's own moments, home first. A fold without rows before it has no vectors."""
    z = fp.join(F.broadcast(fold_moments(fp, folds, names)), how="cross")  # one row
    per = [F.array(*[(F.col(m) - F.col(f"m{i}_{m}")) / F.col(f"s{i}_{m}") for m in names]).alias(f"v{i}") for i in range(len(folds))]
    sides = z.select("game_id", "team", *per).join(games.select("game_id", "game_date", "home", "away"), "game_id")
    side = lambda c, i: F.max(F.when(F.col("team") == F.col(c), F.col(f"v{i}")))
    both = sides.groupBy("game_id", "game_date").agg(*[e.alias(f"{p}{i}") for i in range(len(folds)) for p, e in (("h", side("home", i)), ("a", side("away", i)))])
    each = [F.struct(F.lit(offset + i).cast("int").alias("grp"), F.lit(f.end).cast("date").alias("until"), F.concat(f"h{i}", f"a{i}").alias("vec")) for i, f in enumerate(folds)]
    rows = both.select("game_id", "game_date", F.explode(F.array(*each)).alias("x")).select("game_id", "game_date", "x.*")
    return rows.where("vec IS NOT NULL AND game_date <= until").drop("until")


def walk_forward(games: DataFrame, fallback: DataFrame, prints: dict[tuple[int, float], DataFrame], folds: Sequence[Season], methods: Sequence[Method]) -> DataFrame:
    """method, fold, n_games, corr, fallback_rate, mean_confidence: every method on every fold.

    prints: fingerprints per (window, halflife) that the methods name. fallback: game_id, score. games: game_id, game_date, home,
    away, margin. Fold and fingerprint are a group of the neighbour search, so one search serves all; each search row is then judged by
    every method of its fingerprint. corr is 0 where either side is constant.
    """
    settings = list(prints)
    vectors = None
    for i, key in enumerate(settings):
        v = fold_vectors(games, prints[key], folds, i * len(folds))
        vectors = v if vectors is None else vectors.unionAll(v)
    vectors = staged(vectors.join(games.select("game_id", "margin"), "game_id").select("grp", F.col("game_id").alias("id"), F.col("game_date").alias("at"), "vec", F.col("margin").cast("double").alias("score")), "vectors")
    fold = F.col("grp") % len(folds)
    start = F.get(F.array(*[F.lit(f.start).cast("date") for f in folds]), fold)
    targets = vectors.where(F.col("at") >= start)
    most = max((m.k for m in methods if m.k is not None), default=None)
    limits = {m.threshold for m in methods if m.threshold is not None}
    if len(limits) > 1:
        raise ValueError("one threshold a run")
    found = staged(search_earlier(targets, vectors, most, threshold=min(limits, default=None), group="grp"), "found")
    near = ranked(found, most) if most is not None else None
    counted = None
    for i, m in enumerate(methods):
        own = F.floor(F.col("g") / len(folds)) == settings.index((m.window, m.halflife))
        if m.threshold is not None:
            rows = found.where(F.col("other").isNull() & own)
        else:
            rows = near.where(own & (F.col("rank") <= m.k) & (F.lit(True) if m.floor is None else F.col("sim") >= m.floor))
        rows = rows.select(F.lit(i).alias("method"), F.col("g").alias("grp"), "id", "score", "n")
        counted = rows if counted is None else counted.unionAll(rows)
    per = counted.groupBy("method", "grp", "id").agg((F.sum("score") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    asked = [F.struct(F.lit(i).alias("method"), F.lit(m.name).alias("name"), F.lit(m.least).alias("least"), F.lit(float(m.full)).alias("full"), F.lit(settings.index((m.window, m.halflife))).alias("setting")) for i, m in enumerate(methods)]
    judged = targets.select("grp", "id", F.col("score").alias("margin"), F.explode(F.array(*asked)).alias("m")).select("grp", "id", "margin", "m.*").where(F.floor(F.col("grp") / len(folds)) == F.col("setting"))
    judged = judged.join(per, ["method", "grp", "id"], "left").join(fallback.select(F.col("game_id").alias("id"), F.col("score").alias("instead")), "id", "left")
    n = F.coalesce("n", F.lit(0))
    short = n < F.col("least")
    scored = judged.select("name", fold.alias("fold"), "margin", short.cast("double").alias("fell"), F.least(n / F.col("full"), F.lit(1.0)).alias("confidence"), F.when(short, F.coalesce("instead", F.lit(0.0))).otherwise(F.col("mean")).alias("guess"))
    return scored.groupBy(F.col("name").alias("method"), F.get(F.array(*[F.lit(f.name) for f in folds]), F.col("fold").cast("int")).alias("fold")).agg(
        F.count("*").alias("n_games"), _corr(F.col("guess"), F.col("margin")).alias("corr"), F.avg("fell").alias("fallback_rate"), F.avg("confidence").alias("mean_confidence")
    )


def _corr(a: Column, b: Column) -> Column:
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.corr(a, b)).otherwise(0.0)
