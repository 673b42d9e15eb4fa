"""Scoring predictions, folds, rolling-origin validation, importance and data checks."""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.columns import normal_cdf, safe_div
from tideline.operators.ranks import global_rank
from tideline.operators.windows import r6


def error_metrics(df: DataFrame, keys: Sequence[str] = (), *, within: float = 10.0) -> DataFrame:
    """MAE, RMSE, share within a bound, winner accuracy, Brier score and correlation in one aggregation.

    df: pred_diff, diff, pred_total, total. Rows without a prediction don't count. The Brier score turns a margin into a
    probability by the errors' deviation; where that is 0 the sign decides.
    """
    rows = df.where("pred_diff IS NOT NULL AND diff IS NOT NULL")
    spread = rows.groupBy(*keys).agg(F.stddev_pop(F.col("diff") - F.col("pred_diff")).alias("_sd"))
    if keys:
        named = spread.toDF(*[f"_k{i}" for i in range(len(keys))], "_sd")
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        rows = rows.join(named, functools.reduce(lambda a, b: a & b, same)).drop(*[f"_k{i}" for i in range(len(keys))])
    else:
        rows = rows.crossJoin(F.broadcast(spread))  # one row
    sd = F.col("_sd")
    won = (F.col("diff") > 0).cast("double")
    p = F.when(sd > 0, normal_cdf(F.col("pred_diff") / F.nullif(sd, F.lit(0.0)))).otherwise((F.col("pred_diff") > 0).cast("double"))
    e, t = F.abs(F.col("pred_diff") - F.col("diff")), F.abs(F.col("pred_total") - F.col("total"))
    rows = rows.withColumn("_p", p)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        r6(F.avg(e)).alias("diff_mae"),
        r6(F.sqrt(F.avg(e * e))).alias("diff_rmse"),
        r6(F.avg(t)).alias("total_mae"),
        r6(F.avg((e <= within).cast("double"))).alias("within"),
        r6(F.avg((((F.col("pred_diff") > 0) == (F.col("diff") > 0))).cast("double"))).alias("win_accuracy"),
        r6(F.avg((F.col("_p") - won) * (F.col("_p") - won))).alias("brier"),
        r6(F.coalesce(F.corr("pred_diff", "diff"), F.lit(0.0))).alias("corr"),
    )


def composite(diff_mae: Column, total_mae: Column, naive_diff: Column, naive_total: Column, weight: float = 0.5) -> Column:
    return safe_div(diff_mae, naive_diff) + weight * safe_div(total_mae, naive_total)


@dataclass(frozen=True)
class Fold:
    name: str
    train_end: str
    val_start: str
    val_end: str
    test_start: str
    test_end: str


def check_folds(folds: Sequence[Fold]) -> None:
    """Raises unless there are folds, each runs forward without overlap, and each trains on more than the one before."""
    if not folds:
        raise ValueError("no folds")
    for f in folds:
        if not f.train_end < f.val_start <= f.val_end < f.test_start <= f.test_end:
            raise ValueError(f"fold {f.name} doesn't run forward")
    for a, b in zip(folds, folds[1:], strict=False):
        if not (a.train_end < b.train_end and a.val_end < b.val_end):
            raise ValueError(f"fold {b.name} doesn't follow {a.name}")
        if b.val_start <= a.val_end:
            raise ValueError(f"folds {a.name} and {b.name} overlap")


def rolling_origin(df: DataFrame, date: str, folds: Sequence[Fold], predict: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Error metrics per fold and part. predict(train, rows) returns rows with pred_diff and pred_total; it sees only what lies before."""
    check_folds(folds)
    out = None
    for f in folds:
        train = df.where(F.col(date) <= f.train_end)
        rows = df.where(F.col(date).between(f.val_start, f.test_end))
        part = F.when(F.col(date) <= f.val_end, "val").when(F.col(date) >= f.test_start, "test")
        scored = error_metrics(predict(train, rows).withColumn("part", part).where("part IS NOT NULL"), ["part"]).withColumn("fold", F.lit(f.name))
        out = scored if out is None else out.unionByName(scored)
    return out


def linear_model(features: Sequence[str], targets: Mapping[str, str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A predictor of ordinary least squares per target: one aggregation of means, one of centred products, and the normal equations
    of the few features on the driver. A missing feature takes its training mean; features that explain each other share the weight."""

    def predict(train: DataFrame, rows: DataFrame) -> DataFrame:
        import numpy as np

        train = train.where(functools.reduce(lambda a, b: a & b, [F.col(t).isNotNull() for t in targets]))
        names = [*features, *targets]
        mean = [m or 0.0 for m in train.agg(*[F.avg(c) for c in names]).collect()[0]]
        x = [F.coalesce(F.col(c).cast("double"), F.lit(m)) - m for c, m in zip(names, mean, strict=True)]
        n = len(features)
        pairs = [(i, j) for i in range(n) for j in range(i, len(names))]
        sums = dict(zip(pairs, train.agg(*[F.sum(x[i] * x[j]) for i, j in pairs]).collect()[0], strict=True))
        square = np.array([[sums[min(i, j), max(i, j)] or 0.0 for j in range(n)] for i in range(n)])
        out = rows
        for k, name in enumerate(targets.values(), n):
            weights = np.linalg.lstsq(square, np.array([sums[i, k] or 0.0 for i in range(n)]), rcond=None)[0]
            out = out.withColumn(name, functools.reduce(lambda a, b: a + b, [F.lit(float(w)) * v for w, v in zip(weights, x, strict=False)], F.lit(mean[k])))
        return out

    return predict


def donors(rows: DataFrame, key: str, seed: int, within: Sequence[str] = ()) -> DataFrame:
    """within, key, donor: the donor of a row stands in the order of a hash of (seed, within, key) where the row stands in that of key.

    A permutation of the rows of each `within` that any engine with SHA-256 derives alike. key tells the rows of a `within` apart.
    """
    drawn = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*within, key)]), 256)
    placed = global_rank(rows.select(*within, key), [*within, key]).select(*within, key, "rank")
    dealt = global_rank(rows.select(*within, F.col(key).alias("donor"), drawn.alias("_drawn")), [*within, "_drawn", "donor"]).select(*within, "donor", "rank")
    return placed.join(dealt, [*within, "rank"]).drop("rank")


def permuted(df: DataFrame, columns: Sequence[str], key: str, seed: int) -> DataFrame:
    """df with a block of columns shuffled together among rows, the rest in place; the order of rows doesn't matter."""
    lent = df.select(F.col(key).alias("donor"), *columns)
    return df.drop(*columns).join(donors(df, key, seed), key).join(lent, "donor").select(*df.columns)


def importance(scores: DataFrame, first: str) -> DataFrame:
    """fold, family, share, delta -> per family their means over folds, and the share in the first fold beside that in later ones."""
    in_first = F.col("fold") == first
    return scores.groupBy("family").agg(
        r6(F.avg("share")).alias("share"), r6(F.avg("delta")).alias("delta"), r6(F.avg(F.when(in_first, F.col("share")))).alias("first_share"), r6(F.avg(F.when(~in_first, F.col("share")))).alias("later_share")
    )


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, null rate, mean, sd, min, max and bias-corrected skewness: one aggregation over all columns, then unpivoted."""

    def stats(c: str) -> Column:
        n = F.count(c)
        skew = F.when(n > 2, F.skewness(c) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))
        return F.struct(F.lit(c).alias("name"), n.alias("n"), r6(F.avg(F.col(c).isNull().cast("double"))).alias("null_rate"), r6(F.avg(c)).alias("mean"), r6(F.stddev_samp(c)).alias("sd"), F.min(c).cast("double").alias("lowest"), F.max(c).cast("double").alias("highest"), r6(skew).alias("skew"))

    return df.agg(F.array(*map(stats, columns)).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def correlations(df: DataFrame, columns: Sequence[str], least: float = 0.0) -> DataFrame:
    """Pairs of columns and their correlation, strong ones only; one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    made = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs])
    return df.agg(made.alias("p")).select(F.explode("p").alias("r")).select("r.a", "r.b", r6(F.col("r.corr")).alias("corr")).where(F.abs("corr") >= least)


def quality_checks(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Number of rows that break each rule."""
    counts = F.array(*[F.struct(F.lit(n).alias("rule"), F.count_if(F.coalesce(c, F.lit(False))).alias("n_bad")) for n, c in checks.items()])
    return df.agg(counts.alias("a")).select(F.explode("a").alias("r")).select("r.*")


def families(before: DataFrame, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> dict[str, str]:
    """Column -> the step that added it."""
    out: dict[str, str] = {}
    df = before
    for name, apply in steps:
        seen = set(df.columns)
        df = apply(df)
        out |= {c: name for c in df.columns if c not in seen}
    return out


def ablation(flags: Mapping[str, bool], run: Callable[[Mapping[str, bool]], float]) -> dict[str, float]:
    """Score with each flag flipped, less the score as it is."""
    base = run(dict(flags))
    return {k: run({**flags, k: not v}) - base for k, v in flags.items()}


def random_search(space: Mapping[str, Sequence], score: Callable[[Mapping], float], trials: int, seed: int = 7) -> tuple[dict, float]:
    """The best of `trials` random settings and its score (higher is better). Trials run on the driver; each may run Spark jobs."""
    return _search(space, score, trials, random.Random(seed), trials)


def parzen_search(space: Mapping[str, Sequence], score: Callable[[Mapping], float], trials: int, seed: int = 7, first: int = 5, share: float = 0.25, draws: int = 24) -> tuple[dict, float]:
    """The best of `trials` settings chosen by a tree of Parzen estimators, and its score (higher is better).

    After `first` random settings the best `share` of those tried are told from the rest; of `draws` settings drawn from the good
    ones' densities the one is tried whose density among the good exceeds that among the rest most. Every setting is tried once.
    """
    return _search(space, score, trials, random.Random(seed), first, share, draws)


def _search(space, score, trials, rng, first, share=0.25, draws=24) -> tuple[dict, float]:
    values = {k: list(v) for k, v in space.items()}
    tried: dict[tuple, float] = {}
    for t in range(min(trials, math.prod(map(len, values.values())))):
        fresh = lambda draw: next(c for c in iter(lambda: tuple(draw(k) for k in values), None) if c not in tried)
        if t < first:
            at = fresh(lambda k: rng.randrange(len(values[k])))
        else:
            ranked = sorted(tried, key=tried.get, reverse=True)
            good, rest = ranked[: (cut := max(1, math.ceil(share * len(ranked))))], ranked[cut:]

            def density(some, d, i, n):
                """Smoothed share of place i among the settings' places; neighbours count half as much for each step."""
                return (1 / n + sum(0.5 ** abs(c[d] - i) for c in some)) / (1 + len(some))

            def ratio(c):
                return math.prod(density(good, d, i, len(v)) / density(rest, d, i, len(v)) for d, (i, v) in enumerate(zip(c, values.values(), strict=True)))

            def drawn(k):
                d = list(values).index(k)
                return rng.choices(range(len(values[k])), [density(good, d, i, len(values[k])) for i in range(len(values[k]))])[0]

            at = max((fresh(drawn) for _ in range(draws)), key=ratio)
        tried[at] = score({k: values[k][i] for k, i in zip(values, at, strict=True)})
    best = max(tried, key=tried.get)
    return {k: values[k][i] for k, i in zip(values, best, strict=True)}, tried[best]
