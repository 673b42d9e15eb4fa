"""Search of settings by a tree of Parzen estimators, in batches that are scored together.

Settings tried are told into the best share and the rest. Per dimension both have a density: for numbers a mixture of normal kernels
on the (possibly logarithmic) axis, cut at its ends, and a uniform part; for choices smoothed counts. Settings drawn from the good
density go where it exceeds the other most. A batch of them is one job of the scorer, with the setting as a column.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Real:
    """A number from low to high; log: as likely to double as to halve. whole: rounded to a whole number."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def __post_init__(self):
        if not self.low < self.high or self.log and self.low <= 0:
            raise ValueError(f"not a range: {self}")

    def place(self, value: float) -> float:
        """0 to 1 along the axis."""
        a, b, x = (math.log(v) for v in (self.low, self.high, value)) if self.log else (self.low, self.high, value)
        return (x - a) / (b - a)

    def value(self, place: float) -> float:
        a, b = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        x = a + min(1.0, max(0.0, place)) * (b - a)
        x = math.exp(x) if self.log else x
        x = min(self.high, max(self.low, x))
        return float(round(x)) if self.whole else x

    def anywhere(self, rng: random.Random) -> float:
        return self.value(rng.random())

    def _width(self, places: Sequence[float]) -> float:
        """A kernel's width: of the points' spread, narrower the more there are, never nothing."""
        n = len(places)
        mean = sum(places) / n
        return max(0.1, min(0.5, 0.8 * math.sqrt(sum((p - mean) ** 2 for p in places) / n) * n**-0.2)) if n > 1 else 0.25

    def near(self, values: Sequence[float], rng: random.Random) -> float:
        """Drawn from the density of values."""
        if rng.randrange(len(values) + 1) == len(values):
            return self.anywhere(rng)
        places = [self.place(v) for v in values]
        width, centre = self._width(places), rng.choice(places)
        while True:
            p = rng.gauss(centre, width)
            if 0 <= p <= 1:
                return self.value(p)

    def density(self, values: Sequence[float], value: float) -> float:
        if not values:
            return 1.0
        places, x = [self.place(v) for v in values], self.place(value)
        width = self._width(places)
        cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
        kernels = 0.0
        for p in places:
            inside = cdf((1 - p) / width) - cdf(-p / width)
            kernels += math.exp(-0.5 * ((x - p) / width) ** 2) / (width * math.sqrt(2 * math.pi) * inside)
        return (kernels + 1.0) / (len(values) + 1)


@dataclass(frozen=True)
class Choice:
    values: tuple

    def anywhere(self, rng: random.Random):
        return rng.choice(self.values)

    def near(self, values: Sequence, rng: random.Random):
        return rng.choices(self.values, [self.density(values, v) for v in self.values])[0]

    def density(self, values: Sequence, value) -> float:
        return (sum(v == value for v in values) + 1 / len(self.values)) / (len(values) + 1)


Space = Mapping[str, Real | Choice]
Scores = Callable[[list[dict]], list[float]]


def parzen_batches(space: Space, scores: Scores, trials: int, *, batch: int = 8, seed: int = 7, first: int = 16, share: float = 0.2, draws: int = 16) -> list[tuple[dict, float]]:
    """All settings tried and their scores (higher is better; NaN counts as worst), in the order of trial.

    scores takes a batch of settings and gives their scores. After `first` settings from anywhere, each of a batch is the most promising of
    `draws`; settings of one batch stay apart, as those already chosen count among the rest. The same seed and scores give the same settings.
    """
    rng = random.Random(seed)
    tried: list[tuple[dict, float]] = []
    while len(tried) < trials:
        n = min(batch, trials - len(tried))
        ranked = sorted(range(len(tried)), key=lambda i: (math.isnan(tried[i][1]), -tried[i][1] if not math.isnan(tried[i][1]) else 0.0, i))
        cut = max(1, math.ceil(share * len(ranked)))
        good, rest = [tried[i][0] for i in ranked[:cut]], [tried[i][0] for i in ranked[cut:]]
        chosen: list[dict] = []
        for _ in range(n):
            if len(tried) + len(chosen) < first or not tried:
                chosen.append({k: d.anywhere(rng) for k, d in space.items()})
                continue
            against = rest + chosen

            def promise(s: dict) -> float:
                return sum(math.log(d.density([g[k] for g in good], s[k])) - math.log(d.density([r[k] for r in against], s[k])) for k, d in space.items())

            drawn = [{k: d.near([g[k] for g in good], rng) for k, d in space.items()} for _ in range(draws)]
            chosen.append(max(drawn, key=promise))
        got = scores(chosen)
        if len(got) != len(chosen):
            raise ValueError("a score for each setting is needed")
        tried += list(zip(chosen, map(float, got), strict=True))
    return tried


def random_batches(space: Space, scores: Scores, trials: int, *, batch: int = 8, seed: int = 7) -> list[tuple[dict, float]]:
    """The same without learning."""
    return parzen_batches(space, scores, trials, batch=batch, seed=seed, first=trials)


def best_of(tried: Sequence[tuple[dict, float]]) -> tuple[dict, float]:
    return max((t for t in tried if not math.isnan(t[1])), key=lambda t: t[1], default=tried[0])


def scored_together(spark: SparkSession, columns: str, score: Callable[[DataFrame], DataFrame]) -> Scores:
    """A scorer that runs one job a batch. columns: DDL of the settings; score takes a DataFrame of them with `setting` (a number)
    and returns setting, score; settings without a row score NaN."""
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def scores(batch: list[dict]) -> list[float]:
        frame = spark.createDataFrame([(i, *[s[n] for n in names]) for i, s in enumerate(batch)], f"setting int, {columns}")
        found = {r.setting: r.score for r in score(F.broadcast(frame)).select("setting", "score").collect()}  # a row a setting
        return [math.nan if found.get(i) is None else found[i] for i in range(len(batch))]

    return scores


def last_n_errors(rows: DataFrame, key: str, order: Sequence[str], value: str) -> Callable[[DataFrame], DataFrame]:
    """A score for settings (window, shrink, edge): minus the mean absolute error of edge + n / (n + shrink) * mean of the key's last
    `window` values, n of them.

    Running sums stand once; a setting's window is the difference of two of them, met by an equi-join on the row's number, so all
    settings of a batch are scored in one job, whatever their windows. rows should be stored.
    """
    from pyspark.sql import Window as W

    spec = W.partitionBy(key).orderBy(*order)
    summed = rows.select(F.col(key).alias("k"), F.row_number().over(spec).alias("i"), F.col(value).cast("double").alias("v"), F.sum(F.col(value).cast("double")).over(spec).alias("s"))

    def score(settings: DataFrame) -> DataFrame:
        asked = summed.crossJoin(settings)  # a batch of settings
        n = F.least(F.col("window").cast("int"), F.col("i") - 1)
        asked = asked.select("setting", "shrink", "edge", "k", "v", n.alias("n"), (F.col("s") - F.col("v")).alias("upto"), (F.col("i") - 1 - n).alias("start"))
        begun = summed.select("k", F.col("i").alias("start"), F.col("s").alias("before"))
        met = asked.join(begun, ["k", "start"], "left")
        mean = F.when(F.col("n") > 0, (F.col("upto") - F.coalesce("before", F.lit(0.0))) / F.col("n")).otherwise(0.0)
        guess = F.col("edge") + F.col("n") / (F.col("n") + F.col("shrink")) * mean
        return met.groupBy("setting").agg((-F.avg(F.abs(F.col("v") - guess))).alias("score"))

    return score
