"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic); one aggregation sums their tokens. Raking multiplies the cells until the
token totals by source, by language and by topic are the targets. A document's expected number of copies is its cell's weight
times one scale, so that the expected tokens are the wanted share of the corpus. Where the targets allow it, raking keeps to one
copy at most; where a target asks for more tokens than its documents hold, documents repeat. The fraction of a copy falls to a
hash of the id, which needs no shuffle and gives the same sample on every run.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm._common import drop_stage, few, maybe_broadcast, pick, stage, table

#: Up to so many cells are fitted on the driver; more are fitted by joins and aggregations, by the same rule and to the same end.
DRIVER_CELLS = 100_000
#: Fitting ends where no share is off by TOLERANCE, where the largest deviation has not fallen for STALLED rounds, or after ROUNDS.
ROUNDS = 1000
STALLED = 20
TOLERANCE = 1e-9
#: Targets of a sample without repeats count as met within this share.
CLOSE = 1e-6
DIMS = ("source", "lang", "topic")
#: Targets that are not given: the corpus' own shares to this power.
TEMPER = 0.5


def words_in(text: Column) -> Column:
    """Number of runs of non-blank characters; a cheap stand-in for tokens where no count is at hand."""
    bare = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(bare == "", 0).otherwise(F.char_length(bare) - F.char_length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def topic_of(text: Column, words: Column) -> Column:
    """A coarse topic by form, for tables without one: listings (many column bars), notes, articles and long reads."""
    bars = F.char_length(text) - F.char_length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(5 * bars > words, "listing").when(words < 100, "note").when(words < 1000, "article").otherwise("long read")


def tempered(totals: Mapping, power: float = TEMPER) -> dict:
    powered = {k: v**power for k, v in totals.items() if v > 0}
    whole = sum(powered.values())
    return {k: v / whole for k, v in powered.items()}


class _Progress:
    """Whether fitting goes on, from the largest deviation of each round; off is the last one."""

    def __init__(self) -> None:
        self.off, self.least, self.idle = float("inf"), float("inf"), 0

    def ends(self, off: float) -> bool:
        self.off, self.idle = off, 0 if off < self.least else self.idle + 1
        self.least = min(self.least, off)
        return off < TOLERANCE or self.idle >= STALLED


def rake(cells: Mapping[tuple, float], targets: list[Mapping], wanted: float | None = None) -> dict[tuple, float] | None:
    """Cells' tokens -> cells' raked shares, by turns fitting each dimension's totals to its targets.

    Targets count relative to those of values that occur; if a dimension's occur nowhere, nothing is wanted and all shares are 0.
    With wanted, the shares are those of a sample of so many tokens, in which no cell may have more tokens than it holds; None
    where the targets can't be met so. Without, targets that no weights can meet are approached, with a warning.
    """
    import numpy as np

    keys = list(cells)
    x = np.array([float(cells[k]) for k in keys])
    cap = np.full(len(x), np.inf) if wanted is None else x / wanted
    x = x / x.sum()
    coded, goals = [], []
    for d, target in enumerate(targets):
        names = {k: i for i, k in enumerate(dict.fromkeys(key[d] for key in keys))}
        coded.append(np.array([names[key[d]] for key in keys]))
        goal = np.array([float(target.get(k, 0)) for k in names])
        if not goal.sum() > 0:
            return dict.fromkeys(keys, 0.0)
        goals.append(goal / goal.sum())
    progress = _Progress()
    for _ in range(ROUNDS):
        for at, goal in zip(coded, goals, strict=True):
            full = x >= cap
            held = np.bincount(at, weights=np.where(full, cap, 0.0), minlength=len(goal))
            free = np.bincount(at, weights=np.where(full, 0.0, x), minlength=len(goal))
            now = held + free
            rise = (free > 0) & (goal > held)
            by = np.divide(goal - held, free, out=np.divide(goal, now, out=np.zeros_like(goal), where=now > 0), where=rise)
            x = np.minimum(x * by[at], 1e100)  # a full cell's own value only says how full
        if progress.ends(max(float(np.abs(np.bincount(at, weights=np.minimum(x, cap), minlength=len(goal)) - goal).max()) for at, goal in zip(coded, goals, strict=True))):
            break
    if not progress.off < CLOSE:
        if wanted is not None:
            return None
        _warn(progress.off)
    return dict(zip(keys, np.minimum(x, cap).tolist(), strict=True))


def _warn(gap: float) -> None:
    warnings.warn(f"mixture: the targets contradict each other on these cells; shares are off by up to {gap:.2g}", stacklevel=3)


def _local(spark: SparkSession, rows: list[tuple], kinds: dict[str, str]) -> DataFrame:
    """The driver's rows as a table. By way of Arrow: a list of rows would start a second set of Python workers on the executors."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())}))


def _gap(x: DataFrame, targets: list[DataFrame]) -> float:
    """The largest deviation of raked totals from their targets, over all dimensions."""
    gaps = [x.groupBy(d).agg(F.sum(F.least("raked", "cap")).alias("now")).join(t, d, "left").select(F.abs(F.col("now") - F.coalesce("goal", F.lit(0.0))).alias("gap")) for d, t in zip(DIMS, targets, strict=True)]
    return gaps[0].union(gaps[1]).union(gaps[2]).agg(F.max("gap")).collect()[0][0]


def _rake_by_joins(cells: DataFrame, targets: list[DataFrame], wanted: float | None = None) -> DataFrame | None:
    """The same on DataFrames, for cell tables beyond DRIVER_CELLS: every round ends in a written table."""
    total = cells.agg(F.sum("tokens")).collect()[0][0]
    cap = F.lit(float("inf")) if wanted is None else F.col("tokens") / F.lit(float(wanted))
    x = cells.select(*DIMS, "tokens", (F.col("tokens") / total).alias("raked"), cap.alias("cap"))
    full, goal, held, free = F.col("raked") >= F.col("cap"), F.coalesce("goal", F.lit(0.0)), F.col("held"), F.col("free")
    by = F.when((free > 0) & (goal > held), (goal - held) / free).when(held + free > 0, goal / (held + free)).otherwise(0.0)
    progress, before = _Progress(), None
    for _ in range(ROUNDS):
        for d, target in zip(DIMS, targets, strict=True):
            now = x.groupBy(d).agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("raked"))).alias("free"))
            x = x.join(now.join(target, d, "left").select(d, by.alias("by")), d).select(*DIMS, "tokens", F.least(F.col("raked") * F.col("by"), F.lit(1e100)).alias("raked"), "cap")
        x = stage(few(x), "raked")
        if before is not None:
            drop_stage(before)
        before = x
        if progress.ends(_gap(x, targets)):
            break
    if not progress.off < CLOSE:
        if wanted is not None:
            return None
        _warn(progress.off)
    return x.select(*DIMS, "tokens", F.least("raked", "cap").alias("raked"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", share: float = 0.5, targets: Mapping[str, Mapping] | None = None, tokens: Column | None = None, topic: Column | None = None, seed: int = 7) -> DataFrame:
    """Every row of docs with topic, n_tokens, weight (raked share over own share of its cell), probability, taken and copies.

    targets maps "source", "lang" or "topic" to wanted shares; a dimension without one gets the corpus' shares to the power
    TEMPER. Values without a target get none; where no wanted value occurs, or a dimension's map is empty, nothing is taken. Null sources, languages and topics
    are the value ''. tokens defaults to the word count, topic to the column topic of docs, if there is one, and else to topic_of
    the text. The sample is to have share of the tokens, or all whose weight is above 0 if these are fewer. copies says how often
    it has a row, by expectation scale * weight; probability is that of being in it at all. No row repeats if the targets can be
    met without. Rows of no tokens are never taken (weight and probability 0). Rows with equal ids are taken together; rows
    without an id are drawn by their text. Columns of docs that carry a name of the result are replaced; all others stay,
    whatever their names.
    """
    spark = docs.sparkSession
    made = ("topic", "n_tokens", "weight", "probability", "taken", "copies")
    own = docs.columns
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(own)))}
    extra = {k: c for k, c in (("tokens", tokens), ("form", topic)) if c is not None}
    flat = docs.select("*", *extra.values()).toDF(*[f"c{i}" for i in range(len(own))], *extra)
    text = F.coalesce(F.col(at["text"]), F.lit(""))
    counted = flat.withColumn("n_tokens", (F.col("tokens") if tokens is not None else words_in(text)).cast("long"))
    form = F.col("form") if topic is not None else F.col(at["topic"]) if "topic" in at else topic_of(text, F.col("n_tokens"))
    counted = counted.select(*[f"c{i}" for i in range(len(own))], "n_tokens", form.cast("string").alias("topic"), *[F.col(at[d]).cast("string").alias(d) for d in ("source", "lang")])
    cell = [F.coalesce(d, F.lit("")).alias(d) for d in DIMS]
    cells = stage(few(counted.select(*cell, "n_tokens").groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")), "cells")
    n_cells = cells.count()
    given = targets or {}
    total = cells.agg(F.sum("tokens")).collect()[0][0] or 0
    scale = 0.0
    if n_cells == 0:
        solved = cells.withColumn("raked", F.lit(0.0))
    elif n_cells <= DRIVER_CELLS:
        rows = {(r.source, r.lang, r.topic): r.tokens for r in cells.collect()}
        goals = []
        for d, name in enumerate(DIMS):
            sums: dict = {}
            for k, v in rows.items():
                sums[k[d]] = sums.get(k[d], 0) + v
            goals.append(given[name] if given.get(name) is not None else tempered(sums))
        raked = rake(rows, goals)
        wanted = min(share * total, sum(v for k, v in rows.items() if raked[k] > 0))
        scale = wanted / (total * sum(raked.values())) if wanted else 0.0
        if any(scale * raked[k] * total > v for k, v in rows.items()) and (single := rake(rows, goals, wanted)):
            raked, scale = single, wanted / total
        solved = _local(spark, [(*k, rows[k], raked[k]) for k in rows], {**dict.fromkeys(DIMS, "string"), "tokens": "int64", "raked": "float64"})
    else:
        frames = []
        for name in DIMS:
            if given.get(name) is not None:
                goals = _local(spark, [(k, float(v)) for k, v in given[name].items()], {name: "string", "goal": "float64"})
                here = goals.join(cells.select(name).distinct(), name, "left_semi")
                whole = here.agg(F.sum("goal")).collect()[0][0] or 1.0
                frames.append(here.select(name, (F.col("goal") / whole).alias("goal")))
            else:
                powered = cells.groupBy(name).agg(F.pow(F.sum("tokens"), TEMPER).alias("p"))
                whole = powered.agg(F.sum("p")).collect()[0][0]
                frames.append(powered.select(name, (F.col("p") / whole).alias("goal")))
        solved = _rake_by_joins(cells, frames)
        reachable, whole, most = solved.where("raked > 0").agg(F.sum("tokens"), F.sum("raked"), F.max(F.col("raked") / F.col("tokens"))).collect()[0]
        wanted = min(share * total, reachable or 0)
        scale = wanted / (total * whole) if wanted else 0.0
        if wanted and scale * most * total > 1 and (single := _rake_by_joins(cells, frames, wanted)) is not None:
            solved, scale = single, wanted / total
    weighted = solved.withColumn("weight", F.col("raked") * total / F.col("tokens")).select(*DIMS, "tokens", "weight")
    weights = maybe_broadcast(weighted.select(*[F.col(d).alias(f"_{d}") for d in DIMS], "weight"), n_cells, 128)
    drawn = F.coalesce(F.col(at[id_col]).cast("string"), F.concat(F.lit("text "), text))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), drawn), 11) / F.lit(float(1 << 53))
    on = [F.coalesce(d, F.lit("")) == F.col(f"_{d}") for d in DIMS]
    joined = counted.join(weights, on[0] & on[1] & on[2], "left").drop(*[f"_{d}" for d in DIMS])
    expected = F.when(F.col("n_tokens") > 0, F.lit(float(scale)) * F.coalesce("weight", F.lit(0.0))).otherwise(0.0)
    copies = (F.floor(expected) + (u < expected - F.floor(expected)).cast("int")).cast("int")
    out = joined.withColumns({"probability": F.least(F.lit(1.0), expected), "copies": copies, "weight": F.coalesce("weight", F.lit(0.0))}).withColumn("taken", F.col("copies") > 0)
    kept = [(f"c{i}", c) for i, c in enumerate(own) if c not in made]
    return out.select(*[c for c, _ in kept], *made).toDF(*[c for _, c in kept], *made)


def realised(mixture: DataFrame) -> DataFrame:
    """dimension, value, share, sampled: the share of every source, language and topic in mixed()'s rows and in the sample."""
    cells = mixture.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")) for d in DIMS])).alias("d"), "n_tokens", "copies")
    sums = cells.groupBy("d.dimension", "d.value").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("copies")).alias("m"))
    whole = F.broadcast(sums.groupBy("dimension").agg(F.sum("n").alias("all_n"), F.sum("m").alias("all_m")))  # three rows
    return sums.join(whole, "dimension").select("dimension", "value", (F.col("n") / F.nullif("all_n", F.lit(0))).alias("share"), (F.col("m") / F.nullif("all_m", F.lit(0))).alias("sampled"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "source", "lang")
    return mixed(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "taken", "copies")
