"""Gradient boosting of symmetric trees with several targets in one tree, for all folds of a validation at once.

Features are binned once, by borders of each fold's own training rows. A level of a tree is one job: every task sums its rows'
residuals per fold, leaf, feature and bin, the tasks' sums are added up, and the best (feature, border, side of missing values)
over all leaves of a fold becomes the fold's next split, as trees are symmetric. Sums are of whole numbers (targets in units of
`unit`), so the order of addition, a retried task or another engine can't change a tree. Leaves hold one value a target.

What reaches the driver is folds x leaves x features x bins sums, whatever the number of rows. Rows carry bins and predictions in a stored table,
rewritten every `checkpoint` trees; trees since then are applied on the fly.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import ship_package
from tideline.sources.sinks import staged

MISSING = 255
TRAIN, VALIDATION, TEST = 1, 2, 3


@dataclass(frozen=True)
class BoostingRules:
    trees: int = 1000
    depth: int = 6
    rate: float = 0.1
    l2: float = 3.0
    bins: int = 32  # a power of two, so that quantiles are exact fractions
    subsample: float = 0.8  # share of rows a tree sees
    colsample: float = 0.8  # share of features a level sees
    patience: int | None = 50  # trees without a better validation error before a fold stops
    unit: float = 1e-4
    seed: int = 42
    accuracy: int = 20_000  # of the quantiles: their error in ranks is n / accuracy
    checkpoint: int = 20

    def features_of(self, tree: int, level: int, n: int) -> list[int]:
        """The features that a level may split on."""
        most = max(1, -int(-self.colsample * n // 1))
        return sorted(random.Random(f"{self.seed}:{tree}:{level}").sample(range(n), most))


#: The rows that a tree sees, by a linear step over 32 bits of a hash of the row's key.
_STEP, _TURN, _WORD = 2654435769, 1103515245, 1 << 32


@dataclass
class Forest:
    """One fold's model. Trees: (feature, border number, missing goes right) per level, gains per level, and leaves x targets."""

    borders: list[list[float]]
    base: list[int]
    trees: list[tuple[list[tuple[int, int, bool]], list[float], list[list[int]]]] = field(default_factory=list)
    best: int = 0  # trees that count
    errors: list[int] = field(default_factory=list)
    stopped: bool = False

    def gains(self) -> list[float]:
        """Gain of each feature over the trees that count."""
        out = [0.0] * len(self.borders)
        for splits, gained, _ in self.trees[: self.best]:
            for (f, _, _), g in zip(splits, gained, strict=True):
                out[f] += g
        return out


def leaf_numbers(bins, splits):
    """rows x features of bins -> number of the leaf: a bit a level, set where the row goes right."""
    import numpy as np

    leaf = np.zeros(len(bins), np.int64)
    for level, (f, k, missing_right) in enumerate(splits):
        b = bins[:, f]
        leaf |= np.where(b == MISSING, missing_right, b > k).astype(np.int64) << level
    return leaf


def predicted(forest: Forest, bins, first: int = 0, last: int | None = None, start=None):
    """Predictions in units by the trees first to last, from the base or from `start`."""
    import numpy as np

    out = np.tile(np.array(forest.base, np.int64), (len(bins), 1)) if start is None else start.copy()
    for splits, _, leaves in forest.trees[first:last]:
        out += np.array(leaves, np.int64)[leaf_numbers(bins, splits)]
    return out


def best_split(n, s, allowed: Sequence[int], widths: Sequence[int], l2: float):
    """(score, feature, border, missing goes right, left and right sums) of the best split over all leaves, and the score unsplit.

    n: leaves x features x (bins and missing); s: the same x targets. Ties go to the smaller feature, border, then left.
    """
    import numpy as np

    def part(count, total):
        with np.errstate(divide="ignore", invalid="ignore"):
            each = [np.where(count > 0, total[..., t] * total[..., t] / (count + l2), 0.0) for t in range(total.shape[-1])]
        return sum(each[1:], each[0])

    best = None
    whole_n, whole_s = n[:, 0].sum(-1).astype(np.float64), s[:, 0].sum(1).astype(np.float64)
    for f in allowed:
        for k in range(widths[f]):
            left_n, left_s = n[:, f, : k + 1].sum(1), s[:, f, : k + 1].sum(1)
            for right in (False, True):
                a_n, a_s = (left_n, left_s) if right else (left_n + n[:, f, -1], left_s + s[:, f, -1])
                a_n, a_s = a_n.astype(np.float64), a_s.astype(np.float64)
                b_n, b_s = whole_n - a_n, whole_s - a_s
                score = float((part(a_n, a_s) + part(b_n, b_s)).sum())
                if best is None or score > best[0]:
                    best = (score, f, k, right, a_n, a_s, b_n, b_s)
    return best, float(part(whole_n, whole_s).sum())


def _numbers(column, kind, width: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _histograms(forests: list[Forest], growing: dict[int, list], done: int, tree: int, rules: BoostingRules, allowed: list[int], n_targets: int, widest: int, judged: bool):
    """Per fold, leaf, feature and bin: rows and residual sums of the rows that the tree sees; slot -1 has the validation error."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n_features = len(forests[0].borders)
        size = (1 << max(len(v) for v in growing.values())) * n_features * (widest + 1)
        n = {f: np.zeros(size, np.int64) for f in growing}
        s = {f: np.zeros((n_targets, size), np.int64) for f in growing}
        lost = dict.fromkeys(growing, 0)
        for batch in batches:
            fold, role, draw = (batch.column(i).to_numpy() for i in range(3))
            bins, y, pred = _numbers(batch.column(3), np.uint8, n_features), _numbers(batch.column(4), "<i8", n_targets), _numbers(batch.column(5), "<i8", n_targets)
            seen = (draw.astype(np.uint64) + np.uint64(tree * _STEP % _WORD)) % np.uint64(_WORD) * np.uint64(_TURN) % np.uint64(_WORD) < int(rules.subsample * _WORD)
            for f, splits in growing.items():
                for rows in (np.flatnonzero((fold == f) & (role == TRAIN) & seen), np.flatnonzero((fold == f) & (role == VALIDATION)) if judged else ()):
                    if not len(rows):
                        continue
                    residual = y[rows] - predicted(forests[f], bins[rows], done, tree, pred[rows])
                    if role[rows[0]] == VALIDATION:
                        lost[f] += sum(int(x) for x in (residual.astype(object) ** 2).sum(1))
                        continue
                    leaf = leaf_numbers(bins[rows], splits)
                    b = bins[rows][:, allowed].astype(np.int64)
                    slot = ((leaf[:, None] * n_features + np.array(allowed)) * (widest + 1) + np.where(b == MISSING, widest, b)).ravel()
                    np.add.at(n[f], slot, 1)
                    for t in range(n_targets):
                        np.add.at(s[f][t], slot, np.repeat(residual[:, t], len(allowed)))
        out = [[], [], [], *[[] for _ in range(n_targets)], [], []]
        for f in growing:
            used = np.flatnonzero(n[f])
            for column, values in zip(out, [[f] * len(used), used, n[f][used], *[x[used] for x in s[f]], [0] * len(used), [0] * len(used)], strict=True):
                column.extend(values)
            for column, value in zip(out, [f, -1, 0, *[0] * n_targets, lost[f] >> 32, lost[f] & (_WORD - 1)], strict=True):
                column.append(value)
        names = ["fold", "slot", "n", *[f"s{t}" for t in range(n_targets)], "high", "low"]
        kinds = [pa.int32(), *[pa.int64()] * (len(names) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def _binned(borders: list[list[list[float]]], n_targets: int, unit: float, bases: list[list[int]]):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fold = batch.column(1).to_numpy()
            n_features = batch.num_columns - 4 - n_targets
            bins = np.empty((batch.num_rows, n_features), np.uint8)
            for j in range(n_features):
                x = batch.column(4 + n_targets + j).to_numpy(zero_copy_only=False).astype(np.float64)
                for f in np.unique(fold):
                    rows = fold == f
                    bins[rows, j] = np.where(np.isnan(x[rows]), MISSING, np.searchsorted(borders[f][j], x[rows], side="left"))
            y = np.stack([np.floor(np.nan_to_num(batch.column(4 + t).to_numpy(zero_copy_only=False).astype(np.float64)) / unit + 0.5).astype(np.int64) for t in range(n_targets)], 1)
            pred = np.array(bases, np.int64)[fold]
            packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (bins, y.astype("<i8"), pred.astype("<i8"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *packed], names=["key", "fold", "role", "draw", "bins", "y", "pred"])

    return run


def _advanced(forests: list[Forest], done: int, n_targets: int):
    """State rows with the predictions of the trees since the last checkpoint added."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fold = batch.column(1).to_numpy()
            bins, pred = _numbers(batch.column(4), np.uint8, len(forests[0].borders)), _numbers(batch.column(6), "<i8", n_targets).copy()
            for f in np.unique(fold):
                rows = fold == f
                pred[rows] = predicted(forests[f], bins[rows], done, None, pred[rows])
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([r.tobytes() for r in pred.astype("<i8")], pa.binary())], names=batch.schema.names)

    return run


_STATE = "key long, fold int, role int, draw long, bins binary, y binary, pred binary"


def _row_draw(key: str, seed: int) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")


def fit_boosted(rows: DataFrame, key: str, features: Sequence[str], targets: Sequence[str], roles: Sequence[Column], rules: BoostingRules = BoostingRules()) -> tuple[DataFrame, list[Forest]]:
    """Fits one model a fold and returns its rows (key, fold, role, bins, y, ...; a stored table) and the folds' models.

    roles: per fold an expression that is TRAIN, VALIDATION or TEST, or null where the row is no part of the fold. Rows without a
    target train and judge nothing. Missing features (null, NaN) go to the side that gains more. Targets are rounded to `unit`.
    With patience, a fold's model keeps the trees up to its least validation error and stops after so many without a better one;
    without, or without validation rows, all trees count. Fewer rows or constant features make smaller trees or none.
    """
    import numpy as np

    ship_package(rows.sparkSession)
    if rules.bins & (rules.bins - 1) or not 2 <= rules.bins <= 128:
        raise ValueError("bins must be a power of two from 2 to 128")
    n_targets, n_features = len(targets), len(features)
    known = F.lit(True)
    for t in targets:
        known = known & F.col(t).isNotNull()
    roled = F.array(*[F.struct(F.lit(f).cast("int").alias("fold"), r.cast("int").alias("role")) for f, r in enumerate(roles)])
    one = F.explode(F.filter(roled, lambda x: x["role"].isNotNull())).alias("x")
    of_target = [F.col(t).cast("double").alias(f"y{i}") for i, t in enumerate(targets)]
    of_feature = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    told = rows.select(F.col(key).cast("long").alias("key"), _row_draw(key, rules.seed).alias("draw"), known.alias("known"), one, *of_target, *of_feature).where("known OR x.role = 3")
    flat = staged(told.select("key", "x.fold", "x.role", "draw", *[f"y{i}" for i in range(n_targets)], *[F.nanvl(f"f{i}", F.lit(None)).alias(f"f{i}") for i in range(n_features)]), "boosting-rows")
    train = flat.where(F.col("role") == TRAIN)
    whole = [F.sum(F.floor(F.col(f"y{i}") / rules.unit + 0.5).cast("long")).alias(f"s{i}") for i in range(n_targets)]
    cuts = [F.percentile_approx(f"f{i}", [k / rules.bins for k in range(1, rules.bins)], rules.accuracy).alias(f"q{i}") for i in range(n_features)]
    fitted = {r.fold: r for r in train.groupBy("fold").agg(F.count("*").alias("n"), *whole, *cuts).collect()}
    forests = []
    for f in range(len(roles)):
        r = fitted.get(f)
        forests.append(Forest([sorted(set(r[f"q{i}"] or [])) if r else [] for i in range(n_features)], [r[f"s{t}"] // r.n if r else 0 for t in range(n_targets)], stopped=r is None))
    borders = [x.borders for x in forests]
    state = staged(flat.mapInArrow(_binned(borders, n_targets, rules.unit, [x.base for x in forests]), _STATE), "boosting-state")
    widest, done = rules.bins, 0
    judged = rules.patience is not None
    for tree in range(rules.trees + judged):
        if not any(not x.stopped for x in forests):
            break
        if tree - done >= rules.checkpoint:
            state, done = staged(state.mapInArrow(_advanced(forests, done, n_targets), _STATE), "boosting-state"), tree
        growing: dict[int, list] = {f: [] for f, x in enumerate(forests) if not x.stopped}
        gained: dict[int, list] = {f: [] for f in growing}
        closing: dict[int, tuple] = {}
        for level in range(rules.depth):
            allowed = rules.features_of(tree, level, n_features)
            summed = _summed(state, forests, growing, done, tree, rules, allowed, n_targets, widest, judged and level == 0)
            for f in list(growing):
                n, s, lost = _arrays(summed, f, 1 << level, n_features, widest, n_targets)
                if level == 0 and judged and _worse(forests[f], lost, tree, rules.patience) or tree == rules.trees:
                    growing.pop(f)
                    continue
                chosen, before = best_split(n[:, allowed], s[:, allowed], range(len(allowed)), [len(forests[f].borders[j]) for j in allowed], rules.l2)
                if chosen is None:
                    if level == 0:
                        forests[f].stopped = True
                        growing.pop(f)
                    continue
                score, j, k, right, *sums = chosen
                growing[f].append((allowed[j], k, right))
                gained[f].append(score - before)
                closing[f] = sums
            if not growing:
                break
        for f, splits in growing.items():
            if splits:
                a_n, a_s, b_n, b_s = closing[f]
                value = lambda n, s: [int(np.floor(rules.rate * x / (n + rules.l2) + 0.5)) if n else 0 for x in s]
                leaves = [value(n, s) for n, s in zip(a_n, a_s, strict=True)] + [value(n, s) for n, s in zip(b_n, b_s, strict=True)]
                forests[f].trees.append((splits, gained[f], leaves))
                if not judged:
                    forests[f].best = len(forests[f].trees)
    return state, forests


def _summed(state, forests, growing, done, tree, rules, allowed, n_targets, widest, judged) -> dict:
    names = [f"s{t}" for t in range(n_targets)]
    made = state.select("fold", "role", "draw", "bins", "y", "pred").mapInArrow(_histograms(forests, growing, done, tree, rules, allowed, n_targets, widest, judged), f"fold int, slot long, n long, {', '.join(f'{n} long' for n in names)}, high long, low long")
    rows = made.groupBy("fold", "slot").agg(*[F.sum(c).alias(c) for c in ("n", *names, "high", "low")]).collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r.fold, []).append(r)
    return out


def _arrays(summed: dict, fold: int, leaves: int, n_features: int, widest: int, n_targets: int):
    import numpy as np

    n = np.zeros(leaves * n_features * (widest + 1), np.int64)
    s = np.zeros((len(n), n_targets), np.int64)
    lost = 0
    for r in summed.get(fold, ()):
        if r.slot < 0:
            lost = (r.high << 32) + r.low
        else:
            n[r.slot] = r.n
            s[r.slot] = [r[f"s{t}"] for t in range(n_targets)]
    return n.reshape(leaves, n_features, widest + 1), s.reshape(leaves, n_features, widest + 1, n_targets), lost


def _worse(forest: Forest, lost: int, tree: int, patience: int) -> bool:
    """Notes the validation error after `tree` trees; whether the fold has gone on too long."""
    forest.errors.append(lost)
    if lost == 0 and not any(forest.errors):  # nothing to judge by
        forest.best = tree
        return False
    forest.best = min(range(len(forest.errors)), key=forest.errors.__getitem__)
    forest.stopped = tree - forest.best >= patience
    return forest.stopped


def predict_boosted(state: DataFrame, forests: list[Forest], targets: Sequence[str], unit: float = BoostingRules.unit) -> DataFrame:
    """fold, key, role, each target and its prediction pred_<target>, of all rows of the fitted folds."""
    names = [*targets, *[f"pred_{t}" for t in targets]]
    scored = state.mapInArrow(_scored(forests, len(targets), unit, names), f"key long, fold int, role int, {', '.join(f'{n} double' for n in names)}")
    return scored


def _scored(forests: list[Forest], n_targets: int, unit: float, names: list[str]):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fold = batch.column(1).to_numpy()
            bins, y = _numbers(batch.column(4), np.uint8, len(forests[0].borders)), _numbers(batch.column(5), "<i8", n_targets)
            pred = np.zeros((batch.num_rows, n_targets), np.int64)
            for f in np.unique(fold):
                rows = fold == f
                pred[rows] = predicted(forests[f], bins[rows], 0, forests[f].best)
            values = [pa.array(x * unit) for x in (*y.T, *pred.T)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *values], names=["key", "fold", "role", *names])

    return run


def family_errors(state: DataFrame, forests: list[Forest], donors: DataFrame, families: Mapping[str, Sequence[int]], unit: float = BoostingRules.unit) -> DataFrame:
    """fold, family, n, diff_mae, total_mae of the validation rows, with each family's features taken together from the row's donor;
    family 'none' is the model as it is. Two targets: a score of either side. donors: fold, key, donor.

    One pass: a row meets its donor's bins once, all families are tried on it, and tasks give one row of sums a fold and family.
    """
    rows = state.where(F.col("role") == VALIDATION).select("fold", "key", "bins", "y")
    lent = rows.select("fold", F.col("key").alias("donor"), F.col("bins").alias("lent"))
    both = rows.join(donors, ["fold", "key"]).join(lent, ["fold", "donor"]).select("fold", "bins", "y", "lent")
    made = both.mapInArrow(_family_sums(forests, {k: list(v) for k, v in families.items()}), "fold int, family string, n long, d long, t long")
    per = made.groupBy("fold", "family").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("t").alias("t"))
    mean = lambda c: F.col(c) * F.lit(unit) / F.col("n")
    return per.select("fold", "family", "n", mean("d").alias("diff_mae"), mean("t").alias("total_mae"))


def _family_sums(forests: list[Forest], families: dict[str, list[int]]):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict[tuple[int, str], list[int]] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy()
            width = len(forests[0].borders)
            bins, y, lent = _numbers(batch.column(1), np.uint8, width), _numbers(batch.column(2), "<i8", 2), _numbers(batch.column(3), np.uint8, width)
            for f in np.unique(fold).tolist():
                rows = np.flatnonzero(fold == f)
                for family, columns in ({"none": []} | families).items():
                    tried = bins[rows].copy()
                    tried[:, columns] = lent[rows][:, columns]
                    error = y[rows] - predicted(forests[f], tried, 0, forests[f].best)
                    held = sums.setdefault((f, family), [0, 0, 0])
                    held[0] += len(rows)
                    held[1] += int(np.abs(error[:, 0] - error[:, 1]).sum())
                    held[2] += int(np.abs(error.sum(1)).sum())
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), *[pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(3)]], names=["fold", "family", "n", "d", "t"])

    return run
