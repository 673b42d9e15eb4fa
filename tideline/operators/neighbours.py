"""Exact search for the most similar earlier rows, pruned by time and by likeness.

The pool is cut into ranges of time and, within them, into cones: a centre and the largest angle of a member to it. A target can
only find what it seeks in a cone if the cone begins before it and the angle to the cone's edge allows a similarity that reaches the target's
bound. The bound is the k-th best similarity known so far: from a bounded sample of the pool first, then from the cone that promises
most, which every target meets before the others. Then targets go only to the cones that can still matter. Cones of many rows are
blocks of rows, those of many targets blocks of targets; each pair of blocks is scored as a matrix in one task.

Cone summaries (a row a cone) and the sample are all that the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.columns import unit
from tideline.session import ship_package
from tideline.sources.sinks import staged

#: Pool rows brought to the driver at most, over all groups.
SAMPLE = 16_384
CENTRES = 64
RANGES = 64
#: Targets that meet a block together at most, and those scored at once.
TARGET_ROWS = 4096
SCORED = 256
#: Products of matrices and sums in order differ by less than this for unit vectors; angles by less than the second.
SLACK = 1e-9
ANGLE_SLACK = 1e-6


def _instant(df: DataFrame, name: str) -> Column:
    """A number, date or timestamp as a number in the same order."""
    kind = df.schema[name].dataType.typeName()
    if kind == "date":
        return F.unix_date(name).cast("long")
    return F.unix_micros(F.col(name).cast("timestamp")) if kind.startswith("timestamp") else F.col(name).cast("long" if kind in ("byte", "short", "integer", "long") else "double")


def _searchable(df: DataFrame, group: str | None, *more: Column) -> DataFrame:
    """g, id, at and the unit vector of the rows that take part."""
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    g = F.col(group).cast("int") if group else F.lit(0)
    return df.where(whole).select(g.alias("g"), "id", _instant(df, "at").alias("at"), unit(F.col("vec")).alias("v"), *more).where("at IS NOT NULL AND g IS NOT NULL")


def _matrix(column):
    import numpy as np

    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1)


@dataclass
class Ground:
    """One group's cones: centres, edges of the time ranges, and where its cone numbers begin; its sample and the sample's times."""

    first: int
    centres: object
    edges: object
    sample: object
    times: object

    def place(self, v, at):
        """Cone number and angle to its centre."""
        import numpy as np

        sims = v @ self.centres.T
        c = sims.argmax(1)
        angle = np.arccos(np.clip(sims[np.arange(len(v)), c], -1, 1))
        return self.first + np.searchsorted(self.edges, at, side="right") * len(self.centres) + c, angle


@dataclass
class Cones:
    """Per cone number its largest angle and earliest time; cones without rows begin never."""

    angle: object
    begins: object


def _centres(v, n: int):
    """Centres of the sample on the sphere, from a fixed start."""
    import numpy as np

    centres = v[np.linspace(0, len(v) - 1, n).astype(int)]
    for _ in range(6):
        near = (v @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, v)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], centres)
    return centres


def _grounds(p: DataFrame, cell_rows: int) -> tuple[dict[int, Ground], int]:
    import numpy as np

    counts = {r.g: r["count"] for r in p.groupBy("g").count().collect()}  # a row a group
    drawn = p.select("g", "at", "v").orderBy(F.xxhash64("g", "id", "at")).limit(SAMPLE).collect()
    out, first = {}, 0
    for g, n in sorted(counts.items()):
        own = [r for r in drawn if r.g == g]
        v = np.array([r.v for r in own], np.float64)
        at = np.array([r["at"] for r in own], np.float64)
        wanted = -(-n // cell_rows)
        c = max(1, min(CENTRES, len(own), int(2 * wanted**0.5) if wanted > 1 else 1))
        r = max(1, min(RANGES, -(-wanted // c)))
        edges = np.unique(np.quantile(at, np.arange(1, r) / r, method="higher")) if len(own) and r > 1 else np.empty(0)
        if not len(own):
            v, at = np.zeros((1, 1)), np.zeros(1)
        out[g] = Ground(first, _centres(v, c), edges, v if len(own) else v[:0], at[: len(own)])
        first += (len(edges) + 1) * c
    return out, first


def _placed(grounds: dict[int, Ground], angles: bool):
    """Pool rows with their cone, or with angles only what the cones' summaries need."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            g, at, v = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.float64), _matrix(batch.column(3))
            cone, angle = np.zeros(len(g), np.int64), np.zeros(len(g))
            for own in np.unique(g):
                rows = g == own
                cone[rows], angle[rows] = grounds[own].place(v[rows], at[rows])
            if angles:
                yield pa.RecordBatch.from_arrays([pa.array(cone.astype(np.int32)), pa.array(angle), pa.array(at)], names=["cone", "angle", "at"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(cone.astype(np.int32)), *batch.columns[1:]], names=["cone", *batch.schema.names[1:]])

    return run


def _dealt(grounds: dict[int, Ground], cones: Cones, k: int | None, floor: float | None, threshold: float | None, first: bool):
    """Targets beside the cones they go to: the one that promises most, or all others that can still matter. Columns: g, id, at, v, known."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            g, at = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.float64)
            v = _matrix(batch.column(3)) if batch.num_rows else None
            known = batch.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
            row, cone = [], []
            for own in np.unique(g):
                if own not in grounds:
                    continue
                ground, rows = grounds[own], np.flatnonzero(g == own)
                n = len(ground.centres) * (len(ground.edges) + 1)
                mine = slice(ground.first, ground.first + n)
                for i in range(0, len(rows), SCORED):
                    some = rows[i : i + SCORED]
                    angle = np.arccos(np.clip(v[some] @ ground.centres.T, -1, 1))
                    apart = np.maximum(0, np.tile(angle, len(ground.edges) + 1) - cones.angle[mine] - ANGLE_SLACK)
                    upper = np.cos(np.minimum(apart, np.pi)) + SLACK
                    early = cones.begins[mine][None, :] < at[some][:, None]
                    promise = np.where(early, upper, -np.inf)
                    best = promise.argmax(1)
                    if first:
                        need = np.zeros_like(early)
                        need[np.arange(len(some)), best] = True
                        need &= early
                    else:
                        need = np.zeros_like(early)
                        if k is not None:
                            bound = np.nan_to_num(known[some], nan=-np.inf)
                            if len(ground.sample) >= k:
                                sims = v[some] @ ground.sample.T
                                sims[ground.times[None, :] >= at[some][:, None]] = -np.inf
                                bound = np.maximum(bound, np.partition(sims, -k, axis=1)[:, -k] - SLACK)
                            need |= upper >= np.maximum(bound, -np.inf if floor is None else floor - SLACK)[:, None]
                        if threshold is not None:
                            need |= upper >= threshold - SLACK
                        need &= early
                        need[np.arange(len(some)), best] = False
                    at_row, at_cone = np.nonzero(need)
                    row.append(some[at_row])
                    cone.append(at_cone + ground.first)
            take = pa.array(np.concatenate(row) if row else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(cone) if cone else np.empty(0)).astype(np.int32)), *[batch.column(i).take(take) for i in range(4)]], names=["cone", "g", "id", "at", "v"])

    return run


def _solve(k: int | None, floor: float | None, threshold: float | None, scored: bool):
    """A block of targets and one of the pool -> each target's k best earlier rows (ties to the smaller id), and with a threshold how many
    earlier rows reach it and the sum of their scores (other is null there). scored: adds the number of pairs that were scored."""

    def run(t, p):
        import numpy as np
        import pyarrow as pa

        names = ["g", "id", "other", "sim", "score", "n"]
        kinds = [pa.int32(), t.schema.field("id").type, p.schema.field("id").type, pa.float64(), pa.float64(), pa.int64()]
        if not t.num_rows or not p.num_rows:
            return pa.table([pa.array([], x) for x in kinds], names=names)
        p = p.sort_by("id")
        tv, pv = _matrix(t["v"].combine_chunks()), _matrix(p["v"].combine_chunks())
        t_at, p_at, score = t["at"].to_numpy(), p["at"].to_numpy(), p["score"].to_numpy(zero_copy_only=False).astype(np.float64)
        rows, others, sims_out, n_out, sum_out = [], [], [], [], []

        def exact(some, row, col):
            sim = np.zeros(len(row))  # summed in order, so that equal vectors tie
            for d in range(some.shape[1]):
                sim += some[row, d] * pv[col, d]
            return sim

        for i in range(0, len(tv), SCORED):
            some = tv[i : i + SCORED]
            sims = some @ pv.T
            sims[p_at[None, :] >= t_at[i : i + SCORED, None]] = -np.inf
            if k is not None:
                least = np.partition(sims, -k, axis=1)[:, -k] - SLACK if pv.shape[0] > k else np.full(len(some), -np.inf)
                if floor is not None:
                    least = np.maximum(least, floor - SLACK)
                row, col = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
                sim = exact(some, row, col)
                order = np.lexsort((col, -sim, row))
                row, col, sim = row[order], col[order], sim[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                if floor is not None:
                    keep &= sim >= floor
                rows.append(row[keep] + i)
                others.append(col[keep])
                sims_out.append(sim[keep])
                sum_out.append(score[col[keep]])
                n_out.append(np.ones(int(keep.sum()), np.int64))
            if threshold is not None:
                near = sims >= threshold - SLACK
                row, col = np.nonzero(near & (sims < threshold + SLACK))
                near[row, col] = exact(some, row, col) >= threshold
                reached = near.sum(1)
                used = np.flatnonzero(reached)
                rows.append(used + i)
                others.append(np.full(len(used), -1))
                sims_out.append(np.full(len(used), np.nan))
                sum_out.append((near[used] * score[None, :]).sum(1))
                n_out.append(reached[used].astype(np.int64))
            if scored:
                rows.append(np.array([i]))
                others.append(np.array([-1]))
                sims_out.append(np.array([-2.0]))
                sum_out.append(np.array([0.0]))
                n_out.append(np.array([sims.size]))
        row, other = np.concatenate(rows), np.concatenate(others)
        other = pa.array(other, mask=other < 0)
        return pa.table([t["g"].take(pa.array(row)).cast(pa.int32()), t["id"].take(pa.array(row)), p["id"].combine_chunks().take(other), pa.array(np.concatenate(sims_out)), pa.array(np.concatenate(sum_out)), pa.array(np.concatenate(n_out))], names=names)

    return run


def _met(dealt: DataFrame, placed: DataFrame, sizes: dict[int, int], block_rows: int, solve, schema: str) -> DataFrame:
    """Dealt targets against the pool rows of their cones, block by block."""
    spark = dealt.sparkSession
    asked = {r.cone: r["count"] for r in dealt.groupBy("cone").count().collect()}  # a row a cone
    blocks = spark.createDataFrame([(c, max(1, -(-sizes[c] // block_rows)), -(-n // TARGET_ROWS)) for c, n in asked.items()], "cone int, p_blocks int, t_blocks int")
    blocks = F.broadcast(blocks)
    left = dealt.join(blocks, "cone").select("cone", F.pmod(F.xxhash64("g", "id"), "t_blocks").cast("int").alias("tb"), F.explode(F.sequence(F.lit(0), F.col("p_blocks") - 1)).alias("pb"), "g", "id", "at", "v")
    right = placed.join(blocks, "cone").select("cone", F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1)).alias("tb"), F.pmod(F.xxhash64("id", "at"), "p_blocks").cast("int").alias("pb"), "id", "at", "v", "score")
    keys = ["cone", "tb", "pb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, schema)


def search_earlier(targets: DataFrame, pool: DataFrame, k: int | None, *, floor: float | None = None, threshold: float | None = None, group: str | None = None, cell_rows: int = 4096, block_rows: int = 16_384, scored: bool = False) -> DataFrame:
    """g, id, other, sim, score, n: the candidates of each target's k best earlier pool rows of its group (n = 1), and with a
    threshold rows without `other` that hold the number of earlier rows that reach it and the sum of their scores.

    Both tables are read several times and should be stored. See earlier_neighbours() for the columns. scored: rows of sim -2
    hold in n how many pairs were scored, for measuring.
    """
    import numpy as np

    ship_package(targets.sparkSession)
    t, p = _searchable(targets, group), _searchable(pool, group, F.col("score").cast("double").alias("score"))
    schema = f"g int, id {t.schema['id'].dataType.simpleString()}, other {p.schema['id'].dataType.simpleString()}, sim double, score double, n long"
    grounds, n_cones = _grounds(p, cell_rows)
    if not grounds:
        return targets.sparkSession.createDataFrame([], schema)
    summed = p.mapInArrow(_placed(grounds, True), "cone int, angle double, at double").groupBy("cone").agg(F.count("*").alias("n"), F.max("angle").alias("angle"), F.min("at").alias("begins")).collect()
    cones, sizes = Cones(np.zeros(n_cones), np.full(n_cones, np.inf)), {}
    for r in summed:
        cones.angle[r.cone], cones.begins[r.cone], sizes[r.cone] = r.angle, r.begins, r.n
    kinds = {x: p.schema[x].dataType.simpleString() for x in ("id", "at")}
    placed = p.mapInArrow(_placed(grounds, False), f"cone int, id {kinds['id']}, at {kinds['at']}, v array<double>, score double")
    deal = lambda df, first: df.select("g", "id", "at", "v", "known").mapInArrow(_dealt(grounds, cones, k, floor, threshold, first), f"cone int, g int, id {t.schema['id'].dataType.simpleString()}, at {t.schema['at'].dataType.simpleString()}, v array<double>")
    solve = _solve(k, floor, threshold, scored)
    unknown = t.withColumn("known", F.lit(None).cast("double"))
    best = _met(deal(unknown, True), placed, sizes, block_rows, solve, schema)
    if all(len(x.centres) * (len(x.edges) + 1) == 1 for x in grounds.values()):
        return best
    best = staged(best, "neighbours")
    if k is None:
        again = unknown
    else:
        nth = best.where("other IS NOT NULL").withColumn("_r", F.row_number().over(W.partitionBy("g", "id").orderBy(F.desc("sim")))).where(F.col("_r") == k).select("g", "id", (F.col("sim") - SLACK).alias("known"))
        again = t.join(nth, ["g", "id"], "left")
    more = staged(deal(again, False), "dealt")
    return best.unionAll(_met(more, placed, sizes, block_rows, solve, schema))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of search_earlier()'s candidates, with rank; ties to the smaller id."""
    best = F.row_number().over(W.partitionBy("g", "id").orderBy(F.desc("sim"), "other"))
    return found.where("other IS NOT NULL").withColumn("rank", best).where(F.col("rank") <= k)


def earlier_neighbours(targets: DataFrame, pool: DataFrame, k: int, *, floor: float | None = None, group: str | None = None, cell_rows: int = 4096, block_rows: int = 16_384) -> DataFrame:
    """id, other, rank, sim, score (and the group's column): each target's k most similar pool rows of an earlier time, by cosine; ties to the smaller id.

    Both: id (in targets unique within a group), at (a number, date or timestamp), vec (of one length; pool also score). Rows without
    a time, and vectors that are null or hold null or non-finite components, take no part. floor: least similarity. group: a column
    of whole numbers in both; targets meet the pool rows of their own group only.
    """
    best = ranked(search_earlier(targets, pool, k, floor=floor, group=group, cell_rows=cell_rows, block_rows=block_rows), k)
    return best.select(*([F.col("g").alias(group)] if group else []), "id", "other", "rank", "sim", "score")
