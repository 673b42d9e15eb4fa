"""Exact top-k by inner product as a Voronoi join.

Vectors become integers (floor(scale * x)). Equal vectors are one row that keeps its k + 1 smallest ids, which is all that any
query can use of them, so a vector that fills a third of the table costs one row. Pivots, chosen from a bounded sample, split
queries and data into cells. The sample gives each query a score that it reaches k times; a query at distance d from its pivot
needs a data vector x only if pivot . x + d |x| reaches that. Per group of queries the summary is the largest d n - score at KNOTS
norms n: between them a convex function lies below its chords. The cells' counts and radii give each group one more such score.
A counting scan then tells how many vectors each group needs. Groups that need most of the data share them; groups of many
queries are split; the data of a group go to blocks of bounded size, are solved locally, and the blocks' top rows are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm._common import pick, stage, table

SAMPLE = 4096
GROUP_QUERIES = 128
MAX_PIVOTS = 1024
BLOCK_ROWS = 16_384
#: Queries that meet a block together at most.
UNIT_QUERIES = 8192
KNOTS = 17


def _matrix(column):
    """A list<bigint> Arrow column without nulls -> matrix of float64 (int64 where products could pass 2**53)."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.int64).reshape(len(column), -1)


def _scores(a, b):
    """Integer inner products of all rows of a with all rows of b: by float64 where that is exact. Nothing wraps: voronoi_topk()
    refuses vectors whose products could pass 2**63."""
    import numpy as np

    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _pivots(sample, n: int):
    """n centres of the sample by a few rounds of Lloyd's algorithm, from a fixed start."""
    import numpy as np

    x = sample.astype(np.float64)
    centres = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(8):
        near = _nearest(x, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n_in = np.bincount(near, minlength=len(centres))
        centres = np.where(n_in[:, None] > 0, sums / np.maximum(n_in, 1)[:, None], centres)
    return centres


def _nearest(x, centres):
    import numpy as np

    d = (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None, :]
    near = d.argmin(1)
    return near, np.sqrt(np.maximum(d[np.arange(len(x)), near], 0)) + 1e-6


def _place(centres, sample, k: int):
    """Data or queries -> cell, distance to its pivot, norm and the score that the sample alone guarantees k times besides a row itself."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            near, dist = _nearest(x.astype(np.float64), centres)
            floor = np.full(len(x), -np.inf)
            if sample is not None and len(sample) > k:
                floor = np.partition(_scores(x, sample), len(sample) - k - 1, axis=1)[:, len(sample) - k - 1].astype(np.float64)
            norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(dist), pa.array(norm), pa.array(floor)], names=["id", "vec", "cell", "dist", "norm", "floor"])

    return run


class Bounds:
    """What query groups need: centres of their pivots, largest distance, the guaranteed score, and the summaries at the knots."""

    def __init__(self, centres, radius, floor, knots, at_knots):
        self.centres, self.radius, self.floor, self.knots, self.at_knots = centres, radius, floor, knots, at_knots

    def needed(self, x):
        """Rows x groups: whether a vector may be among the k best of any of the group's queries."""
        import numpy as np

        norm = np.sqrt((x * x).sum(1))
        step = np.clip(np.searchsorted(self.knots, norm) - 1, 0, len(self.knots) - 2)
        part = ((norm - self.knots[step]) / (self.knots[step + 1] - self.knots[step]))[:, None]
        low, high = self.at_knots[:, step].T, self.at_knots[:, step + 1].T
        with np.errstate(invalid="ignore"):
            chord = np.where(np.isfinite(low) & np.isfinite(high), low + part * (high - low), np.inf)
        reach = np.minimum(chord, norm[:, None] * self.radius[None, :] - self.floor[None, :])
        near = x @ self.centres.T
        return near + reach + 1 + 1e-9 * (np.abs(near) + norm[:, None] * self.radius[None, :]) >= 0


def _count_needed(bounds: Bounds):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n = np.zeros(len(bounds.radius), np.int64)
        for batch in batches:
            if batch.num_rows:
                n += bounds.needed(_matrix(batch.column(1)).astype(np.float64)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["at", "n"])

    return run


def _counts(data: DataFrame, bounds: Bounds) -> list[int]:
    """How many vectors each group needs."""
    rows = data.mapInArrow(_count_needed(bounds), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    return [n for _, n in sorted((r.at, r.n) for r in rows)]


def _units(needs: list[int], asked: list[int], count: int) -> list[tuple[int, int, int]]:
    """Per group the first of its units, how many it has, and their number of rows. Groups that need over half of the data share
    units of up to UNIT_QUERIES queries; others have their own, several if they have more queries than that."""
    out, shared, room, units = [], 0, 0, 0
    for need, queries in zip(needs, asked, strict=True):
        if 2 * need > count and queries <= UNIT_QUERIES:
            if room < queries:
                shared, room, units = units, UNIT_QUERIES, units + 1
            room -= queries
            out.append((shared, 1, count))
        else:
            parts = math.ceil(queries / UNIT_QUERIES)
            out.append((units, parts, need))
            units += parts
    return out


def _replicate(bounds: Bounds, units: list[tuple[int, int, int]], blocks: list[int]):
    """Every vector goes to those units with a group that needs it, into one block of each."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        members = np.zeros((len(units), len(blocks)), np.float32)
        for g, (first, parts, _) in enumerate(units):
            members[g, first : first + parts] = 1
        n_blocks = np.asarray(blocks, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            needed = bounds.needed(_matrix(batch.column(1)).astype(np.float64)).astype(np.float32)
            row, unit = np.nonzero(needed @ members)
            block = np.asarray(batch.column(2).to_numpy(), np.int64)[row] % n_blocks[unit]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(unit.astype(np.int32)), pa.array(block.astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take)], names=["unit", "block", "ids", "vec"])

    return run


def _solve(k: int):
    def run(queries, data):
        import numpy as np
        import pyarrow as pa

        out: tuple[list, list, list] = ([], [], [])
        names = ["query_id", "vec_id", "score"]
        if queries.num_rows and data.num_rows:
            q_ids, ids = queries["id"].to_pylist(), data["ids"].to_pylist()
            x = _matrix(data["vec"].combine_chunks())
            q = _matrix(queries["vec"].combine_chunks())
            for start in range(0, len(q), 256):
                scores = _scores(q[start : start + 256], x)
                for own, s in zip(q_ids[start : start + 256], scores, strict=True):
                    at = max(0, len(s) - k - 1)
                    least = np.partition(s, at)[at]
                    found = sorted((-int(s[j]), i) for j in np.flatnonzero(s >= least) for i in ids[j] if i != own)[:k]
                    out[0].extend([own] * len(found))
                    out[1].extend(i for _, i in found)
                    out[2].extend(-v for v, _ in found)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=names)

    return run


def voronoi_topk(
    vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, sample: int = SAMPLE, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other vectors by integer inner product, ties to the smaller id.

    queries is a condition over the column `id`. Rows with a null id, a null vector or null or non-finite components take no
    part. Vectors of unequal length raise an error, as they have no inner product, and so do components so large that a score
    could pass 2**63 (dims * component**2, after scaling). An id given twice counts with either
    vector, each (id, vector) once; a query never meets its own id. Fewer than k candidates: all of them. Empty: no rows.
    Only the sample (at most `sample` vectors) and one summary row a cell (at most MAX_PIVOTS) reach the driver.
    """
    import numpy as np

    base = pick(vectors, id_col, vec_col).toDF("id", "vec")
    fine = F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = base.where(fine).select(F.col("id").cast("long"), F.transform("vec", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("vec")).distinct()
    by_vec = W.partitionBy("vec").orderBy("id")
    first = whole.withColumn("n", F.row_number().over(by_vec)).where(F.col("n") <= k + 1)
    data = stage(first.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("ids", "vec", F.abs(F.xxhash64("vec") % (1 << 40)).alias("h")), "vectors")
    seeds = data.select("vec").orderBy("h").limit(sample).collect()
    schema = "query_id long, rank int, vec_id long, score long"
    if not seeds:
        return vectors.sparkSession.createDataFrame([], schema)
    if len({len(r.vec) for r in seeds}) > 1:
        raise ValueError("vectors of unequal length")
    seed = np.array([r.vec for r in seeds], np.int64)
    asked = whole.where(queries)
    count, least, most = data.agg(F.count("*"), F.min(F.array_min("vec")), F.max(F.array_max("vec"))).collect()[0]
    dims = len(seeds[0].vec)
    if dims and dims * max(-least, most) ** 2 >= 2**63:
        worst = least if -least > most else most
        held = data.where(F.array_contains("vec", F.lit(worst).cast("long"))).first()
        raise ValueError(f"vector {held.ids[0]} has a component of {worst}, so inner products could pass 2**63; take a smaller scale")
    n_queries = asked.agg(F.count("*")).collect()[0][0]
    centres = _pivots(seed, min(MAX_PIVOTS, max(4, math.ceil(n_queries / group_queries))))
    fields = "vec array<long>, cell int, dist double, norm double, floor double"
    placed = stage(asked.mapInArrow(_place(centres, seed, k), f"id long, {fields}"), "queries")
    cells = data.select(F.col("ids").alias("id"), "vec").mapInArrow(_place(centres, None, k), f"id array<long>, {fields}").groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.max("norm").alias("norm")).collect()
    knots = np.linspace(0, max(c.norm for c in cells) * (1 + 1e-9) + 1, KNOTS)
    reach = [F.max(F.col("dist") * float(at) - F.col("floor")).alias(f"k{j}") for j, at in enumerate(knots)]
    groups = sorted(placed.groupBy("cell").agg(F.count("*").alias("queries"), F.max("dist").alias("radius"), *reach).collect(), key=lambda r: r.cell)
    if not groups:
        return vectors.sparkSession.createDataFrame([], schema)
    norm = np.sqrt((centres * centres).sum(1))
    floor = np.full(len(groups), -np.inf)
    for at, g in enumerate(groups):  # what the cells' summaries alone guarantee
        least = sorted(((centres[g.cell] @ centres[c.cell] - norm[g.cell] * c.radius - g.radius * norm[c.cell] - g.radius * c.radius, c.n) for c in cells), reverse=True)
        held = 0
        for score, n in least:
            held += n
            if held > k:
                floor[at] = score
                break
    bounds = Bounds(centres[[g.cell for g in groups]], np.array([g.radius for g in groups]), floor, knots, np.array([[g[f"k{j}"] for j in range(KNOTS)] for g in groups]))
    units = _units(_counts(data, bounds), [g.queries for g in groups], count)
    blocks = [1] * max(first + parts for first, parts, _ in units)
    for first, parts, rows in units:
        blocks[first : first + parts] = [max(1, math.ceil(rows / block_rows))] * parts
    needed = data.mapInArrow(_replicate(bounds, units, blocks), "unit int, block int, ids array<long>, vec array<long>")
    where = vectors.sparkSession.createDataFrame([(g.cell, u[0], u[1], blocks[u[0]]) for g, u in zip(groups, units, strict=True)], "cell int, first int, parts int, blocks int")
    dealt = placed.join(F.broadcast(where), "cell")  # a row a cell, MAX_PIVOTS at most
    dealt = dealt.select("id", "vec", (F.col("first") + F.pmod(F.xxhash64("id"), "parts")).cast("int").alias("unit"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    local = dealt.groupBy("unit", "block").cogroup(needed.groupBy("unit", "block")).applyInArrow(_solve(k), "query_id long, vec_id long, score long")
    best = local.distinct().withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_topk(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS a FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
             CAST(list_inner_product(CAST(q.a AS DOUBLE[]), CAST(d.a AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
