"""Exact k-means by Yinyang grouping.

Vectors become integers (floor(scale * x)), so distances, sums and floors of means are exact and no order of addition matters.
The centroids are put into groups once. Every vector keeps an upper bound of the distance to its centroid and one lower bound a
group of the distance to the group's other centroids; both move by as much as centroids moved. A round leaves a vector alone if
its upper bound lies under all lower bounds (global filter, again with the exact distance), else it scans only the groups whose
lower bound does not rule them out, exactly. Bounds are rounded outwards and ties never pass a filter, so that the result is that
of comparing all centroids, ties to the smaller number.

Vectors and bounds are one narrow table, rewritten each round and dealt to nothing: a round is a scan, and what is shuffled is one
row of sums a task and cluster. The table of a round is written to the shared folder, so a lost executor costs one round's tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm._common import drop_stage, maybe_broadcast, pick, stage, table

#: Centroids of a group, on average.
GROUP = 10
#: Components of all centroids together at most: they go to every task.
MAX_CENTROID_COMPONENTS = 1 << 24
#: Outward rounding of bounds.
SLACK = 1e-12

STATE = "id long, vec binary, cluster int, upper double, lower binary, scanned long"


def squared_distances(x, c, largest: int):
    """Rows x centroids, exact; largest: bound of all components' absolute values."""
    import numpy as np

    kind = np.float64 if 4 * x.shape[1] * largest**2 < 2**53 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def group_centroids(centroids, n: int):
    """The group number of each centroid: a few rounds of Lloyd's algorithm over the centroids, from a fixed start."""
    import numpy as np

    c = centroids.astype(np.float64)
    heads = c[np.linspace(0, len(c) - 1, n).astype(int)]
    for _ in range(5):
        near = ((heads * heads).sum(1)[None, :] - 2 * (c @ heads.T)).argmin(1)
        heads = np.stack([c[near == g].mean(0) if (near == g).any() else heads[g] for g in range(n)])
    return np.unique(near, return_inverse=True)[1]


def _outward(squared, up: bool):
    import numpy as np

    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK if up else 1 - SLACK)


class Round:
    """One assignment of vectors to centroids."""

    def __init__(self, centroids, groups, largest: int, before=None):
        """before: the centroids that the vectors' bounds refer to."""
        import numpy as np

        self.centroids, self.groups, self.largest = centroids, groups, largest
        self.members = [np.flatnonzero(groups == g) for g in range(int(groups.max()) + 1)]
        if before is not None:
            moved = ((centroids.astype(object) - before.astype(object)) ** 2).sum(1).astype(np.float64)
            self.moved = np.sqrt(moved) * (1 + 2 * SLACK)
            self.most = np.array([self.moved[m].max() for m in self.members])

    def first(self, x):
        """cluster, upper, lower and the number of distances, from all centroids."""
        import numpy as np

        d = squared_distances(x, self.centroids, self.largest)
        own = d.argmin(1)
        rows = np.arange(len(x))
        upper = _outward(d[rows, own], True)
        d = d.astype(np.float64)
        d[rows, own] = np.inf
        lower = np.stack([_outward(d[:, m].min(1), False) for m in self.members], 1)
        return own, upper, lower, np.full(len(x), len(self.centroids), np.int64)

    def next(self, x, own, upper, lower):
        """The same from the bounds of the round before."""
        import numpy as np

        own, scanned = own.copy(), np.zeros(len(x), np.int64)
        upper = (upper + self.moved[own]) * (1 + SLACK)
        lower = np.maximum(0, lower - self.most[None, :]) * (1 - SLACK)
        open_ = np.flatnonzero(upper >= lower.min(1))
        if not len(open_):
            return own, upper, lower, scanned
        mine = np.zeros(len(open_), np.int64)  # exact distances to the present centroid
        for c in np.unique(own[open_]):
            at = own[open_] == c
            mine[at] = squared_distances(x[open_[at]], self.centroids[c : c + 1], self.largest)[:, 0].astype(np.int64)
        upper[open_] = _outward(mine, True)
        scanned[open_] += 1
        still = upper[open_] >= lower[open_].min(1)
        rows, mine = open_[still], mine[still]
        if not len(rows):
            return own, upper, lower, scanned
        wanted = upper[rows][:, None] >= lower[rows]
        d = np.full((len(rows), len(self.centroids)), np.iinfo(np.int64).max, np.int64)
        for g, members in enumerate(self.members):
            at = np.flatnonzero(wanted[:, g])
            if len(at):
                d[at[:, None], members[None, :]] = squared_distances(x[rows[at]], self.centroids[members], self.largest).astype(np.int64)
                scanned[rows[at]] += len(members)
        i, old = np.arange(len(rows)), own[rows]
        d[i, old] = mine
        new = d.argmin(1)
        own[rows], upper[rows] = new, _outward(d[i, new], True)
        rest = d.astype(np.float64)
        rest[d == np.iinfo(np.int64).max] = np.inf
        rest[i, new] = np.inf
        for g, members in enumerate(self.members):
            least = _outward(rest[:, members].min(1), False)
            # a group that was not scanned has its bound still, but for a centroid that the vector has just left
            lower[rows, g] = np.where(wanted[:, g], least, np.minimum(lower[rows, g], least))
        return own, upper, lower, scanned


def _rows(column, kind, dims: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dims)


def _state(ids, vec, own, upper, lower, scanned):
    import numpy as np
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([ids, vec, pa.array(own.astype(np.int32)), pa.array(upper), pa.array([r.tobytes() for r in lower], pa.binary()), pa.array(scanned)], names=["id", "vec", "cluster", "upper", "lower", "scanned"])


def _first(by: Round, kind: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.int64).reshape(batch.num_rows, -1)
                yield _state(batch.column(0), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), *by.first(x))

    return run


def _next(by: Round, kind: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(1), kind, by.centroids.shape[1]).astype(np.int64)
                own, upper = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                own, upper, lower, scanned = by.next(x, own.astype(np.int64), upper, _rows(batch.column(4), "<f8", len(by.members)))
                yield _state(batch.column(0), batch.column(1), own, upper, lower, scanned + batch.column(5).to_numpy())

    return run


def _sums(kind: str, k: int, dims: int):
    """Per cluster of the task's vectors their number and componentwise sum."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                own = batch.column(1).to_numpy()
                order = np.argsort(own, kind="stable")
                present, starts = np.unique(own[order], return_index=True)
                sums[present] += np.add.reduceat(_rows(batch.column(0), kind, dims).astype(np.int64)[order], starts, axis=0)
                n += np.bincount(own, minlength=k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _distance(by: Round, kind: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, own = _rows(batch.column(1), kind, by.centroids.shape[1]).astype(np.int64), batch.column(2).to_numpy()
                d = np.zeros(len(x), np.int64)
                for c in np.unique(own):
                    d[own == c] = squared_distances(x[own == c], by.centroids[c : c + 1], by.largest)[:, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d), batch.column(3)], names=["vec_id", "cluster", "distance", "scanned"])

    return run


def cluster_vectors(
    vectors: DataFrame, *, k: int, rounds: int, dims: int, seeds: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, group: int = GROUP
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, scanned) of every vector that takes part, and the final centroids.

    Vectors of exactly `dims` components, none of them null, NaN or infinite, take part; others have no row. The k vectors of
    smallest `seeds` (an expression over the column `id`; ties by id, then by components, nulls last) are the first centroids; with fewer
    vectors there are as many centroids as vectors. `rounds` times vectors go to the nearest centroid and centroids to the floor of their vectors'
    mean (an empty one stays), then vectors are assigned once more. Ties go to the smaller number. Repeated rows and null ids are
    rows as others. distance is squared, scanned counts the distances that the vector cost. Empty input: no rows, no centroids.
    Components so large that a squared distance could pass 2**63 raise an error. Only seeds, sums and centroids (k rows each) reach
    the driver.
    """
    import numpy as np

    spark = vectors.sparkSession
    if k * dims > MAX_CENTROID_COMPONENTS:
        raise ValueError(f"k * dims may be {MAX_CENTROID_COMPONENTS} at most")
    base = pick(vectors, id_col, vec_col).toDF("id", "vec").where((F.size("vec") == dims) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    whole = base.select(F.col("id").cast("long").alias("id"), F.transform("vec", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("vec"))
    least, most = whole.agg(F.min(F.array_min("vec")), F.max(F.array_max("vec"))).collect()[0]
    schema = "vec_id long, cluster int, distance long, scanned long"
    if least is None:
        return spark.createDataFrame([], schema), []
    largest = max(-least, most)
    if 4 * dims * largest**2 >= 2**63:
        raise ValueError(f"a component of {largest} makes squared distances pass 2**63; take a smaller scale")
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
    drawn = whole.orderBy(seeds.asc_nulls_last(), F.col("id").asc_nulls_last(), "vec").limit(k).collect()
    centroids = np.array([r.vec for r in drawn], np.int64)
    groups = group_centroids(centroids, max(1, len(centroids) // group))
    by = Round(centroids, groups, largest)
    state = stage(whole.mapInArrow(_first(by, kind), STATE), "assigned")
    for _ in range(rounds):
        partial = state.select("vec", "cluster").mapInArrow(_sums(kind, len(centroids), dims), "cluster int, n long, sums array<long>")
        means = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dims)]).collect()
        before, centroids = centroids, centroids.copy()
        for r in means:
            centroids[r.cluster] = [s // r.n for s in r[2:]]
        by = Round(centroids, groups, largest, before)
        old, state = state, stage(state.mapInArrow(_next(by, kind), STATE), "assigned")
        drop_stage(old)
    result = stage(state.select("id", "vec", "cluster", "scanned").mapInArrow(_distance(by, kind), schema), "clusters")
    drop_stage(state)
    return result, centroids.tolist()


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    seeds = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)
    found, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, seeds=seeds)
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a cluster
    whole = sum(r.cluster_inertia for r in per)
    held = {r.cluster: r.cluster_inertia for r in per}
    about = spark.createDataFrame([(c, held[c], whole, d) for c, d in digests if c in held], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(maybe_broadcast(about, len(digests), 128), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5) -> str:
    def assign(i: int) -> str:
        near = f"min(struct_pack(d := CAST(list_inner_product(v.a, v.a) + list_inner_product(c.a, c.a) - 2 * list_inner_product(v.a, c.a) AS BIGINT), c := c.c))"
        return f"n{i} AS MATERIALIZED (SELECT v.i, {near} AS m FROM v, c{i} c GROUP BY v.i)"

    def move(i: int) -> str:
        mean = "(s - ((s % n) + n) % n) // n"
        return f"""s{i} AS MATERIALIZED (SELECT c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(v.a) AS x, generate_subscripts(v.a, 1) AS p FROM n{i} JOIN v USING (i)) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(z.a, c.a) AS a FROM c{i} c LEFT JOIN (SELECT c, list(CAST({mean} AS DOUBLE) ORDER BY p) AS a FROM s{i} GROUP BY c) z USING (c))"""

    steps = ",\n".join(f"{assign(i)},\n{move(i)}" for i in range(rounds))
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS a FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id) - 1 AS c, a FROM v ORDER BY c LIMIT {k}),
{steps},
{assign(rounds)},
d AS (SELECT c, sha256(array_to_string(list_transform(a, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS h FROM c{rounds})
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM n{rounds} JOIN v USING (i) JOIN d ON d.c = m.c"""


SQL = _sql()
