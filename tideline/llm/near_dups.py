"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles becomes registers: per bucket the minimum of a hash, stored as its number of leading zeros
and the MANTISSA bits after them (16 bits in all). Every bucket has a hash function of its own instead of a share of one
function's range, so that sets smaller than the number of buckets fill all of them. Bands of ROWS registers are the candidate
keys; candidates pass an estimate of their similarity from the registers, corrected for registers that agree by accident, and
are confirmed on full sets.

Equal sets are one node from the start. Inside a band's bucket every node is first compared with the bucket's hub only, the node
with the most company over all bands (of its hubs the likeliest one); confirmed links join nodes to components. A second such
round takes hubs from each bucket's largest component. Then, in buckets that still hold several components, nodes outside the
largest one meet those of other components. A small bucket gives its pairs as rows, so few that they are linear in its nodes. In a
large one (a crowd that has much in common but is not linked) no pair becomes a row before it is scored: nodes come with a second,
wide sketch of WIDE one-byte minima, blocks of nodes are scored against each other as matrices, and only pairs that the wide sketch does not rule
out, each in the first bucket that it shares, are given on. So a group of n near copies costs about n comparisons, and no pair that
shares a band and could join two components is left out.

A pair at similarity s shares no band with probability (1 - s**ROWS)**BANDS: 3e-6 at 0.8, 2e-8 at 0.85. An estimate falls 0.16
below the truth (five standard deviations at 0.8) with a probability under 1e-6, the wide sketch's 0.0625 alike.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm._common import few, maybe_broadcast, pick, stage, staged_alone, table
from tideline.llm._graph import components

BANDS = 32
ROWS = 5
MANTISSA = 10
MARGIN = 0.16
#: One-byte minima of the wide sketch, and its margin.
WIDE = 1024
WIDE_MARGIN = 0.0625
#: Buckets of more nodes are scored in blocks of so many.
SMALL = 32
BLOCK = 2048
#: Texts that a Python worker holds as words at a time.
TEXTS = 128
#: Below it too many links share no band: at 60 % a pair is missed with a probability of 0.075, at 50 % of 0.36.
LEAST_PERCENT = 60


def _mix(h):
    """splitmix64's last steps."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts, size: int) -> list:
    """Arrow strings -> per text its distinct shingles as sorted 64-bit hashes. Words are runs of other bytes than space and
    U+0009 to U+000D, with A to Z lower-cased; a text of fewer words than `size` is one shingle, one without words has none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    # ascii_lower goes wrong on a slice of another array; take() makes an array of its own
    texts = pc.ascii_lower(pc.cast(pc.fill_null(texts, ""), pa.large_string()).take(pa.array(range(len(texts)), pa.int64())))
    for space in "\t\n\v\f\r":
        texts = pc.replace_substring(texts, space, " ")
    split = pc.split_pattern(texts, " ")
    words, edges = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0]
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    edges = np.concatenate([[0], np.cumsum(full)])[edges]
    coded = pc.dictionary_encode(words.filter(pa.array(full)))
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = of_word[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    n = len(h) - size + 1
    rolled = np.zeros(max(0, n), np.uint64)
    for k in range(size):
        rolled = rolled * factor + h[k : k + n] if n > 0 else rolled
    rolled = _mix(rolled)
    sets = []
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if j - i >= size:
            sets.append(np.unique(rolled[i : j - size + 1]))
        elif j > i:
            one = np.array([j - i], np.uint64)
            for k in range(i, j):
                one = one * factor + h[k]
            sets.append(_mix(one + np.uint64(1)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def _functions(n: int):
    import numpy as np

    seeds = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def registers(sets: list, n: int):
    """Sets of 64-bit hashes -> a matrix of uint16 registers: leading zeros above, MANTISSA bits below."""
    import numpy as np

    a, b = _functions(n)
    least = np.full((len(sets), n), 0xFFFFFFFF, np.uint32)
    for row, hashes in zip(least, sets, strict=True):
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(x), 256):
            y = (x[i : i + 256, None] ^ b) * a
            y ^= y >> np.uint32(16)
            y *= np.uint32(0x85EBCA6B)
            np.minimum(row, y.min(0), out=row)
    zeros = 32 - np.frexp(least.astype(np.float64))[1]
    below = (least.astype(np.uint64) << (zeros + 1).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | (below >> np.uint64(32 - MANTISSA)).astype(np.uint16)


def band_keys(regs):
    import numpy as np

    folded = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), BANDS)).copy()
    banded = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    for k in range(ROWS):
        folded = _mix(folded * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, k])
    return folded.astype(np.int64)


def accidental(sizes_a, sizes_b):
    """Chance that two different minima of sets of these sizes fall into the same register value."""
    import numpy as np

    lead = np.arange(33)[:, None]
    low = np.where(lead < 32, 2.0 ** -(lead + 1.0), 0.0) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
    width = np.where(lead < 32, 2.0 ** -(lead + 1.0) / (1 << MANTISSA), 0.0)
    grid = np.minimum(30, np.ceil(np.log2(np.maximum(1, np.concatenate([sizes_a, sizes_b]))))).astype(int)
    held = {}
    for g in np.unique(grid):
        n = 2.0**g
        held[g] = np.exp(-n * low) - np.exp(-n * (low + width))
    ga, gb = grid[: len(sizes_a)], grid[len(sizes_a) :]
    pairs, where = np.unique(np.stack([ga, gb]), axis=1, return_inverse=True)
    return np.array([float((held[x] * held[y]).sum()) for x, y in pairs.T])[where.ravel()]


def estimated_jaccard(regs_a, regs_b, sizes_a, sizes_b):
    """Share of equal registers, freed of accidental agreement."""
    import numpy as np

    share = (regs_a == regs_b).mean(1)
    c = accidental(sizes_a, sizes_b)
    return np.clip((share - c) / (1 - c), 0, 1)


def _sketch(size: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                sets = shingle_sets(part.column(1), size)
                regs = registers(sets, BANDS * ROWS)
                keys = band_keys(regs)
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                        pa.array([r.tobytes() if f else None for r, f in zip(regs, full, strict=True)], pa.binary()),
                        pa.array([k if f else None for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "digest", "sketch", "keys"],
                )

    return run


def _full_sets(size: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                sets = [s for s in shingle_sets(batch.slice(i, TEXTS).column(0), size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "shingles"])

    return run


def _estimate(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    def matrix(column):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BANDS * ROWS)

    for batch in batches:
        if not batch.num_rows:
            continue
        est = estimated_jaccard(matrix(batch.column(2)), matrix(batch.column(3)), batch.column(4).to_numpy(), batch.column(5).to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(est)], names=["a", "b", "estimate"])


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes whose registers don't rule the threshold out."""
    side = nodes.select("node", "sketch", "n_shingles")
    a = side.toDF("a", "sketch_a", "n_a")
    b = side.toDF("b", "sketch_b", "n_b")
    both = pairs.join(a, "a").join(b, "b").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(_estimate, "a long, b long, estimate double").where(F.col("estimate") >= threshold - MARGIN)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold: 100 * intersection >= percent * union, in whole numbers."""
    a, b = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    both = pairs.select("a", "b").join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(100 * F.col("common") >= percent * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b")


def _best(estimated: DataFrame) -> DataFrame:
    """Of each node's pairs the likeliest."""
    return estimated.groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a")).select("a", "b")


def _mixed(members: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """Members of buckets that hold several components: key, node, weight, component and the bucket's largest component. rows: of documents."""
    known = members.join(found, "node", "left").select("key", "node", "weight", F.coalesce("component", "node").alias("component"))
    known = stage(few(known, rows), "known")
    per = known.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count("*").alias("parts"))
    return stage(few(known.join(per.where("parts > 1").select("key", "most"), "key"), rows), "mixed")


def wide_sketches(sets: list):
    """Sets of 64-bit hashes -> a matrix of WIDE bytes: the low byte of each function's minimum."""
    import numpy as np

    a, b = _functions(WIDE + BANDS * ROWS)
    a, b = a[BANDS * ROWS :], b[BANDS * ROWS :]  # not the functions of the bands
    least = np.full((len(sets), WIDE), 0xFFFFFFFF, np.uint32)
    for row, hashes in zip(least, sets, strict=True):
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(x), 256):
            y = (x[i : i + 256, None] ^ b) * a
            y ^= y >> np.uint32(16)
            y *= np.uint32(0x85EBCA6B)
            np.minimum(row, y.min(0), out=row)
    return least.astype(np.uint8)


def _widened(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            wide = wide_sketches([np.asarray(s.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64) for s in part.column(1)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in wide], pa.binary())], names=["node", "wide"])


def _scored_blocks(threshold: float):
    """Nodes outside a bucket's largest component (x) and any of its nodes (y) -> pairs (a, b) that the wide sketch doesn't rule out."""

    def run(x, y):
        import numpy as np
        import pyarrow as pa

        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if x.num_rows and y.num_rows:
            band = x["band"][0].as_py()
            node_x, node_y = x["node"].to_numpy(), y["node"].to_numpy()
            part_x, part_y = x["component"].to_numpy(), y["component"].to_numpy()
            n_x, n_y = x["n"].to_numpy(), y["n"].to_numpy()
            wide_x, wide_y = (np.frombuffer(b"".join(t["wide"].to_pylist()), np.uint8).reshape(t.num_rows, WIDE) for t in (x, y))
            keys_x, keys_y = (t["keys"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, BANDS) for t in (x, y))
            columns = np.ascontiguousarray(wide_y.T)
            first, bound = BANDS * ROWS, 1 / 256
            least = (threshold - MARGIN) * (1 - bound) + bound
            for i in range(0, len(node_x), 128):
                some = slice(i, i + 128)
                same = np.zeros((len(node_x[some]), len(node_y)), np.uint8)
                for k in range(first):  # the first BANDS * ROWS bytes rule most pairs out
                    same += wide_x[some, k, None] == columns[k]
                fits = np.minimum(n_x[some, None], n_y) >= threshold * np.maximum(n_x[some, None], n_y)
                apart = (part_x[some, None] != part_y) & ((part_y == y["most"][0].as_py()) | (node_x[some, None] < node_y))
                row, col = np.nonzero((same >= least * first) & fits & apart)
                for j in range(0, len(row), 8192):
                    r, c = row[j : j + 8192] + i, col[j : j + 8192]
                    share = ((wide_x[r] == wide_y[c]).mean(1) - bound) / (1 - bound)
                    r, c = r[share >= threshold - WIDE_MARGIN], c[share >= threshold - WIDE_MARGIN]
                    own = (keys_x[r] == keys_y[c]).argmax(1) == band  # the first bucket they share
                    a.append(node_x[r[own]])
                    b.append(node_y[c[own]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _across(mixed: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, rows: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share a bucket and may reach the threshold. rows: of documents."""
    sizes = mixed.groupBy("key").agg(F.count("*").alias("size"))
    sized = mixed.join(sizes, "key")
    small = sized.where(F.col("size") <= SMALL)
    x = small.where("component <> most").select("key", "most", F.col("node").alias("x"), F.col("component").alias("cx"))
    y = small.select("key", F.col("node").alias("y"), F.col("component").alias("cy"))
    met = x.join(y, "key").where("cx <> cy AND (cy = most OR x < y)")
    paired = _estimated(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), nodes, threshold).select("a", "b")

    crowded = stage(few(sized.where(F.col("size") > SMALL), rows), "crowded")
    if crowded.isEmpty():
        return paired
    wanted = crowded.select("node").distinct()
    wide = stage(few(sets.join(wanted, "node").select("node", "shingles").mapInArrow(_widened, "node long, wide binary"), rows), "wide")
    about = wide.join(nodes.select("node", "keys", F.col("n_shingles").alias("n")), "node")
    dealt = crowded.select("key", "most", "node", "component", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")).join(about, "node")
    dealt = dealt.withColumns({"own": F.pmod(F.xxhash64("node"), "blocks").cast("int"), "band": (F.array_position("keys", F.col("key")) - 1).cast("int")})
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ["key", "most", "node", "component", "n", "wide", "keys", "band"]
    x = dealt.where("component <> most").select(*columns, F.col("own").alias("xb"), every.alias("yb")).toDF(*columns, "xb", "yb")
    y = dealt.select(*columns, every.alias("xb"), F.col("own").alias("yb")).toDF(*columns, "xb", "yb")
    by = ["key", "xb", "yb"]
    return paired.union(x.groupBy(*by).cogroup(y.groupBy(*by)).applyInArrow(_scored_blocks(threshold), "a long, b long"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of `shingle`-word shingles; component_id is
    the smallest doc_id reachable over links, kept says whether that is the document itself. Null and empty texts and texts
    without words have an empty set and are linked with nothing. Repeated rows stay rows; a null doc_id is never the smallest
    one, and a component of null ids only has a null component_id (kept is then true). Other columns are ignored. The result is
    a staged table. percent is LEAST_PERCENT at least, as with less the bands would miss too many links.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent must be {LEAST_PERCENT} or more")
    return staged_alone(lambda: _grouped(docs, id_col, text_col, shingle, percent), "groups")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    threshold = percent / 100
    source = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    sketched = stage(source.mapInArrow(_sketch(shingle), "doc_id long, n_shingles long, digest binary, sketch binary, keys array<long>"), "sketches")
    rows = sketched.count()
    some = sketched.where("digest IS NOT NULL")
    grouped = some.groupBy("digest").agg(F.min("doc_id").alias("label"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    nodes = stage(few(grouped.withColumn("node", F.monotonically_increasing_id()), rows), "nodes")

    member = nodes.select("node", F.explode("keys").alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stage(few(member.join(shared, "key"), rows), "buckets")
    popular = members.groupBy("node").agg(F.sum("size").alias("weight"))
    members = stage(few(members.select("key", "node").join(popular, "node"), rows), "buckets")
    in_buckets = stage(few(popular.select("node").join(nodes.select("node", "digest", "label"), "node"), rows), "members")
    wanted = maybe_broadcast(in_buckets.select(F.col("label").alias("doc_id")).distinct(), in_buckets.count(), 16)
    texts = source.join(wanted, "doc_id").select("text").union(source.where("doc_id IS NULL").select("text"))
    made = texts.mapInArrow(_full_sets(shingle), "digest binary, shingles array<long>")
    sets = stage(few(made.join(in_buckets.select("digest", "node"), "digest").select("node", "shingles").dropDuplicates(["node"]), rows), "sets")

    heaviest = F.max_by("node", F.struct("weight", "node"))
    hubs = members.groupBy("key").agg(heaviest.alias("hub"))
    stars = members.select("key", "node").join(hubs, "key").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = stage(few(_confirmed(_best(_estimated(stars, nodes, threshold)), sets, percent), rows), "links")
    found = components(links)

    mixed = _mixed(members, found, rows)
    hubs = mixed.where("component = most").groupBy("key").agg(heaviest.alias("hub"))
    again = mixed.where("component <> most").join(hubs, "key").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    more = stage(few(_confirmed(_best(_estimated(again, nodes, threshold)), sets, percent), rows), "links")
    if not more.isEmpty():
        found = components(found.toDF("a", "b").union(more))
        mixed = _mixed(members, found, rows)

    more = stage(few(_confirmed(_across(mixed, nodes, sets, threshold, rows), sets, percent), rows), "links")
    if not more.isEmpty():
        found = components(found.toDF("a", "b").union(more))

    joined = found.join(nodes.select("node", "label"), "node")
    smallest = joined.groupBy("component").agg(F.min("label").alias("least"))
    moved = joined.join(smallest, "component").select("node", "least")
    names = nodes.select("node", "digest", "label").join(moved, "node", "left").select("digest", F.coalesce("least", "label").alias("component_id"))
    with_set = some.select("doc_id", "n_shingles", "digest").join(names, "digest").select("doc_id", "n_shingles", "component_id")
    without = sketched.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return few(with_set.union(without).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), rows)


def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
