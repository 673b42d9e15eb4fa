"""Packing documents into sequences of bounded length, by best fit and a swap-based local search.

Pieces of one length are alike, so a packing is a list of bin kinds (which lengths, how often) with the number of bins of each.
Only the number of pieces of each length, `capacity` counters at most, reaches the driver, whatever the size of the corpus. There
best fit in descending order gives a first packing, and the local search exchanges documents between underfull bins, one for one,
two for one, one for two, or moves one, always so that the sum of squared fills grows, until bins run empty; an exchange
acts on all bins of the two kinds at once. It ends where no exchange helps, or where a lower bound shows that no packing is smaller.

Pieces then find their places by rank: a piece's number among those of its length and task is stored with it, the tasks' counts
are added up per length, and the plan says which ranks of a length lie in which bins. So no bin, length or task is gathered.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm._common import pick, stage, table, tokenizer_path

CAPACITY = 2048
END_ID = 0
#: Pairs of bin kinds that the local search looks at before it settles for what it has.
EFFORT = 400_000

Kind = tuple[tuple[int, int], ...]  # (length, how often), longest first


def fill(kind: Kind) -> int:
    return sum(length * q for length, q in kind)


def lower_bound(counts: Mapping[int, int], capacity: int) -> int:
    """No packing has fewer bins: for every t, pieces over capacity - t have bins of their own, and the rest of at least t share what
    bins of pieces over half leave, or open more."""
    n, total = [0] * (capacity + 2), [0] * (capacity + 2)
    for length in range(capacity, 0, -1):
        c = counts.get(length, 0)
        n[length], total[length] = n[length + 1] + c, total[length + 1] + c * length
    half = capacity // 2 + 1
    best = -(-total[1] // capacity)
    for t in range(1, capacity // 2 + 1):
        huge = n[capacity - t + 1]
        large, mid = n[half] - huge, total[t] - total[half]
        room = large * capacity - (total[half] - total[capacity - t + 1])
        best = max(best, huge + large + max(0, -(-(mid - room) // capacity)))
    return best


def best_fit(counts: Mapping[int, int], capacity: int) -> Counter[Kind]:
    """Best fit decreasing: the longest pieces first, each into the fullest bin that has room."""
    by_room: dict[int, Counter[Kind]] = defaultdict(Counter)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in range(length, capacity):
            kinds = by_room.get(room)
            while left and kinds:
                kind, n = kinds.popitem()
                q = min(room // length, left)
                m = min(n, left // q)
                if m < n:
                    kinds[kind] += n - m
                by_room[room - q * length][kind + ((length, q),)] += m
                left -= m * q
            if not left:
                break
        q = capacity // length
        if left >= q:
            by_room[capacity - q * length][((length, q),)] += left // q
        if left % q:
            by_room[capacity - left % q * length][((length, left % q),)] += 1
    out: Counter[Kind] = Counter()
    for kinds in by_room.values():
        out.update(kinds)
    return out


def _changed(kind: Kind, out: tuple[int, ...], into: tuple[int, ...]) -> Kind:
    held = Counter(dict(kind))
    held.subtract(out)
    held.update(into)
    return tuple(sorted(((k, v) for k, v in held.items() if v), reverse=True))


def _offers(kind: Kind) -> list[tuple[int, tuple[int, ...]]]:
    """What one and two of the bin's pieces add up to, shortest first."""
    lengths = [k for k, _ in kind]
    pairs = [(a + b, (a, b)) for i, a in enumerate(lengths) for b in lengths[i + 1 :]] + [(2 * a, (a, a)) for a, q in kind if q > 1]
    return sorted([(a, (a,)) for a in lengths] + pairs)


def _exchange(give: list, take: list, room: int, full: int) -> tuple[int, tuple, tuple] | None:
    """The largest net transfer of at most `room` and under `full` from the emptier bin: what it gives and what it gets."""
    best = None
    sums = [s for s, _ in give]
    for back, got in [(0, ()), *take]:
        at = bisect_right(sums, back + room) - 1
        while at >= 0 and sums[at] > back:
            if len(give[at][1]) + len(got) <= 3:
                net = sums[at] - back
                if (len(give[at][1]) < 2 or got) and (best is None or net > best[0]):
                    best = (net, give[at][1], got)
                    break
            at -= 1
        if best and best[0] == room:
            return best
    return best


def local_search(bins: Counter[Kind], capacity: int, bound: int, effort: int = EFFORT) -> Counter[Kind]:
    """Empties bins by exchanges between underfull ones, emptiest first, as long as the sum of squared fills grows by it."""
    bins = Counter(bins)
    total, looked = sum(bins.values()), 0
    offers: dict[Kind, list] = {}

    def of(kind: Kind) -> list:
        if kind not in offers:
            offers[kind] = _offers(kind)
        return offers[kind]

    stuck: set[Kind] = set()
    while total > bound and looked < effort:
        under = sorted((fill(k), k) for k in bins if fill(k) < capacity)
        donor = next((k for _, k in under if k not in stuck), None)
        if donor is None:
            break
        low, found = fill(donor), None
        for full, other in reversed(under):  # the fullest bins first: what fills one of them up gains most
            if full < low:
                break
            if other == donor and bins[donor] < 2:
                continue
            looked += 1
            made = _exchange(of(donor), of(other), capacity - full, low)
            if made and made[0] > low - full and (found is None or made[0] * (full - low + made[0]) > found[0]):
                found = (made[0] * (full - low + made[0]), other, made)
                if made[0] == capacity - full:
                    break
        if found is None:
            stuck.add(donor)
            continue
        _, other, (net, given, got) = found
        m = bins[donor] // 2 if other == donor else min(bins[donor], bins[other])
        for kind in (donor, other):
            bins[kind] -= m
            if not bins[kind]:
                del bins[kind]
        for kind in (_changed(donor, given, got), _changed(other, got, given)):
            if kind:
                bins[kind] += m
            else:
                total -= m
        stuck.clear()
    return bins


@dataclass
class Plan:
    """Which ranks of a length lie where: from the rank `first` on, `each` pieces a bin, in bins from `sequence`, from `offset` on."""

    capacity: int
    length: list[int]
    first: list[int]
    each: list[int]
    sequence: list[int]
    offset: list[int]
    n_sequences: int


def plan_packing(counts: Mapping[int, int], capacity: int, effort: int = EFFORT) -> Plan:
    bins = local_search(best_fit(counts, capacity), capacity, lower_bound(counts, capacity), effort)
    plan, placed, at = Plan(capacity, [], [], [], [], [], 0), Counter(), 0
    for kind, n in bins.items():
        offset = 0
        for length, q in kind:
            for name, value in (("length", length), ("first", placed[length]), ("each", q), ("sequence", at), ("offset", offset)):
                getattr(plan, name).append(value)
            placed[length] += q * n
            offset += q * length
        at += n
    plan.n_sequences = at
    return plan


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from tideline.llm.token_files import _codes

        codes = _codes(path)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        width = 4 * capacity
        names = ["doc_id", "piece", "start", "length", "ids", "task", "nth"]
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                rows = batch.slice(begin, 64)
                at, piece, ids = [], [], []
                for i, text in enumerate(rows.column(1).to_pylist()):
                    coded = np.frombuffer(codes.encode(text or ""), codes.dtype).astype("<u4").tobytes() + end
                    parts = [coded[j : j + width] for j in range(0, len(coded), width)]
                    at += [i] * len(parts)
                    piece += range(len(parts))
                    ids += parts
                length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                nth = np.empty(len(ids), np.int64)
                for j, n in enumerate(length.tolist()):
                    nth[j] = seen[n]
                    seen[n] += 1
                piece = np.array(piece, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(at, pa.int64())), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), task, np.int32)), pa.array(nth)], names=names
                )

    return run


def cut_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece (from 0), start, length, ids (little-endian 32-bit, binary), and task and nth, which tell pieces of one length
    apart. A staged table, so that these two stay as they are.

    Every document's ids and end_id after them are cut into pieces of `capacity` ids; its last piece may be shorter. Null texts count as empty
    (end_id alone). Null ids and repeated rows are documents as others; other columns are ignored. Empty table: no rows.
    """
    file = tokenizer or tokenizer_path("word_bpe_49k.json")
    source = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return stage(source.mapInArrow(_cut(file, capacity, end_id), "doc_id long, piece int, start long, length long, ids binary, task int, nth long"), "pieces")


def _places(plan: Plan):
    import numpy as np

    order = sorted(range(len(plan.length)), key=lambda i: (plan.length[i], plan.first[i]))
    length, first, each, sequence, offset = (np.array([getattr(plan, n)[i] for i in order], np.int64) for n in ("length", "first", "each", "sequence", "offset"))
    key = length << 44 | first

    @F.pandas_udf("sequence_id long, offset long")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, rank = n.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(key, n << 44 | rank, side="right") - 1
        within = rank - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + within // each[at], "offset": offset[at] + within % each[at] * n})

    return place


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, effort: int = EFFORT) -> DataFrame:
    """pieces (length, task, nth and any other columns; a stored table) with sequence_id (from 0) and offset in place of task and nth.

    Sequences are as few as the search finds, hold `capacity` tokens at most, and are gapless from offset 0. Pieces of equal length
    change places freely. No pieces: no rows.
    """
    if capacity >= 1 << 19:
        raise ValueError("capacity must be under 2**19")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("task", "length", before.alias("before"))  # a row a task and length
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    plan = plan_packing(totals, capacity, effort)
    ranked = pieces.join(starts, ["task", "length"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before")
    placed = ranked.withColumn("_at", _places(plan)("length", "nth"))
    return placed.select(*[c for c in pieces.columns if c not in ("task", "nth")], "_at.sequence_id", "_at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary), doc_ids and starts (offsets of the pieces, in order): the packed sequences themselves, each a group of
    bounded size."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    held = packed.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return held.select("sequence_id", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut_pieces(table(spark, sf_dir, "documents"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "nth")
    return pack(digests).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
