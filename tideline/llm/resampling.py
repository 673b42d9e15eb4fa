"""Importance resampling towards a target text collection, with n-grams counted by suffix arrays.

A document's features are its runs of 1 to n consecutive words, hashed to buckets. A task holds the words of many texts as numbers;
their suffixes are sorted by their first n words (a suffix array), common beginnings of neighbours (LCP) then part the sorted suffixes into runs, one a
distinct n-gram. Each run is hashed once and its bucket goes to all places where the n-gram stands.

Buckets of both collections give each bucket's gain, the log ratio of its smoothed shares; a document's weight is the mean gain of
its features. Gumbel noise from a hash of the id makes the highest scores a sample without replacement, in proportion to the
weights' exponentials. Texts are read once: the places' buckets are staged, packed, and scored from there. The draw is a rank over
ranges of the score's order, so no task sees all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm._common import drop_stage, pick, stage, table
from tideline.operators.ranks import global_rank

BUCKETS = 10_000
#: Bytes of text whose words meet in one suffix array; a longer text has one to itself.
CHUNK_BYTES = 8 << 20
#: A-Z become a-z, other characters below U+0080 that are no word characters become blanks; bytes of later characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def suffix_array(words, depth: int):
    """Places in the order of their suffixes' first `depth` entries, and the LCP of neighbours in it, cut at `depth`.

    Doubling: ranks by 1, 2, 4, ... entries, each from those of half the length. Entries below 0 (ends of texts) equal nothing.
    """
    import numpy as np

    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = words < 0
    key = words.astype(np.int64)
    key[ends] = -1 - np.arange(int(ends.sum()))  # every end is an entry of its own
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < depth:
        ahead = np.full(n, -1, np.int64)
        ahead[:-length] = rank[length:] if length < n else ahead[:-length]
        rank = np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        length *= 2
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    same = np.ones(n - 1, bool)
    for k in range(depth):
        a, b = order[:-1] + k, order[1:] + k
        inside = same & (a < n) & (b < n)
        same = inside.copy()
        same[inside] = key[a[inside]] == key[b[inside]]
        lcp[1:] += same
    return order, lcp


def split_words(texts) -> tuple:
    """Binary Arrow array -> number of each word, in the order of the texts; edges of the texts; the distinct words."""
    import numpy as np
    import pyarrow as pa

    coded, edges = [], np.zeros(len(texts) + 1, np.int64)
    known: dict[bytes, int] = {}
    for i, text in enumerate(texts.to_pylist()):
        words = (text or b"").translate(_FOLD).split()
        coded += words
        edges[i + 1] = len(coded)
    if not coded:
        return np.empty(0, np.int64), edges, []
    coded = pa.array(coded, pa.large_binary()).dictionary_encode()
    known = coded.dictionary.to_pylist()
    return coded.indices.to_numpy().astype(np.int64), edges, known


def gram_buckets(texts, most: int, buckets: int) -> tuple:
    """Binary Arrow array -> bucket of each feature, text by text (first single words, then pairs, ...), their edges, word counts."""
    import numpy as np

    words, edges, known = split_words(texts)
    n_words = np.diff(edges)
    at = np.arange(len(words)) + np.repeat(np.arange(len(n_words)), n_words)  # with one end after each text
    held = np.full(len(words) + len(n_words), -1, np.int64)
    held[at] = words
    order, lcp = suffix_array(held, most)
    made = np.empty((most, len(held)), np.int64)
    made.fill(-1)
    for n in range(1, most + 1):
        heads = np.flatnonzero(lcp < n)  # each begins a run of suffixes with the same first n entries
        first = order[heads]
        grams = [held[first + k] if k == 0 else np.where(first + k < len(held), held[np.minimum(first + k, len(held) - 1)], -1) for k in range(n)]
        whole = np.all(np.stack(grams) >= 0, axis=0) if len(first) else np.empty(0, bool)
        of_run = np.full(len(first), -1, np.int64)
        of_run[whole] = [zlib.crc32(b" ".join([known[w] for w in gram])) % buckets for gram in zip(*[g[whole].tolist() for g in grams], strict=True)]
        made[n - 1, order] = np.repeat(of_run, np.diff(np.append(heads, len(order))))
    counts = np.stack([np.maximum(n_words - n, 0) for n in range(most)]).sum(0)
    ends = np.concatenate([[0], np.cumsum(n_words + 1)])
    if most == 1:
        return made[0, at], np.concatenate([[0], np.cumsum(counts)]), n_words
    parts = [row[row >= 0] for i, j in zip(ends[:-1], ends[1:], strict=True) for row in (made[:, i:j],)]
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return flat, np.concatenate([[0], np.cumsum(counts)]), n_words


def _chunks(batches: Iterator) -> Iterator:
    """Batches joined up to CHUNK_BYTES."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bucketed(most: int, buckets: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = "<u2" if buckets <= 1 << 16 else "<u4"
        for rows in _chunks(batches):
            texts = rows.column(1).cast(pa.binary()).combine_chunks()
            flat, edges, n_words = gram_buckets(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, most, buckets)
            flat = flat.astype(kind)
            packed = pa.array([flat[i:j].tobytes() for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())
            out = pa.table([rows.column(0), pa.array(n_words), packed], names=["doc_id", "n_words", "buckets"])
            yield from out.to_batches(max_chunksize=256)

    return run


def bucketed(docs: DataFrame, *, id_col: str, text_col: str, most: int, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words and the packed buckets of the features of every whole text; null texts have none."""
    source = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(_bucketed(most, buckets), "doc_id long, n_words long, buckets binary")


def _counted(buckets: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kind = "<u2" if buckets <= 1 << 16 else "<u4"
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                n += np.bincount(np.frombuffer(packed.as_buffer(), kind), minlength=buckets) if len(packed.as_buffer()) > 2 * buckets else 0
            small = b"".join([p for p in batch.column(0).to_pylist() if len(p) <= 2 * buckets])
            n += np.bincount(np.frombuffer(small, kind), minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], names=["bucket", "n"])

    return run


def bucket_counts(made: DataFrame, buckets: int) -> dict[int, int]:
    """How often each bucket occurs; `buckets` rows at most reach the driver."""
    rows = made.select("buckets").mapInArrow(_counted(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    return {r.bucket: r.n for r in rows}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the source."""
    from math import floor, log

    s, t = sum(source.values()), sum(target.values())
    return [floor(1000 * log(float((target.get(b, 0) + 1) * (s + buckets)) / float((source.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)]


def _weighed(gain: list[int], buckets: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kind = "<u2" if buckets <= 1 << 16 else "<u4"
        size, of = int(kind[2]), np.array(gain, np.int64)
        for batch in batches:
            n = np.array([len(p) // size for p in batch.column(2).to_pylist()], np.int64)
            sums = np.array([int(of[np.frombuffer(p, kind)].sum()) for p in batch.column(2).to_pylist()], np.int64)
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def resampled(
    docs: DataFrame, target: DataFrame, *, share: int, least_words: int = 20, most: int = 1, buckets: int = BUCKETS, salt: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document: its importance for the target, the noisy score, and its
    place in the draw of `share` percent of the documents of least_words words or more; undrawn documents have no rank.

    Words are runs of digits, letters a to z (A to Z lower-cased) and characters from U+0080 on. Null and empty texts have no
    features and weight 0. Ties go to the smaller doc_id, null ids last; a null id counts as empty text in the noise. Repeated rows
    are documents as others. Other columns are ignored. Empty tables: no rows, or, as target, no target counts.
    """
    made = stage(bucketed(docs, id_col=id_col, text_col=text_col, most=most, buckets=buckets), "buckets")
    wanted = bucketed(target, id_col=target_id, text_col=target_text, most=most, buckets=buckets)
    gain = gains(bucket_counts(made, buckets), bucket_counts(wanted, buckets), buckets)
    weighed = made.mapInArrow(_weighed(gain, buckets), "doc_id long, n_words long, n_features long, weight long")
    scored = stage(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), salt)), "scored")
    drop_stage(made)
    fit = scored.where(F.col("n_words") >= least_words).withColumn("row", F.monotonically_increasing_id())
    ranked = global_rank(fit, [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")])
    drawn = F.when(F.col("rank") <= F.floor(F.lit(share) * F.col("n_rows") / 100), F.col("rank"))
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words)
    return ranked.select(*names, drawn.alias("rank")).unionAll(rest.select(*names, F.lit(None).cast("long").alias("rank")))


def noise(doc_id: Column, salt: str) -> Column:
    """Gumbel noise in thousandths, from a hash of salt and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=10)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_POLY = 0xEDB88320
SQL = f"""
WITH crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, {_POLY}) ELSE a >> 1 END) AS v FROM range(256) r(i))),
w AS MATERIALIZED (SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
o AS MATERIALIZED (SELECT side, id, unnest(ws) AS word FROM w),
d AS (SELECT DISTINCT word FROM o),
x AS (SELECT word, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(hex(encode(word))) // 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', hex(encode(word))[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', hex(encode(word))[2 * i + 2]) - 1 AS BIGINT))) AS b FROM d),
k AS MATERIALIZED (SELECT word, xor(list_reduce(b, lambda c, y: xor(c >> 8, crc.t[CAST(xor(c & 255, y) AS BIGINT) + 1])), 4294967295) % {BUCKETS} AS bucket FROM x, crc),
n AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM o JOIN k USING (word) GROUP BY 1),
u AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM n),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + {BUCKETS}) AS DOUBLE) / CAST((s + 1) * (t_all + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain FROM n, u),
m AS (SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM o JOIN k USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY 1),
p AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN m ON m.id = doc_id),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM p),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT z.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(CASE WHEN place <= 10 * n // 100 THEN place END AS BIGINT) AS rank FROM z LEFT JOIN r ON r.doc_id = z.doc_id
"""
