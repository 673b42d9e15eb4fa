"""Token counts without token ids.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum over its pre-tokens. Every distinct
pre-token is encoded once; its number of pieces is joined to the documents that hold it.

Plan: (1) a scan cuts documents into chunks and inverts each chunk: pre-token -> the chunk's documents that hold it (16-bit
positions, repeated as often as the word occurs). Pre-tokens that are themselves vocabulary entries are summed on the spot from
a table whose size the vocabulary bounds, so the hottest words never reach a shuffle. A chunk's other pre-tokens are packed
into one compressed row per hash bucket. (2) A shuffle by bucket brings all occurrences of a pre-token to one task, which encodes
each distinct one once, joins the number to the postings and adds up per chunk. As every chunk gives every bucket one row of
bounded size, a word that fills the corpus makes no task hot. (3) A shuffle by chunk completes the documents' sums.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm._common import one_thread, pick, table, tokenizer_path

CHUNK_ROWS = 16_384
#: Characters of text per chunk; a longer text is a chunk of its own.
CHUNK_CHARS = 32 << 20
#: Entries that a task adds up before it passes them on.
FLUSH_ENTRIES = 4 << 20
#: Bytes of distinct pre-tokens, at ENTRY_BYTES each beside their own, that a task remembers; beyond it the memo starts anew and a word
#: may be encoded again.
MEMO_BYTES = 220 << 20
ENTRY_BYTES = 100


def _load(path: str):
    from tokenizers import Tokenizer

    one_thread()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _n_pieces(tokenizer, words: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch(words, add_special_tokens=False)]


def _pack(words: list[bytes], docs: list) -> bytes:
    """Words and their postings -> one compressed block."""
    import numpy as np
    import zstandard

    head = np.array([len(words), *map(len, words), *map(len, docs)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(words) + np.concatenate(docs).astype("<u2").tobytes())


def _unpack(block: bytes):
    """(words, number of postings of each, all postings)."""
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    lengths = np.frombuffer(raw, "<u4", 2 * n, 4)
    ends = 4 + 8 * n + np.cumsum(lengths[:n], dtype=np.int64)
    begins = (ends - lengths[:n]).tolist()
    words = [raw[i:j] for i, j in zip(begins, ends.tolist(), strict=True)]
    return words, lengths[n:], np.frombuffer(raw, "<u2", offset=int(ends[-1]) if n else 4)


def _invert(path: str, buckets: int):
    """Scan side. One head row per chunk (the documents and what is already counted) and its packed rows, one a bucket."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from tideline.llm._pretokens import PreTokens, byte_chars

        tokenizer = _load(path)
        pre = PreTokens(tokenizer)
        back = {c: b for b, c in enumerate(byte_chars())}
        entries = []
        for token in tokenizer.get_vocab(with_added_tokens=False):
            try:
                word = bytes(map(back.__getitem__, token)).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if pre.words(word) == [word]:
                entries.append(word)
        known = dict(zip(entries, _n_pieces(tokenizer, entries), strict=True))
        first, chunk = TaskContext.get().partitionId() << 33, 0

        class Numbered(dict):
            def __missing__(self, word):
                self[word] = n = len(self)
                return n

        def chunks():
            ids, texts, room = [], [], CHUNK_CHARS
            for batch in batches:
                for i in range(batch.num_rows):
                    text = batch.column(1)[i].as_py() or ""
                    if texts and (room < len(text) or len(texts) >= CHUNK_ROWS):
                        yield ids, texts
                        ids, texts, room = [], [], CHUNK_CHARS
                    ids.append(batch.column(0)[i].as_py())
                    texts.append(text)
                    room -= len(text)
            if texts:
                yield ids, texts

        names = ["bucket", "chunk", "block", "ids", "n_bytes", "done"]
        longs = pa.list_(pa.int64())
        for ids, texts in chunks():
            words_of, places, freqs, done, n_bytes = Numbered(), [], [], [], []
            for text in texts:
                total, found = 0, Counter()
                for k, part in enumerate(pre.segments(text)):
                    if k % 2:
                        total += 1
                    else:
                        found.update(pre.words(part))
                rest = {}
                for word, n in found.items():
                    if (pieces := known.get(word)) is not None:
                        total += pieces * n
                    else:
                        rest[word] = n
                places.append(np.fromiter(map(words_of.__getitem__, rest), np.int32, len(rest)))
                freqs.append(np.fromiter(rest.values(), np.int64, len(rest)))
                done.append(total)
                n_bytes.append(len(text.encode()))
            key, chunk = first | chunk, chunk + 1
            yield pa.RecordBatch.from_arrays([pa.array([key % buckets], pa.int32()), pa.array([key], pa.int64()), pa.nulls(1, pa.binary()), pa.array([ids], longs), pa.array([n_bytes], longs), pa.array([done], longs)], names=names)
            freq = np.concatenate(freqs)
            doc = np.repeat(np.repeat(np.arange(len(texts), dtype=np.uint16), [len(p) for p in places]), freq)
            word = np.repeat(np.concatenate(places), freq)
            doc = doc[np.argsort(word, kind="stable")]
            ends = np.cumsum(np.bincount(word, minlength=len(words_of))).tolist()
            words = [w.encode() for w in words_of]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for some in np.split(order, cuts) if len(order) else []:
                at = some.tolist()
                block = _pack([words[i] for i in at], [doc[ends[i - 1] if i else 0 : ends[i]] for i in at])
                yield pa.RecordBatch.from_arrays([pa.array([bucket[at[0]]], pa.int32()), pa.array([key], pa.int64()), pa.array([block], pa.binary()), pa.nulls(1, longs), pa.nulls(1, longs), pa.nulls(1, longs)], names=names)

    return run


def _join_and_add(path: str):
    """Bucket side: number of pieces per distinct pre-token, joined to its postings, added up per chunk. Head rows pass."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tokenizer = _load(path)
        pieces: dict[bytes, int] = {}
        sums: dict[int, np.ndarray] = {}
        held = memo = 0
        names = ["chunk", "docs", "sums", "ids", "n_bytes", "done"]
        longs = pa.list_(pa.int64())

        def flush():
            for chunk, n in sums.items():
                docs = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([docs.astype("<u2").tobytes()]), pa.array([n[docs].astype("<u4" if n.max(initial=0) < 1 << 32 else "<u8").tobytes()]), pa.nulls(1, longs), pa.nulls(1, longs), pa.nulls(1, longs)], names=names)
            sums.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(2)[i].as_py()
                if block is None:
                    one = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([one.column(1), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), one.column(3), one.column(4), one.column(5)], names=names)
                    continue
                words, each, docs = _unpack(block)
                if memo > MEMO_BYTES:
                    pieces.clear()
                    memo = 0
                if new := [w for w in words if w not in pieces]:
                    memo += sum(map(len, new)) + ENTRY_BYTES * len(new)
                    pieces.update(zip(new, _n_pieces(tokenizer, [w.decode() for w in new]), strict=True))
                weight = np.repeat(np.fromiter(map(pieces.__getitem__, words), np.int64, len(words)), each)
                n = np.bincount(docs, weights=weight).astype(np.int64)
                chunk = batch.column(1)[i].as_py()
                old = sums.get(chunk)
                if old is None:
                    sums[chunk], held = n, held + len(n)
                elif len(old) < len(n):
                    n[: len(old)] += old
                    sums[chunk], held = n, held + len(n) - len(old)
                else:
                    old[: len(n)] += n
                if held > FLUSH_ENTRIES:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def _complete(group):
    """All rows of a chunk -> its documents. The group holds a bounded number of documents, and a task's sums for them at most once a flush."""
    import numpy as np
    import pyarrow as pa

    rows = group.to_pydict()
    head = next(k for k, ids in enumerate(rows["ids"]) if ids is not None)
    total = np.array(rows["done"][head], np.int64)
    for docs, sums in zip(rows["docs"], rows["sums"], strict=True):
        if docs is not None:
            total[np.frombuffer(docs, "<u2")] += np.frombuffer(sums, "<u4" if 2 * len(docs) == len(sums) else "<u8").astype(np.int64)
    return pa.table({"doc_id": pa.array(rows["ids"][head], pa.int64()), "n_bytes": pa.array(rows["n_bytes"][head], pa.int64()), "n_tokens": pa.array(total)})


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs, by a byte-level BPE file.

    Null texts count as empty (0 bytes, 0 tokens). Repeated rows and null ids stay rows of their own. Empty tables give no
    rows. Other columns are ignored. Chunks are named by partition and place, so docs must be a scan, a staged or a sorted table:
    one that reads its rows in the same order again if an executor is lost.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    source = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    buckets = max(64, min(1 << 14, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    heads = "ids array<long>, n_bytes array<long>, done array<long>"
    packed = source.mapInArrow(_invert(path, buckets), f"bucket int, chunk long, block binary, {heads}")
    added = packed.repartition("bucket").mapInArrow(_join_and_add(path), f"chunk long, docs binary, sums binary, {heads}")
    counts = added.groupBy("chunk").applyInArrow(_complete, "doc_id long, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
