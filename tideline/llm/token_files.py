"""Token files coded by a static range asymmetric numeral system (rANS).

File format: a folder with two Parquet datasets, written by Spark's committed writer so that a lost executor leaves no half file.
  table/   token, freq: the shared frequency table; frequencies sum to 2**PROB_BITS.
  blocks/  one row a block: part, block (ascending; with it ascending ids), start (ids of the part's earlier blocks), doc_ids
           (array), lengths (array), n_tokens, payload, checkpoints, crc32. Blocks hold whole documents and decode independently.
Payload: little-endian uint32 words. Ids of a block are dealt to LANES interleaved coders (id i to lane i mod LANES), each with a
64-bit state in [2**31, 2**63) that gives off 32 bits at a time. checkpoints holds, for every CHECK_STEPS steps, the place in
the payload (uint64) and all lane states (uint64), so that each stretch of a block decodes independently of the others. crc32 is
that of payload and checkpoints together.

Texts are encoded once, into a staged table of packed ids; the frequency table is counted from it, and a range partitioning of
it brings documents to files in ascending id order.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm._common import drop_stage, new_path, one_thread, pick, stage, table, tokenizer_path

PROB_BITS = 18
LANES = 2048
CHECK_STEPS = 128
BLOCK_TOKENS = 1 << 20
LOW = 1 << 31
END_ID = 2
#: Below it normalisation (NFC, lower case) acts on single characters and all engines agree; texts beyond go through the library.
PLAIN_BELOW = 0x23A
#: Distinct words, and distinct runs of them, that a Python worker remembers; beyond it the memo starts anew.
MEMO = 400_000
#: Longer words and runs are not remembered, so that the memo is bounded in bytes too.
LONGEST = 128


class WordCodes:
    """ids of a text as the tokenizers library gives them for a lower-casing word-level BPE file, remembering each word's ids."""

    def __init__(self, path: str):
        import json
        import re
        import unicodedata

        from tokenizers import Tokenizer

        from tideline.llm._pretokens import byte_chars

        one_thread()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.chars = self.library.model, byte_chars()

        def within(kind):
            return "".join(re.escape(chr(c)) for c in range(PLAIN_BELOW + 0x70) if kind(chr(c)))

        letters = within(lambda c: unicodedata.category(c)[0] == "L")
        digits = within(lambda c: unicodedata.category(c)[0] == "N")
        spaces = within(lambda c: c.isspace() and not 0x1C <= ord(c) <= 0x1F)
        self.find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+").findall
        self.beyond = re.compile(f"[\\x1c-\\x1f\\U{PLAIN_BELOW:08x}-\\U0010ffff]").search
        self.specials = [t["content"] for t in json.loads(self.library.to_str())["added_tokens"]]
        #: What every special string begins with: a text without it holds none.
        self.hint = os.path.commonprefix(self.specials)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = "<u2" if self.size <= 1 << 16 else "<u4"
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        packed = self.old_words.get(word)
        if packed is None:
            raw = word if word.isascii() and word.isprintable() else "".join(map(self.chars.__getitem__, word.encode()))
            packed = array(self.code, [t.id for t in self.model.tokenize(raw)]).tobytes()
        if len(word) <= LONGEST:
            self.words[word] = packed
        return packed

    def _run(self, run: str) -> bytes:
        """A run of non-blank characters: no word reaches over a blank, so its ids don't depend on its neighbours."""
        packed = self.old_runs.get(run)
        if packed is None:
            known = self.words
            if run.isalpha():
                packed = known.get(run) or self._word(run)
            else:
                packed = b"".join([known.get(w) or self._word(w) for w in self.find(run)])
        if len(run) <= LONGEST:
            self.runs[run] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The text's ids, packed as little-endian self.dtype. What was used since the memo last filled up stays known."""
        if self.beyond(text) or self.hint in text and any(s in text for s in self.specials):
            return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.runs) > MEMO:
            self.old_runs, self.runs = self.runs, {}
        if len(self.words) > MEMO:
            self.old_words, self.words = self.words, {}
        runs = text.lower().split()
        known = self.runs
        try:
            return b"".join([known[r] for r in runs])
        except KeyError:
            return b"".join([known[r] if r in known else self._run(r) for r in runs])


@functools.cache
def _codes(path: str) -> WordCodes:
    """One for all tasks that a Python worker runs, so that its memo stays warm."""
    return WordCodes(path)


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        codes = _codes(path)
        end = np.array([end_id], codes.dtype).tobytes()
        for batch in batches:
            ids = [codes.encode(t or "") + end for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _histogram(dtype: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                more = np.bincount(np.frombuffer(ids.as_py(), dtype), minlength=len(n))
                more[: len(n)] += n
                n = more
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], names=["token", "n"])

    return run


def quantise(counts: dict[int, int], size: int):
    """Counts -> frequencies that sum to 2**PROB_BITS, at least 1 for each token that occurs."""
    import numpy as np

    total = 1 << PROB_BITS
    n = np.zeros(size, np.int64)
    n[list(counts)] = list(counts.values())
    used = np.flatnonzero(n)
    if len(used) > total:
        raise ValueError("more tokens than the table has places")
    freq = np.zeros(size, np.int64)
    freq[used] = np.maximum(1, n[used].astype(np.float64) / n.sum() * total).astype(np.int64)
    while (over := int(freq.sum()) - total) != 0:  # the largest give or take what rounding left
        top = used[np.argsort(-freq[used], kind="stable")][:1024]
        step = np.maximum(1, abs(over) * freq[top] // freq[top].sum())
        for i, s in zip(top, step, strict=True):
            s = int(min(s, abs(over)))
            if over > 0:
                s = int(min(s, freq[i] - 1))
                over -= s
                freq[i] -= s
            else:
                over += s
                freq[i] += s
            if not over:
                break
    return freq


def encode_block(ids, freq, cum) -> tuple[bytes, bytes]:
    """ids -> (payload, checkpoints). One vector operation codes a step of all lanes."""
    import numpy as np

    steps = -(-len(ids) // LANES)
    x = np.full(LANES, LOW, np.uint64)
    words, marks = [], {}
    f64, c64 = freq.astype(np.uint64), cum.astype(np.uint64)
    prob, half = np.uint64(PROB_BITS), np.uint64(32)
    top = np.uint64((LOW >> PROB_BITS) << 32)
    placed = 0
    for s in range(steps - 1, -1, -1):
        sym = ids[s * LANES : (s + 1) * LANES]
        y = x[: len(sym)]
        f = f64[sym]
        full = y >= top * f
        if full.any():
            out = y[full]
            words.append(out.astype(np.uint32))
            placed += len(out)
            y[full] = out >> half
        q = y // f
        y[:] = (q << prob) + (y - q * f) + c64[sym]
        if s % CHECK_STEPS == 0:
            marks[s] = (placed, x.copy())
    payload = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    kept = [np.concatenate([np.array([placed - marks[s][0]], np.uint64), marks[s][1]]) for s in sorted(marks)]
    return payload.astype("<u4").tobytes(), (np.concatenate(kept) if kept else np.empty(0, np.uint64)).astype("<u8").tobytes()


def decode_stretch(payload: bytes, checkpoints: bytes, k: int, n_tokens: int, freq, cum, symbol):
    """The ids of the k-th stretch of CHECK_STEPS steps, from its checkpoint alone."""
    import numpy as np

    mark = np.frombuffer(checkpoints, "<u8")[k * (LANES + 1) : (k + 1) * (LANES + 1)]
    stream = np.frombuffer(payload, "<u4")
    at, x = int(mark[0]), mark[1:].astype(np.uint64)
    first, last = k * CHECK_STEPS * LANES, min(n_tokens, (k + 1) * CHECK_STEPS * LANES)
    out = np.empty(last - first, np.uint32)
    prob, low, half = np.uint64(PROB_BITS), np.uint64(LOW), np.uint64(32)
    mask = np.uint64((1 << PROB_BITS) - 1)
    for begin in range(0, last - first, LANES):
        y = x[: min(LANES, last - first - begin)]
        slot = y & mask
        sym = symbol[slot]
        out[begin : begin + len(y)] = sym
        y[:] = freq[sym] * (y >> prob) + slot - cum[sym]
        empty = np.flatnonzero(y < low)
        if len(empty):
            y[empty] = (y[empty] << half) | stream[at : at + len(empty)]
            at += len(empty)
    return out


def decode_block(payload: bytes, checkpoints: bytes, n_tokens: int, freq, cum, symbol):
    import numpy as np

    stretches = -(-n_tokens // (CHECK_STEPS * LANES))
    parts = [decode_stretch(payload, checkpoints, k, n_tokens, freq, cum, symbol) for k in range(stretches)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def _write_blocks(dtype: str, freq):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        cum = np.concatenate([[0], np.cumsum(freq)[:-1]])
        part = TaskContext.get().partitionId()
        start, block = 0, 0

        def close(doc_ids, lengths, ids):
            payload, marks = encode_block(ids, freq, cum)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary()), pa.array([marks], pa.binary()), pa.array([zlib.crc32(marks, zlib.crc32(payload))], pa.int64())],
                names=["part", "block", "start", "doc_ids", "lengths", "n_tokens", "payload", "checkpoints", "crc32"],
            )

        doc_ids, lengths, parts, held = [], [], [], 0
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for i, doc_id in enumerate(ids_of):
                ids = np.frombuffer(batch.column(1)[i].as_py(), dtype)
                if held and held + len(ids) > BLOCK_TOKENS:
                    yield close(doc_ids, lengths, np.concatenate(parts))
                    start, block = start + held, block + 1
                    doc_ids, lengths, parts, held = [], [], [], 0
                doc_ids.append(doc_id)
                lengths.append(len(ids))
                parts.append(ids)
                held += len(ids)
        if held:
            yield close(doc_ids, lengths, np.concatenate(parts))

    return run


BLOCKS = "part int, block int, start long, doc_ids array<long>, lengths array<long>, n_tokens long, payload binary, checkpoints binary, crc32 long"


def write_token_files(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encodes every whole text, appends end_id, and writes the ids in ascending id order to the folder `path`.

    Null texts count as empty (the end id alone). Null ids come first. Rows that repeat an id follow each other, ordered by a hash
    of their ids; they may fill several files, so that no id, missing ones included, makes a task hot. An empty table gives a folder without blocks. Only the frequency table, bounded by the vocabulary, reaches the driver.
    """
    import numpy as np
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    file = tokenizer or tokenizer_path("word_bpe_49k.json")
    source = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    dtype = "<u2" if Tokenizer.from_file(file).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
    coded = stage(source.mapInArrow(_tokenise(file, end_id), "doc_id long, ids binary"), "ids")
    counted = coded.select("ids").mapInArrow(_histogram(dtype), "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    size = max([end_id, *(r.token for r in counted)], default=0) + 1
    freq = quantise({r.token: r.n for r in counted}, size) if counted else np.zeros(size, np.int64)
    used = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(used, "token int, freq long").coalesce(1).write.parquet(f"{path}/table")
    key = ["doc_id", "tie", "row"]
    keyed = coded.withColumns({"tie": F.xxhash64("ids"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(*key).sortWithinPartitions(*key)
    ordered.select("doc_id", "ids").mapInArrow(_write_blocks(dtype, freq), BLOCKS).write.parquet(f"{path}/blocks")
    drop_stage(coded)


def _read(freq_rows: list[tuple[int, int]], digest: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        size = max((t for t, _ in freq_rows), default=0) + 1
        freq = np.zeros(size, np.uint64)
        for t, f in freq_rows:
            freq[t] = f
        cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        symbol = np.repeat(np.arange(size, dtype=np.uint32), freq.astype(np.int64))
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                if zlib.crc32(row["checkpoints"], zlib.crc32(row["payload"])) != row["crc32"]:
                    raise ValueError(f"block {row['part']}/{row['block']} is damaged")
                ids = decode_block(row["payload"], row["checkpoints"], row["n_tokens"], freq, cum, symbol).astype("<u4")
                ends = np.cumsum(row["lengths"])
                begins = ends - row["lengths"]
                each = [ids[i:j] for i, j in zip(begins, ends, strict=True)]
                last = pa.array([zlib.crc32(e.tobytes()) for e in each], pa.int64()) if digest else pa.array(each, pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))
                n = len(each)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + begins, pa.int64()), pa.array(row["lengths"], pa.int64()), last], names=["part", "doc_id", "at", "n_tokens", "value"])

    return run


def read_token_files(spark: SparkSession, path: str, *, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (array<int>), or with digest their ids_crc32, from the files."""
    rows = [(r.token, r.freq) for r in spark.read.schema("token int, freq long").parquet(f"{path}/table").collect()]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a file
    before, at = [], 0
    for r in totals:
        before.append((r.part, at))
        at += r.n
    kind = "long" if digest else "array<int>"
    docs = blocks.mapInArrow(_read(rows, digest), f"part int, doc_id long, at long, n_tokens long, value {kind}")
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    return docs.join(offsets, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", F.col("value").alias("ids_crc32" if digest else "ids"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path, digest=True)
