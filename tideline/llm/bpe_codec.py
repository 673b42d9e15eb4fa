"""BPE encoding and decoding by forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged over, so between such bytes there is
always a token boundary. Pre-tokens are cut there as well; every fragment is encoded on its own (each distinct one once per
task while the bounded memo lasts) and the ids are concatenated. Decoding joins the ids' bytes.

It is one narrow scan: no shuffle, memory bounded by a batch and the memo.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm._common import one_thread, pick, table, tokenizer_path

#: Distinct pre-tokens that a Python worker remembers, twice over; beyond it those that were not used lately are forgotten.
MEMO = 200_000
#: Longer pre-tokens are not remembered, so that the memo is bounded in bytes too.
LONGEST = 128


class Codec:
    """encode(text) -> ids and decode(ids) -> text, equal to the library's for a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from tideline.llm._pretokens import PreTokens, byte_chars

        one_thread()
        tokenizer = Tokenizer.from_file(path)
        self.model, self.pre, self.chars = tokenizer.model, PreTokens(tokenizer), byte_chars()
        back = {c: b for b, c in enumerate(self.chars)}
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = [b""] * (1 + max(chain(vocab.values(), self.pre.specials.values())))
        inside = bytearray(65536)
        for token, i in vocab.items():
            raw = bytes(map(back.__getitem__, token))
            self.bytes_of[i] = raw
            for a, b in zip(raw, raw[1:], strict=False):
                inside[a << 8 | b] = 1
        for text, i in self.pre.specials.items():
            self.bytes_of[i] = text.encode()
        self.text_of = list(map(str, range(len(self.bytes_of))))
        self.inside = inside
        self.code = "H" if len(self.bytes_of) <= 1 << 16 else "I"
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def cuts(self, raw: bytes) -> list[int]:
        """Places in raw where no token can reach across."""
        inside = self.inside
        return [k for k, (a, b) in enumerate(zip(raw, raw[1:], strict=False), 1) if not inside[a << 8 | b]]

    def _word(self, word: str) -> bytes:
        """A pre-token's ids, packed: its fragments between certain cuts are encoded independently and concatenated."""
        packed = self.old.get(word)
        if packed is None:
            raw = word.encode()
            edges = [0, *self.cuts(raw), len(raw)]
            ids = array(self.code)
            for i, j in zip(edges, edges[1:], strict=False):
                ids.extend([t.id for t in self.model.tokenize("".join(map(self.chars.__getitem__, raw[i:j])))])
            packed = ids.tobytes()
        if len(word) <= LONGEST:
            self.words[word] = packed
        return packed

    def encode(self, text: str) -> array:
        """The text's ids. Pre-tokens that were used since the memo last filled up are not encoded again."""
        if len(self.words) > MEMO:
            self.old, self.words = self.words, {}
        known, packed = self.words, []
        for k, part in enumerate(self.pre.segments(text)):
            if k % 2:
                packed.append(array(self.code, [self.pre.specials[part]]).tobytes())
                continue
            words = self.pre.words(part)
            try:
                packed += [known[w] for w in words]
            except KeyError:
                packed += [known.get(w) or self._word(w) for w in words]
        ids = array(self.code)
        ids.frombytes(b"".join(packed))
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def joined(self, ids) -> str:
        return ",".join(map(self.text_of.__getitem__, ids))


@functools.cache
def _codec(path: str) -> Codec:
    """One for all tasks that a Python worker runs, so that its memo stays warm."""
    return Codec(path)


def _lists(arrays: list[array]):
    """Arrays of ids -> an Arrow list<int32>."""
    import numpy as np
    import pyarrow as pa

    flat = [np.frombuffer(a, np.uint16 if a.typecode == "H" else np.uint32) for a in arrays]
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in flat])]).astype(np.int32)
    values = np.concatenate(flat).astype(np.int32) if flat else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _encode(path: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec(path)
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids)], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec(path)
        for batch in batches:
            texts = [codec.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _digests(path: str):
    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa

        codec = _codec(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for i in range(len(batch)):  # one text at a time: ids of a whole batch need not be in memory
                ids = codec.encode(batch.column(1)[i].as_py() or "")
                n.append(len(ids))
                of_ids.append(sha256(codec.joined(ids).encode()).hexdigest())
                of_text.append(sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _checked(path: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(i, 256).to_pylist()]
                ids = [codec.encode(t) for t in texts]
                same = [codec.decode(d) == t for d, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), pa.array(list(map(len, ids)), pa.int64()), _lists(ids), pa.array(same)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return run


def _source(docs: DataFrame, id_col: str, value_col: str, name: str) -> DataFrame:
    return pick(docs, id_col, value_col).toDF("doc_id", name).select(F.col("doc_id").cast("long"), name)


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) for every row. A null text is an empty one and has no ids; null ids and repeated rows stay."""
    return _source(docs, id_col, text_col, "text").mapInArrow(_encode(tokenizer or tokenizer_path("byte_bpe_50k.json")), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """doc_id, text for every row of ids. Null ids decode to an empty text; bytes that are no UTF-8 become U+FFFD."""
    return _source(encoded, id_col, ids_col, "ids").mapInArrow(_decode(tokenizer or tokenizer_path("byte_bpe_50k.json")), "doc_id long, text string")


def round_trip_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row: encodes and decodes every whole text in one pass."""
    return _source(docs, id_col, text_col, "text").mapInArrow(_digests(tokenizer or tokenizer_path("byte_bpe_50k.json")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (whether the ids decode to the text) per row; nulls as in encode()."""
    return _source(docs, id_col, text_col, "text").mapInArrow(_checked(tokenizer or tokenizer_path("byte_bpe_50k.json")), "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))
