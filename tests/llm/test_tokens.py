"""Token counts, BPE coding and token files against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tideline.llm import bpe_codec, token_counts, token_files
from tideline.llm._pretokens import AGREED_BELOW, PreTokens

NASTY = [
    "",
    None,
    " ",
    "\n\n  \t a  b\n",
    "it's we'll I'd they've 'S ''s",
    "<|endoftext|> a <|endoftext|><|endoftext|>x <|startoftext|>",
    "Éa ça Ñandú ÿ   x　y ٣٤ ½²",
    "日本語のテキスト。中文字符 한국어",
    "ΑΣ ὈΔΥΣΣΕΎΣ ИСТОРИЯ",
    "é Å ẛ̣",
    "\x00\x1c\x1d a\x1f b\x85c",
    "😀👩‍👩‍👧 \U0001f9ff",
    "a" * 5000,
    "word " * 3000,
    "͸ ՠ ࣰ",
    "İstanbul ǅ ß",
]


def _docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, TEXT_ int").withColumnRenamed("TEXT_", "TEXT")


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def _random_texts(n):
    rng = random.Random(5)
    alphabet = "abcdeéüñ  \n\t'.,<|>0129ZÄ "
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 300))) for _ in range(n)]


def test_pretokens_agree_below_the_bound(byte_bpe):
    pre = PreTokens(byte_bpe)
    for cp in range(AGREED_BELOW):
        c = chr(cp)
        s = f"a{c}1{c} {c}!{c}{c}  {c}a '{c}"
        assert pre.find(s) == [s[i:j] for _, (i, j) in byte_bpe.pre_tokenizer.pre_tokenize_str(s)], hex(cp)


def test_counts(spark, byte_bpe):
    texts = NASTY + _random_texts(60) + [NASTY[4]] * 3
    got = {r.doc_id: r for r in token_counts.token_counts(_docs(spark, texts), limit=20).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(byte_bpe.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 20), t


def test_counts_of_nothing_and_of_repeats(spark):
    assert token_counts.token_counts(_docs(spark, []).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, None), (3, "x"), (3, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.token_counts(rows).collect()) == [(-1, 0), (-1, 2), (3, 1), (3, 1)]


def test_small_chunks_add_up(spark, byte_bpe, monkeypatch):
    texts = _random_texts(40)
    whole = {r.doc_id: r.n_tokens for r in token_counts.token_counts(_docs(spark, texts)).collect()}
    assert whole == {i: len(byte_bpe.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_round_trip(spark, byte_bpe):
    texts = NASTY + _random_texts(60)
    for r in bpe_codec.round_trip_digests(_docs(spark, texts)).collect():
        ids = byte_bpe.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(byte_bpe.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_then_decode(spark, byte_bpe):
    texts = NASTY + _random_texts(20)
    encoded = bpe_codec.encode(_docs(spark, texts))
    for r in encoded.collect():
        assert r.ids == byte_bpe.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    assert {r.doc_id: r.text for r in bpe_codec.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    odd = spark.createDataFrame([(1, None), (2, [128, 200])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe_codec.decode(odd).collect()} == {1: "", 2: byte_bpe.decode([128, 200])}


def test_other_special_strings(spark, tmp_path):
    """Special strings that have nothing in common, not even their first character."""
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.add_special_tokens(["[SEP]", "§end"])
    library.save(f"{tmp_path}/other.json")
    texts = ["a [SEP]b", "x§end", "[SEP]<|endoftext|>§end§", "[sep] plain", "", None]
    counted = {r.doc_id: r.n_tokens for r in token_counts.token_counts(_docs(spark, texts), tokenizer=f"{tmp_path}/other.json").collect()}
    coded = {r.doc_id: r.ids for r in bpe_codec.encode(_docs(spark, texts), tokenizer=f"{tmp_path}/other.json").collect()}
    for i, t in enumerate(texts):
        assert coded[i] == library.encode(t or "", add_special_tokens=False).ids
        assert counted[i] == len(coded[i])


def test_long_words_are_not_remembered(byte_bpe, word_bpe):
    text = "x" * 5000 + " " + "-" * 3000 + " a"
    codec, codes = bpe_codec.Codec(P.path("byte_bpe_50k.json")), token_files.WordCodes(P.path("word_bpe_49k.json"))
    for _ in range(2):
        assert codec.encode(text).tolist() == byte_bpe.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codes.encode(text), codes.dtype).tolist() == word_bpe.encode(text, add_special_tokens=False).ids
    assert max(map(len, [*codec.words, *codes.words, *codes.runs])) <= 128


def test_memo_of_counts_restarts(byte_bpe, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_BYTES", 500)
    texts = _random_texts(40)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(lambda: type("Context", (), {"partitionId": staticmethod(lambda: 0)})))
    packed = list(token_counts._invert(P.path("byte_bpe_50k.json"), 4)(iter([batch])))
    added = pa.Table.from_batches(list(token_counts._join_and_add(P.path("byte_bpe_50k.json"))(iter(packed))))
    got = token_counts._complete(added).to_pydict()
    assert got["n_tokens"] == [len(byte_bpe.encode(t, add_special_tokens=False).ids) for t in texts]


def test_cuts_are_certain(byte_bpe):
    codec = bpe_codec.Codec(P.path("byte_bpe_50k.json"))
    assert 0 < sum(codec.inside) < 65536
    raw = bytes(range(256)) + "žluťoučký kůň".encode()
    for k in codec.cuts(raw):
        assert not codec.inside[raw[k - 1] << 8 | raw[k]]
    pairs = {t[i : i + 2] for t in codec.bytes_of[:50256] for i in range(len(t) - 1)}
    assert all(raw[k - 1 : k + 1] not in pairs for k in codec.cuts(raw))


def test_memo_restarts(monkeypatch, byte_bpe):
    monkeypatch.setattr(bpe_codec, "MEMO", 5)
    codec = bpe_codec.Codec(P.path("byte_bpe_50k.json"))
    for t in _random_texts(30):
        assert codec.encode(t).tolist() == byte_bpe.encode(t, add_special_tokens=False).ids


def test_word_codes_equal_the_library(word_bpe, monkeypatch):
    monkeypatch.setattr(token_files, "MEMO", 50)
    codes = token_files.WordCodes(P.path("word_bpe_49k.json"))
    for t in [x or "" for x in NASTY] + _random_texts(200):
        assert np.frombuffer(codes.encode(t), codes.dtype).tolist() == word_bpe.encode(t, add_special_tokens=False).ids, t
    for cp in range(token_files.PLAIN_BELOW):
        t = f"a{chr(cp)}B {chr(cp)}1{chr(cp)}.{chr(cp)} '{chr(cp)}s"
        assert np.frombuffer(codes.encode(t), codes.dtype).tolist() == word_bpe.encode(t, add_special_tokens=False).ids, hex(cp)


@pytest.mark.parametrize("n", [1, 5, token_files.LANES, token_files.LANES + 1, 3 * token_files.CHECK_STEPS * token_files.LANES // 2])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 999).astype(np.uint32)
    counts = dict(zip(*map(np.ndarray.tolist, np.unique(ids, return_counts=True)), strict=True))
    freq = token_files.quantise(counts, 1000)
    assert freq.sum() == 1 << token_files.PROB_BITS and all(freq[k] >= 1 for k in counts)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]])
    payload, marks = token_files.encode_block(ids, freq, cum)
    f, c = freq.astype(np.uint64), cum.astype(np.uint64)
    symbol = np.repeat(np.arange(1000, dtype=np.uint32), freq)
    assert token_files.decode_block(payload, marks, n, f, c, symbol).tolist() == ids.tolist()
    last = -(-n // (token_files.CHECK_STEPS * token_files.LANES)) - 1  # any stretch decodes without those before it
    assert token_files.decode_stretch(payload, marks, last, n, f, c, symbol).tolist() == ids[last * token_files.CHECK_STEPS * token_files.LANES :].tolist()


def test_token_files(spark, word_bpe, tmp_path, monkeypatch):
    texts = NASTY + _random_texts(50)
    docs = _docs(spark, texts).repartition(5)
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, path)
    at = 0
    got = {r.doc_id: r for r in token_files.read_token_files(spark, path, digest=True).collect()}
    full = {r.doc_id: r.ids for r in token_files.read_token_files(spark, path).collect()}
    for i, t in enumerate(texts):
        ids = word_bpe.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert full[i] == ids
        at += len(ids)


def test_token_files_of_a_hot_id(spark, tmp_path):
    """Rows without an id, all of one text, go to several files; starts still follow one order."""
    from pyspark.sql import functions as F

    rows = spark.range(0, 6000, 1, 6).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.lit("one two").alias("text"))
    path = f"file://{tmp_path}/hot"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join files as small as these
    try:
        token_files.write_token_files(rows, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 4000 + list(range(0, 6000, 3))
    n = got[0].n_tokens
    assert [r.start for r in got] == [n * k for k in range(6000)]
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.select("part", F.explode("doc_ids").alias("i")).where("i IS NULL").select("part").distinct().count() > 1


def test_token_files_of_nothing_and_damage(spark, tmp_path):
    empty = f"file://{tmp_path}/empty"
    token_files.write_token_files(_docs(spark, []).limit(0), empty)
    assert token_files.read_token_files(spark, empty).count() == 0
    path = f"file://{tmp_path}/one"
    token_files.write_token_files(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string"), path)
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in rows] == [(None, 0), (1, 2), (1, 5)]
    from pyspark.sql import functions as F

    blocks = spark.read.parquet(f"{path}/blocks").withColumn("crc32", F.col("crc32") + 1)
    blocks.write.parquet(f"{path}-bad/blocks")
    spark.read.parquet(f"{path}/table").write.parquet(f"{path}-bad/table")
    with pytest.raises(Exception, match="damaged"):
        token_files.read_token_files(spark, f"{path}-bad").collect()
