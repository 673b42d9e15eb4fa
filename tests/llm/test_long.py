"""Texts of more than a million bytes through the operators that had no such test, beside short and missing ones."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tideline.llm import bpe_codec, mixing, near_dups, packing, resampling, token_counts, token_files, toxicity


def _long(seed, n=220_000):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "Beta,", "42", "naïve", "c'est", "x" * 9, "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    long = _long(1)
    assert len(long.encode()) > 1 << 20
    return [long, long[: len(long) // 2] + " one word more " + long[len(long) // 2 :], "a short one", "", None, "y" * 1_200_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "src", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").repartition(3)


def test_tokens_of_long_texts(docs, texts):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()} == {i: len(x) for i, x in enumerate(ids)}
    for r in bpe_codec.round_trip_digests(docs).collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_files_and_packing_of_long_texts(spark, docs, texts, tmp_path):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    token_files.write_token_files(docs, f"file://{tmp_path}/files")
    at = 0
    for r in sorted(token_files.read_token_files(spark, f"file://{tmp_path}/files", digest=True).collect()):
        whole = np.array([*ids[r.doc_id], token_files.END_ID], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(whole), zlib.crc32(whole.tobytes()))
        at += len(whole)
    rows = packing.pack(packing.cut_pieces(docs)).collect()
    total = sum(len(x) + 1 for x in ids)
    assert sum(r.length for r in rows) == total and len({r.sequence_id for r in rows}) == -(-total // 2048)


def test_near_duplicates_of_long_texts(docs):
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}


def test_words_of_long_texts(docs, texts):
    n = {r.doc_id: r.n_tokens for r in mixing.mixed(docs, share=0.5).collect()}
    assert n == {i: len((t or "").split()) for i, t in enumerate(texts)}
    model = toxicity.Model(-3.0, {"beta": 0.5})
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, model).collect())
    target = docs.select("doc_id", "text").toDF("item_id", "text").where("item_id = 2")
    rows = {r.doc_id: r for r in resampling.resampled(docs, target, share=50, least_words=1).collect()}
    assert rows[0].n_features > 200_000 and rows[5].n_features == 1 and rows[4].n_features == 0
