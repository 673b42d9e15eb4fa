"""Toxicity by multiple-instance learning.

Only documents carry labels, but offence sits in sentences. A sentence s scores p_s = sigmoid(bias + sum of the weights of its
words); a document scores 1 - prod(1 - p_s) (noisy-or). Weights are fitted to document labels through that product by full-batch
gradient steps, so responsibility settles on the sentences that explain the label, and the same p_s then locate them.

A word's weight is the sum of the weights of its features: the word and its prefixes of 3 to 6 letters. Features are those of
the labelled sample that go with one label clearly more often than chance. The sample is bounded by SAMPLE; scoring is one narrow
scan over whole texts.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm._common import bounded_sample, drop_stage, pick, stage, table

#: At most so many labelled documents, and so many bytes of them, are brought to the driver to fit on.
SAMPLE = 8_000
SAMPLE_BYTES = 256 << 20
MAX_FEATURES = 20_000
LEAST_DOCS = 4
LEAST_Z = 3.0
ROUNDS = 300
DECAY = 1e-4
#: Runs that a scorer remembers; longer ones than LONGEST are not, so that the memo is bounded in bytes too.
MEMO = 500_000
LONGEST = 128
_SENTENCE = re.compile(r"[^.!?\n]+")


def bare(run: str) -> str:
    """run without what is neither letter nor digit at either end, in time linear in its length."""
    first, last = 0, len(run)
    while first < last and not run[first].isalnum():
        first += 1
    while last > first and not run[last - 1].isalnum():
        last -= 1
    return run[first:last]


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in range(3, min(len(word), 7)))]


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def word(self, run: str) -> float:
        """Weight of a run of non-blank lower-case characters."""
        word = bare(run)
        return sum(self.weights.get(f, 0.0) for f in features(word)) if word else 0.0


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, logit) of every sentence that holds more than blanks."""
        known, word = self.known, self.model.word
        found = []
        for m in _SENTENCE.finditer(text):
            runs = m.group().lower().split()
            if not runs:
                continue
            if len(known) > MEMO:
                known.clear()
            z = self.model.bias
            for run in set(runs):
                w = known.get(run)
                if w is None:
                    w = word(run)
                    if len(run) <= LONGEST:
                        known[run] = w
                z += w
            found.append((m.start(), m.end(), z))
        return found

    @staticmethod
    def fused(sentences: list[tuple[int, int, float]]) -> float:
        none = sum(z if z > 30 else math.log1p(math.exp(z)) for _, _, z in sentences)
        return -math.expm1(-none)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Feature choice and noisy-or fit. Without both labels in the sample there is nothing to learn: every sentence scores low."""
    import numpy as np

    y = np.array(labels, float)
    n_docs, n_pos = len(y), int(y.sum())
    if not n_pos or n_pos == n_docs:
        return Model(-30.0)
    cached = functools.lru_cache(1_000_000)(lambda run: tuple(features(b)) if (b := bare(run)) else ())
    seen, positive = Counter(), Counter()
    for text, label in zip(texts, labels, strict=True):
        own = set()
        for run in set(text.lower().split()):
            own.update(cached(run))
        seen.update(own)
        if label:
            positive.update(own)
    rate = n_pos / n_docs
    strength = {f: (positive[f] - n * rate) / math.sqrt(n * rate * (1 - rate)) for f, n in seen.items() if n >= LEAST_DOCS}
    chosen = sorted((f for f, z in strength.items() if abs(z) >= LEAST_Z), key=lambda f: (-abs(strength[f]), f))[:MAX_FEATURES]
    number = {f: i for i, f in enumerate(chosen)}
    rows, cols, doc_of = [], [], []
    for d, text in enumerate(texts):
        for m in _SENTENCE.finditer(text):
            runs = set(m.group().lower().split())
            if runs:
                for run in runs:
                    for f in cached(run):
                        if (i := number.get(f)) is not None:
                            rows.append(len(doc_of))
                            cols.append(i)
                doc_of.append(d)
    rows, cols, doc_of = np.array(rows, np.int64), np.array(cols, np.int64), np.array(doc_of, np.int64)
    w, bias = np.zeros(len(chosen)), -6.0
    m1, m2, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        z = np.bincount(rows, weights=w[cols], minlength=len(doc_of)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        none = np.bincount(doc_of, weights=np.logaddexp(0, z), minlength=n_docs)
        odds = np.exp(-none) / np.maximum(-np.expm1(-none), 1e-12)
        slope = p * np.where(y == 1, -odds, 1.0)[doc_of]
        gw = np.bincount(cols, weights=slope[rows], minlength=len(w)) / n_docs + DECAY * w
        gb = slope.sum() / n_docs
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.1 * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        bias -= 0.1 * (b1 / c1) / (math.sqrt(b2 / c2) + 1e-8)
    return Model(float(bias), {f: float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-4})


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from the labelled documents that meet `train`, a condition over the column doc_id of labels.

    At most `sample` documents and SAMPLE_BYTES of text, chosen by a hash of their ids, are read. Null labels and labels without a
    document don't count: labels meet the documents' ids before any is drawn.
    """
    known = pick(labels, id_col, label_col).toDF("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    ids = pick(docs, id_col).toDF("doc_id").select(F.col("doc_id").cast("long"))
    known = stage(known.join(ids, "doc_id", "left_semi"), "labels")
    asked = [(r.doc_id, r.toxic) for r in bounded_sample(known, ["doc_id", "toxic"], sample, SAMPLE_BYTES)]
    some = docs.sparkSession.createDataFrame(asked, "doc_id long, toxic int")
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(some), "doc_id")  # `sample` rows
    read = bounded_sample(rows, ["doc_id", "text", "toxic"], sample, SAMPLE_BYTES, "text")
    drop_stage(known)
    return fit([r.text or "" for r in read], [int(r.toxic > 0) for r in read])


def _score(model: Model):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(model)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            scores, offending = [], []
            for text in batch.column(1).to_pylist():
                found = scorer.sentences(text or "")
                scores.append(scorer.fused(found))
                offending.append([{"start": i, "end": j, "score": 1 / (1 + math.exp(-z))} for i, j, z in found if z >= 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(offending, span)], names=["doc_id", "score", "offending"])

    return run


def toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), offending: the sentences (start, end in code points, score) that score 0.5 or more.

    Null and empty texts hold no sentence and score 0. Repeated rows and null ids stay. Other columns are ignored.
    """
    source = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return source.mapInArrow(_score(model), "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), apart != 0)
    scored = toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(apart == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"), "offending")
