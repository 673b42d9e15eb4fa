"""From raw documents to token ids: language, boilerplate lines, near-duplicates, mixture, encoding.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a DataFrame; run() writes each
result to the shared folder as Parquet and reads it again for the next stage. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm._common import drop_stage, maybe_broadcast, stage, staged_alone, table
from tideline.llm.bpe_codec import encode_checked
from tideline.llm.language import fit_language, identify
from tideline.llm.line_dedup import strip_boilerplate
from tideline.llm.mixing import mixed
from tideline.llm.near_dups import near_duplicates

#: Share of the corpus' tokens that the mixture keeps.
MIX_SHARE = 0.5
#: Documents with a larger share of boilerplate stay whole for near-duplicate detection.
WHOLE_ABOVE = 0.5


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., which no operator's own names clash with, and where each column went (exact spelling)."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}


def _named(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages. Those without letters, or more like noise than like any language, go.

    Null and empty texts go; null languages and sources are no evidence. Repeated rows fare alike. An empty table, and one in which
    nothing is labelled, gives no rows. Columns keep their values, whatever their names.
    """
    model = fit_language(docs)
    flat, at = _apart(docs)
    none = F.lit(None).cast("string")
    found = identify(flat, model, text=F.col(at["text"]), declared=F.col(at["lang"]), suffix=none, host=F.col(at["source"]), domain=none)
    return _named(found.where("accepted"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; n_chars follows the text. No document goes.

    Null texts stay null; null sources are no site. A document of which such lines make up most keeps them: among near copies from
    many sites the common lines are such, and what then differs would no longer link them. Repeated rows fare alike.
    """
    flat, at = _apart(docs)
    out = strip_boilerplate(flat, text_col=at["text"], site_col=at["source"], max_share=WHOLE_ABOVE)
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.when(F.col("n_removed") > 0, F.char_length(at["text"]).cast("long")).otherwise(F.col(at["n_chars"])))
    return _named(out, docs)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id.

    Where ids are missing or repeat, rows get numbers for the while, so that decisions are made by row: of a group that row stays
    which has the smallest id, or none but the smallest number. Null and empty texts are in no group and stay.
    """
    n, ids = docs.agg(F.count("*"), F.count_distinct(F.col("doc_id"))).collect()[0]
    if n == ids:
        found = near_duplicates(docs).where("kept").select("doc_id")
        return docs.join(maybe_broadcast(found, n, 24), "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    flat, at = _apart(docs)
    numbered = stage(flat.withColumn("row", F.monotonically_increasing_id()), "numbered")
    grouped = near_duplicates(numbered, id_col="row", text_col=at["text"]).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col(at["doc_id"]).isNull(), F.col(at["doc_id"]), F.col("row"))
    least = grouped.join(numbered.select("row", at["doc_id"]), "row").groupBy("component_id").agg(F.min_by("row", order).alias("row"))
    return _named(numbered.join(maybe_broadcast(least.select("row"), n, 24), "row", "left_semi"), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target weights; documents repeat where these need it.

    Null sources and languages are a value of their own; a column topic is the topic if there is one. Rows without words are
    never taken. Columns keep their values, whatever their names.
    """
    flat, at = _apart(docs)
    read = [F.col(at[c]).alias(c) for c in ("doc_id", "text", "source", "lang", "topic") if c in at]
    taken = mixed(flat.select("*", *read), share=MIX_SHARE).where("taken")
    return _named(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))), docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of every document left; a null text has no ids."""
    return encode_checked(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dups", near_dups), ("mixture", mixture), ("bpe", bpe)]

#: SQL can't express the trained language model, the sketches and the tokenizer; tests/llm holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is a table in the shared folder; that of a stage, and what it staged on the way, goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, apply in STAGES:
        docs = staged_alone(lambda apply=apply, docs=docs: apply(spark, docs, sf_dir), name)
        if before is not None:
            drop_stage(before)
        before = docs
    return docs
