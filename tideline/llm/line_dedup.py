"""Cross-site boilerplate lines by their spread over sites.

Lines are counted by hash: a HyperLogLog sketch of the sites per line hash, merged by aggregation (map side first, so a line
that fills the corpus is one sketch per task). Lines whose estimate falls near the threshold get an exact distinct count.
Documents then lose those lines. A document of nothing but spread lines is a copy of a document rather than a carrier of
boilerplate; it keeps its text for near-duplicate detection to judge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm._common import few, maybe_broadcast, pick, stage, table

MIN_SITES = 10
#: Registers are 2**LG_K; the standard error of an estimate is about 1.04 / 2**(LG_K / 2).
LG_K = 8
#: Standard errors around the threshold within which counts are made exactly.
SIGMAS = 5.0


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _key(value: Column) -> list[Column]:
    """96 bits of two independent hashes."""
    return [F.xxhash64(value), F.hash(value)]


def _exploded(source: DataFrame) -> DataFrame:
    """One row a line that holds anything: the text's key (t1, t2), place, the line's key (l1, l2), its length, the site."""
    t1, t2 = _key(F.col("text"))
    lines = source.select(t1.alias("t1"), t2.alias("t2"), "site", F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    bare = lines.withColumn("line", _bare(F.col("line"))).where("line <> ''")
    l1, l2 = _key(F.col("line"))
    return bare.select("t1", "t2", "place", "site", l1.alias("l1"), l2.alias("l2"), F.char_length("line").alias("n"))


def _spread(docs: DataFrame, text_col: str, site_col: str, min_sites: int) -> tuple[DataFrame, int]:
    """What spread_lines returns, and how many rows that has at most."""
    lines = _exploded(pick(docs, text_col, site_col).toDF("text", "site").select("text", F.col("site").cast("string")))
    error = SIGMAS * 1.04 / 2 ** (LG_K / 2)
    low, high = min_sites * (1 - error), min_sites * (1 + error)
    counted = lines.where("site IS NOT NULL").groupBy("l1", "l2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    estimated = stage(few(counted.select("l1", "l2", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low)), "spread")
    most, n = estimated.agg(F.count("*"), F.count_if(F.col("sites") <= high)).collect()[0]
    near = maybe_broadcast(estimated.where(F.col("sites") <= high).select("l1", "l2"), n, 32)
    exact = lines.join(near, ["l1", "l2"]).select("l1", "l2", "site").distinct().groupBy("l1", "l2").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return estimated.where(F.col("sites") > high).select("l1", "l2").union(exact.select("l1", "l2")), most


def spread_lines(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """l1, l2: the keys of lines that occur on at least min_sites distinct sites. Null sites count as none."""
    return _spread(docs, text_col, site_col, min_sites)[0]


def strip_boilerplate(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, max_share: float | None = None) -> DataFrame:
    """docs with n_lines, n_removed and text without its spread lines; all other columns stay.

    Lines end at U+000A and are compared without blanks, tabs and carriage returns at their ends; lines empty after that stay.
    A text without any other line is left whole, and with max_share also one of which spread lines make up more than that share of
    the lines' characters. Null texts stay null (no lines, none removed). Repeated rows are treated alike. Columns named n_lines or n_removed are replaced.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    source = pick(docs, text_col, site_col).toDF("text", "site").select("text", F.col("site").cast("string"))
    spread = maybe_broadcast(*_spread(docs, text_col, site_col, min_sites), 32)
    hit = _exploded(source).join(spread, ["l1", "l2"]).select("t1", "t2", "place", "n").distinct()
    places = stage(few(hit.groupBy("t1", "t2").agg(F.collect_set("place").alias("places"), F.sum("n").alias("spread_chars"))), "places")
    n, held = places.agg(F.count("*"), F.sum(F.size("places"))).collect()[0]
    places = maybe_broadcast(places, 1, 64 * n + 8 * (held or 0))
    at = docs.columns.index(text_col)
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    text = F.col(f"_c{at}")
    t1, t2 = _key(text)
    joined = flat.withColumns({"t1": t1, "t2": t2}).join(places, ["t1", "t2"], "left")
    lines = _lines(text)
    chars = F.aggregate(F.transform(lines, lambda x: F.char_length(_bare(x))), F.lit(0).cast("long"), lambda a, x: a + x)
    strip = F.col("places").isNotNull() & (F.col("spread_chars") < chars)
    if max_share is not None:
        strip = strip & (F.col("spread_chars") <= max_share * chars)
    others = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places"))
    left = F.array_join(F.element_at(F.transform(F.array(lines), lambda all_: F.transform(others, lambda i: F.get(all_, i))), 1), "\n")
    out = {c: F.col(f"_c{i}") for i, c in enumerate(docs.columns)}
    out[text_col] = F.when(strip, left).otherwise(text)
    return joined.select(
        *[out[c].alias(c) for c in columns],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(strip, F.size("places")).otherwise(0).cast("long").alias("n_removed"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, source, text, CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(text, chr(10)) END AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(range(len(ls))) AS place, unnest(ls) AS line FROM d),
b AS (SELECT doc_id, source, place, line, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
s AS (SELECT bare FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT b.*, s.bare IS NOT NULL AS hit FROM b LEFT JOIN s ON b.bare = s.bare),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS hits,
             coalesce(sum(length(bare)) FILTER (WHERE hit), 0) AS spread_chars, coalesce(sum(length(bare)), 0) AS chars,
             string_agg(CASE WHEN NOT hit THEN line END, chr(10) ORDER BY place) AS left_over FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
       CAST(CASE WHEN hits > 0 AND spread_chars < chars THEN hits ELSE 0 END AS BIGINT) AS n_removed,
       sha256(CASE WHEN hits > 0 AND spread_chars < chars THEN coalesce(left_over, '') ELSE text END) AS text_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
