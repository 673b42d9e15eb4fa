"""Document fingerprints by winnowing, in DataFrame functions only.

Every K-gram of code points is hashed; of every window of WINDOW successive hashes the smallest is chosen, of equal ones the
rightmost, and its position is kept. So two texts that share K + WINDOW - 1 code points share a chosen hash.

A choice is one long, hash above and the inverted position below, so that the minimum of longs is the rightmost smallest hash.
Window minima are pairwise minima at distances 1, 2, 4 and 8 (their spans add up to WINDOW). Long texts are cut, in one pass,
into overlapping stretches of SEGMENT windows, which bounds what is held besides the chosen hashes and keeps the work linear.

Neighbours in id order come from one shuffle of the texts into ranges of keys (the inverted id, then the text's first HEAD code
points). The ranges' least keys are a sample of the keys by hash, evenly thinned: about one per RANGE_BYTES of text and at most
MAX_RANGES in one broadcast row, whatever the ids are. Each range also receives the rows that begin the range after it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm._common import pick, stage, table

K = 8
WINDOW = 16
SEGMENT = 16_384
#: Code points that no window reaches beyond.
SPAN = K + WINDOW - 1
HEAD = 32
RANGE_BYTES = 1 << 20
#: The table of their least keys goes to every task, once.
MAX_RANGES = 1 << 18
#: Keys that are drawn for each least key that is kept.
DRAWS = 4
_LOW = (1 << 32) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count_to(n: Column) -> Column:
    """0, 1, ... n - 1, and 0 where n is less than 1."""
    return F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))


def _hash(gram: Column) -> Column:
    return F.shiftright(F.xxhash64(gram), 8).bitwiseAND(F.lit((1 << 28) - 1))


def _choice(gram: Column, inverted: Column) -> Column:
    return F.shiftleft(_hash(gram), 32) + inverted


def _pairwise(values: Column, step: int) -> Column:
    return _let(values, lambda v: F.zip_with(v, F.slice(v, F.lit(step + 1), F.size(v)), lambda x, y: F.least(x, y)))


def _minima(packed: Column) -> Column:
    """The distinct minima of all windows of WINDOW neighbours, or of all values if they are fewer."""
    for step in (1, 2, 4, 8):
        packed = _pairwise(packed, step)
    return _let(packed, lambda v: F.array_distinct(F.slice(v, F.lit(1), F.greatest(F.size(v) - WINDOW + 1, F.lit(1)))))


def _chosen_of(stretch: Column, last: Column) -> Column:
    """Distinct window minima of a stretch of text; last is the inverted position of its first code point.

    A match takes one code point and looks ahead at the gram, so a gram begins at every code point and nowhere else.
    """
    grams = F.regexp_extract_all(stretch, F.lit(f"(?s)(?=(.{{{K}}}))."), F.lit(1))
    return _minima(F.transform(grams, lambda g, i: _choice(g, last - i)))


def _stretches(text: Column) -> Column:
    """The text in stretches that begin SEGMENT code points apart and hold SEGMENT windows each; the last holds the rest.

    One pass of a pattern that counts exactly, so it neither starts over from the text's beginning nor goes deep.
    """
    over = SPAN - 1
    cut = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{SEGMENT + over}}}|.+))(?:.{{{SEGMENT}}}|.+)"), F.lit(1))
    return F.when(F.char_length(text) <= SEGMENT + over, F.array(text)).otherwise(F.filter(cut, lambda p: F.char_length(p) >= SPAN))


def chosen(text: Column, at: Column | None = None) -> Column:
    """array<long>: the distinct choices in order of position. A text shorter than K is one gram; an empty one has none.

    at: the position of the text's first code point, 0 if not given.
    """
    last = F.lit(_LOW) if at is None else F.lit(_LOW) - at
    n = F.char_length(text)
    parts = F.transform(_stretches(text), lambda p, s: _let(last - s * F.lit(SEGMENT), lambda first: _chosen_of(p, first)))
    whole = _let(parts, lambda p: F.when(F.size(p) == 1, F.get(p, F.lit(0))).otherwise(F.array_distinct(F.flatten(p))))
    return F.when(n >= K, whole).when(n > 0, F.array(_choice(text, last))).otherwise(F.array().cast("array<long>"))


def _position(choice: Column) -> Column:
    return F.lit(_LOW) - choice.bitwiseAND(F.lit(_LOW))


def chosen_of_edited(edited: Column, kept: Column, own: Column, after: Column) -> Column:
    """chosen(edited), where edited is the first `kept` code points of one text and the beginning of another.

    own and after are those texts' choices. Whether a position is chosen depends on the windows that hold it, which start at most
    WINDOW - 1 before it and read SPAN code points. So up to kept - SPAN the choices are the first text's, and from WINDOW - 1
    past the seam up to SPAN before the end the second's; only the seam and the end are chosen anew.
    """

    def between(choices: Column, low: Column, high: Column) -> Column:
        return _let(F.struct(low.alias("low"), high.alias("high")), lambda b: F.filter(choices, lambda c: (_position(c) > b["low"]) & (_position(c) <= b["high"])))

    def joined(size: Column) -> Column:
        kept, end = size["kept"], size["end"]
        same = kept - SPAN
        seam = F.greatest(same - WINDOW, F.lit(0))
        again = kept + (WINDOW - 1)
        tail = end - SPAN

        def anew(start: Column, low: Column, high: Column) -> Column:
            """Choices at positions above low and up to high, from the text after start, which is WINDOW before low or 0."""
            return _let(start, lambda at: between(chosen(F.substring(edited, at + 1, F.least(high, end) - at + SPAN), at), low, high))

        low = F.when(seam > 0, same).otherwise(-1)
        head = between(own, F.lit(-1), low)
        moved = F.transform(between(after, F.lit(WINDOW - 2), tail - kept), lambda c: c - kept)
        return F.concat(head, F.when(tail <= again + WINDOW, anew(seam, low, end)).otherwise(F.concat(anew(seam, low, again - 1), moved, anew(tail - WINDOW, tail, end))))

    return _let(F.struct(kept.alias("kept"), F.char_length(edited).alias("end")), joined)


def as_text(choices: Column) -> Column:
    """Eight hex digits a choice: seven of the hash, one of the distance to the choice before (less one; it is under WINDOW)."""

    def digits(c: Column, i: Column) -> Column:
        before = F.when(i > 0, _position(F.get(choices, i - 1))).otherwise(F.lit(-1))
        value = F.shiftleft(F.shiftright(c, 32), 4) + (_position(c) - before - 1)
        return F.substring(F.hex(value + F.lit(1 << 32)), 2, 8)

    return F.lower(F.array_join(F.transform(choices, digits), ""))


def hashes(choices: Column) -> Column:
    return F.array_distinct(F.transform(choices, lambda x: F.shiftright(x, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / F.nullif(union, F.lit(0)))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (text) and choices (array<long>) of every row; a null text counts as empty."""
    source = pick(docs, id_col, text_col).toDF("doc_id", "text")
    both = source.select(F.col("doc_id").cast("long"), chosen(F.coalesce("text", F.lit(""))).alias("choices"))
    return both.select("doc_id", as_text(F.col("choices")).alias("fingerprint"), "choices")


def _key() -> Column:
    """Rows in the order of their ids, the greatest first, and of their texts."""
    return F.struct(F.bitwise_not("doc_id").alias("down"), F.substring("text", 1, HEAD).alias("head"))


def _with_range(rows: DataFrame, bounds: Column, ranges: int) -> DataFrame:
    """rows (with key) and range, the number of the last of the sorted bounds that is not above key; there must be one.

    bounds is a scalar subquery, so no row carries it. A step of the binary search is a projection of its own, without lambdas: all
    fuse into one generated stage.
    """
    found = rows.withColumn("range", F.lit(0))
    for k in reversed(range((2 * ranges).bit_length())):
        step = F.col("range") + (1 << k)
        found = found.withColumn("range", F.when(F.get(bounds, step) <= F.col("key"), step).otherwise(F.col("range")))
    return found


def _with_next(source: DataFrame) -> DataFrame:
    """Rows with an id, laid out in ranges: range, place (1: it begins the range after, and is only there to be read)."""
    n, volume = source.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0]
    if not n:
        return source.select("doc_id", "text", F.lit(0).alias("range"), F.lit(0).alias("place"))
    ranges = min(MAX_RANGES, math.ceil((volume + 1) / RANGE_BYTES))
    return _laid_out(source, ranges, n)


def _laid_out(source: DataFrame, ranges: int, n: int) -> DataFrame:
    keyed = source.withColumn("key", _key())
    drawn = F.shiftrightunsigned(F.xxhash64("key"), 2) < int(min(1.0, DRAWS * ranges / n) * (1 << 62))
    least = keyed.agg(F.min("key").alias("least"), F.sort_array(F.collect_set(F.when(drawn, F.col("key")))).alias("drawn"))
    thin = F.filter("drawn", lambda k, i: (i % DRAWS == DRAWS - 1) & (k > F.col("least")))
    bounds = stage(least.select(F.concat(F.array("least"), thin).alias("bounds")), "bounds").scalar()
    at = _with_range(keyed, bounds, ranges).withColumns({"begins": F.get(bounds, F.col("range")) == F.col("key"), "last": F.size(bounds) - 1})
    own = F.struct("range", F.lit(0).alias("place"))
    before = F.struct(F.when(F.col("range") > 0, F.col("range") - 1).otherwise(F.col("last")).alias("range"), F.lit(1).alias("place"))
    places = F.when(F.col("begins"), F.array(own, before)).otherwise(F.array(own))
    return at.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.range", "p.place")


def edit_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text and the next document's.

    Edited: the last floor(n_chars / 3) code points give way to the first as many (or all) of the next document's, in descending
    doc_id order, the first after the last. Rows that repeat an id follow each other by text. Rows without an id have no next
    document; it counts as empty for them. Null texts count as empty. A single row is its own next document.
    """
    source = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("range").orderBy("place", F.col("doc_id").desc(), "text")
    none = F.array().cast("array<long>")
    named = _with_next(source.where("doc_id IS NOT NULL")).withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
    named = named.select("*", chosen(F.col("text")).alias("own")).withColumn("after", F.lead("own").over(order)).where("place = 0")
    lone = source.where("doc_id IS NULL").select("doc_id", "text", F.lit("").alias("next_text"), chosen(F.col("text")).alias("own"), none.alias("after"))

    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    both = named.select(*lone.columns).union(lone).select("*", (n - cut).alias("kept"))
    edited = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("kept")), F.substring("next_text", F.lit(1), n - F.col("kept"))))
    marked = edited.withColumn("other", chosen_of_edited(F.col("edited"), F.col("kept"), F.col("own"), F.col("after")))
    hashed = marked.select("*", hashes(F.col("own")).alias("own_hashes"), hashes(F.col("other")).alias("other_hashes"), hashes(F.col("after")).alias("after_hashes"))
    return hashed.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("other_hashes")).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("after_hashes")).alias("near_next"),
    )


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(table(spark, sf_dir, "documents"))
