"""Scalar and array expressions. NULL is the only missing value: nothing here makes a NaN from non-NaN input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Severity patterns in order of precedence, what is none of them being minor; weights; reasons that are no injury.
SEVERE = r"(?i)\b(surgery|fracture|torn|tear|rupture|acl|ligament)\b"
MODERATE = r"(?i)\b(sprain|strain|bone bruise|bonebruise)\b"
SEVERITY_WEIGHTS = {"severe": 1.0, "moderate": 0.6, "minor": 0.3}
TWO_WAY = r"(?i)gleague|g league|two.?way|on assignment"
NOT_INJURED = ("rest", "rest-rest", "rest - rest", "rest - load management", "personal reasons", "personalreasons", "not with team", "notwithteam", "coach's decision", "coach'sdecision")
EARTH_RADIUS_MILES = 3958.8


def safe_div(a: Column, b: Column) -> Column:
    """a / b as double; NULL where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    """x between the bounds; NULL stays NULL."""
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def clip_impact(impact: Column, *bounds: Column) -> Column:
    """A negative impact no larger than the smallest bound."""
    return F.greatest(impact, -F.least(*bounds))


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_MILES * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


# The five coefficients and the scale of Abramowitz and Stegun, formula 7.1.26.
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_ERF_P = 0.3275911


def normal_cdf(z: Column) -> Column:
    """P(N(0, 1) <= z), off by less than 1e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + _ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(_ERF):
        poly = (poly + a) * t
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + {_ERF_P} * {x}))"
    poly = "0.0"
    for a in reversed(_ERF):
        poly = f"(({poly} + {a}) * {t})"
    tail = f"(0.5 * {poly} * exp(-{x} * {x}))"
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END"


def season_of(date: Column) -> Column:
    """'2023-24' for dates from October 2023 to September 2024."""
    start = F.when(F.month(date) >= 10, F.year(date)).otherwise(F.year(date) - 1)
    return F.format_string("%04d-%02d", start, (start + 1) % 100)


def season_id_to_text(season_id: Column, last_year: int) -> Column:
    """22023 -> '2023-24'. NULL for anything but a five-digit id with prefix 2 and a year from 1946 to last_year."""
    s = season_id.cast("string")
    year = F.try_to_number(F.substring(s, 2, 4), F.lit("9999")).cast("int")
    good = s.rlike(r"^2\d{4}$") & year.between(1946, last_year)
    return F.when(good, F.format_string("%04d-%02d", year, (year + 1) % 100))


def season_text_to_id(text: Column, last_year: int) -> Column:
    """'2023-24' -> 22023. NULL for other forms, years out of range or a second year that doesn't follow."""
    form = text.rlike(r"^\d{4}-\d{2}$")
    year = F.when(form, F.substring(text, 1, 4).cast("int"))
    follows = F.when(form, F.substring(text, 6, 2).cast("int")) == (year + 1) % 100
    return F.when(form & follows & year.between(1946, last_year), 20000 + year)


# Latin letters with accents and the letters they fold to, position by position.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēėęěğīįķľļłńņňōőřśşšţťūůűųźżžģșț"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyyaaaccddeeeegiiklllnnnoorsssttuuuuzzzgst"


def normal_name(name: Column) -> Column:
    """Lower case without accents, full stops, repeated blanks and generation suffixes."""
    folded = F.translate(F.lower(name), ACCENTED, FOLDED)
    plain = F.trim(F.regexp_replace(F.regexp_replace(folded, r"\.", ""), r"\s+", " "))
    return F.regexp_replace(plain, r" (jr|sr|ii|iii|iv|v)$", "")


def flip_name(name: Column) -> Column:
    """'Last, First' -> 'First Last'; other names stay."""
    parts = F.split(name, r",\s*", 2)
    return F.when(name.contains(","), F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).otherwise(name)


def severity(reason: Column) -> Column:
    return F.when(reason.rlike(SEVERE), "severe").when(reason.rlike(MODERATE), "moderate").otherwise("minor")


def severity_weight(reason: Column) -> Column:
    kind = severity(reason)
    out = F.lit(SEVERITY_WEIGHTS["minor"])
    for name, weight in SEVERITY_WEIGHTS.items():
        out = F.when(kind == name, F.lit(weight)).otherwise(out)
    return out


def is_two_way(reason: Column) -> Column:
    return F.coalesce(reason.rlike(TWO_WAY), F.lit(False))


def is_injury(reason: Column) -> Column:
    return ~F.coalesce(F.lower(F.trim(reason)).isin(*NOT_INJURED), F.lit(False))


def spread_line(question: Column) -> Column:
    """The signed number in brackets of 'Spread: Team (-4.5)'."""
    return F.regexp_extract(question, r"Spread:\s*.+?\s*\(([+-]?\d+(?:\.\d+)?)\)", 1).try_cast("double")


def spread_team(question: Column) -> Column:
    """The team that 'Spread: Team (-4.5)' names."""
    return F.nullif(F.regexp_extract(question, r"Spread:\s*(.+?)\s*\([+-]?\d+(?:\.\d+)?\)", 1), F.lit(""))


def totals_line(question: Column) -> Column:
    """The number of 'A vs. B: O/U 221.5'."""
    return F.regexp_extract(question, r"O/U\s*(\d+(?:\.\d+)?)", 1).try_cast("double")


def first_timestamp(*values: Column) -> Column:
    """The first value that parses as a timestamp."""
    return F.coalesce(*[F.try_to_timestamp(v) for v in values])


def matching_outcome(outcomes: Column, name: Column) -> Column:
    """0-based place of the first outcome that equals name or contains it or is contained in it; NULL if none."""
    wanted = F.lower(F.trim(name))

    def hit(o: Column) -> Column:
        o = F.lower(F.trim(o))
        return (o == wanted) | o.contains(wanted) | wanted.contains(o)

    return F.nullif(F.array_position(F.transform(outcomes, hit), True), F.lit(0)) - 1


def first_argmax(values: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def decay(age: Column, halflife: float) -> Column:
    return F.pow(F.lit(0.5), age / F.lit(float(halflife)))


def absence_decay(games_out: Column, window: float) -> Column:
    return F.greatest(F.lit(0.1), F.exp(-games_out / F.lit(float(window))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v at length 1; a zero vector is divided by 1e-9."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1e-9)).otherwise(norm))


def decayed_means(df: DataFrame, names: Sequence[str], keys: Sequence[str], order: Sequence[str], window: int, halflife: float) -> DataFrame:
    """df with, for each name, the mean of the last `window` rows before, the weight halving every `halflife` rows back; the weights
    of NULLs drop out.

    A weight 2 ** (row / halflife) gives the same mean as 0.5 ** (age / halflife), so plain sums suffice. To keep the powers small,
    rows are numbered within chunks of at least `window` rows. A frame touches at most two neighbouring chunks; its sums are
    differences of running sums within each, so a row costs the same for any window.
    """
    chunk = max(window, 32)
    spec = W.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_row", F.row_number().over(spec) - 1)
    weighted = numbered.withColumns({"_chunk": F.floor(F.col("_row") / chunk), "_w": F.pow(F.lit(2.0), (F.col("_row") % chunk) / F.lit(float(halflife)))})
    parts = {}
    for i, m in enumerate(names):
        x = F.col(m).cast("double")
        parts |= {f"_x{i}": F.coalesce(F.col("_w") * x, F.lit(0.0)), f"_n{i}": F.when(x.isNotNull(), F.col("_w")).otherwise(0.0)}
    within = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = weighted.withColumns({c: F.sum(v).over(within) for c, v in parts.items()})

    # The newest row of a frame is the one before this; the frame begins `window` rows before this one.
    newest, begin = F.floor((F.col("_row") - 1) / chunk), F.greatest(F.col("_row") - window, F.lit(0))
    chunked = W.partitionBy(*keys).orderBy("_chunk", *order)  # the same order, and that in which rows lie within chunks: no new sort
    before = chunked.rowsBetween(W.unboundedPreceding, -1)
    closed = F.last(F.when(F.col("_row") % chunk == chunk - 1, F.struct(*parts)), ignorenulls=True).over(before)
    placed = summed.withColumns({"_at": F.lag(F.struct(*parts)).over(chunked), "_off": F.lag(F.struct(*parts), window + 1).over(chunked), "_closed": closed})
    placed = placed.withColumns({"_newest": newest, "_first": F.floor(begin / chunk), "_cut": (F.col("_row") > window) & (begin % chunk != 0)})
    older = 2.0 ** (-chunk / halflife)

    def total(c: str) -> Column:
        off = F.when(F.col("_cut"), F.col(f"_off.{c}")).otherwise(0.0)
        one = F.col(f"_at.{c}") - off
        return F.when(F.col("_first") == F.col("_newest"), one).otherwise(F.col(f"_at.{c}") + older * (F.col(f"_closed.{c}") - off))

    kept = [c for c in df.columns if c not in names]
    return placed.select(*kept, *[safe_div(total(f"_x{i}"), total(f"_n{i}")).alias(m) for i, m in enumerate(names)])


def rank_pct(value: Column, *keys: str) -> Column:
    """Per group of keys: the average rank of ties over the number of non-NULL values; NULL for NULL."""
    group = W.partitionBy(*keys)
    ties = F.count("*").over(W.partitionBy(*keys, value))
    mean_rank = F.rank().over(group.orderBy(value.asc_nulls_last())) + (ties - 1) / 2.0
    return F.when(value.isNotNull(), mean_rank / F.nullif(F.count(value).over(group).cast("double"), F.lit(0.0)))


def quartile(rank: Column, n: Column) -> Column:
    """0 to 3 for ranks 1 to n, cut where equal-width quantiles of the ranks fall."""
    return F.least(F.lit(3), F.greatest(F.lit(0), F.ceil((rank - 1) * 4 / F.nullif((n - 1).cast("double"), F.lit(0.0))).cast("int") - 1))
