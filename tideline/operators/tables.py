"""Keeping tables: new keys, upserts, checkpoints, migrations, parsing, rosters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.columns import normal_name
from tideline.operators.windows import r6


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Each key's last n rows. Spark prunes by rank before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def warm_start(df: DataFrame, date: str, ends: Mapping[str, str], scored_days: int) -> DataFrame:
    """Per split what it may see (all rows up to its own end, from the start of history) and what of it is scored. One scan."""
    splits = F.explode(F.array(*[F.struct(F.lit(k).alias("split"), F.lit(v).cast("date").alias("until")) for k, v in ends.items()])).alias("s")
    seen = df.select(date, splits).where(F.col(date) <= F.col("s.until"))
    return seen.groupBy(F.col("s.split").alias("split")).agg(F.count("*").alias("n_context"), F.count_if(F.datediff("s.until", date) < scored_days).alias("n_scored"), F.max(date).alias("last_seen"))


def wide_from_long(rows: DataFrame) -> DataFrame:
    """Two rows a game -> one, by a single aggregation instead of a self-join."""
    home = F.col("is_home")
    pick = lambda c, cond, name: F.max(F.when(cond, F.col(c))).alias(name)
    both = rows.groupBy("game_id").agg(pick("team", home, "home"), pick("team", ~home, "away"), pick("pts", home, "pts_home"), pick("pts", ~home, "pts_away"))
    return both.where("home IS NOT NULL AND away IS NOT NULL")


def new_rows(df: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return df.join(stored.select(*keys), list(keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Per key the row of the highest version, of either table."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r"))
    return best.select(*keys, "r.*")


def carry_forward(old: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batch, and old rows whose key is not in it."""
    return batch.unionByName(old.join(batch.select(*keys), list(keys), "left_anti"))


def high_water(df: DataFrame, by: Column, value: str) -> DataFrame:
    """One row: value at the latest `by`."""
    return df.agg(F.max_by(value, by).alias("mark"))


def key_parity(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many distinct keys are in both, only in a, only in b: one aggregation over a union, no join."""
    both = a.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    per = both.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per.agg(F.count_if(F.col("l") + F.col("r") == 2).alias("n_both"), F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("n_only_left"), F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("n_only_right"))


def on_off(df: DataFrame, entity: str, on: Column, off: Column, value: str) -> DataFrame:
    """Per entity the counts and the difference of means of two row sets; NULL where one is missing. As both sides come from one
    table, the full outer join is a conditional aggregation."""
    rows = df.where(on | off).groupBy(F.col(entity).alias("entity")).agg(F.nullif(F.count_if(on), F.lit(0)).alias("n_on"), F.nullif(F.count_if(off), F.lit(0)).alias("n_off"), F.avg(F.when(on, F.col(value))).alias("_on"), F.avg(F.when(off, F.col(value))).alias("_off"))
    return rows.select("entity", "n_on", "n_off", r6(F.col("_on") - F.col("_off")).alias("on_off"))


def full_on_off(on: DataFrame, off: DataFrame, key: str, value: str) -> DataFrame:
    """The same for two tables of one row a key: a full outer join."""
    a, b = on.select(key, F.col(value).alias("on")), off.select(key, F.col(value).alias("off"))
    return a.join(b, key, "full").withColumn("on_off", F.col("on") - F.col("off"))


def checkpoints(df: DataFrame, season: str, date: str, days: int) -> DataFrame:
    """Every `days` days from a season's first date to its last."""
    spans = df.groupBy(season).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return spans.select(season, F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {int(days)} DAYS"))).alias("as_of_date"))


INJURY_DOC = "injuries array<struct<player:long,status:string,comment:string>>"


def parse_injuries(docs: DataFrame, column: str, statuses: Sequence[str]) -> DataFrame:
    """One row per listed player of a JSON document, for the given statuses; a missing comment becomes 'unspecified'."""
    rows = docs.withColumn("_d", F.from_json(column, INJURY_DOC)).select(*[c for c in docs.columns if c != column], F.explode("_d.injuries").alias("i"))
    rows = rows.where(F.col("i.status").isin(*statuses))
    return rows.select(*[c for c in docs.columns if c != column], "i.player", "i.status", F.coalesce("i.comment", F.lit("unspecified")).alias("reason"))


def fill_forward(df: DataFrame, keys: Sequence[str], order: str, column: str, name: str) -> DataFrame:
    """The last value that is not NULL, up to and with this row."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(column, ignorenulls=True).over(w))


def merge_sides(buy: DataFrame, sell: DataFrame, key: str, cap: int) -> DataFrame:
    """Both sides' rows as one stream per key; capped: a side gave as many rows as its source returns at most."""
    rows = buy.withColumn("_b", F.lit(1)).unionByName(sell.withColumn("_b", F.lit(0)))
    n_buy = F.sum("_b")
    return rows.groupBy(key).agg(F.count("*").alias("n_ticks"), n_buy.alias("n_buy"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), ((n_buy >= cap) | (F.count("*") - n_buy >= cap)).alias("capped"))


def migrate(df: DataFrame, rename: Mapping[str, str], add: Mapping[str, Column]) -> DataFrame:
    """Renamed columns, and those of `add` that are missing, with their defaults. Running it again changes nothing."""
    out = df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})
    return out.withColumns({k: v for k, v in add.items() if k not in out.columns})


def keyed_update(df: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns take the changes' values where a change that is not NULL exists."""
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = df.join(new, list(keys), "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*df.columns)


def scrape_ids(lines: DataFrame, column: str, pattern: str, name: str) -> DataFrame:
    """Distinct numbers that the pattern's first group captures."""
    hit = lines.where(F.col(column).rlike(pattern))
    return hit.select(F.regexp_extract(column, pattern, 1).cast("long").alias(name)).distinct()


def roster(df: DataFrame, keys: Sequence[str], player: str, available: Column) -> DataFrame:
    rows = df.where(available).groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(player)).alias("_p"))
    return rows.select(*keys, "n", F.array_join(F.transform("_p", lambda x: x.cast("string")), ",").alias("players"))


def name_index(df: DataFrame, name: str, key: str) -> DataFrame:
    """Normalised name -> number of ids and the first."""
    return df.groupBy(normal_name(F.col(name)).alias("name")).agg(F.count("*").alias("n_ids"), F.min(key).alias("first_id"))


def with_upcoming(df: DataFrame, row: Mapping) -> DataFrame:
    """df and one more row that has not happened yet; columns that are not given are NULL."""
    literal = df.sparkSession.range(1).select(*[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.unionByName(literal)


def feature_columns(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(excluded)]


def upcoming(schedule: DataFrame, outcome: str) -> DataFrame:
    """Games of a schedule that have no outcome yet."""
    return schedule.where(F.col(outcome).isNull())
