"""Texts and JSON of scraped side tables: injuries, lineups, schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import status_probability

_INJURIES = "sports array<struct<leagues:array<struct<teams:array<struct<displayName:string,injuries:array<struct<status:string,date:string,shortComment:string,athlete:struct<displayName:string>>>>>>>>>"


def injuries(df: DataFrame, column: str) -> DataFrame:
    """Nested sports, leagues, teams and athletes -> team, player, status, play_probability, day, comment."""
    rows = df.select(F.explode(F.from_json(column, _INJURIES)["sports"]).alias("s")).select(F.explode("s.leagues").alias("l")).select(F.explode("l.teams").alias("t")).select("t.displayName", F.explode("t.injuries").alias("i"))
    return rows.select(F.col("displayName").alias("team"), F.col("i.athlete.displayName").alias("player"), F.upper("i.status").alias("status"), status_probability(F.col("i.status")).alias("play_probability"), F.to_date(F.substring("i.date", 1, 10)).alias("day"), F.col("i.shortComment").alias("comment"))


def player_text(text: Column) -> dict[str, Column]:
    """What the text of a lineup's entry says: minutes, status, position, and the name that is left."""
    status = F.regexp_extract(F.upper(text), r"\b(OUT|DOUBTFUL|QUESTIONABLE|PROBABLE|GTD|ACTIVE)\b", 1)
    position = F.regexp_extract(text, r"\b(PG|SG|SF|PF|C|G|F)\b", 1)
    name = F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)|\d+(\.\d+)?\s*(min|MIN)?", " "), r"(?i)\b(OUT|DOUBTFUL|QUESTIONABLE|PROBABLE|GTD|ACTIVE)\b|\b(PG|SG|SF|PF|C|G|F)\b", " ")
    minutes = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*(?i:min)", 1).try_cast("double")
    return {"name": F.trim(F.regexp_replace(name, r"\s+", " ")), "status": F.nullif(status, F.lit("")), "position": F.nullif(position, F.lit("")), "projected_minutes": minutes}


def remaining_games(days: Sequence[DataFrame], key: str = "game_id") -> DataFrame:
    """Daily schedules in one, each game once: from the first day that has it."""
    both = None
    for k, d in enumerate(days):
        d = d.withColumn("__k", F.lit(k))
        both = d if both is None else both.unionByName(d, allowMissingColumns=True)
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("__k"))).where("__r = 1").drop("__k", "__r")


def plausible(df: DataFrame, ranges: dict[str, tuple[float, float]], defaults: dict[str, float]) -> DataFrame:
    """Scraped numbers outside of their ranges give way to defaults."""
    return df.withColumns({c: F.coalesce(F.when(F.col(c).try_cast("double").between(a, b), F.col(c).try_cast("double")), F.lit(float(defaults[c]))) for c, (a, b) in ranges.items()})


def ranked_ratings(df: DataFrame, team: str, rating: str, static: DataFrame, least: int = 30) -> DataFrame:
    """Teams ranked by rating, the lowest first; the static table where fewer teams were read."""
    read = df.where(F.col(rating).isNotNull()).select(team, rating)
    n = read.agg(F.count("*").alias("__n"))
    chosen = read.crossJoin(F.broadcast(n)).where(F.col("__n") >= least).drop("__n").union(static.select(team, rating).crossJoin(F.broadcast(n)).where(F.col("__n") < least).drop("__n"))
    return chosen.withColumn("league_rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(rating, team)))
