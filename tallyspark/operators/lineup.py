"""Starting lineups, minutes and matchups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, ladder

#: Correlations of two players' stats. Teammates by unordered pair of positions: (assists with points, points against points).
SYNERGY = {
    ("PG", "SG"): (0.30, -0.10), ("PG", "SF"): (0.28, -0.08), ("PG", "PF"): (0.22, -0.06), ("PG", "C"): (0.25, -0.05), ("SG", "SF"): (0.20, -0.10),
    ("SG", "PF"): (0.15, -0.08), ("SG", "C"): (0.18, -0.05), ("SF", "PF"): (0.15, -0.08), ("SF", "C"): (0.20, -0.06), ("PF", "C"): (0.12, -0.10),
}
#: teammates' rebounds against each other, by unordered pair.
REBOUNDS = {("C", "C"): -0.30, ("C", "PF"): -0.20, ("C", "SF"): -0.08, ("PF", "PF"): -0.25, ("PF", "SF"): -0.12, ("SF", "SF"): -0.15, ("SG", "SG"): -0.10, ("PG", "PG"): -0.05}
TEAMMATES = {"pts": -0.15, "reb": -0.10, "ast": 0.25}
OPPONENTS = {"pts": -0.02, "reb": 0.12, "ast": 0.05}


def _lookup(table: dict, a: Column, b: Column, take, default: float) -> Column:
    tests = [(((a == x) & (b == y)) | ((a == y) & (b == x)), take(v)) for (x, y), v in table.items()]
    return ladder(*tests, otherwise=default)


def pair_correlations(players: DataFrame, game: str = "game") -> DataFrame:
    """Every two players of a game (player, team, position, usage) with the correlations of their points, rebounds and assists.

    A game holds some dozens of players, so its pairs are bounded.
    """
    other = players.select(game, *[F.col(c).alias(f"{c}_2") for c in ("player", "team", "position", "usage")])
    both = players.join(other, game).where("player < player_2")
    a, b, mates = F.col("position"), F.col("position_2"), F.col("team") == F.col("team_2")
    heavy = F.when(F.col("usage") * F.col("usage_2") > 0.05, 0.05).otherwise(0.0)
    big, guard = a.isin("C", "PF") & b.isin("C", "PF"), a.isin("PG", "SG") & b.isin("PG", "SG")
    pts = F.when(mates, _lookup(SYNERGY, a, b, lambda v: v[1], TEAMMATES["pts"]) - heavy).when(guard, 0.05).when(a == b, 0.08).otherwise(OPPONENTS["pts"])
    reb = F.when(mates, _lookup(REBOUNDS, a, b, lambda v: v, TEAMMATES["reb"])).when(big, 0.20).when(a == b, 0.15).otherwise(OPPONENTS["reb"])
    ast = F.when(mates, _lookup(SYNERGY, a, b, lambda v: v[0], TEAMMATES["ast"])).when(guard, 0.10).otherwise(OPPONENTS["ast"])
    return both.select(game, "player", "player_2", pts.alias("pts_corr"), reb.alias("reb_corr"), ast.alias("ast_corr"))


def predict_lineup(rows: DataFrame, team: str, order: Sequence[Column], position: str = "position", size: int = 5) -> DataFrame:
    """Per team the first of each position, then the best of the rest, `size` in all; slot numbers them."""
    first = Window.partitionBy(team, position).orderBy(*order)
    marked = rows.withColumn("__own", (F.row_number().over(first) == 1).cast("int"))
    pick = Window.partitionBy(team).orderBy(F.desc("__own"), *order)
    return marked.withColumn("slot", F.row_number().over(pick)).where(F.col("slot") <= size).drop("__own")


def starter_rates(lineups: DataFrame, team: str, game_order: Sequence[Column], player: str, last: int = 10) -> DataFrame:
    """How often a player starts in the team's last lineups. lineups: team, game columns, starters array."""
    k = F.row_number().over(Window.partitionBy(team).orderBy(*game_order))
    recent = lineups.withColumn("__k", k).where(F.col("__k") <= last)
    games = recent.groupBy(team).agg(F.count("*").alias("__n"))
    return recent.select(team, F.explode("starters").alias(player)).groupBy(team, player).agg(F.count("*").alias("starts")).join(games, team).withColumn("starter_rate", F.col("starts") / F.col("__n")).drop("__n")


def first_lineup(sources: Sequence[tuple[DataFrame, float]], team: str, least: int = 5) -> DataFrame:
    """Per team the first source with enough starters, with its confidence. Sources: team, starters array."""
    both = None
    for k, (df, confidence) in enumerate(sources):
        df = df.where(F.size("starters") >= least).select(team, "starters", F.lit(confidence).alias("confidence"), F.lit(k).alias("__p"))
        both = df if both is None else both.union(df)
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(team).orderBy("__p"))).where("__r = 1").drop("__p", "__r")


def rule_minutes(base: Column, starter: Column, back_to_back: Column, rest: Column, home: Column) -> tuple[Column, Column]:
    """Expected minutes and their deviation without a model."""
    m = F.when(starter > 0.7, F.least(base + 2, F.lit(38.0))).when(starter < 0.3, F.greatest(base - 5, F.lit(10.0))).otherwise(base)
    m = F.when(back_to_back, F.greatest(m - 2, F.lit(15.0))).otherwise(m)
    m = F.when(rest == 0, F.greatest(m - 3, F.lit(12.0))).when(rest >= 4, F.least(m + 2, F.lit(40.0))).otherwise(m)
    return m + F.when(home, 0.5).otherwise(-0.5), F.when(starter > 0.7, 4.0).otherwise(8.0)


def minutes_spread(starter: Column, back_to_back: Column, rest: Column) -> Column:
    return F.when(starter > 0.8, 2.5).when(starter < 0.3, 8.0).otherwise(4.0) + F.when(back_to_back, 1.5).otherwise(0.0) + F.when((rest == 0) | (rest > 5), 2.0).otherwise(0.0)


def usage_boost(missing: Column, remaining: Column) -> Column:
    """Factor on the others' usage when players are missing."""
    return F.when(missing > 0, F.least(1 + 0.15 / F.greatest(remaining, F.lit(5)), F.lit(1.35))).otherwise(1.0)


def versus_team(rows: DataFrame, player: str, opponent: str, order: Sequence[Column], value: str, last: int = 10) -> DataFrame:
    """A player's last games against an opponent: count, mean, and the trend of the newest three at 15 per cent."""
    k = F.row_number().over(Window.partitionBy(player, opponent).orderBy(*order))
    recent = rows.withColumn("__k", k).where(F.col("__k") <= last)
    out = recent.groupBy(player, opponent).agg(F.count("*").alias("games"), F.avg(value).alias("mean"), F.avg(F.when(F.col("__k") <= 3, F.col(value))).alias("recent"), F.avg(F.when(F.col("__k") > 3, F.col(value))).alias("older"))
    change = (F.col("recent") - F.col("older")) / F.col("older")
    return out.withColumn("trend", ladder((change > 0.15, "up"), (change < -0.15, "down"), otherwise="flat"))


def rating_lines(off_home: Column, def_home: Column, off_away: Column, def_away: Column, pace: Column) -> tuple[Column, Column]:
    """Total and home spread from ratings, where there's no market; the home side is worth 2.5 points."""
    home, away = (off_home + def_away) / 2 * pace / 100, (off_away + def_home) / 2 * pace / 100
    return home + away, away - home - 2.5


def position_share(df: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Mean value by key and position over the key's mean, within .8 and 1.25."""
    per = df.groupBy(key, position).agg(F.avg(value).alias("__p"), F.sum(value).alias("__s"), F.count(value).alias("__n"))
    whole = Window.partitionBy(key)
    return per.select(key, position, clip(F.col("__p") / (F.sum("__s").over(whole) / F.sum("__n").over(whole)), 0.8, 1.25).alias("factor"))
