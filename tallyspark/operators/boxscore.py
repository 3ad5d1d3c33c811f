"""Features of box scores: shooting rates, usage, pace, shares, defences and their interactions.

Rows are players' games with the columns player, team, opponent, day, game_id, home (0 or 1), minutes, pts, reb, ast,
stl, blk, tov, fga, fgm, fg3a, fg3m, fta, oreb and dreb. What is known of a team or of a defence is aggregated to its
days first and joined back by them, so windows over teams run over days, not over players' rows. No feature but
est_poss reads the row's own game.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip
from . import windows as w

STATS = ("pts", "reb", "ast")
#: What a team of the league allows a game.
LEAGUE_ALLOWED = {"pts": 105.0, "reb": 42.0, "ast": 22.0}
#: Weights of fantasy points.
FANTASY = {"pts": 1.0, "reb": 1.2, "ast": 1.5, "stl": 2.0, "blk": 2.0, "tov": -1.0}


def player_games():
    return w.ordered(["player"], ["day", "game_id"])


def fantasy_points() -> Column:
    return sum((F.col(s) * k for s, k in FANTASY.items()), F.lit(0.0))


def is_home(matchup: Column) -> Column:
    """1 if a game's text has 'vs.', as home games do; null texts give 0."""
    return F.coalesce(matchup.contains("vs."), F.lit(False)).cast("int")


def daily(df: DataFrame, side: str, *columns: str) -> DataFrame:
    """Sums of the columns for each team (or opponent) and day."""
    return df.groupBy(side, "day").agg(*[F.sum(c).alias(f"day_{c}") for c in columns])


def lagged_mean(c: Column, n: int, least: int = 1, lag: int = 1) -> Column:
    """The mean over n rows of the player that end `lag` rows ago."""
    frame = player_games().rowsBetween(-(n + lag - 1), -lag)
    return F.when(F.count(c).over(frame) >= least, F.avg(c).over(frame))


def rates(df: DataFrame, windows: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """True shooting, effective field goals, threes, assists per turnover and stats per minute over the last games."""
    spec, out = player_games(), {}
    for n in windows:
        total = lambda c: F.coalesce(w.rolling(F.sum, F.col(c), spec, n), F.lit(0.0))  # noqa: B023, E731
        out[f"roll_ts_pct_{n}"] = total("pts") / (2 * (total("fga") + 0.44 * total("fta") + 1e-6))
        out[f"roll_efg_pct_{n}"] = (total("fgm") + 0.5 * total("fg3m")) / (total("fga") + 1e-6)
        out[f"roll_3pt_pct_{n}"] = total("fg3m") / (total("fg3a") + 1e-6)
        out[f"roll_ast_tov_{n}"] = total("ast") / (total("tov") + 1e-6)
        minutes = F.coalesce(w.rolling(F.sum, F.col("minutes"), spec, n), F.lit(1.0))
        out |= {f"roll_{s}_per_min_{n}": total(s) / (minutes + 1e-6) for s in STATS}
    return df.withColumns(out)


def usage(df: DataFrame, lag: int = 1) -> DataFrame:
    """A player's part of possessions, rebounds to be had, shot profile and share of points, over earlier games.

    Each ratio is that of its own game and only then lagged; lag 2 leaves the last game out as well.
    """
    spec = w.ordered(["team"], ["day"])
    mean = lambda c: w.rolling(F.avg, F.col(f"day_{c}"), spec, 10, 3)
    team = daily(df, "team", "fga", "fta", "tov", "pts").select("team", "day", F.col("day_pts").alias("__team_pts"), F.coalesce(mean("fga") + 0.44 * mean("fta") + mean("tov"), F.lit(100.0)).alias("__team_poss"))
    misses = daily(df, "opponent", "fgm", "fga").select("opponent", "day", (1 - clip(F.col("day_fgm") / (F.col("day_fga") + 1e-7), 0.3, 0.7)).alias("__misses"))
    on_court = clip(F.coalesce(F.col("minutes") / 48, F.lit(0.7)), 0.1, 1.0)
    own = F.col("fga") + 0.44 * F.col("fta")
    df = df.join(team, ["team", "day"], "left").join(misses, ["opponent", "day"], "left").withColumns({
        "__usage": F.coalesce(clip((own + F.col("tov")) / (F.col("__team_poss") + 1e-7) / on_court, 0.0, 0.5), F.lit(0.15)),
        "__three": clip(F.col("fg3a") / (F.col("fga") + 1e-7), 0.0, 1.0), "__free": clip(F.col("fta") / (F.col("fga") + 1e-7), 0.0, 1.0),
        "__share": clip(F.col("pts") / (F.col("__team_pts") + 1e-7), 0.0, 0.6), "__ts": clip(F.col("pts") / (2 * own + 1e-7), 0.3, 0.8),
    })
    kinds = (("usg_pct", "__usage", (5, 10)), ("reb_opportunity", "__misses", (5, 10)), ("3pt_freq", "__three", (10, 20)), ("ft_rate", "__free", (10,)), ("pts_share", "__share", (10,)), ("ts_pct_momentum", "__ts", (5, 10)))
    df = df.withColumns({f"roll_{name}_{n}": lagged_mean(F.col(c), n, lag=lag) for name, c, ns in kinds for n in ns})
    return df.drop("__team_pts", "__team_poss", *[c for _, c, _ in kinds])


def pace(df: DataFrame) -> DataFrame:
    """Possessions of the team's day by the usual estimate (est_poss), their mean over ten earlier days and its factor."""
    other = daily(df, "opponent", "dreb").select(F.col("opponent").alias("team"), "day", F.col("day_dreb").alias("__dreb"))
    d = {c: F.col(f"day_{c}") for c in ("fga", "fta", "oreb", "tov", "fgm")}
    second = d["oreb"] / (d["oreb"] + F.coalesce("__dreb", F.lit(10.0)) + 1e-6)
    team = daily(df, "team", *d).join(other, ["team", "day"], "left").select("team", "day", (0.5 * (d["fga"] + 0.4 * d["fta"] - 1.07 * second * (d["fga"] - d["fgm"]) + d["tov"])).alias("est_poss"))
    team = team.withColumn("team_pace_10", F.coalesce(w.rolling(F.avg, F.col("est_poss"), w.ordered(["team"], ["day"]), 10, 3), F.lit(100.0)))
    return df.join(team, ["team", "day"], "left").withColumn("pace_factor", clip(F.col("team_pace_10") / 100, 0.8, 1.2))


def shares(df: DataFrame) -> DataFrame:
    """The team's stats over ten earlier days and the player's mean share of them over five earlier games."""
    spec = w.ordered(["team"], ["day"])
    team = daily(df, "team", *STATS).withColumns({f"team_{s}_avg_10": w.rolling(F.avg, F.col(f"day_{s}"), spec, 10, 3) for s in STATS})
    df = df.join(team, ["team", "day"], "left")
    df = df.withColumns({f"__{s}": F.when(F.col(f"day_{s}") > 0, clip(F.col(s) / F.col(f"day_{s}"), 0.0, 1.0)) for s in STATS})
    return df.withColumns({f"player_{s}_share": lagged_mean(F.col(f"__{s}"), 5) for s in STATS}).drop(*[f"{p}{s}" for s in STATS for p in ("__", "day_")])


def defence(df: DataFrame) -> DataFrame:
    """What the opponent has allowed on its earlier days against the league, and how the player does against it."""
    spec, mine, versus = w.ordered(["opponent"], ["day"]), player_games(), w.ordered(["player", "opponent"], ["day", "game_id"])
    out = {}
    for s, league in LEAGUE_ALLOWED.items():
        out[f"opp_{s}_allowed_10"] = w.rolling(F.avg, F.col(f"day_{s}"), spec, 10, 3)
        out[f"roll_opp_def_{s}_5"] = w.rolling(F.avg, F.col(f"day_{s}"), spec, 5, 2) / league
    allowed = daily(df, "opponent", *STATS).withColumns(out).drop(*[f"day_{s}" for s in STATS])
    norm = {s: F.col(f"opp_{s}_allowed_10") / league for s, league in LEAGUE_ALLOWED.items()}
    df = df.join(allowed, ["opponent", "day"], "left")
    df = df.withColumn("opp_def_rating", F.coalesce(sum(norm.values(), F.lit(0.0)) / len(norm), F.lit(1.0)))
    penalty, home = F.col("opp_def_rating") * 0.05, F.col("home")
    df = df.withColumns({
        "def_difficulty": 2 - F.col("opp_def_rating"), "opp_def_rank": w.percentile_rank(F.col("opp_def_rating"), ["day"]),
        "def_matchup_home_adj": 1.05 - (1 - home) * penalty, "def_matchup_away_adj": 1.0 - home * penalty,
        **{f"relative_opp_def_{s}": F.coalesce(c, F.lit(1.0)) for s, c in norm.items()}, **{f"def_matchup_{s}_impact": 2 - c for s, c in norm.items()},
        **{f"def_overage_{s}": w.rolling(F.avg, F.col(s), versus, None) / (w.rolling(F.avg, F.col(s), mine, None) + 1e-6) - 1 for s in STATS},
        **{f"def_matchup_trend_{s}": w.rolling(F.avg, F.col(s), mine, 10, 3) / (F.col("opp_def_rating") + 1e-6) for s in STATS},
    })
    return df.withColumn("quality_def_avoidance", 1 - F.col("opp_def_rank"))


def interactions(df: DataFrame) -> DataFrame:
    """Means against the opponent's defence and on days without rest; needs what `defence` adds."""
    spec = player_games()
    gap = w.gaps(F.col("day"), spec)
    mean = lambda c: w.rolling(F.avg, F.col(c), spec, 10, 3)
    return df.withColumns({
        **{f"{s}_potential": mean(s) * F.col(f"relative_opp_def_{s}") for s in STATS},
        "b2b_impact_factor": mean("pts") * (clip(gap, 0, 7) <= 1).cast("int") * 0.9, "b2b_min_impact": (gap == 1).cast("int") * mean("minutes"),
    })


def advanced(df: DataFrame) -> DataFrame:
    """Usage scaled to 48 minutes, with pace; defences met lately; fantasy points. Needs what `defence` and `pace` add.

    The strength of schedule reads each opponent's defence as it stood at that game, never a later one.
    """
    poss = lambda p: F.col(f"{p}fga") + 0.44 * F.col(f"{p}fta") + F.col(f"{p}tov")
    df = df.join(daily(df, "team", "fga", "fta", "tov"), ["team", "day"], "left")
    minutes = F.when(F.col("minutes") == 0, 1.0).otherwise(F.col("minutes"))
    df = df.withColumns({"__usage": clip(poss("") / (poss("day_") + 1e-6) * 48 / minutes, 0.0, 0.4), "__met": F.coalesce("opp_pts_allowed_10", F.lit(105.0)), "__fantasy": fantasy_points()})
    df = df.withColumns({"roll_usg48_10": lagged_mean(F.col("__usage"), 10, 3), "sos_opp_def_5": lagged_mean(F.col("__met"), 5, 2), "roll_fantasy_pts_10": lagged_mean(F.col("__fantasy"), 10, 3)})
    return df.withColumn("pace_adj_usage", F.col("roll_usg48_10") * F.col("pace_factor")).drop("__usage", "__met", "__fantasy", "day_fga", "day_fta", "day_tov")
