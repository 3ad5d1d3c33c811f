"""Monte Carlo over rosters. Draws depend on (seed, key, simulation, slot) alone, so a task that runs again draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, normal, uniform

#: Correlations of PTS, REB, AST, STL, BLK, TOV within a player.
STATS = ("pts", "reb", "ast", "stl", "blk", "tov")
CORRELATION = (
    (1.0, 0.15, 0.20, 0.10, 0.05, 0.25), (0.15, 1.0, -0.05, 0.05, 0.30, 0.10), (0.20, -0.05, 1.0, 0.15, -0.05, 0.35),
    (0.10, 0.05, 0.15, 1.0, 0.05, 0.10), (0.05, 0.30, -0.05, 0.05, 1.0, 0.05), (0.25, 0.10, 0.35, 0.10, 0.05, 1.0),
)


def lower_triangle(matrix) -> list[list[float]]:
    """The Cholesky factor; a matrix that isn't positive definite is shifted by its least eigenvalue first."""
    import numpy as np

    m = np.array(matrix, float)
    least = float(np.linalg.eigvalsh(m).min())
    if least <= 1e-8:
        m = m + np.eye(len(m)) * (1e-6 - least)
        d = np.sqrt(np.diag(m))
        m = m / d[:, None] / d[None, :]
    return np.linalg.cholesky(m).tolist()


def with_simulations(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def draw_around(df: DataFrame, mean: str, std: str, n: int, seed: int, *key: str) -> DataFrame:
    return with_simulations(df, n).withColumn("drawn", F.col(mean) + F.col(std) * normal(seed, *[F.col(k) for k in key], F.col("sim")))


def line_summary(draws: DataFrame, keys: list[str], line: Column) -> DataFrame:
    d = F.col("drawn")
    return draws.groupBy(*keys).agg(
        F.avg((d > line).cast("double")).alias("p_over"), F.avg((d < line).cast("double")).alias("p_under"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"),
        F.percentile(d, [0.025, 0.975]).alias("interval"))


def correlated(seed: int, *key: Column, factor: list[list[float]] | None = None) -> list[Column]:
    """Six standard normals with CORRELATION, one per stat."""
    factor = factor or lower_triangle(CORRELATION)
    z = [normal(seed, *key, F.lit(s)) for s in STATS]
    return [sum((z[j] * F.lit(row[j]) for j in range(i + 1)), F.lit(0.0)) for i, row in enumerate(factor)]


def simulate_games(roster: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Players' stats in every simulation of every game.

    roster: game, team, player, home boolean, play_probability, minutes, std_minutes, and mean_/std_ of each
    of STATS. A team has five active players at least: those likeliest to play are forced in. Minutes are
    drawn and brought to 240, means scale with them, a game has one pace and a team one strength a
    simulation, and players' noise is correlated between stats.
    """
    key = [F.col(c) for c in ("game", "team", "player", "sim")]
    team, side = Window.partitionBy("game", "sim", "team"), [F.col(c) for c in ("game", "team", "sim")]
    df = with_simulations(roster, n)
    df = df.withColumn("active", uniform(seed, *key, "active") < F.col("play_probability"))
    order = F.row_number().over(team.orderBy(F.desc("play_probability"), F.desc("minutes"), "player"))
    df = df.withColumn("__order", order).withColumn("active", F.col("active") | ((F.sum(F.col("active").cast("int")).over(team) < 5) & (F.col("__order") <= 5)))
    drawn = clip(F.col("minutes") + F.col("std_minutes") * normal(seed, *key, "minutes"), 0, 48)
    df = df.withColumn("__m", F.when(F.col("active"), drawn).otherwise(0.0)).withColumn("__total", F.sum("__m").over(team))
    df = df.withColumn("sim_minutes", F.when(F.col("__total") > 0, F.least(F.col("__m") * 240 / F.col("__total"), F.lit(48.0))).otherwise(0.0))
    pace = 1 + 0.04 * normal(seed, F.col("game"), F.col("sim"), "pace")
    strength = 1 + 0.05 * normal(seed, *side, "strength") + F.when(F.col("home"), 0.0115).otherwise(-0.0115)
    scale = F.when(F.col("minutes") > 0, F.col("sim_minutes") / F.col("minutes")).otherwise(0.0) * pace * strength
    df = df.withColumn("__scale", scale)
    noise = correlated(seed, *key)
    stats = {f"sim_{s}": F.when(F.col("active"), F.greatest(F.col(f"mean_{s}") * F.col("__scale") + F.col(f"std_{s}") * 0.5 * z, F.lit(0.0))).otherwise(0.0) for s, z in zip(STATS, noise)}
    return df.withColumns(stats).drop("__order", "__m", "__total", "__scale")


def gamma(alpha: Column, seed: int, *key) -> Column:
    """A gamma draw by the Wilson-Hilferty transform of a normal one: all on the JVM, and close for alpha of 1 and more."""
    z = normal(seed, *key, "gamma")
    return F.greatest(alpha * F.pow(1 - 1 / (9 * alpha) + z / (3 * F.sqrt(alpha)), F.lit(3.0)), F.lit(1e-9))


def allocate_points(sims: DataFrame, usage: str = "mean_pts", concentration: float = 70.0, high: float = 118.0, seed: int = 7) -> DataFrame:
    """A team's points of a simulation dealt out anew by Dirichlet shares around the players' own.

    In a game over `high` points the two players of most usage gain 1.5 each and the two of least lose
    1; the team's total stays.
    """
    team = Window.partitionBy("game", "sim", "team")
    key = [F.col(c) for c in ("game", "team", "player", "sim")]
    total = F.sum("sim_pts").over(team)
    df = sims.withColumn("__total", total).withColumn("__a", F.when(F.col("__total") > 0, F.col("sim_pts") / F.col("__total") * concentration).otherwise(0.0))
    df = df.withColumn("__g", F.when(F.col("__a") > 0, gamma(F.greatest("__a", F.lit(1e-3)), seed, *key)).otherwise(0.0))
    whole = F.sum("__g").over(team)
    df = df.withColumn("__p", F.when(whole > 0, F.col("__total") * F.col("__g") / whole).otherwise(0.0))
    best, least = (F.row_number().over(team.orderBy(c, "player")) for c in (F.desc(usage), F.asc(usage)))
    moved = F.when(best <= 2, F.col("__p") + 1.5).when(least <= 2, F.greatest(F.col("__p") - 1, F.lit(0.0))).otherwise(F.col("__p"))
    df = df.withColumn("__p", F.when(F.col("__total") > high, moved).otherwise(F.col("__p")))
    again = F.sum("__p").over(team)
    return df.withColumn("sim_pts", F.when(again > 0, F.col("__p") * F.col("__total") / again).otherwise(F.col("__p"))).drop("__total", "__a", "__g", "__p")


def game_results(sims: DataFrame, seed: int = 7) -> DataFrame:
    """home and away points of each simulation; a margin of at most 3 goes to overtime, of which home wins 52 %."""
    sides = sims.groupBy("game", "sim").agg(F.sum(F.when(F.col("home"), F.col("sim_pts"))).alias("home_pts"), F.sum(F.when(~F.col("home"), F.col("sim_pts"))).alias("away_pts"))
    extra = clip(5 + 2.5 * normal(seed, F.col("game"), F.col("sim"), "overtime"), 0, 15)
    won = uniform(seed, F.col("game"), F.col("sim"), "won") > 0.48
    late = F.abs(F.col("home_pts") - F.col("away_pts")) <= 3
    out = sides.withColumns({"overtime": late, "__x": F.when(late, extra).otherwise(0.0), "__w": won, "__top": F.greatest("home_pts", "away_pts")})
    side = lambda c, wins: F.when(late, F.col("__top") + F.col("__x") + F.when(wins, 1.0).otherwise(0.0)).otherwise(F.col(c))
    return out.withColumns({"home_pts": side("home_pts", F.col("__w")), "away_pts": side("away_pts", ~F.col("__w"))}).drop("__x", "__w", "__top")


def summarize_games(results: DataFrame) -> DataFrame:
    q = [0.005, 0.05, 0.95, 0.995]
    return results.groupBy("game").agg(
        F.avg((F.col("home_pts") > F.col("away_pts")).cast("double")).alias("home_win"), F.avg("home_pts").alias("home_mean"), F.avg("away_pts").alias("away_mean"),
        F.stddev_pop("home_pts").alias("home_std"), F.stddev_pop("away_pts").alias("away_std"), F.percentile("home_pts", q).alias("home_interval"), F.avg(F.col("overtime").cast("double")).alias("overtime"))


def summarize_players(sims: DataFrame) -> DataFrame:
    return sims.groupBy("game", "team", "player").agg(
        F.avg(F.col("active").cast("double")).alias("played"), *[F.avg(f"sim_{s}").alias(f"{s}_mean") for s in STATS], *[F.stddev_pop(f"sim_{s}").alias(f"{s}_std") for s in STATS],
        F.percentile("sim_pts", [0.025, 0.975]).alias("pts_interval"))


def simulate_possessions(teams: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Possession by possession, a state machine that no relational operator expresses.

    teams: game, home boolean, players array<struct<player long, usage double, fg2 double, fg3 double, ft double, tov double, orb double>>.
    Every (game, simulation) is a row of its own, so work is spread evenly however games are grouped.
    """
    import pandas as pd

    sides = teams.groupBy("game").agg(F.max(F.when(F.col("home"), F.col("players"))).alias("h"), F.max(F.when(~F.col("home"), F.col("players"))).alias("a"))
    rows = with_simulations(sides, n).repartition("game", "sim")

    def run(batches):
        import zlib

        import numpy as np

        for pdf in batches:
            out = []
            for game, home, away, sim in zip(pdf["game"], pdf["h"], pdf["a"], pdf["sim"]):
                rng = np.random.default_rng(zlib.crc32(f"{seed}|{game}|{sim}".encode()))
                score, turns = [0, 0], int(np.clip(rng.normal(99, 4), 85, 115))
                for k in range(2 * turns):
                    side = k % 2
                    five = (home, away)[side]
                    use = np.array([p["usage"] for p in five])
                    p = five[int(rng.choice(len(five), p=use / use.sum()))]
                    second = True
                    while second:
                        second = False
                        if rng.random() < p["tov"]:
                            break
                        three = rng.random() < min(0.55, max(0.15, p["usage"] * (1.5 if p["fg3"] > 0.38 else 0.8)))
                        made = rng.random() < (p["fg3"] if three else p["fg2"])
                        score[side] += (3 if three else 2) if made else 0
                        if rng.random() < 0.23 * (0.8 if three else 1.2):
                            score[side] += int((rng.random(int(rng.choice([1, 2, 3], p=[0.15, 0.7, 0.15]))) < p["ft"]).sum())
                        elif not made:
                            second = rng.random() < p["orb"]
                out.append((game, sim, turns, score[0], score[1]))
            yield pd.DataFrame(out, columns=["game", "sim", "possessions", "home_pts", "away_pts"])

    return rows.mapInPandas(run, "game long, sim int, possessions int, home_pts int, away_pts int")
