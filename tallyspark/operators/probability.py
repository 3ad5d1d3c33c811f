"""Probabilities of totals, adjustments of projections, team ratings and calibration: column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, ladder, norm_cdf, quotient

#: Weights and league means of the four factors (shooting, turnovers, rebounds, free throws).
FACTOR_WEIGHT = {"efg": 0.40, "tov": 0.25, "orb": 0.20, "ft": 0.15}
LEAGUE = {"efg": 0.54, "tov": 0.135, "orb": 0.25, "ft": 0.23}
#: Performance multipliers of points, rebounds and assists by circumstance.
FATIGUE = {
    "back_to_back": {"pts": 0.92, "reb": 0.95, "ast": 0.90, "min": 0.88}, "three_in_four": {"pts": 0.95, "reb": 0.97, "ast": 0.94, "min": 0.92},
    "four_in_five": {"pts": 0.88, "reb": 0.92, "ast": 0.86, "min": 0.85}, "rested": {"pts": 1.03, "reb": 1.02, "ast": 1.04, "min": 1.02},
    "home": {"pts": 1.015, "reb": 1.01, "ast": 1.02, "min": 1.0},
}


def spread_of(low: Column, high: Column, mean: Column) -> Column:
    """Standard deviation from a 95 % interval, else a share of the mean."""
    return F.when((high > low) & (low != 0) & (high != 0), (high - low) / 3.92).otherwise(F.greatest(mean * 0.35, F.lit(1.5)))


def over_probability(mean: Column, std: Column, line: Column, available: Column | None = None) -> tuple[Column, Column]:
    """Chances of more and of less than the line; who doesn't play stays under it."""
    s = F.when(std > 0, std).otherwise(F.greatest(mean * 0.3, F.lit(1.0)))
    over = F.lit(1.0) - norm_cdf((line - mean) / s)
    if available is None:
        return over, F.lit(1.0) - over
    return over * available, (F.lit(1.0) - over) * available + (F.lit(1.0) - available)


def trend_adjustment(change: Column, recent: Column, mean: Column, modifier: float = 1.0) -> Column:
    """What a percent change of the recent mean moves a projection by; bands of 40, 25, 15 and 5 per cent."""
    bands = ((40, 0.15, 1.0), (25, 0.12, 0.8), (15, 0.10, 0.6), (5, 0.08, 0.4))
    up = [(change > t, F.least(recent - mean, mean * cap) * k) for t, cap, k in bands]
    down = [(change < -t, F.greatest(recent - mean, -mean * cap) * k) for t, cap, k in bands]
    return ladder(*up, *down, otherwise=0.0) * F.lit(modifier)


def matchup_adjustment(versus: Column, base: Column, mean: Column, weight: float = 0.35, positive: bool = True) -> Column:
    """What earlier matchups move a projection by; positive: nothing where versus or base isn't above 0."""
    share = quotient(versus - base, base)
    bands = ((0.30, 0.15, 1.0), (0.20, 0.12, 0.85), (0.10, 0.08, 0.7))
    up = [(share > t, F.least(versus - mean, mean * cap) * k) for t, cap, k in bands] + [(share > 0.05, (versus - mean) * 0.5)]
    down = [(share < -t, F.greatest(versus - mean, -mean * cap) * k) for t, cap, k in bands] + [(share < -0.05, (versus - mean) * 0.5)]
    moved = ladder(*up, *down, otherwise=0.0) * F.lit(weight)
    return F.when((versus <= 0) | (base <= 0), 0.0).otherwise(moved) if positive else moved


def defense_factor(rank: Column, sensitivity: float = 0.06) -> Column:
    """Factor of a scorer against a defence of this rank, 1 the best."""
    s = sensitivity
    return ladder((rank >= 26, 1 + 1.8 * s), (rank >= 21, 1 + 1.2 * s), (rank >= 16, 1 + 0.5 * s), (rank <= 3, 1 - 1.5 * s), (rank <= 5, 1 - s), (rank <= 10, 1 - 0.5 * s), otherwise=1.0)


def rating(efg: Column, tov: Column, orb: Column, ft: Column) -> Column:
    """Points per 100 possessions from the four factors."""
    w, m = FACTOR_WEIGHT, LEAGUE
    return 114.0 + (efg - m["efg"]) * 200 * w["efg"] + (m["tov"] - tov) * 200 * w["tov"] + (orb - m["orb"]) * 80 * w["orb"] + (ft - m["ft"]) * 100 * w["ft"]


def matchup_rating(efg: Column, tov: Column, orb: Column, ft: Column, d_efg: Column, d_tov: Column, d_orb: Column) -> Column:
    """As rating, of an offence against a defence, within 95 and 135."""
    return clip(rating((efg + (1 - d_efg) + 0.54) / 2.5, (tov + d_tov) / 2, (orb + (1 - d_orb)) / 2, ft), 95, 135)


def possessions(pace_a: Column, pace_b: Column, rest_a: Column, rest_b: Column) -> Column:
    rested = lambda r: F.when(r <= 0, 0.99).when(r >= 3, 1.01).otherwise(1.0)
    return (pace_a + pace_b) / 2 * rested(rest_a) * rested(rest_b)


def damped_pace(pace_a: Column, pace_b: Column) -> Column:
    p = (pace_a + pace_b) / 2
    return F.when(p > 103, 103 + (p - 103) * 0.5).when(p < 97, 97 - (97 - p) * 0.5).otherwise(p)


def implied_totals(total: Column, home_spread: Column) -> tuple[Column, Column]:
    """Points of home and away by the market; a negative spread favours home."""
    return (total - home_spread) / 2, (total + home_spread) / 2


def blended(model: Column, market: Column, weight: float = 0.3) -> Column:
    return model * (1 - weight) + market * weight


def total_over(predicted: Column, total: Column) -> Column:
    return clip(norm_cdf((predicted - total) / 11.0), 0.05, 0.95)


def cover(margin: Column, spread: Column) -> Column:
    return clip(norm_cdf((margin - spread) / 10.5), 0.05, 0.95)


def fatigue(stat: str, back_to_back: Column, rest: Column, week: Column, minutes3: Column) -> Column:
    """Multiplier of a stat by games and minutes of the last days."""
    f = {k: v[stat] for k, v in FATIGUE.items()}
    days = F.when(back_to_back, f["back_to_back"]).when(rest >= 3, f["rested"]).otherwise(1.0)
    load = F.when(week >= 4, f["four_in_five"]).when(week >= 3, f["three_in_four"]).otherwise(1.0)
    return days * load * F.when(minutes3 > 108, F.greatest(F.lit(0.9), 1 - (minutes3 - 108) / 120)).otherwise(1.0)


def performance(stat: str, back_to_back: Column, rest: Column, week: Column, minutes3: Column, home: Column, health: Column, form: Column) -> Column:
    venue = F.when(home, 1.0).otherwise(1 / FATIGUE["home"][stat])
    return clip(fatigue(stat, back_to_back, rest, week, minutes3) * venue * health * F.when(form != 1, 0.6 + 0.4 * form).otherwise(1.0), 0.5, 1.5)


def game_state(margin: Column, quarter: Column, seconds: Column) -> dict[str, Column]:
    gap = F.abs(margin)
    return {
        "close": gap <= 8, "blowout": gap >= F.when(quarter <= 2, 25).when(quarter == 3, 20).otherwise(15),
        "clutch": (quarter == 4) & (seconds <= 300) & (gap <= 5), "garbage": (quarter == 4) & (gap >= 20) & (seconds <= 360),
    }


def to_budget(df: DataFrame, key: str, column: str, budget: float = 240.0, cap: float = 42.0) -> DataFrame:
    """The column of a key's rows brought to the budget: a lack is spread evenly up to the cap, a surplus scaled away."""
    group = Window.partitionBy(key)
    total, n = F.sum(column).over(group), F.count(F.lit(1)).over(group)
    return df.withColumn(f"{column}_fit", F.when(total < budget, F.least(F.col(column) + (budget - total) / n, F.lit(cap))).when(total > budget, F.col(column) * budget / total).otherwise(F.col(column)))


def share_of_total(df: DataFrame, key: str, weight: Column, total: Column, name: str) -> DataFrame:
    """A key's total dealt out by weight; evenly where all weights are 0."""
    group = Window.partitionBy(key)
    w = df.withColumn("__w", weight)
    s = F.sum("__w").over(group)
    return w.withColumn(name, F.when(s > 0, total * F.col("__w") / s).otherwise(total / F.count(F.lit(1)).over(group))).drop("__w")


def calibrated(raw: Column, own_bias: Column, stat_bias: Column) -> Column:
    return clip(raw + F.when(F.coalesce(own_bias, F.lit(0.0)) != 0, own_bias).otherwise(F.coalesce(stat_bias, F.lit(0.0)) * 0.5), 0, 100)


def archetype(pts: Column, reb: Column, ast: Column, stl: Column, blk: Column) -> Column:
    """One of 16 kinds of players, by scoring band and then by strength."""
    return ladder(
        (pts >= 25, ladder((ast >= 6, "elite_playmaker"), (reb >= 8, "dominant_big"), otherwise="primary_scorer")),
        (pts >= 20, ladder((ast >= 5, "floor_general"), (reb >= 7, "interior_scorer"), (stl >= 1.2, "two_way_wing"), otherwise="secondary_scorer")),
        (pts >= 15, ladder((ast >= 4, "playmaker"), (reb >= 6, "stretch_big"), ((blk >= 1) | (stl >= 1), "defensive_anchor"), otherwise="three_level_scorer")),
        (pts >= 10, ladder((reb >= 6, "rim_protector"), (ast >= 3, "connector"), (stl >= 0.8, "three_and_d"), otherwise="role_player")),
        otherwise=ladder((reb >= 5, "rim_protector"), (ast >= 2, "facilitator"), otherwise="role_player"))
