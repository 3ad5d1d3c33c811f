"""Records of recent games, densities, buffers and folds over ordered histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import recent_distinct, recent_trend
from .windows import previous


def game_records(df: DataFrame, keys: Sequence[str], day: str, order: Sequence[Column], k: int = 5, made: str = "fgm", tried: str = "fga", won: str = "wl", match: str = "matchup") -> DataFrame:
    """The k newest games of a key, one per day, with shooting per cent, result and home flag."""
    out = recent_distinct(df, keys, day, order, k)
    extra = {}
    if made in df.columns and tried in df.columns:
        extra["fg_pct"] = F.when(F.col(tried) > 0, F.round(F.col(made) / F.col(tried) * 100, 1)).otherwise(0.0)
    if won in df.columns:
        extra["won"] = F.col(won) == "W"
    if match in df.columns:
        extra["is_home"] = F.col(match).contains("vs.")
    return out.withColumns(extra) if extra else out


def player_context(df: DataFrame, player: str, opponent: str, day: str, order: Sequence[Column], value: str) -> DataFrame:
    """Per player and opponent: mean of the last five games, of the last five against the opponent, and the trend."""
    last = recent_distinct(df, [player], day, order, 5)
    trend = recent_trend(last, [player], value)
    recent = last.groupBy(player).agg(F.avg(value).alias("recent_mean"), F.count("*").alias("games"))
    versus = recent_distinct(df, [player, opponent], day, order, 5).groupBy(player, opponent).agg(F.avg(value).alias("versus_mean"), F.count("*").alias("versus_games"))
    return versus.join(recent, player).join(trend.select(player, "change", "trend"), player)


def mode_of_density(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The place of the highest Gaussian density on 200 points between a key's extremes; the mean of under 3 values.

    A key's values go to one task: keys are simulated quantities, of as many values as there are simulations.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("mode", T.DoubleType())])
    names = list(keys)

    def mode(pdf):
        import numpy as np

        v = pdf[column].dropna().to_numpy(float)
        out = pdf[names].head(1).copy()
        spread = v.std(ddof=1) if len(v) > 1 else 0.0
        if len(v) < 3:
            out["mode"] = float(v.mean()) if len(v) else None
        elif spread == 0:
            out["mode"] = float(np.median(v))
        else:
            grid = np.linspace(v.min(), v.max(), 200)
            width = spread * len(v) ** -0.2
            out["mode"] = float(grid[np.exp(-0.5 * ((grid[:, None] - v) / width) ** 2).sum(axis=1).argmax()])
        return out

    return df.select(*keys, column).groupBy(*keys).applyInPandas(mode, schema)


def inverse_error_blend(df: DataFrame, keys: Sequence[str], order: Sequence[str], truth: str, models: Sequence[str], last: int = 50) -> DataFrame:
    """Models' predictions weighted by the inverse of their mean absolute error over the key's last rows before; evenly where there are none."""
    frame = previous(Window.partitionBy(*keys).orderBy(*order), last)
    errors = {m: F.avg(F.abs(F.col(m) - F.col(truth))).over(frame) for m in models}
    weights = {m: F.coalesce(1 / (e + 1e-6), F.lit(1.0)) for m, e in errors.items()}
    df = df.withColumns({f"__w_{m}": w for m, w in weights.items()})
    total = sum((F.col(f"__w_{m}") for m in models), F.lit(0.0))
    blend = sum((F.col(m) * F.col(f"__w_{m}") for m in models), F.lit(0.0)) / total
    return df.withColumn("blended", blend).drop(*[f"__w_{m}" for m in models])


def stability(df: DataFrame, key: str, order: Sequence[str], members: str, first: float = 0.5) -> DataFrame:
    """Per key, folded over its ordered lineups: .7 of the old value and .3 of the share that stays in place."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, members))).alias("__rows"))
    pairs = F.arrays_zip(F.slice("__rows", 1, F.greatest(F.size("__rows") - 1, F.lit(0))).alias("a"), F.slice("__rows", 2, F.greatest(F.size("__rows") - 1, F.lit(0))).alias("b"))
    same = lambda p: F.size(F.filter(F.zip_with(p["a"][members], p["b"][members], lambda x, y: x == y), lambda t: t)) / F.lit(5.0)
    return rows.select(key, F.aggregate(F.transform(pairs, same), F.lit(first), lambda s, x: 0.7 * s + 0.3 * x).alias("stability"), F.size("__rows").alias("n"))


def team_constraint(df: DataFrame, group: Sequence[str], value: str, target: str, low: float = 0.7, high: float = 1.3) -> DataFrame:
    """The group's values scaled towards its target, by a ratio within bounds."""
    total = F.sum(value).over(Window.partitionBy(*group))
    ratio = F.least(F.greatest(F.col(target) / total, F.lit(low)), F.lit(high))
    return df.withColumn(f"{value}_scaled", F.when(total > 0, F.col(value) * ratio).otherwise(F.col(value)))
