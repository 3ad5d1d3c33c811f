"""The feature pipeline: named groups of columns over a per-entity log, composed in dependency order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, finite, fourier
from . import windows as w


@dataclass(frozen=True)
class Log:
    """Names of a log's columns; order ends with a unique tie-break."""

    entity: str
    order: tuple[str, ...]
    day: str
    opponent: str
    team: str
    stats: tuple[str, ...]
    minutes: str

    def spec(self, *keys: str):
        return w.ordered(keys or [self.entity], list(self.order))


@dataclass(frozen=True)
class FeatureGroup:
    """A named step DataFrame -> DataFrame and the groups that it needs."""

    name: str
    create: Callable[[DataFrame, Log], DataFrame]
    depends_on: tuple[str, ...] = ()


REGISTRY: dict[str, FeatureGroup] = {}


def group(name: str, *depends_on: str):
    def keep(f):
        REGISTRY[name] = FeatureGroup(name, f, depends_on)
        return f

    return keep


def ordered_groups(names=None) -> list[FeatureGroup]:
    """The groups and all that they need, each after what it needs."""
    out: dict[str, FeatureGroup] = {}

    def visit(name: str, path: tuple[str, ...]):
        if name in path:
            raise ValueError(f"feature groups need each other: {' -> '.join((*path, name))}")
        if name not in out:
            for d in REGISTRY[name].depends_on:
                visit(d, (*path, name))
            out[name] = REGISTRY[name]

    for n in names or REGISTRY:
        visit(n, ())
    return list(out.values())


def build(df: DataFrame, log: Log, names=None) -> DataFrame:
    """df with all features. Groups over one key share its sort: Spark plans one exchange for each key."""
    before = set(df.columns)
    for g in ordered_groups(names):
        df = g.create(df, log)
    twice = [c for c in set(df.columns) if df.columns.count(c) > 1]
    if twice:
        raise ValueError(f"features defined twice: {sorted(twice)}")
    kinds = dict(df.dtypes)
    return df.withColumns({c: finite(F.col(c)) for c in df.columns if c not in before and kinds[c] == "double"})


@group("rolling")
def _rolling(df, log):
    spec, out = log.spec(), {}
    for s in log.stats:
        for n in (3, 5, 10, 20, 50):
            r = lambda f: w.rolling(f, F.col(s), spec, n, w.least_rows(n))  # noqa: B023, E731
            out[f"roll_{s}_avg_{n}"] = r(F.avg)
            if n >= 5:
                out[f"roll_{s}_std_{n}"] = r(F.stddev_samp)
            if n in (10, 20):
                out[f"roll_{s}_min_{n}"], out[f"roll_{s}_max_{n}"], out[f"roll_{s}_range_{n}"] = r(F.min), r(F.max), r(F.max) - r(F.min)
    return df.withColumns(out)


@group("efficiency")
def _efficiency(df, log):
    spec = log.spec()
    total = lambda c, n: F.coalesce(w.rolling(F.sum, F.col(c), spec, n), F.lit(0.0))
    return df.withColumns({f"{s}_per_min_{n}": total(s, n) / (total(log.minutes, n) + 1e-6) for s in log.stats for n in (5, 10, 20)})


@group("momentum")
def _momentum(df, log):
    spec = log.spec()
    out = {f"{s}_ewma_{n}": w.ewma(F.col(s), spec, n) for s in log.stats for n in (3, 5, 10, 20)}
    out |= {f"{s}_season_avg": w.rolling(F.avg, F.col(s), spec, None) for s in log.stats}
    out |= {f"{s}_trend_{a}_{b}": w.trend(F.col(s), spec, a, b) for s in log.stats for a, b in ((3, 10), (5, 20))}
    df = df.withColumns(out)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return df.withColumns({f"{s}_{name}": flag(test(F.col(f"{s}_ewma_3"), F.col(f"{s}_ewma_10"))) for s in log.stats for name, test in (("hot", lambda a, b: a > 1.15 * b), ("cold", lambda a, b: a < 0.85 * b))})


@group("rest")
def _rest(df, log):
    spec = log.spec()
    df = df.withColumn("days_since_last", w.gaps(F.col(log.day), spec)).withColumn("__lag", F.coalesce(F.lag(log.minutes).over(spec), F.lit(0.0)))
    total = lambda n: F.sum("__lag").over(spec.rowsBetween(1 - n, 0))
    df = df.withColumns({"rest_days": clip(F.col("days_since_last"), 0, 7), "is_b2b": (F.col("days_since_last") == 1).cast("int"), "mins_last_3": total(3), "mins_last_7": total(7)})
    return df.withColumn("fatigue_score", 0.4 * F.col("mins_last_3") / 100 + 0.3 * F.col("is_b2b") + 0.3 * (4 - clip(F.col("rest_days"), 0, 4))).drop("__lag")


@group("matchup")
def _matchup(df, log):
    spec = log.spec(log.entity, log.opponent)
    return df.withColumns({f"vs_opp_{s}_{name}": w.rolling(F.avg, F.col(s), spec, n) for s in log.stats for name, n in (("avg", None), ("recent", 5))})


@group("team")
def _team(df, log):
    """On the grain of a team's days, not of its players' rows."""
    daily = df.groupBy(log.team, log.day).agg(*[F.sum(s).alias(f"__{s}") for s in log.stats])
    spec = w.ordered([log.team], [log.day])
    daily = daily.select(log.team, log.day, *[w.rolling(F.avg, F.col(f"__{s}"), spec, 10, 3).alias(f"team_{s}_avg_10") for s in log.stats])
    df = df.join(daily, [log.team, log.day], "left")
    lag = lambda s: F.lag(s).over(log.spec())
    first = log.stats[0]
    return df.withColumns({f"{s}_share": clip(lag(s) / F.col(f"team_{s}_avg_10"), 0, 1) for s in log.stats} | {"pace_factor": clip(F.coalesce(F.col(f"team_{first}_avg_10") / 100, F.lit(1.0)), 0.8, 1.2)})


@group("opponent", "rolling")
def _opponent(df, log):
    """What an opponent has allowed on its days before, and how that compares with the league."""
    daily = df.groupBy(log.opponent, log.day).agg(*[F.avg(s).alias(f"__{s}") for s in log.stats])
    spec = w.ordered([log.opponent], [log.day])
    daily = daily.select(log.opponent, log.day, *[w.rolling(F.avg, F.col(f"__{s}"), spec, 5, 2).alias(f"opp_{s}_allowed_5") for s in log.stats])
    league = df.agg(*[F.avg(s).alias(f"__league_{s}") for s in log.stats])
    df = df.join(daily, [log.opponent, log.day], "left").crossJoin(F.broadcast(league))
    df = df.withColumns({f"relative_opp_{s}": F.coalesce(F.col(f"opp_{s}_allowed_5") / F.col(f"__league_{s}"), F.lit(1.0)) for s in log.stats}).drop(*[f"__league_{s}" for s in log.stats])
    mean = sum((F.col(f"relative_opp_{s}") for s in log.stats), F.lit(0.0)) / len(log.stats)
    df = df.withColumn("opp_def_rating", mean).withColumn("def_difficulty", 2 - F.col("opp_def_rating"))
    return df.withColumns({"opp_def_rank": w.percentile_rank(F.col("opp_def_rating"), [log.day])} | {f"{s}_potential": F.col(f"roll_{s}_avg_10") * F.col(f"relative_opp_{s}") for s in log.stats})


@group("season")
def _season(df, log):
    parts = {k: fourier(F.col(log.day), k) for k in (1, 2)}
    return df.withColumns({f"season_{n}_{k}": c for k, cs in parts.items() for n, c in zip(("sin", "cos"), cs)})


@group("encodings", "momentum")
def _encodings(df, log):
    df = w.with_overall(df, **{f"__g_{s}": F.avg(s) for s in log.stats})
    n, out = w.count_before(log.spec()), {}
    team, tn = log.spec(log.team), w.count_before(log.spec(log.team))
    for s in log.stats:
        mean, g = F.col(f"{s}_season_avg"), F.col(f"__g_{s}")
        out[f"{s}_bayesian"] = w.shrunk(mean, n + 1, g, 10)
        out[f"{s}_entity_te"] = F.coalesce(w.shrunk(mean, n, g, 20), g)
        out[f"{s}_team_te"] = F.coalesce(w.shrunk(w.rolling(F.avg, F.col(s), team, None), tn, g, 20), g)
        spread = w.rolling(F.stddev_samp, F.col(s), log.spec(), None, 2)
        out[f"{s}_z"] = (F.col(f"roll_{s}_avg_5") - mean) / (F.when(spread > 0, spread).otherwise(1.0) + 1e-6) if f"roll_{s}_avg_5" in df.columns else F.lit(0.0)
    return df.withColumns(out).drop(*[f"__g_{s}" for s in log.stats])
