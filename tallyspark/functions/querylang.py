"""The question language: parsed on the driver for one question, or as columns for many; compiled to a plan."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import recommendation

#: Words for the six stats and for the two sides of a line.
STATS = {
    "pts": "pts", "points": "pts", "point": "pts", "reb": "reb", "rebounds": "reb", "rebound": "reb", "ast": "ast", "assists": "ast", "assist": "ast",
    "stl": "stl", "steals": "stl", "steal": "stl", "blk": "blk", "blocks": "blk", "block": "blk", "tov": "tov", "turnovers": "tov", "turnover": "tov", "to": "tov",
}
SIDES = {"over": "over", "o": "over", "above": "over", "under": "under", "u": "under", "below": "under"}
EXIT, HELP = ("exit", "quit", "q", "bye"), ("help", "h", "?")
PROJECTION = ("projection", "project", "stats", "average", "predict")
_ANY_STAT = r"\b(" + "|".join(sorted(STATS, key=len, reverse=True)) + r")\b"
_ANY_SIDE = r"\b(" + "|".join(sorted(SIDES, key=len, reverse=True)) + r")\b"
_NUMBER = r"\b(\d+(?:\.\d+)?)\b"


@dataclass(frozen=True)
class Question:
    kind: str
    player: str | None = None
    stat: str | None = None
    line: float | None = None
    side: str | None = None
    opponent: str | None = None
    day: str | None = None
    compare: tuple[str, ...] = ()


def parse(text: str, context: Question | None = None) -> Question:
    """One question. A missing player or stat comes from the context, the question before."""
    low = text.lower().strip()
    if low in EXIT:
        return Question("exit")
    if low in HELP:
        return Question("help")
    if "list players" in low or "show players" in low:
        return Question("list")
    stat = next((STATS[m] for m in re.findall(_ANY_STAT, low)), None)
    names = re.findall(r"\b[A-Z][a-z']+(?:\s+[A-Z][a-z']+)*", text)
    names = [n for n in (re.sub(r"^(Compare|Over|Under|What|Project|Projection|Show|Stats|Will|Vs)\b\s*", "", n) for n in names) if n]
    if "compare" in low:
        return Question("compare", stat=stat or "pts", compare=tuple(dict.fromkeys(names))[:2])
    side = re.search(_ANY_SIDE, low)
    day = re.search(r"\b(\d{4}-\d{2}-\d{2}|today|tonight|tomorrow)\b", low)
    opponent = re.search(r"\b(?:vs\.?|against)\s+([a-z]+)", low)
    rest = {"opponent": opponent[1] if opponent else None, "day": day[1] if day else None}
    if side:
        numbers = [float(x) for x in re.findall(_NUMBER, low) if 0.5 <= float(x) <= 60]
        before = text[: side.start()].strip(" ,:") if side else ""
        player = before or (context.player if context else None)
        if numbers and player:
            return Question("over_under", player, stat or (context.stat if context and context.stat else "pts"), numbers[0], SIDES[side[1]], **rest)
    if any(re.search(rf"\b{w}\b", low) for w in PROJECTION) or (context and context.player):
        player = names[0] if names else (context.player if context else None)
        if player:
            return Question("projection", player, stat or (context.stat if context else None), **rest)
    return Question("unknown")


def parsed(text: Column) -> dict[str, Column]:
    """As parse without context, for a column of questions: kind, stat, side, line."""
    low = F.lower(F.trim(text))
    found = lambda pattern: F.nullif(F.regexp_extract(low, pattern, 1), F.lit(""))
    named = lambda words, c: F.coalesce(*[F.when(c.isin([w for w, v in words.items() if v == value]), value) for value in dict.fromkeys(words.values())])
    side, stat = named(SIDES, found(_ANY_SIDE)), named(STATS, found(_ANY_STAT))
    numbers = F.transform(F.regexp_extract_all(low, F.lit(_NUMBER), F.lit(1)), lambda x: x.cast("double"))
    line = F.get(F.filter(numbers, lambda x: (x >= 0.5) & (x <= 60)), 0)
    kind = (F.when(low.isin(*EXIT), "exit").when(low.isin(*HELP), "help").when(low.contains("list players") | low.contains("show players"), "list").when(low.contains("compare"), "compare")
            .when(side.isNotNull() & line.isNotNull(), "over_under").when(low.rlike(r"\b(" + "|".join(PROJECTION) + r")\b"), "projection").otherwise("unknown"))
    return {"kind": kind, "stat": stat, "side": F.when(kind == "over_under", side), "line": F.when(kind == "over_under", line)}


def answer(question: Question, projections: DataFrame) -> DataFrame:
    """The plan that answers a question over projections (player, team, opponent, and {stat}_mean, {stat}_std)."""
    from ..operators.probability import over_probability
    from ..operators.relational import search_name

    if question.kind == "list":
        return projections.select("player").distinct().orderBy("player")
    if question.kind == "compare":
        stat = question.stat or "pts"
        hit = F.coalesce(*[F.when(F.lower("player").contains(n.lower()), n) for n in question.compare]) if question.compare else F.lit(None)
        return projections.withColumn("asked", hit).where("asked is not null").select("asked", "player", F.col(f"{stat}_mean").alias("mean"), F.col(f"{stat}_std").alias("std")).orderBy(F.desc("mean"))
    if question.kind not in ("over_under", "projection"):
        return projections.select("player").limit(0)
    rows = search_name(projections, "player", question.player)
    if question.opponent:
        rows = rows.where(F.lower("opponent") == question.opponent)
    if question.kind == "projection":
        return rows.select("player", *[c for c in rows.columns if c.endswith(("_mean", "_std")) and (question.stat is None or c.startswith(question.stat))])
    mean, std = F.col(f"{question.stat}_mean"), F.col(f"{question.stat}_std")
    over, under = over_probability(mean, std, F.lit(question.line))
    return rows.select("player", mean.alias("mean"), std.alias("std"), F.lit(question.line).alias("line"), over.alias("p_over"), under.alias("p_under"), recommendation(over).alias("say"))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
