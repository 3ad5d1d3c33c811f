"""Reports as text, from frames of a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Labels by chance to play.
LABELS = ((0.0, "OUT"), (0.25, "DOUBTFUL"), (0.5, "QUESTIONABLE"), (0.85, "PROBABLE"), (1.0, "ACTIVE"))


def status_label(chance: float) -> str:
    return next((name for top, name in LABELS if chance <= top), "ACTIVE")


def game_line(row) -> str:
    side, p = ("home", row["home_win"]) if row["home_win"] >= 0.5 else ("away", 1 - row["home_win"])
    return f"game {row['game']}: {row['home_mean']:.1f} - {row['away_mean']:.1f}, {side} wins {p:.0%}"


def summary(results: DataFrame, most: int = 50) -> str:
    return "\n".join(game_line(r) for r in results.orderBy("game").limit(most).collect())


def team_breakdown(players: DataFrame, team, most: int = 15) -> str:
    rows = players.where(players["team"] == team).orderBy(players["pts_mean"].desc(), "player").limit(most).collect()
    return "\n".join(f"{r['player']:>10} {r['pts_mean']:6.1f} +- {r['pts_std']:4.1f}  {status_label(r['played'])}" for r in rows)
