"""Questions over a table of projections: one with --ask or --player, --stat and --line, else a loop."""

from __future__ import annotations

import argparse

from .functions import querylang as q


def arguments(args=None):
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--projections", required=True, help="Parquet with player, team, opponent and {stat}_mean, {stat}_std")
    a.add_argument("--ask")
    a.add_argument("-p", "--player")
    a.add_argument("-s", "--stat", default="pts", choices=sorted(set(q.STATS.values())))
    a.add_argument("-l", "--line", type=float)
    a.add_argument("-o", "--opponent")
    a.add_argument("--compare", nargs="+")
    a.add_argument("--list-players", action="store_true")
    a.add_argument("--json", action="store_true")
    return a.parse_args(args)


def question(a) -> q.Question | None:
    if a.list_players:
        return q.Question("list")
    if a.compare:
        return q.Question("compare", stat=a.stat, compare=tuple(a.compare))
    if a.player:
        opponent = a.opponent.lower() if a.opponent else None
        return q.Question("over_under", a.player, a.stat, a.line, "over", opponent) if a.line is not None else q.Question("projection", a.player, a.stat, opponent=opponent)
    return q.parse(a.ask) if a.ask else None


def show(spark, asked: q.Question, projections, as_json: bool) -> None:
    out = q.answer(asked, projections)
    if as_json:
        for r in q.as_json(out).limit(200).collect():
            print(r.json)
    else:
        out.show(50, truncate=False)


def main(args=None) -> None:
    from pyspark.sql import SparkSession

    a = arguments(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    projections = spark.read.parquet(a.projections)
    if asked := question(a):
        return show(spark, asked, projections, a.json)
    context = None
    while True:
        try:
            asked = q.parse(input("> "), context)
        except EOFError:
            return None
        if asked.kind == "exit":
            return None
        if asked.kind in ("help", "unknown"):
            print("PLAYER over|under LINE STAT [vs TEAM], compare A and B STAT, PLAYER projection, list players, exit")
            continue
        show(spark, asked, projections, a.json)
        context = asked if asked.player else context


if __name__ == "__main__":
    main()
