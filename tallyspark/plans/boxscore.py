"""Features of box scores over a stand-in log: an order is a game of its customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import fixed, fixed_sql
from ..operators import boxscore as b
from .registry import query, table
from .windowed import roll_sql

#: name: (factor of the order, factor of the customer, modulus, least value)
_STATS = {
    "minutes": (7, 3, 31, 10), "pts": (11, 5, 37, 2), "reb": (5, 7, 13, 1), "ast": (3, 11, 11, 1), "stl": (7, 1, 4, 0), "blk": (5, 2, 3, 0), "tov": (3, 1, 6, 0),
    "fga": (13, 3, 19, 4), "fgm": (3, 5, 9, 1), "fg3a": (7, 5, 8, 0), "fg3m": (11, 3, 5, 0), "fta": (5, 3, 9, 0), "oreb": (3, 7, 4, 0), "dreb": (7, 11, 9, 1),
}
_BOX = f"""WITH b AS (SELECT o_orderkey AS game_id, o_custkey AS player, c_nationkey AS team, (c_nationkey + 1 + o_orderkey % 24) % 25 AS opponent, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS home,
  {', '.join(f'CAST((o_orderkey*{a} + o_custkey*{c}) % {m} + {low} AS DOUBLE) AS {n}' for n, (a, c, m, low) in _STATS.items())} FROM orders JOIN customer ON c_custkey = o_custkey)"""
_P, _T, _O, _V = "PARTITION BY player ORDER BY day, game_id", "PARTITION BY team ORDER BY day", "PARTITION BY opponent ORDER BY day", "PARTITION BY player, opponent ORDER BY day, game_id"


def box(spark, sf):
    home = F.when(F.col("o_orderkey") % 2 == 0, "A vs. B").otherwise("A @ B")
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("game_id"), F.col("o_custkey").alias("player"), F.col("c_nationkey").alias("team"), ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25).alias("opponent"),
        F.to_date("o_orderdate").alias("day"), b.is_home(home).alias("home"), *[((F.col("o_orderkey") * a + F.col("o_custkey") * c) % m + low).cast("double").alias(n) for n, (a, c, m, low) in _STATS.items()])


def _checked(df, *names):
    return df.select("game_id", *[fixed(F.col(n)).alias(n) for n in names])


def _listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{fixed_sql(e)} AS {n}" for n, e in columns.items())


def _within(e: str, low, high) -> str:
    return f"least(greatest({e}, {low}::DOUBLE), {high}::DOUBLE)"


def _rates() -> dict[str, str]:
    out = {}
    for n in (5, 10, 20):
        s = {c: f"coalesce({roll_sql('sum', c, n, 1, _P)}, 0)" for c in _STATS}
        out[f"roll_ts_pct_{n}"] = f"{s['pts']}/(2*({s['fga']} + 0.44::DOUBLE*{s['fta']} + 1e-6::DOUBLE))"
        out[f"roll_efg_pct_{n}"] = f"({s['fgm']} + 0.5::DOUBLE*{s['fg3m']})/({s['fga']} + 1e-6::DOUBLE)"
        out[f"roll_3pt_pct_{n}"] = f"{s['fg3m']}/({s['fg3a']} + 1e-6::DOUBLE)"
        out[f"roll_ast_tov_{n}"] = f"{s['ast']}/({s['tov']} + 1e-6::DOUBLE)"
        out |= {f"roll_{c}_per_min_{n}": f"{s[c]}/(coalesce({roll_sql('sum', 'minutes', n, 1, _P)}, 1) + 1e-6::DOUBLE)" for c in b.STATS}
    return out


@query("box_rates", f"{_BOX} SELECT game_id, {_listed(_rates())} FROM b")
def box_rates(spark, sf):
    return _checked(b.rates(box(spark, sf)), *_rates())


_USAGE = {f"roll_{name}_{n}": roll_sql("avg", c, n, 1, _P) for name, c, ns in (("usg_pct", "usage", (5, 10)), ("reb_opportunity", "misses", (5, 10)), ("3pt_freq", "three", (10, 20)), ("ft_rate", "free", (10,)), ("pts_share", "share", (10,)), ("ts_pct_momentum", "ts", (5, 10))) for n in ns}


@query("box_usage", f"""{_BOX}, t AS (SELECT team, day, sum(fga) AS a, sum(fta) AS f, sum(tov) AS v, sum(pts) AS p FROM b GROUP BY ALL), r AS (SELECT team, day, p, coalesce({roll_sql('avg', 'a', 10, 3, _T)} + 0.44::DOUBLE*{roll_sql('avg', 'f', 10, 3, _T)} + {roll_sql('avg', 'v', 10, 3, _T)}, 100) AS poss FROM t),
  o AS (SELECT opponent, day, 1 - {_within('sum(fgm)/(sum(fga) + 1e-7::DOUBLE)', 0.3, 0.7)} AS misses FROM b GROUP BY ALL),
  u AS (SELECT b.*, misses, {_within(f"(fga + 0.44::DOUBLE*fta + tov)/(poss + 1e-7::DOUBLE)/{_within('minutes/48', 0.1, 1)}", 0, 0.5)} AS usage, {_within('fg3a/(fga + 1e-7::DOUBLE)', 0, 1)} AS three, {_within('fta/(fga + 1e-7::DOUBLE)', 0, 1)} AS free,
    {_within('pts/(p + 1e-7::DOUBLE)', 0, 0.6)} AS share, {_within('pts/(2*(fga + 0.44::DOUBLE*fta) + 1e-7::DOUBLE)', 0.3, 0.8)} AS ts FROM b JOIN r USING (team, day) JOIN o USING (opponent, day))
  SELECT game_id, {_listed(_USAGE)} FROM u""")
def box_usage(spark, sf):
    return _checked(b.usage(box(spark, sf)), *_USAGE)


_PACE_CTE = f"""d AS (SELECT team, day, sum(fga) AS a, sum(fta) AS f, sum(oreb) AS r, sum(tov) AS v, sum(fgm) AS m FROM b GROUP BY ALL), e AS (SELECT opponent AS team, day, sum(dreb) AS dr FROM b GROUP BY ALL),
  p0 AS (SELECT team, day, 0.5::DOUBLE*(a + 0.4::DOUBLE*f - 1.07::DOUBLE*(r/(r + coalesce(dr, 10) + 1e-6::DOUBLE))*(a - m) + v) AS est_poss FROM d LEFT JOIN e USING (team, day)),
  p1 AS (SELECT *, coalesce({roll_sql('avg', 'est_poss', 10, 3, _T)}, 100) AS team_pace_10 FROM p0), p2 AS (SELECT *, {_within('team_pace_10/100', 0.8, 1.2)} AS pace_factor FROM p1)"""


@query("box_pace", f"{_BOX}, {_PACE_CTE} SELECT game_id, {_listed({n: n for n in ('est_poss', 'team_pace_10', 'pace_factor')})} FROM b JOIN p2 USING (team, day)")
def box_pace(spark, sf):
    return _checked(b.pace(box(spark, sf)), "est_poss", "team_pace_10", "pace_factor")


@query("box_shares", f"""{_BOX}, t AS (SELECT team, day, {', '.join(f'sum({s}) AS d_{s}' for s in b.STATS)} FROM b GROUP BY ALL), r AS (SELECT *, {', '.join(f"{roll_sql('avg', f'd_{s}', 10, 3, _T)} AS t_{s}" for s in b.STATS)} FROM t),
  x AS (SELECT b.*, r.* EXCLUDE (team, day), {', '.join(f'CASE WHEN d_{s} > 0 THEN ' + _within(f'{s}/d_{s}', 0, 1) + f' END AS s_{s}' for s in b.STATS)} FROM b JOIN r USING (team, day))
  SELECT game_id, {_listed({f'team_{s}_avg_10': f't_{s}' for s in b.STATS} | {f'player_{s}_share': roll_sql('avg', f's_{s}', 5, 1, _P) for s in b.STATS})} FROM x""")
def box_shares(spark, sf):
    return _checked(b.shares(box(spark, sf)), *[n for s in b.STATS for n in (f"team_{s}_avg_10", f"player_{s}_share")])


_DEF_CTE = f"""a AS (SELECT opponent, day, {', '.join(f'sum({s}) AS d_{s}' for s in b.STATS)} FROM b GROUP BY ALL), a1 AS (SELECT opponent, day, {', '.join(f"{roll_sql('avg', f'd_{s}', 10, 3, _O)} AS w_{s}, {roll_sql('avg', f'd_{s}', 5, 2, _O)}/{k} AS f_{s}" for s, k in b.LEAGUE_ALLOWED.items())} FROM a),
  x AS (SELECT b.*, a1.* EXCLUDE (opponent, day), coalesce(({' + '.join(f'w_{s}/{k}' for s, k in b.LEAGUE_ALLOWED.items())})/3, 1) AS rating, date_diff('day', lag(b.day) OVER ({_P.replace('day', 'b.day')}), b.day) AS gap FROM b JOIN a1 USING (opponent, day))"""
_RANK = "((rank() OVER (PARTITION BY day ORDER BY rating) + (count(*) OVER (PARTITION BY day, rating) - 1)/2.0::DOUBLE)/count(*) OVER (PARTITION BY day))"
_DEF = {
    "opp_def_rating": "rating", "def_difficulty": "2 - rating", "opp_def_rank": _RANK, "quality_def_avoidance": f"1 - {_RANK}", "def_matchup_home_adj": "1.05::DOUBLE - (1 - home)*(rating*0.05::DOUBLE)", "def_matchup_away_adj": "1.0::DOUBLE - home*(rating*0.05::DOUBLE)",
    **{f"opp_{s}_allowed_10": f"w_{s}" for s in b.STATS}, **{f"roll_opp_def_{s}_5": f"f_{s}" for s in b.STATS}, **{f"relative_opp_def_{s}": f"coalesce(w_{s}/{k}, 1)" for s, k in b.LEAGUE_ALLOWED.items()},
    **{f"def_matchup_{s}_impact": f"2 - w_{s}/{k}" for s, k in b.LEAGUE_ALLOWED.items()}, **{f"def_overage_{s}": f"{roll_sql('avg', s, None, 1, _V)}/({roll_sql('avg', s, None, 1, _P)} + 1e-6::DOUBLE) - 1" for s in b.STATS},
    **{f"def_matchup_trend_{s}": f"{roll_sql('avg', s, 10, 3, _P)}/(rating + 1e-6::DOUBLE)" for s in b.STATS},
}


@query("box_defence", f"{_BOX}, {_DEF_CTE} SELECT game_id, {_listed(_DEF)} FROM x")
def box_defence(spark, sf):
    return _checked(b.defence(box(spark, sf)), *_DEF)


_INTER = {f"{s}_potential": f"{roll_sql('avg', s, 10, 3, _P)}*coalesce(w_{s}/{k}, 1)" for s, k in b.LEAGUE_ALLOWED.items()} | {
    "b2b_impact_factor": f"{roll_sql('avg', 'pts', 10, 3, _P)}*(CASE WHEN least(greatest(coalesce(gap, 4), 0), 7) <= 1 THEN 1 ELSE 0 END)*0.9::DOUBLE", "b2b_min_impact": f"(CASE WHEN coalesce(gap, 4) = 1 THEN 1 ELSE 0 END)*{roll_sql('avg', 'minutes', 10, 3, _P)}"}


@query("box_interactions", f"{_BOX}, {_DEF_CTE} SELECT game_id, {_listed(_INTER)} FROM x")
def box_interactions(spark, sf):
    return _checked(b.interactions(b.defence(box(spark, sf))), *_INTER)


_FANTASY = " + ".join(f"{s}*({k}::DOUBLE)" for s, k in b.FANTASY.items())


@query("box_advanced", f"""{_BOX}, {_PACE_CTE}, {_DEF_CTE}, y AS (SELECT x.*, pace_factor, {_within('(fga + 0.44::DOUBLE*fta + tov)/((a + 0.44::DOUBLE*f + v) + 1e-6::DOUBLE)*48/minutes', 0, 0.4)} AS u, coalesce(w_pts, 105) AS met, {_FANTASY} AS fp FROM x JOIN p2 USING (team, day) JOIN d USING (team, day))
  SELECT game_id, {_listed({'roll_usg48_10': roll_sql('avg', 'u', 10, 3, _P), 'pace_adj_usage': roll_sql('avg', 'u', 10, 3, _P) + '*pace_factor', 'sos_opp_def_5': roll_sql('avg', 'met', 5, 2, _P), 'roll_fantasy_pts_10': roll_sql('avg', 'fp', 10, 3, _P)})} FROM y""")
def box_advanced(spark, sf):
    return _checked(b.advanced(b.pace(b.defence(box(spark, sf)))), "roll_usg48_10", "pace_adj_usage", "sos_opp_def_5", "roll_fantasy_pts_10")
