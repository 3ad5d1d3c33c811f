"""Games to come: projections by archetype, rest, pace, defences, totals, priors and calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import fixed, fixed_sql, normal_sql
from ..operators import matchup as m
from ..operators import windows as w
from ..operators.simulation import STATS
from .registry import query, table
from .windowed import roll_sql

_KINDS = [*m.ARCHETYPES, "unheard_of"]
_POSITIONS = ("PG", "SG", "SF", "PF", "C")
_BY_TYPE = "PARTITION BY user_id, event_type ORDER BY ts, event_id"


def _pick(names, k: str) -> str:
    return f"([{', '.join(repr(n) for n in names)}])[{k} % {len(names)} + 1]"


def picked(names, k):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))


_PARAMETERS = "p(kind, rw, tm, sm, mw, ds, ha, aa) AS (VALUES " + ", ".join(f"('{k}', {', '.join(f'{x}::DOUBLE' for x in v)})" for k, v in m.ARCHETYPES.items()) + ")"
_TREND = ((40, 0.15, 1.0), (25, 0.12, 0.8), (15, 0.10, 0.6), (5, 0.08, 0.4))
_MEET = ((0.30, 0.15, 1.0), (0.20, 0.12, 0.85), (0.10, 0.08, 0.7))
_TREND_SQL = "CASE " + " ".join(f"WHEN ch > {t} THEN least(r3 - x, x*{c}::DOUBLE)*{k}::DOUBLE WHEN ch < -{t} THEN greatest(r3 - x, -x*{c}::DOUBLE)*{k}::DOUBLE" for t, c, k in _TREND) + " ELSE 0 END*tm"
_MEET_SQL = "CASE WHEN v <= 0 OR b <= 0 THEN 0 " + " ".join(f"WHEN (v - b)/b > {t} THEN least(v - x, x*{c}::DOUBLE)*{k}::DOUBLE WHEN (v - b)/b < -{t} THEN greatest(v - x, -x*{c}::DOUBLE)*{k}::DOUBLE" for t, c, k in _MEET) + " WHEN abs((v - b)/b) > 0.05 THEN (v - x)*0.5::DOUBLE ELSE 0 END*mw"
_DEFENCE_SQL = {
    "pts": "CASE WHEN rank >= 26 THEN 1 + 1.8::DOUBLE*ds WHEN rank >= 21 THEN 1 + 1.2::DOUBLE*ds WHEN rank >= 16 THEN 1 + 0.5::DOUBLE*ds WHEN rank <= 3 THEN 1 - 1.5::DOUBLE*ds WHEN rank <= 5 THEN 1 - ds WHEN rank <= 10 THEN 1 - 0.5::DOUBLE*ds ELSE 1.0::DOUBLE END",
    "reb": "CASE WHEN pos IN ('C','PF') THEN CASE WHEN rank >= 21 THEN 1.05::DOUBLE WHEN rank <= 10 THEN 0.96 ELSE 1.0 END WHEN rank >= 21 THEN 1.03 WHEN rank <= 10 THEN 0.98 ELSE 1.0 END",
    "ast": "CASE WHEN pos NOT IN ('PG','SG') THEN 1.0::DOUBLE WHEN rank >= 21 THEN 1.04 WHEN rank <= 10 THEN 0.97 ELSE 1.0 END",
}


def _chain_sql(stat: str) -> str:
    venue = "CASE WHEN event_id % 2 = 0 THEN ha ELSE aa END" if stat == "pts" else "CASE WHEN event_id % 2 = 0 THEN 0.3::DOUBLE ELSE -0.2 END"
    return f"""WITH {_PARAMETERS}, e AS (SELECT event_id, {roll_sql('avg', 'value', 10, 3)} AS b, {roll_sql('avg', 'value', 5)} AS r5, {roll_sql('avg', 'value', 3)} AS r3, {roll_sql('avg', 'value', 5, 1, _BY_TYPE)} AS v0, {_pick(_KINDS, 'event_id')} AS k, {_pick(_POSITIONS, 'event_id // 7')} AS pos, event_id % 30 + 1 AS rank, 24.0::DOUBLE + event_id % 16 AS mins FROM events),
  a AS (SELECT e.*, p.*, coalesce(v0, b) AS v, (r3 - b)/b*100 AS ch FROM e JOIN p ON p.kind = CASE WHEN k = 'unheard_of' THEN 'role_player' ELSE k END WHERE b IS NOT NULL),
  x0 AS (SELECT *, CASE WHEN ch > 25 THEN least(0.55, rw + 0.1::DOUBLE) WHEN ch < -25 THEN greatest(0.2, rw - 0.1::DOUBLE) ELSE rw END AS wt FROM a), x1 AS (SELECT *, b*(1 - wt) + r5*wt AS y FROM x0),
  x2 AS (SELECT * EXCLUDE (y), CASE WHEN abs(mins/32 - 1) > 0.05 THEN y*(mins/32) ELSE y END AS y, {_DEFENCE_SQL[stat]} AS d FROM x1), x3 AS (SELECT *, CASE WHEN abs(d - 1) > 0.01 THEN y*d ELSE y END AS x FROM x2),
  x4 AS (SELECT *, {_TREND_SQL} AS t FROM x3), x5 AS (SELECT * EXCLUDE (x), x + CASE WHEN abs(t) > 0.1 THEN t ELSE 0 END AS x FROM x4), x6 AS (SELECT *, {_MEET_SQL} AS q FROM x5)
  SELECT event_id, {fixed_sql(f'x + CASE WHEN abs(q) > 0.1 THEN q ELSE 0 END + {venue}')} AS adjusted FROM x6"""


def _chain(stat: str):
    @query(f"projection_chain_{stat}", _chain_sql(stat))
    def run(spark, sf):
        spec, by_type, v, k = w.ordered(["user_id"], ["ts", "event_id"]), w.ordered(["user_id", "event_type"], ["ts", "event_id"]), F.col("value"), F.col("event_id")
        e = table(spark, sf, "events").select("event_id", w.rolling(F.avg, v, spec, 10, 3).alias("base"), w.rolling(F.avg, v, spec, 5).alias("recent"), w.rolling(F.avg, v, spec, 3).alias("recent_3"), w.rolling(F.avg, v, by_type, 5).alias("versus"),
                                              picked(_KINDS, k).alias("archetype"), picked(_POSITIONS, F.floor(k / 7)).alias("position"), (k % 30 + 1).alias("rank"), (24.0 + k % 16).alias("recent_minutes"), (k % 2 == 0).alias("home")).where("base is not null")
        out = m.adjusted_projection(e.withColumn("change", (F.col("recent_3") - F.col("base")) / F.col("base") * 100), stat)
        return out.select("event_id", fixed(F.col("adjusted")).alias("adjusted"))

    return run


for _stat in ("pts", "reb", "ast"):
    _chain(_stat)


@query("rest_lookback", f"""WITH d AS (SELECT DISTINCT o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS n FROM orders), g AS (SELECT o_custkey, n, n - lag(n) OVER w AS gap, count(*) OVER (w RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS a, count(*) OVER (w RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING) AS b FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY n)),
  r AS (SELECT o_custkey, n AS day, CAST(coalesce(gap, 2) AS BIGINT) AS rest_days, CAST(CASE WHEN gap IS NULL THEN 3 ELSE a END AS BIGINT) AS games_last_7, CAST(CASE WHEN gap IS NULL THEN 6 ELSE b END AS BIGINT) AS games_last_14 FROM g)
  SELECT *, {fixed_sql('CASE WHEN rest_days <= 1 AND games_last_7 >= 3 THEN 0.96::DOUBLE WHEN rest_days <= 1 THEN 0.975 WHEN rest_days = 3 THEN 1.01 WHEN rest_days >= 4 THEN 1.005 ELSE 1.0 END')} AS fatigue FROM r""")
def rest_lookback(spark, sf):
    out = m.rest(table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate")), "o_custkey", "day")
    long = lambda c: F.col(c).cast("long").alias(c)
    return out.select("o_custkey", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long").alias("day"), long("rest_days"), long("games_last_7"), long("games_last_14"), fixed(F.col("fatigue")).alias("fatigue"))


@query("team_pace_ladder", f"""WITH k AS (SELECT o_custkey, o_totalprice/1500 AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, {fixed_sql('CASE WHEN count(*) > 5 THEN least(greatest(avg(x)/1.12::DOUBLE, 90), 110) ELSE 100 END')} AS pace FROM k WHERE k <= 20 GROUP BY 1""")
def team_pace_ladder(spark, sf):
    games = table(spark, sf, "orders").withColumn("pts", F.col("o_totalprice") / 1500)
    return m.team_pace(games, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], "pts").select("o_custkey", fixed(F.col("pace")).alias("pace"))


_ADJ = "coalesce(0.5::DOUBLE*tf + 0.5::DOUBLE*pf, tf)"


@query("defence_by_position", f"""WITH c AS (SELECT c_nationkey AS team, {_pick(_POSITIONS, 'c_custkey')} AS position, c_acctbal + 5000 AS v FROM customer), l AS (SELECT avg(v) AS lv FROM c), t AS (SELECT team, avg(v) AS tv FROM c GROUP BY 1), q AS (SELECT team, position, avg(v) AS pv FROM c GROUP BY ALL),
  f AS (SELECT team, position, tv/lv AS tf, CASE WHEN position <> 'C' THEN pv/lv END AS pf FROM q JOIN t USING (team), l)
  SELECT team, position, {fixed_sql(f'least(greatest({_ADJ}, 0.85), 1.15)')} AS pts, {fixed_sql(f'least(greatest(1 + ({_ADJ} - 1)*0.5::DOUBLE, 0.9), 1.1)')} AS reb, {fixed_sql(f'least(greatest(1 + ({_ADJ} - 1)*0.3::DOUBLE, 0.92), 1.08)')} AS ast, {fixed_sql(f'least(greatest(2 - {_ADJ}, 0.9), 1.1)')} AS tov FROM f""")
def defence_by_position(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("team"), picked(_POSITIONS, F.col("c_custkey")).alias("position"), (F.col("c_acctbal") + 5000).alias("v"))
    by_position = c.groupBy("team", "position").agg(F.avg("v").alias("pv"))
    f = by_position.join(c.groupBy("team").agg(F.avg("v").alias("tv")), "team").crossJoin(F.broadcast(c.agg(F.avg("v").alias("lv"))))
    factors = m.defence_factors(F.col("tv") / F.col("lv"), F.when(F.col("position") != "C", F.col("pv") / F.col("lv")))
    return f.select("team", "position", *[fixed(x).alias(s) for s, x in factors.items()])


_MEANS = {"pts": (20, 4), "reb": (9, 1), "ast": (7, 1), "stl": (2, 0.5), "blk": (2, 0.25), "tov": (3, 0.5)}
_TOTALS = {
    s: f"least(greatest(m_{s} + (s_{s} + {more})*{normal_sql('7', 'game', 'team', 'sim', repr(s))}" + (" + CASE WHEN home THEN 2.5::DOUBLE + least(greatest((m_pts - 100)/50, -0.5), 0.5) ELSE -2.5 END" if s == "pts" else "") + f", {low}), {high})"
    for s, low, high, more in zip(STATS, m.TOTAL_LOW, m.TOTAL_HIGH, m.TOTAL_SPREAD)}


@query("team_total_draws", f"""WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer), p AS (SELECT c_nationkey AS team, c_nationkey // 2 AS game, c_nationkey % 2 = 0 AS home, {', '.join(f'({low}::DOUBLE + c_custkey % {k}) AS {s}' for s, (k, low) in _MEANS.items())} FROM r WHERE r <= 9),
  t AS (SELECT game, team, home, {', '.join(f'sum({s}) AS m_{s}, sqrt(sum(({s}*0.4::DOUBLE)*({s}*0.4::DOUBLE))) AS s_{s}' for s in _MEANS)} FROM p GROUP BY ALL)
  SELECT CAST(game AS BIGINT) AS game, CAST(team AS BIGINT) AS team, CAST(sim AS INT) AS sim, {', '.join(f'{fixed_sql(e)} AS total_{s}' for s, e in _TOTALS.items())} FROM t, range(50) u(sim)""")
def team_total_draws(spark, sf):
    best = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    top = table(spark, sf, "customer").withColumn("r", best).where("r <= 9")
    means = {s: (F.col("c_custkey") % k + low).cast("double") for s, (k, low) in _MEANS.items()}
    roster = top.select(F.floor(F.col("c_nationkey") / 2).alias("game"), F.col("c_nationkey").cast("long").alias("team"), (F.col("c_nationkey") % 2 == 0).alias("home"), *[x.alias(f"mean_{s}") for s, x in means.items()], *[(x * 0.4).alias(f"std_{s}") for s, x in means.items()])
    return m.team_totals(roster, 50).select("game", "team", "sim", *[fixed(F.col(f"total_{s}")).alias(f"total_{s}") for s in STATS])


@query("game_progression", """SELECT CAST(n_nationkey AS BIGINT) AS game, CAST(s AS BIGINT) AS step, CAST(CASE WHEN s = 0 THEN 1 ELSE (s - 1) // 6 + 1 END AS BIGINT) AS quarter, CAST(CASE WHEN s = 0 THEN 720 ELSE 720 - ((s - 1) % 6 + 1)*120 END AS BIGINT) AS time_remaining,
  CASE WHEN s = 0 OR (s - 1) % 2 = 0 THEN 'home' ELSE 'away' END AS possession FROM nation, range(24) t(s)""")
def game_progression(spark, sf):
    out = m.progression(table(spark, sf, "nation").select(F.col("n_nationkey").alias("game")))
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("game", "step", "quarter", "time_remaining")], "possession")


@query("betting_features", f"""WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 200 + o_totalprice/10000 END AS t, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 21 - 10)/1.0::DOUBLE END AS s FROM orders), x AS (SELECT o_orderkey, coalesce(t, 225) AS t, coalesce(s, 0) AS s FROM l)
  SELECT o_orderkey, {fixed_sql('t')} AS vegas_total, {fixed_sql('s')} AS vegas_spread, {fixed_sql('(t - s)/2')} AS home_implied_pts, {fixed_sql('(t + s)/2')} AS away_implied_pts, {fixed_sql('-s/2')} AS home_team_value, {fixed_sql('s/2')} AS away_team_value FROM x""")
def betting_features(spark, sf):
    k = F.col("o_orderkey")
    f = m.betting_features(F.when(k % 5 != 0, 200 + F.col("o_totalprice") / 10000), F.when(k % 7 != 0, (k % 21 - 10) / F.lit(1.0)))
    return table(spark, sf, "orders").select("o_orderkey", *[fixed(f[n]).alias(n) for n in ("vegas_total", "vegas_spread", "home_implied_pts", "away_implied_pts", "home_team_value", "away_team_value")])


@query("key_players", """WITH c AS (SELECT c_nationkey AS team, c_custkey AS player, c_acctbal AS pts, c_custkey % 13 AS reb, c_custkey % 7 AS ast FROM customer WHERE c_custkey % 10 >= 5)
  SELECT team, arg_min(player, (-pts, player)) AS top_pts, arg_min(player, (-reb, player)) AS top_reb, arg_min(player, (-ast, player)) AS top_ast FROM c GROUP BY 1""")
def key_players(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("team"), k.alias("player"), F.col("c_acctbal").alias("pts"), (k % 13).alias("reb"), (k % 7).alias("ast"), ((k % 10) / 10).alias("play_probability"))
    return m.key_players(rows, ["team"], "player")


_TRIED = {"fg": 2, "fg3": 3, "ft": 5}


@query("shooting_defaults", f"""WITH t AS (SELECT l_orderkey, {', '.join(f'CASE WHEN l_partkey % {k} = 0 THEN l_quantity ELSE 0 END AS {n}a, CASE WHEN l_partkey % {2 * k} = 0 THEN l_quantity ELSE 0 END AS {n}m' for n, k in _TRIED.items())} FROM lineitem)
  SELECT l_orderkey, {', '.join(f"{fixed_sql(f'CASE WHEN sum({n}a) > 0 THEN sum({n}m)/sum({n}a) ELSE {k}::DOUBLE END')} AS {n}_pct" for n, k in (('fg', 0.45), ('fg3', 0.35), ('ft', 0.75)))} FROM t GROUP BY 1""")
def shooting_defaults(spark, sf):
    tried = lambda k: F.when(F.col("l_partkey") % k == 0, F.col("l_quantity")).otherwise(0.0)
    names = {"fg": ("fgm", "fga"), "fg3": ("fg3m", "fg3a"), "ft": ("ftm", "fta")}
    rows = table(spark, sf, "lineitem").select("l_orderkey", *[c for n, k in _TRIED.items() for c in (tried(2 * k).alias(names[n][0]), tried(k).alias(names[n][1]))])
    return m.shooting(rows, ["l_orderkey"]).select("l_orderkey", *[fixed(F.col(f"{n}_pct")).alias(f"{n}_pct") for n in _TRIED])


_QUANTILES = f"WITH e AS (SELECT event_type, value, {roll_sql('avg', 'value', 10, 3)} AS g, {roll_sql('stddev_samp', 'value', 10, 3)} AS s FROM events), q AS (SELECT event_type, value, side, g + k*s AS pred FROM e, (VALUES ('low', -1.28::DOUBLE), ('high', 1.28)) t(side, k) WHERE g + k*s IS NOT NULL)"


@query("quantile_coverage", f"""{_QUANTILES} SELECT event_type, side, CAST(count(*) AS BIGINT) AS n, {fixed_sql('avg(CASE WHEN value < pred THEN 1.0::DOUBLE ELSE 0 END)')} AS coverage, {fixed_sql("CASE side WHEN 'low' THEN 0.1::DOUBLE ELSE 0.9 END - avg(CASE WHEN value < pred THEN 1.0::DOUBLE ELSE 0 END)")} AS coverage_error,
  {fixed_sql("CASE side WHEN 'low' THEN quantile_cont(value - pred, 0.9) ELSE quantile_cont(value - pred, 0.1) END")} AS shift FROM q GROUP BY event_type, side""")
def quantile_coverage(spark, sf):
    spec, v = w.ordered(["user_id"], ["ts", "event_id"]), F.col("value")
    e = table(spark, sf, "events").select("event_type", "value", w.rolling(F.avg, v, spec, 10, 3).alias("g"), w.rolling(F.stddev_samp, v, spec, 10, 3).alias("s"))
    one = lambda side, k, expected: m.quantile_coverage(e.withColumn("pred", F.col("g") + k * F.col("s")), ["event_type"], "value", "pred", expected).withColumn("side", F.lit(side))
    return one("low", -1.28, 0.1).unionByName(one("high", 1.28, 0.9)).select("event_type", "side", "n", *[fixed(F.col(c)).alias(c) for c in ("coverage", "coverage_error", "shift")])


@query("simulated_probability", f"""WITH d AS (SELECT user_id, value AS x FROM events WHERE event_id % 5 <> 0), a AS (SELECT user_id, count(*) AS n, avg(CASE WHEN x > 60.5 THEN 1.0::DOUBLE ELSE 0 END) AS o, avg(CASE WHEN x < 60.5 THEN 1.0::DOUBLE ELSE 0 END) AS u, avg(x) AS mean, stddev_pop(x) AS s FROM d GROUP BY 1)
  SELECT user_id, CAST(n AS BIGINT) AS n, {', '.join(f"CASE WHEN n >= 3 THEN {fixed_sql(e)} END AS {c}" for c, e in (('p_over', 'o'), ('p_under', 'u'), ('mean', 'mean'), ('std', 's'), ('z', 'CASE WHEN s > 0 THEN (60.5::DOUBLE - mean)/s END')))} FROM a""")
def simulated_probability(spark, sf):
    draws = table(spark, sf, "events").select("user_id", "value", (F.col("event_id") % 5 != 0).alias("played"))
    out = m.simulated_probability(draws, ["user_id"], "value", F.lit(60.5), "played")
    return out.select("user_id", "n", *[fixed(F.col(c)).alias(c) for c in ("p_over", "p_under", "mean", "std", "z")])
