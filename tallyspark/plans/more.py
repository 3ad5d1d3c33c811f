"""Lineups, minutes, refinements, models, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import fixed, fixed_sql
from ..operators import features, learning, lineup, relational as r, simulation as sim
from ..operators import windows as w
from ..sources import sinks
from .domain import log_of, rosters
from .incremental import scratch
from .registry import query, table
from .windowed import _W, roll_sql

_POS = "CASE c_custkey % 5 WHEN 0 THEN 'PG' WHEN 1 THEN 'SG' WHEN 2 THEN 'SF' WHEN 3 THEN 'PF' ELSE 'C' END"


def place_of(player):
    k = player % 5
    return F.when(k == 0, "PG").when(k == 1, "SG").when(k == 2, "SF").when(k == 3, "PF").otherwise("C")


def position():
    return place_of(F.col("c_custkey"))


@query("lineup_prediction", f"""WITH p AS (SELECT c_nationkey, c_custkey, c_acctbal, {_POS} AS position FROM customer WHERE c_custkey % 7 <> 0), f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY c_nationkey, position ORDER BY c_acctbal DESC, c_custkey) = 1 THEN 1 ELSE 0 END AS own FROM p),
  s AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY own DESC, c_acctbal DESC, c_custkey) AS INT) AS slot FROM f) SELECT c_nationkey, c_custkey, position, slot FROM s WHERE slot <= 5""")
def lineup_prediction(spark, sf):
    out_of_it = table(spark, sf, "customer").where("c_custkey % 7 = 0").select("c_custkey")
    rows = table(spark, sf, "customer").join(out_of_it, "c_custkey", "left_anti").withColumn("position", position())
    return lineup.predict_lineup(rows, "c_nationkey", [F.desc("c_acctbal"), "c_custkey"]).select("c_nationkey", "c_custkey", "position", "slot")


@query("starter_rates", f"""WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, list(DISTINCT l_suppkey) AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM s),
  l AS (SELECT * FROM k WHERE k <= 10), n AS (SELECT o_custkey, count(*) AS n FROM l GROUP BY 1), u AS (SELECT o_custkey, unnest(x) AS supp FROM l) SELECT o_custkey, supp, CAST(count(*) AS BIGINT) AS starts, {fixed_sql('count(*)/any_value(n)')} AS rate FROM u JOIN n USING (o_custkey) GROUP BY ALL""")
def starter_rates(spark, sf):
    s = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey", "o_orderdate").agg(F.collect_set("l_suppkey").alias("starters"))
    out = lineup.starter_rates(s, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], "supp")
    return out.select("o_custkey", "supp", "starts", fixed(F.col("starter_rate")).alias("rate"))


@query("minutes_rules", f"""WITH p AS (SELECT p_partkey, p_size*0.8::DOUBLE AS base, (p_partkey % 11)/10.0::DOUBLE AS st, p_partkey % 3 = 0 AS b2b, p_partkey % 7 AS rest, p_partkey % 2 = 0 AS home FROM part),
  a AS (SELECT *, CASE WHEN st > 0.7 THEN least(base+2, 38) WHEN st < 0.3 THEN greatest(base-5, 10) ELSE base END AS m1 FROM p), b AS (SELECT *, CASE WHEN b2b THEN greatest(m1-2, 15) ELSE m1 END AS m2 FROM a), c AS (SELECT *, CASE WHEN rest = 0 THEN greatest(m2-3, 12) WHEN rest >= 4 THEN least(m2+2, 40) ELSE m2 END AS m3 FROM b)
  SELECT p_partkey, {fixed_sql('m3 + CASE WHEN home THEN 0.5::DOUBLE ELSE -0.5 END')} AS minutes, {fixed_sql('(CASE WHEN st > 0.8 THEN 2.5::DOUBLE WHEN st < 0.3 THEN 8.0 ELSE 4.0 END) + (CASE WHEN b2b THEN 1.5::DOUBLE ELSE 0 END) + (CASE WHEN rest = 0 OR rest > 5 THEN 2.0::DOUBLE ELSE 0 END)')} AS spread FROM c""")
def minutes_rules(spark, sf):
    k = F.col("p_partkey")
    args = ((k % 11) / 10.0, k % 3 == 0, k % 7)
    m, _ = lineup.rule_minutes(F.col("p_size") * 0.8, *args, k % 2 == 0)
    return table(spark, sf, "part").select("p_partkey", fixed(m).alias("minutes"), fixed(lineup.minutes_spread(*args)).alias("spread"))


@query("versus_team", f"""WITH k AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events), a AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS m, avg(value) FILTER (k <= 3) AS r, avg(value) FILTER (k > 3) AS o FROM k WHERE k <= 10 GROUP BY ALL)
  SELECT user_id, event_type, CAST(n AS BIGINT) AS games, {fixed_sql('m')} AS mean, CASE WHEN (r-o)/o > 0.15 THEN 'up' WHEN (r-o)/o < -0.15 THEN 'down' ELSE 'flat' END AS trend FROM a""")
def versus_team(spark, sf):
    out = lineup.versus_team(table(spark, sf, "events"), "user_id", "event_type", [F.desc("ts"), F.desc("event_id")], "value")
    return out.select("user_id", "event_type", "games", fixed(F.col("mean")).alias("mean"), "trend")


_ON_POS = lambda s, k: f"CASE {s} % 5 WHEN 0 THEN 'PG' WHEN 1 THEN 'SG' WHEN 2 THEN 'SF' WHEN 3 THEN 'PF' ELSE 'C' END AS {k}"


def _pair_sql(values: dict, take, default: float) -> str:
    tests = " ".join(f"WHEN (a.position = '{x}' AND b.position = '{y}') OR (a.position = '{y}' AND b.position = '{x}') THEN {take(v)}::DOUBLE" for (x, y), v in values.items())
    return f"CASE {tests} ELSE {default}::DOUBLE END"


@query("player_pairs", f"""WITH p AS (SELECT DISTINCT l_orderkey AS game, l_suppkey AS player, l_suppkey % 2 AS team, 0.2::DOUBLE + (l_suppkey % 3)*0.03::DOUBLE AS usage, {_ON_POS('l_suppkey', 'position')} FROM lineitem),
  c AS (SELECT a.game, a.player, b.player AS player_2,
  CASE WHEN a.team = b.team THEN ({_pair_sql(lineup.SYNERGY, lambda v: v[1], lineup.TEAMMATES['pts'])}) - CASE WHEN a.usage*b.usage > 0.05 THEN 0.05::DOUBLE ELSE 0 END WHEN a.position IN ('PG','SG') AND b.position IN ('PG','SG') THEN 0.05::DOUBLE WHEN a.position = b.position THEN 0.08 ELSE {lineup.OPPONENTS['pts']} END AS pts,
  CASE WHEN a.team = b.team THEN {_pair_sql(lineup.REBOUNDS, lambda v: v, lineup.TEAMMATES['reb'])} WHEN a.position IN ('PF','C') AND b.position IN ('PF','C') THEN 0.20::DOUBLE WHEN a.position = b.position THEN 0.15 ELSE {lineup.OPPONENTS['reb']} END AS reb,
  CASE WHEN a.team = b.team THEN {_pair_sql(lineup.SYNERGY, lambda v: v[0], lineup.TEAMMATES['ast'])} WHEN a.position IN ('PG','SG') AND b.position IN ('PG','SG') THEN 0.10::DOUBLE ELSE {lineup.OPPONENTS['ast']} END AS ast
  FROM p a JOIN p b ON a.game = b.game AND a.player < b.player)
  SELECT game, player, player_2, {fixed_sql('pts')} AS pts_corr, {fixed_sql('reb')} AS reb_corr, {fixed_sql('ast')} AS ast_corr FROM c""")
def player_pairs(spark, sf):
    """An order is a game, the suppliers of its lines are the players: few a game, however large the tables."""
    players = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("player")).distinct()
    players = players.select("game", "player", (F.col("player") % 2).alias("team"), (0.2 + (F.col("player") % 3) * 0.03).alias("usage"), place_of(F.col("player")).alias("position"))
    return lineup.pair_correlations(players).select("game", "player", "player_2", *[fixed(F.col(c)).alias(c) for c in ("pts_corr", "reb_corr", "ast_corr")])


@query("refinement_chain", f"""WITH e AS (SELECT event_id, {roll_sql('avg', 'value', 10, 3)} AS b, {roll_sql('avg', 'value', 3)} AS j, value AS t FROM events), x AS (SELECT event_id, t, CASE WHEN j/b > 0.1 AND j/b < 10 THEN b*0.7::DOUBLE + j*0.3::DOUBLE ELSE b END AS b1 FROM e WHERE b IS NOT NULL)
  SELECT event_id, {fixed_sql('CASE WHEN t/b1 > 0.1 AND t/b1 < 10 THEN b1*0.8::DOUBLE + t*0.2::DOUBLE ELSE b1 END')} AS refined FROM x""")
def refinement_chain(spark, sf):
    spec = w.ordered(["user_id"], ["ts", "event_id"])
    v = F.col("value")
    e = table(spark, sf, "events").select("event_id", w.rolling(F.avg, v, spec, 10, 3).alias("b"), w.rolling(F.avg, v, spec, 3).alias("j"), v.alias("t")).where("b is not null")
    return e.select("event_id", fixed(learning.refined(F.col("b"), {"joint": F.col("j"), "temporal": F.col("t")})).alias("refined"))


@query("spread_from_history", f"""WITH e AS (SELECT event_id, {roll_sql('stddev_samp', 'value', 10, 5)} AS a, {roll_sql('stddev_samp', 'value', 20, 2)} AS b, value FROM events) SELECT event_id, {fixed_sql('CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE value*0.45::DOUBLE END')} AS spread FROM e""")
def spread_from_history(spark, sf):
    spec = w.ordered(["user_id"], ["ts", "event_id"])
    v = F.col("value")
    e = table(spark, sf, "events").select("event_id", "value", w.rolling(F.stddev_samp, v, spec, 10, 5).alias("a"), w.rolling(F.stddev_samp, v, spec, 20, 2).alias("b"))
    return e.select("event_id", fixed(learning.spread_from_history(F.col("a"), F.col("b"), v, "pts")).alias("spread"))


@query("rating_lines", f"""WITH a AS (SELECT c_nationkey AS k, 105 + avg(c_acctbal)/1000 AS o, 110 - avg(c_acctbal)/2000 AS d FROM customer GROUP BY 1), g AS (SELECT h.k, (h.o + v.d)/2*0.99::DOUBLE AS hp, (v.o + h.d)/2*0.99::DOUBLE AS vp FROM a h JOIN a v ON v.k = h.k + 1)
  SELECT k AS home, {fixed_sql('hp + vp')} AS total, {fixed_sql('vp - hp - 2.5')} AS spread FROM g""")
def rating_lines(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("home")).agg((105 + F.avg("c_acctbal") / 1000).alias("o"), (110 - F.avg("c_acctbal") / 2000).alias("d"))
    v = a.select((F.col("home") - 1).alias("home"), F.col("o").alias("vo"), F.col("d").alias("vd"))
    total, spread = lineup.rating_lines(F.col("o"), F.col("d"), F.col("vo"), F.col("vd"), F.lit(99.0))
    return a.join(v, "home").select("home", fixed(total).alias("total"), fixed(spread).alias("spread"))


@query("position_share", f"""WITH p AS (SELECT c_nationkey, {_POS} AS position, c_acctbal + 1000 AS v FROM customer), a AS (SELECT c_nationkey, position, avg(v) AS x FROM p GROUP BY ALL), b AS (SELECT c_nationkey, avg(v) AS y FROM p GROUP BY 1) SELECT c_nationkey, position, {fixed_sql('least(greatest(x/y, 0.8), 1.25)')} AS factor FROM a JOIN b USING (c_nationkey)""")
def position_share(spark, sf):
    rows = table(spark, sf, "customer").select("c_nationkey", position().alias("position"), (F.col("c_acctbal") + 1000).alias("v"))
    return lineup.position_share(rows, "c_nationkey", "position", "v").select("c_nationkey", "position", fixed(F.col("factor")).alias("factor"))


@query("value_counts_top", "SELECT l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 50")
def value_counts_top(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(50)


@query("worst_predictions", f"WITH e AS (SELECT event_id, abs(value - {roll_sql('avg', 'value', 10, 3, _W)}) AS miss FROM events) SELECT event_id, {fixed_sql('miss')} AS miss FROM e WHERE miss IS NOT NULL ORDER BY e.miss DESC, event_id LIMIT 10")
def worst_predictions(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.abs(F.col("value") - w.rolling(F.avg, F.col("value"), w.ordered(["user_id"], ["ts", "event_id"]), 10, 3)).alias("m"))
    return e.where("m is not null").orderBy(F.desc("m"), "event_id").limit(10).select("event_id", fixed(F.col("m")).alias("miss"))


@query("sorted_distinct", "SELECT DISTINCT o_orderpriority AS v FROM orders UNION SELECT DISTINCT c_mktsegment FROM customer")
def sorted_distinct(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("v")).union(table(spark, sf, "customer").select("c_mktsegment")).distinct().orderBy("v")


@query("opponent_self_join", "SELECT a.l_orderkey, CAST(count(*) AS BIGINT) AS pairs FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1")
def opponent_self_join(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return r.others_of_group(rows, "l_orderkey", "l_suppkey", []).groupBy("l_orderkey").agg(F.count("*").alias("pairs"))


@query("export_players")
def export_players(spark, sf):
    return sinks.player_export(sim.simulate_games(rosters(spark, sf), 40))


@query("experiments", "SELECT 'b' AS run, CAST(3 AS BIGINT) AS runs, CAST(2 AS BIGINT) AS completed")
def experiments(spark, sf):
    runs = sinks.Experiments(spark, scratch(spark, "experiments"))
    for run, status, mae in (("a", "completed", 3.0), ("b", "completed", 2.0), ("c", "failed", 9.0)):
        runs.save(run, "demo", status, 1.5, {"mae": mae})
    return runs.best("mae").select("run").crossJoin(runs.summary().select("runs", "completed"))


def modelled(spark, sf):
    df, log = log_of(spark, sf)
    return features.build(df, log, ["rolling", "rest"])


@query("boosted_targets")
def boosted_targets(spark, sf):
    """Trees per target, trained before the last year and applied to it."""
    df = modelled(spark, sf)
    names = ["roll_pts_avg_5", "roll_pts_avg_10", "roll_reb_avg_5", "rest_days", "is_b2b"]
    train, test = learning.temporal_split(df.select("o_orderkey", "day", "pts", "reb", *names), "day", F.lit("2001-01-01").cast("date"))
    for target in ("pts", "reb"):
        test = learning.TargetModel(target, names, trees=5, depth=3).fit(train).transform(test)
    return test.select("o_orderkey", "pts", "pts_pred", "pts_pred_std", "reb_pred", "reb_pred_std")


@query("stacked_ensemble")
def stacked_ensemble(spark, sf):
    df = modelled(spark, sf).select("o_orderkey", "day", "pts", "roll_pts_avg_5", "roll_pts_avg_10", "rest_days")
    return learning.stacked(df, ["day", "o_orderkey"], "pts", ["roll_pts_avg_5", "roll_pts_avg_10", "rest_days"], folds=2).select("o_orderkey", "pts", "stacked")


@query("adversarial_weights")
def adversarial_weights(spark, sf):
    df = modelled(spark, sf).select("o_orderkey", "day", "roll_pts_avg_10", "roll_reb_avg_10", "rest_days")
    train, test = learning.temporal_split(df, "day", F.lit("2000-01-01").cast("date"))
    return learning.adversarial_weights(train, test, ["roll_pts_avg_10", "roll_reb_avg_10", "rest_days"])[0]


@query("feature_selection")
def feature_selection(spark, sf):
    df = modelled(spark, sf)
    names = [c for c in learning.safe_columns(df) if c.startswith("roll_pts")]
    best = learning.select_features(df.select("pts", *names), names, "pts", 10)
    return spark.createDataFrame(list(enumerate(best)), "rank int, feature string")


