"""Properties and examples that SQL doesn't cover."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import columns as c
from tallyspark.functions import querylang as q
from tallyspark.operators import features, probability as p, relational as r, simulation as sim
from tallyspark.operators import windows as w
from tallyspark.sources import files, html
from tallyspark.streaming import incremental as inc


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(0)
    rows = [(e, n, dt.date(2024, 1, 1) + dt.timedelta(days=int(n * 2 + e)), f"o{rng.integers(3)}", e % 2, float(rng.integers(0, 40)), float(rng.integers(0, 15)), float(rng.integers(10, 40))) for e in range(4) for n in range(25)]
    return spark.createDataFrame(rows, "e long, n long, day date, opp string, team long, pts double, reb double, min double")


LOG = features.Log("e", ("day", "n"), "day", "opp", "team", ("pts", "reb"), "min")


def test_rolling_is_shift_then_rolling(spark, log):
    spec = w.ordered(["e"], ["day", "n"])
    got = log.select("e", "n", w.rolling(F.avg, F.col("pts"), spec, 5, 2).alias("a"), w.rolling(F.stddev_samp, F.col("pts"), spec, 5, 2).alias("s"), w.ewma(F.col("pts"), spec, 3).alias("m")).toPandas().sort_values(["e", "n"])
    pdf = log.toPandas().sort_values(["e", "n"])
    lag = pdf.groupby("e")["pts"].shift(1)
    for name, want in (("a", lambda s: s.rolling(5, min_periods=2).mean()), ("s", lambda s: s.rolling(5, min_periods=2).std()), ("m", lambda s: s.ewm(span=3, adjust=False).mean())):
        expect = lag.groupby(pdf["e"]).transform(want)
        assert np.allclose(got[name].astype(float), expect, equal_nan=True)


def test_features_never_see_the_present(spark, log):
    """Changing the last row's stats changes no feature of that row that looks back only."""
    names = ("rolling", "efficiency", "momentum", "rest", "matchup")
    last = log.withColumn("pts", F.when(F.col("n") == 24, 1000.0).otherwise(F.col("pts"))).withColumn("min", F.when(F.col("n") == 24, 999.0).otherwise(F.col("min")))
    a, b = (features.build(x, LOG, names).where("n = 24").drop("pts", "min").orderBy("e").toPandas() for x in (log, last))
    pd.testing.assert_frame_equal(a, b)


def test_all_groups_and_cycles(spark, log):
    out = features.build(log, LOG)
    assert out.count() == log.count() and len(out.columns) > 90
    numbers = out.select([n for n, t in out.dtypes if t == "double"]).toPandas()
    assert np.isfinite(numbers.to_numpy()).all()
    features.REGISTRY["x"] = features.FeatureGroup("x", lambda d, l: d, ("y",))
    features.REGISTRY["y"] = features.FeatureGroup("y", lambda d, l: d, ("x",))
    try:
        with pytest.raises(ValueError, match="need each other"):
            features.ordered_groups(["x"])
    finally:
        del features.REGISTRY["x"], features.REGISTRY["y"]


def test_normal_distribution(spark):
    z = np.linspace(-6, 6, 49)
    got = spark.createDataFrame([(float(x),) for x in z], "z double").select(c.norm_cdf(F.col("z")).alias("p")).toPandas()["p"]
    assert np.allclose(got, [0.5 * (1 + math.erf(x / math.sqrt(2))) for x in z], atol=1e-6)


def test_minutes_and_season(spark):
    rows = [("36:30", 36.5), ("12", 12.0), ("", None), ("nan", None), ("x", None), (None, None), ("75:00", 60.0), (" 7:15 ", 7.25)]
    got = spark.createDataFrame(rows, "t string, want double").select("want", c.minutes(F.col("t")).alias("got")).collect()
    assert all(x.want == x.got for x in got)
    label = spark.createDataFrame([(dt.date(2024, 10, 1),), (dt.date(2025, 9, 30),), (dt.date(1999, 12, 1),)], "d date").select(c.season_label(F.col("d")).alias("s")).collect()
    assert [x.s for x in label] == ["2024-25", "2024-25", "1999-00"]


def test_draws_are_repeatable_and_normal(spark):
    df = spark.range(20_000).select(c.normal(1, F.col("id")).alias("a"), c.normal(2, F.col("id")).alias("b"), c.uniform(1, F.col("id")).alias("u"))
    x, y = df.toPandas(), df.repartition(3).toPandas()
    assert sorted(x["a"]) == sorted(y["a"])
    assert abs(x["a"].mean()) < 0.03 and abs(x["a"].std() - 1) < 0.03 and abs(x["a"].corr(x["b"])) < 0.03 and abs(x["u"].mean() - 0.5) < 0.01


def test_correlated_draws(spark):
    z = spark.range(8000).select(*[x.alias(s) for s, x in zip(sim.STATS, sim.correlated(3, F.col("id")))]).toPandas()
    assert np.abs(z.corr().to_numpy() - np.array(sim.CORRELATION)).max() < 0.06
    bad = [[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]]
    f = np.array(sim.lower_triangle(bad))
    assert np.allclose(np.diag(f @ f.T), 1)


def test_game_simulation(spark):
    rows = [(1, t, 10 * t + k, t == 0, 0.9 if k else 0.0, 30.0 - k, 2.0, *[float(20 - k)] * 1, 5.0, 4.0, 1.0, 1.0, 2.0, *[2.0] * 6) for t in (0, 1) for k in range(9)]
    cols = "game long, team int, player long, home boolean, play_probability double, minutes double, std_minutes double, " + ", ".join(f"mean_{s} double" for s in sim.STATS) + ", " + ", ".join(f"std_{s} double" for s in sim.STATS)
    sims = sim.simulate_games(spark.createDataFrame(rows, cols), 150).cache()
    minutes = sims.groupBy("game", "sim", "team").agg(F.sum("sim_minutes").alias("m"), F.sum(F.col("active").cast("int")).alias("n")).toPandas()
    assert (minutes["m"] <= 240.0001).all() and (minutes["n"] >= 5).all()
    res = sim.summarize_games(sim.game_results(sims)).collect()[0]
    assert 0.4 < res.home_win < 0.95 and res.home_mean > res.away_mean
    assert sims.where("not active and sim_pts > 0").count() == 0
    dealt = sim.allocate_points(sims)
    both = [x.groupBy("game", "sim", "team").agg(F.sum("sim_pts").alias("t")).orderBy("sim", "team").toPandas()["t"] for x in (sims, dealt)]
    assert np.allclose(*both) and dealt.where("not active and sim_pts > 1.6").count() == 0 and dealt.where("sim_pts < 0").count() == 0
    draws = spark.range(20_000).select(sim.gamma(F.lit(4.0), 1, F.col("id")).alias("g")).toPandas()["g"]
    assert abs(draws.mean() - 4) < 0.1 and abs(draws.var() - 4) < 0.3


def test_over_probability_with_absence(spark):
    row = spark.range(1).select(*[x.alias(n) for n, x in zip("ou", p.over_probability(F.lit(20.0), F.lit(0.0), F.lit(20.0), F.lit(0.5)))]).first()
    assert abs(row.o - 0.25) < 1e-6 and abs(row.u - 0.75) < 1e-6
    assert spark.range(1).select(p.spread_of(F.lit(10.0), F.lit(20.0), F.lit(15.0)).alias("s")).first().s == pytest.approx(10 / 3.92)


def test_percentile_rank_ties(spark):
    df = spark.createDataFrame([(1, x) for x in (5, 7, 7, 9)], "d int, v int")
    assert sorted(x.p for x in df.select(w.percentile_rank(F.col("v"), ["d"]).alias("p")).collect()) == [0.25, 0.625, 0.625, 1.0]


def test_numbering_without_one_task(spark):
    df = spark.range(5000).withColumn("x", F.xxhash64("id"))
    rows = w.numbered(df, ["x", "id"]).orderBy("row_no").collect()
    assert [x.row_no for x in rows] == list(range(5000)) and [x.x for x in rows] == sorted(x.x for x in rows)


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 0), (3, "d", 5), (3, "e", 6)], "k int, v string, t int")
    assert {(x.k, x.v) for x in r.upsert(old, new, ["k"], "t").collect()} == {(1, "a"), (2, "c"), (3, "e")}


def test_questions():
    one = q.parse("Stephen Curry over 25.5 points vs BOS today")
    assert (one.kind, one.player, one.stat, one.line, one.side, one.opponent, one.day) == ("over_under", "Stephen Curry", "pts", 25.5, "over", "bos", "today")
    assert q.parse("under 7.5", one).player == "Stephen Curry" and q.parse("under 7.5", one).stat == "pts"
    assert q.parse("compare Luka Doncic and Jayson Tatum assists").compare == ("Luka Doncic", "Jayson Tatum")
    assert [q.parse(x).kind for x in ("q", "?", "show players", "hello")] == ["exit", "help", "list", "unknown"]


def test_answers(spark):
    rows = spark.createDataFrame([("Stephen Curry", "GSW", "bos", 28.0, 6.0), ("Seth Curry", "CHA", "lal", 9.0, 4.0), ("Luka Doncic", "DAL", "bos", 31.0, 7.0)], "player string, team string, opponent string, pts_mean double, pts_std double")
    out = q.answer(q.parse("Stephen Curry over 25.5 points"), rows).collect()
    assert [x.player for x in out] == ["Stephen Curry"] and out[0].p_over == pytest.approx(0.5 * (1 + math.erf(2.5 / 6 / math.sqrt(2))), abs=1e-5) and out[0].say == "STRONG OVER"
    assert {x.player for x in q.answer(q.parse("Zz Curry over 25.5 points"), rows).collect()} == {"Stephen Curry", "Seth Curry"}
    assert [x.player for x in q.answer(q.parse("compare Luka Doncic and Seth Curry points"), rows).collect()] == ["Luka Doncic", "Seth Curry"]
    assert q.as_json(rows).count() == 3 and q.answer(q.parse("list players"), rows).count() == 3


def test_tables_in_html(spark):
    page = "<h2>LAL</h2><table><tr><th>A</th><th>B</th></tr><tr><td>x &amp; y</td><td> 2 </td></tr></table><p>no</p><table><tr><td>z</td></tr></table>"
    rows = html.tables(spark.createDataFrame([(1, page), (2, None)], "id int, page string"), "page").collect()
    assert [(x.id, x.heading, x.table_no, list(x.cells)) for x in rows] == [(1, "LAL", 0, ["A", "B"]), (1, "LAL", 0, ["x & y", "2"]), (1, "LAL", 1, ["z"])]


def test_sources(spark, tmp_path):
    a = spark.createDataFrame([(1, "new")], "k int, v string")
    b = spark.createDataFrame([(1, "old"), (2, "only")], "k int, v string")
    assert {(x.k, x.v) for x in files.first_of([a, b], ["k"]).collect()} == {(1, "new"), (2, "only")}
    for name in ("p_20240101_000000.csv", "p_20240301_000000.csv", "other.csv"):
        (tmp_path / name).write_text("a,b\n1,x\nbad,y\n")
    assert files.latest(spark, str(tmp_path), r"(\d{8}_\d{6})").endswith("p_20240301_000000.csv")
    rows = files.read_log(spark, str(tmp_path / "p_20240301_000000.csv"), "a int, b string", ["a"]).collect()
    assert [(x.a, x.b) for x in rows] == [(1, "x")]


def test_running_bias(spark, tmp_path):
    rows = [(1, t, float(t)) for t in range(1, 6)] + [(2, 1, 3.0)]
    spark.createDataFrame(rows, "k long, __t long, e double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, __t long, e double").parquet(str(tmp_path / "in"))
    query = inc.running_bias(stream, "k", "e").writeStream.outputMode("update").format("memory").queryName("bias").trigger(availableNow=True).start()
    query.awaitTermination()
    bias = 0.0
    for t in range(1, 6):
        bias = 0.6 * bias + 0.4 * t
    got = {x.k: (x.bias, x.n) for x in spark.table("bias").collect()}
    assert got[1] == (pytest.approx(bias), 5) and got[2] == (pytest.approx(1.2), 1)


def test_histories(spark):
    from tallyspark.operators import history as h

    rng = np.random.default_rng(4)
    rows = [(k, float(x)) for k, m in ((1, 10.0), (2, 30.0)) for x in rng.normal(m, 2, 300)] + [(3, 1.0), (3, 2.0)]
    mode = {x.k: x.mode for x in h.mode_of_density(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    assert abs(mode[1] - 10) < 1.5 and abs(mode[2] - 30) < 1.5 and mode[3] == 1.5
    games = spark.createDataFrame([("a", "x", dt.date(2024, 1, d), d, 4, 8, "W", "A vs. B" if d % 2 else "A @ B", float(v)) for d, v in enumerate((10, 10, 10, 20, 20, 20), 1)], "p string, o string, day date, id int, fgm int, fga int, wl string, matchup string, pts double")
    rec = h.game_records(games, ["p"], "day", [F.desc("id")]).orderBy(F.desc("day")).collect()
    assert len(rec) == 5 and rec[0].fg_pct == 50.0 and rec[0].won and not rec[0].is_home
    ctx = h.player_context(games, "p", "o", "day", [F.desc("id")], "pts").first()
    assert ctx.recent_mean == 16.0 and ctx.versus_games == 5 and ctx.trend == "up"
    lineups = spark.createDataFrame([("t", 1, [1, 2, 3, 4, 5]), ("t", 2, [1, 2, 3, 4, 6]), ("t", 3, [1, 2, 3, 4, 6]), ("u", 1, [1, 2, 3, 4, 5])], "team string, n int, five array<int>")
    got = {x.team: x.stability for x in h.stability(lineups, "team", ["n"], "five").collect()}
    assert got["u"] == 0.5 and got["t"] == pytest.approx(0.7 * (0.7 * 0.5 + 0.3 * 0.8) + 0.3)
    preds = spark.createDataFrame([(1, n, 10.0, 10.0, 20.0) for n in range(4)], "k int, n int, y double, good double, bad double")
    out = [x.blended for x in h.inverse_error_blend(preds, ["k"], ["n"], "y", ["good", "bad"]).orderBy("n").collect()]
    assert out[0] == 15.0 and abs(out[3] - 10) < 0.01
    scaled = h.team_constraint(spark.createDataFrame([(1, 10.0, 100.0), (1, 30.0, 100.0)], "g int, v double, t double"), ["g"], "v", "t").collect()
    assert sorted(x.v_scaled for x in scaled) == [13.0, 39.0]


def test_scraped(spark):
    import json

    from tallyspark.sources import scraped as s

    doc = {"sports": [{"leagues": [{"teams": [{"displayName": "T", "injuries": [{"status": "Out", "date": "2024-01-02T00:00Z", "shortComment": "knee", "athlete": {"displayName": "P"}}]}]}]}]}
    row = s.injuries(spark.createDataFrame([(json.dumps(doc),), (None,), ("bad",)], "j string"), "j").collect()
    assert [(x.team, x.player, x.status, x.play_probability, x.day) for x in row] == [("T", "P", "OUT", 0.0, dt.date(2024, 1, 2))]
    text = spark.createDataFrame([("PG Jon Doe (ankle) 31 min Questionable",)], "t string")
    got = text.select(*[c.alias(n) for n, c in s.player_text(F.col("t")).items()]).first()
    assert (got.name, got.status, got.position, got.projected_minutes) == ("Jon Doe", "QUESTIONABLE", "PG", 31.0)
    days = [spark.createDataFrame(r, "game_id int, d int") for r in ([(1, 1), (2, 1)], [(2, 2), (3, 2)])]
    assert sorted((x.game_id, x.d) for x in s.remaining_games(days).collect()) == [(1, 1), (2, 1), (3, 2)]
    fixed = s.plausible(spark.createDataFrame([("99", "0.5"), ("x", "9")], "pace string, efg string"), {"pace": (85, 115), "efg": (0.4, 0.7)}, {"pace": 100, "efg": 0.54}).collect()
    assert [(x.pace, x.efg) for x in fixed] == [(99.0, 0.5), (100.0, 0.54)]
    static = spark.createDataFrame([("a", 110.0), ("b", 105.0)], "team string, r double")
    few = s.ranked_ratings(static.limit(0), "team", "r", static, 2).collect()
    assert {x.team: x.league_rank for x in few} == {"b": 1, "a": 2}


def test_rosters_hold_all_nations(spark):
    import os

    from tallyspark.plans.domain import rosters

    sf = os.environ.get("TALLYSPARK_TEST_SF", "/root/testdata/sf0.001")
    nations = {r.c_nationkey for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_nationkey").distinct().collect()}
    sides = {(r.game, r.team, r.home) for r in rosters(spark, sf).select("game", "team", "home").distinct().collect()}
    assert {t for _, t, _ in sides} == nations
    assert all(sorted(h for g, _, h in sides if g == game) == [False, True] for game, _, _ in sides)


def test_numbers_hold_when_partitions_are_coalesced(spark):
    """Wide rows whose partitions adaptive execution merges: every row comes back, numbered without a gap."""
    from pyspark.sql import functions as F

    from tallyspark.operators import windows

    forced = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10k",
              "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in forced}
    try:
        for k, v in forced.items():
            spark.conf.set(k, v)
        df = spark.range(40_000).select(F.xxhash64("id").alias("x"), "id", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{k}")), 256).alias(f"w{k}") for k in range(6)])
        got = windows.numbered(df, ["x"]).select("x", "row_no").orderBy("row_no").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.row_no for r in got] == list(range(40_000)) and [r.x for r in got] == sorted(r.x for r in got)


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    from tallyspark.streaming.incremental import VersionedTable

    def batch(*rows):
        return spark.createDataFrame(rows, "k long, t long, v string")

    def table():  # as a new driver would open it
        return VersionedTable(spark, str(tmp_path / "t"), ["k"], "t")

    assert table().version() is None
    table().merge(batch((1, 1, "a"), (2, 1, "b")), 0)
    table().merge(batch((2, 2, "c"), (3, 1, "d")), 1)
    want = [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]
    assert sorted(map(tuple, table().read().collect())) == want
    table().merge(batch((2, 2, "c"), (3, 1, "d")), 1)  # the batch runs again
    assert sorted(map(tuple, table().read().collect())) == want and table().version() == 1


def like_sql(spark, name, folder, tables):
    """Whether the query gives its SQL's rows for these tables (pandas)."""
    import duckdb

    from tallyspark import plans

    con = duckdb.connect()
    for table, pdf in tables.items():
        pdf.to_parquet(folder / f"{table}.parquet", coerce_timestamps="us")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = plans.queries()[name](spark, str(folder)), con.sql(plans.oracle_sql()[name])
    return sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.fetchall()))


def event_table(users, kinds, values):
    n = len(values)
    return pd.DataFrame({"event_id": range(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(range(n), "s"), "user_id": users, "event_type": kinds, "value": values, "props": ["{}"] * n})


def test_adjustments_of_zeros(spark, tmp_path):
    """A mean of 0, and earlier matchups of 0 under a mean above it."""
    values = [0.0] * 6 + [10.0, 0.0, 12.0, 0.0, 14.0, 0.0, 9.0, 0.0, 3.0]
    kinds = ["view"] * 6 + ["buy", "view"] * 4 + ["view"]
    assert like_sql(spark, "projection_adjustments", tmp_path, {"events": event_table([1] * len(values), kinds, values)})


def test_encoding_of_many_rows_of_one_type(spark, tmp_path):
    """A value 1e-12 above a limit of rounding: plain sums of 40,000 rows of a type fall below it."""
    from tallyspark import plans

    event_table([i // 20 for i in range(40000)], ["view"] * 40000, [12.00000063 + 1e-12] * 40000).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    got = plans.queries()["target_encoding"](spark, str(tmp_path))
    assert got.select("user_te", "type_te").distinct().collect() == [(12000001, 12000001)]


def test_exact_mean(spark):
    df = spark.createDataFrame([(0.1,)] * 100000 + [(None,)], "x double").repartition(3)
    assert abs(df.select(w.exact_mean(F.col("x"))).first()[0] - 0.1) < 1e-16
    odd = spark.createDataFrame([(1e300, 1), (1.5, 1), (float("nan"), 2), (2.0, 2), (float("inf"), 3), (None, 4)], "x double, g int")
    got = {g: m for g, m in odd.groupBy("g").agg(w.exact_mean(F.col("x"))).collect()}
    assert got[1] == 5e299 and math.isnan(got[2]) and got[3] == math.inf and got[4] is None


def test_mean_at_a_limit_by_blocks(spark, tmp_path):
    """Twenty values of mean 40 beside a block's bound: the order of their sum decides whether it's above 40, also with nulls."""
    rng, values = np.random.default_rng(3), []
    while len(values) < 6000:
        cents = rng.integers(100, 7900, 20)
        cents[-1] = 80000 - cents[:-1].sum()
        values += [*(cents / 100), *[None] * int(rng.integers(0, 4)), 0.5]
    assert like_sql(spark, "fallback_chain", tmp_path, {"events": event_table([1] * len(values), ["view"] * len(values), values)})


def test_rolling_mean_by_blocks(spark):
    df = spark.createDataFrame([(i % 2, i, None if i % 7 == 0 else i * 0.1) for i in range(300)], "k int, t int, x double")
    spec = w.ordered(["k"], ["t"])
    for n in (5, 17, 20, 31):
        both = df.select(w.rolling_mean_by_blocks(F.col("x"), spec, n, 3).alias("a"), w.rolling(F.avg, F.col("x"), spec, n, 3).alias("b"))
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-12) for a, b in both.collect())
    with pytest.raises(ValueError):
        w.rolling_mean_by_blocks(F.col("x"), spec, 32)
