"""Window operators: lags, rolling and expanding frames, weights, ranks, encodings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import clip, fixed, fixed_sql, fourier, season_label
from ..operators import windows as w
from .registry import query, table

EVENT = ["ts", "event_id"]
_W = "PARTITION BY user_id ORDER BY ts, event_id"


def roll_sql(agg: str, c: str, n: int | None, least: int = 1, over: str = _W) -> str:
    frame = f"({over} ROWS BETWEEN {'UNBOUNDED' if n is None else n} PRECEDING AND 1 PRECEDING)"
    return f"(CASE WHEN count({c}) OVER {frame} >= {least} THEN {agg}({c}) OVER {frame} END)"


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value"), w.ordered(["user_id"], EVENT)


@query("rolling_mean_lag1", f"""SELECT event_id, user_id, lag(value) OVER ({_W}) AS lag_value, {fixed_sql(roll_sql('avg', 'value', 10, 3))} AS mean_10 FROM events""")
def rolling_mean_lag1(spark, sf):
    df, spec = events(spark, sf)
    return df.select("event_id", "user_id", F.lag("value").over(spec).alias("lag_value"), fixed(w.rolling(F.avg, F.col("value"), spec, 10, 3)).alias("mean_10"))


_STATS = [(n, a, f) for n in (3, 5, 10, 20, 50) for a, f in (("avg", F.avg), ("stddev_samp", F.stddev_samp), ("min", F.min), ("max", F.max))
          if a == "avg" or (a == "stddev_samp" and n >= 5) or (a in ("min", "max") and n >= 10)]


@query("rolling_std_min_max_range", "SELECT event_id, " + ", ".join(f"{fixed_sql(roll_sql(a, 'value', n, w.least_rows(n)))} AS {a}_{n}" for n, a, _ in _STATS)
       + "".join(f", {fixed_sql(roll_sql('max', 'value', n, w.least_rows(n)) + ' - ' + roll_sql('min', 'value', n, w.least_rows(n)))} AS range_{n}" for n in (10, 20)) + " FROM events")
def rolling_std_min_max_range(spark, sf):
    df, spec = events(spark, sf)
    r = lambda f, n: w.rolling(f, F.col("value"), spec, n, w.least_rows(n))
    return df.select("event_id", *[fixed(r(f, n)).alias(f"{a}_{n}") for n, a, f in _STATS], *[fixed(r(F.max, n) - r(F.min, n)).alias(f"range_{n}") for n in (10, 20)])


_ORDERS_CTE = """g AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_orderpriority, o_totalprice, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, sum(l_discount) AS disc, sum(l_tax) AS tax, count(l_orderkey) AS n_lines
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""
_WO = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def order_log(spark, sf):
    """One row per order with the sums of its lines: the per-customer log that features are built on."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"), F.sum("l_discount").alias("disc"), F.sum("l_tax").alias("tax"), F.count("*").alias("n_lines"))
    orders = table(spark, sf, "orders")
    log = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").drop("l_orderkey").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    return log, w.ordered(["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("rolling_ratio", f"""WITH {_ORDERS_CTE} SELECT o_orderkey, """ + ", ".join(
    f"{fixed_sql('coalesce(' + roll_sql('sum', 'price', n, 1, _WO) + ',0)/(coalesce(' + roll_sql('sum', 'qty', n, 1, _WO) + ',0)+1e-6::DOUBLE)')} AS price_per_unit_{n}" for n in (5, 10, 20)) + " FROM g")
def rolling_ratio(spark, sf):
    df, spec = order_log(spark, sf)
    s = lambda c, n: F.coalesce(w.rolling(F.sum, F.col(c), spec, n), F.lit(0.0))
    return df.select("o_orderkey", *[fixed(s("price", n) / (s("qty", n) + 1e-6)).alias(f"price_per_unit_{n}") for n in (5, 10, 20)])


def _ewma_sql(span: int) -> str:
    a = 2.0 / (span + 1)
    return f"list_reduce(list(value) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda m, x: {a!r}::DOUBLE*x + {1 - a!r}::DOUBLE*m)"


@query("ewma", "WITH e AS (SELECT event_id, " + ", ".join(f"{_ewma_sql(s)} AS e{s}" for s in (3, 5, 10, 20)) + " FROM events) SELECT event_id, " + ", ".join(f"{fixed_sql(f'e{s}')} AS ewma_{s}" for s in (3, 5, 10, 20))
       + ", CAST(coalesce(e3 > 1.15::DOUBLE*e10, false) AS INT) AS hot, CAST(coalesce(e3 < 0.85::DOUBLE*e10, false) AS INT) AS cold FROM e")
def ewma(spark, sf):
    df, spec = events(spark, sf)
    e = df.select("event_id", *[w.ewma(F.col("value"), spec, s).alias(f"e{s}") for s in (3, 5, 10, 20)])
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return e.select("event_id", *[fixed(F.col(f"e{s}")).alias(f"ewma_{s}") for s in (3, 5, 10, 20)], flag(F.col("e3") > 1.15 * F.col("e10")).alias("hot"), flag(F.col("e3") < 0.85 * F.col("e10")).alias("cold"))


@query("ewma_streamed_keys", "SELECT event_id, " + fixed_sql(_ewma_sql(10)) + " AS ewma_10 FROM events")
def ewma_streamed_keys(spark, sf):
    df, _ = events(spark, sf)
    out = w.ewma_long(df, ["user_id"], EVENT, "value", [10])
    return out.select("event_id", fixed(F.when(~F.isnan("value_ewma_10"), F.col("value_ewma_10"))).alias("ewma_10"))


@query("expanding_mean_std", f"SELECT event_id, {fixed_sql(roll_sql('avg', 'value', None))} AS mean_before, {fixed_sql(roll_sql('stddev_samp', 'value', None, 2))} AS std_before FROM events")
def expanding_mean_std(spark, sf):
    df, spec = events(spark, sf)
    return df.select("event_id", fixed(w.rolling(F.avg, F.col("value"), spec, None)).alias("mean_before"), fixed(w.rolling(F.stddev_samp, F.col("value"), spec, None, 2)).alias("std_before"))


@query("trend_short_long", "SELECT event_id, " + ", ".join(f"{fixed_sql(roll_sql('avg', 'value', a) + ' - ' + roll_sql('avg', 'value', b, w.least_rows(b)))} AS trend_{a}_{b}" for a, b in ((3, 10), (5, 20))) + " FROM events")
def trend_short_long(spark, sf):
    df, spec = events(spark, sf)
    return df.select("event_id", *[fixed(w.trend(F.col("value"), spec, a, b)).alias(f"trend_{a}_{b}") for a, b in ((3, 10), (5, 20))])


@query("rest_days_b2b_fatigue", f"""WITH {_ORDERS_CTE}, d AS (SELECT *, coalesce(date_diff('day', CAST(lag(o_orderdate) OVER ({_WO}) AS DATE), CAST(o_orderdate AS DATE)), 4) AS gap, coalesce(lag(qty) OVER ({_WO}), 0) AS before FROM g),
  s AS (SELECT *, least(greatest(gap, 0), 7) AS rest, sum(before) OVER ({_WO} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3, sum(before) OVER ({_WO} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS last7 FROM d)
  SELECT o_orderkey, CAST(gap AS INT) AS gap, CAST(rest AS INT) AS rest, CAST(gap = 1 AS INT) AS b2b, {fixed_sql('last3')} AS last3, {fixed_sql('last7')} AS last7,
  {fixed_sql('0.4*last3/100 + 0.3*(CASE WHEN gap=1 THEN 1 ELSE 0 END) + 0.3*(4-least(greatest(rest,0),4))')} AS fatigue FROM s""")
def rest_days_b2b_fatigue(spark, sf):
    df, spec = order_log(spark, sf)
    df = df.withColumn("gap", w.gaps(F.col("o_orderdate"), spec)).withColumn("before", F.coalesce(F.lag("qty").over(spec), F.lit(0.0)))
    total = lambda n: F.sum("before").over(spec.rowsBetween(1 - n, 0))
    df = df.withColumns({"rest": clip(F.col("gap"), 0, 7), "b2b": (F.col("gap") == 1).cast("int"), "s3": total(3), "s7": total(7)})
    fatigue = 0.4 * F.col("s3") / 100 + 0.3 * F.col("b2b") + 0.3 * (4 - clip(F.col("rest"), 0, 4))
    return df.select("o_orderkey", F.col("gap").cast("int").alias("gap"), F.col("rest").cast("int").alias("rest"), "b2b", fixed(F.col("s3")).alias("last3"), fixed(F.col("s7")).alias("last7"), fixed(fatigue).alias("fatigue"))


_WM = "PARTITION BY o_custkey, l_suppkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate"


@query("matchup_history", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {fixed_sql(roll_sql('avg', 'l_quantity', None, 1, _WM))} AS vs_avg, {fixed_sql(roll_sql('avg', 'l_quantity', 5, 1, _WM))} AS vs_recent
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def matchup_history(spark, sf):
    df = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    spec = w.ordered(["o_custkey", "l_suppkey"], ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"])
    q = F.col("l_quantity")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fixed(w.rolling(F.avg, q, spec, None)).alias("vs_avg"), fixed(w.rolling(F.avg, q, spec, 5)).alias("vs_recent"))


@query("entity_rolling_intended_grain", f"""WITH d AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
  r AS (SELECT *, coalesce({roll_sql('avg', 'q', 10, 3, 'PARTITION BY l_suppkey ORDER BY day')}, 100) AS pace FROM d)
  SELECT l_orderkey, l_linenumber, l_partkey, l.l_suppkey, {fixed_sql('pace')} AS pace_10, {fixed_sql('least(greatest(pace/100, 0.8), 1.2)')} AS pace_factor FROM lineitem l JOIN r ON r.l_suppkey = l.l_suppkey AND r.day = CAST(l_shipdate AS DATE)""")
def entity_rolling_intended_grain(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    daily = lines.groupBy("l_suppkey", "day").agg(F.sum("l_quantity").alias("q"))
    daily = daily.withColumn("pace", F.coalesce(w.rolling(F.avg, F.col("q"), w.ordered(["l_suppkey"], ["day"]), 10, 3), F.lit(100.0))).drop("q")
    out = lines.join(daily, ["l_suppkey", "day"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fixed(F.col("pace")).alias("pace_10"), fixed(clip(F.col("pace") / 100, 0.8, 1.2)).alias("pace_factor"))


@query("opponent_allowed_rolling", f"""WITH t AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, sum(q) AS total FROM t GROUP BY 1),
  p AS (SELECT t.l_orderkey, t.l_suppkey, total - q AS allowed FROM t JOIN b USING (l_orderkey))
  SELECT l_orderkey, l_suppkey, {fixed_sql('allowed')} AS allowed, {fixed_sql(roll_sql('avg', 'allowed', 10, 3, 'PARTITION BY l_suppkey ORDER BY l_orderkey'))} AS allowed_10 FROM p""")
def opponent_allowed_rolling(spark, sf):
    teams = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    # what the others of a game make is the game's sum less one's own: a window instead of a self-join
    teams = teams.withColumn("allowed", F.sum("q").over(Window.partitionBy("l_orderkey")) - F.col("q"))
    return teams.select("l_orderkey", "l_suppkey", fixed(F.col("allowed")).alias("allowed"), fixed(w.rolling(F.avg, F.col("allowed"), w.ordered(["l_suppkey"], ["l_orderkey"]), 10, 3)).alias("allowed_10"))


@query("cumcount_shrinkage", f"""WITH g AS (SELECT avg(value) AS gm FROM events), e AS (SELECT event_id, row_number() OVER ({_W}) - 1 AS n, {roll_sql('avg', 'value', None)} AS m FROM events)
  SELECT event_id, CAST(n AS BIGINT) AS n_before, {fixed_sql('(n+1)/(n+1+10.0::DOUBLE)*m + 10.0::DOUBLE/(n+1+10.0::DOUBLE)*gm')} AS shrunk FROM e, g""")
def cumcount_shrinkage(spark, sf):
    df, spec = events(spark, sf)
    df = w.with_overall(df, gm=F.avg("value"))
    n = w.count_before(spec)
    return df.select("event_id", n.cast("long").alias("n_before"), fixed(w.shrunk(w.rolling(F.avg, F.col("value"), spec, None), n + 1, F.col("gm"), 10)).alias("shrunk"))


_WT = "PARTITION BY event_type ORDER BY ts, event_id"


@query("target_encoding", f"""WITH g AS (SELECT avg(value) AS gm FROM events), e AS (SELECT event_id, row_number() OVER ({_W}) - 1 AS nu, {roll_sql('avg', 'value', None)} AS mu, row_number() OVER ({_WT}) - 1 AS nt, {roll_sql('avg', 'value', None, 1, _WT)} AS mt FROM events)
  SELECT event_id, {fixed_sql('coalesce(nu/(nu+20.0::DOUBLE)*mu + 20.0::DOUBLE/(nu+20.0::DOUBLE)*gm, gm)')} AS user_te, {fixed_sql('coalesce(nt/(nt+20.0::DOUBLE)*mt + 20.0::DOUBLE/(nt+20.0::DOUBLE)*gm, gm)')} AS type_te FROM e, g""")
def target_encoding(spark, sf):
    df, _ = events(spark, sf)
    df = w.with_overall(df, gm=w.exact_mean(F.col("value")))

    def encoded(key):
        spec = w.ordered([key], EVENT)
        mean = w.exact_mean(F.col("value"), lambda a: a.over(w.previous(spec)))
        return F.coalesce(w.shrunk(mean, w.count_before(spec), F.col("gm"), 20), F.col("gm"))

    return df.select("event_id", fixed(encoded("user_id")).alias("user_te"), fixed(encoded("event_type")).alias("type_te"))


@query("pct_rank_in_day", f"""SELECT event_id, {fixed_sql('(rank() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value) + (count(*) OVER (PARTITION BY CAST(ts AS DATE), value) - 1)/2.0::DOUBLE)/count(*) OVER (PARTITION BY CAST(ts AS DATE))')} AS pct FROM events""")
def pct_rank_in_day(spark, sf):
    df = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return df.select("event_id", fixed(w.percentile_rank(F.col("value"), ["day"])).alias("pct"))


@query("rolling_percentile", f"""WITH e AS (SELECT event_id, value, list(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 1999 PRECEDING AND CURRENT ROW) AS seen FROM events)
  SELECT event_id, CASE WHEN len(seen) >= 500 THEN {fixed_sql('len(list_filter(seen, lambda x: x <= value))::DOUBLE/len(seen)')} END AS pct FROM e""")
def rolling_percentile(spark, sf):
    df = table(spark, sf, "events").select("event_id", "ts", "value")
    return w.rolling_percentile(df, EVENT, "value", 2000, 500).select("event_id", fixed(F.col("percentile")).alias("pct"))


@query("z_score_hot_hand", f"""WITH e AS (SELECT event_id, {roll_sql('avg', 'value', 5)} AS m5, {roll_sql('avg', 'value', None)} AS m, {roll_sql('stddev_samp', 'value', None, 2)} AS s FROM events), g AS (SELECT avg(s) AS gs FROM e)
  SELECT event_id, {fixed_sql('(m5 - m)/((CASE WHEN coalesce(s, gs) = 0 THEN 1 ELSE coalesce(s, gs) END) + 1e-6::DOUBLE)')} AS z FROM e, g""")
def z_score_hot_hand(spark, sf):
    df, spec = events(spark, sf)
    v = F.col("value")
    df = df.select("event_id", w.rolling(F.avg, v, spec, 5).alias("m5"), w.rolling(F.avg, v, spec, None).alias("m"), w.rolling(F.stddev_samp, v, spec, None, 2).alias("s"))
    df = w.with_overall(df, gs=F.avg("s"))
    s = F.coalesce("s", "gs")
    return df.select("event_id", fixed((F.col("m5") - F.col("m")) / (F.when(s == 0, 1.0).otherwise(s) + 1e-6)).alias("z"))


@query("double_lag_ratio", f"""WITH {_ORDERS_CTE}, l AS (SELECT *, lag(disc) OVER ({_WO})/(lag(tax) OVER ({_WO}) + 1e-6::DOUBLE) AS y FROM g), r AS (SELECT *, CASE WHEN y IS NOT NULL THEN least(greatest(y, 0), 5) END AS x FROM l)
  SELECT o_orderkey, {fixed_sql(roll_sql('avg', 'x', 5, 1, _WO))} AS r5, {fixed_sql(roll_sql('avg', 'x', 10, 1, _WO))} AS r10 FROM r""")
def double_lag_ratio(spark, sf):
    df, spec = order_log(spark, sf)
    lag = lambda c: F.lag(c).over(spec)
    df = df.withColumn("x", clip(lag("disc") / (lag("tax") + 1e-6), 0, 5))
    return df.select("o_orderkey", *[fixed(w.rolling(F.avg, F.col("x"), spec, n)).alias(f"r{n}") for n in (5, 10)])


@query("sequence_windows", f"""WITH e AS (SELECT event_id, value, list(value) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS seen FROM events)
  SELECT event_id, value AS target, seen[1] AS first, seen[10] AS last, {fixed_sql('list_sum(seen)')} AS total FROM e WHERE len(seen) = 10""")
def sequence_windows(spark, sf):
    df, spec = events(spark, sf)
    df = df.withColumn("seen", w.sequences(F.col("value"), spec, 10)).where("seen is not null")
    return df.select("event_id", F.col("value").alias("target"), F.element_at("seen", 1).alias("first"), F.element_at("seen", 10).alias("last"), fixed(F.aggregate("seen", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("temporal_decay", f"""WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS last FROM orders) SELECT o_orderkey, {fixed_sql("greatest(0.1, least(1.0, exp(-0.023::DOUBLE*date_diff('day', CAST(o_orderdate AS DATE), last))))")} AS weight,
  {fixed_sql("exp(-date_diff('day', CAST(o_orderdate AS DATE), last)/180.0::DOUBLE)")} AS slow FROM orders, m""")
def temporal_decay(spark, sf):
    df = w.with_overall(table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), last=F.max("day"))
    return df.select("o_orderkey", fixed(w.decay(F.col("day"), F.col("last"))).alias("weight"), fixed(F.exp(-F.datediff("last", "day") / F.lit(180.0))).alias("slow"))


@query("time_series_folds", """WITH n AS (SELECT o_orderkey, ntile(6) OVER (ORDER BY o_orderdate, o_orderkey) AS part FROM orders)
  SELECT CAST(f AS INT) AS fold, CAST(count(*) FILTER (part <= f) AS BIGINT) AS n_train, CAST(count(*) FILTER (part = f + 1) AS BIGINT) AS n_test FROM n, range(1, 6) t(f) GROUP BY f""")
def time_series_folds(spark, sf):
    # the parts of ntile from row numbers that need no single task
    df = w.numbered(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    df = w.with_overall(df, n=F.count("*"))
    size, more = F.floor(F.col("n") / 6), F.col("n") % 6
    part = F.when(F.col("row_no") < more * (size + 1), F.floor(F.col("row_no") / (size + 1))).otherwise(more + F.floor((F.col("row_no") - more * (size + 1)) / size)) + 1
    counts = df.groupBy(part.alias("part")).agg(F.count("*").alias("c"))
    folds = counts.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(1, 6)])))
    return folds.groupBy("fold").agg(F.coalesce(F.sum(F.when(F.col("part") <= F.col("fold"), F.col("c"))), F.lit(0)).alias("n_train"), F.coalesce(F.sum(F.when(F.col("part") == F.col("fold") + 1, F.col("c"))), F.lit(0)).alias("n_test"))


@query("season_label", """SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) >= 10 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS VARCHAR) || '-' || lpad(CAST((CASE WHEN month(o_orderdate) >= 10 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END) % 100 AS VARCHAR), 2, '0') AS season FROM orders""")
def season(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", season_label(F.col("o_orderdate")).alias("season"))


@query("fourier_season", "SELECT o_orderkey, " + ", ".join(f"{fixed_sql(f'{f}(dayofyear(o_orderdate)*{k}*2*pi()/365)')} AS {f}_{k}" for k in (1, 2) for f in ("sin", "cos")) + " FROM orders")
def fourier_season(spark, sf):
    day = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", *[fixed(c).alias(f"{n}_{k}") for k in (1, 2) for n, c in zip(("sin", "cos"), fourier(day, k))])
