"""Joins, aggregates, top-k, set operations, ladders and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.columns import fixed, fixed_sql
from ..operators import relational as r
from ..operators import windows as w
from .registry import query, table
from .windowed import _ORDERS_CTE, roll_sql


@query("group_quantile_cap", f"""WITH q AS (SELECT user_id, quantile_cont(value, 0.99) AS q, count(value) AS n FROM events GROUP BY 1), g AS (SELECT quantile_cont(value, 0.99) AS gq FROM events)
  SELECT event_id, {fixed_sql('least(value, CASE WHEN n >= 5 THEN q ELSE gq END)')} AS value_clean FROM events JOIN q USING (user_id), g""")
def group_quantile_cap(spark, sf):
    out = r.cap_at_quantile(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "value")
    return out.select("event_id", fixed(F.col("value_clean")).alias("value_clean"))


@query("multi_agg_group", f"""SELECT l_suppkey, {fixed_sql('avg(l_quantity)')} AS mean_q, {fixed_sql('stddev_samp(l_quantity)')} AS std_q, CAST(count(*) AS BIGINT) AS n, max(l_quantity) AS max_q, min(l_quantity) AS min_q,
  {fixed_sql('avg(l_extendedprice)')} AS mean_p, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_orders FROM lineitem GROUP BY 1""")
def multi_agg_group(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        fixed(F.avg("l_quantity")).alias("mean_q"), fixed(F.stddev_samp("l_quantity")).alias("std_q"), F.count("*").alias("n"), F.max("l_quantity").alias("max_q"), F.min("l_quantity").alias("min_q"),
        fixed(F.avg("l_extendedprice")).alias("mean_p"), F.countDistinct("l_orderkey").alias("n_orders"))


@query("last_row_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def last_row_per_group(spark, sf):
    last = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))  # combines before the shuffle, unlike a window
    return table(spark, sf, "orders").groupBy("o_custkey").agg(last.alias("x")).select("o_custkey", "x.o_orderkey", "x.o_totalprice")


_LINE = "l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity"


@query("topk_per_group", f"SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, k AS rank_in_group FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE}) AS INT) AS k FROM lineitem) WHERE k <= 12")
def topk_per_group(spark, sf):
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity"]
    return r.top_k(table(spark, sf, "lineitem"), ["l_suppkey"], order, 12).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank_in_group")


@query("recent_n_dedup", f"""WITH d AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders), o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, day ORDER BY o_orderkey DESC) AS x FROM d),
  k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC) AS rk FROM o WHERE x = 1), a AS (SELECT o_custkey, avg(o_totalprice) FILTER (rk <= 3) AS recent, avg(o_totalprice) FILTER (rk > 3) AS older, count(*) AS n FROM k WHERE rk <= 5 GROUP BY 1),
  t AS (SELECT *, CASE WHEN older > 0 THEN (recent - older)/older*100 END AS change FROM a)
  SELECT o_custkey, {fixed_sql('recent')} AS recent, CAST(n AS BIGINT) AS n, CASE WHEN n >= 3 AND change > 10 THEN 'up' WHEN n >= 3 AND change < -10 THEN 'down' ELSE 'flat' END AS trend FROM t""")
def recent_n_dedup(spark, sf):
    rows = r.recent_distinct(table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate")), ["o_custkey"], "day", [F.desc("o_orderkey")], 5)
    return r.recent_trend(rows, ["o_custkey"], "o_totalprice").select("o_custkey", fixed(F.col("recent")).alias("recent"), "n", "trend")


@query("league_averages", f"""WITH l AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500) SELECT {fixed_sql('avg(o_totalprice)')} AS mean_price, CAST(count(*) AS BIGINT) AS n FROM l HAVING count(*) >= 50""")
def league_averages(spark, sf):
    last = table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(500)
    return last.agg(fixed(F.avg("o_totalprice")).alias("mean_price"), F.count("*").alias("n")).where("n >= 50")


_MONTHS = "SELECT c_nationkey, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS t FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL"


@query("win_probability", f"WITH t AS ({_MONTHS}) SELECT a.c_nationkey AS a, b.c_nationkey AS b, {fixed_sql('avg(CASE WHEN a.t > b.t THEN 1.0::DOUBLE ELSE 0 END)')} AS p, CAST(count(*) AS BIGINT) AS n FROM t a JOIN t b ON a.m = b.m AND a.c_nationkey < b.c_nationkey GROUP BY ALL")
def win_probability(spark, sf):
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    t = orders.groupBy("c_nationkey", F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("t"))
    a, b = t.select(F.col("c_nationkey").alias("a"), "m", F.col("t").alias("ta")), t.select(F.col("c_nationkey").alias("b"), "m", F.col("t").alias("tb"))
    return a.join(b, "m").where("a < b").groupBy("a", "b").agg(fixed(F.avg((F.col("ta") > F.col("tb")).cast("double"))).alias("p"), F.count("*").alias("n"))


_P = (0.005, 0.05, 0.95, 0.995)


@query("sim_summary", f"SELECT event_type, {fixed_sql('avg(value)')} AS mean, {fixed_sql('stddev_pop(value)')} AS std, " + ", ".join(f"{fixed_sql(f'quantile_cont(value, {p})')} AS p{k}" for k, p in enumerate(_P)) + " FROM events GROUP BY 1")
def sim_summary(spark, sf):
    q = F.percentile("value", [float(p) for p in _P])
    out = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), q.alias("q"))
    return out.select("event_type", fixed(F.col("mean")).alias("mean"), fixed(F.col("std")).alias("std"), *[fixed(F.col("q")[k]).alias(f"p{k}") for k in range(len(_P))])


@query("mode_histogram", """WITH m AS (SELECT l_suppkey, l_quantity, min(l_quantity) OVER (PARTITION BY l_suppkey) AS lo, count(*) OVER (PARTITION BY l_suppkey) AS n, avg(l_quantity) OVER (PARTITION BY l_suppkey) AS a FROM lineitem),
  b AS (SELECT l_suppkey, lo, n, a, floor((l_quantity - lo + 0.25)/0.5) AS bin, count(*) AS c FROM m GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY c DESC, bin) AS r FROM b)
  SELECT l_suppkey, CASE WHEN n < 3 THEN a ELSE lo + bin*0.5 END AS mode FROM k WHERE r = 1""")
def mode_histogram(spark, sf):
    return r.mode_of_halves(table(spark, sf, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity")


_GUESS = f"WITH e AS (SELECT user_id, event_type, value, {roll_sql('avg', 'value', 10, 3)} AS guess FROM events)"


@query("regression_metrics", f"""{_GUESS}, d AS (SELECT *, value - guess AS e FROM e WHERE guess IS NOT NULL) SELECT event_type, CAST(count(*) AS BIGINT) AS n, {fixed_sql('avg(abs(e))')} AS mae, {fixed_sql('sqrt(avg(e*e))')} AS rmse,
  {fixed_sql('avg(abs(e)/greatest(value, 1.0))*100')} AS mape, {fixed_sql('avg(e)')} AS bias, {fixed_sql('quantile_cont(e, 0.5)')} AS median_error, {fixed_sql('max(abs(e))')} AS worst, {fixed_sql('avg(CASE WHEN abs(e) > 10 THEN 1.0::DOUBLE ELSE 0 END)')} AS over_10 FROM d GROUP BY 1""")
def regression_metrics(spark, sf):
    df = guesses(spark, sf)
    out = r.regression_metrics(df, "value", "guess", ["event_type"])
    return out.select("event_type", "n", *[fixed(F.col(x)).alias(x) for x in ("mae", "rmse", "mape", "bias", "median_error", "worst", "over_10")])


def guesses(spark, sf):
    """Events with the lagged rolling mean as their prediction."""
    df = table(spark, sf, "events")
    return df.withColumn("guess", w.rolling(F.avg, F.col("value"), w.ordered(["user_id"], ["ts", "event_id"]), 10, 3))


@query("left_join_default", f"WITH {_ORDERS_CTE} SELECT o_orderkey, {fixed_sql('coalesce(qty, 28)')} AS qty, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines FROM g")
def left_join_default(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n_lines"))
    out = r.left_with_defaults(table(spark, sf, "orders").select("o_orderkey"), lines, ["o_orderkey"], {"qty": 28.0, "n_lines": 0})
    return out.select("o_orderkey", fixed(F.col("qty")).alias("qty"), "n_lines")


@query("semi_anti", "SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_lines FROM orders")
def semi_anti(spark, sf):
    orders, lines = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(lines, "o_orderkey", "left_semi").withColumn("has_lines", F.lit(True)).union(orders.join(lines, "o_orderkey", "left_anti").withColumn("has_lines", F.lit(False)))


@query("asof_previous", """WITH d AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders), p AS (SELECT a.o_orderkey, max_by(b.o_orderkey, (b.day, b.o_orderkey)) AS prev_key, CAST(count(b.o_orderkey) FILTER (b.day >= a.day - 365) AS BIGINT) AS n_year
  FROM d a LEFT JOIN d b ON a.o_custkey = b.o_custkey AND b.day < a.day GROUP BY 1) SELECT * FROM p""")
def asof_previous(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    out = r.asof_previous(df, ["o_custkey"], "day", "o_orderkey", ["o_orderkey"])
    days = Window.partitionBy("o_custkey").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(-365, -1)
    return out.select("o_orderkey", F.col("prev_o_orderkey").alias("prev_key"), F.count("*").over(days).alias("n_year"))


@query("cooccurrence_graph", f"""WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), p AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey <> y.l_suppkey GROUP BY ALL)
  SELECT a, b, CAST(n AS BIGINT) AS n, {fixed_sql('n/sum(n) OVER (PARTITION BY a)')} AS share FROM p""")
def cooccurrence_graph(spark, sf):
    return r.cooccurrence(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey").select("a", "b", "n", fixed(F.col("share")).alias("share"))


@query("pairwise_rules", f"""WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey, s_nationkey, n_regionkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
  SELECT CASE WHEN x.s_nationkey = y.s_nationkey THEN 'same nation' WHEN x.n_regionkey = y.n_regionkey THEN 'same region' ELSE 'apart' END AS rule, CAST(count(*) AS BIGINT) AS n,
  {fixed_sql('avg(CASE WHEN x.s_nationkey = y.s_nationkey THEN 0.15::DOUBLE WHEN x.n_regionkey = y.n_regionkey THEN 0.08 ELSE -0.05 END)')} AS corr FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1""")
def pairwise_rules(spark, sf):
    nations = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_regionkey")
    s = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct().join(nations, F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey")
    both = s.join(s.toDF("l_orderkey", "other", "on", "og"), "l_orderkey").where("l_suppkey < other")
    same, near = F.col("s_nationkey") == F.col("on"), F.col("n_regionkey") == F.col("og")
    rule = c.ladder((same, "same nation"), (near, "same region"), otherwise="apart")
    corr = c.ladder((same, 0.15), (near, 0.08), otherwise=-0.05)
    return both.select(rule.alias("rule"), corr.alias("corr")).groupBy("rule").agg(F.count("*").alias("n"), fixed(F.avg("corr")).alias("corr"))


@query("position_matchup", f"""WITH a AS (SELECT c_nationkey AS k, avg(c_acctbal) AS x FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, avg(s_acctbal) AS y FROM supplier GROUP BY 1), d AS (SELECT k, x - y AS diff FROM a JOIN b USING (k))
  SELECT k AS nation, {fixed_sql('diff')} AS diff, CASE WHEN diff > 3 THEN 'customers' WHEN diff < -3 THEN 'suppliers' ELSE 'even' END AS edge, {fixed_sql('abs(diff)/10')} AS size FROM d""")
def position_matchup(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("x"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.avg("s_acctbal").alias("y"))
    d = a.join(b, "nation").withColumn("d", F.col("x") - F.col("y"))
    return d.select("nation", fixed(F.col("d")).alias("diff"), c.ladder((F.col("d") > 3, "customers"), (F.col("d") < -3, "suppliers"), otherwise="even").alias("edge"), fixed(F.abs("d") / 10).alias("size"))


@query("upsert_keep_last", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert_keep_last(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    old = orders.where("o_orderkey % 5 < 3 or o_orderkey % 3 != 0")
    new = orders.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return r.upsert(old, new, ["o_orderkey"])


@query("set_ops", """SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)
  UNION ALL SELECT 'either', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'all', CAST(count(*) AS INT) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)""")
def set_ops(spark, sf):
    a, b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "k")
    return kind(a.intersect(b), "both").union(kind(a.subtract(b), "customers only")).union(kind(a.union(b).distinct(), "either")).union(kind(a.unionAll(b).agg(F.count("*").cast("int").alias("k")), "all"))


@query("chunked_union_dedupe", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def chunked_union_dedupe(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    first, second = orders.where("month <= '1998-06'"), orders.where("month >= '1998-01'")
    return first.unionByName(second).dropDuplicates(["o_orderkey"])


@query("case_ladders", f"""SELECT p_partkey, CASE WHEN p_size >= 40 AND p_retailprice >= 1500 THEN 'C' WHEN p_size >= 35 THEN 'PF' WHEN p_size % 10 >= 6 THEN 'PG' WHEN p_size % 10 >= 3 THEN 'SG' ELSE 'SF' END AS position,
  {fixed_sql("CASE WHEN p_size % 7 = 0 THEN 0.96::DOUBLE WHEN p_size % 5 = 0 THEN 0.975 WHEN p_size % 6 = 2 THEN 1.0 WHEN p_size % 6 = 3 THEN 1.01 WHEN p_size % 6 >= 4 THEN 1.005 ELSE 1.0 END")} AS rest,
  {fixed_sql("CASE WHEN p_size >= 20 THEN 1.0::DOUBLE WHEN p_size >= 10 THEN 0.95 WHEN p_size >= 5 THEN 0.85 WHEN p_size >= 1 THEN 0.7 ELSE 0.5 END")} AS confidence,
  CASE WHEN p_size <= 5 THEN 'elite' WHEN p_size <= 10 THEN 'good' WHEN p_size <= 20 THEN 'average' WHEN p_size <= 25 THEN 'poor' ELSE 'weak' END AS rank_text FROM part""")
def case_ladders(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", F.when((s >= 40) & (F.col("p_retailprice") >= 1500), "C").otherwise(c.position(F.when(s >= 35, 7).otherwise(0), s % 10, F.lit(0.0))).alias("position"),
        fixed(c.rest_multiplier(s % 6, s % 7 == 0, s % 5 == 0)).alias("rest"), fixed(c.confidence(s)).alias("confidence"), c.rank_text(s).alias("rank_text"))


_STATUS = [("out", 0.0), ("Out - Knee", 0.0), ("doubtful", 0.25), (" GTD ", 0.5), ("day-to-day (ankle)", 0.5), ("Probable", 0.85), ("active", 1.0), ("unknown", 0.7), ("", 0.7)]


@query("status_probability", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {int(p * 100)})" for s, p in _STATUS) + ") t(status, p)")
def status_probability(spark, sf):
    df = spark.createDataFrame([(s,) for s, _ in _STATUS], "status string")
    return df.select("status", F.round(c.status_probability(F.col("status")) * 100).cast("int").alias("p"))


@query("fallback_chain", f"""WITH e AS (SELECT event_id, value, {roll_sql('avg', 'value', 10, 3)} AS a, {roll_sql('avg', 'value', 20, 6)} AS b FROM events) SELECT event_id, {fixed_sql('CASE WHEN a > 50 THEN a WHEN b > 40 THEN b WHEN value > 100 THEN value ELSE 12.5::DOUBLE END')} AS v FROM e""")
def fallback_chain(spark, sf):
    spec = w.ordered(["user_id"], ["ts", "event_id"])
    v = F.col("value")
    e = table(spark, sf, "events").select("event_id", "value", w.rolling(F.avg, v, spec, 10, 3).alias("a"), w.rolling_mean_by_blocks(v, spec, 20, 6).alias("b"))
    over = lambda x, low: F.when(F.col(x) > low, F.col(x))
    return e.select("event_id", fixed(c.first_positive(over("a", 50), over("b", 40), over("value", 100), default=12.5)).alias("v"))


@query("minutes_parse", f"""WITH m AS (SELECT DISTINCT CAST(l_quantity AS INT) AS q FROM lineitem), t AS (SELECT q, CASE q % 5 WHEN 0 THEN CAST(q AS VARCHAR) || ':30' WHEN 1 THEN CAST(q AS VARCHAR) WHEN 2 THEN '' WHEN 3 THEN 'x' || CAST(q AS VARCHAR) ELSE CAST(q * 2 AS VARCHAR) || ':00' END AS s FROM m)
  SELECT q, s, CASE q % 5 WHEN 0 THEN CAST(floor(q*100 + 50) AS BIGINT) WHEN 1 THEN q*100 WHEN 4 THEN least(q*200, 6000) END AS minutes FROM t""")
def minutes_parse(spark, sf):
    q = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("q")).distinct()
    m = F.col("q") % 5
    text = F.when(m == 0, F.concat(F.col("q").cast("string"), F.lit(":30"))).when(m == 1, F.col("q").cast("string")).when(m == 2, "").when(m == 3, F.concat(F.lit("x"), F.col("q").cast("string"))).otherwise(F.concat((F.col("q") * 2).cast("string"), F.lit(":00")))
    return q.withColumn("s", text).withColumn("minutes", F.round(c.minutes(F.col("s")) * 100).cast("long"))


@query("name_search", """WITH p AS (SELECT p_partkey, p_name, lower(p_name) AS n FROM part), t AS (SELECT *, n LIKE '%zzz 12%' AS a, n LIKE '%zzz%' AS b FROM p) SELECT p_partkey, p_name FROM t WHERE a OR (b AND NOT EXISTS (SELECT 1 FROM t WHERE a))
  UNION ALL SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%00012%'""")
def name_search(spark, sf):
    part, customer = table(spark, sf, "part"), table(spark, sf, "customer")
    a = r.search_name(part, "p_name", "zzz 12").select("p_partkey", "p_name")
    return a.union(r.search_name(customer, "c_name", "00012").select("c_custkey", "c_name"))


@query("team_alias_normalise", "SELECT n_nationkey, r_name, upper(substr(replace(n_name, ' ', ''), 1, 3)) AS abbr FROM nation JOIN region ON r_regionkey = n_regionkey")
def team_alias_normalise(spark, sf):
    return table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "r_name", F.upper(F.substring(F.replace("n_name", F.lit(" "), F.lit("")), 1, 3)).alias("abbr"))


@query("json_props", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def json_props(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("inverted_name_index", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) SELECT token, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS tf, min(doc_id) AS first_doc FROM w WHERE length(token) >= 3 GROUP BY 1""")
def inverted_name_index(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")).where("length(token) >= 3")
    per = words.groupBy("token", "doc_id").agg(F.count("*").alias("c"))  # first per document: a token's documents combine before the shuffle
    return per.groupBy("token").agg(F.count("*").alias("df"), F.sum("c").alias("tf"), F.min("doc_id").alias("first_doc"))


@query("lineup_continuity", f"""WITH s AS (SELECT o_custkey, o_orderkey, list_sort(list(DISTINCT l_suppkey)) AS x, any_value(o_orderdate) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2), l AS (SELECT *, lag(x) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey) AS p FROM s)
  SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, {fixed_sql('avg(CASE WHEN x <> p THEN 1.0::DOUBLE ELSE 0 END)')} AS change_rate, {fixed_sql('avg(len(list_intersect(x, p))/5.0::DOUBLE)')} AS overlap FROM l WHERE p IS NOT NULL GROUP BY 1""")
def lineup_continuity(spark, sf):
    s = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("x"), F.first("o_orderdate").alias("d"))
    s = s.withColumn("p", F.lag("x").over(Window.partitionBy("o_custkey").orderBy("d", "o_orderkey"))).where("p is not null")
    return s.groupBy("o_custkey").agg(F.count("*").alias("n"), fixed(F.avg((F.col("x") != F.col("p")).cast("double"))).alias("change_rate"), fixed(F.avg(F.size(F.array_intersect("x", "p")) / F.lit(5.0))).alias("overlap"))


@query("weighted_blend", f"""SELECT l_suppkey, {fixed_sql('sum(l_extendedprice/(l_discount+0.01))/sum(1/(l_discount+0.01))')} AS blended, {fixed_sql('stddev_pop(l_extendedprice)')} AS spread FROM lineitem GROUP BY 1""")
def weighted_blend(spark, sf):
    weight = 1 / (F.col("l_discount") + 0.01)
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(fixed(F.sum(F.col("l_extendedprice") * weight) / F.sum(weight)).alias("blended"), fixed(F.stddev_pop("l_extendedprice")).alias("spread"))


@query("temporal_split", """WITH m AS (SELECT max(o_orderdate) - INTERVAL 365 DAY AS d FROM orders) SELECT CASE WHEN o_orderdate < d THEN 'train' ELSE 'test' END AS part, CAST(count(*) AS BIGINT) AS n FROM orders, m GROUP BY 1""")
def temporal_split(spark, sf):
    df = w.with_overall(table(spark, sf, "orders").select("o_orderdate"), last=F.max("o_orderdate"))
    part = F.when(F.col("o_orderdate") < F.col("last") - F.expr("interval 365 days"), "train").otherwise("test")
    return df.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("roster_filter", """WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS last FROM orders), f AS (SELECT c_nationkey, o_custkey, max(o_totalprice) AS best FROM orders JOIN customer ON c_custkey = o_custkey, m WHERE CAST(o_orderdate AS DATE) >= last - 90 AND o_totalprice >= 5 GROUP BY 1, 2),
  k AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY best DESC, o_custkey) AS INT) AS rank_in_group FROM f) SELECT c_nationkey, o_custkey, rank_in_group FROM k WHERE rank_in_group <= 12""")
def roster_filter(spark, sf):
    df = w.with_overall(table(spark, sf, "orders").select("o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day")), last=F.max("day"))
    recent = df.where("day >= date_sub(last, 90) and o_totalprice >= 5").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"))
    rows = recent.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    return r.top_k(rows, ["c_nationkey"], [F.desc("best"), "o_custkey"], 12).select("c_nationkey", "o_custkey", "rank_in_group")


