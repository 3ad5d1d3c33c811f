"""Sources, sinks and streams."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions.columns import fixed, fixed_sql
from ..sources import files, html
from ..streaming import incremental as inc
from .registry import query, table


def scratch(spark, name: str) -> str:
    """A new folder that driver and executors share; only a local master may do without spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: streams and sinks need a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "tallyspark-checkpoints")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@query("stream_incremental_upsert", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, CAST(epoch_us(max(ts)) AS BIGINT) AS ts FROM events GROUP BY 1")
def stream_incremental_upsert(spark, sf):
    at = scratch(spark, "events-in")
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts")
    for day in ("< '2024-01-11'", ">= '2024-01-11'"):  # two landings
        rows.where(f"ts {day}").coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)
    target = inc.VersionedTable(spark, scratch(spark, "events-table"), ["user_id"], "ts")
    out = inc.run_upsert(stream.withColumn("ts", F.col("ts")), target, scratch(spark, "events-checkpoint"))
    return out.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))


@query("stream_windowed_errors", f"""WITH d AS (SELECT CAST(ts AS DATE) AS day, value FROM events), w AS (SELECT unnest(generate_series(day - INTERVAL 6 DAY, CAST(day AS TIMESTAMP), INTERVAL 1 DAY)) AS s, value FROM d)
  SELECT strftime(s, '%Y-%m-%d') AS start, CAST(count(*) AS BIGINT) AS n, {fixed_sql('sum(value)')} AS total FROM w GROUP BY 1""")
def stream_windowed_errors(spark, sf):
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    name = f"errors_{uuid.uuid4().hex}"
    q = inc.windowed_errors(stream, "ts", "value", "7 days", "1 day").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "n", fixed(F.col("total")).alias("total"))


@query("windows_tumbling", f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, CAST(count(*) AS BIGINT) AS n, {fixed_sql('sum(value)')} AS total FROM events GROUP BY 1")
def windows_tumbling(spark, sf):
    """Tumbling windows, an extra of this engine."""
    df = inc.tumbling(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "1 day")
    return df.select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "n", fixed(F.col("total")).alias("total"))


@query("windows_session", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
  SELECT user_id, CAST(count(*) AS BIGINT) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM c GROUP BY 1""")
def windows_session(spark, sf):
    """Session windows, an extra of this engine."""
    df = inc.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "6 hours")
    return df.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("csv_log_roundtrip", "SELECT o_orderkey, o_custkey, CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS day, CAST(floor(o_totalprice*100+0.37) AS BIGINT) AS cents FROM orders")
def csv_log_roundtrip(spark, sf):
    at = scratch(spark, "csv")
    files.write_sorted(table(spark, sf, "orders").withColumn("o_orderdate", F.to_date("o_orderdate")), f"{at}/log_20240101_000000", ["o_orderdate", "o_orderkey"])
    log = files.read_log(spark, files.latest(spark, at, r"log_(\d{8}_\d{6})"), "o_orderkey bigint, o_custkey bigint, o_orderdate date, o_totalprice double", ["o_totalprice"])
    return log.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("day"), F.floor(F.col("o_totalprice") * 100 + 0.37).cast("long").alias("cents"))


@query("high_water_mark", "SELECT strftime(max(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS last FROM orders")
def high_water_mark(spark, sf):
    return table(spark, sf, "orders").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"))


@query("result_set_json", "SELECT c_custkey AS id, c_name AS name FROM customer")
def result_set_json(spark, sf):
    """Headers and rows as JSON, as scoreboard services give them."""
    packed = table(spark, sf, "customer").select(F.to_json(F.struct(F.array(F.lit("ID"), F.lit("NAME")).alias("headers"), F.array(F.array(F.col("c_custkey").cast("string"), "c_name")).alias("rowSet"))).alias("json"))
    rows = files.result_set(packed, "json")
    return rows.select(F.col("row")["ID"].cast("long").alias("id"), F.col("row")["NAME"].alias("name"))


@query("ttl_filter", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def ttl_filter(spark, sf):
    df = table(spark, sf, "events")
    return files.fresh(df.select("event_id", "ts").crossJoin(F.broadcast(df.agg(F.max("ts").alias("now")))), "ts", F.col("now"), "24 hours").select("event_id")


@query("html_list_scan", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS li FROM pages) SELECT page_id, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1""")
def html_list_scan(spark, sf):
    return html.list_links(table(spark, sf, "pages"), "html").groupBy("page_id").agg(F.count("*").alias("n"))
