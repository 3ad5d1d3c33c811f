"""Joins, aggregates, top-k and set operators of the per-entity logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_with_defaults(left: DataFrame, right: DataFrame, keys: Sequence[str], defaults: dict[str, object], suffix: str = "_R") -> DataFrame:
    """Left outer join; right columns that clash get the suffix, and missing ones a default."""
    clash = {c for c in right.columns if c in left.columns and c not in keys}
    right = right.withColumnsRenamed({c: c + suffix for c in clash})
    out = left.join(right, list(keys), "left")
    return out.fillna(defaults) if defaults else out


def others_of_group(df: DataFrame, group: str, member: str, columns: Sequence[str], suffix: str = "_OPP") -> DataFrame:
    """Self-join on the group with another member: each row with every other member's columns."""
    other = df.select(F.col(group), F.col(member).alias(f"{member}{suffix}"), *[F.col(c).alias(c + suffix) for c in columns])
    return df.join(other, group).where(F.col(member) != F.col(f"{member}{suffix}"))


def asof_previous(df: DataFrame, keys: Sequence[str], time: str, tie: str, take: Sequence[str]) -> DataFrame:
    """Each row with the columns of the key's last row whose time is strictly earlier, by a window instead of a range join."""
    # the last row of each earlier time: rows of one time share it
    times = Window.partitionBy(*keys, time).orderBy(F.desc(tie))
    last = df.withColumn("__r", F.row_number().over(times)).where("__r = 1").drop("__r")
    step = Window.partitionBy(*keys).orderBy(time)
    before = last.select(*keys, time, *[F.lag(c).over(step).alias(f"prev_{c}") for c in take])
    return df.join(before, [*keys, time])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank_in_group") <= k)


def recent_distinct(df: DataFrame, keys: Sequence[str], day: str, order: Sequence[Column], k: int) -> DataFrame:
    """The k newest rows of a key, one per day."""
    one = df.withColumn("__d", F.row_number().over(Window.partitionBy(*keys, day).orderBy(*order))).where("__d = 1").drop("__d")
    return top_k(one, keys, [F.desc(day)], k)


def recent_trend(df: DataFrame, keys: Sequence[str], value: str, rank: str = "rank_in_group") -> DataFrame:
    """Mean of the newest 3 against the rest: percent change and its class; `flat` where there are too few rows."""
    new, old = F.avg(F.when(F.col(rank) <= 3, F.col(value))), F.avg(F.when(F.col(rank) > 3, F.col(value)))
    out = df.groupBy(*keys).agg(new.alias("recent"), old.alias("older"), F.count("*").alias("n"))
    change = F.when(F.col("older") > 0, (F.col("recent") - F.col("older")) / F.col("older") * 100)
    return out.withColumn("change", change).withColumn("trend", F.when((F.col("n") >= 3) & (F.col("change") > 10), "up").when((F.col("n") >= 3) & (F.col("change") < -10), "down").otherwise("flat"))


def cap_at_quantile(df: DataFrame, key: str, column: str, q: float = 0.99, least: int = 5) -> DataFrame:
    """The column capped at its key's exact quantile, or at the global one for keys with few rows; as `{column}_clean`."""
    per_key = df.groupBy(key).agg(F.percentile(column, q).alias("__q"), F.count(column).alias("__n"))
    whole = df.agg(F.percentile(column, q).alias("__g"))
    out = df.join(per_key, key).crossJoin(F.broadcast(whole))
    cap = F.when(F.col("__n") >= least, F.col("__q")).otherwise(F.col("__g"))
    return out.withColumn(f"{column}_clean", F.when(F.col(column).isNotNull(), F.least(column, cap))).drop("__q", "__n", "__g")


def cooccurrence(df: DataFrame, group: str, member: str) -> DataFrame:
    """a, b, n, share: how often two members meet in a group, both ways, and the share of a's meetings."""
    rows = df.select(group, member).distinct()
    other = rows.withColumnRenamed(member, "b")
    pairs = rows.withColumnRenamed(member, "a").join(other, group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    sums = both.groupBy("a").agg(F.sum("n").alias("total"))
    return both.join(sums, "a").withColumn("share", F.col("n") / F.col("total")).drop("total")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """old and new rows, the last of each key: new ones win, and among them the largest by `order`."""
    both = old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("__src"), *([F.desc(order)] if order else []))
    return both.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r", "__src")


def mode_of_halves(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The mode by a histogram of width 1/2 from the key's least value; the mean where a key has under 3 values."""
    low = Window.partitionBy(*keys)
    rows = df.withColumns({"__lo": F.min(column).over(low), "__n": F.count(column).over(low), "__m": F.avg(column).over(low)})
    bins = rows.groupBy(*keys, F.floor((F.col(column) - F.col("__lo") + 0.25) / 0.5).alias("__bin"), "__lo", "__n", "__m").agg(F.count("*").alias("c"))
    best = F.max_by(F.struct(F.col("__lo") + F.col("__bin") * 0.5, "__n", "__m"), F.struct("c", -F.col("__bin")))
    out = bins.groupBy(*keys).agg(best.alias("x"))
    return out.select(*keys, F.when(F.col("x.__n") < 3, F.col("x.__m")).otherwise(F.col("x.col1")).alias("mode"))


def regression_metrics(df: DataFrame, truth: str, guess: str, keys: Sequence[str] = ()) -> DataFrame:
    e = F.col(truth) - F.col(guess)
    return df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.abs(e) / F.greatest(F.col(truth), F.lit(1.0))) * 100).alias("mape"),
        F.avg(e).alias("bias"), F.percentile(e, 0.5).alias("median_error"), F.max(F.abs(e)).alias("worst"), F.avg((F.abs(e) > 10).cast("double")).alias("over_10"))


def search_name(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose name holds the text; where none does, those that hold its first word of three letters or more that any holds."""
    low = F.lower(column)
    words = [t for t in text.lower().split() if len(t) >= 3]
    tries = [low.contains(text.lower())] + [low.contains(t) for t in words]
    level = F.coalesce(*[F.when(t, k) for k, t in enumerate(tries)])
    hits = df.withColumn("match_level", level)
    # a row's own level is its first matching try; the best level overall wins
    first = hits.agg(F.min("match_level").alias("__best"))
    out = hits.crossJoin(F.broadcast(first))
    chosen = F.element_at(F.array(*tries), F.col("__best") + 1)
    return out.where(F.col("__best").isNotNull() & chosen).withColumn("match_level", F.col("__best")).drop("__best")
