"""URL filters: association rules over URL tokens, mined by FP-growth from labels.

Fixed rules come first; the longest that fits decides. All other URLs are judged by mined rules: sets
of tokens (labels of the host, parts of the path, names of parameters) that go with bad pages at the
least confidence and support. Rules are matched through an inverted index from token to rule. Only
DataFrame and SQL operations run, on distinct URLs, so a frequent URL is judged once.

Null URLs and those without "://" have an empty host and path and no tokens; no rule fits them and
they're allowed. Repeated rows repeat; of several labels of a page the best counts. An empty table gives an empty one; without labels no rules are
mined and all is allowed that no fixed rule blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, light

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Of the labelled URLs, the least share and number that hold a rule's tokens and are bad; the least share of bad ones among those that hold them.
SUPPORT, COUNT, CONFIDENCE = 0.004, 20, 0.8
#: Tokens of a mined rule, at most.
LENGTH = 3
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _CAPITALS, _SMALL)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name = verdict = None
    for rule_host, rule_path, say in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, say) if verdict is None else verdict.when(fits, say)
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def tokens(url: Column) -> Column:
    """Distinct tokens: h= for the parts of the host, p= of the path, q= for parameters' names; numbers are one token."""
    low = F.translate(F.coalesce(url, F.lit("")), _CAPITALS, _SMALL)
    plain = lambda c, split: F.filter(F.split(c, split), lambda x: F.length(x) > 0)
    named = lambda kind, parts: F.transform(parts, lambda x: F.concat(F.lit(kind), F.when(x.rlike("^[0-9]+$"), "#").otherwise(x)))
    query = F.regexp_extract(low, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(plain(query, "&"), lambda x: F.regexp_extract(x, "(?s)^[^=]*", 0))
    return F.array_distinct(F.concat(named("h=", plain(host(low), "[.:-]")), named("p=", plain(path(low), "[/._-]")), named("q=", names)))


def rule_labels(pages: DataFrame, rules=RULES) -> DataFrame:
    """doc_id (the page's) and quality of the pages that a fixed rule covers: 0 where it blocks, else 1."""
    _, said = fixed_rule(host(F.col("url")), path(F.col("url")), rules)
    rows = pages.select(F.col("page_id").alias("doc_id"), said.alias("said")).where("said is not null")
    return rows.select("doc_id", F.when(F.col("said") == "block", 0).otherwise(1).alias("quality"))


def mine(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """rule (array of tokens), confidence, support: combinations that go with label `bad`."""
    from pyspark.ml.fpm import FPGrowth

    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = pages.select(F.col("page_id").alias("doc_id"), tokens(F.col("url")).alias("tokens")).join(known, "doc_id")
    items = cut(rows.select(F.when(F.col("quality") == 0, F.concat("tokens", F.array(F.lit("bad")))).otherwise(F.col("tokens")).alias("items")).where("size(items) > 0"), "items")
    n = items.count()
    spark = pages.sparkSession
    if not n:
        return spark.createDataFrame([], "rule array<string>, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(SUPPORT, COUNT / n)), minConfidence=CONFIDENCE).fit(items)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == "bad") & (F.size("antecedent") <= LENGTH))
    return found.select(F.array_sort("antecedent").alias("rule"), "confidence", "support")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url and its most confident matching rule, of urls (url) that match any."""
    numbered = rules.withColumn("id", F.concat_ws("\u0001", "rule"))
    index = light(cut(numbered.select("id", "confidence", F.size("rule").alias("n"), F.explode("rule").alias("token")), "index"))
    hits = urls.select("url", F.explode(tokens(F.col("url"))).alias("token")).join(index, "token")
    full = hits.groupBy("url", "id", "n", "confidence").agg(F.count("*").alias("found")).where("found = n")
    return full.groupBy("url").agg(F.max(F.struct("confidence", "id"))["id"].alias("mined"))


def url_filter(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, mined (tokens of the mined rule that blocks, else null) and verdict of pages (page_id, url, ...)."""
    url = F.col("url")
    rows = pages.select("page_id", "url", host(url).alias("host"), path(url).alias("path"))
    name, said = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "said": said})
    open_urls = rows.where("said is null and url is not null").select("url").distinct()
    matched = light(cut(match(open_urls, mine(pages, labels)), "matched"))
    out = rows.join(matched, "url", "left")
    mined = F.when(F.col("said").isNull(), F.split("mined", "\u0001"))
    return out.select("page_id", "url", "host", "path", "rule", mined.alias("mined"), F.coalesce("said", F.when(F.col("mined").isNotNull(), "block"), F.lit("allow")).alias("verdict"))
