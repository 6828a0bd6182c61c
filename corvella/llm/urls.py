"""URL filters: a sort-merge range join of hosts with nested host rules.

A host's canonical key is its labels in reverse, each followed by a dot
(``example.org`` -> ``org.example.``), so a rule's host and all its subdomains
are one interval of keys, and two such intervals are nested or apart. Hosts
and rule hosts are sorted together by key in range blocks. A sweep over each
block keeps a stack with a slot for each label depth: a rule host fills the
slot of its depth, and a slot counts as popped where its key is no longer a
prefix of the key at hand. The slots open at a block's start are carried in
from a prefix scan over one row a block. A page then tests only the paths of
the rules on its host's stack; the longest rule wins, at equal length the
deeper host's.

Only DataFrame functions run. The sweep sees each host once, so a host with a
third of all pages is one row there; the way back to pages is a sort-merge
join whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import partitions, shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_TYPE = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end; A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules: (verdict, host, path after the first slash)."""
    return spark.createDataFrame([(h, f"/{p}", v) for v, h, p in rules], RULE_TYPE)


def rules_on_stack(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and stack: the rules of all rule hosts that a host lies under.

    hosts: distinct host. rules: host, path, verdict; the rules of one host
    travel as an array, so a host's own rule list must fit in a row. Null and
    empty rule hosts fit nothing, repeated rules count once, no rules or no
    hosts are fine; very long hosts are keys like any other.
    """
    spark = hosts.sparkSession
    at = F.struct((-F.length("path")).alias("less"), "path", "verdict")
    per_host = rules.where(F.col("host").isNotNull() & (F.col("host") != "")).groupBy("host").agg(F.array_sort(F.collect_set(at)).alias("found"))
    per_host = per_host.select("host", host_key(F.col("host")).alias("key"), F.size(F.split("host", r"\.")).alias("depth"), "found")
    depths = [r.depth for r in per_host.select("depth").distinct().orderBy("depth").collect()]  # label depths: few
    if not depths:
        return hosts.select("host", F.array().cast("array<struct<host:string,path:string,verdict:string>>").alias("stack"))
    slot = F.struct("key", "host", "found")
    points = per_host.select("key", F.lit(0).alias("kind"), "host", *[F.when(F.col("depth") == d, slot).alias(f"slot{d}") for d in depths])
    empty = F.lit(None).cast(points.schema[f"slot{depths[0]}"].dataType)
    points = points.unionByName(hosts.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host", *[empty.alias(f"slot{d}") for d in depths]))
    blocks = shared(points.repartitionByRange(partitions(spark), "key", "kind").withColumn("block", F.spark_partition_id()))
    # One row a block: the last rule host of each depth in it, then in all blocks before it.
    ends = blocks.groupBy("block").agg(*[F.max(F.col(f"slot{d}")).alias(f"slot{d}") for d in depths])
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("block", *[F.last(f"slot{d}", ignorenulls=True).over(before).alias(f"carried{d}") for d in depths])
    sweep = Window.partitionBy("block").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = blocks.select("block", "key", "kind", "host", *[F.last(f"slot{d}", ignorenulls=True).over(sweep).alias(f"slot{d}") for d in depths]).where("kind = 1")
    swept = swept.join(carried, "block", "left")

    def open_rules(top: Column) -> Column:
        rules_here = F.transform(top["found"], lambda r: F.struct(top["host"].alias("host"), r["path"].alias("path"), r["verdict"].alias("verdict")))
        return F.when(F.startswith(F.col("key"), top["key"]), rules_here).otherwise(F.array().cast("array<struct<host:string,path:string,verdict:string>>"))

    stack = [open_rules(F.coalesce(F.col(f"slot{d}"), F.col(f"carried{d}"))) for d in depths]
    return swept.select("host", F.concat(*stack).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    Null urls and urls without :// have an empty host and path, no rule and
    the default verdict, as has any page that no rule fits. Repeated pages are
    judged each; an empty table or rule list is fine; other columns of pages
    are ignored; very long urls are read whole. Of rules with one host and path the smallest verdict counts.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    stacks = rules_on_stack(parts.select("host").distinct(), rules).select(F.col("host").alias("stack_host"), "stack")
    fitting = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(fitting, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("size"), F.length(r["host"]).alias("host_size"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict")))
    best = F.array_max(F.transform(ranked, lambda r: F.struct(r["size"], r["host_size"], r["rule"], F.when(r["verdict"] == "allow", 1).otherwise(0), r["verdict"].alias("verdict"))))
    joined = parts.join(stacks, parts.host == stacks.stack_host, "left").withColumn("best", best)
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
