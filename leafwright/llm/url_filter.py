"""URL filters by dated lists: entries become validity intervals, met by an as-of join. SQL operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (list, verdict, host, path, action add|remove, at) as validity intervals [since, until).

    An entry holds from an add to the next remove of the same (list, verdict, host, path); an add of what
    is there changes nothing. At one time removes come before adds, so an entry renewed at once goes on.
    until is null while nothing ends it."""
    same = Window.partitionBy("list", "verdict", "host", "path").orderBy("at", F.col("action").desc())
    e = entries.where("host is not null and at is not null and action in ('add', 'remove')")
    e = e.select("list", "verdict", F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action", "at")
    e = e.withColumn("before", F.lag("action").over(same)).where("before is null or before <> action")
    e = e.withColumn("until", F.lead("at").over(same)).where("action = 'add'")
    return e.select("list", "verdict", "host", "path", F.col("at").alias("since"), "until").where("until is null or until > since")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched",
                broadcast_rows: int = 10_000) -> DataFrame:
    """One row per capture: (id, host, fetched, n_active, lists, decision).

    An entry matches a capture if its host is the capture's host or a parent domain, its path is a prefix
    of the capture's path, and it is active when the capture was fetched. Of several the most specific
    decides (longest host, then longest path, then allow before block); without any the capture is
    allowed. n_active counts matching entries, lists names their lists, sorted.

    Distinct hosts, not captures, are expanded into parent domains and joined with the entries, and most
    hosts have none; captures then meet the few entries of their host in an equi-join. Those entries are
    broadcast when there are at most `broadcast_rows`; beyond that both sides are dealt by host, in a join
    that Spark splits where one host is hot. Nothing is collected per host.

    A null or malformed URL has an empty host and path and matches nothing, a null time matches nothing.
    Repeated captures are decided alike and all returned. Other columns are ignored.
    """
    base = captures.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.col(time_col).cast("long").alias("fetched"))
    base = base.groupBy("id", "host", "path", "fetched").agg(F.count("*").alias("copies"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = base.select("host").where("host <> ''").distinct().select("host", F.explode(parents).alias("parent"))
    valid = intervals(entries).withColumnRenamed("host", "parent").withColumnRenamed("path", "under")
    rules = durable(hosts.join(valid, "parent").withColumnRenamed("host", "rule_host"), "url-rules")
    few = rules.limit(broadcast_rows + 1).count() <= broadcast_rows
    rules = F.broadcast(rules) if few else rules
    active = (F.col("host") == F.col("rule_host")) & F.col("path").startswith(F.col("under")) & (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    met = base.join(rules, active, "left")
    rank = F.when(F.col("rule_host").isNotNull(), F.struct(F.length("parent"), F.length("under"), (F.col("verdict") == "allow").cast("int")))
    out = met.groupBy("id", "host", "path", "fetched", "copies").agg(
        F.count("rule_host").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        F.coalesce(F.max_by("verdict", rank), F.lit("allow")).alias("decision"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.col("id").alias(id_col), "host", "fetched", "n_active", "lists", "decision")
