"""URL rules by a sort-merge range join, in DataFrame functions only.

A rule (host, path, verdict) fits a url whose host is the rule's or a subdomain of it and whose path starts with the rule's.
Of the rules that fit, the longest (host and path together, then host) wins. Hosts are turned into reversed canonical keys
(``www.example.net`` -> ``net.example.www.``), so a rule's host is a prefix, hence an interval of the sorted keys, and
intervals nest. A sweep over the sorted keys keeps the stack of open intervals: as they nest, the stack after an opening or
closing is known beforehand, and the running last event is the stack at each url. A first sweep over hosts finds, for each
url, the rule hosts on the stack; a second over ``rule host + path`` finds the innermost path rule of each of these.

Keys are dealt by range together with a hash of the row, so a host with a third of all rows fills many partitions; an
interval's events go to the partitions that its range meets (found against the partitions' bounds, as many rows as there are
partitions, which alone are broadcast).

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule. Rules with a null part, an
empty host or one of ``/?#`` in the host are ignored; of rules with equal host and path, block wins over allow. Each row
of the input gives one row, repeated rows included; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def host_key(name: Column) -> Column:
    """Labels from the last to the first, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), "."), F.lit("."))


def _after(prefix: Column) -> Column:
    """Greater than every UTF-8 text with this prefix, and less than all greater texts without it."""
    return F.concat(prefix.cast("binary"), F.unhex(F.lit("FF")))


def _dealt(points: DataFrame, name: str) -> DataFrame:
    """``points`` (key, uid, ...) in range partitions, as a table that names each row's partition."""
    return written(points.repartitionByRange("key", F.xxhash64("uid")).withColumn("part", F.spark_partition_id()), name)


def _swept(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """``points`` with ``found``: what the last event at or before their key has left on the stack, null before any.

    ``intervals``: key (the prefix), opened and closed (what is found after its opening and after its closing).
    """
    bounds = points.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    meets = (F.col("key").cast("binary") <= F.col("high").cast("binary")) & (_after(F.col("key")) > F.col("low").cast("binary"))
    events = intervals.join(F.broadcast(bounds), meets)
    rest = [c for c in points.columns if c not in ("part", "key")]
    opening = events.select("part", F.col("key").cast("binary").alias("at"), F.lit(1).alias("kind"), F.col("opened").alias("found"))
    closing = events.select("part", _after(F.col("key")).alias("at"), F.lit(0).alias("kind"), F.col("closed").alias("found"))
    rows = points.select("part", F.col("key").cast("binary").alias("at"), F.lit(2).alias("kind"), *rest)
    line = rows.unionByName(opening, allowMissingColumns=True).unionByName(closing, allowMissingColumns=True)
    order = Window.partitionBy("part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("found", F.last("found", ignorenulls=True).over(order)).where("kind = 2").select(*rest, "found")


def _prefixes(key: Column, ends: Column) -> Column:
    return F.transform(ends, lambda n: F.substring(key, F.lit(1), n))


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict``; ``rules``: host, path, verdict (allow or block)."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").dropna()
    rules = rules.where("rule_host <> '' and not rule_host rlike '[/?#]'").groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    rules = written(rules.withColumn("host_key", host_key(F.col("rule_host"))), "rules")

    # The stack of rule hosts after each opening: the host keys among this one's own leading labels.
    hosts = rules.select("host_key").distinct()
    labels = F.split("host_key", r"\.")
    leading = hosts.select("host_key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))).alias("outer"))
    stacks = leading.join(hosts.select(F.col("host_key").alias("outer")), "outer").groupBy("host_key").agg(F.sort_array(F.collect_list("outer")).alias("opened"))
    intervals = stacks.select(F.col("host_key").alias("key"), "opened", F.filter("opened", lambda x: x != F.col("host_key")).alias("closed"))

    urls = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    urls = _dealt(urls.withColumn("key", host_key(F.col("host"))), "hosts")
    fitting = _swept(urls, intervals).where(F.size("found") > 0)

    # The innermost path rule of each rule host; after its closing, the next shorter path rule of that host, if any.
    paths = rules.withColumn("key", F.concat("host_key", "rule_path")).withColumn("rule", F.struct(F.length(F.concat("rule_host", "rule_path")).alias("length"), F.length("rule_host").alias("host_length"), F.concat("rule_host", "rule_path").alias("text"), "verdict"))
    inner = paths.select("host_key", "key", F.explode(_prefixes(F.col("rule_path"), F.sequence(F.lit(0), F.length("rule_path") - 1))).alias("rule_path")).where("length(key) > length(host_key)")
    parents = inner.join(paths.select("host_key", "rule_path", F.col("rule").alias("parent")), ["host_key", "rule_path"]).groupBy("key").agg(F.max("parent").alias("parent"))
    none = F.struct(F.lit(-1).alias("length"), F.lit(-1).alias("host_length"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("verdict"))
    path_intervals = paths.join(parents, "key", "left").select("key", F.col("rule").alias("opened"), F.coalesce("parent", none).alias("closed"))
    tries = fitting.select("uid", F.explode("found").alias("host_key"), "path").select("uid", F.concat("host_key", "path").alias("key"))
    tries = _swept(_dealt(tries, "paths"), path_intervals).where("found.length >= 0").select("uid", F.col("found").alias("best"))

    every = urls.select("uid", "page_id", "host", "path").unionByName(tries, allowMissingColumns=True)
    best = every.groupBy("uid").agg(F.max("page_id").alias("page_id"), F.max("host").alias("host"), F.max("path").alias("path"), F.max("best").alias("best"))
    return best.select("page_id", "host", "path", F.col("best.text").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
