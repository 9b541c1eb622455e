"""robots.txt rules (S3, W1, X4) and the robots join.

Parse: one row per line (``posexplode``), the last ``User-agent:`` line before each line
decides whether it is relevant (a ``last(..., ignorenulls)`` window per file). ``Disallow``
adds a rule (empty value -> ``/``), ``Allow`` removes one earlier equal rule if there is one:
per (host, rule) that is a counter that never goes below zero, so the final count is
``S_n - least(0, min_k S_k)`` of the running sum ``S`` of +1 / -1. A file is one group, which
is bounded by the file itself.

Join: URLs ⋉ rules on host with ``rule = '/' OR startswith(path, rule)``; the rules side is
broadcast when its measured bytes are few and no host has many rules, else paths are looked up in a
prefix index, an equi-join on (host, cut).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import py_strip, splitlines
from pagemill.functions.urls import with_url_parts
from pagemill.session import cut_lineage


def robots_lines(robots: DataFrame, host_col: str = "host", content_col: str = "content") -> DataFrame:
    """(host, n, line, field, value, relevant) for every non-blank, non-comment line."""
    df = robots.select(F.col(host_col).alias("host"), F.posexplode(splitlines(content_col)).alias("n", "raw"))
    df = df.withColumn("line", py_strip("raw"))
    df = df.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    low = F.lower("line")
    field = (
        F.when(low.startswith("user-agent:"), "user-agent")
        .when(low.startswith("disallow:"), "disallow")
        .when(low.startswith("allow:"), "allow")
        .otherwise("other")
    )
    value = py_strip(F.regexp_extract("line", r"(?s)^[^:]*:(.*)\z", 1))
    df = df.select("host", "n", "line", field.alias("field"), value.alias("value"))
    star = F.when(F.col("field") == "user-agent", F.lower("value") == "*")
    w = Window.partitionBy("host").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    relevant = F.coalesce(F.last(star, ignorenulls=True).over(w), F.lit(False))
    return df.withColumn("relevant", relevant)


def robots_rules(robots: DataFrame, host_col: str = "host", content_col: str = "content", empty_disallow: str = "block") -> DataFrame:
    """S3 + W1 + X4: (host, rule, copies) of the disallow rules still active at the end of the file."""
    lines = robots_lines(robots, host_col, content_col).where(F.col("relevant") & F.col("field").isin("disallow", "allow"))
    if empty_disallow == "block":
        rule = F.when((F.col("field") == "disallow") & (F.col("value") == ""), F.lit("/")).otherwise(F.col("value"))
    else:  # the robots standard: an empty Disallow allows everything
        lines = lines.where(~((F.col("field") == "disallow") & (F.col("value") == "")))
        rule = F.col("value")
    delta = F.when(F.col("field") == "disallow", 1).otherwise(-1)
    ev = lines.select("host", "n", rule.alias("rule"), delta.alias("d"))
    w = Window.partitionBy("host", "rule").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ev = ev.withColumn("s", F.sum("d").over(w))
    g = ev.groupBy("host", "rule").agg(F.sum("d").alias("total"), F.min("s").alias("low"))
    copies = (F.col("total") - F.least(F.lit(0), F.col("low"))).cast("int")
    return g.select("host", "rule", copies.alias("copies")).where(F.col("copies") > 0)


def rules_by_host(rules: DataFrame) -> DataFrame:
    """(host, rules array): one row per robots file, bounded by the file's size."""
    return rules.groupBy("host").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def with_longest_rule(paths: DataFrame, rules: DataFrame, host: str, path: str, out: str) -> DataFrame:
    """``out`` = the longest rule of the host (``rules``: host, rule) that ``path`` begins with, else null.

    A prefix index instead of a scan of the host's rules: a path is cut only at the lengths that occur among
    its host's rules, and a cut equals a rule or it doesn't, an equi-join on (host, text). Distinct (host,
    path) pairs are looked up once; a host with most of the rules or paths is split like any skewed join."""
    keys = paths.select(F.col(host).alias("_h"), F.col(path).alias("_p")).distinct()
    r = rules.select(F.col("host").alias("_h"), F.col("rule").alias("_r")).distinct()
    lengths = r.groupBy("_h").agg(F.collect_set(F.char_length("_r")).alias("_lens"))  # at most as many as a rule is long
    cuts = keys.join(lengths, "_h").select("_h", "_p", F.explode(F.filter("_lens", lambda n: n <= F.char_length("_p"))).alias("_n"))
    cuts = cuts.withColumn("_r", F.substring(F.col("_p"), F.lit(1), F.col("_n")))
    best = cuts.join(r, ["_h", "_r"], "left_semi").groupBy("_h", "_p").agg(F.max_by("_r", "_n").alias(out))
    same = paths[host].eqNullSafe(best["_h"]) & paths[path].eqNullSafe(best["_p"])
    return paths.join(best, same, "left").drop("_h", "_p")


def with_robots_disallowed(urls: DataFrame, rules: DataFrame, url_col: str, out: str, broadcast_bytes: int = 8 << 20, host_rules: int = 1000) -> DataFrame:
    """``out`` = the URL's hostname has a rule '/' or a rule its path starts with.

    While all rules together take at most ``broadcast_bytes`` and no host has more than ``host_rules``, one
    broadcast join on host with per-host arrays; beyond that the prefix index of ``with_longest_rule``."""
    df = with_url_parts(urls, url_col, "__r_")
    df = df.withColumn("__r_p", F.coalesce(F.when(F.col("__r_path") != "", F.col("__r_path")), F.lit("/")))
    per_host = rules.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("rule") + F.octet_length("host") + 32).alias("bytes"))
    size = per_host.agg(F.max("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    if (size.n or 0) > host_rules or (size.bytes or 0) > broadcast_bytes:
        found = with_longest_rule(cut_lineage(df.select(*urls.columns, "__r_host", "__r_p")), rules, "__r_host", "__r_p", "__r_rule")
        return found.withColumn(out, F.col("__r_rule").isNotNull()).select(*urls.columns, out)
    r = F.broadcast(rules_by_host(rules).select(F.col("host").alias("__r_host"), F.col("rules").alias("__r_rules")))
    df = df.join(r, "__r_host", "left")
    hit = F.exists(F.coalesce(F.col("__r_rules"), F.array().cast("array<string>")),
                   lambda x: (x == "/") | F.col("__r_p").startswith(x))
    return df.withColumn(out, hit).select(*urls.columns, out)
