"""URL rules by host suffix and path prefix.

Every URL is expanded into expressions ``host suffix + path prefix``; a path prefix is taken at
each length that a rule's path has, so a rule's path may end anywhere. Expressions meet the rules
in an equi-join on a short prefix of their SHA-256, the full digests confirm the hit, and of
several rules that fit the longest one wins (ties: the longer host, then block before allow).

Distinct URLs are judged once, so a URL that a third of all rows share costs one row; the verdict
is joined back by URL, where adaptive execution can split a hot one. The expansion is at most
labels (of the longest rule host) x distinct path lengths per URL and is never shuffled unless its digest prefix meets a rule
(Spark broadcasts the rules while they are small and shuffles both sides by the short prefix beyond that).

Null URLs and URLs without ``://`` have an empty host and path and get the default verdict.
Repeated rows are returned as often as they come; no column of the input but the two named is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "action string, host string, path string"
SHORT = 8  # hex digits of the digest prefix


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as (action, host, path) rows."""
    return spark.createDataFrame(rules, RULE_SCHEMA)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Rows of ``pages`` (all columns) plus struct ``_judged``: host, path, rule, verdict."""
    urls = pages.select(F.col(url_col).cast("string").alias("_url")).where("_url is not null").distinct()
    host, path = host_path(F.col("_url"))
    urls = urls.select("_url", host.alias("_host"), path.alias("_path"))
    # The lengths of rule paths are a column of one row, not collected: the rules may be any table.
    lengths = rules.where("path is not null").agg(F.collect_set(F.length("path")).alias("_lengths"))
    labels = F.split("_host", r"\.")
    # a suffix of more labels than any rule's host fits none, so a very long host costs no more than a rule
    deepest = rules.where("host is not null").agg(F.max(F.size(F.split("host", r"\."))).alias("_deepest"))
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - F.col("_deepest") + 1), F.size(labels)),
                           lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    expanded = (
        urls.withColumns({"_lengths": lengths.scalar(), "_deepest": deepest.scalar()}).where("_deepest is not null")
        .withColumn("_suffix", F.explode(suffixes))
        .withColumn("_length", F.explode(F.filter("_lengths", lambda n: n <= F.length("_path"))))
        .withColumn("_digest", F.sha2(F.concat("_suffix", F.lit("\n"), F.expr("left(_path, _length)")), 256))
        .select("_url", "_digest", F.left("_digest", F.lit(SHORT)).alias("_short"))
    )
    table = rules.where("host is not null and path is not null").select(
        F.sha2(F.concat(ascii_lower(F.col("host")), F.lit("\n"), "path"), 256).alias("_full"),
        F.concat(ascii_lower(F.col("host")), "path").alias("_rule"), F.length("host").alias("_host_length"), "action",
    ).withColumn("_short", F.left("_full", F.lit(SHORT)))
    best = (
        expanded.join(table, "_short").where("_digest = _full")
        .groupBy("_url")
        .agg(F.max(F.struct(F.length("_rule").alias("length"), "_host_length", (F.col("action") == "block").alias("block"),
                            F.col("_rule").alias("rule"), "action")).alias("_best"))
    )
    judged = F.struct(
        F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"),
        F.coalesce("_best.action", F.lit(default)).alias("verdict"))
    per_url = urls.join(best, "_url", "left").select(F.col("_url").alias("_key"), judged.alias("_judged"))
    none = F.struct(F.lit("").alias("host"), F.lit("").alias("path"), F.lit(None).cast("string").alias("rule"),
                    F.lit(default).alias("verdict"))
    keyed = pages.where(F.col(url_col).isNotNull())
    found = keyed.join(per_url, keyed[url_col].cast("string") == per_url["_key"]).drop("_key")
    return found.unionByName(pages.where(F.col(url_col).isNull()).withColumn("_judged", none))
