"""URL verdicts by hashed host-suffix and path-prefix expressions.

A rule is a host and the beginning of a path. It fits a URL whose host is the rule's or a subdomain
of it and whose path starts with the rule's. Every distinct (host, path) expands into expressions
host-suffix + path-prefix; they meet the rules in an equi-join on the first four bytes of their
SHA-256, and the whole digest then confirms a match. The longest fitting rule wins.

Only suffixes with as many labels, and prefixes with as many characters, as some rule has are
expanded. That loses nothing, and keeps the expansion of a long host or path in proportion to the
distinct rule lengths. Expressions that meet no rule prefix die in the join; the verdicts are joined
back by (host, path), so a page that stands for a third of all rows is expanded once.

Edge cases: a null URL or one without ``://`` has empty host and path and takes the default verdict.
Rules that tie in length: the longer host wins, then block. Repeated rules count once; rules with a
null part are ignored. Repeated pages each get the verdict. An input column named like an output
column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from headway.llm.common import LOWER, UPPER, col, others

ADDED = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(_url, locate('://', _url) + 3)"))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def verdicts(pages: DataFrame, url: str, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``; ``rules`` has (host, path, verdict)."""
    kept = [x for x in others(pages, ADDED) if x != "_url"]
    host, path = host_and_path(F.col("_url"))
    named = pages.select(*[col(x) for x in kept], col(url).alias("_url")).select(
        *[col(x) for x in kept], host.alias("host"), path.alias("path")
    )
    listed = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
        .groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # block before allow
        .select("*", _digest(F.col("rule_host"), F.col("rule_path")).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, 8))
    )
    # Distinct label and path lengths of the rules: bounded by the longest rule.
    shape = listed.agg(
        F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")
    ).first()
    labels, lengths = sorted(shape["labels"]), sorted(shape["lengths"])
    if not labels:
        return named.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", r"\.")
    suffixes = F.array_compact(
        F.array(*[F.when(F.size("parts") >= n, F.substring_index("host", ".", -n)) for n in labels])
    )
    prefixes = F.array_compact(
        F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n) if n else F.lit("")) for n in lengths])
    )
    expressions = (
        named.select("host", "path").distinct().withColumn("parts", parts)
        .select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("begin"))
        .withColumn("expression", _digest(F.col("suffix"), F.col("begin")))
    )
    met = expressions.join(listed, F.substring("expression", 1, 8) == F.col("prefix"))
    sure = met.where((F.col("expression") == F.col("digest")) & (F.col("suffix") == F.col("rule_host")) & (F.col("begin") == F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = sure.groupBy("host", "path").agg(
        F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), F.col("verdict").alias("v"), rule.alias("rule"))).alias("best")
    )
    return (
        named.join(best, ["host", "path"], "left")
        .select(*[col(x) for x in kept], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
    )
