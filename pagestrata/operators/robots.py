"""robots.txt as rules, and the pages they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.constants import USER_AGENT
from pagestrata.functions import urls as U
from pagestrata.functions.text import trim_spaces
from pagestrata.operators.skew import split_join


def robots_lines(files: DataFrame, key: str = "site", text: str = "text") -> DataFrame:
    """Directives of every file in order: key, line, directive, value."""
    raw = files.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line", "_raw"))
    line = trim_spaces(F.regexp_replace("_raw", r"#.*\z", ""))
    return (
        raw.withColumn("_raw", line)
        .where(F.col("_raw").rlike(r"\A[^:]+:"))
        .select(
            key, "line",
            F.lower(trim_spaces(F.substring_index("_raw", ":", 1))).alias("directive"),
            trim_spaces(F.regexp_replace("_raw", r"\A[^:]+:\s*", "")).alias("value"),
        )
    )


def sitemap_urls(lines: DataFrame, key: str = "site") -> DataFrame:
    return lines.where((F.col("directive") == "sitemap") & (F.col("value") != "")).select(
        key, "line", F.col("value").alias("sitemap_url")
    )


def robots_rules(lines: DataFrame, user_agent: str = USER_AGENT, key: str = "site") -> DataFrame:
    """Rules that apply to ``user_agent``: key, rule, value, pattern.

    A group is a run of agents followed by its rules. Groups that name the agent win over ``*``.
    """
    agent = F.col("directive") == "user-agent"
    rule = F.col("directive").isin("allow", "disallow") & (F.col("value") != "")
    order = Window.partitionBy(key).orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = lines.where(agent | rule)
    # A new group starts at an agent line that follows a rule of an earlier agent.
    agents_before = F.count_if(agent).over(upto)
    used = used.withColumn("_named", agents_before > 0).where(F.col("_named"))
    starts = agent & F.coalesce(F.lag(F.col("directive")).over(order) != "user-agent", F.lit(True))
    grouped = used.withColumn("_group", F.count_if(starts).over(upto))
    token = F.lower("value")
    named = (token != "*") & F.contains(F.lit(user_agent.lower()), token)
    groups = grouped.where(agent).groupBy(key, "_group").agg(
        F.max(named).alias("_exact"), F.max(token == "*").alias("_any")
    )
    best = Window.partitionBy(key)
    chosen = groups.withColumn("_has_exact", F.max("_exact").over(best)).where(
        F.when(F.col("_has_exact"), F.col("_exact")).otherwise(F.col("_any"))
    )
    return (
        grouped.where(rule).join(chosen.select(key, "_group"), [key, "_group"], "left_semi")
        .select(key, F.col("directive").alias("rule"), "value", U.robots_pattern(F.col("value")).alias("pattern"))
    )


def is_allowed(target: Column, rules: Column) -> Column:
    """Whether an array of rules allows a path with query: the longest match decides, allow wins ties."""
    matches = F.transform(
        F.filter(rules, lambda r: F.rlike(target, r["pattern"])),
        lambda r: F.struct(F.length(r["value"]).alias("length"), (r["rule"] == "allow").alias("allow")),
    )
    return F.coalesce(F.array_max(matches)["allow"], F.lit(True))


def with_robots(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds robots_allowed. The rules of a site are one array (a robots file is a few kilobytes),
    so a page meets its site's rules once and no pair of page and rule is ever a row."""
    per_site = rules.groupBy("site").agg(F.collect_list(F.struct("rule", "value", "pattern")).alias("_rules"))
    joined = split_join(pages, per_site, ["site"], "left", ["url"])
    target = F.concat(U.url_path(F.col("url")), U.url_query(F.col("url")))
    none = F.array().cast("array<struct<rule:string,value:string,pattern:string>>")
    return joined.withColumn("robots_allowed", is_allowed(target, F.coalesce("_rules", none))).drop("_rules")
