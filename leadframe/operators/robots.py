"""URL allow-list by robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from leadframe.functions.urls import extract_domain


def _decoded(text: Column) -> Column:
    """Without percent escapes; a text with broken escapes stays as it is."""
    plus = F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(plus), text)


def robots_rules(robots: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """Rules of each robots text: (host, group_no, agents, rule_no, allow, path).

    A group's crawl settings are rows without a path: they restrict nothing, but a group that
    holds only such lines still is the group of its agents.  Paths are percent-decoded.
    Consecutive agent lines open a group; rules belong to the open group until
    the next agent line; a blank line right after agents discards them.
    """
    lines = robots.select(
        F.col(host).alias("host"),
        F.posexplode(F.split(F.col(body), r"\r\n|\r|\n")).alias("line_no", "raw"),
    )
    text = F.trim(F.regexp_replace("raw", "#.*$", ""))
    key = F.lower(F.trim(F.regexp_extract("text", r"^([^:]*):", 1)))
    lines = lines.withColumn("text", text).select(
        "host", "line_no", "raw", "text", key.alias("key"),
        F.trim(F.regexp_extract("text", r"^[^:]*:(.*)$", 1)).alias("value"),
    )
    kind = (
        F.when(F.trim("raw") == "", "blank")
        .when(F.col("key") == "user-agent", "agent")
        .when(F.col("key").isin("allow", "disallow"), "rule")
        .when(F.col("key").isin("crawl-delay", "request-rate"), "other")
    )
    lines = lines.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    in_order = Window.partitionBy("host").orderBy("line_no")
    opens = (F.col("kind") == "agent") & (
        F.coalesce(F.lag("kind").over(in_order), F.lit("blank")) != "agent"
    )
    grouped = lines.withColumn("opens", opens.cast("int")).withColumn(
        "group_no", F.sum("opens").over(in_order)
    )
    in_group = Window.partitionBy("host", "group_no").orderBy("line_no")
    so_far = in_group.rowsBetween(Window.unboundedPreceding, 0)
    alive = F.sum((F.col("kind") == "blank").cast("int")).over(so_far) == 0
    agents = F.collect_list(F.when(F.col("kind") == "agent", F.lower("value"))).over(
        in_group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return (
        grouped.withColumns({"alive": alive, "agents": agents})
        .filter(F.col("kind").isin("rule", "other") & F.col("alive") & (F.col("group_no") > 0))
        .select(
            "host", "group_no", "agents", F.col("line_no").alias("rule_no"),
            ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"),
            F.when(F.col("kind") == "rule", _decoded(F.col("value"))).alias("path"),
        )
    )


def host_rules(rules: DataFrame, user_agent: str = "*") -> DataFrame:
    """One row per host: the ordered rules of the group that fits the agent.

    A named group whose name is part of the agent wins over the '*' group.  The
    array holds the rules of a single robots text.
    """
    agent = user_agent.split("/")[0].lower()
    named = F.exists(
        "agents", lambda a: (a != "*") & (a != "") & F.lit(agent).contains(a)
    )
    default = F.array_contains("agents", "*")
    rank = F.when(named, 0).when(default, 1)
    picked = rules.withColumn("fit", F.struct(rank.alias("rank"), "group_no")).filter(
        rank.isNotNull()
    )
    by_host = picked.groupBy("host").agg(
        F.min("fit").alias("best"),
        F.array_sort(F.collect_list(F.struct("fit", "rule_no", "allow", "path"))).alias("all"),
    )
    return by_host.select(
        "host", F.filter("all", lambda r: r["fit"] == F.col("best")).alias("rules")
    )


def _path(url: Column) -> Column:
    after = F.regexp_extract(url, r"^https?://[^/?#]*([^#]*)", 1)
    return F.when(after.startswith("/"), after).otherwise(F.concat(F.lit("/"), after))


def allowed_urls(
    urls: DataFrame, robots: DataFrame, user_agent: str = "*", url: str = "url",
    respect: bool = True,
) -> DataFrame:
    """Add ``allowed``: the first rule whose path is a prefix of the URL decides.

    No robots text or no fitting group allows the URL; a URL without a host is
    blocked.  The rules arrive as one row per host, so URLs are never multiplied.
    """
    if not respect:
        return urls.withColumn("allowed", F.lit(True))
    per_host = host_rules(robots_rules(robots), user_agent)
    keyed = urls.withColumn("host", extract_domain(url))
    joined = keyed.join(per_host, "host", "left")
    path = _decoded(_path(F.col(url)))
    hit = F.get(
        F.filter("rules", lambda r: (r["path"] == "*") | path.startswith(r["path"])), F.lit(0)
    )
    allowed = F.when(F.col("host").isNull(), F.lit(False)).otherwise(
        F.coalesce(hit["allow"], F.lit(True))
    )
    return joined.withColumn("allowed", allowed).drop("rules", "host")
