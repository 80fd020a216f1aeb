"""robots.txt: which URLs may be fetched, where sitemaps are, how long an answer counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import urls

# Seconds that a good answer and a failure count.
GOOD, FAILED = 86_400, 300


def policy_of(status: Column, body: Column, last_good: Column) -> tuple[Column, Column]:
    """(decision, body to go by): parse for 2xx, allow for 4xx; otherwise the last good body, without one disallow."""
    good, refused = (status >= 200) & (status < 300), (status >= 400) & (status < 500)
    decision = F.when(good, "parse").when(refused, "allow").when(last_good.isNotNull(), "stale").otherwise("disallow")
    return decision, F.when(good, body).when(~refused, last_good)


def is_fresh(fetched_at: Column, now: Column, failed: Column) -> Column:
    """Whether an answer (epoch seconds) still counts."""
    return now - fetched_at < F.when(failed, FAILED).otherwise(GOOD)


def statements(robots: DataFrame) -> DataFrame:
    """origin, pos, key (lower case) and value of each line with a colon, comments cut."""
    line = F.posexplode(F.split(F.coalesce("body", F.lit("")), "\r\n|\r|\n")).alias("pos", "line")
    rows = robots.select("origin", line).withColumn("line", F.regexp_replace("line", "#.*$", ""))
    return rows.filter(F.col("line").contains(":")).select("origin", "pos", F.lower(F.btrim(F.substring_index("line", ":", 1))).alias("key"), F.btrim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))


def sitemaps(robots: DataFrame) -> DataFrame:
    """origin, pos and url of each sitemap that is named by an absolute URL."""
    return statements(robots).filter((F.col("key") == "sitemap") & urls.parses(F.col("value"))).select("origin", F.col("pos").cast("long").alias("pos"), F.col("value").alias("url"))


def rules(robots: DataFrame, agent: str) -> DataFrame:
    """origin, allow and pattern of the rules for agent: those of its own groups, else those of *."""
    rows = statements(robots).filter(F.col("key").isin("user-agent", "allow", "disallow")).withColumn("is_agent", F.col("key") == "user-agent")
    line = Window.partitionBy("origin").orderBy("pos")
    new = F.col("is_agent") & ~F.coalesce(F.lag("is_agent").over(line), F.lit(False))
    rows = rows.withColumn("grp", F.sum(new.cast("int")).over(line))
    name = F.lower(F.regexp_extract("value", "^([a-zA-Z_*-]*)", 1))
    who = rows.filter("is_agent").groupBy("origin", "grp").agg(F.max((name == agent.lower()).cast("int")).alias("own"), F.max((F.substring(name, 1, 1) == "*").cast("int")).alias("any"))
    best = who.withColumn("has_own", F.max("own").over(Window.partitionBy("origin")))
    mine = best.filter(((F.col("has_own") == 1) & (F.col("own") == 1)) | ((F.col("has_own") == 0) & (F.col("any") == 1))).select("origin", "grp")
    kept = rows.filter(~F.col("is_agent") & (F.col("value") != "")).join(mine, ["origin", "grp"])
    return kept.select("origin", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))


def matches(path: Column, pattern: Column) -> Column:
    """Whether pattern matches a start of path: * stands for anything, $ at the end for the end. Parts between stars are
    looked for from left to right, each where it comes first, so that a pattern of many stars costs no more than its length."""
    anchored = pattern.endswith("$")
    parts = F.split(F.when(anchored, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern), r"\*", -1)

    def after(at: Column, part: Column) -> Column:
        found = F.call_function("locate", part, path, at)
        return F.when(at == 0, F.lit(0)).when(part == "", at).when(found > 0, found + F.length(part)).otherwise(0)

    first, n = F.get(parts, F.lit(0)), F.size(parts)
    start = F.when(path.startswith(first), F.length(first) + 1).otherwise(0)
    middle = F.aggregate(F.slice(parts, 2, F.when(anchored, F.greatest(n - 2, F.lit(0))).otherwise(n)), start, after)
    last = F.element_at(parts, -1)
    ends = F.when(n == 1, path == first).otherwise((middle > 0) & path.endswith(last) & (F.length(path) - F.length(last) + 1 >= middle))
    return F.when(anchored, ends).otherwise(middle > 0)


def allowed(candidates: DataFrame, rule_rows: DataFrame, url_col: str = "url") -> DataFrame:
    """candidates with allowed: the longest rule that matches path and query decides, allow wins ties."""
    rows = candidates.withColumn("_origin", urls.origin(F.col(url_col))).withColumn("_path", F.regexp_replace(F.regexp_replace(url_col, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), "#.*$", ""))
    rows = rows.withColumn("_path", F.when(F.col("_path").startswith("/"), F.col("_path")).otherwise(F.concat(F.lit("/"), "_path")))
    r = rule_rows.groupBy("origin").agg(F.collect_list(F.struct(F.length("pattern").alias("n"), "allow", "pattern")).alias("_rules"))
    rows = rows.join(r, rows["_origin"] == r["origin"], "left").drop("origin")
    hit = F.array_max(F.transform(F.filter("_rules", lambda x: matches(F.col("_path"), x["pattern"])), lambda x: F.struct(x["n"], x["allow"])))
    return rows.withColumn("allowed", F.coalesce(hit["allow"], F.lit(True))).drop("_rules", "_origin", "_path")
