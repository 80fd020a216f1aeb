"""Bulk submission: which seeds are submitted, in which order, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import urls

# The checked-in settings of a bulk run.
DEFAULTS = {
    "max_pages_per_url": 200, "same_domain": True, "delay_between_submissions_ms": 200, "delay_between_batches_ms": 2000, "batch_size": 10,
    "skip_domains": ["localhost", "127.0.0.1", "duckduckgo.com", "www.google.com", "search.brave.com", "accounts.google.com", "accounts.hetzner.com", "mail.google.com", "outlook.office.com", "teams.microsoft.com", "music.youtube.com", "gemini.google.com", "chatgpt.com", "lightmailer-bs.gmx.net", "lightmailer-bap.gmx.net"],
    "skip_patterns": ["/login", "/signin", "/auth", "/oauth", "?code=", "?token="],
    "browser_domains": ["nuxt.com", "ui.nuxt.com", "content.nuxt.com", "vuejs.org", "tiptap.dev"],
}


def judged(seeds: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """seeds (url, pos) with reason (null: submit), domain and use_browser."""
    url = F.col("url")
    return seeds.withColumns({"reason": urls.skip_reason(url, config["skip_domains"], config["skip_patterns"]), "domain": urls.bulk_domain(url), "use_browser": urls.needs_browser(url, config["browser_domains"])})


def skip_histogram(judged_rows: DataFrame, most: int = 5) -> DataFrame:
    """The most frequent reasons, ties by first place."""
    return judged_rows.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).orderBy(F.desc("n"), "first_pos").limit(most)


def interleave(rows: DataFrame) -> DataFrame:
    """rows (domain, pos) with turn, place: domains take turns in the order in which they first came."""
    own = Window.partitionBy("domain")
    out = rows.withColumn("turn", F.row_number().over(own.orderBy("pos")).cast("long")).withColumn("first_pos", F.min("pos").over(own))
    return out.withColumn("place", F.row_number().over(Window.orderBy("turn", "first_pos")).cast("long"))


def schedule(placed: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """placed with batch and due_ms: a pause after each submission, a longer one after each batch."""
    size = config["batch_size"]
    before = F.col("place") - 1
    return placed.withColumn("batch", F.floor(before / size)).withColumn("due_ms", before * config["delay_between_submissions_ms"] + F.floor(before / size) * config["delay_between_batches_ms"])


def plan(seeds: DataFrame, done: DataFrame | None = None, config: dict = DEFAULTS, limit: int = 0) -> DataFrame:
    """Submissions in order: judged seeds that were not submitted before, the first ``limit`` of them (0: all)."""
    rows = judged(seeds, config).filter("reason IS NULL")
    if done is not None:
        rows = rows.join(done.select("url"), "url", "left_anti")
    if limit:
        rows = rows.orderBy("pos").limit(limit)
    return schedule(interleave(rows), config).withColumn("max_pages", F.lit(config["max_pages_per_url"])).withColumn("same_domain", F.lit(config["same_domain"]))


def summary(outcomes: DataFrame) -> DataFrame:
    """submitted and failed of rows with a boolean ok, and domains."""
    return outcomes.agg(F.coalesce(F.sum(F.col("ok").cast("long")), F.lit(0)).alias("submitted"), F.coalesce(F.sum((~F.col("ok")).cast("long")), F.lit(0)).alias("failed"), F.countDistinct("domain").alias("domains"))
