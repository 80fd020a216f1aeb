"""Crawl requests as a stream: admission, and a rate limit with state for each origin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.functions import urls
from skein.operators.crawl import DEPTH, PERIOD
from skein.sources.tables import requests

SCHEMA = "url string, max_pages long, same_domain boolean, use_browser boolean, wait_for_selector string, wait_timeout_ms long, max_depth long"
# What a request takes as usual.
USUAL = {"same_domain": True, "use_browser": False, "wait_timeout_ms": 5000, "max_depth": DEPTH}


def admit(raw: DataFrame) -> DataFrame:
    """Requests from JSON (value): the normal URL, usual values where they are missing, and error (null: admitted)."""
    rows = requests(raw, SCHEMA, USUAL).withColumn("seed", urls.normalize(F.col("url")))
    trap = F.coalesce(urls.is_crawl_trap(F.col("seed")), F.lit(False))
    error = F.when(F.col("_error").isNotNull() | F.col("max_pages").isNull(), "malformed request").when(F.col("seed").isNull(), "invalid URL").when(trap, "crawl trap")
    return rows.withColumn("error", error).drop("_error")


def throttle(arrivals: DataFrame, period: float = PERIOD) -> DataFrame:
    """origin, id, arrival and start of a stream of arrivals (seconds); each origin's next free time is its state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values(["arrival", "id"])
        starts = []
        for arrival in rows["arrival"]:
            starts.append(max(arrival, free))
            free = starts[-1] + period
        state.update((free,))
        yield rows.assign(start=starts)[["origin", "id", "arrival", "start"]]

    rows = arrivals.select("origin", "id", "arrival")
    return rows.groupBy("origin").applyInPandasWithState(step, "origin string, id long, arrival double, start double", "free double", "append", GroupStateTimeout.NoTimeout)


def outcomes_by_window(events: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: outcomes counted by event-time window, late rows dropped after the watermark."""
    rows = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width), "event_type").count()
