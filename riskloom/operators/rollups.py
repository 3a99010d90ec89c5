"""Operational rollups: what was decided, how fast requests were, what batches did."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import steps_below
from riskloom.operators.decisions import escalated, fired_rules
from riskloom.operators.ranking import broadcast_if_small, running_totals

# Bucket ends of the published histograms, request routes, and the knee of a load curve.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
VELOCITY_BUCKETS = (0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 1.0)
RISK_BUCKETS = (0.001, 0.01, 0.05, 0.24, 0.5, 0.95, 1.0)
BATCH_SIZE_BUCKETS = (1, 5, 10, 50, 100, 250, 500, 1000)
ROUTES = ("/score", "/score/batch", "/transactions", "/transactions/{transaction_id}", "/health", "/metrics")
UNMATCHED = "unmatched"
METRICS_ROUTE = "/metrics"
KNEE_THROUGHPUT, KNEE_LATENCY = 1.1, 1.5


def decisions_by_source(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision", "source").agg(F.count(F.lit(1)).alias("decisions"))


def escalations_by_rule(decisions: DataFrame) -> DataFrame:
    """Rules counted only where they changed the decision."""
    changed = decisions.where(escalated()).select(F.explode(fired_rules()).alias("rule"))
    return changed.groupBy("rule").agg(F.count(F.lit(1)).alias("escalations"))


def cumulative_histogram(df: DataFrame, value: Column, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Observations at or below each edge, per series, with the closing infinite bucket,
    the sum and the count. One scan; at most len(edges)+1 rows per series are summed up."""
    counted = df.groupBy(*by, steps_below(value, list(map(float, edges))).alias("_step")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sum")
    )
    gathered = counted.groupBy(*by).agg(
        F.collect_list(F.struct("_step", "_n")).alias("_steps"), F.sum("_n").alias("count"), F.sum("_sum").alias("sum")
    )
    upto = lambda i: F.aggregate(
        F.filter("_steps", lambda s: s["_step"] <= i), F.lit(0).cast("long"), lambda total, s: total + s["_n"]
    )
    rows = [
        F.struct(F.lit(float(edge)).alias("le"), upto(i).alias("cumulative")) for i, edge in enumerate([*edges, float("inf")])
    ]
    return gathered.select(*by, F.inline(F.array(*rows)), "count", "sum")


def route_of(path: Column, routes: Sequence[str] = ROUTES) -> Column:
    """The route template a path matches; paths that match none share one label."""
    found = F.lit(UNMATCHED)
    for template in reversed(routes):
        parts = re.split(r"(\{[^}]*\})", template)
        pattern = "".join("[^/]+" if p.startswith("{") else re.escape(p) for p in parts)
        found = F.when(path.rlike(rf"\A{pattern}\z"), F.lit(template)).otherwise(found)
    return found


def request_rollup(requests: DataFrame) -> DataFrame:
    """Requests and time spent per method, route template and status; scrapes are not counted."""
    routed = requests.withColumn("route", route_of(F.col("path"))).where(F.col("route") != METRICS_ROUTE)
    return routed.groupBy("method", "route", "status").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("latency_s").alias("seconds")
    )


def nearest_ranks(df: DataFrame, value: str, percents: Mapping[str, float], by: str) -> DataFrame:
    """Percentiles that are always measured values: the one at rank ceil(p/100 * n)."""
    counted = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counted, [value], {"_upto": "_n"}, [by])
    sizes = counted.groupBy(by).agg(F.sum("_n").alias("_size"))
    ranked = ranked.join(broadcast_if_small(sizes), by)
    rank = lambda p: F.greatest(F.ceil(F.lit(p) * F.col("_size") / 100), F.lit(1))
    return ranked.groupBy(by).agg(
        *(F.min(F.when(F.col("_upto") >= rank(p), F.col(value))).alias(name) for name, p in percents.items())
    )


def stage_summary(requests: DataFrame, stage: str, seconds: DataFrame) -> DataFrame:
    """Throughput, latency percentiles and errors of each load stage.

    `seconds` holds (stage, seconds), one row per stage run. Errors are left out
    of latencies and throughput; a stage without a success has zeros.
    """
    good = requests.where(F.col("status") == 200)
    counts = requests.groupBy(stage).agg(
        F.count_if(F.col("status") == 200).alias("requests"), F.count_if(F.col("status") != 200).alias("errors")
    )
    ranks = nearest_ranks(good, "latency_s", {"p50": 50.0, "p95": 95.0, "p99": 99.0}, stage)
    joined = seconds.join(counts, stage, "left").join(ranks, stage, "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return joined.select(
        stage,
        zero("requests"),
        zero("errors"),
        F.coalesce(F.try_divide("requests", "seconds"), F.lit(0.0)).alias("throughput"),
        *(F.coalesce(F.col(p), F.lit(0.0)).alias(p) for p in ("p50", "p95", "p99")),
    )


def knee(stages: DataFrame, stage: str) -> DataFrame:
    """The first stage after which throughput stalls while latency climbs; no row if none."""
    following = Window.partitionBy(F.lit(0)).orderBy(stage)  # one row per stage of one load test
    seen = stages.select(
        "*", F.lead("throughput").over(following).alias("_throughput"), F.lead("p95").over(following).alias("_p95")
    )
    stalls = (F.col("_throughput") < F.col("throughput") * KNEE_THROUGHPUT) & (F.col("_p95") > F.col("p95") * KNEE_LATENCY)
    return seen.where(stalls).orderBy(stage).limit(1).select(stage, "throughput", "p95")


def counter_means(scrapes: DataFrame, stage: str) -> DataFrame:
    """Mean time per request between the first and last scrape of each stage, null without new requests."""
    ends = scrapes.groupBy(stage).agg(
        *(f(c, "scraped_at").alias(f"_{n}_{c}") for c in ("total", "count") for n, f in (("first", F.min_by), ("last", F.max_by)))
    )
    new = F.col("_last_count") - F.col("_first_count")
    mean = F.when(new > 0, (F.col("_last_total") - F.col("_first_total")) / new)
    return ends.select(stage, mean.alias("server_seconds"))


def outage_totals(stats: DataFrame) -> DataFrame:
    """Outages met while recording, and the seconds spent waiting."""
    return stats.agg(
        F.coalesce(F.sum("outages"), F.lit(0)).alias("outages"),
        F.coalesce(F.sum("seconds_waiting"), F.lit(0.0)).alias("seconds_waiting"),
    )


def cumulative_stats(stats: DataFrame) -> DataFrame:
    """All batches together, with the overall rate."""
    names = ("consumed", "scored", "dead_lettered", "duplicates", "approve", "review", "block")
    total = stats.agg(
        *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names),
        F.count(F.lit(1)).alias("batches"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"),
    )
    return total.withColumn("per_second", F.coalesce(F.try_divide("consumed", "seconds"), F.lit(0.0)))
