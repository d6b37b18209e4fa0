"""Summaries: counts per service, latency percentiles, throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.session import cut_lineage

# Fixed value: the reported percentiles.
PERCENTILES = (50, 90, 95, 99)


def count_by_service(logs: DataFrame) -> DataFrame:
    return logs.groupBy("service").agg(F.count("*").alias("count"))


def latency_summary(samples: DataFrame, value: str, by: str, splits: int = 256) -> DataFrame:
    """Nearest-rank percentiles ``(by, n, p50, p90, p95, p99)`` per group; 0 without samples.

    Exact, and no task holds a whole group: approximate quantiles cut each
    group's value range into ``splits`` parts, the parts are counted, and only
    the parts that the wanted ranks fall into are sorted. The cut points affect
    balance, never the result.
    """
    # As a struct, a NULL group joins like any other.
    data = samples.select(F.struct(F.col(by).alias("by")).alias("by"), F.col(value).cast("double").alias("v"))
    cuts = F.percentile_approx("v", [i / splits for i in range(1, splits)], 10 * splits)
    groups = cut_lineage(data.groupBy("by").agg(F.count("v").alias("n"), cuts.alias("cuts")))
    values = (
        data.where(F.col("v").isNotNull())
        .groupBy("by", "v")
        .agg(F.count("*").alias("c"))
        .join(groups, "by")
        .select("by", "v", "c", "n", F.size(F.filter("cuts", lambda cut: cut < F.col("v"))).alias("part"))
    )
    # At most `splits` rows per group.
    through = F.sum("c").over(Window.partitionBy("by").orderBy("part"))
    ranks = F.array(
        *(F.struct(F.lit(p).alias("p"), F.ceil(F.lit(p / 100) * F.col("n")).alias("rank")) for p in PERCENTILES)
    )
    hit = lambda r: (r["rank"] <= F.col("through")) & (r["rank"] > F.col("through") - F.col("c"))
    wanted = (
        values.groupBy("by", "part", "n")
        .agg(F.sum("c").alias("c"))
        .withColumn("through", through)
        .select("by", "part", (F.col("through") - F.col("c")).alias("before"), F.filter(ranks, hit).alias("ranks"))
        .where(F.size("ranks") > 0)
    )
    in_part = Window.partitionBy("by", "part").orderBy("v")
    picked = (
        values.join(wanted, ["by", "part"])
        .withColumn("through", F.col("before") + F.sum("c").over(in_part))
        .select("by", "v", F.explode(F.filter("ranks", hit)).alias("r"))
        .groupBy("by")
        .agg(*(F.max(F.when(F.col("r.p") == p, F.col("v"))).alias(f"p{p}") for p in PERCENTILES))
    )
    return groups.join(picked, "by", "left").select(
        F.col("by.by").alias(by),
        "n",
        *(F.coalesce(f"p{p}", F.lit(0.0)).alias(f"p{p}") for p in PERCENTILES),
    )


def latency_summary_approximate(samples: DataFrame, value: str, by: str, accuracy: int = 10_000) -> DataFrame:
    """The same columns in one pass, each rank off by at most ``n / accuracy``."""
    v = F.col(value).cast("double")
    found = samples.groupBy(by).agg(
        F.count(v).alias("n"), F.percentile_approx(v, [p / 100 for p in PERCENTILES], accuracy).alias("p")
    )
    return found.select(
        by, "n", *(F.coalesce(F.get("p", F.lit(i)), F.lit(0.0)).alias(f"p{p}") for i, p in enumerate(PERCENTILES))
    )


def throughput_summary(requests: DataFrame, by: str | None = None) -> DataFrame:
    """Totals and rates of a request log ``(sent_at, done_at, attempted, accepted, rejected, failed)``."""
    totals = requests.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("requests"),
        F.count_if("failed").alias("failed_requests"),
        F.sum("attempted").alias("attempted"),
        F.sum("accepted").alias("accepted"),
        F.sum("rejected").alias("rejected"),
        ((F.unix_millis(F.max("done_at")) - F.unix_millis(F.min("sent_at"))) / 1_000).alias("elapsed_s"),
    )
    rate = lambda name: F.round(F.try_divide(F.col(name), F.col("elapsed_s")), 2)
    return totals.select(
        "*", rate("attempted").alias("attempted_per_s"), rate("accepted").alias("accepted_per_s")
    )
