"""Traffic KPIs by dependency (and optionally endpoint)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000  # of the sketch that finds where an exact percentile lies
MARGIN = 5 / ACCURACY
SMALL = 20_000  # rows; the margin spans several ranks of larger groups


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Per group of ``keys`` (nulls are keys too): columns p0, p1, ... with the interpolated percentiles of ``value``
    (null values left out).

    A first pass counts each group and sketches two values between which each
    percentile lies (the sketch's error is a fifth of the margin).  Where no
    group has more than SMALL rows, each is aggregated by itself; otherwise by
    ``_banded``, so no task holds a large group's values.  ``df`` is read
    twice: pass a stored frame.
    """
    d = df.select(F.struct(*keys).alias("_k"), F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    cuts = [x for p in shares for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    groups = d.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                 F.percentile_approx("_v", cuts, ACCURACY).alias("_cut")).checkpoint()
    if groups.where(F.col("_n") > SMALL).isEmpty():
        found = d.groupBy("_k").agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias("_p")).select(
            "_k", *[F.col("_p")[i].alias(f"p{i}") for i in range(len(shares))])
    else:
        # where the margin is less than some ranks, the whole (small) group is the band
        ends = F.array(*[F.lit(x) for x in range(len(cuts))])
        whole = F.transform(ends, lambda i: F.when(i % 2 == 0, F.col("_min")).otherwise(F.col("_max")))
        found = _banded(d, groups.select(
            "_k", "_n", F.when(F.col("_n") > SMALL, F.col("_cut")).otherwise(whole).alias("_cut")), shares)
    return found.select(*[F.col("_k")[k].alias(k) for k in keys], *[c for c in found.columns if c != "_k"])


def _banded(d: DataFrame, groups: DataFrame, shares: list[float]) -> DataFrame:
    """Percentiles of ``_v`` by ``_k``: only distinct values between a group's cuts are counted and ranked."""
    rows = d.join(groups, "_k")
    lo, hi = (lambda i: F.col("_cut")[2 * i]), (lambda i: F.col("_cut")[2 * i + 1])
    below = rows.groupBy("_k").agg(F.first("_n").alias("_n"), F.array(*[
        F.count_if(F.col("_v") < lo(i)) for i in range(len(shares))]).alias("_below"))
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("share"), lo(i).alias("lo"), hi(i).alias("hi"))
                      for i, p in enumerate(shares)])
    band = (rows.select("_k", "_v", F.explode(bands).alias("_b")).where(F.col("_v").between(F.col("_b.lo"), F.col("_b.hi")))
            .groupBy("_k", "_b.i", "_b.share", "_v").agg(F.count(F.lit(1)).alias("_c")).join(below, "_k"))
    end = F.get("_below", F.col("i")) + F.sum("_c").over(Window.partitionBy("_k", "i").orderBy("_v"))
    place = F.col("share") * (F.col("_n") - 1)
    at = lambda k: F.max(F.when((k >= F.col("_end") - F.col("_c")) & (k < F.col("_end")), F.col("_v")))
    found = (band.withColumn("_end", end).withColumn("_place", place).groupBy("_k", "i")
             .agg(at(F.floor("_place")).alias("_a"), at(F.ceil("_place")).alias("_z"), F.first("_place").alias("_place")))
    one = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_place") - F.floor("_place"))
    return found.groupBy("_k").agg(*[F.max(F.when(F.col("i") == i, one)).alias(f"p{i}") for i in range(len(shares))])


def traffic_kpis(flags: DataFrame, by_endpoint: bool = False, approx: bool = False) -> DataFrame:
    """Requests, unmatched share, hits, misses, hit rate, p50/p95 latency for
    hits and misses, and the status mix ('code:count,...' by code).

    Input: ``serve_flags`` output, read once.  Unmatched requests form the
    NULL dependency group.  Counts are taken per (keys, status, hit) and
    rolled up, so a dependency holding most of the traffic is combined
    map-side; percentiles are exact (``approx=True``: a sketch).
    """
    keys = ["dependency"] + (["endpoint_method", "endpoint_path"] if by_endpoint else [])
    own = flags.select(*keys, "status", "hit", F.col("endpoint_path").isNull().alias("_un"), "latency_ms").checkpoint()
    fine = own.groupBy(*keys, "status", "hit", "_un").agg(F.count(F.lit(1)).alias("_n"))
    per_status = fine.groupBy(*keys, "status").agg(
        F.sum("_n").alias("_n"), F.sum(F.when(F.col("_un"), F.col("_n"))).alias("_u"),
        F.sum(F.when(F.col("hit"), F.col("_n"))).alias("_h"), F.sum(F.when(~F.col("hit"), F.col("_n"))).alias("_m"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    base = per_status.groupBy(*keys).agg(
        total("_n").alias("requests"), total("_u").alias("unmatched"), total("_h").alias("hits"), total("_m").alias("misses"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "_n"))),
                                 lambda s: F.concat(s["status"].cast("string"), F.lit(":"), s["_n"].cast("string"))), ",")
        .alias("status_mix"))
    served = own.where(F.col("hit").isNotNull())
    if approx:
        cuts = served.groupBy(*keys, "hit").agg(F.percentile_approx("latency_ms", [0.5, 0.95], ACCURACY).alias("_p"))
        cuts = cuts.select(*keys, "hit", F.col("_p")[0].alias("p0"), F.col("_p")[1].alias("p1"))
    else:
        cuts = exact_percentiles(served, [*keys, "hit"], "latency_ms", [0.5, 0.95])
    pick = lambda c, hit: F.round(F.max(F.when(F.col("hit") == hit, F.col(c))), 6)
    cuts = cuts.groupBy(*keys).agg(pick("p0", True).alias("p50_hit_ms"), pick("p1", True).alias("p95_hit_ms"),
                                   pick("p0", False).alias("p50_miss_ms"), pick("p1", False).alias("p95_miss_ms"))
    out = base.join(cuts, [base[k].eqNullSafe(cuts[k]) for k in keys], "left").select(
        base["*"], *[cuts[c] for c in cuts.columns if c not in keys])
    return out.select(
        *keys, "requests", "unmatched", "hits", "misses",
        F.round(F.when((F.col("hits") + F.col("misses")) > 0,
                       F.col("hits") / (F.col("hits") + F.col("misses"))), 6).alias("hit_rate"),
        "p50_hit_ms", "p95_hit_ms", "p50_miss_ms", "p95_miss_ms", "status_mix")
