"""Time-to-live deduplication of keyed requests.

Per key, in time order: the first request is a miss and opens an entry at its
time ``s``; a request at ``t <= s + ttl`` is a hit and does not extend the
entry; the first request at ``t > s + ttl`` is a miss and opens a new entry.
``ttl`` of None or <= 0 means entries never expire.  Ties in time are ordered
by the id column; of several requests at one instant only the first can miss.

The entry starts of a key form the chain root, nxt(root), nxt(nxt(root)), ...
where nxt(v) is the first request time strictly after v + ttl.  Two exact ways
to find them:

* ``fold``: collect each key's distinct times and fold them in order; for
  small keys only.
* ``jump``: skew-safe for any key size.  nxt() for every distinct time comes
  from a successor search whose windows are bounded by construction (fine
  1-second buckets, then groups of 4096 buckets, then per-key group heads),
  and the chain is followed by jumps of 1, 4, 16, ... entries (log4 of the
  longest chain rounds of joins over unique (key, time) rows; each level is a
  stored table, removed once the starts are known).

The default counts the times of every key: keys of at most ``FOLD_ROWS`` are
folded, one shuffle of their rows; larger ones, if there are any, take the jumps.

Both then attach to every request its covering start with one equi-join on
(key, ttl bucket): starts lie more than ``ttl`` apart, so each ttl-wide
bucket holds at most one start and a request is covered by the start of its
own bucket or the one before.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.session import delete, stored

FINE_US = 1_000_000      # fine bucket: 1 s -> at most 2e6 rows per window partition
GROUP_BUCKETS = 4096     # fine buckets per group -> at most 8192 rows per partition
FOLD_ROWS = 512          # distinct times of a key that are folded as one array


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _nodes(df: DataFrame, keys, ts: str, id_col: str) -> DataFrame:
    """Distinct (key, time) with the first id at that time (partial aggregation
    collapses duplicate instants before the shuffle)."""
    return (df.select(*keys, F.unix_micros(F.col(ts)).alias("_t"), F.col(id_col).alias("_id"))
            .groupBy(*keys, "_t").agg(F.min("_id").alias("_tid")))


def _starts_fold(nodes: DataFrame, keys, ttl_us: int | None) -> DataFrame:
    grouped = nodes.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_t", "_tid"))).alias("_ev"))
    init = F.struct(F.lit(None).cast("long").alias("s"),
                    F.array().cast("array<struct<_t:bigint,_tid:bigint>>").alias("starts"))
    if ttl_us is None:
        fold = F.slice(F.col("_ev"), 1, 1)
    else:
        fold = F.aggregate(
            "_ev", init,
            lambda acc, x: F.when(acc["s"].isNull() | (x["_t"] > acc["s"] + F.lit(ttl_us)),
                                  F.struct(x["_t"].alias("s"),
                                           F.array_append(acc["starts"], x).alias("starts")))
            .otherwise(acc),
            lambda acc: acc["starts"])
    return (grouped.select(*keys, F.explode(fold).alias("_st"))
            .select(*keys, F.col("_st._t").alias("_s"), F.col("_st._tid").alias("_sid")))


def _succ_level(nodes_lvl: DataFrame, probes_lvl: DataFrame, part, order: str, val: str) -> DataFrame:
    """For each probe row, the minimum node ``val`` strictly after it in ``order``
    within the ``part`` partition (descending running minimum, O(n) frame).
    Probe columns other than ``part`` and ``order`` are carried through."""
    u = (nodes_lvl.select(*part, order, F.col(val).alias("_v"), F.lit(0).alias("_kind"))
         .unionByName(probes_lvl.withColumn("_v", F.lit(None).cast("long")).withColumn("_kind", F.lit(1)),
                      allowMissingColumns=True))
    w = (Window.partitionBy(*part).orderBy(F.col(order).desc(), F.col("_kind").desc())
         .rowsBetween(Window.unboundedPreceding, -1))
    return u.withColumn("_succ", F.min("_v").over(w)).where(F.col("_kind") == 1).drop("_v", "_kind")


def successor(nodes: DataFrame, probes: DataFrame, keys) -> DataFrame:
    """For each probe (keys, _pid, _x): the least node time ``_t`` > ``_x`` in its key.

    Three bounded levels: within the probe's fine bucket; the next non-empty
    fine bucket in the same group; the next non-empty group of the key.
    """
    n = nodes.select(*keys, "_t").withColumn("_f", F.floor(F.col("_t") / FINE_US).cast("long"))
    p = probes.withColumn("_f", F.floor(F.col("_x") / FINE_US).cast("long"))
    # level 1: same fine bucket (<= FINE_US distinct node times + as many probes)
    a = _succ_level(n.withColumnRenamed("_t", "_pos").withColumn("_val", F.col("_pos")),
                    p.withColumnRenamed("_x", "_pos"), [*keys, "_f"], "_pos", "_val")
    a = a.withColumnRenamed("_pos", "_x").withColumnRenamed("_succ", "_s1")
    # level 2: first node of a later fine bucket in the same group
    fs = n.groupBy(*keys, "_f").agg(F.min("_t").alias("_ft")).withColumn(
        "_g", F.floor(F.col("_f") / GROUP_BUCKETS).cast("long"))
    pf = a.where(F.col("_s1").isNull()).select(*keys, "_f").distinct().withColumn(
        "_g", F.floor(F.col("_f") / GROUP_BUCKETS).cast("long"))
    b = _succ_level(fs, pf, [*keys, "_g"], "_f", "_ft").withColumnRenamed("_succ", "_s2")
    # level 3: first node of a later group of the key (<= span / 4096 s rows per key)
    gs = fs.groupBy(*keys, "_g").agg(F.min("_ft").alias("_gt"))
    pg = b.where(F.col("_s2").isNull()).select(*keys, "_g").distinct()
    c = _succ_level(gs, pg, keys, "_g", "_gt").withColumnRenamed("_succ", "_s3")
    out = (a.join(b.select(*keys, "_f", "_s2"), [*keys, "_f"], "left")
           .withColumn("_g", F.floor(F.col("_f") / GROUP_BUCKETS).cast("long"))
           .join(c, [*keys, "_g"], "left"))
    return out.select(*keys, "_pid", F.coalesce("_s1", "_s2", "_s3").alias("_succ"))


def _hops(one: DataFrame, keys) -> DataFrame:
    """From the next time of each time (keys, _t, _n1): the next four (_n1 to _n4, null behind a key's last)."""
    two = one.join(one.select(*keys, F.col("_t").alias("_n1"), F.col("_n1").alias("_n2")), [*keys, "_n1"], "left")
    far = two.select(*keys, F.col("_t").alias("_n2"), F.col("_n1").alias("_n3"), F.col("_n2").alias("_n4"))
    return two.join(far, [*keys, "_n2"], "left").select(*keys, "_t", "_n1", "_n2", "_n3", "_n4")


def _starts_jump(nodes: DataFrame, keys, ttl_us: int | None) -> DataFrame:
    """The search and the jumps carry a number for each key, whatever the key's length; rows with a null key have no entry."""
    spark = nodes.sparkSession
    nodes = nodes.checkpoint()
    if ttl_us is None:
        roots = nodes.groupBy(*keys).agg(F.min("_t").alias("_t"))
        return roots.join(nodes, [*keys, "_t"]).select(*keys, F.col("_t").alias("_s"), F.col("_tid").alias("_sid"))
    names = nodes.select(*keys).distinct().withColumn("_k", F.monotonically_increasing_id()).checkpoint()
    nodes = nodes.join(names, keys).select("_k", "_t", "_tid").checkpoint()
    roots = nodes.groupBy("_k").agg(F.min("_t").alias("_t"))
    # Longest possible chain: starts lie in distinct ttl buckets.
    longest = (nodes.select("_k", F.floor(F.col("_t") / ttl_us).alias("_b")).distinct()
               .groupBy("_k").count().agg(F.max("count")).first()[0]) or 1
    if longest > 1:
        probes = nodes.select("_k", F.col("_t").alias("_pid"), (F.col("_t") + F.lit(ttl_us)).alias("_x"))
        nxt = successor(nodes, probes, ["_k"]).select("_k", F.col("_pid").alias("_t"), F.col("_succ").alias("_n1"))
        scratch, levels = [], []
        for _ in range(max(1, math.ceil(math.log(longest + 1, 4)))):
            level, path = stored(_hops(nxt, ["_k"]), "jump")
            levels.append(level)
            scratch.append(path)
            nxt = level.select("_k", "_t", F.col("_n4").alias("_n1"))
        reached = roots
        for level in reversed(levels):
            step = (reached.join(level, ["_k", "_t"])
                    .select("_k", F.explode(F.array("_t", "_n1", "_n2", "_n3")).alias("_t")).where(F.col("_t").isNotNull()))
            reached, path = stored(step, "reached")
            scratch.append(path)
        out = reached.join(nodes, ["_k", "_t"]).join(names, "_k").checkpoint()
        delete(spark, *scratch)
    else:
        out = roots.join(nodes, ["_k", "_t"]).join(names, "_k")
    return out.select(*keys, F.col("_t").alias("_s"), F.col("_tid").alias("_sid"))


def _starts_by_size(nodes: DataFrame, keys, ttl_us: int) -> DataFrame:
    """Small keys folded, large ones by jumps; both see every row of their keys."""
    nodes = stored(nodes.where(F.col("_t").isNotNull()), "nodes")[0]
    # first by a number for each key, as most tables have no large key and a key may be long; keys that share one are counted apart
    many = nodes.groupBy(F.xxhash64(*keys).alias("_k")).count().where(F.col("count") > FOLD_ROWS).select("_k").checkpoint()
    alone = many.isEmpty()
    large = nodes.select(*keys).limit(0) if alone else (
        nodes.withColumn("_k", F.xxhash64(*keys)).join(many, "_k", "left_semi").groupBy(*keys).count()
        .where(F.col("count") > FOLD_ROWS).select(*keys).checkpoint())
    if alone or large.isEmpty():
        return stored(_starts_fold(nodes, keys, ttl_us), "starts")[0]
    same = lambda k: F.col(f"n.{k}").eqNullSafe(F.col(f"l.{k}"))
    on = functools.reduce(lambda a, b: a & b, [same(k) for k in keys])
    small = nodes.alias("n").join(large.alias("l"), on, "left_anti")
    rest = nodes.alias("n").join(large.alias("l"), on, "left_semi")
    return stored(_starts_fold(small, keys, ttl_us).unionByName(_starts_jump(rest, keys, ttl_us)), "starts")[0]


def entry_starts(df: DataFrame, key, ts: str = "ts", id_col: str = "request_id",
                 ttl_seconds: float | None = 86400, strategy: str = "auto") -> DataFrame:
    """Entry starts per key: (keys..., _s micros, _sid id of the opening request)."""
    keys = _keys(key)
    ttl_us = None if ttl_seconds is None or ttl_seconds <= 0 else int(round(ttl_seconds * 1_000_000))
    nodes = _nodes(df, keys, ts, id_col)
    if strategy == "fold":
        return _starts_fold(nodes, keys, ttl_us)
    if strategy == "jump" or (strategy == "auto" and ttl_us is None):
        return _starts_jump(nodes, keys, ttl_us)
    if strategy == "auto":
        return _starts_by_size(nodes, keys, ttl_us)
    raise ValueError(f"unknown strategy {strategy!r}")


def attach_entries(df: DataFrame, starts: DataFrame, key, ts: str, id_col: str,
                   ttl_seconds: float | None) -> DataFrame:
    """Every row with ``hit`` and ``entry_created_at`` from its covering start."""
    keys = _keys(key)
    ttl_us = None if ttl_seconds is None or ttl_seconds <= 0 else int(round(ttl_seconds * 1_000_000))
    bucket = (lambda c: F.lit(0).cast("long")) if ttl_us is None else (
        lambda c: F.floor(c / F.lit(ttl_us)).cast("long"))
    st = starts.withColumn("_cb", bucket(F.col("_s")))
    own = st.select(*keys, "_cb", F.col("_s").alias("_s0"), F.col("_sid").alias("_i0"),
                    F.lit(None).cast("long").alias("_s1"), F.lit(None).cast("long").alias("_i1"))
    prev = st.select(*keys, (F.col("_cb") + 1).alias("_cb"), F.lit(None).cast("long").alias("_s0"),
                     F.lit(None).cast("long").alias("_i0"), F.col("_s").alias("_s1"), F.col("_sid").alias("_i1"))
    per_bucket = own.unionByName(prev).groupBy(*keys, "_cb").agg(
        F.max("_s0").alias("_s0"), F.max("_i0").alias("_i0"), F.max("_s1").alias("_s1"), F.max("_i1").alias("_i1"))
    t = F.unix_micros(F.col(ts))
    rows = df.withColumn("_t", t).withColumn("_cb", bucket(F.col("_t")))
    j = rows.join(per_bucket.hint("merge"), [*keys, "_cb"], "left")
    own_covers = F.col("_s0").isNotNull() & (F.col("_s0") <= F.col("_t"))
    cover = F.when(own_covers, F.col("_s0")).otherwise(F.col("_s1"))
    cover_id = F.when(own_covers, F.col("_i0")).otherwise(F.col("_i1"))
    miss = (F.col("_t") == cover) & (F.col(id_col) == cover_id)
    return j.select(*df.columns, (~F.coalesce(miss, F.lit(False))).alias("hit"),
                    F.timestamp_micros(cover).alias("entry_created_at"))


def ttl_dedup(df: DataFrame, key, ts: str = "ts", id_col: str = "request_id",
              ttl_seconds: float | None = 86400, strategy: str = "auto") -> DataFrame:
    """Every row flagged ``hit`` with the ``entry_created_at`` that served it."""
    starts = entry_starts(df, key, ts, id_col, ttl_seconds, strategy)
    return attach_entries(df, starts, key, ts, id_col, ttl_seconds)
