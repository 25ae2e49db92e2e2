"""Response store: entries, upsert, lookup, stats, purge.

The store is a Parquet table with one row per ``key_hash``, partitioned by
``dependency`` and ``bucket`` (a hash of the key, with the number of buckets in
its name; a new store gets as many as keep partitions near a million rows).  A
new store of more than ``FOLDERS`` dependencies has ``group`` (a hash of the
dependency) in its place, so that the files follow the rows.
``upsert_persisted`` reads the partitions that its rows belong to, and of the
others in their buckets the keys alone, to find a key that moves;
``purge_persisted`` reads only the dependency it removes.  Spark's dynamic
partition overwrite replaces the partitions that change and leaves all others
as they are.  A partition left without rows is removed after that; should the
job end in between, a key that moved to another dependency is there twice
until its bucket is written again, which keeps the later row.
"""

from __future__ import annotations

import urllib.parse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens import schemas
from trafficlens.functions.keys import is_live, stamp_expiry
from trafficlens.session import delete, list_names, path_exists, stored

STORE_COLS = [f.name for f in schemas.RESPONSE_STORE.fields]
JSON_HEADERS = '{"Content-Type":"application/json"}'


def upsert_responses(store: DataFrame | None, new: DataFrame, ttl_seconds: float | None = 86400,
                     batch_id: int = 0) -> DataFrame:
    """Insert-or-replace by ``key_hash``; the later write wins the whole row.

    New rows get ``expires_at`` stamped (F10).  "Later" is decided by
    (created_at, batch id, order within the batch via ``_seq`` if present), so
    the result is deterministic.  The per-key pick is a partial aggregation:
    a key written many times is combined map-side before the shuffle.
    """
    ttl = 0 if ttl_seconds is None else ttl_seconds
    seq = F.col("_seq") if "_seq" in new.columns else F.lit(0).cast("long")
    incoming = new.select(
        *[c for c in STORE_COLS if c != "expires_at"],
        stamp_expiry(F.col("created_at"), F.col("expires_at") if "expires_at" in new.columns
                     else F.lit(None).cast("timestamp"), ttl).alias("expires_at"),
        F.lit(batch_id).cast("long").alias("_batch"), seq.cast("long").alias("_seq"))
    if store is not None:
        old = store.select(*STORE_COLS, F.lit(-1).cast("long").alias("_batch"), F.lit(0).cast("long").alias("_seq"))
        incoming = old.unionByName(incoming)
    latest = incoming.groupBy("key_hash").agg(F.max_by(
        F.struct(*[c for c in STORE_COLS if c != "key_hash"]),
        F.struct("created_at", "_batch", "_seq")).alias("_r"))
    return latest.select("key_hash", *[F.col(f"_r.{c}").alias(c) for c in STORE_COLS if c != "key_hash"])


#: Rows of a partition that a new store's number of buckets aims at; a stored one keeps its number.
PARTITION_ROWS = 1_000_000
#: Dependencies that get a folder each; a new store with more has groups of them, as many as its rows need.
FOLDERS = 1000


def _hashed(value: Column, parts: int) -> Column:
    return F.concat(F.pmod(F.xxhash64(value), F.lit(parts)).cast("string"), F.lit(f"of{parts}"))


def bucket_of(key: Column, buckets: int) -> Column:
    return _hashed(key, buckets)


def _placed(rows: DataFrame, buckets: int, groups: int | None) -> DataFrame:
    """``rows`` with the columns of their partition; groups: None where each dependency has a folder."""
    rows = rows.withColumn("bucket", bucket_of(F.col("key_hash"), buckets))
    return rows if groups is None else rows.withColumn("group", _hashed(F.col("dependency"), groups))


def _folder(groups: int | None) -> str:
    return "dependency" if groups is None else "group"


def _fitting(store: DataFrame) -> tuple[int, int | None]:
    """Buckets for the largest dependency's rows, and groups where the dependencies are many."""
    per = store.groupBy("dependency").count()
    n, most, rows = per.agg(F.count(F.lit(1)), F.max("count"), F.sum("count")).first()
    fit = lambda x: max(1, -(-(x or 0) // PARTITION_ROWS))
    return fit(most), fit(rows) if n > FOLDERS else None


def write_store(store: DataFrame, path: str, mode: str = "overwrite", buckets: int | None = None, groups: int | None = None) -> None:
    """Persist partitioned by dependency (or group of dependencies) and bucket; dynamic overwrite replaces only
    partitions that get rows.  Without buckets, both are found by counting."""
    if buckets is None:
        store = stored(store, "store-rows")[0]
        buckets, groups = _fitting(store)
    by = [_folder(groups), "bucket"]
    (_placed(store, buckets, groups).repartition(*by).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))


def stored_groups(spark: SparkSession, path: str) -> int | None:
    """How many groups of dependencies a stored table has; None where each dependency has a folder."""
    return next((int(n.rpartition("of")[2]) for n in list_names(spark, path) if n.startswith("group=")), None)


def _stored(spark: SparkSession, path: str, groups: int | None = None) -> DataFrame:
    extra = "" if groups is None else ", `group` string"
    return spark.read.schema(f"{schemas.RESPONSE_STORE.toDDL()}, bucket string{extra}").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).select(*STORE_COLS)


def lookup_responses(requests: DataFrame, store: DataFrame, now=None, key_col: str = "request_key") -> DataFrame:
    """Each request with the live store entry for its key (NULLs on a miss).

    ``now`` is a column or timestamp; by default the request's own ``ts``, and
    then an entry written after the request does not answer it.
    Expired rows never answer (the reference deletes them lazily on read; see
    ``purge`` with ``expired_before`` for the physical removal).
    """
    now_col = F.col("ts") if now is None else (now if not isinstance(now, str) else F.lit(now).cast("timestamp"))
    s = store.select(F.col("key_hash").alias("_k"), F.col("response_status").alias("store_status"),
                     F.col("response_body").alias("store_body"), F.col("created_at").alias("store_created_at"),
                     F.col("expires_at").alias("_exp"))
    j = requests.join(s, requests[key_col] == s["_k"], "left")
    live = F.col("_k").isNotNull() & is_live(F.col("_exp"), now_col)
    if now is None:
        live = live & (F.col("store_created_at") <= now_col)
    keep = [c for c in requests.columns]
    return j.select(*keep, live.alias("hit"),
                    F.when(live, F.col("store_status")).alias("store_status"),
                    F.when(live, F.col("store_body")).alias("store_body"),
                    F.when(live, F.col("store_created_at")).alias("store_created_at"))


def store_stats(store: DataFrame, by_dependency: bool = False) -> DataFrame:
    """A5: entries and total body size in characters (expired rows included).

    With ``by_dependency`` one row per dependency plus a total row
    (dependency NULL) from a rollup.
    """
    aggs = [F.count(F.lit(1)).alias("total_entries"),
            F.coalesce(F.sum(F.length("response_body")).cast("long"), F.lit(0).cast("long")).alias("total_size")]
    if not by_dependency:
        return store.agg(*aggs)
    return store.rollup("dependency").agg(*aggs, F.grouping("dependency").alias("is_total"))


def _purged(dependency: str | None, expired_before) -> Column:
    cond = F.lit(True)
    if dependency:
        cond = cond & (F.col("dependency") == dependency)
    if expired_before is not None:
        t = expired_before if not isinstance(expired_before, str) else F.lit(expired_before).cast("timestamp")
        cond = cond & F.col("expires_at").isNotNull() & (F.col("expires_at") < t)
    return F.coalesce(cond, F.lit(False))


def purge(store: DataFrame, dependency: str | None = None, expired_before=None) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, deleted count).  ''/None dependency = every dependency;
    ``expired_before`` additionally restricts deletion to rows expired by then."""
    flagged = store.withColumn("_del", _purged(dependency, expired_before))
    remaining = flagged.where(~F.col("_del")).drop("_del")
    deleted = flagged.agg(F.sum(F.col("_del").cast("long")).alias("deleted"))
    return remaining, deleted


# ------------------------------------------------------------ persisted store
def stored_buckets(spark: SparkSession, path: str) -> int | None:
    """How many buckets a stored table has; None if it has no partition."""
    for name in list_names(spark, path):
        if name.startswith(("dependency=", "group=")):
            for b in list_names(spark, f"{path}/{name}"):
                if b.startswith("bucket="):
                    return int(b.rpartition("of")[2])
    return None


LISTED = 1000


def touched_rows(spark: SparkSession, path: str, new: DataFrame, buckets: int) -> DataFrame:
    """The stored rows of all partitions that ``new`` (key_hash, dependency) changes: those its rows belong to, and
    those that hold one of its keys under another dependency.  The scan leaves out all others."""
    groups = stored_groups(spark, path)
    folder = _folder(groups)
    new = _placed(new.select("key_hash", "dependency"), buckets, groups).checkpoint()
    own = new.select(folder, "bucket").distinct()
    in_buckets = F.col("bucket").isin(sorted(r[0] for r in own.select("bucket").distinct().collect()))
    moved = (_stored(spark, path, groups).where(in_buckets).select("key_hash", "dependency", folder, "bucket")
             .join(new.select("key_hash", F.col("dependency").alias("_to")), "key_hash")
             .where(~F.col("dependency").eqNullSafe(F.col("_to"))).select(folder, "bucket"))
    parts = own.unionByName(moved).distinct().checkpoint()
    rows = _stored(spark, path, groups).where(in_buckets)
    names = [r[0] for r in parts.select(folder).distinct().limit(LISTED + 1).collect()]
    if len(names) <= LISTED and None not in names:
        rows = rows.where(F.col(folder).isin(names))
    same = rows[folder].eqNullSafe(parts[folder]) & (rows["bucket"] == parts["bucket"])
    return rows.join(parts, same, "left_semi")


def _replace(spark: SparkSession, path: str, rows: DataFrame, before: DataFrame, buckets: int, groups: int | None) -> None:
    """Puts ``rows`` in place of the partitions of ``before``, a row (folder, bucket) each."""
    name = _folder(groups)
    had = {tuple(r) for r in before.collect()}
    rows = rows.checkpoint()
    write_store(rows, path, buckets=buckets, groups=groups)
    have = {tuple(r) for r in _placed(rows.select("key_hash", "dependency"), buckets, groups).select(name, "bucket").distinct().collect()}
    gone = had - have
    by_name = {}
    for n in list_names(spark, path) if gone else ():
        if n.startswith(f"{name}="):
            by_name[unescape_path(n[len(name) + 1:])] = n
    for value, bucket in gone:
        folder = f"{path}/{by_name[value or '__HIVE_DEFAULT_PARTITION__']}"
        delete(spark, f"{folder}/bucket={bucket}")
        if not any(n.startswith("bucket=") for n in list_names(spark, folder)):
            delete(spark, folder)


def unescape_path(name: str) -> str:
    """A partition's value from its folder's name (Spark writes special characters as %XX)."""
    return urllib.parse.unquote(name)


def upsert_persisted(spark: SparkSession, path: str, new: DataFrame, ttl_seconds: float | None = 86400,
                     batch_id: int = 0, buckets: int | None = None) -> None:
    """S4 on a stored table: only partitions that gain or lose a row are rewritten.  buckets: of a new table."""
    at = stored_buckets(spark, path) if path_exists(spark, path) else None
    if at is None:
        write_store(upsert_responses(None, new, ttl_seconds, batch_id), path, buckets=buckets)
        return
    groups = stored_groups(spark, path)
    now = touched_rows(spark, path, new, at).checkpoint()
    before = now.select(_folder(groups), "bucket").distinct()
    _replace(spark, path, upsert_responses(now, new, ttl_seconds, batch_id), before, at, groups)


def purge_persisted(spark: SparkSession, path: str, dependency: str | None = None, expired_before=None) -> int:
    """A6 on a stored table: removes the rows and returns how many; partitions without such rows are only read."""
    at = stored_buckets(spark, path)
    if at is None:
        return 0
    groups = stored_groups(spark, path)
    by = [_folder(groups), "bucket"]
    now = _stored(spark, path, groups)
    if dependency and groups is not None:
        now = now.where(F.col("group") == _hashed(F.lit(dependency), groups))
    elif dependency:
        now = now.where(F.col("dependency") == dependency)
    flagged = now.withColumn("_del", _purged(dependency, expired_before))
    per = flagged.groupBy(*by).agg(F.sum(F.col("_del").cast("long")).alias("n")).where("n > 0").checkpoint()
    n = per.agg(F.sum("n")).first()[0] or 0
    if n:
        same = F.col(f"l.{by[0]}").eqNullSafe(F.col(f"r.{by[0]}")) & (F.col("l.bucket") == F.col("r.bucket"))
        kept = flagged.where(~F.col("_del")).alias("l").join(F.broadcast(per).alias("r"), same, "left_semi")
        _replace(spark, path, kept.select(*STORE_COLS), per.select(*by), at, groups)
    return n
