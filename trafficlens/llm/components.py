"""Connected components of an edge table: alternating large-star and small-star steps.

Each step aggregates a minimum per vertex (combined before the shuffle) and
hands it back to the vertex's edges with ``attach``, so a vertex with very
many edges is not one task's work.  Each step is a table in the shared
folder; those of the round before are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.common import attach
from trafficlens.session import delete, stored

ROWS_PER_FILE = 100_000


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex that has an edge; component: its smallest reachable id.

    edges: columns a, b (long), in any direction; loops and repeats do no harm.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame, rows: int) -> tuple[DataFrame, str]:
        # a few rows need few tasks; where there are more, the shuffle's own number stays
        return stored(df.coalesce(max(1, -(-rows // ROWS_PER_FILE))), "edges")

    both = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e, path = stored(both.distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        n = mark[0]
        # large star: neighbours above u go to u's smallest neighbour (or u)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = kept(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), n)
        star, star_path = kept(attach(both, least, "u", "n", 2 * n, "inner").filter("v > u")
                               .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n)
        # small star: neighbours below u, and u, go to the smallest
        low, low_path = kept(star.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), n)
        e, next_path = kept(attach(star, low, "u", "n", n, "inner").filter("v <> m")
                            .select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .unionByName(low.select("u", F.col("m").alias("v"))).distinct(), n)
        delete(spark, path, least_path, star_path, low_path)
        path = next_path
        before, mark = mark, _mark(e)
        if before == mark:
            break
    return (e.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct())
