"""Mixing sources to target weights: repetition rates per source, whole copies plus one hash-seeded draw.

Tokens are summed per source; each source's target is its share by weight,
but at most ``LIMIT`` times its own tokens, and what is over goes to the
others by weight.  A source's rate is target over tokens; each document is
taken floor(rate) times, and once more with the fraction as probability.

Only DataFrame functions.  Rates are ratios of whole numbers, so a rate of
exactly 3 never draws a fourth copy.  The draw is the start of an MD5 over
doc_id, source, text and the number of the occurrence: reruns, lost executors
and other layouts give the same mix.

Defined cases: a null text has no tokens; sources are ordered by code point,
null last, and null is a source like any other.  Rows alike in doc_id, source
and text are one document that occurs several times; each occurrence draws
for itself.  A document without tokens is taken as often as its source's rate
says (its tokens are 0), and never where the source has none at all.  Other
columns of any name stay in ``mix``; of rows alike it takes the smallest
values of those that can be ordered.  No rows: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.llm.common import attach, prepare, table
from trafficlens.llm.registry import register
from trafficlens.session import stored

WEIGHTS = (5, 2, 1)
LIMIT = 3
WORD = r"[^\x20\x09-\x0D]+"

#: Up to this many sources (counted) the rates are broadcast: under 1 MB.  Beyond, they meet the rows in a join.
BROADCAST_SOURCES = 10_000
#: Sources numbered by one task, and occurrences of one document listed by one task.
CHUNK = 100_000
KEY = ["__id", "__source", "__digest"]
WIDE = "decimal(38,0)"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _never_null(value: Column) -> Column:
    """A text that is never null and keeps the order: by code point, null last."""
    return F.when(value.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), value.cast("string")))


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows in one struct, with what the mix needs to know of them."""
    digest = F.when(F.col("text").isNull(), F.lit("")).otherwise(F.md5(F.col("text")))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), _never_null(F.col("doc_id")).alias("__id"),
                       _never_null(F.col("source")).alias("__source"), digest.alias("__digest"),
                       n_tokens(F.col("text")).alias("__size"))


def numbered(sources: DataFrame, n: int) -> DataFrame:
    """``sources`` with ``rank``, from 0 in the order of ``__source``; range partitions are numbered each by itself."""
    parts, _ = stored(sources.repartitionByRange(n // CHUNK + 1, "__source")
                      .withColumn("part", F.spark_partition_id()), "mix-sources")
    before = parts.groupBy("part").agg(F.count("*").alias("rows"))
    before = before.alias("a").join(F.broadcast(before.alias("b")), F.col("b.part") < F.col("a.part"), "left") \
        .groupBy("a.part").agg(F.coalesce(F.sum("b.rows"), F.lit(0)).alias("before"))
    place = F.expr("row_number() over (partition by part order by __source)")
    return (parts.withColumn("place", place).join(F.broadcast(before), "part")
            .withColumn("rank", F.col("before") + F.col("place") - 1).drop("part", "place", "before"))


@dataclass
class Mixture:
    """documents: one row per distinct document (KEY, __size, n occurrences); rates: one per source, as num / den."""
    documents: DataFrame
    rates: DataFrame
    n_sources: int
    n_rows: int

    def rated(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with __source) and their source's figures."""
        if self.n_sources <= BROADCAST_SOURCES:
            return rows.join(F.broadcast(self.rates.drop("rows")), "__source")
        return attach(rows, self.rates, "__source", "rows", self.n_rows, "inner")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> Mixture:
    """Counts the documents and their sources, and levels the targets.

    weights: of the sources in order, repeating.  limit: a target is at most
    so many times the source's tokens.
    """
    # one small row per document: texts are read once and never shuffled
    documents, _ = stored(_keyed(docs).groupBy(*KEY).agg(F.first("__size").alias("__size"), F.count("*").alias("n")),
                          "mix-documents")
    sources, _ = stored(documents.groupBy("__source").agg(F.sum(F.col("__size") * F.col("n")).alias("source_size"),
                                                          F.sum("n").alias("rows")), "mix-sizes")
    n_sources, n_rows, total = sources.agg(F.count("*"), F.sum("rows"), F.sum("source_size")).first()
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked, _ = stored(numbered(sources, n_sources).withColumn(
        "weight", F.get(cycle, F.col("rank") % len(weights)).cast("long")), "mix-ranked")
    # all targets are weight * rest / share until they meet their limit; the level only rises, so a source once
    # above its limit stays there, and each turn is one sum over the sources
    rest, share = int(total or 0), None
    most = F.col("source_size").cast(WIDE) * limit
    capped = F.lit(False)
    while True:
        left = ranked.filter(~capped).agg(F.sum("weight")).first()[0]
        over = ranked.filter(capped).agg(F.sum(most)).first()[0]
        rest = int(total or 0) - int(over or 0)
        if share == left or not left:
            break
        share = left
        capped = most * F.lit(share).cast(WIDE) < F.col("weight").cast(WIDE) * F.lit(rest).cast(WIDE)
    some = F.lit(rest).cast(WIDE) * F.col("weight")
    at_limit = capped | (F.col("source_size") == 0)
    num = F.when(at_limit, F.lit(limit)).otherwise(some).cast(WIDE)
    den = F.when(at_limit, F.lit(1)).otherwise(F.lit(share or 1).cast(WIDE) * F.col("source_size")).cast(WIDE)
    target = F.when(at_limit, most.cast("double")).otherwise(some.cast("double") / F.lit(float(share or 1)))
    rates = ranked.select("__source", "source_size", "rows", target.alias("target"),
                          F.when(F.col("source_size") == 0, F.lit(0)).otherwise(num).cast(WIDE).alias("num"),
                          den.alias("den"))
    rates, _ = stored(rates, "mix-rates")
    return Mixture(documents, rates, n_sources, int(n_rows or 0))


def copies(occurrence: Column) -> Column:
    """How often an occurrence of a document (KEY, num, den in its row) is taken."""
    said = F.concat_ws("|", *[F.col(c) for c in KEY], occurrence.cast("string"))
    draw = F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
    whole = F.expr("num div den").cast("long")
    return whole + F.when(draw < (F.expr("num % den").cast("double") / F.col("den").cast("double")), 1).otherwise(0)


def occurrences(documents: DataFrame) -> DataFrame:
    """One row per occurrence, numbered from 0; a document that occurs very often is listed by many tasks."""
    few = documents.filter(F.col("n") <= CHUNK).withColumn("occurrence", F.explode(F.expr("sequence(0, n - 1)")))
    many = (documents.filter(F.col("n") > CHUNK)
            .withColumn("chunk", F.explode(F.expr(f"sequence(0, (n - 1) div {CHUNK})")))
            .repartition(*KEY, "chunk")
            .withColumn("occurrence", F.explode(F.expr(
                f"sequence(chunk * {CHUNK}, least(n, (chunk + 1) * {CHUNK}) - 1)"))).drop("chunk"))
    return few.unionByName(many)


def repetitions(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, occurrence, source_size, target, copies, taken (tokens)."""
    m = mixture(docs, weights, limit)
    rows = m.rated(occurrences(m.documents)).withColumn("copies", copies(F.col("occurrence")))
    kind = docs.schema["doc_id"].dataType
    return rows.select(
        F.when(F.col("__id") != "1", F.expr("substring(__id, 2)")).cast(kind).alias("doc_id"),
        F.when(F.col("__source") != "1", F.expr("substring(__source, 2)")).cast(docs.schema["source"].dataType)
        .alias("source"),
        F.col("__size").alias("size"), "occurrence", "source_size", "target", "copies",
        (F.col("copies") * F.col("__size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The mixed corpus: whole rows of ``docs``, each as often as it is taken.

    Texts are shuffled only where rows are alike (and of those only one a
    task and document).
    """
    m = mixture(docs, weights, limit)
    rows = _keyed(docs)
    alike = m.documents.filter("n > 1")
    single = m.rated(rows).withColumn("times", copies(F.lit(0)))
    if not alike.isEmpty():
        drawn = (m.rated(occurrences(alike)).groupBy(*KEY).agg(F.sum(copies(F.col("occurrence"))).alias("times")))
        drawn, _ = stored(drawn, "mix-drawn")
        ordered = [f.name for f in docs.schema.fields if _orderable(f.dataType)]
        others = [c for c in docs.columns if c not in ordered]
        one = (rows.join(drawn.select(*KEY), KEY, "left_semi").groupBy(*KEY)
               .agg(F.min(F.struct(*[F.col(f"__row.`{c}`") for c in ordered])).alias("__least"),
                    *[F.any_value(F.col(f"__row.`{c}`")).alias(f"__any_{i}") for i, c in enumerate(others)]))
        one = one.withColumn("__row", F.struct(*[
            (F.col(f"__least.`{c}`") if c in ordered else F.col(f"__any_{others.index(c)}")).alias(c)
            for c in docs.columns]))
        single = (single.join(drawn.select(*KEY), KEY, "left_anti").select("__row", *KEY, "times")
                  .unionByName(one.join(drawn, KEY).select("__row", *KEY, "times")))
    out = single.filter("times > 0")
    few = out.filter(F.col("times") <= CHUNK).withColumn("copy", F.explode(F.expr("sequence(1, times)")))
    if not alike.isEmpty():
        many = (out.filter(F.col("times") > CHUNK)
                .withColumn("chunk", F.explode(F.expr(f"sequence(0, (times - 1) div {CHUNK})")))
                .repartition(*KEY, "chunk")
                .withColumn("copy", F.explode(F.expr(
                    f"sequence(chunk * {CHUNK} + 1, least(times, (chunk + 1) * {CHUNK}))"))).drop("chunk"))
        few = few.unionByName(many)
    return few.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


_ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
             CASE WHEN doc_id IS NULL THEN '1' ELSE '0' || doc_id END AS i, CASE WHEN text IS NULL THEN '' ELSE md5(text) END AS digest
           FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY i, k, digest) - 1 AS occurrence FROM d),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
r AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY encode(k)) - 1) % 3 + 1] AS w FROM s),
-- in the order in which sources meet three times their size: what is left, and for which weights
p AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, k) AS place,
             sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
               ORDER BY 3.0 * source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY 3.0 * source_size / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
      FROM r),
l AS (SELECT arg_min(rest, place) AS rest, arg_min(share, place) AS share
      FROM p WHERE 3 * source_size::HUGEINT * share >= w * rest::HUGEINT),
t AS (SELECT k, source_size, 3 * source_size::HUGEINT * share < w * rest::HUGEINT OR source_size = 0 AS capped,
             w * rest::HUGEINT AS num, share::HUGEINT * source_size AS den, share
      FROM r, l),
u AS (SELECT k, source_size, CASE WHEN capped THEN 3.0 * source_size ELSE num::DOUBLE / share::DOUBLE END AS target,
             CASE WHEN source_size = 0 THEN 0 WHEN capped THEN 3 ELSE num END AS num,
             CASE WHEN capped THEN 1 ELSE den END AS den FROM t)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * (num // den + CASE WHEN ('0x' || substr(md5(i || '|' || k || '|' || digest || '|' || occurrence), 1, 13))::BIGINT
                                       / 4503599627370496.0 < (num % den)::DOUBLE / den::DOUBLE THEN 1 ELSE 0 END))::BIGINT AS taken,
       source, occurrence::BIGINT AS occurrence
FROM o JOIN u USING (k)
"""


@register("op11_mixing", _ORACLE)
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by the weights 5, 2, 1 with targets of at most three times a source."""
    prepare(spark)
    return repetitions(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "occurrence")
