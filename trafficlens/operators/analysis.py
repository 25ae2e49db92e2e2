"""G1: parse model output into endpoint rows, with a quarantine for failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.functions.jsonfix import repair_json

# One endpoint element; bodies are kept as raw JSON text.
ENDPOINT_ELEM = T.ArrayType(T.StructType([
    T.StructField("method", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("request_body", T.StringType()),
    T.StructField("response_body", T.StringType()), T.StructField("status_code", T.IntegerType())]))


def parse_endpoints(raw: DataFrame, id_col: str = "output_id", text_col: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(endpoints, quarantine).

    The text is repaired (F17) and must be a non-empty JSON array; an invalid
    document or an empty array goes to the quarantine with a reason.  Missing
    fields take zero values ('' and 0), bodies may be null.
    """
    cleaned = raw.select(F.col(id_col), repair_json(F.col(text_col)).alias("_clean"))
    n = F.json_array_length("_clean")
    tagged = cleaned.withColumn("_n", n)
    bad = tagged.where(F.col("_n").isNull() | (F.col("_n") == 0)).select(
        F.col(id_col), F.when(F.col("_n").isNull(), "invalid_json").otherwise("empty_array").alias("error"))
    good = (tagged.where(F.col("_n") > 0)
            .select(F.col(id_col), F.posexplode(F.from_json("_clean", ENDPOINT_ELEM)).alias("pos", "e")))
    present = lambda c: F.coalesce(c.isNotNull() & (c != "null"), F.lit(False))
    endpoints = good.select(
        F.col(id_col), F.col("pos"),
        F.coalesce(F.col("e.method"), F.lit("")).alias("method"),
        F.coalesce(F.col("e.path"), F.lit("")).alias("path"),
        F.coalesce(F.col("e.description"), F.lit("")).alias("description"),
        F.coalesce(F.col("e.status_code"), F.lit(0)).alias("status_code"),
        present(F.col("e.request_body")).alias("has_request_body"),
        present(F.col("e.response_body")).alias("has_response_body"))
    return endpoints, bad
