"""The read-only catalogue of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.operators.metrics import METRICS

SCHEMA = (
    "kpi_key string, name string, definition string, accepted_labels array<string>, rejected_labels array<string>, "
    "preferred_statements array<string>, retrieval_hints array<string>, normalization_rule string, cautions array<string>"
)

def catalog(spark: SparkSession) -> DataFrame:
    """31 rows, a fixed table, so joins with it are broadcast."""
    return spark.createDataFrame(METRICS, SCHEMA)


def lookup(requests: DataFrame, key: str = "kpi_key") -> DataFrame:
    """Requests with their metric's knowledge; an unknown key gets an error and all supported keys."""
    known = F.broadcast(catalog(requests.sparkSession).withColumnRenamed("kpi_key", "known_key"))
    supported = F.when(F.col("known_key").isNull(), F.array(*[F.lit(m["kpi_key"]) for m in METRICS]))
    error = F.when(F.col("known_key").isNull(), F.concat(F.lit("unknown KPI key: "), F.col(key)))
    return requests.join(known, F.col(key) == F.col("known_key"), "left").withColumn("error", error).withColumn("supported", supported)


def unknown(requests: DataFrame, key: str = "kpi_key") -> DataFrame:
    return requests.join(F.broadcast(catalog(requests.sparkSession).select(F.col("kpi_key").alias(key))), key, "left_anti")
