"""Report artifacts: bytes with a name and a type, to chunks; and versioned saving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.operators import chunking, ordering

CHUNK = "chunk_id string, page int, heading string, text string"
NOT_UTF8 = "report artifact is not valid UTF-8"
# The keys that a chunk must have.
KEYS = ("chunk_id", "page", "heading", "text")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """``artifact_name, content`` of the files under ``path``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("artifact_name"), "content")


def is_markdown(name: str = "artifact_name", mime: str = "mime_type") -> str:
    return f"(coalesce({mime}, '') in ('text/markdown', 'text/x-markdown') or lower({name}) rlike '[.](md|markdown)$')"


def load_chunks(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of ``artifacts(report_ref, artifact_name, mime_type, content)``, and ``(report_ref, error)``.

    An artifact is read as a whole or not at all: bytes that are not UTF-8, a
    line that is not JSON, a record that is no chunk fail it with a message, and
    none of its chunks come out.
    """
    decoded = artifacts.withColumn("ok", F.expr("is_valid_utf8(cast(content as string))")).withColumn("text", F.expr("cast(content as string)"))
    decoded = decoded.withColumn("markdown", F.expr(is_markdown()))
    marked = chunking.chunk_reports(decoded.where("ok and markdown").select("report_ref", "text")).drop("chunk_index")
    lines = decoded.where("ok and not markdown").select("report_ref", F.posexplode(F.split("text", "\\r?\\n")).alias("line", "raw")).where("trim(raw) <> ''")
    parsed = lines.select("report_ref", "line", F.expr("try_parse_json(raw)").alias("v"), "raw")
    keys = [F.expr(f"try_variant_get(v, '$.{k}', 'string')").alias(k) for k in KEYS]
    rows = parsed.select("report_ref", "line", F.col("v").isNull().alias("broken"), *keys)
    broken = F.expr(f"case when broken then '{chunking.BAD_JSONL}' end")
    bad = F.expr(chunking.chunk_violation())
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line")))
    checked = rows.groupBy("report_ref").agg(F.coalesce(first(broken), first(bad)).alias("error"))
    errors = decoded.where("not ok").select("report_ref", F.lit(NOT_UTF8).alias("error")).unionByName(checked.where("error is not null"))
    good = rows.join(checked.where("error is null").select("report_ref"), "report_ref", "left_semi")
    jsonl = good.select("report_ref", "chunk_id", F.col("page").cast("int").alias("page"), "heading", "text")
    return marked.unionByName(jsonl), errors


def to_jsonl(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def from_jsonl(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a bad one fails the read."""
    read = F.from_json(F.col(column), schema, {"mode": "FAILFAST"})
    return lines.where(f"trim({column}) <> ''").select(read.alias("r")).select("r.*")


def next_versions(saves: DataFrame, order: str) -> DataFrame:
    """Versions of artifacts saved under one name, from 0."""
    from pyspark.sql import Window

    return saves.withColumn("version", F.row_number().over(Window.partitionBy("artifact_name").orderBy(order)) - 1)


def save(artifacts: DataFrame, path: str) -> None:
    """Append versions of artifacts; readers pick the largest version of a name."""
    artifacts.write.mode("append").partitionBy("artifact_name").parquet(path)


def samples(files: DataFrame, name: str = "name", size: str = "size") -> DataFrame:
    """PDF files in order of their names regardless of case: ``position, name, size, url``."""
    from reportlake.functions import text as T

    pdf = files.where(f"lower({name}) like '%.pdf'").withColumn("__folded", F.expr(T.fold(name)))
    url = F.expr(f"concat('/raw-pdf/', replace({T.percent_quoted(name)}, '/', '%2F'))").alias("url")
    return ordering.numbered(pdf, "__folded", name).select("position", name, size, url)
