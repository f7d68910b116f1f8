"""Reports to pages, headings and bounded chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.functions import text as T


def split_pages(reports: DataFrame, text_col: str = "text") -> DataFrame:
    """All pages with their numbers, blank ones too."""
    keep = [F.col(c) for c in reports.columns if c != text_col]
    return reports.select(*keep, F.posexplode(F.expr(T.pages(text_col))).alias("at", "raw")).select(
        *[c for c in reports.columns if c != text_col], (F.col("at") + 1).alias("page"), F.expr(T.strip("raw")).alias("body")
    )


def with_headings(pages: DataFrame) -> DataFrame:
    """Pages that are not blank, with the first heading of each."""
    return pages.where("body <> ''").withColumn("heading", F.expr(T.heading("body")))


def chunk_pages(pages: DataFrame) -> DataFrame:
    """``report_ref, chunk_id, page, chunk_index, heading, text``."""
    pieces = pages.select("report_ref", "page", "heading", F.posexplode(F.expr(T.bounded_pieces("body"))).alias("chunk_index", "text"))
    return pieces.select("report_ref", F.expr("concat(report_ref, ':p', page, ':c', chunk_index)").alias("chunk_id"), "page", "chunk_index", "heading", "text")


def chunk_reports(reports: DataFrame) -> DataFrame:
    """Chunks of ``reports(report_ref, text)``. The input decides on parallelism: one report is one task's row."""
    return chunk_pages(with_headings(split_pages(reports)))


def chunk_texts(rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    return rows.select(id_col, F.posexplode(F.expr(T.bounded_pieces(text_col))).alias("chunk_index", "text"))


def manifests(reports: DataFrame) -> DataFrame:
    """One manifest per report; blank pages count."""
    return reports.select(
        "report_ref",
        F.expr("concat(report_ref, '.md')").alias("artifact_name"),
        F.lit("text/markdown").alias("mime_type"),
        F.expr(f"cast(size({T.pages('text')}) as bigint)").alias("total_pages"),
        F.expr("cast(length(text) as bigint)").alias("total_chars"),
    )


# Fixed values.
BAD_CHUNK = "report artifact contains an invalid chunk"
LONG_CHUNK = "chunk exceeds 6000 characters"
BAD_JSONL = "report artifact is invalid JSONL"


def chunk_violation(chunk_id: str = "chunk_id", page: str = "page", heading: str = "heading", text: str = "text") -> str:
    """SQL: why a record is no chunk, or null. A missing key reads as null."""
    missing = " or ".join(f"{c} is null" for c in (chunk_id, page, heading, text))
    return f"case when {missing} then '{BAD_CHUNK}' when length({text}) > {T.MAX_CHUNK} then '{LONG_CHUNK}' end"


def report_validity(records: DataFrame, order_col: str) -> DataFrame:
    """The first violation of each report in order; null where it is valid."""
    checked = records.withColumn("violation", F.expr(chunk_violation()))
    return checked.groupBy("report_ref").agg(F.min_by("violation", F.expr(f"case when violation is not null then {order_col} end")).alias("error"), F.count("*").alias("records"))
