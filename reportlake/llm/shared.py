"""Plumbing that the operators share: scratch tables, keys, partition counts.

Scratch tables live in the folder that the cluster names in
``spark.checkpoint.dir``.  Only where that setting is absent (tests, a laptop)
and the master is local is a folder of our own used.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside operators: after every real id.
NO_ID = (1 << 63) - 1

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="reportlake-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/reportlake/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let go of what plans hold that nobody uses any more: broadcast tables, shuffle files of counts.

    Spark deletes them when the driver's JVM collects the plans; between two
    stages of one operator that would otherwise come much too late.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Paths of the scratch tables written inside each open ``passing``.
_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written inside are deleted at its end, but for those made to last.

    Nothing that is used afterwards may depend on the others.
    """
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Spark's setting by which a finished execution deletes its own shuffle files.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet; its shuffle files go at once, not whenever the driver's JVM collects its plan."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends here.

    A lost executor then costs the tasks that ran on it, not the whole chain.
    Inside ``passing`` a table that is not ``lasting`` goes with it.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    scope = len(_passing) - 1 - lasting
    if scope >= 0:
        _passing[scope].append(path)
    write_table(df, path)
    del df  # or what its plan holds would outlive this
    release(spark)
    return spark.read.schema(schema).parquet(path)


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def row_tag(id_col: str, text_col: str) -> Column:
    """A 64-bit hash of a row's id and text: rows that share it are repeated rows."""
    return F.xxhash64(id_key(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("tag")


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc long, tag long, text string)``: what the text operators work on.

    ``doc`` is the id with null as ``NO_ID``; ``tag`` tells rows apart that
    share an id but not a text.  Every other column of the input stays out, so
    its names cannot clash with ours.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        id_key(id_col).alias("doc"),
        row_tag(id_col, text_col),
        text.alias("text"),
    )


def without(documents: DataFrame, bad: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` without the rows that ``bad(doc, tag)`` names, their columns untouched."""
    own = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(own, id_key(id_col).alias("doc"), row_tag(id_col, text_col))
    return rows.join(bad, ["doc", "tag"], "left_anti").select("row.*")


def named_id(column: str = "doc") -> Column:
    """Back from ``id_key``."""
    return F.when(F.col(column) == NO_ID, F.lit(None)).otherwise(F.col(column)).cast("long")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; a plain scan's is that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame, mb_each: int = 4) -> int:
    """Buckets for an exchange keyed by hash: enough that each fits a task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * parts, min(1 << 20, plan_bytes(df) // (mb_each << 20)))


#: Rows up to which a checked table of ids or parameters is broadcast.
BROADCAST_ROWS = 50_000


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df``, which must be materialized, if counting shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
