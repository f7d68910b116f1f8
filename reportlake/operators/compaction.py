"""Context compaction of ordered conversation contents.

``contents(scope, pos, json, calls, responses)``: one row per item, positions
from 1, the ids of the tool calls and tool responses in it as arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHARS_PER_TOKEN, THRESHOLD, RETENTION, MAX_SUMMARY = 4, 64_000, 16_000, 16_000


def tokens(contents: DataFrame) -> DataFrame:
    return contents.groupBy("scope").agg(F.expr(f"cast(sum(length(json)) div {CHARS_PER_TOKEN} as bigint)").alias("tokens"))


def digests(contents: DataFrame) -> DataFrame:
    """SHA-256 over the items in order, each followed by a zero character. A scope is one conversation."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "json")))
    joined = F.array_join(F.transform(ordered, lambda x: F.concat(x["json"], F.expr("chr(0)"))), "")
    return contents.groupBy("scope").agg(F.sha2(joined, 256).alias("digest"))


def boundaries(contents: DataFrame) -> DataFrame:
    """Positions after which no call is open.

    An item's responses are taken off before its calls are added, so a response
    closes calls of earlier items only.  A call is open from its position up to
    the next response with its id.
    """
    calls = contents.select("scope", "pos", F.explode("calls").alias("id"))
    answers = contents.select("scope", F.col("pos").alias("answered"), F.explode("responses").alias("id"))
    spans = calls.join(answers, ["scope", "id"], "left").groupBy("scope", "id", "pos").agg(F.min(F.expr("case when answered > pos then answered end")).alias("until"))
    steps = spans.select("scope", F.col("pos").alias("at"), F.lit(1).alias("d")).unionByName(spans.where("until is not null").select("scope", F.col("until").alias("at"), F.lit(-1).alias("d")))
    change = steps.groupBy("scope", "at").agg(F.sum("d").alias("d"))
    over = Window.partitionBy("scope").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    joined = contents.select("scope", "pos").join(change.withColumnRenamed("at", "pos"), ["scope", "pos"], "left")
    opened = joined.withColumn("open", F.sum(F.coalesce("d", F.lit(0))).over(over))
    return opened.where("open = 0").select("scope", "pos")


def desired_split(contents: DataFrame, retention_chars: int = RETENTION * CHARS_PER_TOKEN) -> DataFrame:
    """How many items precede the retained tail: the tail grows from the end until it holds ``retention_chars``."""
    from_end = Window.partitionBy("scope").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    tail = contents.withColumn("tail", F.sum(F.length("json")).over(from_end))
    return tail.groupBy("scope").agg(F.coalesce(F.max(F.when(F.col("tail") >= retention_chars, F.col("pos") - 1)), F.lit(0)).alias("desired"))


def split(contents: DataFrame, retention_chars: int = RETENTION * CHARS_PER_TOKEN) -> DataFrame:
    """The last safe boundary within the desired split; 0 if there is none."""
    wanted = desired_split(contents, retention_chars)
    safe = wanted.join(boundaries(contents), "scope", "left").where("pos is null or pos <= desired")
    best = safe.groupBy("scope").agg(F.max("pos").alias("split"))
    return wanted.join(best, "scope", "left").select("scope", "desired", F.coalesce("split", F.lit(0)).alias("split"))


def plan(contents: DataFrame, records: DataFrame, threshold: int = THRESHOLD, retention_chars: int = RETENTION * CHARS_PER_TOKEN) -> DataFrame:
    """What to do for each scope, given ``records(scope, prefix_count, prefix_digest, summary)``.

    A record is valid if its digest is that of as many items.  ``action`` is
    ``keep`` (send what there is), ``reuse`` (send the old summary and the rest)
    or ``summarize`` items ``first_item`` to ``split``, after the old summary if
    ``with_summary``.
    """
    prefix = contents.join(records.select("scope", "prefix_count"), "scope").where("pos <= prefix_count")
    checked = digests(prefix).join(prefix.groupBy("scope").agg(F.max("pos").alias("have"), F.sum(F.length("json")).alias("prefix_chars")), "scope")
    valid = records.join(checked, "scope").where("digest = prefix_digest and have = prefix_count and prefix_count > 0 and summary is not null")
    total = contents.groupBy("scope").agg(F.sum(F.length("json")).alias("chars"))
    all_ = total.join(split(contents, retention_chars), "scope").join(valid.select("scope", "prefix_count", "prefix_chars", "summary"), "scope", "left")
    now = F.expr(f"case when prefix_count is null then chars else chars - prefix_chars + length(summary) end div {CHARS_PER_TOKEN}")
    action = (
        f"case when effective < {threshold} then case when prefix_count is null then 'keep' else 'reuse' end when split = 0 then 'keep' "
        "when split <= coalesce(prefix_count, 0) then 'reuse' else 'summarize' end"
    )
    out = all_.withColumn("effective", now).withColumn("action", F.expr(action))
    first = F.expr("case when action = 'summarize' then coalesce(prefix_count, 0) + 1 end")
    return out.select("scope", F.col("effective").alias("tokens"), "action", first.alias("first_item"), F.expr("case when action = 'summarize' then split end").alias("split"), F.expr("action = 'summarize' and prefix_count is not null").alias("with_summary"))


def bounded_parts(parts: DataFrame, scope: str, order: str, text: str, most: int = MAX_SUMMARY) -> DataFrame:
    """Text parts in order until ``most`` characters, the last one cut."""
    before = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = parts.where(f"{text} <> ''").withColumn("used", F.coalesce(F.sum(F.length(text)).over(before), F.lit(0))).where(f"used < {most}")
    return run.select(scope, order, F.expr(f"substring({text}, 1, cast({most} - used as int))").alias("part"))


def scope_key(agent: str, scope: str) -> str:
    return f"concat({agent}, ':', substring(sha2(coalesce({scope}, 'root'), 256), 1, 16))"
