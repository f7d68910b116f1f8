"""Folds over event streams: the same rules over a finished table and over a live stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.operators.access import MAX_OUTPUT

# Tools and the phase that their use shows.
PHASES = {
    "GetKpiKnowledge": "reading metric rules",
    "PrepareReportQuestion": "understanding the question",
    "SearchReport": "searching the report",
    "ReadReportChunks": "checking evidence",
    "finish_task": "result returned, waiting for summary",
}


def state_delta(deltas: DataFrame, scope: str, order: str) -> DataFrame:
    """The merged state: the last value of each top-level key. ``deltas(scope, order, key, value)``."""
    return deltas.groupBy(scope, "key").agg(F.max_by("value", order).alias("value"))


def live_state(deltas: DataFrame, scope: str, order: str, ended: str) -> DataFrame:
    """``state_delta`` of what is alive: a scope's terminal event clears all that was set up to it.

    ``ended`` is SQL for whether a row is such an event; a scope that was cleared
    and not used again has no row.
    """
    last = deltas.groupBy(scope).agg(F.max(F.expr(f"case when {ended} then {order} end")).alias("cleared"))
    alive = deltas.join(last, scope).where(f"cleared is null or {order} > cleared")
    return state_delta(alive, scope, order)


def phase(tool: str) -> str:
    return "case " + " ".join(f"when {tool} = '{t}' then '{p}'" for t, p in PHASES.items()) + " end"


def worker_phase(events: DataFrame, tasks: DataFrame, order: str) -> DataFrame:
    """The last phase of each known task. ``events(scope, author, tool, has_output, order)``."""
    last = "element_at(filter(split(scope, '/'), x -> x <> ''), -1)"
    mine = events.where("author in ('kpi_worker', 'report_qa_worker') and scope rlike '[^/]'").withColumn("task_id", F.expr(last)).join(tasks.select("task_id"), "task_id", "left_semi")
    shown = mine.withColumn("phase", F.expr(f"coalesce({phase('tool')}, case when has_output then '{PHASES['finish_task']}' end)")).where("phase is not null")
    return shown.groupBy("task_id").agg(F.max_by("phase", order).alias("phase"))


def merged_entries(events: DataFrame, scope: str, order: str) -> DataFrame:
    """Assistant texts after merging partial and final events, in order: ``scope, entries``.

    A partial event extends the last entry if that is a partial one of the same
    author.  A final one replaces the entry with its id, or else the last entry if
    that is a partial one of its author, or else is added.  One scope is one
    message's events, which are folded in order.
    """
    entry = "named_struct('id', e.id, 'author', e.author, 'partial', e.partial, 'text', e.text)"
    none = "cast(array() as array<struct<id:string,author:string,partial:boolean,text:string>>)"
    last = "element_at(a, -1)"
    open_ = f"(size(a) > 0 and {last}.partial and {last}.author = e.author)"
    extended = f"concat(slice(a, 1, size(a) - 1), array(named_struct('id', e.id, 'author', e.author, 'partial', true, 'text', concat({last}.text, e.text))))"
    # A final event replaces the first entry with its id.
    at = "coalesce(array_position(transform(a, x -> coalesce(x.id, '') = coalesce(e.id, '-')), true), 0)"
    replaced = f"transform(a, (x, i) -> case when i = {at} - 1 then {entry} else x end)"
    final = f"case when {at} > 0 then {replaced} when {open_} then concat(slice(a, 1, size(a) - 1), array({entry})) else concat(a, array({entry})) end"
    step = f"case when e.text = '' then a when e.partial then case when {open_} then {extended} else concat(a, array({entry})) end else {final} end"
    gathered = events.groupBy(scope).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "id", "author", "partial", "text"))).alias("es"))
    return gathered.select(scope, F.expr(f"aggregate(es, {none}, (a, e) -> {step})").alias("entries"))


def budget_stream(calls: DataFrame, scope: str, size: str, most: int = MAX_OUTPUT, idle: str | None = None) -> DataFrame:
    """The output budget as keyed streaming state: ``scope, output_chars, accepted, refused`` after each batch.

    Calls of a scope have to arrive in order, as they do from one conversation.
    With ``idle``, a duration in ms, the state of a scope that has had no call for
    so long is cleared.
    """
    import pandas as pd

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used, accepted, refused = state.get if state.exists else (0, 0, 0)
        for frame in frames:
            for n in frame["n"].tolist():
                if used + n > most:
                    refused += 1
                else:
                    used, accepted = used + n, accepted + 1
        state.update((used, accepted, refused))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame({scope: [key[0]], "output_chars": [used], "accepted": [accepted], "refused": [refused]})

    kind = calls.schema[scope].dataType.simpleString()
    rows = calls.select(scope, F.col(size).cast("long").alias("n"))
    return rows.groupBy(scope).applyInPandasWithState(
        update, f"{scope} {kind}, output_chars long, accepted long, refused long", "used long, accepted long, refused long", "update", "ProcessingTimeTimeout" if idle else "NoTimeout"
    )
