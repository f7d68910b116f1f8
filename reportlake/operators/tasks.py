"""The task graph, event-sourced.

A log of events per task, in order, is the truth; current records, edges,
progress and status changes are views of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportlake.operators import ordering

STATUSES = ("pending", "in_progress", "completed")
# Fixed values.
MISSING_ID = "missing required argument: taskId"
UNKNOWN_TASK = "unknown task"
SELF_BLOCK = "a task cannot block itself"
UNKNOWN_RELATED = "unknown related task IDs: "
ACTIVE, REPORT, DONE = (
    "continue active tasks; tasks with recorded errors may be reported incomplete",
    "report the recorded incomplete tasks honestly",
    "all tasks are completed",
)


def replay(log: DataFrame, task: str, order: str, fields: tuple[str, ...]) -> DataFrame:
    """The current record of each task: for each field the last value that was set."""
    last = [F.max_by(f, F.expr(f"case when {f} is not null then {order} end")).alias(f) for f in fields]
    return log.groupBy(task).agg(*last)


def status_changes(log: DataFrame, task: str, order: str, start: str = "pending") -> DataFrame:
    """``from_status, to_status`` where an update set another status than the one before."""
    set_ = log.where("status is not null")
    before = F.coalesce(F.lag("status").over(Window.partitionBy(task).orderBy(order)), F.lit(start))
    return set_.withColumn("from_status", before).where("from_status <> status").withColumnRenamed("status", "to_status")


def merged_metadata(updates: DataFrame, task: str, order: str) -> DataFrame:
    """Last write per key; a null deletes the key. ``updates(task, order, key, value)``."""
    last = updates.groupBy(task, "key").agg(F.max_by(F.struct("value"), order).alias("v"))
    return last.select(task, "key", F.col("v.value").alias("value")).where("value is not null")


def merge_maps(existing: str, updates: str) -> str:
    """SQL: the shallow merge of two maps; a null in ``updates`` deletes."""
    kept = f"map_filter({existing}, (k, v) -> not map_contains_key({updates}, k))"
    return f"map_concat({kept}, map_filter({updates}, (k, v) -> v is not null))"


def edges(links: DataFrame) -> DataFrame:
    """Symmetric edges, each once: ``links(task, relation, related)`` to ``(blocker, blocked)``."""
    blocker = F.expr("case when relation = 'blocks' then task else related end")
    blocked = F.expr("case when relation = 'blocks' then related else task end")
    return links.select(blocker.alias("blocker"), blocked.alias("blocked")).where("blocker <> blocked").distinct()


def adjacency(edge: DataFrame) -> DataFrame:
    """``task, blocks, blocked_by`` as sorted sets."""
    both = edge.selectExpr("blocker as task", "blocked as b", "cast(null as bigint) as c").unionByName(edge.selectExpr("blocked as task", "cast(null as bigint) as b", "blocker as c"))
    return both.groupBy("task").agg(F.array_sort(F.collect_set("b")).alias("blocks"), F.array_sort(F.collect_set("c")).alias("blocked_by"))


def delete(tasks: DataFrame, edge: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks without those in ``gone(task)``, and edges without their ends."""
    left = edge.join(gone.withColumnRenamed("task", "blocker"), "blocker", "left_anti")
    return tasks.join(gone, "task", "left_anti"), left.join(gone.withColumnRenamed("task", "blocked"), "blocked", "left_anti")


def update_guard(task_id: str, exists: str, n_unknown: str, unknown: str, blocks_itself: str) -> str:
    """SQL: why an update is refused, or null; a refusal changes nothing."""
    return (
        f"case when {task_id} is null then '{MISSING_ID}' when not {exists} then '{UNKNOWN_TASK}' "
        f"when {n_unknown} > 0 then concat('{UNKNOWN_RELATED}', {unknown}) when {blocks_itself} then '{SELF_BLOCK}' end"
    )


def progress(tasks: DataFrame, *by: str) -> DataFrame:
    """Counts with fixed keys, the share completed (rounded half up), and what to do next.

    ``tasks(status, error)``; other statuses count as unfinished only.
    """
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    open_ = F.col("status") != "completed"
    action = f"case when bool_or(status <> 'completed' and error is null) then '{ACTIVE}' when bool_or(status <> 'completed') then '{REPORT}' else '{DONE}' end"
    percent = F.expr("cast(floor(100D * count_if(status = 'completed') / greatest(count(*), 1) + 0.5) as bigint)")
    may_finish = ~F.coalesce(F.bool_or(open_ & F.col("error").isNull()), F.lit(False))
    return tasks.groupBy(*by).agg(*counts, percent.alias("percent"), F.expr(action).alias("next_action"), may_finish.alias("may_finish"))


def new_ids(tasks: DataFrame, counter: int, order: str) -> DataFrame:
    """Ids after the counter for new rows; ids of deleted tasks are never used again."""
    return ordering.numbered(tasks, order, name="id", start=counter + 1)


# --- the tools' views ----------------------------------------------------------------------------------------------

# The tools whose calls are counted.
TOOLS = ("TaskCreate", "TaskGet", "TaskList", "TaskUpdate")


def tool_calls(calls: DataFrame, *by: str) -> DataFrame:
    """``task_tool_calls`` of each group of ``calls(tool, ...)``; other tools do not count."""
    return calls.groupBy(*by).agg(F.count_if(F.col("tool").isin(*TOOLS)).alias("task_tool_calls"))


def _with_edges(tasks: DataFrame, edge: DataFrame) -> DataFrame:
    none = F.array().cast("array<bigint>")
    both = tasks.join(adjacency(edge), "task", "left")
    return both.withColumn("blocks", F.coalesce("blocks", none)).withColumn("blocked_by", F.coalesce("blocked_by", none))


def got(tasks: DataFrame, edge: DataFrame) -> DataFrame:
    """What reading one task shows: its public record. Owner, metadata and the active form stay inside."""
    return _with_edges(tasks, edge).select("task", "subject", "description", "status", "blocks", "blocked_by")


def listed(tasks: DataFrame, edge: DataFrame) -> DataFrame:
    """What a list shows of each task; an owner only where there is one."""
    return _with_edges(tasks, edge).select("task", "subject", "status", F.expr("nullif(owner, '')").alias("owner"), "blocked_by")


def update_results(updates: DataFrame, task: str, order: str, start: str = "pending") -> DataFrame:
    """The answer to each of ``updates(task, order, fields, status)``.

    ``success, updated_fields, from_status, to_status, error``.  ``fields`` are
    the arguments' names in the order given.  Deleting a task reports its status
    alone, whatever else was asked, and later updates find no task.  The two
    statuses are there only where the status changed.
    """
    earlier = Window.partitionBy(task).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.max((F.col("status") == "deleted").cast("int")).over(earlier), F.lit(0)) > 0
    before = F.coalesce(F.last("status", ignorenulls=True).over(earlier), F.lit(start))
    facts = updates.withColumn("gone", gone).withColumn("before", before)
    changed = F.expr("not gone and status is not null and status <> before")
    return facts.select(
        task,
        order,
        (~F.col("gone")).alias("success"),
        F.expr("case when gone then cast(array() as array<string>) when status = 'deleted' then array('status') else fields end").alias("updated_fields"),
        F.when(changed, F.col("before")).alias("from_status"),
        F.when(changed, F.col("status")).alias("to_status"),
        F.when(F.col("gone"), F.lit(UNKNOWN_TASK)).alias("error"),
    )
