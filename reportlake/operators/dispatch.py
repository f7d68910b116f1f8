"""Fan-out of tasks to workers with failures kept apart.

A worker is any callable from a task (a dict) to a result (a dict).  Partitions
take the place of concurrent branches; a worker's failure becomes the outcome of
its own task and never fails the job.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Worker = Callable[[dict], dict | None]

ATTEMPTS, PAUSE = 3, 0.1
OUTCOME = "task_id string, ordinal long, status string, result string, error string, error_code string, retryable boolean, attempts int"
# Code, guidance, retryable.
FAILURES = {
    "worker_invalid_json": ("worker did not return a valid structured response after 3 attempts; retry only this item and keep sibling results", True),
    "worker_invalid_result": ("worker returned an incomplete or invalid structured result; retry only this item and keep sibling results", True),
    "worker_execution_failed": ("worker could not complete this item; keep sibling results and report it as unfinished", False),
}


class WorkerResultError(ValueError):
    """A worker ended without a usable result."""


def null_worker(task: dict) -> dict:
    """Finds nothing and says so: a legal result for every task."""
    return {**{k: task[k] for k in ("task_id", "report_ref", "kpi_key") if k in task}, "status": "absent", "value": None, "notes": ["no worker is configured"]}


def classify(error: BaseException) -> str:
    """The failure code of an exception, whatever wraps it."""
    seen: set[int] = set()
    while getattr(error, "error", None) is not None and isinstance(error.error, BaseException) and id(error) not in seen:
        seen.add(id(error))
        error = error.error
    if isinstance(error, json.JSONDecodeError):
        return "worker_invalid_json"
    return "worker_invalid_result" if isinstance(error, ValueError) else "worker_execution_failed"


def attempt(worker: Worker, task: dict, check: Callable[[dict], str | None] | None = None, pause: float = PAUSE) -> dict:
    """One task's outcome. Only malformed JSON is tried again."""
    for n in range(1, ATTEMPTS + 1):
        try:
            result = worker(task)
            if not isinstance(result, dict):
                raise WorkerResultError("no task result")
            if check and (why := check(result)):
                raise WorkerResultError(why)
            return {"status": "succeeded", "result": json.dumps(result, ensure_ascii=False, sort_keys=True), "error": None, "error_code": None, "retryable": None, "attempts": n}
        except Exception as e:
            code = classify(e)
            if code == "worker_invalid_json" and n < ATTEMPTS:
                time.sleep(pause)
                continue
            guidance, retryable = FAILURES[code]
            return {"status": "failed", "result": None, "error": guidance, "error_code": code, "retryable": retryable, "attempts": n}
    raise AssertionError


def dispatch(tasks: DataFrame, worker: Worker, concurrency: int = 4, check: Callable[[dict], str | None] | None = None, pause: float = PAUSE) -> DataFrame:
    """Outcomes of ``tasks(task_id, ordinal, ...)``; order them by ``ordinal``."""
    names = tasks.columns

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            rows = [{"task_id": r[names.index("task_id")], "ordinal": r[names.index("ordinal")], **attempt(worker, dict(zip(names, r, strict=True)), check, pause)} for r in frame.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTCOME.split(", ")])

    return tasks.repartition(concurrency).mapInPandas(run, OUTCOME)


def failure_columns(exception: str) -> dict[str, str]:
    """SQL for ``error_code`` and ``retryable`` from an exception's class name."""
    code = f"case when {exception} = 'JSONDecodeError' then 'worker_invalid_json' when {exception} in ('WorkerResultError', 'ValidationError') then 'worker_invalid_result' else 'worker_execution_failed' end"
    return {"error_code": code, "retryable": f"({exception} in ('JSONDecodeError', 'WorkerResultError', 'ValidationError'))"}


def retry_set(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("status = 'failed' and retryable")


def final(first: DataFrame, retried: DataFrame) -> DataFrame:
    """The retry's outcome where there is one, else the first."""
    others = [c for c in first.columns if c != "task_id"]
    again = retried.select("task_id", F.lit(True).alias("again"), *[F.col(c).alias(f"r_{c}") for c in others])
    return first.join(again, "task_id", "left").select("task_id", *[F.when(F.col("again"), F.col(f"r_{c}")).otherwise(F.col(c)).alias(c) for c in others])
