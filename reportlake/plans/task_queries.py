"""Queries on tasks, dispatch, metrics, compaction, OCR plans and event streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from reportlake.operators import catalog, compaction, dispatch, markdown, ocr, ordering, tasks
from reportlake.plans import fixtures as X
from reportlake.plans.registry import query, table
from reportlake.sources import sessions
from reportlake.streaming import folds

SETTINGS = ocr.OcrConfig("http://ocr.test", "reader").settings_digest()


def _tasks(spark, sf):
    found = tasks.replay(X.task_log(spark, sf), "task", "seq", ("status", "error", "k"))
    return found.withColumn("error", F.expr("nullif(error, '')"))


@query("task_replay", f"WITH {X.D_LOG}, {X.D_TASKS} SELECT * FROM tasks")
def task_replay(spark, sf):
    return _tasks(spark, sf)


@query("task_list", f"WITH {X.D_LOG}, {X.D_TASKS} SELECT row_number() OVER (ORDER BY task) AS position, task, status FROM tasks")
def task_list(spark, sf):
    return ordering.numbered(_tasks(spark, sf).select("task", "status"), "task")


D_COUNTS = "count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'completed') AS completed"
D_SHARE = "CAST(floor(100.0 * count(*) FILTER (status = 'completed') / greatest(count(*), 1) + 0.5) AS BIGINT)"
D_ACTION = f"CASE WHEN bool_or(status <> 'completed' AND error IS NULL) THEN '{tasks.ACTIVE}' WHEN bool_or(status <> 'completed') THEN '{tasks.REPORT}' ELSE '{tasks.DONE}' END"
D_BY = f"WITH {X.D_LOG}, {X.D_TASKS}, grouped AS (SELECT *, task % 10 AS session FROM tasks)"


def _progress(spark, sf):
    return tasks.progress(_tasks(spark, sf).withColumn("session", F.expr("task % 10")), "session")


@query("task_progress", f"{D_BY} SELECT session, {D_COUNTS} FROM grouped GROUP BY session")
def task_progress(spark, sf):
    return _progress(spark, sf).select("session", *tasks.STATUSES)


@query("task_percent", f"{D_BY} SELECT session, {D_SHARE} AS percent FROM grouped GROUP BY session")
def task_percent(spark, sf):
    return _progress(spark, sf).select("session", "percent")


@query("task_next_action", f"{D_BY} SELECT session, {D_ACTION} AS next_action FROM grouped GROUP BY session")
def task_next_action(spark, sf):
    return _progress(spark, sf).select("session", "next_action")


@query("completion_guard", f"{D_BY} SELECT session, NOT coalesce(bool_or(status <> 'completed' AND error IS NULL), false) AS may_finish FROM grouped GROUP BY session")
def completion_guard(spark, sf):
    return _progress(spark, sf).select("session", "may_finish")


@query("task_unfinished", f"{D_BY} SELECT session, string_agg(task || ':' || status || coalesce(':' || error, ''), ',' ORDER BY task) AS unfinished FROM grouped WHERE status <> 'completed' GROUP BY session")
def task_unfinished(spark, sf):
    open_ = _tasks(spark, sf).where("status <> 'completed'").withColumn("session", F.expr("task % 10"))
    listed = F.array_sort(F.collect_list(F.struct("task", F.expr("concat(task, ':', status, coalesce(concat(':', error), ''))").alias("t"))))
    return open_.groupBy("session").agg(F.array_join(F.transform(listed, lambda x: x["t"]), ",").alias("unfinished"))


@query("task_status_changes", f"WITH {X.D_LOG} SELECT * FROM (SELECT task, seq, coalesce(lag(status) OVER (PARTITION BY task ORDER BY seq), 'pending') AS from_status, status AS to_status FROM log WHERE status IS NOT NULL) WHERE from_status <> to_status")
def task_status_changes(spark, sf):
    return tasks.status_changes(X.task_log(spark, sf), "task", "seq").select("task", "seq", "from_status", "to_status")


D_EDGES = "links AS (SELECT user_id AS task, CASE WHEN event_id % 2 = 0 THEN 'blocks' ELSE 'blockedBy' END AS relation, CAST(event_id % 50 AS BIGINT) AS related FROM events), edges AS (SELECT DISTINCT CASE WHEN relation = 'blocks' THEN task ELSE related END AS blocker, CASE WHEN relation = 'blocks' THEN related ELSE task END AS blocked FROM links WHERE task <> related)"


def _edges(spark, sf):
    links = table(spark, sf, "events").selectExpr("user_id as task", "case when event_id % 2 = 0 then 'blocks' else 'blockedBy' end as relation", "event_id % 50 as related")
    return tasks.edges(links)


@query("task_edges", f"WITH {D_EDGES} SELECT * FROM edges")
def task_edges(spark, sf):
    return _edges(spark, sf)


@query("task_adjacency", f"WITH {D_EDGES}, ends AS (SELECT blocker AS task FROM edges UNION SELECT blocked FROM edges) SELECT task, coalesce((SELECT string_agg(blocked, ',' ORDER BY blocked) FROM edges e WHERE e.blocker = ends.task), '') AS blocks, coalesce((SELECT string_agg(blocker, ',' ORDER BY blocker) FROM edges e WHERE e.blocked = ends.task), '') AS blocked_by FROM ends")
def task_adjacency(spark, sf):
    return tasks.adjacency(_edges(spark, sf)).selectExpr("task", "array_join(blocks, ',') as blocks", "array_join(blocked_by, ',') as blocked_by")


@query("task_delete", f"WITH {X.D_LOG}, {X.D_TASKS}, {D_EDGES} SELECT 'task' AS kind, task AS a, CAST(NULL AS BIGINT) AS b FROM tasks WHERE task % 5 <> 0 UNION ALL SELECT 'edge', blocker, blocked FROM edges WHERE blocker % 5 <> 0 AND blocked % 5 <> 0")
def task_delete(spark, sf):
    every, edges = _tasks(spark, sf), _edges(spark, sf)
    ends = edges.selectExpr("blocker as task").union(edges.selectExpr("blocked as task")).union(every.select("task"))
    left, links = tasks.delete(every, edges, ends.where("task % 5 = 0").distinct())
    return left.selectExpr("'task' as kind", "task as a", "cast(null as bigint) as b").unionByName(links.selectExpr("'edge' as kind", "blocker as a", "blocked as b"))


@query("task_ids", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) + 7 AS id FROM documents")
def task_ids(spark, sf):
    return tasks.new_ids(table(spark, sf, "documents").select("doc_id"), 7, "doc_id").selectExpr("doc_id", "cast(id as bigint) as id")


@query("metadata_merge", f"WITH {X.D_LOG} SELECT * FROM (SELECT task, key, arg_max(v, seq) AS value FROM (SELECT task, seq, 'k' || (CAST(k AS INT) % 3) AS key, CASE WHEN CAST(k AS INT) % 4 = 0 THEN '<null>' ELSE k END AS v FROM log WHERE k IS NOT NULL) GROUP BY 1, 2) WHERE value <> '<null>'")
def metadata_merge(spark, sf):
    """The last write of each key of a task; a null takes the key away."""
    clicks = X.task_log(spark, sf).where("k is not null").selectExpr("task", "seq", "concat('k', cast(k as int) % 3) as key", "case when cast(k as int) % 4 = 0 then null else k end as value")
    return tasks.merged_metadata(clicks, "task", "seq")


@query("metadata_maps", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'b=2,c=' || event_id ELSE 'a=1,b=2,c=' || event_id END AS merged FROM events")
def metadata_maps(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "map('a', '1', 'b', '2') as old", "map('a', case when event_id % 3 = 0 then null else '1' end, 'c', cast(event_id as string)) as new")
    merged = F.expr(tasks.merge_maps("old", "new"))
    return rows.withColumn("m", merged).selectExpr("event_id", "array_join(transform(array_sort(map_entries(m)), e -> concat(e.key, '=', e.value)), ',') as merged")


@query("guard_task_update", f"""WITH {X.D_LOG}, {X.D_TASKS} SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '{tasks.MISSING_ID}' WHEN event_id % 9 = 1 THEN '{tasks.UNKNOWN_TASK}' WHEN event_id % 9 = 2 THEN '{tasks.UNKNOWN_RELATED}-1' WHEN event_id % 9 = 3 THEN '{tasks.SELF_BLOCK}' END AS error FROM events""")
def guard_task_update(spark, sf):
    known = _tasks(spark, sf).selectExpr("task as known")
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "case event_id % 9 when 0 then null when 1 then -5 else user_id end as task", "filter(array(case event_id % 9 when 2 then -1 when 3 then user_id end), x -> x is not null) as related"
    )
    exists = rows.join(known, rows.task == known.known, "left")
    asked = exists.select("event_id", F.explode("related").alias("r")).join(known.withColumnRenamed("known", "r"), "r", "left_anti")
    missing = asked.groupBy("event_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.col("r").cast("string"))), ", ").alias("names"))
    facts = exists.join(missing, "event_id", "left")
    guard = tasks.update_guard("task", "(known is not null)", "coalesce(n, 0)", "names", "array_contains(related, task)")
    return facts.selectExpr("event_id", f"{guard} as error")


D_CALLS = "CASE event_type WHEN 'signup' THEN 'TaskCreate' WHEN 'view' THEN 'TaskGet' WHEN 'purchase' THEN 'TaskUpdate' WHEN 'error' THEN 'TaskList' ELSE 'SearchReport' END"


@query("tool_calls", f"SELECT user_id % 10 AS session, count(*) FILTER ({D_CALLS} LIKE 'Task%') AS task_tool_calls FROM events GROUP BY 1")
def tool_calls(spark, sf):
    return tasks.tool_calls(table(spark, sf, "events").selectExpr("user_id % 10 as session", f"{D_CALLS} as tool"), "session")


D_ANSWERS = """u AS (SELECT user_id AS task, event_id AS seq, CASE event_type WHEN 'view' THEN 'in_progress' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN CASE WHEN event_id % 20 = 0 THEN 'deleted' ELSE 'pending' END END AS status,
    CASE event_type WHEN 'view' THEN 'status' WHEN 'purchase' THEN 'owner,status' WHEN 'error' THEN 'status,metadata' WHEN 'click' THEN 'metadata' ELSE 'subject,description' END AS fields FROM events),
    w AS (SELECT *, coalesce(max(CASE WHEN status = 'deleted' THEN 1 END) OVER e, 0) = 1 AS gone, coalesce(last_value(status IGNORE NULLS) OVER e, 'pending') AS before FROM u WINDOW e AS (PARTITION BY task ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("task_updates", f"WITH {D_ANSWERS} SELECT task, seq, NOT gone AS success, CASE WHEN gone THEN '' WHEN status = 'deleted' THEN 'status' ELSE fields END AS updated_fields, CASE WHEN NOT gone AND status <> before THEN before END AS from_status, CASE WHEN NOT gone AND status <> before THEN status END AS to_status, CASE WHEN gone THEN '{tasks.UNKNOWN_TASK}' END AS error FROM w")
def task_updates(spark, sf):
    asked = table(spark, sf, "events").selectExpr(
        "user_id as task", "event_id as seq",
        "case event_type when 'view' then 'in_progress' when 'purchase' then 'completed' when 'error' then case when event_id % 20 = 0 then 'deleted' else 'pending' end end as status",
        "case event_type when 'view' then array('status') when 'purchase' then array('owner', 'status') when 'error' then array('status', 'metadata') when 'click' then array('metadata') else array('subject', 'description') end as fields",
    )
    return tasks.update_results(asked, "task", "seq").withColumn("updated_fields", F.array_join("updated_fields", ","))


def _records(spark, sf):
    """Tasks with texts and, for every second one, an owner."""
    texts = "concat('subject ', task) as subject", "concat('description ', task) as description", "case when task % 2 = 0 then concat('worker', task % 3) else '' end as owner"
    return _tasks(spark, sf).selectExpr("task", *texts, "status", "k as active_form")


D_LISTS = "b AS (SELECT blocker AS task, string_agg(blocked, ',' ORDER BY blocked) AS blocks FROM edges GROUP BY 1), c AS (SELECT blocked AS task, string_agg(blocker, ',' ORDER BY blocker) AS blocked_by FROM edges GROUP BY 1)"


@query("task_get", f"WITH {X.D_LOG}, {X.D_TASKS}, {D_EDGES}, {D_LISTS} SELECT task, 'subject ' || task AS subject, 'description ' || task AS description, status, coalesce(blocks, '') AS blocks, coalesce(blocked_by, '') AS blocked_by FROM tasks LEFT JOIN b USING (task) LEFT JOIN c USING (task)")
def task_get(spark, sf):
    shown = tasks.got(_records(spark, sf), _edges(spark, sf))
    return shown.withColumn("blocks", F.array_join("blocks", ",")).withColumn("blocked_by", F.array_join("blocked_by", ","))


@query("task_summaries", f"WITH {X.D_LOG}, {X.D_TASKS}, {D_EDGES}, {D_LISTS} SELECT task, 'subject ' || task AS subject, status, CASE WHEN task % 2 = 0 THEN 'worker' || (task % 3) END AS owner, coalesce(blocked_by, '') AS blocked_by FROM tasks LEFT JOIN c USING (task)")
def task_summaries(spark, sf):
    return tasks.listed(_records(spark, sf), _edges(spark, sf)).withColumn("blocked_by", F.array_join("blocked_by", ","))


# --- metrics and dispatch ------------------------------------------------------------------------------------------

KEYS = [m["kpi_key"] for m in catalog.METRICS]
D_KEYS = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"
D_ASKED = f"asked AS (SELECT doc_id, CASE WHEN doc_id % 33 < 31 THEN ({D_KEYS})[1 + doc_id % 33] ELSE 'metric_' || (doc_id % 33) END AS kpi_key FROM documents)"
D_VALUES = ", ".join(f"('{m['kpi_key']}', '{m['name'].replace(chr(39), 2 * chr(39))}', {len(m['accepted_labels'])}, {len(m['rejected_labels'])})" for m in catalog.METRICS)
D_NAMES = f"names AS (SELECT * FROM (VALUES {D_VALUES}) v(kpi_key, name, labels, rejected))"


def _asked(spark, sf):
    keys = "array(" + ", ".join(f"'{k}'" for k in KEYS) + ")"
    return table(spark, sf, "documents").selectExpr("doc_id", f"case when doc_id % 33 < 31 then {keys}[cast(doc_id % 33 as int)] else concat('metric_', doc_id % 33) end as kpi_key")


@query("kpi_lookup", f"WITH {D_ASKED}, {D_NAMES} SELECT doc_id, kpi_key, name, CAST(labels AS INT) AS labels, CAST(rejected AS INT) AS rejected, CASE WHEN name IS NULL THEN 'unknown KPI key: ' || kpi_key END AS error FROM asked LEFT JOIN names USING (kpi_key)")
def kpi_lookup(spark, sf):
    found = catalog.lookup(_asked(spark, sf))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return found.select("doc_id", "kpi_key", "name", size("accepted_labels").alias("labels"), size("rejected_labels").alias("rejected"), "error")


@query("kpi_unknown", f"WITH {D_ASKED}, {D_NAMES} SELECT doc_id, kpi_key FROM asked WHERE kpi_key NOT IN (SELECT kpi_key FROM names)")
def kpi_unknown(spark, sf):
    return catalog.unknown(_asked(spark, sf)).select("doc_id", "kpi_key")


def scripted(task: dict) -> dict:
    """A worker with a known fault for each remainder of the id."""
    import json

    n = int(task["task_id"])
    if n % 5 == 1:
        json.loads("{")
    if n % 5 == 2:
        return {"status": "found"}
    if n % 5 == 3:
        raise ConnectionError
    return dispatch.null_worker(task)


def _contract(result: dict) -> str | None:
    return None if result.get("notes") else "notes are missing"


def _outcomes(spark, sf):
    asked = table(spark, sf, "labels").selectExpr("cast(doc_id as string) as task_id", "doc_id as ordinal", "'r' as report_ref", "'revenue' as kpi_key")
    return dispatch.dispatch(asked, scripted, check=_contract, pause=0.0)


D_OUTCOMES = """outcomes AS (SELECT CAST(doc_id AS VARCHAR) AS task_id, doc_id AS ordinal, CASE WHEN doc_id % 5 IN (1, 2, 3) THEN 'failed' ELSE 'succeeded' END AS status,
    CASE doc_id % 5 WHEN 1 THEN 'worker_invalid_json' WHEN 2 THEN 'worker_invalid_result' WHEN 3 THEN 'worker_execution_failed' END AS error_code, CASE WHEN doc_id % 5 IN (1, 2) THEN true WHEN doc_id % 5 = 3 THEN false END AS retryable, CASE WHEN doc_id % 5 = 1 THEN 3 ELSE 1 END AS attempts FROM labels)"""


@query("dispatch_outcomes", f"WITH {D_OUTCOMES} SELECT * FROM outcomes")
def dispatch_outcomes(spark, sf):
    return _outcomes(spark, sf).select("task_id", "ordinal", "status", "error_code", "retryable", "attempts")


@query("dispatch_ordered", f"WITH {D_OUTCOMES} SELECT row_number() OVER (ORDER BY ordinal) AS position, task_id, status FROM outcomes")
def dispatch_ordered(spark, sf):
    return ordering.numbered(_outcomes(spark, sf).select("ordinal", "task_id", "status"), "ordinal").drop("ordinal")


@query("dispatch_retry_set", f"WITH {D_OUTCOMES} SELECT task_id FROM outcomes WHERE status = 'failed' AND retryable")
def dispatch_retry_set(spark, sf):
    return dispatch.retry_set(_outcomes(spark, sf)).select("task_id")


@query("dispatch_final", f"WITH {D_OUTCOMES} SELECT task_id, CASE WHEN retryable THEN 'succeeded' ELSE status END AS status, CASE WHEN retryable THEN NULL ELSE error_code END AS error_code FROM outcomes")
def dispatch_final(spark, sf):
    first = ordering.settled(_outcomes(spark, sf))  # every worker runs once
    again = dispatch.retry_set(first).select("task_id", "ordinal", F.lit("r").alias("report_ref"), F.lit("revenue").alias("kpi_key"))
    retried = dispatch.dispatch(again, dispatch.null_worker, check=_contract, pause=0.0)
    return dispatch.final(first, retried).select("task_id", "status", "error_code")


@query("classify_failures", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'worker_invalid_json' WHEN 1 THEN 'worker_invalid_result' WHEN 2 THEN 'worker_invalid_result' ELSE 'worker_execution_failed' END AS error_code, event_id % 4 < 3 AS retryable FROM events")
def classify_failures(spark, sf):
    raised = table(spark, sf, "events").selectExpr("event_id", "element_at(array('JSONDecodeError', 'WorkerResultError', 'ValidationError', 'TimeoutError'), cast(event_id % 4 + 1 as int)) as e")
    return raised.select("event_id", *[F.expr(sql).alias(name) for name, sql in dispatch.failure_columns("e").items()])


# --- compaction ----------------------------------------------------------------------------------------------------


@query("context_tokens", f"WITH {X.D_CONTENTS} SELECT scope, CAST(sum(length(json)) // 4 AS BIGINT) AS tokens FROM contents GROUP BY scope")
def context_tokens(spark, sf):
    return compaction.tokens(X.contents(spark, sf))


@query("context_digest", f"WITH {X.D_CONTENTS} SELECT scope, sha256(string_agg(json || chr(0), '' ORDER BY pos)) AS digest FROM contents GROUP BY scope")
def context_digest(spark, sf):
    return compaction.digests(X.contents(spark, sf))


@query("compaction_boundaries", f"WITH {X.D_CONTENTS}, {X.D_SAFE} SELECT scope, pos FROM safe")
def compaction_boundaries(spark, sf):
    return compaction.boundaries(X.contents(spark, sf))


D_SPLIT = (
    "tail AS (SELECT scope, pos, sum(length(json)) OVER (PARTITION BY scope ORDER BY pos DESC) AS t FROM contents), wanted AS (SELECT scope, coalesce(max(pos - 1) FILTER (t >= 400), 0) AS desired FROM tail GROUP BY scope), "
    "splits AS (SELECT scope, desired, coalesce((SELECT max(pos) FROM safe s WHERE s.scope = wanted.scope AND s.pos <= desired), 0) AS split FROM wanted)"
)


@query("compaction_split", f"WITH {X.D_CONTENTS}, {X.D_SAFE}, {D_SPLIT} SELECT scope, CAST(desired AS INT) AS desired, CAST(split AS INT) AS split FROM splits")
def compaction_split(spark, sf):
    return compaction.split(X.contents(spark, sf), 400).selectExpr("scope", "cast(desired as int) as desired", "cast(split as int) as split")


def _summaries(spark, sf):
    """A summary of the first item of every second scope; every fourth is stale."""
    first = compaction.digests(X.contents(spark, sf).where("pos = 1 and scope % 2 = 0"))
    return first.selectExpr("scope", "1 as prefix_count", "case when scope % 4 = 0 then digest else 'stale' end as prefix_digest", "'summary' as summary")


@query("compaction_plan", f"""WITH {X.D_CONTENTS}, {X.D_SAFE}, {D_SPLIT}, facts AS (SELECT s.scope, split, CASE WHEN s.scope % 4 = 0 THEN 1 END AS p, sum(length(json)) AS chars, sum(length(json)) FILTER (pos = 1) AS head FROM splits s JOIN contents c ON c.scope = s.scope GROUP BY ALL),
    eff AS (SELECT *, CAST((CASE WHEN p IS NULL THEN chars ELSE chars - head + 7 END) // 4 AS BIGINT) AS tokens FROM facts), act AS (SELECT *, CASE WHEN tokens < 200 THEN CASE WHEN p IS NULL THEN 'keep' ELSE 'reuse' END WHEN split = 0 THEN 'keep' WHEN split <= coalesce(p, 0) THEN 'reuse' ELSE 'summarize' END AS action FROM eff)
    SELECT scope, tokens, action, CASE WHEN action = 'summarize' THEN CAST(coalesce(p, 0) + 1 AS INT) END AS first_item, CASE WHEN action = 'summarize' THEN CAST(split AS INT) END AS split, action = 'summarize' AND p IS NOT NULL AS with_summary FROM act""")
def compaction_plan(spark, sf):
    found = compaction.plan(X.contents(spark, sf), _summaries(spark, sf), 200, 400)
    return found.selectExpr("scope", "cast(tokens as bigint) as tokens", "action", "cast(first_item as int) as first_item", "cast(split as int) as split", "with_summary")


@query("bounded_concat", "SELECT conv_id, turn, substr(text, 1, CAST(500 - used AS INT)) AS part FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations WHERE text <> '') WHERE used < 500")
def bounded_concat(spark, sf):
    return compaction.bounded_parts(table(spark, sf, "conversations"), "conv_id", "turn", "text", 500)


@query("scope_key", "SELECT conv_id, turn, role || ':' || substr(sha256(CASE WHEN turn = 0 THEN 'root' ELSE 'task/' || conv_id END), 1, 16) AS key FROM conversations")
def scope_key(spark, sf):
    rows = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "role", "case when turn > 0 then concat('task/', conv_id) end as scope")
    return rows.selectExpr("conv_id", "turn", f"{compaction.scope_key('role', 'scope')} as key")


# --- OCR -----------------------------------------------------------------------------------------------------------


@query("ocr_cache_key", f"SELECT doc_id, '{SETTINGS}/' || sha256(text) || '.md' AS cache_key FROM documents")
def ocr_cache_key(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", f"{ocr.cache_key('cast(text as binary)', SETTINGS)} as cache_key")


@query("ocr_cache_hit_miss", "SELECT d.doc_id, d.doc_id > f.first OR f.source0 AS hit FROM documents d JOIN (SELECT text, min(doc_id) AS first, bool_or(doc_id % 10 = 0) AS source0 FROM documents GROUP BY text) f USING (text)")
def ocr_cache_hit_miss(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 10 = 0").selectExpr(f"{ocr.cache_key('cast(text as binary)', SETTINGS)} as cache_key").distinct()
    return ocr.cache_plan(docs, "cast(text as binary)", "doc_id", SETTINGS, cache).select("doc_id", "hit")


@query("ocr_split_pages", f"SELECT source || (doc_id // 250) AS reply, doc_id, {X.d_strip('text')} AS section FROM documents WHERE {X.d_strip('text')} <> ''")
def ocr_split_pages(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("concat(source, doc_id div 250) as reply", "doc_id", "text")
    bodies = rows.groupBy("reply").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("d")).selectExpr("reply", "transform(filter(d, x -> trim(x.text) <> ''), x -> x.doc_id) as ids", "concat('<PAGE> ', array_join(transform(d, x -> x.text), '\\n<PAGE>\\n'), ' <PAGE>') as body")
    sections = bodies.select("reply", F.posexplode(F.arrays_zip(F.col("ids").alias("doc_id"), F.expr(ocr.split_sections("body")).alias("section"))).alias("at", "x"))
    return sections.select("reply", "x.doc_id", "x.section")


@query("ocr_batch_plan", "SELECT doc_id, CAST(i * 20 + 1 AS INT) AS first_page, CAST(least(20, 1 + doc_id % 90 - i * 20) AS INT) AS n FROM documents, unnest(range(0, 1 + (doc_id % 90) // 20)) u(i)")
def ocr_batch_plan(spark, sf):
    plan = F.expr(ocr.batch_plan("(1 + doc_id % 90)", 20))
    return table(spark, sf, "documents").select("doc_id", F.explode(plan).alias("b")).selectExpr("doc_id", "cast(b.first_page as int) as first_page", "b.n")


D_HALVES = """WITH RECURSIVE h AS (SELECT doc_id, 0 AS depth, 0 AS "offset", CAST(1 + doc_id % 30 AS INT) AS size FROM documents UNION ALL
    SELECT doc_id, depth + 1, CASE WHEN s = 0 THEN "offset" ELSE CAST("offset" + size // 2 AS INT) END, CASE WHEN s = 0 THEN CAST(size // 2 AS INT) ELSE CAST(size - size // 2 AS INT) END FROM h, (VALUES (0), (1)) v(s) WHERE size > 1)
    SELECT * FROM h"""


@query("ocr_bisect_plan", D_HALVES)
def ocr_bisect_plan(spark, sf):
    return ocr.bisections(table(spark, sf, "documents").selectExpr("doc_id", "1 + doc_id % 30 as n")).drop("n")


@query("ocr_fingerprint", f"SELECT '{ocr.OcrConfig('http://ocr.test', 'reader').fingerprint()}' AS fingerprint, '{SETTINGS}' AS settings")
def ocr_fingerprint(spark, sf):
    config = ocr.OcrConfig("http://ocr.test", "reader")
    return spark.createDataFrame([(config.fingerprint(), config.settings_digest())], "fingerprint string, settings string")


@query("ocr_batches")
def ocr_batches(spark, sf):
    """Extraction through the hooks: the texts' lines stand in for pages. Tested against the texts themselves."""
    docs = table(spark, sf, "documents").selectExpr("doc_id", "cast(text as binary) as content")
    render = lambda content: [p for p in content.decode().split("\n") if p.strip()]
    read = lambda pages, budget: ocr.SEPARATOR.join(pages)
    return ocr.extract(docs, "doc_id", render, read).selectExpr("doc_id", "length(markdown) as chars", "pages", "error")


@query("data_uri", "SELECT doc_id, 'data:image/png;base64,' || base64(encode(text)) AS uri FROM documents")
def data_uri(spark, sf):
    """Of a stand-in for an image: each text's bytes."""
    return table(spark, sf, "documents").selectExpr("doc_id", f"{ocr.data_uri('cast(text as binary)')} as uri")


# --- markdown ------------------------------------------------------------------------------------------------------

ROW = "concat('| ', doc_id, ' | a\\\\|b | ', lang, case doc_id % 3 when 0 then '' when 1 then ' | x' else ' | x | y | z' end, ' |')"


@query("parse_md_table", "SELECT doc_id, doc_id || ';a|b;' || lang || CASE doc_id % 3 WHEN 0 THEN ';' WHEN 1 THEN ';x' ELSE ';x | y | z' END AS cells, 'left,center,right,left' AS aligned, 'neutral' AS badge FROM documents")
def parse_md_table(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{ROW} as line").withColumn("raw", F.expr(markdown.cells("line"))).withColumn("rule", F.expr(markdown.cells("'|---|:---:|---:|:---|'")))
    fitted = F.expr(f"array_join({markdown.fitted('raw', '4')}, ';')").alias("cells")
    aligned = F.expr(f"case when {markdown.is_alignment('rule')} then array_join({markdown.alignments('rule')}, ',') end").alias("aligned")
    return rows.select("doc_id", fitted, aligned, F.expr(markdown.status_badge("raw[2]")).alias("badge"))


@query("md_block_kind", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'blank' WHEN 1 THEN 'fence' WHEN 2 THEN 'h' || least(2 + doc_id % 4, 6) WHEN 3 THEN 'ul' WHEN 4 THEN 'ol' ELSE 'p' END AS kind FROM documents")
def md_block_kind(spark, sf):
    line = "case doc_id % 6 when 0 then '  ' when 1 then '```py' when 2 then concat(repeat('#', cast(1 + doc_id % 4 as int)), ' ', lang) when 3 then '  - item' when 4 then '12. item' else concat('text ', lang) end"
    return table(spark, sf, "documents").selectExpr("doc_id", f"{line} as line").selectExpr("doc_id", f"{markdown.block_kind('line')} as kind")


# --- events --------------------------------------------------------------------------------------------------------


@query("state_delta_merge", "SELECT user_id, event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def state_delta_merge(spark, sf):
    return folds.state_delta(table(spark, sf, "events").selectExpr("user_id", "event_id", "event_type as key", "value"), "user_id", "event_id")


@query("scope_cleanup", "WITH ends AS (SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS cleared FROM events GROUP BY 1) SELECT user_id, event_type AS key, arg_max(value, event_id) AS value FROM events JOIN ends USING (user_id) WHERE event_id > coalesce(cleared, -1) GROUP BY 1, 2")
def scope_cleanup(spark, sf):
    """The state that is left where a purchase ends a user's scope."""
    deltas = table(spark, sf, "events").selectExpr("user_id", "event_id", "event_type as key", "value")
    return folds.live_state(deltas, "user_id", "event_id", "key = 'purchase'")


D_TOOL = "CASE event_type WHEN 'view' THEN 'SearchReport' WHEN 'click' THEN 'ReadReportChunks' WHEN 'signup' THEN 'GetKpiKnowledge' WHEN 'purchase' THEN 'finish_task' END"


def _phase_sql() -> str:
    return "CASE " + " ".join(f"WHEN tool = '{t}' THEN '{p}'" for t, p in folds.PHASES.items()) + " END"


@query("worker_phase", f"WITH e AS (SELECT *, {D_TOOL} AS tool FROM events WHERE event_id % 2 = 0 AND user_id % 3 <> 0), p AS (SELECT *, coalesce({_phase_sql()}, CASE WHEN event_id % 4 = 0 THEN '{folds.PHASES['finish_task']}' END) AS phase FROM e) SELECT CAST(user_id AS VARCHAR) AS task_id, arg_max(phase, event_id) FILTER (phase IS NOT NULL) AS phase FROM p WHERE phase IS NOT NULL GROUP BY 1")
def worker_phase(spark, sf):
    tool = "case event_type when 'view' then 'SearchReport' when 'click' then 'ReadReportChunks' when 'signup' then 'GetKpiKnowledge' when 'purchase' then 'finish_task' end"
    events = table(spark, sf, "events")
    rows = events.selectExpr("event_id", "concat('run/', event_id, '/', user_id, '/') as scope", "case when event_id % 2 = 0 then 'kpi_worker' else 'root_agent' end as author", f"{tool} as tool", "event_id % 4 = 0 as has_output")
    known = events.where("user_id % 3 <> 0").selectExpr("cast(user_id as string) as task_id").distinct()
    return folds.worker_phase(rows, known, "event_id")


@query("event_task_join", "SELECT event_id, CAST(user_id AS VARCHAR) AS task_id FROM events WHERE user_id % 3 <> 0")
def event_task_join(spark, sf):
    events = table(spark, sf, "events")
    known = events.where("user_id % 3 <> 0").selectExpr("cast(user_id as string) as task_id").distinct()
    last = "element_at(filter(split(concat('run/', event_id, '//', user_id), '/'), x -> x <> ''), -1)"
    return events.selectExpr("event_id", f"{last} as task_id").join(known, "task_id", "left_semi").select("event_id", "task_id")


@query("visible_text", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text ELSE '' END AS shown, CASE WHEN role <> 'assistant' THEN trim(text) ELSE '' END AS cleaned FROM conversations")
def visible_text(spark, sf):
    part = lambda t, thought: f"named_struct('text', {t}, 'thought', {thought})"
    parts = f"array({part('text', 'false')}, {part(chr(39) + 'hidden' + chr(39), 'true')})"
    mine = f"array({part('text', 'false')}, {part(chr(39) + '[Uploaded annual report artifact: x' + chr(39), 'false')})"
    rows = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "case when role = 'assistant' then 'root_agent' else 'user' end as author", f"{parts} as ps", f"{mine} as ms")
    return rows.selectExpr("conv_id", "turn", f"{sessions.visible_root_text('ps', 'author')} as shown", f"{sessions.clean_user_text('ms', 'author')} as cleaned")


@query("merge_partials", "SELECT conv_id, string_agg(text || '+' || text, '|' ORDER BY turn) AS shown FROM conversations GROUP BY conv_id")
def merge_partials(spark, sf):
    """Each turn arrives as two partial events and then as a final one that replaces them."""
    turns = table(spark, sf, "conversations")
    made = turns.selectExpr("conv_id", "turn", "explode(array(named_struct('n', 0, 'p', true, 't', text), named_struct('n', 1, 'p', true, 't', '...'), named_struct('n', 2, 'p', false, 't', concat(text, '+', text)))) as e")
    events = made.selectExpr("conv_id", "turn * 3 + e.n as seq", "concat('e', turn) as id", "'root_agent' as author", "e.p as partial", "e.t as text")
    return folds.merged_entries(events, "conv_id", "seq").selectExpr("conv_id", "array_join(transform(entries, x -> x.text), '|') as shown")


@query("budget_stream")
def budget_stream(spark, sf):
    """The budget over a stream of documents files; tested for equality with ``budget_fold``."""
    schema = table(spark, sf, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/documents.parquet*")
    calls = stream.selectExpr("concat(source, '_', doc_id div 2500) as scope", "n_chars * 10 as size")
    name = "budget_" + next(tempfile._get_candidate_names())
    run = folds.budget_stream(calls, "scope", "size").writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    last = spark.table(name).groupBy("scope").agg(F.max_by(F.struct("output_chars", "accepted", "refused"), F.expr("accepted + refused")).alias("b"))
    return last.select("scope", "b.output_chars", "b.accepted", "b.refused")
