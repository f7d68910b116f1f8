"""Inputs that the tables do not hold as such, in Spark and as SQL for DuckDB.

A report is made of up to 250 consecutive documents of one source, a page each,
so its size does not grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.operators import chunking
from reportlake.plans.registry import table

JOINER = "\n\n<--- Page Split --->\n\n"
#: Constant searches, beside the first two words of every benchmark item.
SEARCHES = [(-1, "annual report"), (-2, "the the on"), (-3, "été"), (-4, "license copyright"), (-5, "  The   Of  "), (-6, "weiß straße")]


def reports(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    blank = f"case when doc_id % 7 = 0 then '{JOINER}' else '' end".replace("\n", "\\n")  # a blank page before every seventh
    body = f"concat({blank}, '# ', lang, ' ', doc_id, '\\n\\n', replace(text, '.\\n', '.\\n\\n'))"
    pages = docs.selectExpr("concat(source, '_', doc_id div 250) as report_ref", "doc_id", f"{body} as body")
    gathered = pages.groupBy("report_ref").agg(F.array_sort(F.collect_list(F.struct("doc_id", "body"))).alias("p"))
    return gathered.select("report_ref", F.array_join(F.transform("p", lambda x: x["body"]), JOINER).alias("text"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_reports(reports(spark, sf))


def searches(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").selectExpr("item_id as query_id", "regexp_extract(text, '^(\\\\S+\\\\s+\\\\S+)', 1) as query")
    return items.unionByName(spark.createDataFrame(SEARCHES, "query_id long, query string"))


def constant_searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query_id long, query string")


def task_log(spark: SparkSession, sf: str) -> DataFrame:
    """``task, seq, status, error, k`` from each user's events."""
    status = "case event_type when 'signup' then 'pending' when 'view' then 'in_progress' when 'purchase' then 'completed' when 'error' then 'pending' end"
    return table(spark, sf, "events").selectExpr(
        "user_id as task", "event_id as seq", f"{status} as status", "case when event_type = 'error' then concat('error ', event_id) when event_type = 'purchase' then '' end as error",
        "case when event_type = 'click' then get_json_object(props, '$.k') end as k", "event_type", "value",
    )


def contents(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as contents: turns 1, 5, 9 ... call a tool that turns 3, 7, 11 ... answer."""
    return table(spark, sf, "conversations").selectExpr(
        "conv_id as scope", "cast(turn + 1 as int) as pos", "text as json",
        "case when turn % 4 = 1 then array(concat('c', turn)) else cast(array() as array<string>) end as calls",
        "case when turn % 4 = 3 then array(concat('c', turn - 2)) else cast(array() as array<string>) end as responses", "role",
    )


# --- the same for DuckDB -------------------------------------------------------------------------------------------

NL = "chr(10)"


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A\\s+|\\s+\\z', '', 'g')"


def d_fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def d_pieces(source: str, keys: str, text: str) -> str:
    """A recursive table ``w(keys, k, piece, rem)``; pieces have ``k >= 0``."""
    return (
        f"w AS (SELECT {keys}, -1 AS k, '' AS piece, {d_strip(text)} AS rem FROM {source} UNION ALL SELECT {keys}, k + 1, "
        f"CASE WHEN length(rem) <= 6000 THEN rem ELSE {d_strip('substr(rem, 1, b)')} END, "
        f"CASE WHEN length(rem) <= 6000 THEN '' ELSE {d_strip('substr(rem, b + 1)')} END "
        f"FROM (SELECT *, CASE WHEN l = 0 OR 6000 - l < 3000 THEN 6000 ELSE 6000 - l END AS b FROM (SELECT *, strpos(reverse(substr(rem, 1, 6001)), {NL} || {NL}) AS l FROM w)) WHERE rem <> '')"
    )


D_REPORTS = (
    "reports AS (SELECT source || '_' || (doc_id // 250) AS report_ref, string_agg(CASE WHEN doc_id % 7 = 0 THEN chr(10) || chr(10) || '<--- Page Split --->' || chr(10) || chr(10) ELSE '' END || '# ' || lang || ' ' || doc_id || "
    f"{NL} || {NL} || replace(text, '.' || {NL}, '.' || {NL} || {NL}), {NL} || {NL} || '<--- Page Split --->' || {NL} || {NL} ORDER BY doc_id) AS text FROM documents GROUP BY 1)"
)
D_PAGES = (
    f"pages_ AS (SELECT report_ref, CAST(i AS INT) AS page, {d_strip('parts[i]')} AS body FROM (SELECT report_ref, regexp_split_to_array(text, '(?i)<---\\s*Page Split\\s*--->') AS parts FROM reports) t, "
    "unnest(range(1, len(parts) + 1)) u(i))"
)
D_HEADED = "headed AS (SELECT report_ref, page, body, CASE WHEN h = '' OR h IS NULL THEN 'Annual Report' ELSE substr(h, 1, 200) END AS heading FROM (SELECT *, regexp_extract(body, '(?m)^#{1,6}\\s+(.+?)\\s*$', 1) AS h FROM pages_ WHERE body <> ''))"
D_CHUNKS = (
    f"WITH RECURSIVE {D_REPORTS}, {D_PAGES}, {D_HEADED}, {d_pieces('headed', 'report_ref, page, heading', 'body')}, "
    "chunks AS (SELECT report_ref, report_ref || ':p' || page || ':c' || k AS chunk_id, page, CAST(k AS INT) AS chunk_index, heading, piece AS text FROM w WHERE k >= 0)"
)
D_CONSTANT = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{q}')" for i, q in SEARCHES) + ") v(query_id, query))"
D_SEARCHES = D_CONSTANT[:-1] + " UNION ALL SELECT item_id, regexp_extract(text, '^(\\S+\\s+\\S+)', 1) FROM benchmark)"
D_PARSED = f"parsed AS (SELECT query_id, query, regexp_extract_all({d_fold('query')}, '[a-z0-9]+') AS terms, trim(regexp_replace({d_fold('query')}, '\\s+', ' ', 'g')) AS phrase FROM asked)"
D_SCORED = (
    f"scored AS (SELECT c.*, q.query_id, q.terms, f, CAST(coalesce(list_sum(list_transform(terms, lambda x: (length(h) - length(replace(h, x, ''))) // length(x))), 0) "
    "+ CASE WHEN phrase = '' THEN 0 ELSE 10 * ((length(h) - length(replace(h, phrase, ''))) // length(phrase)) END AS BIGINT) AS score "
    f"FROM (SELECT *, {d_fold('text')} AS f, {d_fold('heading')} || {NL} || {d_fold('text')} AS h FROM chunks) c, parsed q)"
)
D_SEARCH = f"{D_CHUNKS}, {D_CONSTANT}, {D_PARSED}, {D_SCORED}"
D_SEARCH_ALL = f"{D_CHUNKS}, {D_SEARCHES}, {D_PARSED}, {D_SCORED}"
D_SNIPPET = "substr(text, 1 + greatest(0, coalesce(list_min(list_transform(list_filter(terms, lambda t: contains(f, t)), lambda t: strpos(f, t) - 1)), 0) - 150), 600)"
D_ORDER = "ORDER BY score DESC, page, chunk_id"

D_STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'in_progress' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'pending' END"
D_LOG = (
    f"log AS (SELECT user_id AS task, event_id AS seq, {D_STATUS} AS status, CASE WHEN event_type = 'error' THEN 'error ' || event_id WHEN event_type = 'purchase' THEN '' END AS error, "
    "CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k') END AS k, event_type, value FROM events)"
)
D_TASKS = (
    "tasks AS (SELECT task, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, nullif(arg_max(error, seq) FILTER (error IS NOT NULL), '') AS error, "
    "arg_max(k, seq) FILTER (k IS NOT NULL) AS k FROM log GROUP BY task)"
)
D_CONTENTS = (
    "contents AS (SELECT conv_id AS scope, CAST(turn + 1 AS INT) AS pos, text AS json, CASE WHEN turn % 4 = 1 THEN 'c' || turn END AS call, CASE WHEN turn % 4 = 3 THEN 'c' || (turn - 2) END AS response, role FROM conversations)"
)
D_SAFE = (
    "opened AS (SELECT c.scope, c.pos, (SELECT min(a.pos) FROM contents a WHERE a.scope = c.scope AND a.response = c.call AND a.pos > c.pos) AS until FROM contents c WHERE c.call IS NOT NULL), "
    "safe AS (SELECT c.scope, c.pos FROM contents c WHERE NOT EXISTS (SELECT 1 FROM opened o WHERE o.scope = c.scope AND o.pos <= c.pos AND (o.until IS NULL OR o.until > c.pos)))"
)
