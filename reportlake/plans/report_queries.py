"""Queries on reading, chunking, searching and access."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportlake.functions import text as T
from reportlake.operators import access, chunking, contracts, ordering, report_session, search, uploads
from reportlake.plans import fixtures as X
from reportlake.plans.registry import query, table
from reportlake.sources import config, reports, sessions

NL = X.NL


@query("report_manifest", f"WITH {X.D_REPORTS} SELECT report_ref, report_ref || '.md' AS artifact_name, 'text/markdown' AS mime_type, CAST(len(regexp_split_to_array(text, '(?i)<---\\s*Page Split\\s*--->')) AS BIGINT) AS total_pages, CAST(length(text) AS BIGINT) AS total_chars FROM reports")
def report_manifest(spark, sf):
    return chunking.manifests(X.reports(spark, sf))


@query("page_split", f"WITH {X.D_REPORTS}, {X.D_PAGES} SELECT report_ref, page, body FROM pages_")
def page_split(spark, sf):
    return chunking.split_pages(X.reports(spark, sf))


@query("page_heading", f"WITH {X.D_REPORTS}, {X.D_PAGES}, {X.D_HEADED} SELECT report_ref, page, heading FROM headed")
def page_heading(spark, sf):
    return chunking.with_headings(chunking.split_pages(X.reports(spark, sf))).drop("body")


@query("chunk_report", f"{X.D_CHUNKS} SELECT * FROM chunks")
def chunk_report(spark, sf):
    return X.chunks(spark, sf)


@query("chunk_documents", f"WITH RECURSIVE {X.d_pieces('documents', 'doc_id', 'text')} SELECT doc_id, CAST(k AS INT) AS chunk_index, piece AS text FROM w WHERE k >= 0")
def chunk_documents(spark, sf):
    return chunking.chunk_texts(table(spark, sf, "documents"), "doc_id")


D_STEM = "regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '([^.])\\.[^.]*$', '\\1')"


@query("report_ref", f"SELECT page_id, coalesce(nullif(trim(regexp_replace({D_STEM}, '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'report') AS report_ref FROM pages")
def report_ref(spark, sf):
    return table(spark, sf, "pages").selectExpr("page_id", f"{T.report_ref('url')} as report_ref")


def _artifacts(spark, sf):
    """Half of the reports as Markdown, half as JSON lines, of which some are broken."""
    number = "cast(regexp_extract(report_ref, 'src([0-9]+)_', 1) as int)"
    md = X.reports(spark, sf).where(f"{number} % 2 = 0").selectExpr("report_ref", "concat(report_ref, '.md') as artifact_name", "'text/markdown' as mime_type", "cast(text as binary) as content")
    made = X.chunks(spark, sf).where(f"{number} % 2 = 1").withColumn("line", F.expr("to_json(struct(chunk_id, page, heading, text))"))
    lines = made.groupBy("report_ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "chunk_index", "line"))), lambda x: x["line"]), "\n").alias("body"))
    broken = f"case when {number} % 5 = 0 then concat(body, '\\n{{\"chunk_id\":') else body end"
    jsonl = lines.selectExpr("report_ref", "concat(report_ref, '.jsonl') as artifact_name", "'application/x-ndjson' as mime_type", f"cast({broken} as binary) as content")
    return md.unionByName(jsonl)


D_NUMBER = "CAST(regexp_extract(report_ref, 'src([0-9]+)_', 1) AS INT)"


@query("scan_reports", f"{X.D_CHUNKS} SELECT report_ref, chunk_id, page, heading, text FROM chunks WHERE {D_NUMBER} % 2 = 0 OR {D_NUMBER} % 5 <> 0")
def scan_reports(spark, sf):
    return reports.load_chunks(_artifacts(spark, sf))[0]


@query("scan_errors", f"{X.D_CHUNKS} SELECT DISTINCT report_ref, '{chunking.BAD_JSONL}' AS error FROM chunks WHERE {D_NUMBER} % 2 = 1 AND {D_NUMBER} % 5 = 0")
def scan_errors(spark, sf):
    return reports.load_chunks(_artifacts(spark, sf))[1]


@query("scan_jsonl", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_jsonl(spark, sf):
    docs = table(spark, sf, "documents")
    return reports.from_jsonl(reports.to_jsonl(docs, docs.columns), "doc_id long, text string, lang string, source string, n_chars long")


@query("chunk_validity", f"""SELECT report_ref, arg_min(v, doc_id) FILTER (v IS NOT NULL) AS error, count(*) AS records FROM (SELECT source || '_' || (doc_id // 250) AS report_ref, doc_id,
    CASE WHEN doc_id % 41 = 0 THEN '{chunking.BAD_CHUNK}' WHEN length(text) > 6000 THEN '{chunking.LONG_CHUNK}' END AS v FROM documents) GROUP BY 1""")
def chunk_validity(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("concat(source, '_', doc_id div 250) as report_ref", "doc_id", "cast(doc_id as string) as chunk_id", "1 as page", "case when doc_id % 41 <> 0 then lang end as heading", "text")
    return chunking.report_validity(rows, "doc_id")


NAMED = "case page_id % 4 when 0 then concat('p', page_id, '.md') when 1 then concat('P', page_id, '.PDF') when 2 then concat('dir/p', page_id, '.Markdown') else url end"


@query("classify_attachments", """SELECT page_id, CASE WHEN page_id % 12 = 3 THEN 'pdf' WHEN page_id % 4 = 1 THEN 'pdf' WHEN page_id % 4 IN (0, 2) THEN 'markdown' ELSE 'other' END AS kind,
    page_id % 4 <> 3 AND length(html) <= 104857600 AS accepted FROM pages""")
def classify_attachments(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", f"{NAMED} as name", "case when page_id % 12 = 3 then 'application/pdf' end as mime", "length(html) as size")
    return rows.selectExpr("page_id", f"{uploads.kind('mime', 'name')} as kind", f"{uploads.may_upload('name', 'size')} as accepted")


@query("safe_filenames", """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'report_inv_' || page_id || '.md' WHEN page_id % 5 = 1 THEN 'a b-' || page_id || '.ocr.md' ELSE 'x' || page_id || '.md' END AS stored FROM pages""")
def safe_filenames(spark, sf):
    name = "case page_id % 5 when 0 then '' when 1 then concat('/tmp/a b-', page_id, '.pdf') else concat('up/x', page_id, '.md') end"
    rows = table(spark, sf, "pages").selectExpr("page_id", f"{uploads.safe_name(name, chr(39) + 'inv' + chr(39), 'page_id')} as name")
    return rows.selectExpr("page_id", f"{uploads.stored_name(uploads.kind('cast(null as string)', 'name'), 'name')} as stored")


D_PART = """CASE WHEN turn % 3 = 0 THEN '[Uploaded annual report artifact: "r' || turn || '.md"; use report_ref "r' || turn || '" for KPI tasks.]' ELSE text END"""


@query("rewrite_parts", f"SELECT conv_id, string_agg({D_PART}, chr(10) ORDER BY turn) AS parts FROM conversations GROUP BY conv_id")
def rewrite_parts(spark, sf):
    part = f"case when turn % 3 = 0 then {uploads.placeholder('name', T.report_ref('name'))} else text end"
    rows = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "concat('r', turn, '.md') as name", "text").selectExpr("conv_id", "turn", f"{part} as part")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "part")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n").alias("parts"))


@query("current_manifest", "SELECT conv_id, 'r' || max(turn) AS report_ref, CAST(arg_max(length(text), turn) AS BIGINT) AS total_chars FROM conversations WHERE turn % 3 = 0 GROUP BY conv_id")
def current_manifest(spark, sf):
    rows = table(spark, sf, "conversations").where("turn % 3 = 0").selectExpr("conv_id", "turn", "concat('r', turn, '.md') as name", "length(text) as n")
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("name", "n"), "turn").alias("m"))
    return last.selectExpr("conv_id", f"{T.report_ref('m.name')} as report_ref", "cast(m.n as bigint) as total_chars")


@query("list_samples", f"SELECT row_number() OVER (ORDER BY {X.d_fold('name')}, name) AS position, name, size, '/raw-pdf/' || replace(name, ' ', '%20') AS url FROM (SELECT CASE WHEN page_id % 2 = 0 THEN 'A ' ELSE 'b' END || page_id || CASE WHEN page_id % 3 = 0 THEN '.pdf' ELSE '.PDF' END AS name, CAST(length(html) AS INT) AS size, page_id FROM pages) WHERE page_id % 5 <> 0")
def list_samples(spark, sf):
    name = "case when page_id % 5 = 0 then 'x.md' else concat(case when page_id % 2 = 0 then 'A ' else 'b' end, page_id, case when page_id % 3 = 0 then '.pdf' else '.PDF' end) end"
    return reports.samples(table(spark, sf, "pages").selectExpr(f"{name} as name", "length(html) as size"))


D_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"


@query("valid_service_url", f"SELECT page_id, regexp_matches(url, '^https?://') AND {D_HOST} <> 'example.com' AND {D_HOST} NOT LIKE '%.example.com' AS valid FROM pages")
def valid_service_url(spark, sf):
    return table(spark, sf, "pages").selectExpr("page_id", f"{config.valid_url('url')} as valid")


@query("sse_parse", "SELECT user_id, event_id, event_type FROM events")
def sse_parse(spark, sf):
    record = F.expr("concat('event: message\\ndata: {\"event_id\":', event_id, ',\\ndata: \"event_type\":\"', event_type, '\"}\\n\\n')")
    bodies = table(spark, sf, "events").select("user_id", "event_id", record.alias("r")).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "r"))), lambda x: x["r"]), "").alias("body"))
    parsed = sessions.sse_payloads(bodies, "body", "user_id").select("user_id", F.from_json("payload", "event_id long, event_type string").alias("e"))
    return parsed.select("user_id", "e.event_id", "e.event_type")


@query("session_history", "SELECT row_number() OVER (ORDER BY last DESC, user_id) AS position, user_id, n FROM (SELECT user_id, max(ts) AS last, count(*) AS n FROM events GROUP BY user_id) ORDER BY last DESC, user_id LIMIT 20")
def session_history(spark, sf):
    """The twenty newest sessions: the limit is the feature."""
    from pyspark.sql import Window

    every = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    top = sessions.history(every, "last", "user_id")
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("last"), "user_id"))).select("position", "user_id", "n")


@query("session_title", "SELECT conv_id, substr(trim(regexp_replace(arg_min(text, turn), '\\s+', ' ', 'g')), 1, 60) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def session_title(spark, sf):
    first = table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.selectExpr("conv_id", f"{sessions.title('text')} as title")


@query("artifact_versions", "SELECT source AS artifact_name, doc_id, row_number() OVER (PARTITION BY source, doc_id // 250 ORDER BY doc_id) - 1 AS version FROM documents")
def artifact_versions(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("concat(source, '/', doc_id div 250) as artifact_name", "doc_id")
    return reports.next_versions(rows, "doc_id").selectExpr("split(artifact_name, '/')[0] as artifact_name", "doc_id", "cast(version as bigint) as version")


# --- text ----------------------------------------------------------------------------------------------------------


@query("query_terms", f"WITH {X.D_SEARCHES}, {X.D_PARSED} SELECT query_id, array_to_string(terms, ' ') AS terms FROM parsed")
def query_terms(spark, sf):
    return X.searches(spark, sf).selectExpr("query_id", f"array_join({T.terms('query')}, ' ') as terms")


@query("query_phrase", f"WITH {X.D_SEARCHES}, {X.D_PARSED} SELECT query_id, phrase FROM parsed")
def query_phrase(spark, sf):
    return X.searches(spark, sf).selectExpr("query_id", f"{T.phrase('query')} as phrase")


@query("normalize_question", "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS question FROM conversations WHERE role = 'user' AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def normalize_question(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").selectExpr("conv_id", "turn", f"{T.collapse('text')} as question").where("question <> ''")


@query("payload_chars", "SELECT doc_id, CAST(length(to_json({'doc_id': doc_id, 'lang': lang, 'none': NULL, 'source': source})) AS INT) AS chars FROM documents")
def payload_chars(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", f"{access.payload_chars('struct(doc_id, lang, cast(null as string) as none, source)')} as chars")


@query("filename_year", "SELECT page_id, regexp_extract('Report_' || (1890 + page_id) || '.pdf', '((?:19|20)[0-9]{2})', 1) AS year FROM pages")
def filename_year(spark, sf):
    return table(spark, sf, "pages").selectExpr("page_id", "regexp_extract(concat('Report_', 1890 + page_id, '.pdf'), '((?:19|20)[0-9]{2})', 1) as year")


@query("format_bytes", "SELECT doc_id, CASE WHEN n_chars * 500 < 1048576 THEN printf('%.1f', floor(n_chars * 500 / 1024.0 * 10 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(n_chars * 500 / 1048576.0 * 10 + 0.5) / 10) || ' MB' END AS size FROM documents")
def format_bytes(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", f"{T.byte_size('(n_chars * 500)')} as size")


# --- search --------------------------------------------------------------------------------------------------------


def _scored(spark, sf, every=False):
    asked = X.searches(spark, sf) if every else X.constant_searches(spark)
    return search.score(X.chunks(spark, sf), asked)


@query("search_score", f"{X.D_SEARCH} SELECT query_id, chunk_id, score FROM scored WHERE score > 0")
def search_score(spark, sf):
    return _scored(spark, sf).where("score > 0").select("query_id", "chunk_id", "score")


@query("search_ranked", f"{X.D_SEARCH} SELECT query_id, report_ref, chunk_id, score, row_number() OVER (PARTITION BY query_id, report_ref {X.D_ORDER}) AS rank FROM scored WHERE score > 0")
def search_ranked(spark, sf):
    """Within each report, as a search has one."""
    return search.ranked(_scored(spark, sf), ("query_id", "report_ref")).select("query_id", "report_ref", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("search_topk", f"{X.D_SEARCH} SELECT * FROM (SELECT query_id, chunk_id, page, heading, score, row_number() OVER (PARTITION BY query_id {X.D_ORDER}) AS rank FROM scored) WHERE rank <= 8 AND score > 0 AND query_id = -2")
def search_topk(spark, sf):
    """One query over all reports: the best eight, which Spark takes without a full sort."""
    scored = _scored(spark, sf).where("query_id = -2")
    best = scored.orderBy(F.desc("score"), "page", "chunk_id").limit(search.MOST_HITS)
    return search.top_k(best).select("query_id", "chunk_id", "page", "heading", "score", F.col("rank").cast("long").alias("rank"))


@query("search_topk_per_query", f"{X.D_SEARCH_ALL} SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id {X.D_ORDER}) AS rank FROM scored) WHERE rank <= 8 AND score > 0")
def search_topk_per_query(spark, sf):
    return search.top_k(_scored(spark, sf, True)).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("search_snippets", f"{X.D_SEARCH} SELECT query_id, report_ref, chunk_id, page, heading, score, {X.D_SNIPPET} AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY query_id, report_ref {X.D_ORDER}) AS rank FROM scored) WHERE rank <= 8 AND score > 0")
def search_snippets(spark, sf):
    return search.hits(search.top_k(_scored(spark, sf), by=("query_id", "report_ref")))


@query("search_page2", f"{X.D_SEARCH} SELECT query_id, report_ref, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, report_ref {X.D_ORDER}) AS rank FROM scored) WHERE rank > 3 AND rank <= 6 AND score > 0")
def search_page2(spark, sf):
    return search.top_k(_scored(spark, sf), 3, 3, ("query_id", "report_ref")).select("query_id", "report_ref", "chunk_id", F.col("rank").cast("long").alias("rank"))


D_STATS = f"{X.D_SEARCH}, stats AS (SELECT query_id, report_ref, count(*) AS scanned_chunks, count(*) FILTER (score > 0) AS total_matches FROM scored GROUP BY 1, 2)"


@query("search_stats", f"{D_STATS} SELECT * FROM stats")
def search_stats(spark, sf):
    return search.stats(_scored(spark, sf), ("query_id", "report_ref"))


@query("search_has_next", f"{D_STATS} SELECT query_id, report_ref, CASE WHEN 11 < total_matches THEN 11 END AS next_offset FROM stats")
def search_has_next(spark, sf):
    stats = search.stats(_scored(spark, sf), ("query_id", "report_ref"))
    return stats.selectExpr("query_id", "report_ref", f"{search.next_offset(3, 8)} as next_offset")


@query("search_session", f"{X.D_SEARCH} SELECT rank, CASE WHEN rank <= 3 THEN 1 ELSE 2 END AS page_of_hits, chunk_id, page, score, {X.D_SNIPPET} AS snippet FROM (SELECT *, row_number() OVER ({X.D_ORDER}) AS rank FROM scored WHERE query_id = -2 AND score > 0) WHERE rank <= 8")
def search_session(spark, sf):
    """One caller's two pages of hits over all reports, the second by the first one's cursor: three hits, then five."""
    session = report_session.ReportSession(ordering.settled(X.chunks(spark, sf)), "all")
    asked = dict(X.SEARCHES)[-2]
    first = session.search(asked, limit=3)
    second = session.search(asked, first["next_cursor"], 5) if first["next_cursor"] else {"items": []}
    rows = [(n, which, i["chunk_id"], i["page"], i["score"], i["snippet"]) for n, (which, i) in enumerate([*((1, i) for i in first["items"]), *((2, i) for i in second["items"])], 1)]
    return spark.createDataFrame(rows, "rank long, page_of_hits int, chunk_id string, page int, score long, snippet string")


# --- access --------------------------------------------------------------------------------------------------------


@query("guard_manifest", f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{access.NO_MANIFEST}' WHEN event_id % 5 = 1 THEN '{access.WRONG_REF}' WHEN event_id % 5 = 2 THEN '{access.NO_ARTIFACT}' END AS error FROM events""")
def guard_manifest(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "case when event_id % 5 > 0 then concat('r', event_id % 5) end as have", "concat('r', greatest(event_id % 5, 2)) as asked", "case when event_id % 5 <> 2 then 'a.md' end as artifact")
    return rows.selectExpr("event_id", f"{access.manifest_guard('have', 'asked', 'artifact')} as error")


ACCESS = ["event_id", "case event_id % 3 when 0 then 'kpi_worker' when 1 then 'report_qa_worker' else 'root_agent' end as agent", "event_id % 2 = 0 as kpi", "case when event_id % 5 < 3 then concat('r', event_id % 5) end as question_ref", "'r1' as ref"]
D_ACCESS = "CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 WHEN event_id % 3 = 1 THEN event_id % 5 = 1 ELSE event_id % 2 = 0 OR event_id % 5 = 1 END"


@query("guard_access", f"SELECT event_id, {D_ACCESS} AS allowed FROM events")
def guard_access(spark, sf):
    return table(spark, sf, "events").selectExpr(*ACCESS).selectExpr("event_id", f"{access.may_access('agent', 'kpi', 'question_ref', 'ref')} as allowed")


@query("guard_search", f"""SELECT event_id, CASE WHEN NOT ({D_ACCESS}) THEN '{access.NO_SEARCH_ACCESS}' WHEN event_id % 7 = 0 THEN '{access.EMPTY_QUERY}' WHEN event_id % 11 IN (0, 9, 10) THEN '{access.BAD_LIMIT}'
    WHEN event_id % 64 >= 60 THEN '{access.SEARCHES_SPENT}' WHEN event_id % 13 = 1 THEN '{access.BAD_CURSOR}' WHEN event_id % 13 = 2 THEN '{access.OTHER_CURSOR}' END AS error FROM events""")
def guard_search(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        *ACCESS, "case when event_id % 7 = 0 then '  ' else 'revenue' end as query", "event_id % 11 as lim", "event_id % 64 as calls",
        "case when event_id % 13 < 4 and event_id % 13 > 0 then 'token' end as cursor", "case when event_id % 13 in (2, 3) then 'r1' end as cursor_ref", "case event_id % 13 when 2 then 'other' when 3 then case when event_id % 7 = 0 then '  ' else 'revenue' end end as cursor_query",
    )
    allowed = rows.withColumn("allowed", F.expr(access.may_access("agent", "kpi", "question_ref", "ref")))
    return allowed.selectExpr("event_id", f"{access.search_guard('allowed', 'query', 'lim', 'calls', 'cursor', 'cursor_ref', 'cursor_query', 'ref')} as error")


def _requests(spark, sf):
    """Each document asks for two to five chunks of its report; every third id has not been returned."""
    docs = table(spark, sf, "documents")
    ids = "transform(sequence(1, cast(1 + doc_id % 4 as int)), i -> concat(source, '_', doc_id div 250, ':p', i + doc_id % 3, ':c0'))"
    return docs.selectExpr("doc_id as request_id", f"{ids} as chunk_ids")


D_REQUESTS = "requests AS (SELECT doc_id AS request_id, CAST(i AS INT) - 1 AS position, source || '_' || (doc_id // 250) || ':p' || (i + doc_id % 3) || ':c0' AS chunk_id FROM documents, unnest(range(1, 2 + doc_id % 4)) u(i))"
D_RETURNED = "returned AS (SELECT * FROM chunks WHERE page % 3 <> 0)"


@query("read_chunks", f"{X.D_CHUNKS}, {D_REQUESTS} SELECT request_id, position, chunk_id, page, heading, text FROM requests JOIN chunks USING (chunk_id)")
def read_chunks(spark, sf):
    return access.read_chunks(_requests(spark, sf), X.chunks(spark, sf)).select("request_id", "position", "chunk_id", "page", "heading", "text")


@query("last_line_wins", "SELECT source || (doc_id % 3) AS chunk_id, arg_max(text, doc_id) AS text FROM documents GROUP BY 1")
def last_line_wins(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("concat(source, doc_id % 3) as chunk_id", "doc_id", "text")
    return access.last_lines(rows, "doc_id")


def _returned(spark, sf):
    return X.chunks(spark, sf).where("page % 3 <> 0")


@query("read_authorized", f"{X.D_CHUNKS}, {D_REQUESTS}, {D_RETURNED} SELECT request_id, position, chunk_id FROM requests WHERE chunk_id IN (SELECT chunk_id FROM returned)")
def read_authorized(spark, sf):
    asked = _requests(spark, sf).select("request_id", F.posexplode("chunk_ids").alias("position", "chunk_id"))
    return asked.join(_returned(spark, sf).select("chunk_id"), "chunk_id", "left_semi").select("request_id", "position", "chunk_id")


@query("read_unauthorized", f"{X.D_CHUNKS}, {D_REQUESTS}, {D_RETURNED} SELECT request_id, position, chunk_id FROM requests WHERE chunk_id NOT IN (SELECT chunk_id FROM returned)")
def read_unauthorized(spark, sf):
    asked = _requests(spark, sf).select("request_id", F.posexplode("chunk_ids").alias("position", "chunk_id"))
    return asked.join(_returned(spark, sf).select("chunk_id"), "chunk_id", "left_anti").select("request_id", "position", "chunk_id")


@query("read_body_chars", f"{X.D_CHUNKS}, {D_REQUESTS} SELECT request_id, CAST(sum(length(text)) AS BIGINT) AS body_chars FROM requests JOIN chunks USING (chunk_id) GROUP BY 1")
def read_body_chars(spark, sf):
    return access.read_chunks(_requests(spark, sf), X.chunks(spark, sf)).groupBy("request_id").agg(F.sum(F.length("text")).alias("body_chars"))


@query("guard_read", f"""{X.D_CHUNKS}, {D_REQUESTS}, {D_RETURNED}, j AS (SELECT request_id, count(*) AS n, count(DISTINCT chunk_id) AS d, count(*) FILTER (r.text IS NULL) AS un, coalesce(sum(length(r.text)), 0) AS chars FROM requests LEFT JOIN returned r USING (chunk_id) GROUP BY 1)
    SELECT request_id, CASE WHEN request_id % 10 = 9 THEN '{access.NO_READ_ACCESS}' WHEN n < 1 OR n > 3 OR d <> n THEN '{access.BAD_IDS}' WHEN un > 0 THEN '{access.NOT_RETURNED}' WHEN request_id % 43 >= 40 THEN '{access.READS_SPENT}' WHEN chars > 18000 THEN '{access.TOO_MUCH}' END AS error FROM j""")
def guard_read(spark, sf):
    asked = _requests(spark, sf).select("request_id", F.explode("chunk_ids").alias("chunk_id"))
    joined = asked.join(_returned(spark, sf).select("chunk_id", F.length("text").alias("n_chars")), "chunk_id", "left")
    facts = joined.groupBy("request_id").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("d"), F.count_if(F.col("n_chars").isNull()).alias("un"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))
    guard = access.read_guard("(request_id % 10 <> 9)", "n", "d", "un", "(request_id % 43)", "0", "chars")
    return facts.selectExpr("request_id", f"{guard} as error")


@query("authorized_set", f"{X.D_CHUNKS}, {D_RETURNED} SELECT report_ref, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunk_ids FROM returned GROUP BY 1")
def authorized_set(spark, sf):
    return access.authorised(_returned(spark, sf), "report_ref").selectExpr("report_ref", "array_join(chunk_ids, ',') as chunk_ids")


@query("ids_except", "SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1, 2) THEN '' ELSE 'c' || (doc_id % 5) END AS unauthorised FROM documents")
def ids_except(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", "array_join(array_except(array('c0', concat('c', doc_id % 5)), array('c0', 'c1', 'c2')), ',') as unauthorised")


@query("ids_union", "SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1, 2) THEN 'c0,c1,c2' ELSE 'c0,c1,c2,c' || (doc_id % 5) END AS authorised FROM documents")
def ids_union(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", "array_join(array_sort(array_union(array('c0', concat('c', doc_id % 5)), array('c0', 'c1', 'c2'))), ',') as authorised")


def _calls(spark, sf):
    return table(spark, sf, "documents").selectExpr("concat(source, '_', doc_id div 2500) as scope", "doc_id", "n_chars * 10 as size")


@query("budget_running", "SELECT doc_id, CAST(sum(n_chars * 10) OVER (PARTITION BY source, doc_id // 2500 ORDER BY doc_id) AS BIGINT) AS used_if_none_refused FROM documents")
def budget_running(spark, sf):
    """An upper bound of what is used, exact up to the first refusal."""
    from pyspark.sql import Window

    return _calls(spark, sf).select("doc_id", F.sum("size").over(Window.partitionBy("scope").orderBy("doc_id")).alias("used_if_none_refused"))


D_FOLD = """WITH RECURSIVE calls AS (SELECT source || '_' || (doc_id // 2500) AS scope, row_number() OVER (PARTITION BY source, doc_id // 2500 ORDER BY doc_id) AS i, n_chars * 10 AS n FROM documents),
    f AS (SELECT scope, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS refused FROM (SELECT DISTINCT scope FROM calls)
    UNION ALL SELECT f.scope, c.i, CASE WHEN used + n > 480000 THEN used ELSE used + n END, CASE WHEN used + n > 480000 THEN accepted ELSE accepted + 1 END, CASE WHEN used + n > 480000 THEN refused + 1 ELSE refused END FROM f JOIN calls c ON c.scope = f.scope AND c.i = f.i + 1)
    SELECT scope, arg_max(used, i) AS output_chars, arg_max(accepted, i) AS accepted, arg_max(refused, i) AS refused FROM f GROUP BY scope"""


@query("budget_fold", D_FOLD)
def budget_fold(spark, sf):
    return access.budget_fold(_calls(spark, sf), "scope", "doc_id", "size")


@query("evidence_check", f"{X.D_CHUNKS} SELECT chunk_id, contains(text, CASE WHEN page % 2 = 0 THEN substr(text, 11, 40) ELSE substr(text, 11, 40) || '#' END) AS verified FROM chunks")
def evidence_check(spark, sf):
    """Whether quoted evidence occurs in the chunk that it names."""
    quoted = "case when page % 2 = 0 then substring(text, 11, 40) else concat(substring(text, 11, 40), '#') end"
    return X.chunks(spark, sf).selectExpr("chunk_id", f"contains(text, {quoted}) as verified")


# --- contracts -----------------------------------------------------------------------------------------------------

D_CASES = "cases AS (SELECT d.doc_id, l.quality, l.toxic, d.n_chars FROM documents d JOIN labels l USING (doc_id))"


def _cases(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")


@query("check_kpi_result", f"""WITH {D_CASES} SELECT doc_id, CASE WHEN s = 'odd' THEN 'unknown status' WHEN s IN ('found', 'explicit_zero') AND (v IS NULL OR toxic = 1) THEN '{contracts.NEEDS_VALUE}' WHEN s = 'explicit_zero' AND v <> 0 THEN '{contracts.NEEDS_ZERO}'
    WHEN s IN ('absent', 'ambiguous') AND v IS NOT NULL THEN '{contracts.NEEDS_NULL}' WHEN s = 'absent' AND quality = 0 THEN '{contracts.NEEDS_SCOPE}' END AS violation
    FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN 'found' WHEN 1 THEN 'explicit_zero' WHEN 2 THEN 'absent' WHEN 3 THEN 'ambiguous' ELSE 'odd' END AS s, CASE WHEN n_chars % 3 > 0 THEN n_chars % 3 - 1 END AS v FROM cases)""")
def check_kpi_result(spark, sf):
    rows = _cases(spark, sf).selectExpr("doc_id", "case doc_id % 5 when 0 then 'found' when 1 then 'explicit_zero' when 2 then 'absent' when 3 then 'ambiguous' else 'odd' end as status", "cast(case when n_chars % 3 > 0 then n_chars % 3 - 1 end as double) as value", "toxic = 0 as evidence", "quality as notes")
    return rows.selectExpr("doc_id", f"{contracts.kpi_result('status', 'value', 'evidence', 'notes')} as violation")


@query("check_qa_result", f"""WITH {D_CASES} SELECT doc_id, CASE WHEN n_chars > 4000 THEN 'question length' WHEN e > 5 THEN 'evidence count' WHEN e > 0 AND n_chars > 2000 THEN 'evidence length' WHEN s = 'answered' AND (a IS NULL OR trim(a) = '' OR e = 0) THEN '{contracts.NEEDS_ANSWER}'
    WHEN s <> 'answered' AND a IS NOT NULL THEN '{contracts.NO_ANSWER}' WHEN s <> 'answered' AND quality = 0 THEN '{contracts.NEEDS_NOTES}' END AS violation
    FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'answered' WHEN 1 THEN 'not_found' ELSE 'ambiguous' END AS s, CASE n_chars % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'yes' END AS a, doc_id % 7 AS e FROM cases)""")
def check_qa_result(spark, sf):
    rows = _cases(spark, sf).selectExpr("doc_id", "case doc_id % 3 when 0 then 'answered' when 1 then 'not_found' else 'ambiguous' end as status", "repeat('q', cast(n_chars as int)) as question", "case n_chars % 3 when 0 then ' ' when 1 then 'yes' end as answer", "doc_id % 7 as n", "n_chars as longest", "quality as notes")
    return rows.selectExpr("doc_id", f"{contracts.qa_result('status', 'question', 'answer', 'n', 'longest', 'notes')} as violation")


@query("check_outcome", f"""WITH {D_CASES} SELECT doc_id, CASE WHEN s = 'succeeded' AND (quality = 0 OR e IS NOT NULL OR c IS NOT NULL OR r IS NOT NULL) THEN '{contracts.ONLY_RESULT}' WHEN s = 'failed' AND (quality = 1 OR e IS NULL OR c IS NULL OR r IS NULL) THEN '{contracts.NEEDS_FAILURE}' END AS violation
    FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS s, CASE WHEN n_chars % 4 = 1 THEN 'e' END AS e, CASE WHEN n_chars % 4 = 1 THEN 'c' END AS c, CASE WHEN n_chars % 4 = 1 THEN true END AS r FROM cases)""")
def check_outcome(spark, sf):
    rows = _cases(spark, sf).selectExpr("doc_id", "case when doc_id % 2 = 0 then 'succeeded' else 'failed' end as status", "quality = 1 as result", "case when n_chars % 4 = 1 then 'e' end as error", "case when n_chars % 4 = 1 then 'c' end as code", "case when n_chars % 4 = 1 then true end as retryable")
    return rows.selectExpr("doc_id", f"{contracts.outcome('status', 'result', 'error', 'code', 'retryable')} as violation")


@query("normalize_results", "SELECT doc_id, 'absent' AS status, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS DOUBLE) END AS value, CAST(NULL AS VARCHAR) AS unit FROM documents")
def normalize_results(spark, sf):
    """Missing fields of a result read as null."""
    made = "case when doc_id % 2 = 0 then to_json(named_struct('status', 'absent', 'value', n_chars)) else to_json(named_struct('status', 'absent')) end"
    parsed = table(spark, sf, "documents").selectExpr("doc_id", f"from_json({made}, 'status string, value double, unit string, source_value string, source_unit string, notes array<string>') as r")
    return parsed.selectExpr("doc_id", "r.status", "r.value", "r.unit")
